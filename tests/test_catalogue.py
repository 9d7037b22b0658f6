"""Every query with SQL gives the oracle's rows."""

import pytest

from vaultspark.plans import catalogue, vault_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_oracle(spark, duck, rows, name):
    assert rows(catalogue.QUERIES[name](spark, SF)) == duck(catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_others_have_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_every_version_of_every_object_is_listed(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn").collect()
    got = catalogue.QUERIES["list_versions"](spark, SF).collect()
    assert sorted((r.object_id, r.version) for r in got) == sorted((t.conv_id, t.turn + 1) for t in turns)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
