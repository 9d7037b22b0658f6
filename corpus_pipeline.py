"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
gives a DataFrame that is written as Parquet and reread as the next one's docs. All
but the last give the columns of documents. What a stage has staged is deleted when the
next one starts, as the stage's result has been written by then.

* toxicity: documents with a score of 0.7 or more go.
* line_dedup: repeated three-line windows go; so do documents that lose their whole text.
* jaccard_join: of each group of near duplicates the document with the smallest doc_id stays.
* decontamination: documents that hold a benchmark item go.
* packing: pieces of at most 1024 tokens, packed into sequences.

Defined cases, for every stage: columns beside those of documents are carried, whatever their names; null and empty texts are
kept (no gain, no lines, no shingles, no items; packed as an end id alone); rows that repeat doc_id and text are scored, cut and packed alike,
and are one document to the near-duplicate stage; null doc_ids are documents like any others; texts of any length are whole; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from vaultspark.llm.common import new_folder, release, table, tagged, unused

_TAG = "pipeline"


def _stage(f):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _TAG)
        with tagged(_TAG):
            return f(spark, docs, sf_dir)

    run_stage.__doc__ = f.__doc__
    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score accepts."""
    model = toxicity.train(*toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    (score,) = unused(docs, "score")
    return toxicity.score_texts(docs, model, score=score).where(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines."""
    lines, removed = unused(docs, "n_lines", "n_removed")
    out = line_dedup.dedup_lines(docs, n_lines=lines, n_removed=removed).where((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@_stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; rows that repeat doc_id and text are one."""
    groups = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
    own, text = unused(docs, "first_id", "text_hash")
    first = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias(own)).distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    return kept.withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).select(docs.columns)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in a packed sequence."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Scores, embeddings and tokenizers are not expressible in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        out = f(spark, docs, sf_dir)
        path = new_folder(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
