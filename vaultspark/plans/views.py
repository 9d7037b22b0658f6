"""Views that map the driver tables onto the vault's data model, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

F_SQL = """with f as (
  select source || '/' || lang || '.txt' as name, doc_id,
         row_number() over (partition by source, lang order by doc_id) as version,
         octet_length(encode(text)) as size_bytes, sha256(text) as manifest_id
  from documents)
"""
C_SQL = """with c as (
  select conv_id as object_id, turn + 1 as version, sha256(text) as manifest_id, octet_length(encode(text)) as size_bytes
  from conversations)
"""
M_SQL = """with mc as (
  select l_orderkey as manifest_id, l_partkey as chunk_id, cast(l_quantity as bigint) as raw_len,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 as ordinal
  from lineitem),
chunks as (select p_partkey as chunk_id, cast(p_size as bigint) as raw_len from part),
objects as (select o_orderkey as object_id, o_orderkey as manifest_id, o_orderstatus <> 'F' as bound, o_orderpriority as label from orders)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as versioned files: one row for each version of each name; the name is the object's id."""
    w = W.partitionBy("source", "lang").orderBy("doc_id")
    f = table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit(".txt")).alias("name"),
        F.row_number().over(w).cast("long").alias("version"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("manifest_id"),
        "doc_id",
    )
    return f.withColumn("object_id", F.col("name"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    return d.select(F.concat("source", F.lit("/"), "lang", F.lit(".txt")).alias("name")).withColumn("object_id", F.col("name"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as versions of a conversation."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("object_id"), (F.col("turn") + 1).alias("version"), F.sha2(F.col("text").cast("binary"), 256).alias("manifest_id"), F.octet_length("text").cast("long").alias("size_bytes")
    )


def manifest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    row = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)) - 1
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("manifest_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_quantity").cast("long").alias("raw_len"), row.cast("long").alias("ordinal"))


def chunk_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manifest_chunks without the order, for operators on sets."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("manifest_id"), F.col("l_partkey").alias("chunk_id"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_size").cast("long").alias("raw_len"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects; an order's manifest has its key."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object_id"), F.col("o_orderkey").alias("manifest_id"), (F.col("o_orderstatus") != "F").alias("bound"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
