"""Uniform shuffle into shards of exact sizes.

The hypergeometric communication matrix: rows are staged once with a number in
their source partition; from the partitions' row counts the driver draws
``M[p, s]``, how many rows of partition p go to shard s, as one multivariate
hypergeometric draw a partition, so that columns sum to shard sizes that differ
by one at most. A keyed permutation of each partition's row numbers is the
local shuffle: rank ``r`` of partition p goes to the shard in whose part of row
p of the cumulated matrix r lies, and arrives there at a place that the columns'
cumulated sums give. One exchange moves the rows, and a second keyed
permutation of each shard's places gives the slots. Both permutations are
Feistel networks with cycle walking: a function of the number alone, so no
partition or shard is ever held, and a lost executor repeats the same rows.

The matrix has one row of 2 x shards numbers for each source partition. Up to ``PLAN_BYTES`` it is
broadcast, so that the rows move once; beyond that it is joined as a table by source partition.

Defined cases: equal or repeated rows, null keys, null and very long texts are rows like any
others, each with a slot of its own; an empty table gives no rows; more shards
than rows leave shards empty; a column of the input named ``shard`` or ``slot`` is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, unused

SEED = 20_240_501
#: Bytes of the matrix up to which it is broadcast.
PLAN_BYTES = 32 << 20
#: Rows of one slot block; a block stays together in the exchange.
BLOCK = 4096
_PART_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permute(at: np.ndarray, size: np.ndarray, stream: np.ndarray, seed: int) -> np.ndarray:
    """The place of ``at`` in a keyed permutation of ``range(size)``.

    ``stream`` tells permutations apart. Six Feistel rounds over the least even
    number of bits that holds ``size``; a value outside walks on until inside.
    """
    at, size, stream = (np.asarray(x, dtype=np.int64).astype(np.uint64) for x in (at, size, stream))
    bits = np.ceil(np.log2(np.maximum(size.astype(np.float64), 2))).astype(np.uint64) + np.uint64(1)
    half = bits >> np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    base = _mix(stream + np.uint64(1), seed)
    out, todo = at.copy(), np.arange(len(at))
    while len(todo):
        h, m, b = half[todo], mask[todo], base[todo]
        left, right = out[todo] >> h, out[todo] & m
        for k in range(6):
            left, right = right, left ^ (_mix(right + b, seed + 7919 * (k + 1)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw; numpy's own below its limit of 10^9, else by inverting the distribution around its mode."""
    if not good or not draws:
        return 0
    if not bad:
        return draws
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    sd = (draws * (good / n) * (bad / n) * max(1.0, (n - draws)) / max(1, n - 1)) ** 0.5
    reach = int(40 * sd) + 60
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(logs - logs.max())
    return a + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum()))


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """``M[p, s]``: exact row counts from source p to shard s; shard sizes differ by one at most."""
    total = sum(rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    rng = np.random.default_rng(seed)
    out = np.zeros((len(rows), shards), dtype=np.int64)
    for p, n in enumerate(rows):
        left, over = n, sum(room)
        for s in range(shards):
            over -= room[s]
            out[p, s] = x = _hypergeometric(rng, room[s], over, left)
            left -= x
        room = [r - int(x) for r, x in zip(room, out[p], strict=True)]
    return out


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """All rows of ``df``, moved to their shards, with ``shard`` int and ``slot`` long.

    Sizes of shards differ by one at most; slots are gapless from 0; which row
    gets which slot is a uniform shuffle keyed by ``seed``.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    row_id, p_, n_, ends_, start_, rank_, block_ = unused(df, "row_id", "source", "source_rows", "ends", "starts", "source_rank", "slot_block")
    rows = stage(df.withColumn(row_id, F.monotonically_increasing_id()), "shard-source")
    part = F.shiftright(row_id, _PART_BITS).cast("int")
    counts = dict(rows.groupBy(part.alias("p")).count().collect())  # one row for each source partition
    parts = sorted(counts)
    m = communication_matrix([counts[p] for p in parts], shards, seed)
    sizes = m.sum(0)
    ends, offsets = m.cumsum(1), m.cumsum(0) - m
    plan = [(p, int(n), e.tolist(), o.tolist()) for p, n, e, o in zip(parts, m.sum(1), ends, offsets - (ends - m), strict=True)]
    plan = spark.createDataFrame(plan, f"`{p_}` int, `{n_}` long, `{ends_}` array<long>, `{start_}` array<long>")

    @F.pandas_udf("long")
    def place(at: pd.Series, size: pd.Series, stream: pd.Series) -> pd.Series:
        return pd.Series(permute(at.to_numpy(), size.to_numpy(), stream.to_numpy(), seed))

    small = len(parts) * (2 * shards + 3) * 8 <= PLAN_BYTES
    dealt = rows.withColumn(p_, part).join(F.broadcast(plan) if small else plan, p_)
    at = F.col(row_id).bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    dealt = dealt.withColumn(rank_, place(at, F.col(n_), F.col(p_).cast("long")))
    dealt = dealt.withColumn("shard", F.size(F.filter(ends_, lambda e: e <= F.col(rank_))))
    arrival = F.col(rank_) + F.get(start_, F.col("shard"))
    size_of = F.when(F.col("shard") < int(sizes.sum() % shards), F.lit(int(sizes.sum() // shards) + 1)).otherwise(F.lit(int(sizes.sum() // shards)))
    dealt = dealt.withColumn("slot", place(arrival, size_of.cast("long"), (F.col("shard") + (1 << 31)).cast("long")))
    dealt = dealt.drop(p_, n_, ends_, start_, rank_, row_id)
    # Dealt by shard and slot block into partitions of the advisory size, whatever the data's: adaptive execution splits and joins them.
    dealt = dealt.withColumn(block_, F.floor(F.col("slot") / BLOCK)).hint("rebalance", F.col("shard"), F.col(block_))
    return dealt.sortWithinPartitions("shard", "slot").drop(block_)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_into_shards(table(spark, sf_dir, "documents"), 8)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
