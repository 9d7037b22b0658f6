"""Best-fit packing of token sequences by fitted length patterns.

Each text becomes ids (byte-level BPE, then an end id); a document longer than
the capacity is cut into pieces of exactly that length, the first of which may be
shorter. The histogram of piece lengths - a table of at most ``capacity`` rows - goes to the
driver, which enumerates patterns of up to three lengths that fill a sequence,
fits how often each is used to the histogram by non-negative least squares,
rounds down to what the histogram holds, and packs the residual by best fit over
lengths. The plan is a list of slots (length, first rank, count, first sequence, offset),
bounded by the number of patterns and not by the data. Every piece gets a rank among those of
its length - a count within its task plus the counts of the tasks before - and so its slot.

Tokenising runs once: pieces with their ids are staged, and later steps read
the stage, whose ids are not shuffled again while the counts of lengths by task are few
enough to be sent to all. How ids come fast and equal the tokenizer's: ``tokens``.

Defined cases: a null or empty text is the end id alone; texts are whole
however long; repeated rows and null doc_ids are packed like any others; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, stage, table
from .shingles import chunks
from .tokens import Encoder

CAPACITY = 1024
END_ID = 2
#: Rows (of 20 bytes) of piece counts up to which these are broadcast; beyond it the join is a shuffle.
BROADCAST_ROWS = 500_000


def split_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of ``n`` ids: full pieces, the first may be shorter."""
    if n <= capacity:
        return [0]
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


_PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, rank long"


def _cutter(tokenizer: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for sub in chunks(batch, 1):
                out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "part", "rank")}
                for doc, ids in zip(sub.column(0).to_pylist(), encoder.encode(sub.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    starts = split_points(n, capacity)
                    for i, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        out["doc_id"].append(doc)
                        out["piece"].append(i)
                        out["start"].append(a)
                        out["length"].append(b - a)
                        out["ids"].append(ids[4 * a : 4 * b])
                        out["part"].append(part)
                        out["rank"].append(seen[b - a])
                        seen[b - a] += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return cut


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three lengths (0: none), longest first, that sum to ``capacity`` exactly."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths[lengths > 0]] = True
    have[0] = True
    a, b = np.meshgrid(np.flatnonzero(have)[1:], np.flatnonzero(have), indexing="ij")
    c = capacity - a - b
    ok = (b <= a) & (c >= 0) & (c <= b)
    a, b, c = a[ok], b[ok], c[ok]
    ok = have[c] & ((b > 0) | (c == 0))
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def fit(shapes: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeats x >= 0 of each pattern: least squares of (lengths used - counts), by multiplicative updates."""
    if not len(shapes):
        return np.zeros(0)
    size = len(counts)
    # Lengths of the empty third or second place do not count.
    weight = np.ones(size)
    weight[0] = 0
    target = counts * weight
    gather = lambda v: v[shapes].sum(1)  # noqa: E731  A'v
    uses = np.zeros(size)
    for j in range(3):
        uses += np.bincount(shapes[:, j], minlength=size)
    x = np.minimum.reduce([np.where(shapes[:, j] > 0, target[shapes[:, j]] / np.maximum(uses[shapes[:, j]], 1), np.inf) for j in range(3)])
    up = gather(target)
    for _ in range(rounds):
        now = np.zeros(size)
        for j in range(3):
            now += np.bincount(shapes[:, j], weights=x, minlength=size)
        x = x * up / np.maximum(gather(now * weight), 1e-12)
    return x


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, count, first sequence, offset), and the number of sequences.

    Piece number r of a length, from 0, gets the slot with first rank <= r <
    first rank + count, in sequence first sequence + r - first rank.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    used, slots, sequences = np.zeros(capacity + 1, dtype=np.int64), [], 0

    def put(shape: list[int], times: int) -> None:
        nonlocal sequences
        at = 0
        for length in shape:
            slots.append((int(length), int(used[length]), int(times), sequences, at))
            used[length] += times
            left[length] -= times
            at += int(length)
        sequences += int(times)

    if left[capacity]:
        put([capacity], int(left[capacity]))
    shapes = patterns(np.flatnonzero(left), capacity)
    x = fit(shapes, left.astype(np.float64))
    for i in np.argsort(-x, kind="stable"):
        times = int(x[i] + 0.5)
        if not times:
            break
        shape = [int(v) for v in shapes[i] if v]
        need = {v: shape.count(v) for v in shape}
        times = min([times, *(int(left[v]) // k for v, k in need.items())])
        if times:
            put(shape, times)
    # Residual: best fit over lengths, many equal pieces at once; an open group is (times, shape) by free room.
    room: dict[int, list[tuple[int, list[int]]]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        left[length] = 0
        while n:
            free = next((r for r in range(length, capacity) if room.get(r)), None)
            if free is None:
                # As many as fit go into one sequence; only what is left over opens another shape.
                each = max(1, capacity // length)
                for each in (each, n % each if n >= each else n):
                    times = n // each if each else 0
                    if times:
                        room.setdefault(capacity - each * length, []).append((times, [length] * each))
                        n -= times * each
                continue
            times, shape = room[free].pop()
            take = min(times, n)
            if take < times:
                room[free].append((times - take, shape))
            room.setdefault(free - length, []).append((take, [*shape, length]))
            n -= take
    for groups in room.values():
        for times, shape in groups:
            at = 0
            for length in shape:
                slots.append((int(length), int(used[length]), times, sequences, at))
                used[length] += times
                at += length
            sequences += times
    return slots, sequences


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) for all documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = stage(rows.mapInArrow(_cutter(tokenizer, capacity, end_id), _PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # Ranks start where the tasks before end: at most capacity rows a task.
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = checkpointed(counts.withColumn("before", F.coalesce(before, F.lit(0))))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    first = {}
    for length, rank, times, sequence, offset in slots:
        first.setdefault(length, []).append((rank, times, sequence, offset))
    ranks = {k: np.array(sorted(v), dtype=np.int64) for k, v in first.items()}

    # The plan's size is bounded by the patterns of three lengths (about capacity**2 / 12), not by the data.
    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), dtype=np.int64)
        n, r = length.to_numpy(), rank.to_numpy()
        for k in np.unique(n):
            at = np.flatnonzero(n == k)
            have = ranks[int(k)]
            i = np.searchsorted(have[:, 0], r[at], side="right") - 1
            out[at, 0] = have[i, 2] + r[at] - have[i, 0]
            out[at, 1] = have[i, 3]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    # At most capacity rows a task: sent to all where that is few, else joined by a shuffle of the pieces.
    few = counts.count() <= BROADCAST_ROWS
    before = counts.select("part", "length", "before")
    out = pieces.join(F.broadcast(before) if few else before, ["part", "length"])
    out = out.withColumn("s", slot("length", F.col("rank") + F.col("before")))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "s.sequence_id", "s.offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
