"""N-gram Jaccard join with count vectors and R-trees.

A text's set is its distinct five-word shingles, as 64-bit hashes. Two texts
link when ``100 * intersection >= 75 * union``. Shingles are hashed into groups, a set is the point of its
group counts, and the overlap of two sets is at most the sum of the coordinate-wise minima. The bound
is used at three levels:

1. Against everything at once, the box of all other sets. With as many groups as there
   are shingle hashes its minima count the shingles that occur elsewhere too. A text that
   has more than ``n - ceil(0.75 n)`` shingles of its own can link with nothing and leaves.
   This runs over half of the hash space, as packed columns: 32-bit hashes dealt by bucket.
2. To deal the points of equal trees to one task: what is left is represented once for each
   distinct set; its shared groups, rarest first, have a prefix in which two linked sets must
   meet. Sets that meet are one candidate component.
3. In a candidate component, an R-tree over the count vectors: nodes hold coordinate maxima and the least size, and a
   query goes only where the summed minima reach the needed overlap. Pairs that survive are verified by exact intersection.

Only spanning links are kept: in a tree, sets outside of the largest linked cluster
search the tree for links across clusters, so groups of copies never become all pairs. A component
of more than ``BLOCK_SETS`` sets or ``BLOCK_SHINGLES`` shingles is cut into blocks, and all pairs of blocks are
searched, each in a task of its own; nothing is capped. Exact copies (equal sets)
are one class with the smallest doc_id as its representative.

Defined cases: null and empty texts, and texts without words, have no shingles and
link with nothing; null doc_ids are classes like any others, whose component_id is the
smallest known doc_id of the component (null if there is none); repeated rows are copies; an empty table gives no rows;
extra columns are ignored. Shingles are 64-bit hashes of words' 64-bit hashes, with a random multiplier for each byte's
and each word's place; a set with another hash for one shingle would need two of a pair's shingles to meet. Whole sets are told apart by
128 bits and their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, stage, table, trim
from .components import Forest, components, stars
from .shingles import chunks, mix, shingle_sets, text_bytes

#: Of 100: what intersection and union must have.
INTERSECTION, UNION = 100, 75
BLOCK_SETS, BLOCK_SHINGLES = 1500, 1_500_000
#: Rows taken out of an Arrow batch at once.
SLICE = 512
_ALL = 0xFFFF
_DOC = np.dtype([("doc", "<i8"), ("known", "u1"), ("text", "<i8"), ("node", "<i8"), ("check", "<i8"), ("n", "<i4"), ("need", "<i4")])
_PACKED = "bucket int, batch long, kind int, a binary, b binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def least_overlap(n: np.ndarray | int):
    """A set of ``n`` shares at least so many with any set it links with."""
    return (UNION * n + INTERSECTION - 1) // INTERSECTION


def linked(overlap, n, m):
    return INTERSECTION * overlap >= UNION * (n + m - overlap)


def _buckets(spark: SparkSession) -> int:
    return max(128, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(_PACKED_ARROW)], schema=_PACKED_ARROW)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive pieces, of which some are empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=values.dtype if values.dtype == np.uint64 else np.int64)]).astype(values.dtype if values.dtype == np.uint64 else np.int64)
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def set_keys(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of whole sets that share no step: sums of differently mixed shingles, and the size."""
    a, b = _sums(mix(s), n), _sums(mix(s ^ np.uint64(0x5DEECE66D)), n)
    return mix(a + n.astype(np.uint64)).view(np.int64), mix(b).view(np.int64)


def _by_bucket(order_key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(order_key, np.arange(buckets + 1))
    return at[:-1], at[1:]


def _deal(buckets: int):
    """Level 1, map side: documents' records, and half of their shingles by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for big in batches:
            for batch in chunks(big, 2):
                s, n = shingle_sets(*text_bytes(batch.column(2)))
                docs = np.zeros(batch.num_rows, dtype=_DOC)
                ids = batch.column(0)
                docs["doc"], docs["known"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
                docs["text"] = batch.column(1).to_numpy(zero_copy_only=False)
                docs["node"], docs["check"] = set_keys(s, n)
                docs["n"] = n
                owner = np.repeat(np.arange(len(n)), n)
                half = s < np.uint64(1 << 63)
                own = np.bincount(owner[half], minlength=len(n))
                docs["need"] = own - (n - least_overlap(n))
                h, owner = s[half], owner[half]
                bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((h, bucket))
                h, owner, bucket = h[order], owner[order], bucket[order]
                # What occurs twice in this batch is settled here, and sent once, for others.
                new = np.ones(len(h), dtype=bool)
                new[1:] = h[1:] != h[:-1]
                run_of = np.cumsum(new) - 1
                many = np.bincount(run_of)[run_of] > 1 if len(h) else np.zeros(0, dtype=bool)
                docs["need"] -= np.bincount(owner[many], minlength=len(n)).astype(np.int32)
                send = new | ~many
                low = h[send].astype(np.uint32)
                who = np.where(many[send], _ALL, owner[send]).astype(np.uint16)
                first, last = _by_bucket(bucket[send], buckets)
                out = [(int(number % buckets), number, 0, docs.tobytes(), None)]
                out += [(k, number, 1, low[a:b].tobytes(), who[a:b].tobytes()) for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)) if b > a]
                number += 1
                yield _rows(out)
        trim()

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows whose first ``keys`` columns are equal; rows come sorted."""
    key, held = None, []
    for big in batches:
        for at in range(0, big.num_rows, SLICE):
            batch = big.slice(at, SLICE)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:keys] != key:
                    if held:
                        yield key, held
                    key, held = row[:keys], []
                held.append(row)
    if held:
        yield key, held


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level 1, by bucket: for each batch's documents, how many of their shingles occur elsewhere too."""
    for _, rows in _grouped(batches, 1):
        out = [r for r in rows if r[2] == 0]
        rows = [r for r in rows if r[2] == 1]
        if rows:
            h = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint32)
            who = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint16)
            which = np.repeat(np.arange(len(rows)), [len(r[4]) // 2 for r in rows])
            order = np.argsort(h, kind="stable")
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[order][1:] != h[order][:-1]
            run_of = np.cumsum(new) - 1
            weight = np.bincount(run_of, weights=1 + (who[order] == _ALL))
            hit = order[weight[run_of] > 1]
            hit = hit[who[hit] != _ALL]
            got, times = np.unique((which[hit] << 16) | who[hit], return_counts=True)
            cut = np.searchsorted(got >> 16, np.arange(len(rows) + 1))
            for i, r in enumerate(rows):
                a, b = cut[i], cut[i + 1]
                if b > a:
                    out.append((0, r[1], 1, (got[a:b] & 0xFFFF).astype(np.uint16).tobytes(), times[a:b].astype(np.int32).tobytes()))
        if out:
            yield _rows(out)
    trim()


_TOLD = "doc_id long, text_hash long, node long, check long, n int, candidate boolean"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level 1, by batch: a row for each document; ``candidate`` if it may link."""
    for _, rows in _grouped(batches, 1):
        docs = np.frombuffer(next(r[3] for r in rows if r[2] == 0), dtype=_DOC)
        got = np.zeros(len(docs), dtype=np.int64)
        for r in rows:
            if r[2] == 1:
                got[np.frombuffer(r[3], dtype=np.uint16)] += np.frombuffer(r[4], dtype=np.int32)
        candidate = (docs["n"] > 0) & (got >= docs["need"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs["doc"], mask=docs["known"] == 0), pa.array(docs["text"]), pa.array(docs["node"]), pa.array(docs["check"]), pa.array(docs["n"]), pa.array(candidate)],
            ["doc_id", "text_hash", "node", "check", "n", "candidate"],
        )


def _deal_sets(buckets: int):
    """Level 2, map side: whole sets, and a batch's distinct shingles with their counts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for big in batches:
            for batch in chunks(big, 1):
                nodes = batch.column(0).to_numpy(zero_copy_only=False)
                s, n = shingle_sets(*text_bytes(batch.column(1)))
                u, times = np.unique(s, return_counts=True)
                bucket = ((u >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                low, times = u[order].astype(np.uint32), times[order].astype(np.int32)
                first, last = _by_bucket(bucket[order], buckets)
                out = [(int(number % buckets), number, 0, nodes.astype("<i8").tobytes() + n.astype("<i8").tobytes(), s.tobytes())]
                out += [(k, number, 1, low[a:b].tobytes(), times[a:b].tobytes()) for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)) if b > a]
                number += 1
                yield _rows(out)
        trim()

    return run


def _frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level 2, by bucket: in how many sets each shingle is (255: as many or more), in the order it was sent."""
    for _, rows in _grouped(batches, 1):
        out = [r for r in rows if r[2] == 0]
        rows = [r for r in rows if r[2] == 1]
        if rows:
            h = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint32)
            times = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.int32)
            order = np.argsort(h, kind="stable")
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[order][1:] != h[order][:-1]
            run_of = np.cumsum(new) - 1
            df = np.empty(len(h), dtype=np.uint8)
            df[order] = np.minimum(np.bincount(run_of, weights=times[order]), 255)[run_of]
            at = 0
            for r in rows:
                k = len(r[3]) // 4
                out.append((r[0], r[1], 1, df[at : at + k].tobytes(), None))
                at += k
        if out:
            yield _rows(out)
    trim()


_SETS = "node long, n int, shingles binary, prefix binary"


def _prefixes(buckets: int):
    """Level 2, by batch: sets with their shared shingles, and the prefix of these in which linked sets meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 1):
            head = next(r for r in rows if r[2] == 0)
            nodes, n = np.frombuffer(head[3], dtype="<i8").reshape(2, -1)
            s = np.frombuffer(head[4], dtype=np.uint64)
            u = np.unique(s)
            bucket = ((u >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            df = np.empty(len(u), dtype=np.uint8)
            df[order] = np.frombuffer(b"".join(r[3] for r in rows if r[2] == 1), dtype=np.uint8)
            f = df[np.searchsorted(u, s)]
            out, at = [], 0
            for node, k in zip(nodes.tolist(), n.tolist(), strict=True):
                keep = f[at : at + k] > 1
                own, rare = s[at : at + k][keep], f[at : at + k][keep]
                at += k
                spare = len(own) - least_overlap(k) + 1
                if spare > 0:
                    first = np.lexsort((own, rare))[:spare]
                    out.append((node, k, own.tobytes(), own[first].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["node", "n", "shingles", "prefix"])

    return run


def _stars(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token its least node; and the links of the others with it."""
    order = np.lexsort((nodes, tokens))
    t, v = tokens[order], nodes[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = t[1:] != t[:-1]
    hub = v[np.flatnonzero(new)][np.cumsum(new) - 1] if len(t) else v
    a, b = v[v != hub], hub[v != hub]
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    once = np.ones(len(a), dtype=bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.flatnonzero(new), order, np.stack([a[once], b[once]], axis=1)


def _meet_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level 2: prefix tokens with one node each, and links (token null) inside the batch."""
    for batch in (big.slice(at, 2 * SLICE) for big in batches for at in range(0, big.num_rows, 2 * SLICE)):
        blobs = batch.column(1).to_pylist()
        tokens = np.frombuffer(b"".join(blobs), dtype=np.int64)
        nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(b) // 8 for b in blobs])
        first, order, links = _stars(tokens, nodes)
        t, v = tokens[order][first], nodes[order][first]
        none = np.ones(len(links), dtype=bool)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([t, np.zeros(len(links), dtype=np.int64)]), mask=np.concatenate([np.zeros(len(t), dtype=bool), none])), pa.array(np.concatenate([v, links[:, 0]])), pa.array(np.concatenate([v, links[:, 1]]))],
            ["token", "a", "b"],
        )


class CountTree:
    """An R-tree over group counts: leaves of ``FAN`` points, nodes of ``FAN`` leaves, each with coordinate maxima and the least size."""

    FAN = 16

    def __init__(self, points: np.ndarray, n: np.ndarray):
        self.points, self.n = points, n
        self.leaf = np.arange(0, len(n), self.FAN)
        self.top = np.arange(0, len(self.leaf), self.FAN)
        self.leaf_max, self.leaf_n = np.maximum.reduceat(points, self.leaf), np.minimum.reduceat(n, self.leaf)
        self.top_max, self.top_n = np.maximum.reduceat(self.leaf_max, self.top), np.minimum.reduceat(self.leaf_n, self.top)

    def _reach(self, point: np.ndarray, size: int, boxes: np.ndarray, least: np.ndarray) -> np.ndarray:
        bound = np.minimum(boxes, point).sum(1, dtype=np.int64)
        return linked(bound, size, np.maximum(least, bound))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points whose overlap with ``point`` may be enough."""
        tops = np.flatnonzero(self._reach(point, size, self.top_max, self.top_n))
        leaves = (tops[:, None] * self.FAN + np.arange(self.FAN)).ravel()
        leaves = leaves[leaves < len(self.leaf)]
        leaves = leaves[self._reach(point, size, self.leaf_max[leaves], self.leaf_n[leaves])]
        at = (leaves[:, None] * self.FAN + np.arange(self.FAN)).ravel()
        at = at[at < len(self.n)]
        return at[self._reach(point, size, self.points[at], self.n[at])]


def spanning_links(sets: list[np.ndarray], n: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all links connect; ``sets`` are sorted, ``n`` their whole sizes."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    begin = np.cumsum(sizes) - sizes

    def overlaps(i: int, at: np.ndarray | None = None) -> np.ndarray:
        own = sets[i]
        if at is None:
            spot = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            return np.bincount(owner[own[spot] == flat], minlength=m)
        part = np.concatenate([sets[j] for j in at])
        spot = np.minimum(np.searchsorted(own, part), len(own) - 1)
        who = np.repeat(np.arange(len(at)), sizes[at])
        return np.bincount(who[own[spot] == part], minlength=len(at))

    forest, links = Forest(), []
    middle = int(np.argsort(n, kind="stable")[m // 2])
    near = overlaps(middle)
    for j in np.flatnonzero(linked(near, n[middle], n)).tolist():
        if forest.join(middle, j):
            links.append((middle, j))
    root = np.array([forest.find(i) for i in range(m)])
    values, counts = np.unique(root, return_counts=True)
    if len(values) == 1:
        return links
    groups = 1 << int(np.clip(np.ceil(np.log2(np.median(sizes) / 3 + 1)), 4, 9))
    order = np.lexsort((n, near))
    points = np.zeros((m, groups), dtype=np.int32)
    place = np.empty(m, dtype=np.int64)
    place[order] = np.arange(m)
    np.add.at(points, (place[owner], (flat % np.uint64(groups)).astype(np.int64)), 1)
    tree = CountTree(points, n[order])
    largest = values[np.argmax(counts)]
    # A link between two clusters has at least one end outside of the largest.
    for i in np.flatnonzero(root != largest).tolist():
        at = order[tree.search(points[place[i]], int(n[i]))]
        mine = forest.find(i)
        at = np.array([j for j in at.tolist() if forest.find(j) != mine], dtype=np.int64)
        if not len(at):
            continue
        for j in at[linked(overlaps(i, at), n[i], n[at])].tolist():
            if forest.join(i, j):
                links.append((i, j))
    return links


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _grouped(batches, 3):
        rows = list({r[3]: r for r in rows}.values())
        nodes = [r[3] for r in rows]
        links = spanning_links([np.frombuffer(r[5], dtype=np.uint64) for r in rows], np.array([r[4] for r in rows], dtype=np.int64))
        if links:
            forest = Forest()
            for i, j in links:
                forest.join(nodes[i], nodes[j])
            yield stars(forest, nodes)
    trim()


def candidate_links(sets: DataFrame) -> DataFrame:
    """(a, b): nodes that meet in a prefix token, as stars."""
    met = sets.select("node", "prefix").mapInArrow(_meet_map, "token long, a long, b long")
    hubs = met.where("token is not null").groupBy("token").agg(F.min("a").alias("hub"), F.max("a").alias("most")).where("hub <> most").select("token", "hub")
    across = met.where("token is not null").join(hubs, "token").where("a <> hub").select("a", F.col("hub").alias("b"))
    return across.unionByName(met.where("token is null").select("a", "b")).distinct()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): a row for each row of ``docs``."""
    spark = docs.sparkSession
    buckets = _buckets(spark)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    dealt = own.mapInArrow(_deal(buckets), _PACKED).repartition("bucket").sortWithinPartitions("bucket", "batch", "kind")
    partial = dealt.mapInArrow(_shared, _PACKED).repartition("batch").select("batch", "bucket", "kind", "a", "b").sortWithinPartitions("batch", "kind")
    told = checkpointed(partial.mapInArrow(_judge, _TOLD), share=4)

    # Classes are told apart by both hashes; their numbers, which the steps below use, cannot meet.
    keys = ["node", "check", "n"]
    classes = told.where("candidate").groupBy(*keys).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("r"))
    classes = classes.select(*[F.col(k).alias("set_" + k) for k in keys], F.col("r.doc_id").alias("first"), F.col("r.text_hash").alias("text_hash"))
    classes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))
    chosen = own.join(classes, own.doc_id.eqNullSafe(classes["first"]) & (own.text_hash == classes.text_hash)).select("node", "text")
    packed = chosen.mapInArrow(_deal_sets(buckets), _PACKED).repartition("bucket").sortWithinPartitions("bucket", "batch", "kind")
    counted = packed.mapInArrow(_frequency, _PACKED).repartition("batch").select("batch", "bucket", "kind", "a", "b").sortWithinPartitions("batch", "bucket")
    sets = stage(counted.mapInArrow(_prefixes(buckets), _SETS), "shingle-sets")

    near = components(candidate_links(sets))
    near = sets.select("node", "n", "shingles").join(near, "node")
    big = near.groupBy("root").agg(F.count("*").alias("sets"), F.sum(F.octet_length("shingles") / 8).alias("total"))
    # Kept apart from the join below, so that adaptive execution can split the sets of a hot component there.
    big = checkpointed(big.select("root", F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    cut = near.join(big, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "shingles")
    cut = cut.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    # Links come as stars already, and a second Python operator in the stage would double its workers.
    found = components(cut.mapInArrow(_verify, "a long, b long"), contract=False)

    firsts = classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = firsts.join(least, "root").select(*[F.col("set_" + k).alias(k) for k in keys], "component_id")
    may, alone = told.where("candidate"), told.where("not candidate")
    return (
        may.join(labels, keys)
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
        .unionByName(alone.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)])) end as s
  from w
), k as (select sha256(array_to_string(s, chr(10))) as k, min(doc_id) as c, any_value(s) as s, len(any_value(s)) as n from s where len(s) > 0 group by 1),
u as (select c, n, unnest(s) as x from k),
l as (
  select a.c as a, b.c as b from u a join u b on a.x = b.x and a.c <> b.c
  group by a.c, b.c, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r(a, b) as (select c, c from k union select r.a, l.b from r join l on l.a = r.b),
m as (select a as c, min(b) as component_id from r group by a)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(m.component_id, s.doc_id) as component_id
from s left join k on len(s.s) > 0 and k.k = sha256(array_to_string(s.s, chr(10))) left join m on m.c = k.c
"""
