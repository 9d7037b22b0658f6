"""Benchmark decontamination: windows of documents within a word edit distance of an item.

A text is a sequence of words (runs of letters, digits and non-ASCII characters, A-Z as a-z). A document
is contaminated by an item of L words if some window of it is within ``floor(MAX_EDITS * L)`` word edits.

1. Where a window may be. An edit breaks at most two of an item's word pairs, so of any ``2k + 1`` of them one stands in every
   window within ``k`` edits, and by the q-gram lemma such a window, of at most ``L + k`` words, holds at least ``L - 1 - 2k`` places whose
   pair is one of the item's. The item's rarest pairs are its anchors; what holds no anchor is left after one look into a
   table. This leaves stretches of text and loses no window.
2. CGK embedding and bit sampling. In each of ``ROUNDS`` rounds a random walk reads the item and every item-sized window of a stretch:
   step j writes the word under the pointer, which moves on if a random bit of (round, j, word) says so. Words in which two sequences
   agree keep their walks together, so edit distance becomes Hamming distance. A round samples one of the first ``2 L`` steps, over the
   whole item; a stretch is a candidate when a window and the item have the same word there. Windows that begin before the stretch or
   end after it are filled with blanks, which agree with nothing.
3. Each candidate is verified: the exact edit distance of the item to the best window in the stretch.

Step 2 is the one that samples. At 20 percent edits a window agrees with its item in a share of more than ``AGREE`` of the steps, so that
``ROUNDS`` rounds miss it with odds of less than ``1 - RECALL``; neighbouring windows add to that.

Items are broadcast in blocks of at most ``BLOCK_BYTES`` of text, each of which is one more pass. Short items
follow the same rule: up to 4 words allow no edit, 5 to 9 one. An item of one word has no pair and is looked up as a word. In a script without blanks
a run of letters is one word, so an item of one run is found only where the same run stands.

Defined cases: null and empty texts hold nothing; null items are ignored; null doc_ids and
item_ids are carried; equal documents get equal rows, one for each input row; no items, no rows; a very long item is handled like
any other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trim
from .shingles import PUNCTUATION, chunks, mix, text_bytes, word_hashes

MAX_EDITS = 0.2
BLOCK_BYTES = 8 << 20
#: Recall aimed at, the share of steps in which a window at the limit agrees with its item, and the rounds that follow from them.
RECALL, AGREE = 0.999, 0.2
ROUNDS = int(np.ceil(np.log(1 - RECALL) / np.log(1 - AGREE)))
#: Words of a window and of an item that are under no pointer: they agree with nothing.
_OUT = np.uint64(0)
#: Places and items looked at together.
_AT_ONCE = 1 << 20
_SLOTS = 1 << 22


def allowed(words: int) -> int:
    return int(MAX_EDITS * words)


def window_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least word edits from ``item`` to any window of ``text``, and where that window ends."""
    n = len(text)
    slope = np.arange(n + 1)
    row = np.zeros(n + 1, dtype=np.int64)
    for i, w in enumerate(item.tolist(), 1):
        up = np.empty(n + 1, dtype=np.int64)
        up[0] = i
        up[1:] = np.minimum(row[:-1] + (text != np.uint64(w)), row[1:] + 1)
        row = np.minimum.accumulate(up - slope) + slope
    end = int(np.argmin(row))
    return int(row[end]), end


class Index:
    """What a task needs of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        h, count, _, _ = word_hashes(data, offsets, PUNCTUATION)
        first = np.cumsum(count) - count
        use = np.flatnonzero(count)
        self.ids = [items[i][0] for i in use]
        self.words = [h[first[i] : first[i] + count[i]] for i in use]
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.edits = np.array([allowed(n) for n in self.size.tolist()], dtype=np.int64)
        self.need = self.size - 1 - 2 * self.edits
        self._samples: dict[int, dict[int, int]] = {}
        self.single = Postings([w if len(w) == 1 else w[:0] for w in self.words])
        pairs = [pair_keys(w) for w in self.words]
        self.pairs = Postings([np.unique(p) for p in pairs])
        # Positions count, not distinct pairs: 2k + 1 positions of the rarest pairs.
        rare = [p[np.argsort(self.pairs.frequency(p), kind="stable")[: 2 * k + 1]] for p, k in zip(pairs, self.edits.tolist(), strict=True)]
        self.anchors = Postings([np.unique(p) for p in rare])

    def search(self, h: np.ndarray, count: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(document, item) -> (edits, first word after the window) for documents whose words lie end to end in ``h``."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        if not len(h) or not self.words:
            return best
        ends = np.cumsum(count)
        owner = np.repeat(np.arange(len(count)), count)
        for pos, x in self.single.expand(*self.single.look_up(h, np.arange(len(h)))):
            case, first = np.unique(owner[pos] * len(self.words) + x, return_index=True)
            for c, p in zip(case.tolist(), pos[first].tolist(), strict=True):
                d, y = divmod(c, len(self.words))
                best.setdefault((d, y), (0, p + 1 - int(ends[d] - count[d])))
        keys = pair_keys(h)
        inside = owner[:-1] == owner[1:]  # no pair reaches into the next document
        at, term = self.pairs.look_up(keys, np.flatnonzero(inside))
        seen = np.zeros(len(h) + 1, dtype=np.int64)
        seen[at + 1] = 1
        seen = np.cumsum(seen)  # pairs of any item that start before each word
        n = len(self.words)
        likely = []
        for pos, x in self.anchors.expand(*self.anchors.look_up(keys, at)):
            doc, reach = owner[pos], self.size[x] + self.edits[x] - 2
            a, b = np.maximum(pos - reach, ends[doc] - count[doc]), np.minimum(pos + reach + 1, ends[doc])
            likely.append(np.unique((doc * n + x)[seen[b] - seen[a] >= self.need[x]]))
        likely = np.unique(np.concatenate(likely)) if likely else np.zeros(0, dtype=np.int64)
        if not len(likely):
            return best
        docs = np.zeros(len(count), dtype=bool)
        docs[likely // n] = True
        use = docs[owner[at]]
        places, cases = [], []
        for pos, x in self.pairs.expand(at[use], term[use]):
            case = owner[pos] * n + x
            i = np.minimum(np.searchsorted(likely, case), len(likely) - 1)
            ok = likely[i] == case
            places.append(pos[ok])
            cases.append(case[ok])
        pos, case = np.concatenate(places), np.concatenate(cases)
        order = np.lexsort((pos, case))
        pos, case = pos[order], case[order]
        x = case % n
        last = np.arange(len(pos)) + self.need[x] - 1
        i = np.flatnonzero(last < len(pos))
        last = last[i]
        longest = self.size[x[i]] + self.edits[x[i]]
        ok = (case[last] == case[i]) & (pos[last] - pos[i] <= longest - 2)
        i, last, longest = i[ok], last[ok], longest[ok]
        if not len(i):
            return best
        doc = case[i] // n
        a, b = np.maximum(pos[last] + 2 - longest, ends[doc] - count[doc]), np.minimum(pos[i] + longest, ends[doc])
        # Stretches of a case that meet become one.
        new = np.ones(len(i), dtype=bool)
        new[1:] = (case[i][1:] != case[i][:-1]) | (a[1:] > b[:-1])
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(i)) - 1
        found, low, high = case[i][starts], a[starts], b[stops]
        meets = self.meets(h, found % n, low, high)
        for c, s, e in zip(found[meets].tolist(), low[meets].tolist(), high[meets].tolist(), strict=True):
            d, y = divmod(c, n)
            edits, end = window_distance(self.words[y], h[s:e])
            if edits <= self.edits[y] and edits < best.get((d, y), (edits + 1, 0))[0]:
                best[d, y] = edits, s + end - int(ends[d] - count[d])
        return best


    def meets(self, h: np.ndarray, items: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which stretches [low, high) of ``h`` have a window that agrees with the item in a sampled step of some round."""
        out = np.zeros(len(items), dtype=bool)
        size, edits = self.size[items], self.edits[items]
        starts = high - low + edits  # windows begin up to k words before the stretch
        for first in _pieces(starts):
            todo = np.arange(first.start, first.stop)
            for r in range(ROUNDS):
                if not len(todo):
                    break
                count = starts[todo]
                which = np.repeat(todo, count)
                offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) - edits[which]
                mine = self._sampled(r, items[todo])
                seen = walk(h, low[which], high[which], low[which] + offset, size[which], self.steps(r)[items[which]], r)
                hit = (seen == np.repeat(mine, count)) & (seen != _OUT)
                agreed = np.unique(which[hit])
                out[agreed] = True
                todo = todo[~out[todo]]
        return out

    def steps(self, r: int) -> np.ndarray:
        """The step that round ``r`` samples of each item."""
        return (mix(np.arange(len(self.size), dtype=np.uint64) * np.uint64(ROUNDS) + np.uint64(r + 1)) % np.maximum(2 * self.size, 1).astype(np.uint64)).astype(np.int64)

    def _sampled(self, r: int, items: np.ndarray) -> np.ndarray:
        """Round ``r``'s word of each item, computed once."""
        own = self._samples.setdefault(r, {})
        new = [y for y in np.unique(items).tolist() if y not in own]
        if new:
            flat = np.concatenate([self.words[y] for y in new])
            size = self.size[new]
            end = np.cumsum(size)
            got = walk(flat, end - size, end, end - size, size, self.steps(r)[new], r)
            own.update(zip(new, got.tolist(), strict=True))
        return np.array([own[y] for y in items.tolist()], dtype=np.uint64)


def _pieces(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of stretches with about ``_AT_ONCE`` windows."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _AT_ONCE, side="right")))
        yield slice(at, end)
        at = end


def walk(h: np.ndarray, low: np.ndarray, high: np.ndarray, begin: np.ndarray, size: np.ndarray, step: np.ndarray, r: int) -> np.ndarray:
    """The word that a CGK walk of round ``r`` writes at ``step``, for windows of ``size`` words that begin at ``begin`` in ``h``.

    Outside [low, high) and past the window's end there is ``_OUT``.
    """
    out = np.zeros(len(begin), dtype=np.uint64)
    order = np.argsort(step, kind="stable")
    at, stop = begin[order].copy(), (begin + size)[order]
    low, high, step = low[order], high[order], step[order]
    done = j = 0
    while done < len(order):
        inside = (at[done:] >= low[done:]) & (at[done:] < high[done:]) & (at[done:] < stop[done:])
        word = np.where(inside, h[np.clip(at[done:], 0, len(h) - 1)], _OUT)
        last = int(np.searchsorted(step[done:], j, side="right"))
        out[order[done : done + last]] = word[:last]
        key = mix(np.array([(r << 32) | (j + 1)], dtype=np.uint64))
        at[done:] += (mix(word + key) & np.uint64(1)).astype(np.int64)
        done += last
        j += 1
    return out


class Postings:
    """The items that have each pair, or each word."""

    def __init__(self, pairs: list[np.ndarray]):
        flat = np.concatenate([*pairs, np.zeros(0, dtype=np.uint64)])
        items = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        order = np.argsort(flat, kind="stable")
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.items = items[order]
        self.slots = np.zeros(_SLOTS, dtype=bool)
        self.slots[pair_slots(self.keys)] = True

    def frequency(self, pairs: np.ndarray) -> np.ndarray:
        return self.count[np.searchsorted(self.keys, pairs)]

    def look_up(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places ``at`` whose pair some item has, and the pair's number."""
        if not len(self.keys):
            return at[:0], at[:0]
        at = at[self.slots[pair_slots(keys[at])]]
        term = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        ok = self.keys[term] == keys[at]
        return at[ok], term[ok]

    def expand(self, at: np.ndarray, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, item) for each item of each place, in pieces of bounded size."""
        total = np.cumsum(self.count[term])
        start = done = 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(total, done + _AT_ONCE, side="right")))
            size = self.count[term[start:stop]]
            begin = np.cumsum(size) - size
            where = np.arange(int(size.sum())) + np.repeat(self.first[term[start:stop]] - begin, size)
            yield np.repeat(at[start:stop], size), self.items[where]
            start, done = stop, int(total[stop - 1])


def pair_keys(h: np.ndarray) -> np.ndarray:
    return (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)


def pair_slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(42)).astype(np.int64)


_FOUND = "doc_id long, item_id long, edits int, item_words int, end_word long"


def _finder(items: list[tuple[int | None, str]]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for big in batches:
            for batch in chunks(big, 1):
                h, count, _, _ = word_hashes(*text_bytes(batch.column(1)), PUNCTUATION)
                found = sorted(index.search(h, count).items())
                if found:
                    ids = batch.column(0).to_pylist()
                    rows = [(ids[d], index.ids[x], e, len(index.words[x]), end) for (d, x), (e, end) in found]
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "item_id", "edits", "item_words", "end_word"])
        trim()

    return find


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items, collected in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text <> ''")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    for i in range(blocks):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()]


def _keeper(items: list[tuple[int | None, str]], column: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for big in batches:
            for batch in chunks(big, column):
                h, count, _, _ = word_hashes(*text_bytes(batch.column(column)), PUNCTUATION)
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[d for d, _ in index.search(h, count)]] = False
                yield batch.filter(pa.array(clean))
        trim()

    return keep


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, in one pass and without a shuffle."""
    for block in _blocks(benchmark):
        docs = docs.mapInArrow(_keeper(block, docs.columns.index(text)), docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, item_words, end_word): a row for each document and item found in it."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in _blocks(benchmark):
        part = own.mapInArrow(_finder(block), _FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
