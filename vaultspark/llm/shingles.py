"""Words and word shingles of whole texts as 64-bit hashes, in numpy over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(2718)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[_BLANK] = 0
_ODD = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 2**62, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that end words where punctuation is not part of them.
PUNCTUATION = _BLANK.copy()
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _ODD
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: none) end to end, and the texts' offsets in them."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: int, size: int = CHUNK, rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``size`` bytes of text each."""
    _, offsets = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="left"))
        end = min(max(end, at + 1), at + rows, n)
        yield batch.slice(at, end - at)
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, how many words each text has, and where the words start and end.

    ``breaks`` has the bytes that end words; A-Z counts as a-z.
    """
    n, texts = len(data), len(offsets) - 1
    none = np.zeros(0, dtype=np.int64)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(texts, dtype=np.int64), none, none
    blank = breaks[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins, ends = ~blank, ~blank
    begins[1:] &= blank[:-1] | edge[1:n]
    ends[:-1] &= blank[1:] | edge[1:n]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.zeros(0, dtype=np.uint64), np.zeros(texts, dtype=np.int64), none, none
    most = int((stop - start).max())
    # A multiplier of its own for each place: powers of one base would give words of the Thue-Morse kind one hash.
    power = mix(np.arange(1, most + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    gap = np.diff(np.append(start, n))
    at = np.minimum(np.arange(start[0], n) - np.repeat(start, gap), most - 1)
    values = _BYTE if breaks is _BLANK else np.where(breaks, np.uint64(0), _BYTE)
    h = np.add.reduceat(values[data[start[0] :]] * power[at], start - start[0])
    count = np.diff(np.searchsorted(start, offsets))
    return mix(h + (stop - start).astype(np.uint64)), count, start, stop


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and how many each has.

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    """
    h, count, _, _ = word_hashes(data, offsets)
    first = np.cumsum(count) - count
    total = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    begin = np.cumsum(total) - total
    at = np.repeat(first - begin, total) + np.arange(int(total.sum()))
    padded = np.append(h, np.zeros(words, dtype=np.uint64))
    s = np.zeros(len(at), dtype=np.uint64)
    for j in range(words):
        s += padded[at + j] * _PLACE[j]
    for i in np.flatnonzero((count < words) & (count > 0)).tolist():
        own = h[first[i] : first[i] + count[i]]
        s[begin[i]] = (own * _PLACE[: len(own)]).sum() ^ _PLACE[words + len(own)]
    s = mix(s)
    for a, n in zip(begin.tolist(), total.tolist(), strict=True):
        s[a : a + n].sort()
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = s[1:] != s[:-1]
    keep[begin[total > 0]] = True
    owner = np.repeat(np.arange(len(total)), total)
    return s[keep], np.bincount(owner[keep], minlength=len(total)).astype(np.int64)
