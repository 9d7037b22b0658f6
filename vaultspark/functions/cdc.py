"""Content-defined chunking in numpy.

A gear hash of the last 64 bytes is computed for all positions at once by
doubling (``h[i] += h[i - n] << n``), so a cut depends on local content only.
From ``least`` on, a strict mask must be zero up to ``target`` and a loose one
after it; at ``most`` a chunk is cut anyway. A text of up to ``least`` bytes is
one chunk, an empty one none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The default sizes.
LEAST, TARGET, MOST = 16 << 10, 64 << 10, 256 << 10
_GEAR = np.random.default_rng(1969).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64)


def gear_hash(data: np.ndarray) -> np.ndarray:
    h = _GEAR[data]
    n = 1
    while n < 64 and n < len(h):
        nxt = h.copy()
        nxt[n:] += h[:-n] << np.uint64(n)
        h, n = nxt, 2 * n
    return h


def cut_points(data: bytes, least: int = LEAST, target: int = TARGET, most: int = MOST) -> list[int]:
    """Ends of the chunks of ``data``."""
    if not 0 < least <= target <= most:
        raise ValueError("sizes must be 0 < least <= target <= most")
    n = len(data)
    if n <= least:
        return [n] if n else []
    strict, loose = _cuts(np.frombuffer(data, dtype=np.uint8), target)
    out, at = [], 0
    while n - at > least:
        at = _next_cut(strict, loose, at, n, least, target, most)
        out.append(at)
    if at < n:
        out.append(n)
    return out


class StreamChunker:
    """The same cuts from blocks of a stream, in bounded memory."""

    def __init__(self, least: int = LEAST, target: int = TARGET, most: int = MOST):
        self.sizes, self.held, self.tail = (least, target, most), b"", b""

    def feed(self, block: bytes) -> Iterator[bytes]:
        self.held += block
        if len(self.held) > 4 * self.sizes[2]:
            yield from self._take(False)

    def finish(self) -> Iterator[bytes]:
        yield from self._take(True)

    def _take(self, end: bool) -> Iterator[bytes]:
        """Chunks whose cuts do not depend on what is to come; at the end all. What is held is hashed once."""
        least, target, most = self.sizes
        held, n, at = self.held, len(self.held), 0
        # A window of 64 bytes before the chunk belongs to the hash, as the hash is not reset at cuts.
        strict, loose = _cuts(np.frombuffer(self.tail + held, dtype=np.uint8), target)
        strict, loose = strict - len(self.tail), loose - len(self.tail)
        while n - at > (0 if end else 2 * most):
            cut = n
            if n - at > least:
                cut = _next_cut(strict, loose, at, n, least, target, most)
            yield held[at:cut]
            at = cut
        self.tail, self.held = (self.tail + held[:at])[-64:], held[at:]


def _cuts(data: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks by the strict and by the loose mask."""
    bits = max(1, (target - 1).bit_length())
    h = gear_hash(data) >> np.uint64(64 - bits - 2)
    return np.flatnonzero(h == 0) + 1, np.flatnonzero(h >> np.uint64(3) == 0) + 1


def _next_cut(strict: np.ndarray, loose: np.ndarray, at: int, n: int, least: int, target: int, most: int) -> int:
    i = np.searchsorted(strict, at + least)
    if i < len(strict) and strict[i] <= min(at + target, n):
        return int(strict[i])
    j = np.searchsorted(loose, max(at + target, at + least))
    return min(int(loose[j]) if j < len(loose) else n, at + most, n)


def _chunk_batches(least: int, target: int, most: int, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, ordinal, start, data = [], [], [], []
            for i, content in enumerate(batch.column(keys)):
                raw, at = content.as_py() or b"", 0
                for k, end in enumerate(cut_points(raw, least, target, most)):
                    source.append(i)
                    ordinal.append(k)
                    start.append(at)
                    data.append(raw[at:end])
                    at = end
            rows = pa.array(source, pa.int64())
            cols = [batch.column(j).take(rows) for j in range(keys)]
            cols += [pa.array(ordinal, pa.int32()), pa.array(start, pa.int64()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:keys], "ordinal", "start_offset", "data"])

    return run


def chunk(df: DataFrame, keys: list[str], content: str = "content", least: int = LEAST, target: int = TARGET, most: int = MOST) -> DataFrame:
    """``keys`` with ordinal, start_offset, data and chunk_id, a row for each chunk; chunk_id is the SHA-256 of the data in hex."""
    slim = df.select(*keys, F.col(content).cast("binary").alias("__content"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    out = slim.mapInArrow(_chunk_batches(least, target, most, len(keys)), f"{kinds}, ordinal int, start_offset long, data binary")
    return out.withColumns({"chunk_id": F.sha2("data", 256), "raw_len": F.octet_length("data").cast("int")})


def assemble(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with content: chunks put together in order."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "data")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["data"]))
    return chunks.groupBy(*keys).agg(joined.alias("content"))
