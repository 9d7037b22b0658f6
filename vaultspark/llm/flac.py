"""A FLAC codec for byte payloads as 8-bit mono, in numpy over many frames at once.

Encoder: each payload is one stream of frames of ``BLOCK`` samples (the bytes minus
128). A frame holds one subframe: CONSTANT, VERBATIM, or FIXED (the linear predictors of
orders 0 to 4) with one Rice partition, whichever is shortest. STREAMINFO has the
MD5 of the samples; a SEEKTABLE has a point for each frame: sample number and byte offset.

Decoder: reads the seek table, checks each frame's CRC-8 (header) and CRC-16
(whole frame) and decodes all frames of a batch side by side: step i takes the i-th Rice code of
every frame. The stream's MD5 is checked last. Streams that others wrote - LPC subframes,
several partitions, escape codes, wasted bits - go through a plain decoder, :func:`decode_any`.

Defined cases: a null text is empty; an empty text is 64 bytes 0; texts are
whole, however long (a stream of up to 2^31 bytes); null doc_ids, repeated rows and extra
columns change nothing; a bad checksum raises.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

BLOCK = 1024
PAD = 64
RATE = 8000
#: Rice parameters the encoder uses; no code has 32 zeros or more.
_K = range(3, 9)
#: Orders 0 to 4 of the fixed predictors.
_ORDERS = 5
#: A batch is decoded in pieces of about so many samples.
PIECE = 2 << 20


def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out & top, (out << 1) ^ poly, out << 1) & mask
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
def _two_steps(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x << 8) & 0xFFFF ^ _CRC16[x >> 8]
    return x


#: What two more bytes make of a CRC-16 into which they are already mixed.
_CRC16_PAIR = _two_steps(np.arange(65536, dtype=np.int64)).astype(np.uint16)


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of the pieces of ``data``, all at once; ``data`` has a byte to spare."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    crc = np.zeros(len(size), dtype=np.uint16)
    pairs = size // 2
    live = np.searchsorted(-pairs, -np.arange(int(pairs.max(initial=0))), side="left")
    for i, n in enumerate(live.tolist()):
        at = start[:n] + 2 * i
        crc[:n] = _CRC16_PAIR[crc[:n] ^ ((data[at].astype(np.uint16) << np.uint16(8)) | data[at + 1])]
    odd = np.flatnonzero(size & 1)
    if len(odd):
        c = crc[odd].astype(np.int64)
        crc[odd] = ((c << 8) & 0xFFFF) ^ _CRC16[(c >> 8) ^ data[start[odd] + size[odd] - 1]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def _utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    out = [0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 1)]
    lead = (0xFF << (8 - size)) & 0xFF
    return bytes([lead | n >> (6 * (size - 1)), *reversed(out)])


_HEADS: dict[tuple[int, int], bytes] = {}


def _frame_header(number: int, samples: int) -> bytes:
    """Fixed block size, rate from STREAMINFO, one channel, 8 bits; the size in 16 bits."""
    key = (number, samples)
    if key not in _HEADS:
        if len(_HEADS) > 20_000:
            _HEADS.clear()
        head = bytes([0xFF, 0xF8, 0x70, 0x02]) + _utf8_number(number) + (samples - 1).to_bytes(2, "big")
        _HEADS[key] = head + bytes([crc8(head)])
    return _HEADS[key]


def _fixed_frames(samples: np.ndarray, first: np.ndarray, size: np.ndarray):
    """For each frame the best (order, Rice parameter, bits); order -1 is verbatim, -2 constant."""
    n, best = len(first), np.full(len(first), np.iinfo(np.int64).max)
    order, param = np.full(n, -1), np.zeros(n, dtype=np.int64)
    at = np.arange(len(samples)) - np.repeat(first, size)
    codes = {}
    x = samples.astype(np.int32)
    for o in range(_ORDERS):
        if o:
            d = x.copy()
            d[1:] -= x[:-1]
            x = np.where(at >= o, d, 0)
        z = np.where(x >= 0, 2 * x, -2 * x - 1) * (at >= o)
        codes[o] = z
        left, most = np.maximum(size - o, 0), np.maximum.reduceat(z, first)
        # The parameter near the mean's logarithm is the best or costs next to nothing more.
        k = np.log2(np.maximum(np.add.reduceat(z, first) / np.maximum(left, 1), 1)).astype(np.int64)
        k = np.maximum(np.clip(k, _K[0], _K[-1]), np.ceil(np.log2(most + 1)).astype(np.int64) - 5)
        bits = np.add.reduceat(z >> np.repeat(k, size).astype(np.int32), first) + left * (k + 1) + 8 * o + 10
        ok = (bits < best) & (size > o)
        best[ok], order[ok], param[ok] = bits[ok], o, k[ok]
    worse = best >= 8 * size
    order[worse] = -1
    spread = np.maximum.reduceat(samples, first) == np.minimum.reduceat(samples, first)
    order[spread] = -2
    return order, param, codes


def encode(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream for each payload; payloads are not empty."""
    if not payloads:
        return []
    raw = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    samples = raw.astype(np.int16) - 128
    lengths = np.array([len(p) for p in payloads])
    per = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    size = np.minimum(BLOCK, lengths[owner] - number * BLOCK)
    first = np.cumsum(size) - size
    order, param, codes = _fixed_frames(samples, first, size)
    heads = [_frame_header(a, b) for a, b in zip(number.tolist(), size.tolist(), strict=True)]

    # Bits of every sample: (value, width) written at its bit offset.
    frame = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(raw)) - first[frame]
    o, k = order[frame], param[frame]
    fixed = o >= 0
    z = np.choose(np.clip(o, 0, _ORDERS - 1), [codes[i] for i in range(_ORDERS)]).astype(np.int64)
    rice = fixed & (at >= o)
    width = np.where(rice, (z >> k) + 1 + k, 8)
    width[(o == -2) & (at > 0)] = 0
    value = np.where(rice, (np.int64(1) << k) | (z & ((np.int64(1) << k) - 1)), raw.astype(np.int64) ^ 0x80)
    warm = np.where(order >= 0, order, 0)
    # The coding method and the one partition's parameter stand after the warm-up samples.
    extra = np.where(rice & (at == np.maximum(o, 0)), 10, 0)
    spot = np.cumsum(width + extra)
    body = np.add.reduceat(width + extra, first)
    before = spot - np.repeat(np.cumsum(body) - body, size)
    head_len = np.array([len(h) for h in heads])
    whole = head_len + 1 + -(-body // 8) + 2
    begin = np.cumsum(whole) - whole
    out = np.zeros(int(whole.sum()) + 16, dtype=np.uint8)
    last = (begin + head_len + 1)[frame] * 8 + before - 1  # the last bit of each code
    _put(out, last, value, np.where(rice, k + 1, width))
    mark = np.flatnonzero(extra)
    # Rice method 1 (5-bit parameters): 2 bits method, 4 bits partition order 0, then the parameter in the low 4 of method 0.
    _put(out, last[mark] - width[mark], k[mark], np.full(len(mark), 10))
    kind = np.where(order >= 0, (8 + warm) << 1, np.where(order == -1, 1 << 1, 0)).astype(np.uint8)
    flat = np.frombuffer(b"".join(heads), dtype=np.uint8)
    where = np.repeat(begin - (np.cumsum(head_len) - head_len), head_len) + np.arange(len(flat))
    out[where] = flat
    out[begin + head_len] = kind
    check = crc16(out, begin, whole - 2)
    out[begin + whole - 2] = check >> 8
    out[begin + whole - 1] = check & 255

    streams, data, f = [], out.tobytes(), 0
    for p, n in zip(payloads, per.tolist(), strict=True):
        sizes, starts = whole[f : f + n], begin[f : f + n]
        points = np.zeros(n, dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        points["sample"], points["offset"], points["n"] = number[f : f + n] * BLOCK, starts - starts[0], size[f : f + n]
        signed = (raw[first[f] : first[f] + len(p)] ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        seek = points.tobytes()
        streams.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data[starts[0] : starts[-1] + sizes[-1]])
        f += n
    return streams


def _put(out: np.ndarray, last: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    """Write ``value`` so that its lowest bit is bit ``last`` (bits counted from the top of byte 0)."""
    some = width > 0
    last, value = last[some], value[some]
    byte = last >> 3
    word = value << (7 - (last & 7))
    for i in range(3):
        part = (word >> (8 * i)) & 255
        use = np.flatnonzero(part)
        # Codes do not overlap, so their sum is their union.
        out += np.bincount(byte[use] - i, weights=part[use], minlength=len(out)).astype(np.uint8)


class _Stream:
    __slots__ = ("first", "md5", "offsets", "sizes", "total")

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, final, self.offsets = 4, False, None
        while not final:
            final, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + n]
            if kind == 0:
                self.total, self.md5 = int.from_bytes(block[10:18], "big") & (1 << 36) - 1, block[18:34]
            elif kind == 3:
                points = np.frombuffer(block, dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
                self.offsets, self.sizes = points["offset"].astype(np.int64), points["n"].astype(np.int64)
            at += 4 + n
        self.first = at


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams that :func:`encode` wrote, all frames side by side."""
    if not streams:
        return []
    infos = [_Stream(s) for s in streams]
    lengths = np.array([len(s) for s in streams])
    base = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(streams) + bytes(16), dtype=np.uint8)
    begin = np.concatenate([b + i.first + i.offsets for b, i in zip(base, infos, strict=True)])
    end = np.concatenate([np.append(b + i.first + i.offsets[1:], b + n) for b, i, n in zip(base, infos, lengths, strict=True)])
    size = np.concatenate([i.sizes for i in infos])
    order = np.argsort(-size, kind="stable")
    begin, end, size = begin[order], end[order], size[order]
    got = crc16(data, begin, end - begin - 2)
    if np.any(got != (data[end - 2].astype(np.uint16) << np.uint16(8) | data[end - 1])):
        raise ValueError("CRC-16 of a frame does not fit")
    # The header: its frame number is 1 to 7 bytes long.
    lead = data[begin + 4]
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    head = 4 + extra + 2
    check = np.zeros(len(begin), dtype=np.int64)
    for i in range(int(head.max())):
        check = np.where(i < head, _CRC8[check ^ data[np.minimum(begin + i, len(data) - 1)]], check)
    if np.any(check != data[begin + head]):
        raise ValueError("CRC-8 of a frame header does not fit")
    kind = (data[begin + head + 1] >> 1).astype(np.int64)
    body = begin + head + 2
    out = np.zeros((len(size), int(size.max())), dtype=np.int16)
    for i in np.flatnonzero(kind == 0).tolist():
        out[i, : size[i]] = data[body[i]].astype(np.int8)
    for i in np.flatnonzero(kind == 1).tolist():
        out[i, : size[i]] = data[body[i] : body[i] + size[i]].view(np.int8)
    some = np.flatnonzero(kind >= 8)
    if len(some):
        _decode_fixed(data, body[some] * 8, kind[some] - 8, size[some], out, some)
    flat = np.empty(int(size.sum()), dtype=np.uint8)
    spot = np.empty(len(size), dtype=np.int64)
    back = np.empty(len(size), dtype=np.int64)
    back[order] = np.arange(len(size))
    sizes = size[back]
    spot = np.cumsum(sizes) - sizes
    keep = np.arange(out.shape[1])[None, :] < sizes[:, None]
    flat = (out[back][keep] & 255).astype(np.uint8)
    result, at, f = [], 0, 0
    for i in infos:
        signed = flat[at : at + i.total]
        if hashlib.md5(signed.tobytes()).digest() != i.md5:
            raise ValueError("MD5 of a stream does not fit")
        result.append((signed ^ 0x80).tobytes())
        at, f = at + i.total, f + len(i.offsets)
    return result


def _decode_fixed(data: np.ndarray, bit: np.ndarray, order: np.ndarray, size: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
    """FIXED subframes with one Rice partition; frames come longest first."""
    words = np.ndarray(shape=(len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))
    n = len(bit)
    warm = np.zeros((n, _ORDERS), dtype=np.int64)
    for j in range(int(order.max(initial=0))):
        use = order > j
        warm[use, j] = (data[bit[use] // 8 + j]).astype(np.int8)
    at = bit + 8 * order
    k = (words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64) >> np.uint64(54)).astype(np.int64)
    if np.any(k >= 15):
        raise ValueError("not a stream of this encoder")
    at = at + 10
    most = int((size - order).max(initial=0))
    codes = np.zeros((most, n), dtype=np.int16)
    left = size - order
    turn = np.argsort(-left, kind="stable")
    at, k, left = at[turn], k[turn], left[turn]
    live = np.searchsorted(-left, -np.arange(most), side="left").tolist()
    ku = k.astype(np.uint64)
    rest = np.uint64(64) - ku
    for i, m in enumerate(live):
        p = at[:m]
        w = words[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        # Leading zeros by the exponent of the top 32 bits, exact in a double.
        q = 32 - np.frexp((w >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
        low = (w << (q + 1).astype(np.uint64)) >> rest[:m]
        codes[i, :m] = (q << k[:m]) | low.astype(np.int64)
        at[:m] = p + q + 1 + k[:m]
    z = np.empty((n, most), dtype=np.int16)
    z[turn] = codes.T
    x = ((z >> 1) ^ -(z & 1)).astype(np.int32)
    for o in range(_ORDERS):
        use = np.flatnonzero(order == o)
        if not len(use):
            continue
        # The j-th differences begin with the warm-up samples' own; each sum undoes one difference.
        full, begins, d = x[use], [], warm[use, :o].astype(np.int32)
        for _ in range(o):
            begins.append(d[:, :1])
            d = np.diff(d, axis=1)
        for first in reversed(begins):
            full = np.cumsum(np.concatenate([first, full], axis=1), axis=1, dtype=np.int32)
        wide = min(full.shape[1], out.shape[1])
        out[rows[use], :wide] = full[:, :wide].astype(np.int16)


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("the stream ends inside a frame")
        word = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n)
        self.at += n
        return word & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


#: Fixed values of the format: coefficients of the fixed predictors, block sizes and sample sizes by code.
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
_SIZES = {1: 192} | {k: 576 << (k - 2) for k in range(2, 6)} | {k: 256 << (k - 8) for k in range(8, 16)}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _subframe(bits: _Bits, n: int, depth: int) -> list[int]:
    if bits.take(1):
        raise ValueError("padding bit of a subframe is set")
    kind = bits.take(6)
    wasted = bits.zeros() + 1 if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        x = [bits.signed(depth)] * n
    elif kind == 1:
        x = [bits.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        x = [bits.signed(depth) for _ in range(order)]
        shift, weights = 0, _FIXED[order] if kind < 32 else []
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        method = bits.take(2)
        if method > 1:
            raise ValueError("unknown residual coding")
        wide = 4 + method
        parts = bits.take(4)
        for part in range(1 << parts):
            count = (n >> parts) - (order if part == 0 else 0)
            k = bits.take(wide)
            raw = bits.take(5) if k == (1 << wide) - 1 else None
            for _ in range(count):
                if raw is not None:
                    r = bits.signed(raw)
                else:
                    q = bits.zeros()
                    z = q << k | bits.take(k)
                    r = z >> 1 ^ -(z & 1)
                x.append(r + (sum(w * x[-1 - i] for i, w in enumerate(weights)) >> shift))
    else:
        raise ValueError("reserved subframe type")
    return [v << wasted for v in x]


def decode_any(stream: bytes) -> list[int]:
    """Samples of a mono stream, whatever its subframes; checks CRC-8, CRC-16 and, for 8 bits, the MD5."""
    info, data = _Stream(stream), np.frombuffer(stream + b"\0\0", dtype=np.uint8)
    at, out, depth = info.first, [], int.from_bytes(stream[8 + 10 : 8 + 18], "big") >> 36 & 31
    while at < len(stream):
        bits = _Bits(stream, at * 8)
        if bits.take(15) != 0x7FFC:
            raise ValueError("no frame here")
        bits.take(1)
        size, rate, channels, width = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        bits.take(1)
        lead = bits.take(8)
        for _ in range(0 if lead < 0x80 else 7 - (~lead & 0xFF).bit_length()):
            bits.take(8)
        n = bits.take(8) + 1 if size == 6 else bits.take(16) + 1 if size == 7 else _SIZES[size]
        bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        if crc8(stream[at : bits.at >> 3]) != bits.take(8):
            raise ValueError("CRC-8 of a frame header does not fit")
        if channels:
            raise ValueError("not mono")
        out += _subframe(bits, n, _BITS.get(width, depth + 1))
        end = (bits.at + 7) >> 3
        if int(crc16(data, np.array([at]), np.array([end - at]))[0]) != int.from_bytes(stream[end : end + 2], "big"):
            raise ValueError("CRC-16 of a frame does not fit")
        at = end + 2
    if depth == 7 and any(info.md5) and hashlib.md5(np.array(out, dtype=np.int8).tobytes()).digest() != info.md5:
        raise ValueError("MD5 of the stream does not fit")
    return out


def decode_range(stream: bytes, start: int, stop: int) -> bytes:
    """Bytes [start, stop) of a payload, from the frames that hold them: the seek table says where they are."""
    info = _Stream(stream)
    firsts = np.cumsum(info.sizes) - info.sizes
    a = max(0, int(np.searchsorted(firsts, start, side="right")) - 1)
    b = int(np.searchsorted(firsts, stop, side="left"))
    if start >= min(stop, info.total) or a >= b:
        return b""
    lo = info.first + int(info.offsets[a])
    hi = info.first + int(info.offsets[b]) if b < len(info.offsets) else len(stream)
    piece = decode_any(b"fLaC\x80\x00\x00\x22" + stream[8:26] + bytes(16) + stream[lo:hi])
    skip = start - int(firsts[a])
    return bytes((v + 128) & 255 for v in piece[skip : skip + stop - start])


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def _pieces(sizes: list[int]) -> Iterator[slice]:
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > PIECE:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)]
        for s in _pieces(lengths):
            part = batch.slice(s.start, s.stop - s.start)
            media = encode([payload_of(t) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths[s], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a FLAC stream."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encode_batches, "doc_id long, n_bytes long, media binary")


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column(1).to_pylist()
        for s in _pieces([len(m) for m in media]):
            rows = []
            for d, p in zip(batch.column(0).to_pylist()[s], decode(media[s]), strict=True):
                rows += [(d, i // BLOCK, i, min(BLOCK, len(p) - i), p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "block", "sample_offset", "n_samples", "pcm"])


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, n_samples, pcm) from ``to_media``'s rows: decoded and verified."""
    return media.select("doc_id", "media").mapInArrow(_block_batches, "doc_id long, block long, sample_offset long, n_samples long, pcm binary")


def features(payload: bytes) -> str:
    """Mean, root mean square, peak and zero crossings of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    sign = x >= 0
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};peak={int(np.abs(x).max())};crossings={int((sign[1:] != sign[:-1]).sum())}"


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _OUT.split(", ")]
    for batch in batches:
        media = batch.column(2).to_pylist()
        for s in _pieces([len(m) for m in media]):
            rows = []
            for d, n, m, p in zip(batch.column(0).to_pylist()[s], batch.column(1).to_pylist()[s], media[s], decode(media[s]), strict=True):
                rows.append((d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(p)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64())] + [pa.array(c) for c in cols[1:]], names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stage(to_media(table(spark, sf_dir, "documents")), "media")
    return media.mapInArrow(_read_batches, _OUT)
