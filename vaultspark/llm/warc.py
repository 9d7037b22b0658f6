"""WARC archives read by index.

Records are written to ``.warc.zst`` files (one zstd frame a record, so each
record can be read alone) in the shared folder. The writer returns one index row
for each record - archive, offset, length, URL, digest - and the index is staged as
a table before anything is read; files of failed attempts are in no index row. A read
takes selected index rows, sorts them by archive and offset, merges neighbours into ranges, reads
each range once, and checks every record's digest.

Deduplication: of records with equal payloads of at least ``least`` bytes, the one with
the smallest id is a ``response``; the others are ``revisit`` records that
name it and hold no payload. Payload digests are SHA-1 in bare base32.

The archives' folder is opened with ``pyarrow.fs`` by its URI (local or shared
disks, HDFS, S3, GCS); input tables are read by Spark alone.

Defined cases: a null payload is empty; a null URL is written as an empty URI; null ids
never are the smallest (all null: every record is a response); rows that repeat
both id and payload get the same type; very long payloads are whole records; an empty table gives an empty archive set;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, stage, table

INDEX = "archive string, offset long, length long, page_id long, url string, record_type string, payload_digest string"
_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string())])
#: Neighbours closer than this are read in one range, and a range is not longer than that.
GAP, RANGE = 64 << 10, 4 << 20
#: Bytes of archives for one task of a read, and the most tasks, beyond which each reads more.
TASK_BYTES, MOST_TASKS = 8 << 20, 20_000
#: An archive is closed beyond this size.
ROLL = 256 << 20
#: Names of the header fields.
VERSION, DATE = "WARC/1.1", "2020-01-01T00:00:00Z"


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Payload-Length", str(len(payload)))]
        payload = b""
    fields += [("Content-Type", "text/html"), ("Content-Length", str(len(payload)))]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; raises if lengths or ends don't fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:20]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length does not fit")
    return fields, rest[:n]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True)
        out, name, at = None, None, 0
        for batch in batches:
            rows = []
            ids, urls, pages, firsts = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                if out is None or at >= ROLL:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                page, url, first = ids[i].as_py(), urls[i].as_py(), firsts[i].as_py()
                payload = (pages[i].as_py() or "").encode()
                digest = digest_of(payload)
                kind = "response" if first is None or first == page else "revisit"
                frame = pack.compress(record(page, url, payload, kind, digest, first))
                out.write(frame)
                rows.append((name, at, len(frame), page, url, kind, digest))
                at += len(frame)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _INDEX, strict=True)] if rows else [pa.array([], t.type) for t in _INDEX], schema=_INDEX)
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> tuple[DataFrame, str]:
    """Write all records; gives the staged index and the archives' folder."""
    folder = new_folder(pages.sparkSession, "warc")
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(payload, F.lit("")).alias("html"))
    slim = own.where(F.octet_length("html") >= least).select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"))
    copies = slim.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    revisits = slim.join(copies, "sha").where("not (page_id <=> first)").select(F.col("page_id").alias("__page"), "sha", "first").distinct()
    told = own.withColumn("__sha", F.sha1(F.col("html").cast("binary")))
    told = told.join(revisits, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("__sha") == F.col("sha")), "left")
    index = told.select("page_id", "url", "html", "first").mapInArrow(_writer(folder), INDEX)
    return stage(index, "warc-index"), folder


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def ranges(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Merge (archive, offset, length), sorted, into (archive, start, end, records)."""
    held: list | None = None
    for archive, offset, length in rows:
        if held and held[0] == archive and offset - held[2] <= GAP and offset + length - held[1] <= RANGE:
            held[2] = max(held[2], offset + length)
            held[3].append((offset, length))
            continue
        if held:
            yield tuple(held)
        held = [archive, offset, offset + length, [(offset, length)]]
    if held:
        yield tuple(held)


def _urn(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        name, file = None, None
        wanted = (x for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        for archive, start, end, records in ranges(wanted):
            if archive != name:
                if file is not None:
                    file.close()
                name, file = archive, fs.open_input_file(f"{root}/{archive}")
            data = file.read_at(end - start, start)
            out = []
            for offset, length in records:
                f, block = parse(unpack.decompress(data[offset - start : offset - start + length]))
                digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = f["WARC-Type"] == "revisit"
                if not revisit and digest_of(block) != digest:
                    raise ValueError(f"digest does not fit: {archive} at {offset}")
                size = int(f["X-Payload-Length"]) if revisit else len(block)
                out.append((_urn(f["WARC-Record-ID"]), f["WARC-Target-URI"], size, digest, f["WARC-Type"], _urn(f.get("WARC-Refers-To")), None if revisit else block))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _READ, strict=True)], schema=_READ)
        if file is not None:
            file.close()

    return read


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` selects, read by sorted and merged byte ranges."""
    slim = index.select("archive", "offset", "length")
    # By the bytes of the archives: adaptive execution sees the slim index only.
    total = slim.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = min(MOST_TASKS, max(1, -(-total // TASK_BYTES)))
    dealt = slim.repartition(tasks, "archive", F.floor(F.col("offset") / (4 * RANGE))).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_reader(folder), READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = write_archives(table(spark, sf_dir, "pages"))
    out = read_archives(index, folder)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages),
f as (select h, min(page_id) as first from p group by h),
d as (
  select page_id, h, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, 5 * i + 1, 5))::bigint >> k) % 32 + 1, 1) for k in [15, 10, 5, 0]], '') for i in range(8)], '') as digest
  from p
)
select page_id, octet_length(encode(h)) as payload_bytes, digest as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from d join f using (h)
"""
