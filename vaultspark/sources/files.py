"""Folders as tables, and tables as folders: scans, stable reads, extraction, archives."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions import cdc, paths

#: Folders that a walk leaves out, besides names that start with a dot.
SKIPPED = ["node_modules", "target", "dist"]


def _relative(root: str) -> Column:
    """Path below ``root``, which may be given without a scheme."""
    bare = root.rstrip("/").split("://", 1)[-1]
    bare = bare[bare.index("/") :] if "://" in root and not bare.startswith("/") else bare
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:(//[^/]*)?", "")
    return F.substr(path, F.lit(len(bare) + 2))


def list_folder(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """(name, size, mtime) of the files below ``root`` that no rule leaves out; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    df = df.select(_relative(root).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return df.where(~paths.ignored("name", patterns))


def walk_folder(spark: SparkSession, root: str) -> DataFrame:
    """(name, content) of the files below ``root``, without dot names and the skipped folders."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    df = df.select(_relative(root).alias("name"), "content")
    return df.where(~F.exists(F.split("name", "/"), lambda c: F.startswith(c, F.lit(".")) | c.isin(SKIPPED)))


def read_stable(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """(name, content) of files whose size and time were the same before and after they were read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    got = df.select(_relative(root).alias("name"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    got = got.where((F.octet_length("content") == F.col("size")) & ~paths.ignored("name", patterns))
    return got.join(list_folder(spark, root, patterns), ["name", "size", "mtime"], "left_semi").select("name", "content")


def physical_bytes(spark: SparkSession, root: str) -> int:
    """Bytes of all files below ``root``; only listings are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def _extractor(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1).to_pylist(), strict=True):
                target = f"{base}/{name}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                temp = f"{target}.{uuid.uuid4().hex}.part"
                try:
                    with fs.open_output_stream(temp, compression=None) as out:
                        out.write(content)
                    fs.move(temp, target)
                except BaseException:
                    if fs.get_file_info(temp).type == pafs.FileType.File:
                        fs.delete_file(temp)
                    raise
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return run


def extract(files: DataFrame, root: str) -> DataFrame:
    """Write (name, content) below ``root``: cleaned paths, a temporary name first, then a rename. Gives (name, bytes).

    ``content`` comes verified (``Vault.contents`` raises before a byte is written).
    """
    clean = files.select(paths.sanitize("name").alias("name"), "content").where("name <> ''")
    return clean.mapInArrow(_extractor(root), "name string, bytes long")


def _zipper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, buffer, archive = None, None, None

    def done():
        archive.close()
        return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([buffer.getvalue()], pa.binary())], ["folder", "zip"])

    for batch in batches:
        for folder, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if folder != key or archive is None:
                if archive is not None:
                    yield done()
                key, buffer = folder, io.BytesIO()
                archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
            archive.writestr(zipfile.ZipInfo(name), content)
    if archive is not None:
        yield done()


def zip_folders(files: DataFrame) -> DataFrame:
    """(folder, zip) from (folder, name, content): one archive for each folder, files in byte order of their names."""
    slim = files.select("folder", "name", "content").repartition("folder").sortWithinPartitions("folder", "name")
    return slim.mapInArrow(_zipper, "folder string, zip binary")


#: Bytes read at once from a file, and bytes of chunks given to Spark at once.
BLOCK, BATCH = 1 << 20, 8 << 20
TRIES = 3
_CHUNK_ROWS = "name string, seq long, attempt int, ordinal int, start_offset long, raw_len int, chunk_id string, data binary"


def _path_chunker(sizes: tuple[int, int, int]):
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
    columns = [c.split()[0] for c in _CHUNK_ROWS.split(", ")]

    def rows(name, seq, path):
        for attempt in range(1, TRIES + 1):
            fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
            before, whole, offset, ordinal, chunker = fs.get_file_info(at), hashlib.sha256(), 0, 0, cdc.StreamChunker(*sizes)
            with fs.open_input_stream(at, compression=None) as stream:
                while True:
                    block = stream.read(BLOCK)
                    whole.update(block)
                    for chunk in chunker.feed(block) if block else chunker.finish():
                        yield name, seq, attempt, ordinal, offset, len(chunk), hashlib.sha256(chunk).hexdigest(), chunk
                        offset, ordinal = offset + len(chunk), ordinal + 1
                    if not block:
                        break
            after = fs.get_file_info(at)
            if (before.size, before.mtime_ns) == (after.size, after.mtime_ns) and after.size == offset:
                yield name, seq, attempt, -1, offset, 0, whole.hexdigest(), None
                return
        yield name, seq, 0, -1, 0, 0, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for out in rows(*row):
                    held.append(out)
                    size += 200 + out[5]
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], columns)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], columns)

    return run


def chunk_paths(files: DataFrame, sizes: tuple[int, int, int]) -> DataFrame:
    """Chunks of (name, seq, path), read in blocks: ordinal -1 has a file's size, SHA-256 and the attempt that found it at rest (0: none did).

    Chunks of attempts that failed carry another number than that row.
    """
    return files.select("name", "seq", "path").mapInArrow(_path_chunker(sizes), _CHUNK_ROWS)


def _chunk_writer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        key = out = temp = target = whole = None
        size = 0

        def done():
            out.close()
            if whole.hexdigest() != key[1]:
                raise ValueError(f"file hash does not fit: {key[0]}")
            fs.move(temp, target)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([size], pa.int64())], ["name", "bytes"])

        try:
            for batch in batches:
                for name, manifest, ordinal, ok, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if key != (name, manifest):
                        if key is not None:
                            yield done()
                        key, target, whole, size = (name, manifest), f"{base}/{name}", hashlib.sha256(), 0
                        temp = f"{target}.{uuid.uuid4().hex}.part"
                        fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                        out = fs.open_output_stream(temp, compression=None)
                    if ordinal is None:
                        continue  # an empty file has no chunks
                    if not ok:
                        raise ValueError(f"a chunk is missing or corrupt: {name}")
                    out.write(data)
                    whole.update(data)
                    size += len(data)
            if key is not None:
                yield done()
        finally:
            if temp is not None and fs.get_file_info(temp).type == pafs.FileType.File:
                out.close()
                fs.delete_file(temp)

    return run


def write_chunks(parts: DataFrame, root: str) -> DataFrame:
    """Write files below ``root`` from (name, manifest_id, ordinal, hash_ok, data), each by one task in the order of its chunks."""
    slim = parts.select(paths.sanitize("name").alias("name"), "manifest_id", "ordinal", F.coalesce("hash_ok", F.lit(False)).alias("ok"), "data").where("name <> ''")
    return slim.repartition("name").sortWithinPartitions("name", "manifest_id", "ordinal").mapInArrow(_chunk_writer(root), "name string, bytes long")


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, out = batch.column(0).to_pylist(), []
        for path in batch.column(1).to_pylist():
            fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
            whole = hashlib.sha256()
            with fs.open_input_stream(at, compression=None) as stream:
                while block := stream.read(BLOCK):
                    whole.update(block)
            out.append(whole.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], ["name", "content_hash"])


def hash_paths(files: DataFrame) -> DataFrame:
    """(name, content_hash) of (name, path), read in blocks."""
    return files.select("name", "path").mapInArrow(_hasher, "name string, content_hash string")
