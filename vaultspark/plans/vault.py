"""A vault: versioned, content-addressed, deduplicated files as tables behind a commit log.

Every change is computed as new rows against a pinned log number, written as
Parquet, and made visible by one commit. Metadata rows are events that carry the number of their
commit; a table's state is the newest event of each key, so a change costs its own rows and not the table.
``optimize`` writes the state anew.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions import cdc, codecs, paths
from vaultspark.functions.errors import AlreadyExists, Conflict, Corrupt, InvalidName, NotEncrypted, NotFound, WouldBlock
from vaultspark.operators import relops
from vaultspark.plans.log import CommitLog
from vaultspark.sources import files as sources

SCHEMAS = {
    "names": "name string, object_id string, lsn long",
    "objects": "object_id string, latest_version int, alive boolean, lsn long",
    "versions": "object_id string, version int, manifest_id string, size_bytes long, created_at timestamp, alive boolean, lsn long",
    "manifests": "manifest_id string, total_size long, created_at timestamp, lsn long",
    "manifest_chunks": "manifest_id string, ordinal int, chunk_id string, raw_len int, start_offset long",
    "chunks": "chunk_id string, codec string, scheme string, raw_len int, payload_len int, payload_crc long, payload binary",
    "snapshots": "label string, created_at timestamp, alive boolean, lsn long",
    "snapshot_entries": "label string, name string, object_id string, version int, manifest_id string, size_bytes long, lsn long",
    "tracked_files": "watch_root string, name string, alive boolean, lsn long",
    "watch_config": "watch_dir string, debounce_secs long, cooldown_secs long, throttle_ms long, lsn long",
    "shares": "id string, path string, token string, expires_at long, alive boolean, lsn long",
}
_KEYS = {"names": ["name"], "objects": ["object_id"], "versions": ["object_id", "version"], "manifests": ["manifest_id"], "snapshots": ["label"], "tracked_files": ["watch_root", "name"], "shares": ["id"]}
RETRIES = 24
#: Seconds for which data files that nothing refers to any more stay, for readers of an older state and writers under way.
GRACE = 3600.0


class Vault:
    def __init__(self, spark: SparkSession, root: str, key: bytes | None, sizes: tuple[int, int, int]):
        self.spark, self.root, self.sizes = spark, root.rstrip("/"), sizes
        self.log, self._key = CommitLog(spark, root), key

    # Opening.

    @classmethod
    def open(cls, spark: SparkSession, root: str, passphrase: str | None = None, sizes: tuple[int, int, int] = (cdc.LEAST, cdc.TARGET, cdc.MOST)) -> Vault:
        """Open a vault, or make it: encrypted if a passphrase is given. The mode is in commit 1 and never changes."""
        vault = cls(spark, root, None, sizes)
        if not vault.log.last():
            key, record = codecs.create_key(passphrase) if passphrase is not None else (None, None)
            try:
                vault.log.commit(1, "create", [], {"encryption": record, "hash": "sha-256"})
                vault._key = key
                return vault
            except Conflict:
                pass  # another opener was first; its mode counts
        record = vault.log.commits(0, 1)[0]["summary"]["encryption"]
        if record is None and passphrase is not None:
            raise NotEncrypted("the store is plain")
        vault._key = codecs.unlock_key(passphrase, record) if record else None
        return vault

    # Tables.

    def events(self, table: str, upto: int | None = None) -> DataFrame:
        files = self.log.files(upto).get(table, [])
        if not files:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.root}/{f}" for f in files])

    def state(self, table: str, upto: int | None = None) -> DataFrame:
        """The newest event of each key, without what is gone."""
        df = self.events(table, upto)
        keys = _KEYS.get(table)
        if keys is None:
            return df
        rest = [c for c in df.columns if c not in keys]
        df = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "lsn").alias("e")).select(*keys, "e.*")
        if "alive" in df.columns:
            df = df.where("alive")
        return df.where("object_id is not null") if table == "names" else df

    def names(self, upto: int | None = None) -> DataFrame:
        return self.state("names", upto).select("name", "object_id")

    def versions_table(self, upto: int | None = None) -> DataFrame:
        return self.state("versions", upto).select("object_id", "version", "manifest_id", "size_bytes", "created_at")

    def _entries(self, upto: int | None = None) -> DataFrame:
        live = self.state("snapshots", upto).select("label", F.col("lsn").alias("__lsn"))
        return self.events("snapshot_entries", upto).join(live, "label").where("lsn = __lsn").drop("__lsn", "lsn")

    def _write(self, table: str, df: DataFrame) -> dict:
        path = f"data/{table}/{uuid.uuid4().hex}"
        kinds = self.spark.createDataFrame([], SCHEMAS[table]).schema
        df.select(*[F.col(f.name).cast(f.dataType) for f in kinds]).write.parquet(f"{self.root}/{path}")
        return {"op": "add", "table": table, "path": path}

    def _change(self, kind: str, build: Callable[[int, int], tuple[dict[str, DataFrame], dict]], removes: Callable[[], list[dict]] | None = None) -> dict:
        """Commit what ``build(pinned, lsn)`` gives; on a conflict it is computed again from the newer state."""
        for attempt in range(RETRIES):
            pinned = self.log.last()
            tables, summary = build(pinned, pinned + 1)
            if not tables and not removes:
                return summary
            actions = (removes() if removes else []) + [self._write(t, df) for t, df in tables.items()]
            try:
                self.log.commit(pinned + 1, kind, actions, summary)
                return summary | {"lsn": pinned + 1}
            except Conflict:
                # What was written for a commit that did not come about.
                for a in actions:
                    if a["op"] == "add":
                        self._drop(a["path"])
                time.sleep(random.uniform(0, 0.05 * (attempt + 1)))
        raise Conflict(f"{kind}: other writers were faster {RETRIES} times")

    # Writing.

    def put(self, files: DataFrame) -> DataFrame:
        """Store ``files`` (name, content and optionally seq) as new versions, in one commit.

        Gives (name, version, manifest_id, size_bytes, chunk_count, new_chunks, dedup_chunks). Versions of
        a name are numbered by seq; equal content still makes a version.
        """
        if "seq" not in files.columns:
            files = files.withColumn("seq", F.lit(0).cast("long"))
        files = files.select(F.trim("name").alias("name"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
        self._check_names(files)
        keyed = files.withColumn("manifest_id", F.sha2("content", 256))
        cut = cdc.chunk(keyed, ["name", "seq", "manifest_id"], "content", *self.sizes)
        facts = keyed.select("name", "seq", "manifest_id", F.octet_length("content").cast("long").alias("size_bytes"))
        return self._store(cut, facts)

    def put_paths(self, files: DataFrame) -> DataFrame:
        """As :meth:`put`, for (name, path and optionally seq): files are read in blocks and never held whole.

        Paths are local ones or URIs that every executor can open. A file whose size or time changes while it is
        read is read again, three times at most; then nothing is stored and :class:`WouldBlock` names it.
        """
        if "seq" not in files.columns:
            files = files.withColumn("seq", F.lit(0).cast("long"))
        files = files.select(F.trim("name").alias("name"), F.col("seq").cast("long").alias("seq"), "path")
        self._check_names(files)
        rows = sources.chunk_paths(files, self.sizes)
        staging = f"data/_staging/{uuid.uuid4().hex}"
        try:
            rows.withColumn("data", self._sealed("data")).write.parquet(f"{self.root}/{staging}")
            read = self.spark.read.parquet(f"{self.root}/{staging}")
            moving = read.where("ordinal = -1 and attempt = 0").select("name").limit(3).collect()
            if moving:
                raise WouldBlock(", ".join(r.name for r in moving))
            facts = read.where("ordinal = -1").select("name", "seq", "attempt", F.col("chunk_id").alias("manifest_id"), F.col("start_offset").alias("size_bytes"))
            cut = read.where("ordinal >= 0").join(facts.select("name", "seq", "attempt", "manifest_id"), ["name", "seq", "attempt"])
            return self._commit_put(cut.drop("attempt"), facts.drop("attempt"))
        finally:
            self._drop(staging)

    def _check_names(self, files: DataFrame) -> None:
        bad = files.select("name", paths.name_error("name").alias("why")).where("why is not null").limit(3).collect()
        if bad:
            raise InvalidName("; ".join(f"{r.name!r}: {r.why}" for r in bad))

    def _store(self, cut: DataFrame, facts: DataFrame) -> DataFrame:
        """Files are read once: their facts and their chunks are staged (encrypted, where the vault is), and all that follows reads these."""
        staging = f"data/_staging/{uuid.uuid4().hex}"
        try:
            cut.withColumn("data", self._sealed("data")).write.parquet(f"{self.root}/{staging}/chunks")
            facts.write.parquet(f"{self.root}/{staging}/files")
            return self._commit_put(*(self.spark.read.parquet(f"{self.root}/{staging}/{t}") for t in ("chunks", "files")))
        finally:
            self._drop(staging)

    def _drop(self, path: str) -> None:
        """Delete a folder of the vault that no commit refers to."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _sealed(self, data: str) -> Column:
        """Chunk data for a staged table."""
        return codecs.encrypt(F.col(data), F.lit(self._key), F.lit(b"staged").cast("binary")) if self._key else F.col(data)

    def _commit_put(self, cut: DataFrame, facts: DataFrame) -> DataFrame:
        if self._key:
            opened = codecs.decrypt(F.col("data"), F.lit(self._key), F.lit(b"staged").cast("binary"))
        else:
            opened = F.col("data")

        def build(pinned: int, lsn: int) -> tuple[dict, dict]:
            now = F.current_timestamp()
            new = relops.new_chunks(cut.select("chunk_id", "data", "raw_len"), self.events("chunks", pinned)).withColumn("data", opened)
            bound = facts.join(self.names(pinned), "name", "left")
            made = F.substr(F.sha2(F.concat_ws("/", F.lit(f"{self.root}#{lsn}"), "name"), 256), F.lit(1), F.lit(32))
            bound = bound.withColumn("object_id", F.coalesce("object_id", made))
            numbered = relops.number_versions(bound, self.state("objects", pinned), "object_id", "seq")
            fresh = facts.join(self.events("manifests", pinned).select("manifest_id"), "manifest_id", "left_anti")
            mc = cut.join(fresh.select("manifest_id").distinct(), "manifest_id", "left_semi").dropDuplicates(["manifest_id", "ordinal"])
            alive = F.lit(True)
            return {
                "chunks": self._encoded(new),
                "manifest_chunks": mc,
                "manifests": facts.groupBy("manifest_id").agg(F.max("size_bytes").alias("total_size")).withColumns({"created_at": now, "lsn": F.lit(lsn)}),
                "versions": numbered.withColumns({"created_at": now, "alive": alive, "lsn": F.lit(lsn)}),
                "objects": numbered.groupBy("object_id").agg(F.max("version").alias("latest_version")).withColumns({"alive": alive, "lsn": F.lit(lsn)}),
                "names": numbered.select("name", "object_id").distinct().withColumn("lsn", F.lit(lsn)),
            }, {"op": "put"}

        return self._put_result(self._change("put", build)["lsn"])

    def _put_result(self, lsn: int) -> DataFrame:
        """What commit ``lsn`` stored, from its own files and the chunks that were there before it."""
        made = self.events("names", lsn).where(F.col("lsn") == lsn).select("name", "object_id")
        versions = self.events("versions", lsn).where(F.col("lsn") == lsn).join(made, "object_id").select("name", "object_id", "version", "manifest_id", "size_bytes")
        refs = versions.select("name", "version", "manifest_id").join(self.events("manifest_chunks", lsn), "manifest_id")
        summary = relops.put_summary(refs.select("name", "version", "ordinal", "chunk_id", "raw_len"), self.events("chunks", lsn - 1).select("chunk_id"), "name", ["name", "version", "ordinal"])
        newest = relops.latest(versions, "name")
        return newest.join(summary, "name", "left").select("name", "version", "manifest_id", "size_bytes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunk_count", "new_chunks", "dedup_chunks")])

    def _encoded(self, chunks: DataFrame) -> DataFrame:
        e = chunks.withColumn("e", codecs.encode_chunk(F.col("data"))).select("chunk_id", "raw_len", F.col("e.codec").alias("codec"), F.col("e.payload").alias("payload"))
        if self._key:
            aad = codecs.associated_data(F.col("chunk_id"), F.col("codec"), F.col("raw_len"), F.octet_length("payload"))
            e = e.withColumn("payload", codecs.encrypt(F.col("payload"), F.lit(self._key), aad))
        return e.withColumns({"scheme": F.lit("gcm" if self._key else "none"), "payload_len": F.octet_length("payload"), "payload_crc": codecs.crc(F.col("payload"))})

    def decoded(self, chunks: DataFrame) -> DataFrame:
        """``chunks`` with data, crc_ok and hash_ok: CRC first, then decryption, decompression and the content hash."""
        crc_ok = codecs.crc(F.col("payload")) == F.col("payload_crc")
        plain = F.when(crc_ok, F.col("payload"))
        if self._key:
            # 12 bytes of nonce and 16 of tag around the data.
            aad = codecs.associated_data(F.col("chunk_id"), F.col("codec"), F.col("raw_len"), F.col("payload_len") - 28)
            plain = codecs.decrypt(plain, F.lit(self._key), aad)
        df = chunks.withColumns({"crc_ok": crc_ok, "__plain": plain})
        df = df.withColumn("data", codecs.decode_chunk(F.col("codec"), F.col("__plain"))).drop("__plain")
        return df.withColumn("hash_ok", F.coalesce(F.sha2("data", 256) == F.col("chunk_id"), F.lit(False)))

    # Reading.

    def list_files(self) -> DataFrame:
        return relops.list_files(self.names(), self.versions_table(), self.state("objects"))

    def _object(self, target: str, pinned: int | None = None) -> str:
        hit = self.names(pinned).where(F.col("name") == target).select("object_id").first()
        if hit:
            return hit[0]
        if self.state("objects", pinned).where(F.col("object_id") == target).count():
            return target
        raise NotFound(target)

    def versions(self, target: str) -> DataFrame:
        return self.versions_table().where(F.col("object_id") == self._object(target)).orderBy("version")

    def resolve(self, target: str, version: int | None = None) -> str:
        """The manifest of a target: name, object id or manifest id; with a version, name or object id only."""
        if version is not None:
            row = self.versions(target).where(F.col("version") == version).first()
            if row is None:
                raise NotFound(f"{target} version {version}")
            return row.manifest_id
        one = self.spark.sql("select :t as target", args={"t": target})
        row = relops.resolve(one, self.names(), self.versions_table(), self.state("manifests").select("manifest_id")).first()
        if row.manifest_id is None:
            raise NotFound(target)
        return row.manifest_id

    def contents(self, manifests: DataFrame) -> DataFrame:
        """(manifest_id, content) of whole files, verified: chunks by hash, files by their id; raises on any fault."""
        wanted = manifests.select("manifest_id").distinct()
        refs = self.events("manifest_chunks").join(wanted, "manifest_id", "left_semi")
        got = refs.join(self.decoded(self.events("chunks")), "chunk_id", "left")
        data = F.when(F.col("hash_ok"), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("chunk is missing or corrupt: "), "chunk_id")).cast("binary"))
        whole = cdc.assemble(got.select("manifest_id", "ordinal", data.alias("data")), ["manifest_id"])
        whole = wanted.join(whole, "manifest_id", "left").withColumn("content", F.coalesce("content", F.lit(b"").cast("binary")))
        ok = F.sha2("content", 256) == F.col("manifest_id")
        return whole.withColumn("content", F.when(ok, F.col("content")).otherwise(F.raise_error(F.lit("file hash does not fit")).cast("binary")))

    def get(self, target: str, version: int | None = None) -> bytes:
        """One whole file, for small files and tests; ``contents`` serves many."""
        m = self.resolve(target, version)
        return bytes(self.contents(self.spark.sql("select :m as manifest_id", args={"m": m})).first().content)

    def read_range(self, target: str, offset: int, size: int) -> bytes:
        """Bytes [offset, offset + size) of a file; only chunks that overlap are read and verified."""
        m = self.resolve(target)
        req = self.spark.sql("select :m as manifest_id, :o as offset, :s as size", args={"m": m, "o": offset, "s": size})
        refs = self.events("manifest_chunks").where(F.col("manifest_id") == m)
        lost = relops.missing(refs, self.events("chunks"), "chunk_id").count()
        if lost:
            raise Corrupt(f"{lost} chunks are missing")
        hit = relops.range_slices(refs, req).join(self.decoded(self.events("chunks")).select("chunk_id", "data", "hash_ok"), "chunk_id")
        parts = hit.select("ordinal", "hash_ok", F.substr("data", (F.col("from_byte") + 1).cast("int"), F.col("n_bytes").cast("int")).alias("part")).collect()
        if not all(r.hash_ok for r in parts):
            raise Corrupt("a chunk is corrupt")
        return b"".join(bytes(r.part) for r in sorted(parts, key=lambda r: r.ordinal))

    def read_ranges(self, requests: DataFrame) -> DataFrame:
        """(name, offset, size, bytes) of requests (name, offset, size); only chunks that overlap are decoded, each verified.

        A range beyond the end is cut, one past it empty; names that are not there give no row.
        """
        files = relops.list_files(self.names(), self.versions_table(), self.state("objects")).where("manifest_id is not null")
        req = requests.select("name", F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("size")).distinct().join(files.select("name", "manifest_id"), "name")
        hit = relops.range_slices(self.events("manifest_chunks"), req).select("name", "offset", "size", "ordinal", "chunk_id", "from_byte", "n_bytes")
        chunks = self.events("chunks").join(hit.select("chunk_id").distinct(), "chunk_id", "left_semi")
        got = hit.join(self.decoded(chunks).select("chunk_id", "data", "hash_ok"), "chunk_id", "left")
        fault = F.raise_error(F.concat(F.lit("chunk is missing or corrupt: "), "chunk_id")).cast("binary")
        part = F.when(F.col("hash_ok"), F.substr("data", (F.col("from_byte") + 1).cast("int"), F.col("n_bytes").cast("int"))).otherwise(fault)
        whole = cdc.assemble(got.select("name", "offset", "size", "ordinal", part.alias("data")), ["name", "offset", "size"])
        return req.drop("manifest_id").join(whole, ["name", "offset", "size"], "left").select("name", "offset", "size", F.coalesce("content", F.lit(b"").cast("binary")).alias("bytes"))

    # Names and versions.

    def _rows(self, df: DataFrame, lsn: int, alive: bool = True) -> DataFrame:
        return df.withColumns({"alive": F.lit(alive), "lsn": F.lit(lsn)})

    def rollback(self, name: str, version: int) -> int:
        """A new version with the content of ``version``; gives its number."""

        def build(pinned, lsn):
            o = self._object(name, pinned)
            v = self.versions_table(pinned).where((F.col("object_id") == o) & (F.col("version") == version)).first()
            if v is None:
                raise NotFound(f"{name} version {version}")
            top = self.state("objects", pinned).where(F.col("object_id") == o).first().latest_version
            one = self.spark.createDataFrame([(o, top + 1, v.manifest_id, v.size_bytes)], "object_id string, version int, manifest_id string, size_bytes long")
            return {"versions": self._rows(one.withColumn("created_at", F.current_timestamp()), lsn), "objects": self._rows(one.select("object_id", F.col("version").alias("latest_version")), lsn)}, {"version": top + 1}

        return self._change("rollback", build)["version"]

    def prune(self, keep: int, name: str | None = None) -> int:
        """Drop all but the last ``keep`` versions of a name (of every bound name without one); gives how many went."""

        def build(pinned, lsn):
            names = self.names(pinned) if name is None else self.names(pinned).where(F.col("name") == name)
            v = self.versions_table(pinned).join(names.select("object_id").distinct(), "object_id", "left_semi")
            gone = v.join(relops.newest(v, keep).select("object_id", "version"), ["object_id", "version"], "left_anti")
            n = gone.count()
            return ({"versions": self._rows(gone, lsn, False)} if n else {}), {"pruned": n}

        return self._change("prune", build)["pruned"]

    def _unbind(self, kind: str, hit: Column, drop_object: bool) -> int:
        def build(pinned, lsn):
            gone = self.names(pinned).where(hit)
            n = gone.count()
            if not n:
                return {}, {"names": 0}
            out = {"names": gone.select("name", F.lit(None).cast("string").alias("object_id"), F.lit(lsn).alias("lsn"))}
            if drop_object:
                ids = gone.select("object_id").distinct()
                out["objects"] = self._rows(self.state("objects", pinned).join(ids, "object_id", "left_semi"), lsn, False)
                out["versions"] = self._rows(self.versions_table(pinned).join(ids, "object_id", "left_semi"), lsn, False)
            return out, {"names": n}

        return self._change(kind, build)["names"]

    def delete(self, name: str) -> bool:
        """Drop a name with its object; only snapshots keep its history."""
        return self._unbind("delete", F.col("name") == name.strip(), True) > 0

    def delete_prefix(self, prefix: str) -> int:
        return self._unbind("delete_prefix", F.startswith("name", F.lit(prefix)), True)

    def unbind(self, name: str) -> bool:
        """Drop a name; the object and its history stay, reachable by id."""
        return self._unbind("unbind", F.col("name") == name.strip(), False) > 0

    def delete_object(self, object_id: str) -> bool:
        """Drop an object and its versions by id; a name that is bound to it dangles and is not listed."""

        def build(pinned, lsn):
            own = self.state("objects", pinned).where(F.col("object_id") == object_id)
            if not own.count():
                return {}, {"n": 0}
            versions = self.versions_table(pinned).where(F.col("object_id") == object_id)
            return {"objects": self._rows(own, lsn, False), "versions": self._rows(versions, lsn, False)}, {"n": 1}

        return self._change("delete_object", build)["n"] > 0

    def delete_manifest(self, manifest_id: str) -> bool:
        """Drop a manifest and its list of chunks by id; refused while a version or a snapshot needs it."""
        pinned = self.log.last()
        own = self.state("manifests", pinned)
        if not own.where(F.col("manifest_id") == manifest_id).count():
            return False
        if relops.live_manifests(self.versions_table(pinned), self._entries(pinned)).where(F.col("manifest_id") == manifest_id).count():
            raise Corrupt(f"manifest {manifest_id} is in use")
        other, files, actions = F.col("manifest_id") != manifest_id, self.log.files(pinned), []
        for t, df in (("manifests", own), ("manifest_chunks", self.events("manifest_chunks", pinned))):
            actions += [{"op": "remove", "table": t, "path": p} for p in files.get(t, [])] + [self._write(t, df.where(other))]
        self.log.commit(pinned + 1, "delete_manifest", actions, {"manifest": manifest_id})
        return True

    def rename(self, old: str, new: str) -> bool:
        return self.move([(old.strip(), new.strip())], whole=False) > 0

    def move(self, moves: list[tuple[str, str | None]], whole: bool = True) -> int:
        """Rename several names at once, with what lies below them if ``whole``; to None unbinds.

        All old names go before any new one comes, so swaps and chains are safe. Gives how many bindings changed.
        """
        for _, new in moves:
            if new is not None:
                why = self.spark.sql("select :n as n", args={"n": new}).select(paths.name_error("n")).first()[0]
                if why:
                    raise InvalidName(f"{new!r}: {why}")

        def build(pinned, lsn):
            n = F.col("name")
            to, hit = F.lit(None).cast("string"), F.lit(False)
            for old, new in moves:
                mine = paths.under("name", old) if whole else n == old
                hit = hit | mine
                if new is not None:
                    to = F.when(mine, paths.moved("name", old, new)).otherwise(to)
            gone = self.names(pinned).where(hit).withColumn("to", to)
            count = gone.count()
            if not count:
                return {}, {"moved": 0}
            came = gone.where("to is not null").select(F.col("to").alias("name"), "object_id")
            left = gone.select("name").join(came.select("name"), "name", "left_anti").select("name", F.lit(None).cast("string").alias("object_id"))
            return {"names": came.unionByName(left).withColumn("lsn", F.lit(lsn))}, {"moved": count}

        return self._change("move", build)["moved"]

    # Snapshots.

    def snapshot(self, label: str) -> int:
        """Freeze the latest version of each name; gives how many entries there are."""
        label = label.strip()
        if not label:
            raise InvalidName("a label is not empty")

        def build(pinned, lsn):
            if self.state("snapshots", pinned).where(F.col("label") == label).count():
                raise AlreadyExists(label)
            entries = relops.snapshot_entries(label, self.names(pinned), self.versions_table(pinned)).withColumn("lsn", F.lit(lsn))
            one = self.spark.range(1).select(F.lit(label).alias("label"), F.current_timestamp().alias("created_at"))
            return {"snapshots": self._rows(one, lsn), "snapshot_entries": entries}, {"label": label}

        self._change("snapshot", build)
        return self._entries().where(F.col("label") == label).count()

    def snapshots(self) -> DataFrame:
        counts = self._entries().groupBy("label").agg(F.count("*").alias("entries"))
        return self.state("snapshots").select("label", "created_at").join(counts, "label", "left").select("label", "created_at", F.coalesce("entries", F.lit(0)).alias("entries")).orderBy("created_at", "label")

    def snapshot_entries(self, label: str) -> DataFrame:
        return self._entries().where(F.col("label") == label.strip())

    def delete_snapshot(self, label: str) -> bool:
        def build(pinned, lsn):
            hit = self.state("snapshots", pinned).where(F.col("label") == label.strip())
            return ({"snapshots": self._rows(hit, lsn, False)}, {"n": 1}) if hit.count() else ({}, {"n": 0})

        return self._change("delete_snapshot", build)["n"] > 0

    def export(self, files: DataFrame, folder: str) -> DataFrame:
        """Write (name, manifest_id) below ``folder`` chunk by chunk; gives (name, bytes).

        No file is held whole. A file gets its name after its chunks and its whole were verified; a fault leaves none.
        """
        wanted = files.select("name", "manifest_id").distinct()
        refs = self.events("manifest_chunks").join(wanted, "manifest_id", "right").select("name", "manifest_id", "ordinal", "chunk_id")
        parts = refs.join(self.decoded(self.events("chunks")).select("chunk_id", "data", "hash_ok"), "chunk_id", "left")
        return sources.write_chunks(parts, folder)

    def restore(self, label: str, folder: str) -> int:
        """Write a snapshot's files below ``folder``; gives how many."""
        if not self.state("snapshots").where(F.col("label") == label.strip()).count():
            raise NotFound(label)
        return self.export(self.snapshot_entries(label), folder).count()

    def ingest(self, files: DataFrame, label: str | None = None) -> dict:
        """Store files and, with a label, freeze the result; gives totals."""
        out = self.put(files).agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).first().asDict()
        if label:
            out["entries"] = self.snapshot(label)
        return out

    # Garbage, checks, totals.

    def gc(self, grace: float = GRACE) -> dict:
        """Drop manifests and chunks that no object and no snapshot needs, and delete files that nothing has referred to for ``grace`` seconds.

        Only files with dead chunks are rewritten.
        """
        stats = self._sweep()
        return stats | self.vacuum(grace)

    def vacuum(self, grace: float = GRACE) -> dict:
        """Delete data folders that no commit of the last ``grace`` seconds refers to: what was swept, what a writer left behind, stale staging."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        data = jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        fs = data.getFileSystem(conf)
        if not fs.exists(data):
            return {"folders_deleted": 0, "bytes_deleted": 0}
        # Listed before the log is read: what a writer adds meanwhile is not in the list.
        found = [f for t in fs.listStatus(data) if t.isDirectory() for f in fs.listStatus(t.getPath())]
        cut = time.time() - grace
        keep = {p for files in self.log.files().values() for p in files}
        known: set[str] = set()
        for commit in self.log.commits():
            for a in commit["actions"]:
                known.add(a["path"])
                if a["op"] == "remove" and commit.get("at", 0) > cut:
                    keep.add(a["path"])
        folders = size = 0
        for f in found:
            path = "data/" + "/".join(str(f.getPath().toUri().getPath()).rsplit("/", 2)[1:])
            if path in keep or (path not in known and f.getModificationTime() / 1000 > cut):
                continue
            size += fs.getContentSummary(f.getPath()).getLength()
            fs.delete(f.getPath(), True)
            folders += 1
        return {"folders_deleted": folders, "bytes_deleted": size}

    def _sweep(self) -> dict:
        pinned = self.log.last()
        versions, entries = self.versions_table(pinned), self._entries(pinned)
        live = relops.live_manifests(versions, entries)
        lost = relops.missing(live, self.state("manifests", pinned), "manifest_id").limit(3).collect()
        if lost:
            raise Corrupt(f"manifests are missing, nothing was swept: {[r.manifest_id for r in lost]}")
        refs, chunks = self.events("manifest_chunks", pinned), self.events("chunks", pinned)
        reach = relops.reachable_chunks(live, refs)
        stats = relops.gc_stats(self.state("objects", pinned), self.state("snapshots", pinned), reach, chunks).first().asDict()
        dead_manifests = relops.missing(self.state("manifests", pinned).select("manifest_id"), live, "manifest_id").count()
        stats["manifests_reclaimed"] = dead_manifests
        if not stats["chunks_reclaimed"] and not dead_manifests:
            return stats
        files, actions, out = self.log.files(pinned), [], {}
        if stats["chunks_reclaimed"]:
            at = chunks.select("chunk_id", F.regexp_extract(F.input_file_name(), r"(data/chunks/[0-9a-f]+)/", 1).alias("path"))
            touched = {r.path for r in relops.missing(at, reach, "chunk_id").select("path").distinct().collect()}  # one row a folder
            actions += [{"op": "remove", "table": "chunks", "path": p} for p in touched]
            kept = self.spark.read.schema(SCHEMAS["chunks"]).parquet(*[f"{self.root}/{p}" for p in touched])
            out["chunks"] = kept.join(reach, "chunk_id", "left_semi")
        if dead_manifests:
            for t, df in (("manifests", self.state("manifests", pinned)), ("manifest_chunks", refs)):
                actions += [{"op": "remove", "table": t, "path": p} for p in files.get(t, [])]
                out[t] = df.join(live, "manifest_id", "left_semi")
        # A sweep is only valid for the state that it marked: no retry on a newer one.
        self.log.commit(pinned + 1, "gc", actions + [self._write(t, df) for t, df in out.items()], stats)
        return stats

    def fsck(self) -> dict:
        """Verify every stored chunk and every reference; missing and corrupt count once for each reference."""
        # The store is decoded once: references are counted by chunk first.
        checked = self.decoded(self.events("chunks")).select("chunk_id", "crc_ok", "hash_ok")
        refs = self.events("manifest_chunks").groupBy("chunk_id").agg(F.count("*").alias("refs"))
        n, stored = F.coalesce("refs", F.lit(0)), F.col("hash_ok").isNotNull()
        c = (
            checked.join(refs, "chunk_id", "full")
            .agg(
                F.count_if(stored).alias("chunks"), F.count_if(~F.col("hash_ok")).alias("corrupt"), F.count_if(~F.col("crc_ok")).alias("bad_crc"),
                F.coalesce(F.sum(F.when(~stored, n)), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(~F.col("hash_ok"), n)), F.lit(0)).alias("corrupt_refs"),
            )
            .first()
        )
        manifests = self.state("manifests")
        dangling = {t: relops.missing(df, manifests, "manifest_id").count() for t, df in (("versions", self.versions_table()), ("snapshot_entries", self._entries()))}
        out = {"chunks_checked": c.chunks, "corrupt_chunks": c.corrupt, "bad_crc": c.bad_crc, "missing_chunks": c.missing, "corrupt_references": c.corrupt_refs, "objects_checked": self.state("objects").count(), "manifests_checked": manifests.count(), "dangling": dangling}
        out["healthy"] = not (c.corrupt or c.missing or c.corrupt_refs or any(dangling.values()))
        return out

    def check_manifests(self) -> DataFrame:
        """(manifest_id, missing, corrupt): faulty references of each manifest that has some."""
        state = self.decoded(self.events("chunks")).select("chunk_id", "hash_ok")
        seen = self.events("manifest_chunks").select("manifest_id", "chunk_id").join(state, "chunk_id", "left")
        out = seen.groupBy("manifest_id").agg(F.count_if(F.col("hash_ok").isNull()).alias("missing"), F.count_if(~F.col("hash_ok")).alias("corrupt"))
        return out.where("missing + corrupt > 0")

    def stats(self) -> dict:
        """Totals, and the bytes that the chunks' payloads take."""
        payload = self.events("chunks").agg(F.coalesce(F.sum("payload_len"), F.lit(0)).cast("long")).first()[0]
        return relops.store_stats(self.names(), self.versions_table(), self.state("manifests"), self.state("snapshots"), self.events("chunks")).first().asDict() | {"payload_bytes": payload}

    def vfs(self) -> DataFrame:
        return relops.vfs_files(self.names(), self.versions_table(), self._entries())

    def optimize(self) -> None:
        """Write the state of the event tables anew, as one file set each."""
        pinned = self.log.last()
        files = self.log.files(pinned)
        out = {}
        for t in _KEYS:
            if len(files.get(t, [])) > 1:
                out[t] = self.state(t, pinned)
        actions = [{"op": "remove", "table": t, "path": p} for t in out for p in files[t]]
        if out:
            self.log.commit(pinned + 1, "optimize", actions + [self._write(t, df) for t, df in out.items()])

    # Shares, tracking, configuration.

    def _upsert(self, table: str, rows: list[tuple], columns: list[str], alive: bool = True) -> None:
        fields = {f.split()[0]: f for f in SCHEMAS[table].split(", ")}
        schema = ", ".join(fields[c] for c in columns)

        def build(pinned, lsn):
            df = self.spark.createDataFrame(rows, schema).withColumn("lsn", F.lit(lsn))
            return {table: df.withColumn("alive", F.lit(alive)) if "alive" in fields else df}, {}

        self._change(f"upsert {table}", build)

    def add_share(self, path: str, expires_at: int = 0) -> tuple[str, str]:
        """(id, token) of a new share; 0 never expires."""
        made = (uuid.uuid4().hex[:16], uuid.uuid4().hex[:16])
        self._upsert("shares", [(made[0], path, made[1], expires_at)], ["id", "path", "token", "expires_at"])
        return made

    def shares(self, now: int | None = None) -> DataFrame:
        return relops.live_shares(self.state("shares"), F.lit(int(time.time()) if now is None else now)).drop("alive", "lsn")

    def revoke_share(self, share: str) -> None:
        self._upsert("shares", [(share, "", "", 0)], ["id", "path", "token", "expires_at"], alive=False)

    def track(self, watch_root: str, names: list[str], on: bool = True) -> None:
        self._upsert("tracked_files", [(watch_root, n) for n in names], ["watch_root", "name"], on)

    def track_names(self, watch_root: str, names: DataFrame) -> None:
        """As :meth:`track`, for a table of names."""

        def build(pinned, lsn):
            return {"tracked_files": self._rows(names.select(F.lit(watch_root).alias("watch_root"), "name"), lsn)}, {}

        self._change("upsert tracked_files", build)

    def tracked(self, watch_root: str) -> DataFrame:
        return self.state("tracked_files").where(F.col("watch_root") == watch_root).select("watch_root", "name")

    def save_watch_config(self, watch_dir: str, debounce: int, cooldown: int, throttle_ms: int) -> None:
        self._upsert("watch_config", [(watch_dir, debounce, cooldown, throttle_ms)], ["watch_dir", "debounce_secs", "cooldown_secs", "throttle_ms"])

    def watch_config(self) -> tuple[str | None, int, int, int]:
        row = self.events("watch_config").orderBy(F.desc("lsn")).first()
        return (row.watch_dir, row.debounce_secs, row.cooldown_secs, row.throttle_ms) if row else (None, 3, 60, 10)
