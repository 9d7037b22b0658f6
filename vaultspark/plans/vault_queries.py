"""Queries over real vaults: the driver tables are put into a store, and the store's own operations give the rows.

Files are documents, named ``source/lang.txt``; a file's versions are its documents by doc_id. Stores lie in the shared
folder (``spark.checkpoint.dir``). Those that are only read are made once for each table set and session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions import paths, scalars
from vaultspark.operators import relops
from vaultspark.plans import views
from vaultspark.plans.catalogue import _HEADERS, query
from vaultspark.plans.vault import Vault
from vaultspark.plans.views import F_SQL
from vaultspark.streaming.service import WatchService
from vaultspark.streaming.watcher import WatchConfig

#: Small chunks, as the documents are small; files of up to the least size are one chunk, whose id is the file's.
SIZES = (512, 2048, 8192)
_made: dict[tuple, Vault] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; where none is set, on one machine, in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vaultspark-")
    return f"{root.rstrip('/')}/vaultspark/{name}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "documents")
    return t.select(F.concat("source", F.lit("/"), "lang", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("seq"))


def stored(spark: SparkSession, d: str, passphrase: str | None = None, halves: bool = False) -> Vault:
    """A new vault of all documents, in one put or, even ids first, in two with a snapshot after each."""
    v = Vault.open(spark, scratch(spark, "vault"), passphrase, SIZES)
    docs = documents(spark, d)
    if not halves:
        v.put(docs)
        return v
    for part, label in ((docs.where("seq % 2 = 0"), "one"), (docs.where("seq % 2 = 1"), "two")):
        v.put(part)
        v.snapshot(label)
    return v


def shared(spark: SparkSession, d: str, halves: bool = False) -> Vault:
    key = (spark.sparkContext.applicationId, d, halves)
    if key not in _made:
        _made[key] = stored(spark, d, halves=halves)
    return _made[key]


def _facts(spark: SparkSession, facts: dict) -> DataFrame:
    return spark.createDataFrame([(k, int(v)) for k, v in facts.items()], "fact string, value long")


@query("vault_put", F_SQL + "select name, max(version) as version, arg_max(manifest_id, version) as manifest_id, arg_max(size_bytes, version) as size_bytes from f group by name")
def _(spark, d):
    return stored(spark, d)._put_result(2).select("name", "version", "manifest_id", "size_bytes")


@query("vault_versions", F_SQL + "select name, version, manifest_id, size_bytes from f")
def _(spark, d):
    v = shared(spark, d)
    return v.names().join(v.versions_table(), "object_id").select("name", F.col("version").cast("long").alias("version"), "manifest_id", "size_bytes")


@query("vault_contents", "select distinct sha256(text) as manifest_id, octet_length(encode(text)) as n, sha256(text) as hash from documents")
def _(spark, d):
    v = shared(spark, d)
    return v.contents(v.state("manifests")).select("manifest_id", F.octet_length("content").cast("long").alias("n"), F.sha2("content", 256).alias("hash"))


@query("vault_encrypted", "select distinct sha256(text) as manifest_id, octet_length(encode(text)) as n, 'gcm' as scheme from documents where octet_length(encode(text)) > 0")
def _(spark, d):
    made = stored(spark, d, "a long passphrase")
    v = Vault.open(spark, made.root, "a long passphrase", SIZES)
    whole = v.contents(v.state("manifests")).select("manifest_id", F.octet_length("content").cast("long").alias("n"))
    schemes = v.events("manifest_chunks").select("manifest_id", "chunk_id").join(v.events("chunks").select("chunk_id", "scheme"), "chunk_id").groupBy("manifest_id").agg(F.array_join(F.collect_set("scheme"), ",").alias("scheme"))
    return whole.join(schemes, "manifest_id")


_LAST = ", l as (select name, arg_max(doc_id, version) as doc_id from f group by 1), t as (select l.name, text, octet_length(encode(text)) as n, hex(encode(text)) as x from l join documents using (doc_id))"


@query("vault_read_ranges", F_SQL + _LAST + ", r as (select *, k * 700 as a from t, (values (0), (1), (5)) v(k)) select name, a::bigint as \"offset\", 1500::bigint as size, lower(substr(x, 2 * a + 1, 3000)) as bytes from r")
def _(spark, d):
    v = shared(spark, d)
    req = v.names().select("name", F.explode(F.array(*[F.lit(k * 700) for k in (0, 1, 5)])).alias("offset"), F.lit(1500).alias("size"))
    return v.read_ranges(req).select("name", "offset", "size", F.lower(F.hex("bytes")).alias("bytes"))


@query(
    "vault_range_get",
    F_SQL + _LAST + ", h as (select name, n, x, unnest(" + repr(_HEADERS) + ") as h from t), p as (select *, try_cast(regexp_extract(h, '^bytes=(\\d*)-(\\d*)$', 1) as bigint) as a, try_cast(regexp_extract(h, '^bytes=(\\d*)-(\\d*)$', 2) as bigint) as b from h), g as (select *, case when a is null and b is null then null when n = 0 then 0 when a is null then greatest(n - b, 0) when a >= n or b < a then null else a end as s, case when a is null and b is null then null when n = 0 then 0 when a is null then least(b, n) when a >= n or b < a then null else least(coalesce(b, n - 1), n - 1) - a + 1 end as k from p) select name, h as header, case when s is null then 416 else 206 end as status, case when s is not null then lower(substr(x, 2 * s + 1, 2 * k)) end as body from g",
)
def _(spark, d):
    v = shared(spark, d)
    files = v.list_files().select("name", "size_bytes", F.explode(F.array(*map(F.lit, _HEADERS))).alias("header"))
    r = scalars.parse_range("header", "size_bytes")
    asked = files.select("name", "header", r["start"].alias("offset"), r["len"].alias("size"))
    got = v.read_ranges(asked.where("offset is not null").select("name", "offset", "size"))
    out = asked.join(got, ["name", "offset", "size"], "left")
    return out.select("name", "header", F.when(F.col("offset").isNull(), 416).otherwise(206).alias("status"), F.lower(F.hex("bytes")).alias("body"))


@query("vault_list_dangling", F_SQL + ", l as (select name, count(*) as n, arg_max(manifest_id, version) as m from f group by 1) select name, case when starts_with(name, 'src2/') then 0 else n end as latest_version, case when not starts_with(name, 'src2/') then m end as manifest_id from l where not starts_with(name, 'src1/')")
def _(spark, d):
    # One folder's objects are gone, another's have no versions left.
    v, f = shared(spark, d), F.col("name")
    known = v.names().where(~F.startswith(f, F.lit("src1/")))
    kept = v.versions_table().join(known.where(~F.startswith(f, F.lit("src2/"))).select("object_id"), "object_id", "left_semi")
    return relops.list_files(v.names(), kept, known).select("name", F.col("latest_version").cast("long").alias("latest_version"), "manifest_id")


_HALVES = ", g as (select *, row_number() over (partition by name order by doc_id % 2, doc_id) as v from f)"


@query("vault_snapshots", F_SQL + _HALVES + "select 'one' as label, name, max(v) as version, arg_max(manifest_id, v) as manifest_id from g where doc_id % 2 = 0 group by name union all select 'two', name, max(v), arg_max(manifest_id, v) from g group by name")
def _(spark, d):
    v = stored(spark, d, halves=True)
    v.snapshot("three")
    v.delete_snapshot("three")
    every = v.snapshot_entries("one").unionByName(v.snapshot_entries("two")).unionByName(v.snapshot_entries("three"))
    return every.select("label", "name", F.col("version").cast("long").alias("version"), "manifest_id")


@query("vault_snapshot_list", F_SQL + "select 'one' as label, count(distinct name) as entries from f where doc_id % 2 = 0 union all select 'two', count(distinct name) from f")
def _(spark, d):
    return shared(spark, d, halves=True).snapshots().select("label", "entries")


@query("vault_restore", F_SQL + ", e as (select name, arg_max(manifest_id, doc_id) as m, arg_max(size_bytes, doc_id) as n from f where doc_id % 2 = 0 group by 1) select name, n as size, m as hash from e")
def _(spark, d):
    folder = scratch(spark, "restored")
    shared(spark, d, halves=True).restore("one", folder)
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return got.select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


@query("vault_delete_gc", F_SQL + ", k as (select * from f where not starts_with(name, 'src1')) select 'names' as fact, count(distinct name) as value from k union all select 'versions', count(*) from k union all select 'manifests', count(distinct manifest_id) from k union all select 'reclaimed', (select count(distinct manifest_id) from f) - (select count(distinct manifest_id) from k) union all select 'healthy', 1 union all select 'fewer_bytes', 1")
def _(spark, d):
    from vaultspark.sources.files import physical_bytes

    v = stored(spark, d)
    before = physical_bytes(spark, f"{v.root}/data")
    v.delete_prefix("src1")
    swept = v.gc(grace=0)
    return _facts(spark, {"names": v.names().count(), "versions": v.versions_table().count(), "manifests": v.state("manifests").count(), "reclaimed": swept["manifests_reclaimed"], "healthy": v.fsck()["healthy"], "fewer_bytes": physical_bytes(spark, f"{v.root}/data") < before})


@query("vault_unbind_delete", F_SQL + "select name, case when ends_with(name, '/en.txt') then 'unbound' when starts_with(name, 'src2/') then 'deleted' else 'bound' end as fate, case when starts_with(name, 'src2/') and not ends_with(name, '/en.txt') then 0 else count(*) end as versions from f group by name")
def _(spark, d):
    v = stored(spark, d)
    first = v.names()
    v.move([(r.name, None) for r in first.where(F.endswith("name", F.lit("/en.txt"))).collect()], whole=False)
    v.delete_prefix("src2/")
    v.gc(grace=0)
    left = v.versions_table().groupBy("object_id").agg(F.count("*").alias("versions"))
    bound = v.names().select("object_id", F.lit(True).alias("bound"))
    out = first.join(left, "object_id", "left").join(bound, "object_id", "left")
    fate = F.when(F.col("bound"), "bound").when(F.col("versions").isNotNull(), "unbound").otherwise("deleted")
    return out.select("name", fate.alias("fate"), F.coalesce("versions", F.lit(0)).alias("versions"))


@query("vault_delete_by_id", F_SQL + ", k as (select * from f where not ends_with(name, '/fr.txt')) select 'listed' as fact, count(distinct name) as value from k union all select 'manifests', count(distinct manifest_id) from k union all select 'refused', 1")
def _(spark, d):
    from vaultspark.functions.errors import Corrupt

    v = stored(spark, d)
    used = v.names().where(F.endswith("name", F.lit("/en.txt"))).join(v.versions_table(), "object_id").orderBy("manifest_id").first().manifest_id
    for r in v.names().where(F.endswith("name", F.lit("/fr.txt"))).collect():
        v.delete_object(r.object_id)
    try:
        refused = v.delete_manifest(used) and False
    except Corrupt:
        refused = True
    dead = relops.missing(v.state("manifests").select("manifest_id"), relops.live_manifests(v.versions_table(), v._entries()), "manifest_id").orderBy("manifest_id").first()
    if dead:
        v.delete_manifest(dead.manifest_id)
    v.gc(grace=0)
    return _facts(spark, {"listed": v.list_files().count(), "manifests": v.state("manifests").count(), "refused": refused})


@query("vault_fsck", f"with m as (select distinct sha256(text) as manifest_id, octet_length(encode(text)) as n from documents) select manifest_id, case when manifest_id like 'f%' then 1 else 0 end as missing, case when manifest_id < '4' then 1 else 0 end as corrupt from m where n between 1 and {SIZES[0]} and (manifest_id like 'f%' or manifest_id < '4')")
def _(spark, d):
    # Chunks that are a whole small file, and so have its id, are damaged: some lost, some with another payload.
    v = stored(spark, d)
    small = v.state("manifests").where(F.col("total_size") <= SIZES[0]).select(F.col("manifest_id").alias("chunk_id"), F.lit(True).alias("small"))
    chunks = v.events("chunks").join(small, "chunk_id", "left")
    chunks = chunks.where("not (coalesce(small, false) and chunk_id like 'f%')")
    hit = F.coalesce("small", F.lit(False)) & (F.col("chunk_id") < "4")
    bad = chunks.withColumn("payload", F.when(hit, F.concat(F.lit(b"?"), F.substr("payload", F.lit(2)))).otherwise(F.col("payload"))).drop("small")
    old = [{"op": "remove", "table": "chunks", "path": p} for p in v.log.files()["chunks"]]
    v.log.commit(v.log.last() + 1, "damage", [*old, v._write("chunks", bad)])
    whole = v.state("manifests").where(F.col("total_size") <= SIZES[0]).select("manifest_id")
    return v.check_manifests().join(whole, "manifest_id", "left_semi")


@query("vault_replay", F_SQL + ", b as (select doc_id % 3 as k, name from f), n as (select name, min(k) as k from b group by 1) select (2 + i)::bigint as lsn, (select count(*) from n where k <= i) as names, (select count(*) from b where k <= i) as versions from range(3) r(i)")
def _(spark, d):
    # Three puts of a third each; a store opened anew replays its log up to each commit.
    v = Vault.open(spark, scratch(spark, "vault"), None, SIZES)
    for k in range(3):
        v.put(documents(spark, d).where(F.col("seq") % 3 == k))
    again, out = Vault.open(spark, v.root, None, SIZES), None
    for lsn in range(2, 5):
        n = again.names(lsn).agg(F.count("*").alias("names")).crossJoin(again.versions_table(lsn).agg(F.count("*").alias("versions"))).select(F.lit(lsn).cast("long").alias("lsn"), "names", "versions")
        out = n if out is None else out.unionByName(n)
    return out


@query("vault_stats", F_SQL + ", l as (select name, arg_max(size_bytes, version) as s from f group by 1) select 'objects' as fact, count(*) as value from l union all select 'manifests', count(distinct manifest_id) from f union all select 'logical_bytes', sum(size_bytes)::bigint from f union all select 'latest_logical_bytes', sum(s)::bigint from l union all select 'payload_below_raw', 1 union all select 'raw_below_logical', 1")
def _(spark, d):
    s = shared(spark, d).stats()
    return _facts(spark, {k: s[k] for k in ("objects", "manifests", "logical_bytes", "latest_logical_bytes")} | {"payload_below_raw": 0 < s["payload_bytes"] < s["unique_chunks_bytes"], "raw_below_logical": s["unique_chunks_bytes"] < s["logical_bytes"]})


@query("vault_prune_total", F_SQL + ", c as (select name, count(*) as n from f group by 1) select sum(greatest(n - 2, 0))::bigint as pruned, sum(least(n, 2))::bigint as kept from c")
def _(spark, d):
    v = stored(spark, d)
    pruned = v.prune(2)
    return v.versions_table().agg(F.lit(pruned).cast("long").alias("pruned"), F.count("*").alias("kept"))


@query("vault_rollback", F_SQL + ", c as (select name, count(*) + 1 as version, arg_min(manifest_id, version) as manifest_id from f where starts_with(name, 'src3/') group by 1) select * from c")
def _(spark, d):
    v = stored(spark, d)
    hit = v.names().where(F.startswith("name", F.lit("src3/")))
    for r in hit.collect():
        v.rollback(r.name, 1)
    return relops.latest(v.versions_table()).join(hit, "object_id").select("name", F.col("version").cast("long").alias("version"), "manifest_id")


# Folders, shares and the watcher.


@query("share_files", F_SQL + ", l as (select name, arg_max(size_bytes, version) as size_bytes from f group by 1), s as (select conv_id as id, case conv_id % 3 when 0 then 'src' || (conv_id % 7) || '/' when 1 then 'src1/en.txt' else 'none/x' end as path from (select distinct conv_id from conversations)) select id, name, size_bytes from s join l on name = rtrim(path, '/') or starts_with(name, rtrim(path, '/') || '/')")
def _(spark, d):
    k = F.col("id") % 3
    path = F.when(k == 0, F.concat(F.lit("src"), (F.col("id") % 7).cast("string"), F.lit("/"))).when(k == 1, "src1/en.txt").otherwise("none/x")
    shares = views.table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct().withColumn("path", path)
    return relops.share_files(shares, relops.list_files(views.names(spark, d), views.files(spark, d)))


def _tree(spark, d):
    f = relops.latest(views.files(spark, d), "name")
    return f.select(F.concat(F.lit("/current/"), "name").alias("path"), F.lit("file").alias("kind"), F.col("size_bytes").alias("size"), F.col("doc_id").alias("mtime"))


@query("vfs_readdir_page", "with n as (select distinct source as name from documents), e as (select 0 as k, '.' as name union all select 1, '..' union all select 2, name from n), p as (select row_number() over (order by k, name) as position, name from e) select position, name, 'dir' as kind from p where position between 2 and 6")
def _(spark, d):
    return relops.readdir_page(_tree(spark, d), "/current", 1, 5).select(F.col("position").cast("long").alias("position"), "name", "kind")


_ENTRY = "'  <D:response>' || chr(10) || '    <D:href>' || href || '</D:href>' || chr(10) || '    <D:propstat>' || chr(10) || '      <D:prop>' || chr(10) || '        <D:displayname>' || name || '</D:displayname>' || chr(10) || case when size is null then '        <D:resourcetype><D:collection/></D:resourcetype>' || chr(10) else '        <D:resourcetype/>' || chr(10) || '        <D:getcontentlength>' || size || '</D:getcontentlength>' || chr(10) || '        <D:getcontenttype>application/octet-stream</D:getcontenttype>' || chr(10) end || '        <D:getlastmodified>' || strftime(to_timestamp(mtime) at time zone 'UTC', '%a, %d %b %Y %H:%M:%S GMT') || '</D:getlastmodified>' || chr(10) || '      </D:prop>' || chr(10) || '      <D:status>HTTP/1.1 200 OK</D:status>' || chr(10) || '    </D:propstat>' || chr(10) || '  </D:response>' || chr(10)"


@query("vfs_propfind", F_SQL + ", l as (select name, arg_max(size_bytes, version) as size, max(doc_id) as mtime from f where starts_with(name, 'src1/') group by 1), e as (select '/current/' || name as href, split_part(name, '/', 2) as name, size, mtime from l union all select '/current/src1/', 'src1', null, min(mtime) from l) select href, " + _ENTRY + " as xml from e")
def _(spark, d):
    return relops.propfind(_tree(spark, d), "/current/src1/")


@query("search_names", F_SQL + "select distinct name from f where contains(lower(name), 'c1/e')")
def _(spark, d):
    return views.names(spark, d).where(paths.found("name", " C1/E ")).select("name")


_U = "with u as (select page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) as p from pages) "


@query("root_overlap", _U + "select page_id, page_id % 3 <> 2 or p = '' or ends_with(p, '/') as overlaps from u")
def _(spark, d):
    t = views.table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("p"))
    k, p = F.col("page_id") % 3, F.concat(F.lit("/w/"), "p")
    other = F.when(k == 0, F.concat(p, F.lit("/store/"))).when(k == 1, "/w").otherwise(F.concat(p, F.lit("-store")))
    return t.select("page_id", paths.overlaps(p, other).alias("overlaps"))


@query("payload_overflow", "select doc_id, octet_length(encode(text)) + (case doc_id % 3 when 0 then 9223372036854775807 when 1 then 9223372036854775807 - octet_length(encode(text)) else 0 end)::hugeint <= 9223372036854775807 as fits from documents")
def _(spark, d):
    n, top = F.octet_length("text").cast("long"), F.lit(2**63 - 1).cast("long")
    k = F.col("doc_id") % 3
    return views.table(spark, d, "documents").select("doc_id", scalars.fits(n, F.when(k == 0, top).when(k == 1, top - n).otherwise(F.lit(0))).alias("fits"))


@query("watcher_last_error", "with e as (select 'r' || (user_id % 16) as watch_root, 'p' || user_id as key, event_id from events where event_type = 'error') select watch_root, arg_min('failed ' || event_id, (key, 'failed ' || event_id)) as last_error from e group by 1")
def _(spark, d):
    e = views.table(spark, d, "events").where("event_type = 'error'")
    e = e.select(F.concat(F.lit("r"), (F.col("user_id") % 16).cast("string")).alias("watch_root"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("key"), F.concat(F.lit("failed "), F.col("event_id").cast("string")).alias("message"))
    return relops.first_errors(e)


@query("watcher_service", "with n as (select count(distinct source || lang) as n, count(distinct source || lang) filter (lang = 'de') as g from documents) select 'scanned' as fact, 2 * n - g as value from n union all select 'saved', n + (n - g) from n union all select 'removed', g from n union all select 'versions', n + (n - g) from n union all select 'watching', 1")
def _(spark, d):
    """A folder of the latest documents is scanned, rewritten without one language, and scanned again."""
    from vaultspark.sources.files import extract

    folder = scratch(spark, "watched")
    latest = relops.latest(documents(spark, d).withColumnRenamed("seq", "version"), "name").select("name", "content")
    extract(latest, folder).count()
    v = Vault.open(spark, scratch(spark, "vault"), None, SIZES)
    service = WatchService(v, folder, WatchConfig.asked(1, 1, 0))
    service.scan_once()
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in latest.where(F.endswith("name", F.lit("/de.txt"))).select("name").collect():
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{r.name}"), False)
    extract(latest.where(~F.endswith("name", F.lit("/de.txt"))).withColumn("content", F.concat("content", F.lit(b"!"))), folder).count()
    service.scan_once()
    s = service.status()
    return _facts(spark, {"scanned": s.scanned_files, "saved": s.saved_files, "removed": s.removed_files, "versions": v.versions_table().count(), "watching": s.phase == "watching"})
