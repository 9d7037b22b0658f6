"""The vault's queries over the driver tables, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vaultspark.functions import cdc, codecs, paths, scalars
from vaultspark.operators import relops
from vaultspark.plans import views
from vaultspark.plans.views import C_SQL, F_SQL, M_SQL
from vaultspark.streaming import watcher

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


# Versions and names over documents as files.


@query("list_files_latest", F_SQL + "select name, max(version) as latest_version, arg_max(size_bytes, version) as size_bytes, arg_max(manifest_id, version) as manifest_id from f group by name")
def _(spark: SparkSession, d: str) -> DataFrame:
    return relops.list_files(views.names(spark, d), views.files(spark, d)).select("name", "latest_version", "size_bytes", "manifest_id")


@query("list_versions", C_SQL + "select object_id, version, size_bytes, manifest_id from c")
def _(spark, d):
    return views.conversations(spark, d).select("object_id", "version", "size_bytes", "manifest_id")


@query("version_lookup", C_SQL + "select object_id, version, manifest_id from c where version = 2")
def _(spark, d):
    return views.conversations(spark, d).where("version = 2").select("object_id", "version", "manifest_id")


@query("next_version_numbers", F_SQL + ", n as (select name, doc_id, row_number() over (partition by name order by doc_id) + (select max(version) from f g where g.name = f.name) as version from f) select name, doc_id, version from n")
def _(spark, d):
    f = views.files(spark, d)
    known = f.groupBy("name").agg(F.max("version").alias("latest_version"))
    return relops.number_versions(f.select("name", "doc_id"), known, "name", "doc_id").select("name", "doc_id", "version")


@query("last3_versions", C_SQL + "select object_id, version, size_bytes from c qualify row_number() over (partition by object_id order by version desc) <= 3")
def _(spark, d):
    return relops.newest(views.conversations(spark, d), 3).select("object_id", "version", "size_bytes")


@query("prune_keep_n", F_SQL + "select name, version, manifest_id from f qualify row_number() over (partition by name order by version desc) <= 2")
def _(spark, d):
    return relops.newest(views.files(spark, d), 2, "name").select("name", "version", "manifest_id")


@query("prune_counts", F_SQL + "select name, greatest(count(*) - 2, 0) as pruned from f group by name")
def _(spark, d):
    return relops.prune_counts(views.files(spark, d), 2, "name")


@query("rollback_append", C_SQL + ", m as (select object_id, max(version) + 1 as n from c group by 1) select c.object_id, m.n as version, c.manifest_id from c join m using (object_id) where c.version = 1")
def _(spark, d):
    return relops.rollback(views.conversations(spark, d), F.lit(1)).select("object_id", "version", "manifest_id")


@query("rename_overwrite", F_SQL + "select distinct case when name = 'src0/en.txt' then 'src1/en.txt' else name end as name, name as object_id from f where name <> 'src1/en.txt'")
def _(spark, d):
    return relops.rename(views.names(spark, d), "src0/en.txt", "src1/en.txt")


@query("move_prefix_boundary", F_SQL + ", n as (select distinct name from f) select case when starts_with(name, 'src1/') then 'moved/deep' || substr(name, 5) else name end as name, name as object_id from n")
def _(spark, d):
    return relops.move_prefix(views.names(spark, d), "src1", "moved/deep")


@query("delete_prefix_raw", F_SQL + "select distinct name from f where not starts_with(name, 'src1')")
def _(spark, d):
    return views.names(spark, d).where(~F.startswith("name", F.lit("src1"))).select("name")


@query("folder_totals", F_SQL + ", l as (select name, arg_max(size_bytes, version) as s from f group by 1) select count(*) as files, sum(s)::bigint as bytes from l where starts_with(name, 'src2/')")
def _(spark, d):
    l = relops.list_files(views.names(spark, d), views.files(spark, d)).where(paths.in_folder("name", "\\src2\\"))
    return l.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query("unbind_vs_delete", M_SQL + "select label, count(*) filter (bound) as bound, count(*) filter (not bound) as unbound, count(*) as kept_by_unbind, count(*) filter (bound) as kept_by_delete from objects group by label")
def _(spark, d):
    o = views.objects(spark, d)
    return o.groupBy("label").agg(F.count_if("bound").alias("bound"), F.count_if(~F.col("bound")).alias("unbound"), F.count("*").alias("kept_by_unbind"), F.count_if("bound").alias("kept_by_delete"))


@query("bind_upsert", F_SQL + "select distinct name, case when ends_with(name, '/en.txt') then 'new' else name end as object_id from f")
def _(spark, d):
    n = views.names(spark, d)
    return relops.bind(n, n.where(F.endswith("name", F.lit("/en.txt"))).withColumn("object_id", F.lit("new")))


@query("snapshot_entries", F_SQL + "select 'nightly' as label, name, max(version) as version, arg_max(manifest_id, version) as manifest_id, arg_max(size_bytes, version) as size_bytes from f group by name")
def _(spark, d):
    return relops.snapshot_entries(" nightly ", views.names(spark, d), views.files(spark, d)).select("label", "name", "version", "manifest_id", "size_bytes")


@query("snapshot_list_sorted", M_SQL + "select label, count(*) as entries, row_number() over (order by min(object_id), label) as position from objects where bound group by label")
def _(spark, d):
    s = views.objects(spark, d).where("bound").groupBy("label").agg(F.count("*").alias("entries"), F.min("object_id").alias("at"))
    return s.select("label", "entries", F.row_number().over(W.orderBy("at", "label")).alias("position"))


@query("snapshot_diff", F_SQL + ", a as (select name, arg_max(manifest_id, version) as m from f where doc_id % 2 = 0 group by 1), b as (select name, arg_max(manifest_id, version) as m from f where name not like 'src3/%' group by 1) select coalesce(a.name, b.name) as name, case when a.m is null then 'added' when b.m is null then 'removed' else 'changed' end as change from a full join b on a.name = b.name where a.m is distinct from b.m")
def _(spark, d):
    f = views.files(spark, d)
    return relops.snapshot_diff(relops.latest(f.where("doc_id % 2 = 0"), "name"), relops.latest(f.where("name not like 'src3/%'"), "name"))


@query("resolve_targets", F_SQL + ", l as (select name, arg_max(manifest_id, version) as m from f group by 1), t as (select distinct name as t from f union select distinct manifest_id from f union select 'nothing') select t.t as target, coalesce(l.m, case when x.manifest_id is not null then t.t end) as manifest_id, case when l.m is not null then 'name' when x.manifest_id is not null then 'manifest' end as via from t left join l on l.name = t.t left join (select distinct manifest_id from f) x on x.manifest_id = t.t")
def _(spark, d):
    f = views.files(spark, d)
    t = f.select(F.col("name").alias("target")).union(f.select("manifest_id")).union(spark.sql("select 'nothing'")).distinct()
    return relops.resolve(t, views.names(spark, d), f, f.select("manifest_id"))


# Chunks: orders as manifests, parts as chunks.


@query("manifest_expand", M_SQL + "select o.label, count(*) as refs, count(distinct chunk_id) as chunks from objects o join mc using (manifest_id) group by 1")
def _(spark, d):
    j = views.objects(spark, d).select("label", "manifest_id").join(views.chunk_refs(spark, d), "manifest_id")
    return j.groupBy("label").agg(F.count("*").alias("refs"), F.count_distinct("chunk_id").alias("chunks"))


@query("manifest_offsets", M_SQL + "select manifest_id, ordinal, coalesce(sum(raw_len) over (partition by manifest_id order by ordinal rows between unbounded preceding and 1 preceding), 0)::bigint as start_offset from mc")
def _(spark, d):
    return relops.with_offsets(views.manifest_chunks(spark, d)).select("manifest_id", "ordinal", "start_offset")


@query("range_read_slices", M_SQL + ", o as (select *, coalesce(sum(raw_len) over (partition by manifest_id order by ordinal rows between unbounded preceding and 1 preceding), 0)::bigint as s from mc), r as (select o_orderkey as manifest_id, o_orderkey % 20 as off, 25 as size from orders) select manifest_id, ordinal, greatest(off - s, 0) as from_byte, least(raw_len, off + size - s) - greatest(off - s, 0) as n_bytes from o join r using (manifest_id) where s + raw_len > off and s < off + size")
def _(spark, d):
    req = views.objects(spark, d).select("manifest_id", (F.col("manifest_id") % 20).alias("offset"), F.lit(25).cast("long").alias("size"))
    return relops.range_slices(relops.with_offsets(views.manifest_chunks(spark, d)), req).select("manifest_id", "ordinal", "from_byte", "n_bytes")


@query("dedup_new_chunks", M_SQL + "select distinct chunk_id from mc where chunk_id not in (select chunk_id from chunks where chunk_id % 3 = 0)")
def _(spark, d):
    return relops.new_chunks(views.chunk_refs(spark, d), views.chunks(spark, d).where("chunk_id % 3 = 0")).select("chunk_id")


@query("put_summary", M_SQL + ", x as (select *, row_number() over (partition by chunk_id order by manifest_id, ordinal) = 1 and chunk_id % 3 <> 0 as fresh from mc) select manifest_id, count(*) as chunk_count, count(*) filter (fresh) as new_chunks, count(*) filter (not fresh) as dedup_chunks, sum(raw_len)::bigint as total_bytes from x group by 1")
def _(spark, d):
    return relops.put_summary(views.manifest_chunks(spark, d), views.chunks(spark, d).where("chunk_id % 3 = 0"), "manifest_id", ["manifest_id", "ordinal"])


@query("file_dedup_by_hash", F_SQL + "select manifest_id, count(*) as copies, min(doc_id) as first_doc from f group by 1")
def _(spark, d):
    t = views.table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("manifest_id"))
    return t.groupBy("manifest_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def _live(spark, d):
    """Versions of bound objects only, and snapshots of the urgent orders: the rest is garbage."""
    o = views.objects(spark, d)
    return o.where("bound"), o.where("label = '1-URGENT' and object_id % 7 = 0")


def _few_live(spark, d):
    """A store of which little is left, the dearest open orders, so that there are chunks without a reference."""
    o = views.objects(spark, d).where("status = 'P' and price > 400000")
    return o, o.where("label = '1-URGENT'")


_LIVE = ", live as (select manifest_id from objects where bound union select manifest_id from objects where label = '1-URGENT' and object_id % 7 = 0), reach as (select distinct chunk_id from mc where manifest_id in (select manifest_id from live))"


@query("gc_reachable", M_SQL + _LIVE + " select chunk_id from reach")
def _(spark, d):
    v, s = _live(spark, d)
    return relops.reachable_chunks(relops.live_manifests(v, s), views.chunk_refs(spark, d))


@query("gc_sweep_chunks", M_SQL + ", reach as (select distinct chunk_id from mc where manifest_id in (select o_orderkey from orders where o_orderstatus = 'P' and o_totalprice > 400000)) select chunk_id, raw_len from chunks where chunk_id not in (select chunk_id from reach)")
def _(spark, d):
    v, s = _few_live(spark, d)
    return relops.missing(views.chunks(spark, d), relops.reachable_chunks(relops.live_manifests(v, s), views.chunk_refs(spark, d)), "chunk_id").select("chunk_id", "raw_len")


@query("gc_sweep_manifests", M_SQL + _LIVE + " select manifest_id from objects where manifest_id not in (select manifest_id from live)")
def _(spark, d):
    v, s = _live(spark, d)
    return relops.missing(views.objects(spark, d).select("manifest_id"), relops.live_manifests(v, s), "manifest_id")


@query("gc_stats", M_SQL + _LIVE + " select (select count(*) from objects where bound) + (select count(distinct label) from objects) as live_roots, (select count(*) from reach) as reachable_chunks, (select count(*) from chunks where chunk_id in (select chunk_id from reach)) as chunks_retained, (select count(*) from chunks where chunk_id not in (select chunk_id from reach)) as chunks_reclaimed")
def _(spark, d):
    v, s = _live(spark, d)
    reach = relops.reachable_chunks(relops.live_manifests(v, s), views.chunk_refs(spark, d))
    return relops.gc_stats(v, views.objects(spark, d).select("label"), reach, views.chunks(spark, d))


@query("fsck_missing_refs", M_SQL + ", k as (select * from chunks where chunk_id % 11 <> 0) select manifest_id, count(*) as missing from mc where chunk_id not in (select chunk_id from k) group by 1")
def _(spark, d):
    lost = relops.missing(views.chunk_refs(spark, d), views.chunks(spark, d).where("chunk_id % 11 <> 0"), "chunk_id")
    return lost.groupBy("manifest_id").agg(F.count("*").alias("missing"))


@query("fsck_hash_mismatch", "select doc_id, sha256(text) as stored, sha256(text || 'x') as found from documents where doc_id % 10 = 3")
def _(spark, d):
    t = views.table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("stored"), F.concat("text", F.when(F.col("doc_id") % 10 == 3, "x").otherwise("")).alias("bytes"))
    return t.withColumn("found", F.sha2(F.col("bytes").cast("binary"), 256)).where("found <> stored").select("doc_id", "stored", "found")


@query("wal_replay_idempotent", "with e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as version from events) select user_id, version, event_id from e")
def _(spark, d):
    e = views.table(spark, d, "events").select("user_id", "event_id")
    log = e.withColumn("version", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    # Half of the log is applied already; replaying all of it adds only what is not there.
    done = log.where("event_id % 2 = 0")
    again = log.join(done.select("user_id", "version"), ["user_id", "version"], "left_anti")
    return done.unionByName(again).select("user_id", "version", "event_id")


@query("recovery_missing_chunks", M_SQL + "select distinct manifest_id from mc where chunk_id not in (select chunk_id from chunks where raw_len > 5)")
def _(spark, d):
    return relops.missing(views.chunk_refs(spark, d), views.chunks(spark, d).where("raw_len > 5"), "chunk_id").select("manifest_id").distinct()


@query(
    "store_stats",
    M_SQL + ", sz as (select o.object_id, o.bound, coalesce(sum(mc.raw_len), 0) as s from objects o left join mc using (manifest_id) group by 1, 2), t as (select (select count(*) from objects where bound) as objects, (select count(*) from objects) as manifests, (select count(distinct label) from objects) as snapshots, (select count(*) from chunks) as chunks, (select sum(raw_len)::bigint from chunks) as u, (select sum(s)::bigint from sz where bound) as n) select objects, manifests, snapshots, chunks, u as unique_chunks_bytes, n as logical_bytes, n as latest_logical_bytes, round(n / u, 6) as dedup_ratio, round(case when n <= u then 0 else (n - u) / n * 100 end, 6) as space_savings_pct from t",
)
def _(spark, d):
    o = views.objects(spark, d)
    size = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("manifest_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("size_bytes"))
    v = o.join(size, "manifest_id", "left").select("object_id", F.lit(1).alias("version"), "manifest_id", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"))
    s = relops.store_stats(o.where("bound"), v, o, o.select("label").distinct(), views.chunks(spark, d))
    return s.withColumns({"dedup_ratio": F.round("dedup_ratio", 6), "space_savings_pct": F.round("space_savings_pct", 6)})


@query("shared_chunks_pair", M_SQL + ", a as (select chunk_id from mc join objects using (manifest_id) where label = '1-URGENT'), b as (select chunk_id from mc join objects using (manifest_id) where label = '5-LOW') select chunk_id, 'shared' as side from (select chunk_id from a intersect select chunk_id from b) union all select chunk_id, 'first' from (select chunk_id from a except select chunk_id from b)")
def _(spark, d):
    j = views.objects(spark, d).join(views.chunk_refs(spark, d), "manifest_id")
    a, b = (j.where(F.col("label") == x).select("chunk_id") for x in ("1-URGENT", "5-LOW"))
    return a.intersect(b).withColumn("side", F.lit("shared")).union(a.subtract(b).withColumn("side", F.lit("first")))


# The file system's views.

_CURRENT = "select '/current/' || name as path, 'file' as kind, arg_max(size_bytes, version) as size from f group by name"
_HISTORY = "select '/history/' || name || '@v' || version as path, 'file' as kind, size_bytes as size, null::varchar as symlink_target from f union all select '/history/' || name || '@latest', 'symlink', octet_length(encode(split_part(name, '/', -1) || '@v' || max(version))), split_part(name, '/', -1) || '@v' || max(version) from f group by name"


def _entries(spark, d):
    return relops.snapshot_entries("nightly", views.names(spark, d), views.files(spark, d).where("doc_id % 2 = 0"))


def _tree(spark, d):
    return relops.vfs_files(views.names(spark, d), views.files(spark, d), _entries(spark, d))


@query("vfs_current", F_SQL + _CURRENT)
def _(spark, d):
    return _tree(spark, d).where("path like '/current/%'").select("path", "kind", "size")


@query("vfs_history", F_SQL + _HISTORY)
def _(spark, d):
    return relops.history_files(views.names(spark, d), views.files(spark, d))


@query("vfs_snapshots", F_SQL + "select '/snapshots/nightly/' || name as path, 'file' as kind, arg_max(size_bytes, version) as size from f where doc_id % 2 = 0 group by name")
def _(spark, d):
    return _tree(spark, d).where("path like '/snapshots/%'").select("path", "kind", "size")


@query("vfs_directories", F_SQL + ", s as (select distinct split_part(name, '/', 1) as s from f), h as (select distinct split_part(name, '/', 1) as s from f where doc_id % 2 = 0) select '/current' as path union select '/history' union select '/snapshots' union select '/snapshots/nightly' union select '/current/' || s from s union select '/history/' || s from s union select '/snapshots/nightly/' || s from h")
def _(spark, d):
    return relops.vfs_directories(_tree(spark, d))


@query("vfs_readdir", F_SQL + "select distinct split_part(name, '/', 2) as name, 'file' as kind from f where starts_with(name, 'src4/')")
def _(spark, d):
    return relops.readdir(_tree(spark, d), "/current/src4")


@query("vfs_resolve_path", F_SQL + "select 'history/./x/../' || name || '@latest' as request, '/history/' || name || '@v' || max(version) as path, 'file' as kind from f group by name")
def _(spark, d):
    req = views.names(spark, d).select(F.concat(F.lit("history/./x/../"), "name", F.lit("@latest")).alias("request"))
    return relops.resolve_paths(req, relops.history_files(views.names(spark, d), views.files(spark, d)))


# Paths and scalars over page URLs and file sizes.


def _paths(spark, d):
    return views.table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("p"), "url")


_U = "with u as (select page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) as p, url from pages) "


@query("validate_names", _U + ", n as (select page_id, case page_id % 6 when 0 then p when 1 then '../' || p when 2 then '/' || p when 3 then p || '/aux.txt' when 4 then '' else p || ':x' end as name from u) select page_id, case page_id % 6 when 1 then 'parent' when 2 then 'absolute' when 3 then 'device' when 4 then 'empty' when 5 then 'character' end as error from n".replace(") ,", "),"))
def _(spark, d):
    p, k = F.col("p"), F.col("page_id") % 6
    n = F.when(k == 0, p).when(k == 1, F.concat(F.lit("../"), p)).when(k == 2, F.concat(F.lit("/"), p)).when(k == 3, F.concat(p, F.lit("/aux.txt"))).when(k == 4, "").otherwise(F.concat(p, F.lit(":x")))
    return _paths(spark, d).select("page_id", paths.name_error(n).alias("error"))


@query("sanitize_paths", _U + "select page_id, array_to_string(list_filter(string_split('a/./../' || p || '//b', '/'), lambda x: x not in ('', '.', '..')), '/') as clean from u")
def _(spark, d):
    return _paths(spark, d).select("page_id", paths.sanitize(F.concat(F.lit("a/./../"), "p", F.lit("//b"))).alias("clean"))


@query("ignore_filter", _U + ", n as (select page_id, p || case page_id % 4 when 0 then '.tmp' when 1 then '/node_modules/x' when 2 then '/.git/config' else '' end as path from u) select page_id, path from n where page_id % 4 = 3".replace(") ,", "),"))
def _(spark, d):
    k = F.col("page_id") % 4
    n = _paths(spark, d).select("page_id", F.concat("p", F.when(k == 0, ".tmp").when(k == 1, "/node_modules/x").when(k == 2, "/.git/config").otherwise("")).alias("path"))
    return n.where(~paths.ignored("path"))


def _sizes(spark, d):
    return views.table(spark, d, "documents").select("doc_id", (F.octet_length("text").cast("long") * (F.col("doc_id") % 5) * (F.col("doc_id") % 5) * 997).alias("n"))


_SIZES = "with s as (select doc_id, octet_length(encode(text)) * (doc_id % 5) * (doc_id % 5) * 997 as n from documents) "


@query("format_bytes_cli", _SIZES + "select doc_id, case when n < 1024 then n || ' bytes' when n < 1048576 then printf('%.2f KiB (%d bytes)', round_even(n / 1024.0, 2), n) when n < 1073741824 then printf('%.2f MiB (%d bytes)', round_even(n / 1048576.0, 2), n) else printf('%.2f GiB (%d bytes)', round_even(n / 1073741824.0, 2), n) end as text from s")
def _(spark, d):
    return _sizes(spark, d).select("doc_id", scalars.format_bytes_long("n").alias("text"))


@query("format_bytes_share", _SIZES + "select doc_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.0f KB', round_even(n / 1024.0, 0)) when n < 1073741824 then printf('%.1f MB', round_even(n / 1048576.0, 1)) else printf('%.2f GB', round_even(n / 1073741824.0, 2)) end as text from s")
def _(spark, d):
    return _sizes(spark, d).select("doc_id", scalars.format_bytes_short("n").alias("text"))


_E = "with e as (select event_id, user_id, event_type, floor(epoch(ts))::bigint as t, (select max(floor(epoch(ts))::bigint) from events) as now from events) "


def _events(spark, d):
    return views.table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_timestamp("ts").alias("t"))


@query("relative_age", _E + "select event_id, case when now - t < 60 then (now - t) || 's ago' when now - t < 3600 then ((now - t) // 60) || 'm ago' when now - t < 86400 then ((now - t) // 3600) || 'h ago' else ((now - t) // 86400) || 'd ago' end as age from e")
def _(spark, d):
    e = _events(spark, d)
    return e.crossJoin(e.agg(F.max("t").alias("now"))).select("event_id", scalars.relative_age("t", "now").alias("age"))


@query("expiry_badge", _E + ", x as (select event_id, case when event_id % 10 = 0 then 0 else t + (event_id % 97) * 3001 end as ex, t + 5000 as n from e) select event_id, case when ex = 0 then 'never' when ex <= n then 'expired' when ex - n >= 86400 then ((ex - n) // 86400) || ' days left' when ex - n >= 3600 then ((ex - n) // 3600) || ' hours left' when ex - n >= 60 then ((ex - n) // 60) || ' minutes left' else (ex - n) || ' seconds left' end as badge from x".replace(") ,", "),"))
def _(spark, d):
    ex = F.when(F.col("event_id") % 10 == 0, F.lit(0).cast("long")).otherwise(F.col("t") + (F.col("event_id") % 97) * 3001)
    return _events(spark, d).select("event_id", scalars.expiry_badge(ex, F.col("t") + 5000).alias("badge"))


@query("http_date", "select event_id, strftime(to_timestamp(floor(epoch(ts))::bigint) at time zone 'UTC', '%a, %d %b %Y %H:%M:%S GMT') as text from events")
def _(spark, d):
    return _events(spark, d).select("event_id", scalars.http_date("t").alias("text"))


_HEADERS = ["bytes=0-99", "bytes=100-", "bytes=-50", "bytes=5-1", "bytes=0-1,4-5", "items=0-1", "bytes=-0", "bytes=0-99999999", "bytes=99999999-", "bytes=-"]


@query(
    "range_header_parse",
    "with h as (select doc_id, octet_length(encode(text)) as n, list_extract(" + repr(_HEADERS) + ", (doc_id % 10)::int + 1) as h from documents), p as (select *, try_cast(regexp_extract(h, '^bytes=(\\d*)-(\\d*)$', 1) as bigint) as a, try_cast(regexp_extract(h, '^bytes=(\\d*)-(\\d*)$', 2) as bigint) as b from h) select doc_id, h as header, case when a is null and b is null then null when n = 0 then 0 when a is null then greatest(n - b, 0) when a >= n or b < a then null else a end as start, case when a is null and b is null then null when n = 0 then 0 when a is null then least(b, n) when a >= n or b < a then null else least(coalesce(b, n - 1), n - 1) - a + 1 end as len from p",
)
def _(spark, d):
    t = views.table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"), F.element_at(F.array(*map(F.lit, _HEADERS)), (F.col("doc_id") % 10 + 1).cast("int")).alias("header"))
    r = scalars.parse_range("header", "n")
    return t.select("doc_id", "header", r["start"].alias("start"), r["len"].alias("len"))


@query("url_decode_paths", _U + "select page_id, p || ' +&é' as text, replace(replace(url_encode(p || ' +&é'), '+', '%20'), '%7E', '~') as encoded from u")
def _(spark, d):
    t = _paths(spark, d).select("page_id", F.concat("p", F.lit(" +&é")).alias("raw"))
    t = t.withColumn("encoded", scalars.percent_encode("raw"))
    return t.select("page_id", scalars.percent_decode("encoded").alias("text"), "encoded")


@query("query_params", "with q as (select page_id, list_filter(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')), lambda x: len(x) = 2) as q from pages) select page_id, list_filter(q, lambda x: x[1] = 'page')[1][2] as page, list_filter(q, lambda x: x[1] = 'utm_source')[1][2] as utm_source from q")
def _(spark, d):
    return views.table(spark, d, "pages").select("page_id", scalars.query_param("url", "page").alias("page"), scalars.query_param("url", "utm_source").alias("utm_source"))


@query("xml_escape", "select page_id, replace(replace(replace(replace(replace(url || '<\"''>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') as text from pages")
def _(spark, d):
    return views.table(spark, d, "pages").select("page_id", scalars.xml_escape(F.concat("url", F.lit("<\"'>"))).alias("text"))


_EXTS = "zip tar gz bz2 xz 7z rar pdf doc docx txt md csv png jpg jpeg gif webp svg bmp rs js ts py c cpp go html css json toml yaml exe".split()


def _in(table: dict, other: str) -> str:
    return "case " + " ".join(f"when e in ({', '.join(repr(x) for x in v.split())}) then '{k}'" for k, v in table.items()) + f" else '{other}' end"


@query("file_class", f"with x as (select page_id, list_extract({_EXTS!r}, (page_id % {len(_EXTS)})::int + 1) as e from pages) select page_id, {_in(scalars.SERVER_CLASSES, 'generic')} as server, {_in(scalars.DESKTOP_CLASSES, 'file')} as desktop from x")
def _(spark, d):
    e = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("page_id") % len(_EXTS) + 1).cast("int"))
    t = views.table(spark, d, "pages").select("page_id", paths.extension(F.concat(F.lit("a.b/F."), F.upper(e))).alias("e"))
    return t.select("page_id", scalars.server_class("e").alias("server"), scalars.desktop_class("e").alias("desktop"))


@query("hex_ids_valid", F_SQL + "select doc_id, doc_id % 4 < 2 as valid from f")
def _(spark, d):
    t = views.table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    k = F.col("doc_id") % 4
    h = F.when(k == 0, F.col("h")).when(k == 1, F.upper("h")).when(k == 2, F.substr("h", F.lit(2))).otherwise(F.concat(F.lit("g"), F.substr("h", F.lit(2))))
    return t.select("doc_id", scalars.is_hex_id(h, 64).alias("valid"))


for _name, _by, _order in (("sort_recent", "latest_version desc, name", (F.desc, "latest_version")), ("sort_size", "size_bytes desc, name", (F.desc, "size_bytes")), ("sort_name", "name", None)):
    # The rank of all rows is the feature, so these have one window over the few names.
    def _run(spark, d, _order=_order):
        l = relops.list_files(views.names(spark, d), views.files(spark, d))
        keys = ([F.desc(_order[1])] if _order else []) + [F.asc("name")]
        return l.select("name", F.row_number().over(W.orderBy(*keys)).alias("rank"))

    query(_name, F_SQL + f", l as (select name, max(version) as latest_version, arg_max(size_bytes, version) as size_bytes from f group by 1) select name, row_number() over (order by {_by}) as rank from l")(_run)


# Shares and events.


def _shares(spark, d):
    e = _events(spark, d)
    return e.select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("token"), F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("t")).cast("long").alias("expires_at"))


_CUT = 1_705_000_000
_S = f"with s as (select cast(event_id as varchar) as id, 't' || user_id as token, case when event_id % 5 = 0 then 0 else floor(epoch(ts))::bigint end as expires_at, event_id, {_CUT} as now from events) "


@query("live_shares", _S + "select id, expires_at from s where expires_at = 0 or expires_at > now")
def _(spark, d):
    return relops.live_shares(_shares(spark, d), F.lit(_CUT)).select("id", "expires_at")


@query("share_status", _S + "select case when event_id % 9 = 0 then 'x' || id else id end as id, case when event_id % 9 = 0 then 404 when expires_at <> 0 and expires_at <= now then 410 when event_id % 4 = 0 then 302 else 200 end as status from s")
def _(spark, d):
    s = _shares(spark, d)
    n = F.col("id").cast("long")
    req = s.select(F.when(n % 9 == 0, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"), F.when(n % 4 == 0, "no").otherwise(F.col("token")).alias("token"))
    return relops.share_status(req, s, F.lit(_CUT)).select("id", "status")


@query("debounce_batch", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 1 hour then 0 else 1 end as n from events), r as (select user_id, ts, sum(n) over (partition by user_id order by ts rows unbounded preceding) as run from (select * from g order by ts)) select user_id, floor(epoch(min(ts)))::bigint as first, floor(epoch(max(ts)))::bigint as last, count(*) as n from r group by user_id, run")
def _(spark, d):
    s = relops.debounced(views.table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", "1 hour")
    return s.select("user_id", F.unix_timestamp("first").alias("first"), F.unix_timestamp("last").alias("last"), "n")


_R = "with e as (select user_id as watch_root, event_id, user_id % 3 as tracker, 'p' || event_id as path, ts, case event_type when 'click' then 'rename_from' when 'view' then 'rename_to' else event_type end as kind from events) "


@query("rename_pairing", _R + "select b.watch_root, b.tracker, arg_max(a.path, (a.ts, a.event_id)) as old, b.path as new from e b join e a on a.watch_root = b.watch_root and a.tracker = b.tracker and a.kind = 'rename_from' and b.ts >= a.ts and b.ts <= a.ts + interval 6 hour and a.event_id < b.event_id where b.kind = 'rename_to' group by b.watch_root, b.tracker, b.event_id, b.path")
def _(spark, d):
    kind = F.when(F.col("event_type") == "click", "rename_from").when(F.col("event_type") == "view", "rename_to").otherwise(F.col("event_type"))
    e = views.table(spark, d, "events").select(F.col("user_id").alias("watch_root"), "event_id", (F.col("user_id") % 3).alias("tracker"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("path"), "ts", kind.alias("kind"))
    return relops.paired_renames(e, "6 hours")


@query("reconcile_deletes", F_SQL + "select distinct name from f where name not in (select name from f where doc_id % 40 <> 0 and name like '%/en.txt')")
def _(spark, d):
    f = views.files(spark, d)
    return relops.reconcile_deletes(views.names(spark, d).select("name"), f.where("doc_id % 40 <> 0 and name like '%/en.txt'").select("name").distinct(), spark.sql("select true as scan_complete"))


@query("reconcile_changes", F_SQL + ", c as (select name, arg_max(size_bytes, version) as s, arg_max(manifest_id, version) as m from f where name not like 'src5/%' group by 1), l as (select name, arg_min(size_bytes, version) as s, arg_min(manifest_id, version) as m from f group by 1) select l.name, case when c.m is null then 'unbound' when l.s <> c.s then 'size' else 'hash' end as why from l left join c using (name) where c.m is null or l.s <> c.s or l.m <> c.m")
def _(spark, d):
    # Stored: the latest versions, without one folder. Found in the folder: the first ones.
    f = views.files(spark, d)
    current = relops.latest(f.where("name not like 'src5/%'"), "name")
    oldest = f.groupBy("name").agg(F.min_by("size_bytes", "version").alias("size"), F.min_by("manifest_id", "version").alias("content_hash"))
    return relops.reconcile_changes(oldest, current)


@query("watcher_status_counts", "select event_type, count(*) as scanned, count(*) filter (value > 50) as saved, count(distinct user_id) as paths from events group by 1")
def _(spark, d):
    return views.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("scanned"), F.count_if(F.col("value") > 50).alias("saved"), F.count_distinct("user_id").alias("paths"))


# Kernels.


def _chunked(spark, d):
    return cdc.chunk(views.table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", 64, 256, 1024)


@query("cdc_lossless", "select doc_id, octet_length(encode(text)) as n, sha256(text) as hash from documents where octet_length(encode(text)) > 0")
def _(spark, d):
    whole = cdc.assemble(_chunked(spark, d), ["doc_id"])
    return whole.select("doc_id", F.octet_length("content").cast("long").alias("n"), F.sha2("content", 256).alias("hash"))


@query("cdc_bounds", "select doc_id, true as within from documents where octet_length(encode(text)) > 0")
def _(spark, d):
    c = _chunked(spark, d)
    last = F.max("ordinal").over(W.partitionBy("doc_id"))
    ok = (F.col("raw_len") <= 1024) & ((F.col("raw_len") >= 64) | (F.col("ordinal") == last))
    return c.select("doc_id", ok.alias("ok")).groupBy("doc_id").agg(F.bool_and("ok").alias("within"))


@query("cdc_dedup_stats")
def _(spark, d):
    c = _chunked(spark, d).select("chunk_id", "raw_len")
    each = c.groupBy("chunk_id").agg(F.count("*").alias("n"), F.first("raw_len").alias("raw_len"))
    return each.agg(F.sum("n").alias("chunks"), F.count("*").alias("unique_chunks"), F.sum(F.col("n") * F.col("raw_len")).alias("logical_bytes"), F.sum("raw_len").alias("unique_bytes"))


@query("zstd_ratio")
def _(spark, d):
    t = views.table(spark, d, "documents").select("lang", F.col("text").cast("binary").alias("data"))
    e = t.select("lang", F.octet_length("data").alias("raw"), codecs.encode_chunk(F.col("data")).alias("e")).select("lang", "raw", "e.codec", F.octet_length("e.payload").alias("kept"))
    return e.groupBy("lang", "codec").agg(F.count("*").alias("n"), F.sum("raw").alias("raw_bytes"), F.sum("kept").alias("payload_bytes"))


@query("crc_column")
def _(spark, d):
    return views.table(spark, d, "documents").select("doc_id", codecs.crc(F.col("text").cast("binary")).alias("crc"))


@query("aead_roundtrip", "select doc_id, sha256(text) as hash, true as tamper_seen from documents")
def _(spark, d):
    key, data = F.unhex(F.lit("00112233445566778899aabbccddeeff" * 2)), F.col("text").cast("binary")
    t = views.table(spark, d, "documents").select("doc_id", "text", codecs.encrypt(data, key, F.col("doc_id").cast("string").cast("binary")).alias("sealed"))
    back = codecs.decrypt(F.col("sealed"), key, F.col("doc_id").cast("string").cast("binary"))
    other = codecs.decrypt(F.col("sealed"), key, F.lit("other").cast("binary"))
    return t.select("doc_id", F.sha2(back, 256).alias("hash"), other.isNull().alias("tamper_seen"))


# The watcher over events as folder events.


def _folder_events(events):
    kind = F.create_map(*[F.lit(x) for p in (("signup", "create"), ("click", "modify"), ("view", "modify"), ("purchase", "rename_both"), ("error", "remove")) for x in p])
    path = F.concat(F.lit("p"), F.col("user_id").cast("string"))
    return events.select(
        F.concat(F.lit("r"), (F.col("user_id") % 16).cast("string")).alias("watch_root"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.element_at(kind, F.col("event_type")), F.lit("modify")).alias("kind"), path.alias("path"), F.concat(path, F.lit("-moved")).alias("to_path"), F.lit(None).cast("long").alias("tracker")
    )


@query("cooldown_batch")
def _(spark, d):
    e = _folder_events(views.table(spark, d, "events")).where("kind in ('create', 'modify')")
    return watcher.replay(e, watcher.WatchConfig(debounce=60, cooldown=3600)).select("watch_root", "seq", "action", "path", "at")


@query("stream_autoingest")
def _(spark, d):
    config, events = watcher.WatchConfig(debounce=3, cooldown=60), views.table(spark, d, "events")
    # A file stream takes a folder or a pattern; the table can be one file.
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")
    return watcher.ingest(_folder_events(stream), watcher.closing(_folder_events(events), config), config)
