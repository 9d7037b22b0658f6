"""The vault's relational core: DataFrames in, DataFrames out, no files and no actions.

Tables, by their columns:

* names(name, object_id)
* versions(object_id, version, manifest_id, size_bytes, created_at)
* manifest_chunks(manifest_id, ordinal, chunk_id, raw_len)
* chunks(chunk_id, raw_len, ...)
* snapshot_entries(label, name, object_id, version, manifest_id, size_bytes)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vaultspark.functions import paths, scalars

# Versions.


def latest(versions: DataFrame, key: str = "object_id") -> DataFrame:
    """The newest row of each key: one aggregate with map-side combining, no window sort."""
    rest = [c for c in versions.columns if c not in (key, "version")]
    best = versions.groupBy(key).agg(F.max_by(F.struct("version", *rest), "version").alias("v"))
    return best.select(key, "v.*")


def list_files(names: DataFrame, versions: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """Names with their latest version. A name whose object is not there goes; an object without versions has version 0 and size 0.

    ``objects`` (object_id) tells these apart; without it every object has versions.
    """
    if objects is not None:
        names = names.join(objects.select("object_id").distinct(), "object_id", "left_semi")
    joined = names.join(latest(_unnamed(versions)), "object_id", "inner" if objects is None else "left")
    return joined.select("name", "object_id", F.coalesce("version", F.lit(0)).alias("latest_version"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "manifest_id")


def newest(versions: DataFrame, n: int, key: str = "object_id") -> DataFrame:
    """The last ``n`` versions of each key; Spark limits the groups before the shuffle."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("version")))
    return versions.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def prune_counts(versions: DataFrame, keep: int, key: str = "object_id") -> DataFrame:
    """(key, pruned): how many versions a prune drops."""
    return versions.groupBy(key).agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("pruned"))


def number_versions(incoming: DataFrame, known: DataFrame, key: str, order: str) -> DataFrame:
    """``incoming`` with ``version``: after the largest ever given, which pruning does not take back.

    ``known`` has (key, latest_version).
    """
    row = F.row_number().over(W.partitionBy(key).orderBy(order))
    return incoming.join(known.select(key, "latest_version"), key, "left").withColumn("version", F.coalesce("latest_version", F.lit(0)) + row).drop("latest_version")


def rollback(versions: DataFrame, to_version: Column, key: str = "object_id") -> DataFrame:
    """One new row for each key that has ``to_version``: its content again, as the next version."""
    w = W.partitionBy(key)
    return versions.withColumn("__next", F.max("version").over(w) + 1).where(F.col("version") == to_version).withColumn("version", F.col("__next")).drop("__next")


def _unnamed(versions: DataFrame) -> DataFrame:
    """Versions without a name of their own, so that the binding's name is the only one."""
    return versions.drop("name")


# Names.


def rename(names: DataFrame, old: str, new: str) -> DataFrame:
    """``old`` becomes ``new``, whose own binding goes; without ``old`` nothing changes."""
    has = names.where(F.col("name") == old).select(F.lit(True).alias("__has")).limit(1)
    kept = names.join(has, F.lit(True), "left").where(F.col("__has").isNull() | (F.col("name") != new)).drop("__has")
    return kept.withColumn("name", F.when(F.col("name") == old, F.lit(new)).otherwise(F.col("name")))


def move_prefix(names: DataFrame, old: str, new: str | None) -> DataFrame:
    """Names at or below ``old`` move to ``new`` (None: are unbound), all at once: targets give way first."""
    hit = paths.under("name", old)
    stay, go = names.where(~hit), names.where(hit)
    if new is None:
        return stay
    go = go.withColumn("name", paths.moved("name", old, new))
    return stay.join(go.select("name"), "name", "left_anti").select(names.columns).unionByName(go)


def bind(names: DataFrame, added: DataFrame) -> DataFrame:
    """Upsert: ``added`` wins over bindings of the same name."""
    return names.join(added.select("name"), "name", "left_anti").select(names.columns).unionByName(added.select(names.columns))


def resolve(targets: DataFrame, names: DataFrame, versions: DataFrame, manifests: DataFrame) -> DataFrame:
    """(target, manifest_id, via): a name, else an object id, else a manifest id; a hit that dangles falls through."""
    now = latest(versions).select("object_id", F.col("manifest_id").alias("of_object"))
    by_name = names.join(now, "object_id").select(F.col("name").alias("t"), F.col("of_object").alias("by_name"))
    by_object = now.select(F.col("object_id").alias("t"), F.col("of_object").alias("by_object"))
    by_manifest = manifests.select(F.col("manifest_id").alias("t"), F.col("manifest_id").alias("by_manifest")).distinct()
    t = targets.withColumn("t", F.trim("target"))
    for found in (by_name, by_object, by_manifest):
        t = t.join(found, "t", "left")
    via = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_object").isNotNull(), "object").when(F.col("by_manifest").isNotNull(), "manifest")
    return t.select("target", F.coalesce("by_name", "by_object", "by_manifest").alias("manifest_id"), via.alias("via"))


# Snapshots.


def snapshot_entries(label: str | Column, names: DataFrame, versions: DataFrame) -> DataFrame:
    """The latest version of each name that has one."""
    label = F.lit(label) if isinstance(label, str) else label
    return names.join(latest(_unnamed(versions)), "object_id").select(F.trim(label).alias("label"), "name", "object_id", "version", "manifest_id", "size_bytes")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change): added, removed or changed between two lists of (name, manifest_id)."""
    a, b = before.select("name", F.col("manifest_id").alias("a")), after.select("name", F.col("manifest_id").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "name", "full").select("name", change.alias("change")).where("change is not null")


# Chunks.


def with_offsets(manifest_chunks: DataFrame) -> DataFrame:
    """``start_offset`` of each chunk in its file, kept at ingest so that range reads need no running sum."""
    before = W.partitionBy("manifest_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    return manifest_chunks.withColumn("start_offset", F.coalesce(F.sum("raw_len").over(before), F.lit(0)))


def range_slices(offsets: DataFrame, requests: DataFrame) -> DataFrame:
    """Chunks that overlap the requests (manifest_id, offset, size), with the part of each: (from_byte, n_bytes).

    The join is on the manifest; the range test stays with it, so no inequality join is planned.
    """
    end = F.col("offset") + F.col("size")
    j = offsets.join(requests, "manifest_id").where((F.col("start_offset") + F.col("raw_len") > F.col("offset")) & (F.col("start_offset") < end))
    low = F.greatest(F.col("offset") - F.col("start_offset"), F.lit(0))
    return j.withColumns({"from_byte": low, "n_bytes": F.least(F.col("raw_len"), end - F.col("start_offset")) - low})


def new_chunks(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct incoming chunks that the store does not have."""
    return incoming.dropDuplicates(["chunk_id"]).join(store.select("chunk_id"), "chunk_id", "left_anti")


def put_summary(incoming: DataFrame, store: DataFrame, file: str, order: list[str]) -> DataFrame:
    """For each file: chunk_count (with repeats), new_chunks (first seen here, by the total ``order``), dedup_chunks, total_bytes."""
    first = F.row_number().over(W.partitionBy("chunk_id").orderBy(*order)) == 1
    known = store.select("chunk_id", F.lit(True).alias("__known")).distinct()
    flagged = incoming.withColumn("__first", first).join(known, "chunk_id", "left")
    fresh = F.count_if(F.col("__first") & F.col("__known").isNull())
    return flagged.groupBy(file).agg(F.count("*").alias("chunk_count"), fresh.alias("new_chunks"), (F.count("*") - fresh).alias("dedup_chunks"), F.sum("raw_len").cast("long").alias("total_bytes"))


# Garbage collection and integrity.


def live_manifests(versions: DataFrame, entries: DataFrame) -> DataFrame:
    """Manifests of every object, bound or not, and of every snapshot."""
    return versions.select("manifest_id").union(entries.select("manifest_id")).distinct()


def reachable_chunks(live: DataFrame, manifest_chunks: DataFrame) -> DataFrame:
    return manifest_chunks.join(live, "manifest_id", "left_semi").select("chunk_id").distinct()


def missing(refs: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """References whose target is not there."""
    return refs.join(table.select(key), key, "left_anti")


def gc_stats(objects: DataFrame, labels: DataFrame, reachable: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: live_roots, reachable_chunks (distinct, stored or not), chunks_retained, chunks_reclaimed."""
    marked = chunks.select("chunk_id").join(reachable.withColumn("live", F.lit(True)), "chunk_id", "left")
    counts = marked.agg(F.count_if("live").alias("chunks_retained"), F.count_if(F.col("live").isNull()).alias("chunks_reclaimed"))
    roots = objects.select("object_id").distinct().agg(F.count("*").alias("o")).crossJoin(labels.select("label").distinct().agg(F.count("*").alias("l")))
    return roots.crossJoin(reachable.agg(F.count("*").alias("reachable_chunks"))).crossJoin(counts).select((F.col("o") + F.col("l")).alias("live_roots"), "reachable_chunks", "chunks_retained", "chunks_reclaimed")


def store_stats(names: DataFrame, versions: DataFrame, manifests: DataFrame, labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals; each side is one aggregate, and only single rows are put side by side."""
    named = versions.join(names.select("object_id"), "object_id", "left_semi")
    one = names.agg(F.count("*").alias("objects"))
    for part in (
        manifests.agg(F.count("*").alias("manifests")),
        labels.agg(F.count("*").alias("snapshots")),
        chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("raw_len"), F.lit(0)).cast("long").alias("unique_chunks_bytes")),
        named.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("logical_bytes")),
        latest(named).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("latest_logical_bytes")),
    ):
        one = one.crossJoin(part)
    u, n = F.col("unique_chunks_bytes"), F.col("logical_bytes")
    return one.withColumns({
        "dedup_ratio": F.when(u == 0, F.lit(1.0)).otherwise(n / F.nullif(u, F.lit(0))),
        "space_savings_pct": F.when(n <= u, F.lit(0.0)).otherwise((n - u) / F.nullif(n, F.lit(0)) * 100),
    })


# Views of the file system.


def vfs_files(names: DataFrame, versions: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, kind, size, symlink_target) of all files under /current, /snapshots/<label> and /history."""
    clean = lambda c: F.array_join(paths.components(c), "/")
    now = names.join(latest(_unnamed(versions)), "object_id").select(F.concat(F.lit("/current/"), clean("name")).alias("path"), F.lit("file").alias("kind"), F.col("size_bytes").alias("size"), F.lit(None).cast("string").alias("symlink_target"))
    snaps = entries.select(F.concat(F.lit("/snapshots/"), "label", F.lit("/"), clean("name")), F.lit("file"), "size_bytes", F.lit(None).cast("string"))
    return now.union(snaps).union(history_files(names, versions))


def history_files(names: DataFrame, versions: DataFrame) -> DataFrame:
    """``<name>@v<N>`` for every version of a bound object, and ``@latest`` as a link to the largest."""
    clean = F.concat(F.lit("/history/"), F.array_join(paths.components("name"), "/"))
    each = names.join(_unnamed(versions), "object_id").select(F.concat(clean, F.lit("@v"), F.col("version").cast("string")).alias("path"), F.lit("file").alias("kind"), F.col("size_bytes").alias("size"), F.lit(None).cast("string").alias("symlink_target"))
    top = versions.groupBy("object_id").agg(F.max("version").alias("version"))
    target = F.concat(paths.basename("name"), F.lit("@v"), F.col("version").cast("string"))
    links = names.join(top, "object_id").select(F.concat(clean, F.lit("@latest")), F.lit("symlink"), F.octet_length(target).cast("long"), target)
    return each.union(links)


def vfs_directories(files: DataFrame) -> DataFrame:
    """(path) of every folder that a file's path implies."""
    parts = paths.components("path")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return files.where(F.size(parts) > 1).select(F.explode(prefixes).alias("path")).distinct()


def readdir(files: DataFrame, folder: str) -> DataFrame:
    """(name, kind) of what is directly in ``folder``."""
    rest = F.substr("path", F.lit(len(folder.rstrip("/")) + 2))
    inside = files.where(F.startswith("path", F.lit(folder.rstrip("/") + "/")))
    kind = F.when(F.contains(rest, F.lit("/")), "dir").otherwise(F.col("kind"))
    return inside.select(F.substring_index(rest, "/", 1).alias("name"), kind.alias("kind")).distinct()


def readdir_page(files: DataFrame, folder: str, offset: int, limit: int) -> DataFrame:
    """(position, name, kind) of a folder's entries after the first ``offset``: the folder, its parent, then all by name.

    Only the page is ordered over the whole folder: a top-k, no window.
    """
    dots = files.sparkSession.createDataFrame([("", ".", "dir"), ("", "..", "dir")], "first string, name string, kind string")
    every = dots.unionByName(readdir(files, folder).select(F.col("name").alias("first"), "name", "kind"))
    page = every.orderBy("first", "name").limit(offset + limit).offset(offset)
    at = F.row_number().over(W.orderBy("first", "name")) + offset
    return page.select(at.alias("position"), "name", "kind")


def propfind(files: DataFrame, folder: str, depth: int = 1) -> DataFrame:
    """(href, xml): the WebDAV property entry of a folder and, with depth 1, of what is directly in it.

    ``files`` has (path, kind, size, mtime in epoch seconds); a folder's mtime is the least below it.
    """
    base = "/" + folder.strip("/")
    inside = files.where(F.startswith("path", F.lit(base.rstrip("/") + "/")))
    rest = F.substr("path", F.lit(len(base.rstrip("/")) + 2))
    name, is_dir = F.substring_index(rest, "/", 1), F.contains(rest, F.lit("/"))
    kids = inside.select(name.alias("name"), is_dir.alias("is_dir"), F.when(~is_dir, F.col("size")).alias("size"), "mtime").groupBy("name", "is_dir").agg(F.max("size").alias("size"), F.min("mtime").alias("mtime"))
    kids = kids.withColumn("href", F.concat(F.lit(base.rstrip("/") + "/"), "name", F.when(F.col("is_dir"), "/").otherwise("")))
    own = inside.agg(F.min("mtime").alias("mtime"), F.count("*").alias("n")).where("n > 0")
    own = own.select(F.lit(base.rsplit("/", 1)[-1]).alias("name"), F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("size"), "mtime", F.lit(base.rstrip("/") + "/").alias("href"))
    rows = own.unionByName(kids) if depth else own
    date = F.concat(F.lit("        <D:getlastmodified>"), scalars.http_date("mtime"), F.lit("</D:getlastmodified>\n"))
    size = F.concat(F.lit("        <D:getcontentlength>"), F.coalesce(F.col("size"), F.lit(0)).cast("string"), F.lit("</D:getcontentlength>\n        <D:getcontenttype>application/octet-stream</D:getcontenttype>\n"))
    kind = F.when(F.col("is_dir"), "        <D:resourcetype><D:collection/></D:resourcetype>\n").otherwise(F.concat(F.lit("        <D:resourcetype/>\n"), size))
    xml = F.concat(
        F.lit("  <D:response>\n    <D:href>"), scalars.xml_escape("href"), F.lit("</D:href>\n    <D:propstat>\n      <D:prop>\n        <D:displayname>"), scalars.xml_escape("name"), F.lit("</D:displayname>\n"),
        kind, date, F.lit("      </D:prop>\n      <D:status>HTTP/1.1 200 OK</D:status>\n    </D:propstat>\n  </D:response>\n"),
    )
    return rows.select("href", xml.alias("xml"))


def resolve_paths(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(request, path, kind): paths taken lexically, symbolic links followed once."""
    wanted = requests.withColumn("path", F.concat(F.lit("/"), paths.normalize("request")))
    hit = wanted.join(files.select("path", "kind", "symlink_target"), "path")
    to = F.concat(paths.parent("path"), F.lit("/"), F.col("symlink_target"))
    return hit.select("request", F.when(F.col("kind") == "symlink", to).otherwise(F.col("path")).alias("path"), F.lit("file").alias("kind"))


# Events.


def debounced(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, first, last, n): runs of events of a key in which each comes less than ``gap`` after the one before."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("w")


def reconcile_deletes(tracked: DataFrame, listing: DataFrame, complete: DataFrame) -> DataFrame:
    """Tracked names that are not listed; none unless ``complete`` (one row, scan_complete) is true."""
    gone = tracked.join(listing.select("name"), "name", "left_anti")
    return gone.join(F.broadcast(complete.where("scan_complete").limit(1)), F.lit(True), "left_semi")


def reconcile_changes(listing: DataFrame, current: DataFrame) -> DataFrame:
    """Listed files (name, size, content_hash) that are unbound or differ from ``current``, by size first."""
    c = current.select("name", F.col("size_bytes").alias("__size"), F.col("manifest_id").alias("__hash"))
    why = F.when(F.col("__hash").isNull(), "unbound").when(F.col("size") != F.col("__size"), "size").when(F.col("content_hash") != F.col("__hash"), "hash")
    return listing.join(c, "name", "left").select("name", why.alias("why")).where("why is not null")


def paired_renames(events: DataFrame, timeout: str = "2 seconds") -> DataFrame:
    """(watch_root, tracker, old, new): rename_from and rename_to of one tracker within ``timeout``; the nearest earlier from counts."""
    a = events.where("kind = 'rename_from'").select("watch_root", "tracker", F.col("path").alias("old"), F.col("ts").alias("from_ts"), F.col("event_id").alias("from_id"))
    b = events.where("kind = 'rename_to'").select("watch_root", "tracker", F.col("path").alias("new"), F.col("ts").alias("to_ts"), "event_id")
    j = b.join(a, ["watch_root", "tracker"]).where(F.col("to_ts").between(F.col("from_ts"), F.col("from_ts") + F.expr(f"interval {timeout}")) & (F.col("from_id") < F.col("event_id")))
    best = j.groupBy("watch_root", "tracker", "event_id", "new").agg(F.max_by("old", F.struct("from_ts", "from_id")).alias("old"))
    return best.select("watch_root", "tracker", "old", "new")


def live_shares(shares: DataFrame, now: Column) -> DataFrame:
    return shares.where((F.col("expires_at") == 0) | (F.col("expires_at") > now))


def share_files(shares: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name, size_bytes): a share's one file, or all files in its folder. An equi-join on the folders that each name lies in."""
    parts = paths.components("name")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = files.where(F.size(parts) > 0).select("name", "size_bytes", F.explode(above).alias("__path"))
    wanted = shares.select("id", F.array_join(paths.components("path"), "/").alias("__path"))
    return wanted.join(each, "__path").select("id", "name", "size_bytes")


def first_errors(errors: DataFrame) -> DataFrame:
    """(watch_root, last_error): of each root's open errors (key, message) the one whose key comes first."""
    return errors.groupBy("watch_root").agg(F.min_by("message", F.struct("key", "message")).alias("last_error"))


def share_status(requests: DataFrame, shares: DataFrame, now: Column) -> DataFrame:
    """404 for an unknown share, 410 for an expired one, 302 for a wrong token, else 200."""
    s = shares.select("id", F.col("token").alias("__token"), F.col("expires_at").alias("__at"))
    expired = (F.col("__at") != 0) & (F.col("__at") <= now)
    status = F.when(F.col("__token").isNull(), 404).when(expired, 410).when(F.col("token") != F.col("__token"), 302).otherwise(200)
    return requests.join(s, "id", "left").select(*requests.columns, status.alias("status"))
