"""Line dedup by overlapping three-line windows.

Each text is cut at ``\\n``; each run of three consecutive lines is a window,
known by its three 64-bit line hashes (192 bits). A window that occurs more
than once keeps its first occurrence, by (doc_id, position); the later ones
cover their lines, covered positions of a document are merged, and the lines
under them go. A text of fewer than three lines is one window of all its lines.

Slim rows travel: window hashes are grouped with map-side partial aggregation,
and only documents that lose lines are rewritten. The text itself is shuffled
at most once, for the join with the covered positions.

Defined cases: a null text stays null and an empty one empty; a window of blank
lines only never counts; rows that share doc_id and text are one document and
get one result; null doc_ids come first; inside one document a later occurrence that
overlaps the window's first occurrence leaves the first one's lines in place;
a document that loses every line has an empty text and ``n_removed`` equal to
``n_lines``; texts of any length are cut whole; extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

WINDOW = 3


def covered_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sig, covered: array of 0-based positions) of documents that lose lines."""
    lines = F.split(F.col("text"), "\n")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text <> ''")
    base = base.select("doc_id", F.xxhash64("text").alias("sig"), F.transform(lines, lambda x: F.when(F.trim(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("h"))
    # Positions past the end have hash 1 in their place, so a short text's one window differs from any longer one.
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - WINDOW, F.lit(0)))
    at = lambda i, k: F.coalesce(F.get("h", i + k), F.lit(1).cast("long"))
    windows = base.select(
        "doc_id", "sig", F.size("h").alias("n"),
        F.explode(F.transform(starts, lambda i: F.struct(i.alias("pos"), at(i, 0).alias("a"), at(i, 1).alias("b"), at(i, 2).alias("c")))).alias("w"),
    ).select("doc_id", "sig", "n", "w.*").where("not (a in (0, 1) and b in (0, 1) and c in (0, 1))")
    first = (
        windows.groupBy("a", "b", "c")
        .agg(F.min(F.struct("doc_id", "sig", "pos")).alias("f"), F.max(F.struct("doc_id", "sig", "pos")).alias("l"))
        .where("f <> l")
        .select("a", "b", "c", "f")
    )
    later = windows.join(first, ["a", "b", "c"]).where("not (struct(doc_id, sig, pos) <=> f)")
    low = F.when(F.struct("doc_id", "sig").eqNullSafe(F.struct("f.doc_id", "f.sig")), F.greatest(F.col("pos"), F.col("f.pos") + WINDOW)).otherwise(F.col("pos"))
    high = F.least(F.col("pos") + WINDOW, F.col("n")) - 1
    spans = later.select("doc_id", "sig", low.alias("lo"), high.alias("hi")).where("lo <= hi")
    return spans.select("doc_id", "sig", F.explode(F.sequence("lo", "hi")).alias("p")).groupBy("doc_id", "sig").agg(F.collect_set("p").alias("covered"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` with ``text`` cut, and ``n_lines``, ``n_removed`` (int) under the names given; columns that have these names are replaced."""
    own, doc, sig, cut = unused(docs, "own_hash", "cut_doc", "cut_sig", "cut_lines")
    covered = covered_lines(docs, doc_id, text).select(F.col("doc_id").alias(doc), F.col("sig").alias(sig), F.col("covered").alias(cut))
    joined = docs.withColumn(own, F.xxhash64(text)).join(covered, F.col(doc_id).eqNullSafe(F.col(doc)) & (F.col(own) == F.col(sig)), "left")
    lines = F.split(F.col(text), "\n")
    # The lines are bound once, and positions are told apart by a hash set: linear in a document's lines.
    left = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), cut)
    kept = F.get(F.transform(F.array(lines), lambda ls: F.array_join(F.transform(left(ls), lambda i: F.get(ls, i)), "\n")), 0)
    total = F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(F.size(lines))
    out = joined.withColumns({n_lines: total, n_removed: F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut))})
    return out.withColumn(text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(kept)).drop(own, doc, sig, cut)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("int").alias("n_lines"), F.col("n_removed").cast("int").alias("n_removed"), "text")


SQL = r"""
with l as (
  select doc_id, string_split(text, chr(10)) as ls from documents where text <> ''
), w as (
  select doc_id, len(ls) as n, i as pos,
         [case when trim(x, ' ') = '' then '' else x end for x in ls[i + 1 : least(i + 3, len(ls))]] as k
  from l, lateral (select unnest(range(greatest(len(ls) - 2, 1))) as i)
), u as (select * from w where len([x for x in k if x <> '']) > 0),
f as (
  select k, min({'d': doc_id, 'p': pos}) as f from u group by k having count(*) > 1
), s as (
  select u.doc_id, case when u.doc_id = f.d then greatest(pos, f.p + 3) else pos end as lo, least(pos + 3, n) - 1 as hi
  from u join f on u.k = f.k where not (u.doc_id = f.d and u.pos = f.p)
), c as (
  select doc_id, unnest(range(lo, hi + 1)) as p from s where lo <= hi
), g as (select doc_id, list(distinct p) as covered from c group by doc_id)
select d.doc_id, cast(case when coalesce(d.text, '') = '' then 0 else len(string_split(d.text, chr(10))) end as int) as n_lines,
       cast(coalesce(len(g.covered), 0) as int) as n_removed,
       case when g.covered is null then d.text
            else array_to_string([x for x, i in string_split(d.text, chr(10)) if not list_contains(g.covered, i - 1)], chr(10)) end as text
from documents d left join g using (doc_id)
"""
