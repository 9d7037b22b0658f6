"""URL rules: a blocked Bloom filter in front of an exact hash join.

A rule is ``(host, path, verdict)``. It fits a URL if the URL's host is the
rule's or a subdomain of it and the URL's path starts with the rule's; of the
rules that fit, the longest (``host + path``) wins. A URL expands to its canonical keys, one
for each host suffix and each listed path length. A blocked Bloom filter of the
listed keys (one 64-bit word a block, four bits a key) drops nearly all keys
inside the scan; only the keys that pass are exploded, joined with the rules by
equality, and so freed of false positives.

The filter has at most ``MAX_WORDS`` words (32 KiB) whatever the list's length:
a longer list raises only the share of keys that reach the join. Everything on
this path is DataFrame expressions; no Python runs on executors.

Defined cases: a null URL or one without ``://`` has empty host and path and no
rule; empty rule tables give the default verdict; repeated URLs get equal rows;
repeated rules count once (a tie of verdicts: ``block`` wins); extra columns
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

MAX_WORDS = 4096
BITS_PER_KEY = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the contract.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.substring_index(F.substring_index(F.substring_index(_after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    at = F.locate("/", rest)
    return F.when(at > 0, F.substr(rest, at)).otherwise("")


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _block(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), key), F.lit(words)).cast("int")


def _any_bits(h: Column) -> Column:
    out = None
    for s in (0, 6, 12, 18):
        n = F.shiftright(h, s).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), n)
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def bloom_words(keys: DataFrame, words: int) -> list[int]:
    """The filter of ``keys(key)`` as ``words`` 64-bit words, built by one aggregate.

    What reaches the driver is at most ``words`` rows, and ``words`` is bounded.
    """
    masked = keys.select(_block(F.col("key"), words).alias("b"), _any_bits(F.xxhash64(F.lit(71), F.col("key"))).alias("m"))
    out = [0] * words
    for b, m in masked.groupBy("b").agg(F.expr("bit_or(m)").alias("m")).collect():
        out[b] = m
    return out


def may_be_listed(key: Column, filter_words: list[int]) -> Column:
    """True for every listed key, and for a small share of the others."""
    words = F.expr("array(" + ",".join(f"{w}L" if w != -(2**63) else "-9223372036854775807L-1L" for w in filter_words) + ")")
    mask = _any_bits(F.xxhash64(F.lit(71), key))
    return F.get(words, _block(key, len(filter_words))).bitwiseAND(mask) == mask


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has columns host, path, verdict. A column of ``df`` named like an
    added one is replaced.
    """
    listed = rules.select("host", "path", "verdict").where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    listed = listed.withColumn("key", F.concat("host", F.lit(" "), "path"))
    # Bounded: the distinct lengths of listed paths, and two counts.
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())
    n = listed.count()
    words = MAX_WORDS
    while words > 64 and words * 32 >= n * BITS_PER_KEY:
        words //= 2
    bloom = bloom_words(listed.select("key"), words)

    parts = F.split(F.col("__host"), "\\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    paths = F.filter(F.array(*[F.when(F.length("__path") >= k, F.substring("__path", 1, k)) for k in lengths]), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit(" "), p))))

    hit, rule, verdict = unused(df, "hit_url", "hit_rule", "hit_verdict")
    urls = df.select(F.col(url).alias("__url"), url_host(F.col(url)).alias("__host"), url_path(F.col(url)).alias("__path"))
    hits = urls.where("__host <> ''").select("__url", F.filter(keys, lambda k: may_be_listed(k, bloom)).alias("keys"))
    hits = hits.where(F.size("keys") > 0).distinct().select("__url", F.explode("keys").alias("key"))
    won = (
        hits.join(listed, "key")
        .groupBy("__url")
        .agg(F.max(F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "verdict")).alias("w"))
        .select(F.col("__url").alias(hit), F.col("w.rule").alias(rule), F.col("w.verdict").alias(verdict))
    )
    out = df.join(won, F.col(url) == F.col(hit), "left")
    return out.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url)), "rule": F.col(rule), "verdict": F.coalesce(verdict, F.lit(default))}).drop(hit, rule, verdict)


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return spark.sql(f"select * from values {values} as t(host, path, verdict)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
with p as (
  select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), q as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p
), r(h, p, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
w as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
  from q join r on (q.host = r.h or ends_with(q.host, '.' || r.h)) and starts_with(q.path, r.p) group by page_id
)
select q.page_id, q.host, q.path, w.rule, coalesce(w.verdict, 'allow') as verdict from q left join w using (page_id)
"""
