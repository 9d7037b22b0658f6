"""Tables of examples for paths, scalars and chunking."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultspark.functions import cdc, codecs, paths, scalars
from vaultspark.functions.errors import AuthenticationError, PasswordRequired, WeakPassphrase


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


BAD = ["", "  ", ".", "./", "..", "../a", "a/../b", "/a", "CON", "con.txt", "a/NUL", "aux.tar.gz", "d/com1", "LPT9.x", "prn", "a:b", "a\nb", "a\x00b", "Com9", "x/lpt1.log", "nul.", "COM5/file"]
GOOD = ["a", "a/b.txt", "console", "com10", "a b", "é/ü", "lpt", ".hidden", "a/.b", "nulls.txt"]


def test_names(spark):
    got = spark.createDataFrame([(n,) for n in BAD + GOOD], "n string").select("n", paths.name_error("n").alias("e")).collect()
    assert [r.n for r in got if r.e is None] == GOOD


def test_ignore_rules(spark):
    patterns = paths.parse_ignore_lines(["# note", "", "build_out/", "*.secret_cache", "logs"])
    cases = {"a.txt": False, "a.tmp": True, "d/~$x.doc": True, ".git/config": True, "x/node_modules/y.js": True, "build_out/a/b.o": True, "q/build_out/c": True, "v.secret_cache": True, "logs/today.txt": True, "catalogs/x": False, "targets/x": False}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", paths.ignored("p", patterns).alias("i")).collect()
    assert {r.p: r.i for r in got} == cases


@pytest.mark.parametrize("pattern,regex_ok", [("a**", False), ("**/x", True), ("x/**", True), ("[ab", False), ("a?c", True)])
def test_globs(pattern, regex_ok):
    assert (paths.glob_regex(pattern) is not None) == regex_ok


def test_paths(spark):
    assert one(spark, paths.sanitize(F.lit("/a/./../b//c"))) == "a/b/c"
    assert one(spark, paths.normalize(F.lit("a/./b/../../../c"))) == "c"
    assert one(spark, paths.parent(F.lit("a/b/c"))) == "a/b"
    assert one(spark, paths.extension(F.lit("A.B/x.TXT"))) == "txt"
    assert [one(spark, paths.safe_restore_dir(F.lit(p))) for p in ("out", "/out", "a/../b", ".", "a/b")] == [True, False, False, False, True]
    assert one(spark, paths.under(F.lit("docs-old/a"), "docs")) is False


def test_range_headers(spark):
    cases = [("bytes=0-99", 1000, (0, 100)), ("bytes=900-", 1000, (900, 100)), ("bytes=-100", 1000, (900, 100)), ("bytes=0-4999", 1000, (0, 1000)), ("bytes=1000-", 1000, None), ("bytes=5-1", 1000, None), ("bytes=0-1,3-4", 1000, None), ("x", 1000, None), ("bytes=0-", 0, (0, 0)), ("bytes=-0", 10, (10, 0)), ("bytes=-", 10, None)]
    for header, total, want in cases:
        r = one(spark, scalars.parse_range(F.lit(header), F.lit(total)))
        assert (None if r is None else (r.start, r.len)) == want, header


def test_formats(spark):
    assert one(spark, scalars.http_date(F.lit(0))) == "Thu, 01 Jan 1970 00:00:00 GMT"
    assert one(spark, scalars.http_date(F.lit(784111777))) == "Sun, 06 Nov 1994 08:49:37 GMT"
    assert [one(spark, scalars.format_bytes_short(F.lit(n).cast("long"))) for n in (0, 512, 2560, 1572864, 1342177280)] == ["0 B", "512 B", "2 KB", "1.5 MB", "1.25 GB"]
    assert one(spark, scalars.format_bytes_long(F.lit(1572864).cast("long"))) == "1.50 MiB (1572864 bytes)"
    assert one(spark, scalars.xml_escape(F.lit("<a href=\"x\">'&'</a>"))) == "&lt;a href=&quot;x&quot;&gt;&apos;&amp;&apos;&lt;/a&gt;"
    assert one(spark, scalars.percent_encode(F.lit("a b*~/é"))) == "a%20b%2A~%2F%C3%A9"
    assert one(spark, scalars.percent_decode(F.lit("a+b%20c"))) == "a+b c"
    for text, want in (("a%zz", "a%"), ("a%zzb%41", "a%bA"), ("a%z%41", "a%41"), ("%", "%"), ("x%4", "x%"), ("%c3%a9%ff", "é\ufffd")):
        assert one(spark, scalars.percent_decode(F.lit(text))) == want
    assert [one(spark, scalars.relative_age(F.lit(t), F.lit(100_000))) for t in (100_500, 99_990, 99_000, 90_000, 1)] == ["0s ago", "10s ago", "16m ago", "2h ago", "1d ago"]
    a = one(spark, scalars.file_attributes(F.lit("file"), F.lit(513)))
    assert (a.blocks, a.perm, a.nlink) == (2, 0o444, 1)


def _noise(n, seed=1):
    return random.Random(seed).randbytes(n)


@given(st.binary(max_size=6000), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_chunks_bounded_and_lossless(data, k):
    cuts = cdc.cut_points(data * (k + 1), 64, 256, 1024)
    data = data * (k + 1)
    assert (cuts[-1] if cuts else 0) == len(data)
    sizes = [b - a for a, b in zip([0, *cuts], cuts)]
    assert all(s <= 1024 for s in sizes) and all(s >= 64 for s in sizes[:-1])


def test_local_edit_keeps_other_chunks():
    data = bytearray(_noise(200_000))
    pieces = lambda b: [bytes(b[x:y]) for x, y in zip([0, *cdc.cut_points(bytes(b), 256, 1024, 4096)], cdc.cut_points(bytes(b), 256, 1024, 4096))]
    before = pieces(data)
    data[100_000:100_100] = _noise(100, 2)
    after = pieces(data)
    assert before[0] == after[0] and before[-1] == after[-1]
    assert len(set(before) & set(after)) >= len(before) - 4


def test_stream_chunker_equals_slices():
    data = _noise(150_000)
    c, got = cdc.StreamChunker(256, 1024, 4096), []
    for i in range(0, len(data), 7001):
        got += c.feed(data[i : i + 7001])
    got += c.finish()
    ends = cdc.cut_points(data, 256, 1024, 4096)
    assert got == [data[a:b] for a, b in zip([0, *ends], ends)]


def test_codecs(spark):
    df = spark.createDataFrame([(bytearray(b"the same sentence. " * 900),), (bytearray(_noise(1024)),), (bytearray(),)], "data binary")
    rows = df.select("data", codecs.encode_chunk(F.col("data")).alias("e")).select("data", "e.*", codecs.decode_chunk(F.col("e.codec"), F.col("e.payload")).alias("back")).collect()
    assert [r.codec for r in rows] == ["zstd", "none", "none"]
    assert len(rows[0].payload) < 0.2 * len(rows[0].data) and len(rows[1].payload) == 1024
    assert all(bytes(r.back) == bytes(r.data) for r in rows)


def test_keys():
    key, record = codecs.create_key("8 chars!")
    assert codecs.unlock_key("8 chars!", record) == key
    with pytest.raises(AuthenticationError):
        codecs.unlock_key("8 chars?", record)
    with pytest.raises(PasswordRequired):
        codecs.unlock_key(None, record)
    for weak in ("7 chars", " " * 9, ""):
        with pytest.raises(WeakPassphrase):
            codecs.create_key(weak)
