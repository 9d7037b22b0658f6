"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultspark.llm import chat_format, decontamination, flac, jaccard_join, line_dedup, packing, sharding, shingles, toxicity, url_filter, warc
from vaultspark.llm.common import release, stage, tagged
from vaultspark.llm.components import components
from vaultspark.llm.tokens import Encoder

RNG = random.Random(5)
LONG = " ".join("".join(RNG.choices("abcdefgh", k=4)) + ("\n" if i % 20 == 19 else "") for i in range(30_000))
ROWS = [(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, " \n\t"), (5, LONG), (6, LONG + " more"), (None, "null id"), (None, "null id"), (7, "same"), (7, "same"), (8, "same"), (9, "é 日本 😀 ﬁ\u2028 x\x00y")]
#: Extra columns whose names clash with those that the operators use inside.
EXTRA = ["shard", "slot", "n_removed", "n_lines", "score", "node", "root", "part", "rank", "host", "rule", "__doc", "token", "sequence_id"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(c) for c in EXTRA})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_sharding(spark, docs, none):
    got = sharding.shuffle_into_shards(docs, 5).select("doc_id", "shard", "slot").collect()
    assert len(got) == len(ROWS) and sorted(np.bincount([r.shard for r in got])) == [2, 2, 2, 3, 3]
    assert sharding.shuffle_into_shards(none, 3).count() == 0
    assert {r.slot for r in sharding.shuffle_into_shards(docs.limit(2), 9).collect()} == {0}
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(docs, 0)


def test_sharding_is_uniform_and_exact():
    m = sharding.communication_matrix([5, 0, 17, 100], 7, 1)
    assert m.sum(1).tolist() == [5, 0, 17, 100] and max(m.sum(0)) - min(m.sum(0)) <= 1
    for n in (1, 2, 7, 64, 1000):
        at = np.arange(n)
        assert sorted(sharding.permute(at, np.full(n, n), np.full(n, 3), 11).tolist()) == at.tolist()
    rng = np.random.default_rng(0)
    big = [sharding._hypergeometric(rng, 10**10, 3 * 10**10, 1000) for _ in range(300)]
    assert abs(np.mean(big) - 250) < 5 and 10 < np.std(big) < 18


def test_jaccard(spark, docs, none):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.jaccard_components(docs).collect())
    assert [g for g in got if g[0] in (2, 3, 4)] == [(2, 0, 2), (3, 0, 3), (4, 0, 4)]
    assert [g[2] for g in got if g[0] in (5, 6, 7, 8)] == [5, 5, 7, 7, 7] and len(got) == len(ROWS)
    assert [g[1:] for g in got if g[0] == -1] == [(1, -1), (1, -1)]
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_chain_and_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(60):  # each links with the next, the ends do not
        words = base[:]
        words[: 4 * k] = [f"x{i}" for i in range(4 * k)]
        rows.append((100 + k, " ".join(words)))
    rows += [(500 + k, " ".join([f"y{k}_{i}" for i in range(150)] + base[:60])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r[0]: 100 if r[0] < 500 else r[0] for r in rows}
    for size in (1500, 7):
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", size)
        assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()} == want


@given(st.lists(st.lists(st.integers(0, 40), min_size=4, max_size=30), min_size=2, max_size=25))
@settings(max_examples=60, deadline=None)
def test_spanning_links_connect_what_all_links_connect(lists):
    sets = [np.unique(np.array(x, dtype=np.uint64)) for x in lists]
    n = np.array([len(s) for s in sets])
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    from vaultspark.llm.components import Forest

    a, b = Forest(), Forest()
    for e in edges:
        a.join(*e)
    for e in jaccard_join.spanning_links(sets, n):
        assert (max(e), min(e)) in edges
        b.join(*e)
    assert [a.find(i) for i in range(len(sets))] == [b.find(i) for i in range(len(sets))]


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 101), (101, 102), (7, 3), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_against_words():
    texts = ["A b c d e f", "a B c", "", " ", "x" * 500, "a b c d e a b c d e a b c d e", "é\x0bé é\té é é"]
    s, n = shingles.shingle_sets(*shingles.text_bytes(pa.array([*texts, None])))
    assert n.tolist() == [2, 1, 0, 0, 1, 5, 1, 0]
    s2, n2 = shingles.shingle_sets(*shingles.text_bytes(pa.array(["a b c"])))
    assert s2[0] == s[2]


def test_line_dedup(spark, docs, none):
    p = "l1\nl2\nl3"
    rows = [(1, f"a\n{p}\nb"), (2, f"c\n{p}\nd"), (3, p), (4, "l1\nl2"), (5, "l1\nl2"), (6, "r\nr\nr\nr\nr"), (7, "\n\n\n"), (8, "\n\n\n\n"), (None, p)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("a", "b", "pos", "__covered")})
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: "a\nb", 2: "c\nd", 3: "", 4: "l1\nl2", 5: "", 6: "r\nr\nr", 7: "\n\n\n", 8: "\n\n\n\n", None: p}
    out = line_dedup.dedup_lines(docs)
    assert out.count() == len(ROWS) and out.where("doc_id = 2").first().text is None
    assert line_dedup.dedup_lines(none).count() == 0


def test_packing(spark, docs, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, path).collect()
    assert len({r.sequence_id for r in got}) >= -(-sum(r.length for r in got) // 1024)
    assert sum(r.piece == 0 for r in got) == len(ROWS)
    assert [r.length for r in got if r.doc_id in (2, 3)] == [1, 1]
    assert packing.pack(none, path).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=40))
@settings(max_examples=80, deadline=None)
def test_plans_place_every_piece_once(histogram):
    slots, sequences = packing.plan(histogram, 64)
    filled, placed = {}, {}
    for length, rank, times, first, offset in slots:
        for k in range(times):
            assert placed.setdefault((length, rank + k), True) and (length, rank + k) in placed
            filled.setdefault(first + k, []).append((offset, length))
    assert len(placed) == sum(histogram.values()) == sum(map(len, filled.values())) and len(filled) == sequences
    assert all({r for n, r in placed if n == k} == set(range(c)) for k, c in histogram.items())
    for spans in filled.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 64


@given(st.lists(st.text(alphabet=" \n\t'strevmldLlSé9²½ñ!.,-$\r\x85\xa0日<|>", max_size=30), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_tokenizers(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
    assert Encoder.of(path).encode(texts) == want


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.NET/en/x?y#z"), (4, "a://net"), (5, "a://net/"), (6, "a://xnet/"), (7, "a://b.example.com/de/?q"), (8, "a://example.com#/de/"), (9, "a://q.org/fr/x"), (9, "a://q.org/fr/x"), (10, "a://x?y://z"), (11, "a://b.net/en/"), (12, "://")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("old")).withColumn("key", F.lit("k"))
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.rules_table(spark)).orderBy("page_id").collect()]
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "www.example.net", "/en/x", "example.net/en/", "allow"), (4, "net", "", None, "allow"), (5, "net", "/", "net/", "block"), (6, "xnet", "/", None, "allow"),
        (7, "b.example.com", "/de/", "example.com/de/", "block"), (8, "example.com", "", None, "allow"), (9, "q.org", "/fr/x", "org/fr/", "allow"), (9, "q.org", "/fr/x", "org/fr/", "allow"), (10, "x", "", None, "allow"), (11, "b.net", "/en/", "net/", "block"), (12, "", "", None, "allow"),
    ]
    empty = url_filter.rules_table(spark).where("false")
    assert {r.verdict for r in url_filter.filter_urls(df, empty).collect()} == {"allow"}
    assert url_filter.filter_urls(df.where("false"), url_filter.rules_table(spark)).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = url_filter.bloom_words(keys, 4096)
    hit = lambda p: spark.range(5000).select(url_filter.may_be_listed(F.concat(F.lit(p), "id"), words).alias("h")).where("h").count()
    assert hit("k") == 5000 and hit("z") < 500


def test_decontamination(spark, docs, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (None, item)], "item_id long, text string")
    edited = item.replace("delta", "DELTA!").replace("kappa", "kap pa")
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(50, f"x {item.upper()} y"), (51, f"go {edited} on"), (52, item[:40]), (50, f"x {item.upper()} y")], "doc_id long, text string"))
    got = sorted((r.doc_id, r.item_id or -1, r.edits) for r in decontamination.contaminated(df, bench).collect())
    assert got == [(50, -1, 0), (50, -1, 0), (50, 1, 0), (50, 1, 0), (51, -1, 2), (51, 1, 2)]
    assert decontamination.drop_contaminated(docs, bench).count() == len(ROWS)
    assert decontamination.contaminated(none, bench).count() == 0 and decontamination.contaminated(docs, bench.where("false")).count() == 0


def test_decontamination_recall_of_edited_items():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("bcdfgaeiou", k=rng.randint(2, 6))) for _ in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(15, 60)))) for i in range(60)]
    index, texts, want = decontamination.Index(items), [], []
    for d in range(240):
        i, text = rng.choice(items)
        w = text.split()
        for _ in range(rng.randint(0, decontamination.allowed(len(w)))):
            p = rng.randrange(len(w))
            w[p : p + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
        noise = rng.choices(vocabulary, k=100)
        texts.append(" ".join(noise[:50] + w + noise[50:]))
        want.append((d, i))
    h, n, _, _ = shingles.word_hashes(*shingles.text_bytes(pa.array(texts)), shingles.PUNCTUATION)
    words = [shingles.word_hashes(*shingles.text_bytes(pa.array([t])), shingles.PUNCTUATION)[0] for t in texts]
    near = {(d, i) for d, i in want if decontamination.window_distance(index.words[i], words[d])[0] <= decontamination.allowed(len(index.words[i]))}
    assert len(near & set(index.search(h, n))) >= 0.95 * len(near)


@pytest.mark.parametrize("size", [15, 16, 20, 45, 59, 60, 150, 250, 400])
@pytest.mark.parametrize("how", ["head replaced", "head dropped", "tail replaced", "tail dropped", "inserted", "spread"])
def test_decontamination_finds_every_window_at_the_limit(size, how):
    rng = random.Random(size)
    vocabulary = ["".join(rng.choices("bcdfgaeiou", k=rng.randint(2, 6))) for _ in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=size))) for i in range(40)]
    k, texts = decontamination.allowed(size), []
    for _, text in items:
        w = text.split()
        fresh = [f"new{i}" for i in range(k)]
        if how == "inserted":
            for i, p in enumerate(sorted(rng.sample(range(1, size), k), reverse=True)):
                w.insert(p, fresh[i])
        elif how == "spread":
            for i in range(k):
                w[(2 * i + 1) * size // (2 * k)] = fresh[i]
        else:
            fresh *= how.endswith("replaced")
            w = fresh + w[k:] if how.startswith("head") else w[: size - k] + fresh
        noise = rng.choices(vocabulary, k=100)
        texts.append(" ".join(noise[:50] + w + noise[50:]))
    h, n, _, _ = shingles.word_hashes(*shingles.text_bytes(pa.array(texts)), shingles.PUNCTUATION)
    got = decontamination.Index(items).search(h, n)
    ends = np.cumsum(n)
    for d, (i, _) in enumerate(items):
        own = h[ends[d] - n[d] : ends[d]]
        assert got.get((d, i)) == decontamination.window_distance(decontamination.Index(items[i : i + 1]).words[0], own)


def test_flac_digests_come_from_stored_streams(spark):
    out = flac.query(spark, "/root/testdata/sf0.001")
    (folder,) = {f.rsplit("/", 1)[0] for f in out.inputFiles()}
    stored = {r.doc_id: r for r in spark.read.parquet(folder).collect()}
    got = out.collect()
    assert "/media-" in folder and len(got) == len(stored)
    assert all(r.media_bytes == len(stored[r.doc_id].media) and r.media_sha256 == hashlib.sha256(stored[r.doc_id].media).hexdigest() for r in got)


def test_flac_uses_every_order():
    rng = np.random.default_rng(3)
    kinds, payloads = set(), []
    for o in range(5):
        for n in (64, 1000, 1024, 1500):
            t = np.arange(n)
            x = [rng.integers(-9, 9, n), np.cumsum(rng.integers(-2, 3, n)) % 60, 100 * np.sin(t / 9), 110 * np.sin(t / 5.0), 120 * np.sin(t / 3.2)][o]
            payloads.append((np.clip(np.round(x), -128, 127).astype(np.int64) + 128).astype(np.uint8).tobytes())
    payloads += [rng.integers(0, 256, 1024).astype(np.uint8).tobytes(), bytes([0, 255] * 512), bytes(64)]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    for s, p in zip(streams, payloads, strict=True):
        assert bytes((v + 128) & 255 for v in flac.decode_any(s)) == p
        head = flac._Stream(s).first
        kinds.add(s[head + 8] >> 1)  # frame 0: sync 2, codes 2, number 1, size 2, CRC-8 1
    assert {8, 9, 10, 11, 12} <= kinds


def test_decontamination_finds_short_items():
    items = [(1, "Yes!"), (2, "alpha beta"), (3, "one two three four"), (4, "five six seven eight nine"), (5, "a b c d e f g"), (6, "日本語")]
    texts = ["yes and, yes", "so alpha; BETA", "alpha x beta", "one two three four", "one two three x", "five six x eight nine", "five six x eight x", "z a b c d e f g z", "a b c e f g", "日本語 です", "yesterday", ""]
    h, n, _, _ = shingles.word_hashes(*shingles.text_bytes(pa.array(texts)), shingles.PUNCTUATION)
    index = decontamination.Index(items)
    got = {(d, index.ids[x]): v for (d, x), v in index.search(h, n).items()}
    assert got == {(0, 1): (0, 1), (1, 2): (0, 3), (3, 3): (0, 4), (5, 4): (1, 5), (7, 5): (0, 8), (8, 5): (1, 6), (9, 6): (0, 1)}
    assert decontamination.Index(items[:1]).search(h[:1], np.array([1])) == {(0, 0): (0, 1)}


def test_decontamination_of_pairs_too_far_apart():
    item = [f"w{i}" for i in range(20)]
    text = " ".join(w if i % 4 else w + " x x x x x x x x" for i, w in enumerate(item))
    h, n, _, _ = shingles.word_hashes(*shingles.text_bytes(pa.array([text, "", "x", text])), shingles.PUNCTUATION)
    assert decontamination.Index([(1, " ".join(item))]).search(h, n) == {}


def test_chat_folds_events(spark):
    log = [
        (1, 1, "start", 0, "user", "He"), (1, 2, "delta", 0, None, "llo"), (1, 3, "start", 1, "assistant", None), (1, 4, "delta", 1, None, "<|im_end|>\n"), (1, 5, "delta", 1, None, "x"),
        (1, 6, "regenerate", 1, None, "y"), (1, 7, "delta", 1, None, "z"), (1, 8, "edit", 0, None, "Hi"), (2, 1, None, None, None, None), (None, 1, "message", 0, "a\nb", "\\<\\s>"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert chat_format.parse(got[1].formatted) == [("user", "Hi"), ("assistant", "yz")]
    assert [got[1].formatted[s.start : s.end] for s in got[1].loss_spans] == ["yz"]
    assert chat_format.parse(got[2].formatted) == [("", "")] and chat_format.parse(got[None].formatted) == [("a\nb", "\\<\\s>")]
    assert chat_format.format_conversations(df.where("false")).count() == 0


@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet="<|>im_startend/s[]INSY\\\n x", max_size=60)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(messages):
    messages = [*messages, ("assistant", "".join(chat_format.CONTROL)), ("user", "<\\s><<s>[[INST]")]
    text, spans = chat_format.render(messages)
    assert chat_format.parse(text) == messages
    assert "".join(chat_format.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in messages if r == "assistant")
    assert not any(c in chat_format.escape("".join(chat_format.CONTROL)) for c in chat_format.CONTROL)


def test_warc(spark):
    rows = [(1, "u", "<p>"), (2, "u\r\nX: y", "<p>"), (3, None, None), (4, "v", ""), (None, "w", "<p>"), (5, "x", "é\r\n\r\nWARC/1.1"), (5, "x", "é\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(0)).withColumn("sha", F.lit(0))
    index, folder = warc.write_archives(df)
    got = sorted(((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, r.payload and bytes(r.payload)) for r in warc.read_archives(index, folder).collect()), key=str)
    assert sorted(got, key=str) == sorted([(1, "response", None, 3, b"<p>"), (2, "revisit", 1, 3, None), (3, "response", None, 0, b""), (4, "revisit", 3, 0, None), (-1, "revisit", 1, 3, None)] + 2 * [(5, "response", None, 14, "é\r\n\r\nWARC/1.1".encode())], key=str)
    assert warc.read_archives(index.where("page_id = 5"), folder).count() == 2
    index, folder = warc.write_archives(df, least=5)
    assert index.where("record_type = 'revisit'").count() == 0
    index, folder = warc.write_archives(df.where("false"))
    assert warc.read_archives(index, folder).count() == 0


def test_warc_ranges_merge():
    got = list(warc.ranges(iter([("a", 0, 10), ("a", 10, 5), ("a", 200_000, 5), ("b", 0, 5)])))
    assert [(g[0], g[1], g[2], len(g[3])) for g in got] == [("a", 0, 15, 2), ("a", 200_000, 200_005, 1), ("b", 0, 5, 1)]


def test_toxicity(spark, docs, none):
    rng = random.Random(2)
    words = ["".join(rng.choices("aeiourstln", k=5)) for _ in range(300)]
    clean = [" ".join(rng.choices(words, k=120)) for _ in range(150)]
    toxic = [" ".join(rng.choices(words, k=60) + ["grumblefuzz"] * 2 + rng.choices(words, k=60)) for _ in range(60)]
    model = toxicity.train(toxic, clean)
    rows = [(i, t) for i, t in enumerate(["plain " + clean[0], "GRUMBLEFUZZ and grumblefuzz " + clean[1], None, ""])]
    got = {r.doc_id: r.score for r in toxicity.score_texts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(5)), model).collect()}
    assert got[1] > 0.7 and max(got[0], got[2], got[3]) < 0.7 and got[2] == got[3]
    assert toxicity.score_texts(docs, model).count() == len(ROWS) and toxicity.score_texts(none, model).count() == 0
    assert {r.score for r in toxicity.score_texts(docs, None).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, None), (5, 0), (None, 1)], "doc_id long, toxic int")
    assert [len(x) for x in toxicity.training_rows(docs, labels)] == [0 if zlib.crc32(b"1") % 3 == 1 else 1, 0]


def test_flac(spark, docs, none):
    got = {(r.doc_id, r.block): r for r in flac.pcm_blocks(flac.to_media(docs)).collect()}
    assert bytes(got[3, 0].pcm) == bytes(64) and got[5, 3].sample_offset == 3 * flac.BLOCK
    assert flac.to_media(none).count() == 0
    rng = np.random.default_rng(1)
    payloads = [bytes(64), bytes([200]) * 64, rng.bytes(64), rng.bytes(5000), bytes(rng.integers(90, 100, 20_000).astype("u1")), np.cumsum(rng.integers(-2, 3, 4096)).astype("u1").tobytes(), flac.payload_of(LONG)]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    for p, s in zip(payloads[:6], streams, strict=False):
        assert bytes((v + 128) & 255 for v in flac.decode_any(s)) == p
        for a, b in ((0, 10), (60, 64), (1000, 1030), (3000, 3001), (0, 10**6), (5, 5)):
            assert flac.decode_range(s, a, b) == p[a:b]
    for at in (len(streams[3]) - 1, len(streams[3]) - 900):
        broken = bytearray(streams[3])
        broken[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])
        with pytest.raises(ValueError):
            flac.decode_any(bytes(broken))


def test_flac_lpc_and_escapes():
    """A stream of another encoder: LPC, two partitions of which one is escaped, wasted bits."""
    bits = []

    def put(v, n):
        bits.extend(v >> (n - 1 - i) & 1 for i in range(n))

    want = [4 * v for v in (3, 5, 7, 9, 11, 13, 15, 18, 20, 22, 24, 26, 28, 30, 32, 34)]
    x = [v // 4 for v in want]
    res = [x[i] - (2 * x[i - 1] - x[i - 2]) for i in range(2, 16)]
    put(0b0, 1), put(32 + 1, 6), put(1, 1), put(0b01, 2)  # LPC of order 2, 2 wasted bits
    for v in x[:2]:
        put(v & 63, 6)
    put(3, 4), put(0, 5), put(2, 4), put(-1 & 15, 4)
    put(0, 2), put(1, 4), put(1, 4)  # method 0, 2 partitions
    for r in res[:6]:
        z = 2 * r if r >= 0 else -2 * r - 1
        put(1, (z >> 1) + 1), put(z & 1, 1)
    put(15, 4), put(3, 5)
    for r in res[6:]:
        put(r & 7, 3)
    bits += [0] * (-len(bits) % 8)
    body = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
    head = bytes([0xFF, 0xF8, 0x60, 0x02, 0, 15])
    frame = head + bytes([flac.crc8(head)]) + body
    data = np.frombuffer(frame + b"\0\0", dtype=np.uint8)
    frame += int(flac.crc16(data, np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 16).to_bytes(8, "big") + bytes(16)
    assert flac.decode_any(b"fLaC\x80\x00\x00\x22" + info + frame) == want


def test_staged_tables_are_released(spark):
    with tagged("t"):
        df = stage(spark.range(3).toDF("a"), "x")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert df.count() == 3 and os.path.isdir(path)
    release(spark, "t")
    assert not os.path.exists(path)


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


def test_words_of_the_thue_morse_kind_stay_apart(spark):
    """Hashes that are polynomials in one base modulo 2^64 give such words one value."""
    import public_tokenizers
    from tokenizers import Tokenizer

    for n in (1024, 2048):
        words = [thue_morse(n), thue_morse(n, "b", "a")]
        h = shingles.word_hashes(*shingles.text_bytes(pa.array([" ".join(words)])))[0]
        assert h[0] != h[1]
        text = " ".join([words[0], "c", "d", "e", "f", words[1], "c", "d", "e", "f", words[0], "c"])
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert jaccard_join.jaccard_components(df).first().n_shingles == len({tuple(text.split()[i : i + 5]) for i in range(8)})
        path = public_tokenizers.path("byte_bpe_50k.json")
        want = np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert Encoder.of(path).encode([text]) == [want] and Encoder.of(path).fast


def test_ids_where_the_fast_way_is_not_known_to_agree(tmp_path):
    """A vocabulary with an entry that its own merges cannot reach is left to the tokenizer; long blanks and added tokens too."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    spec = json.load(open(path))
    a, b = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"][:2])
    spec["model"]["merges"][0], spec["model"]["merges"][1] = b, a
    own = tmp_path / "odd.json"
    own.write_text(json.dumps(spec))
    for p, fast in ((path, True), (str(own), False)):
        e, t = Encoder(p), Tokenizer.from_file(p)
        assert (e.fast is not None) == fast
        for text in ("the then there", "a <|endoftext|> b", "x" + " " * 30_000 + "y", "日本 語 é"):
            assert e.encode([text]) == [np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()]


def test_line_dedup_of_a_document_that_loses_many_lines(spark):
    """Time grows with the lines, not with lines times removed lines."""
    import time

    took = {}
    for n in (2_000, 40_000):
        lines = [f"line {i}" for i in range(n)]
        df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([*lines, "own"])), (3, "\n".join(["a", *lines[5:], "b"]))], "doc_id long, text string")
        start = time.time()
        got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
        took[n] = time.time() - start
        assert got[1].n_removed == 0 and (got[2].text, got[2].n_removed) == ("own", n) and (got[3].text, got[3].n_removed) == ("a\nb", n - 5)
    assert took[40_000] < 20 * took[2_000] + 2


def test_pipeline_stages_with_odd_rows_and_clashing_columns(spark, docs, none, tmp_path):
    import corpus_pipeline as cp

    sf = str(tmp_path)
    spark.createDataFrame([(1, 0), (7, 0), (5, 1)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "an item that no row holds at all in any place")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    odd = docs.withColumns({"n_chars": F.length("text").cast("long"), "n_lines": F.lit(42), "score": F.lit(7.5), "first_id": F.lit("f"), "text_hash": F.lit("h")})
    n, before = {}, odd
    for name, f in cp.STAGES[:-1]:
        out = f(spark, before, sf)
        assert out.columns == odd.columns
        rows = out.collect()
        n[name] = len(rows)
        assert {(r.n_lines, r.score, r.first_id, r.text_hash, r.slot) for r in rows} <= {(42, 7.5, "f", "h", "slot")}
        assert f(spark, before.where("false"), sf).count() == 0
        before = spark.createDataFrame(rows, out.schema)
    kept = sorted(str(r.doc_id) for r in before.collect())
    assert n["toxicity"] in (len(ROWS), len(ROWS) - 1) and {"2", "3", "None"} <= set(kept) and kept.count("7") == 1
    packed = cp.STAGES[-1][1](spark, before, sf).collect()
    assert sorted({str(r.doc_id) for r in packed}) == sorted(set(kept)) and cp.STAGES[-1][1](spark, none, sf).count() == 0


def test_shared_root_needs_a_shared_folder_on_a_cluster():
    from vaultspark.llm import common

    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        common.shared_root(Session())


def test_toxicity_scores_by_a_plain_version(spark):
    """Scores recomputed window by window: two compressors, sorted gains, a logistic function."""
    import math

    rng = random.Random(5)
    words = ["".join(rng.choices("aeiourstln", k=5)) for _ in range(200)]
    clean = [" ".join(rng.choices(words, k=100)) for _ in range(60)]
    toxic = [" ".join([*rng.choices(words, k=50), "snarkwort", *rng.choices(words, k=50)]) for _ in range(30)]
    m = toxicity.train(toxic, clean)
    assert b"snarkwort" in m.toxic and b"snarkwort" not in m.ordinary and len(m.toxic) == len(m.ordinary)
    texts = [*clean[:5], *toxic[:5], "x" * 5000, "Ünï " * 300, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_texts(df, m).collect()}
    for i, text in enumerate(texts):
        raw, gains = (text or "").lower().encode(), []
        for first in (96, 48):
            at = 0
            while at < len(raw):
                end = at + (first if at == 0 else 96)
                if end < len(raw):
                    spaces = [j for j in range(at + (end - at) // 2, end) if raw[j : j + 1] == b" "]
                    end = spaces[-1] if spaces else end
                gains.append(len(toxicity._compressor(m.ordinary).compress(raw[at:end])) - len(toxicity._compressor(m.toxic).compress(raw[at:end])))
                at = end
        top = sorted(gains, reverse=True) + [0] * 6
        n = max(1, len(gains))
        x = [1.0, *top[:4], top[5], sum(gains) / n, sum(g for g in gains if g >= 2) / n]
        x += [math.log1p(v) for v in (*(sum(g >= k for g in gains) for k in (1, 2, 3, 5)), sum(g for g in gains if g >= 4), len(gains))]
        z = sum((v - a) / s * w for v, a, s, w in zip(x, m.mean, m.scale, m.weight, strict=True))
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_cgk_walks_stay_together_where_words_agree():
    """The walk against a plain one, word by word; and the share of steps in which a window at the limit agrees."""
    rng = random.Random(3)
    h = np.array([rng.randrange(1, 2**63) for _ in range(120)], dtype=np.uint64)
    begin, size, step = np.array([-4, 0, 30, 100]), np.array([20, 60, 60, 60]), np.array([11, 70, 119, 50])
    low, high = np.array([0, 0, 30, 40]), np.array([120, 50, 120, 120])
    for r in (0, 7):
        got = decontamination.walk(h, low, high, begin, size, step, r).tolist()
        for w in range(4):
            at, word = int(begin[w]), 0
            for j in range(int(step[w]) + 1):
                word = int(h[at]) if low[w] <= at < high[w] and at < begin[w] + size[w] else 0
                key = int(shingles.mix(np.array([(r << 32) | (j + 1)], dtype=np.uint64))[0])
                at += int(shingles.mix(np.array([(word + key) % 2**64], dtype=np.uint64))[0]) & 1
            assert got[w] == word
    words = [f"w{rng.randrange(500)}" for _ in range(100)]
    index = decontamination.Index([(1, " ".join(words))])
    edited = index.words[0].copy()
    edited[2::5] = np.arange(1, 21, dtype=np.uint64)
    same = 0
    for r in range(200):
        ends = [decontamination.walk(x, np.zeros(200, dtype=int), np.full(200, 100), np.zeros(200, dtype=int), np.full(200, 100), np.arange(200), r) for x in (index.words[0], edited)]
        same += ((ends[0] == ends[1]) & (ends[0] != 0)).mean()
    assert same / 200 > decontamination.AGREE


def test_sharding_with_a_matrix_too_large_to_broadcast(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").alias("doc_id")).repartition(7)
    monkeypatch.setattr(sharding, "PLAN_BYTES", 0)
    got = sharding.shuffle_into_shards(df, 3).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(3) for i in range(334 if s == 0 else 333)] and {r.doc_id for r in got} == set(range(1000))
