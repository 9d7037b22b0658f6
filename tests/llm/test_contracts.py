"""The contract queries against brute force on the smallest tables, and the queries with SQL against DuckDB."""

import base64
import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vaultspark.llm import registry

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, duck, rows, name):
    assert rows(registry.queries()[name](spark, SF)) == duck(registry.oracle_sql()[name])


def test_op1(spark, docs):
    got = run(spark, "op1_sharding")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def shingles(text, k=5):
    w = re.findall("[^\x20\x09-\x0d]+", text.translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(sets):
    """Smallest id reachable by links, by brute force over ids that share a shingle."""
    holders, up, shared = defaultdict(list), {}, Counter()

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i in sorted(sets):
        for s in sets[i]:
            for j in holders[s]:
                shared[j, i] += 1
            holders[s].append(i)
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_op2(spark, docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    want = groups(sets)
    assert any(i != g for i, g in want.items())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op2_jaccard_join")} == {i: (len(sets[i]), want[i]) for i in docs}


def test_op4(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, places = defaultdict(list), defaultdict(list)
    for r in run(spark, "op4_packing"):
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert sorted(got) == sorted(docs)
    total = 0
    for i, text in docs.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        at, total = 0, total + len(ids)
        for k, p in enumerate(sorted(got[i], key=lambda r: r.piece)):
            assert (p.piece, p.start) == (k, at) and (k == 0 or p.length == 1024) and p.length <= 1024
            assert zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids) and (len(got[i]) == 1 or len(ids) > 1024)
    for spans in places.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 1024
    assert len(places) <= -(-total // 1024) * 1.02 + 1


def test_op6_finds_every_exact_passage(spark, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    words = lambda s: re.findall(r"[a-z0-9\x80-\U0010ffff]+", s.translate(FOLD))
    want = set()
    for i, text in docs.items():
        joined = " " + " ".join(words(text)) + " "
        want |= {(i, k) for k, b in items.items() if len(words(b)) >= 8 and f" {' '.join(words(b))} " in joined}
    got = {(r.doc_id, r.item_id): r.edits for r in run(spark, "op6_decontamination")}
    assert want and want == {k for k, e in got.items() if e == 0} and all(e <= 0.2 * len(words(items[k])) for (_, k), e in got.items())


def test_op7(spark):
    turns = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in run(spark, "op7_chat_format")}
    assert sorted(got) == sorted(turns)
    for i, told in turns.items():
        loss = "".join(t for r, t in told if r == "assistant")
        r = got[i]
        assert (r.n_turns, r.loss_chars) == (len(told), len(loss)) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in told).encode()).hexdigest()


def test_op8(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for r in run(spark, "op8_warc"):
        p = pages.pop(r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[p] == r.page_id else ("revisit", first[p]))
    assert not pages


def test_op9_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in registry.queries()["op9_toxicity"](spark, sf).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    told = [(got[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    wins = [(a > b) + 0.5 * (a == b) for a, x in told if x for b, y in told if not y]
    assert sum(wins) / len(wins) > 0.85


def test_op10(spark, docs):
    seen = {}
    for r in run(spark, "op10_flac_media"):
        raw = docs[r.doc_id].encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert seen.setdefault(p, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert len(seen) == len(set(docs.values()))


def test_pipeline(spark):
    """The stages against plain versions of their decisions."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, docs
    stages = {}
    for name, f in cp.STAGES[:-1]:
        out = f(spark, out, SF)
        assert out.columns == columns
        kept = out.collect()
        stages[name], out = {r.doc_id: r.text for r in kept}, spark.createDataFrame(kept, docs.schema)
    lines, one, clean = stages["line_dedup"], stages["jaccard_join"], stages["decontamination"]
    windows = Counter()
    for t in lines.values():
        ls = t.split("\n")
        windows.update({tuple(ls[i : i + 3]) for i in range(len(ls) - 2)} if len(ls) > 2 else set())
    before = Counter(w for t in stages["toxicity"].values() for w in {tuple(t.split("\n")[i : i + 3]) for i in range(len(t.split("\n")) - 2)})
    assert sum(v > 1 for v in windows.values()) < max(1, sum(v > 1 for v in before.values()))
    want = groups({i: shingles(t) for i, t in lines.items()})
    assert set(one) == {i for i, g in want.items() if i == g}
    assert set(clean) <= set(one) and all(clean[i] == one[i] for i in clean)
    packed = cp.STAGES[-1][1](spark, out, SF).collect()
    assert {r.doc_id for r in packed} == set(clean)
