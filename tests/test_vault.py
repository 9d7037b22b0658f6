"""The vault's invariants, one test each."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from vaultspark.functions.errors import AlreadyExists, AuthenticationError, Corrupt, InvalidName, NotEncrypted, NotFound, PasswordRequired
from vaultspark.plans.vault import Vault
from vaultspark.sources import files as sources

SIZES = (64, 256, 1024)
A, B = random.Random(1).randbytes(4000), random.Random(2).randbytes(2500)


def put(v, *rows):
    return v.put(v.spark.createDataFrame([(n, bytearray(c), i) for i, (n, c) in enumerate(rows)], "name string, content binary, seq long"))


@pytest.fixture
def vault(spark, tmp_path):
    return Vault.open(spark, str(tmp_path / "v"), sizes=SIZES)


def names(v):
    return sorted(r.name for r in v.list_files().collect())


def test_put_twice_makes_versions_of_one_object(vault):
    put(vault, ("a.txt", A), ("a.txt", A + B))
    put(vault, ("a.txt", A))
    got = vault.versions("a.txt").collect()
    assert [r.version for r in got] == [1, 2, 3] and len({r.object_id for r in got}) == 1
    assert vault.get("a.txt", 2) == A + B and vault.get("a.txt") == A
    assert vault.get(got[0].object_id) == A and vault.get(got[1].manifest_id) == A + B
    with pytest.raises(NotFound):
        vault.get("a.txt", 9)
    with pytest.raises(NotFound):
        vault.get("none")


def test_identical_files_share_chunks(vault):
    first = {r.name: r for r in put(vault, ("x", A), ("y", A), ("empty", b"")).collect()}
    s = vault.stats()
    assert abs(s["dedup_ratio"] - 2) < 0.01 and abs(s["space_savings_pct"] - 50) < 1
    assert first["x"].new_chunks + first["y"].new_chunks == first["x"].chunk_count and first["empty"].chunk_count == 0
    assert vault.get("empty") == b""


def test_prune_and_rollback_number_on(vault):
    for i in range(5):
        put(vault, ("d", A + bytes([i])))
    assert vault.prune(2, "d") == 3 and vault.prune(2, "d") == 0 and vault.prune(1, "none") == 0
    put(vault, ("d", B))
    assert vault.rollback("d", 4) == 7
    assert [r.version for r in vault.versions("d").collect()] == [4, 5, 6, 7]
    assert vault.get("d") == A + bytes([3])


def test_snapshot_pins_content(vault):
    put(vault, ("f", A), ("g", B))
    assert vault.snapshot(" s ") == 2
    put(vault, ("f", B))
    assert vault.delete("g") and not vault.delete("g")
    assert {r.name: r.version for r in vault.snapshot_entries("s").collect()} == {"f": 1, "g": 1}
    with pytest.raises(AlreadyExists):
        vault.snapshot("s")
    assert vault.gc()["chunks_reclaimed"] == 0
    m = vault.snapshot_entries("s").where("name = 'g'").first().manifest_id
    assert vault.get(m) == B
    assert vault.delete_snapshot("s") and not vault.delete_snapshot("s")


def test_shared_chunk_survives_until_the_last_reference(vault):
    put(vault, ("a", A + B), ("b", A))
    vault.delete("a")
    stats = vault.gc()
    assert stats["chunks_reclaimed"] > 0 and vault.get("b") == A
    assert vault.gc()["chunks_reclaimed"] == 0
    vault.delete("b")
    vault.gc()
    assert vault.stats()["chunks"] == 0


def test_unbind_keeps_history(vault):
    put(vault, ("a", A))
    o = vault.versions("a").first().object_id
    assert vault.unbind("a")
    vault.gc()
    assert names(vault) == [] and vault.get(o) == A


def test_rename_overwrites_and_moves_whole_components(vault):
    put(vault, ("docs/a", A), ("docs/n/b", B), ("docs-old/a", A), ("x", B))
    assert vault.move([("docs", "moved")]) == 2
    assert names(vault) == ["docs-old/a", "moved/a", "moved/n/b", "x"]
    assert vault.rename("x", "moved/a") and not vault.rename("x", "y")
    assert names(vault) == ["docs-old/a", "moved/a", "moved/n/b"] and vault.get("moved/a") == B
    assert vault.move([("docs-old/a", "moved/a"), ("moved/a", "docs-old/a")], whole=False) == 2
    assert vault.get("docs-old/a") == B and vault.get("moved/a") == A
    assert vault.delete_prefix("moved") == 2
    with pytest.raises(InvalidName):
        vault.rename("docs-old/a", "../up")


def test_bad_names_are_refused(vault):
    with pytest.raises(InvalidName):
        put(vault, ("ok", A), ("a/../b", A))
    assert names(vault) == []


def test_missing_manifest_stops_gc(vault):
    put(vault, ("a", A), ("b", B))
    lost = vault.versions("a").first().manifest_id
    df = vault.state("manifests").where(F.col("manifest_id") != lost)
    old = vault.log.files()["manifests"]
    add = vault._write("manifests", df)
    vault.log.commit(vault.log.last() + 1, "damage", [{"op": "remove", "table": "manifests", "path": p} for p in old] + [add])
    vault.delete("b")
    with pytest.raises(Corrupt):
        vault.gc()
    assert vault.stats()["chunks"] > 0 and not vault.fsck()["healthy"]


@pytest.mark.parametrize("what", ["payload", "gone"])
def test_damage_is_found(vault, what):
    put(vault, ("a", A), ("b", B))
    assert vault.fsck()["healthy"]
    chunks, files = vault.events("chunks"), vault.log.files()["chunks"]
    victim = chunks.orderBy("chunk_id").first().chunk_id
    hit = F.col("chunk_id") == victim
    bad = chunks.where(~hit) if what == "gone" else chunks.withColumn("payload", F.when(hit, F.concat(F.lit(b"x"), F.substr("payload", F.lit(2)))).otherwise(F.col("payload")))
    add = vault._write("chunks", bad)
    vault.log.commit(vault.log.last() + 1, "damage", [{"op": "remove", "table": "chunks", "path": p} for p in files] + [add])
    report = vault.fsck()
    assert not report["healthy"] and (report["missing_chunks"] if what == "gone" else report["bad_crc"]) == 1
    broken = [n for n, c in (("a", A), ("b", B)) if _fails(vault, n)]
    assert len(broken) == 1


def _fails(v, name):
    try:
        v.get(name)
        return False
    except Exception:
        return True


def test_range_reads(vault):
    put(vault, ("a", A))
    for off, n in ((0, 4000), (0, 10), (1000, 1500), (3990, 10), (3990, 100), (4000, 5), (9999, 5), (7, 0)):
        assert vault.read_range("a", off, n) == A[off : off + n]


def test_views(vault):
    put(vault, ("d/f.txt", A), ("top", B))
    put(vault, ("d/f.txt", B))
    vault.snapshot("s")
    got = {r.path: (r.kind, r.symlink_target) for r in vault.vfs().collect()}
    assert got["/history/d/f.txt@latest"] == ("symlink", "f.txt@v2") and "/history/d/f.txt@v1" in got
    assert "/current/top" in got and "/snapshots/s/d/f.txt" in got


def test_writers_at_once_leave_no_gap(spark, tmp_path):
    v = Vault.open(spark, str(tmp_path / "c"), sizes=SIZES)
    errors = []

    def write(i):
        try:
            put(Vault.open(spark, str(tmp_path / "c"), sizes=SIZES), ("n", bytes([i]) * 100))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and [r.version for r in v.versions("n").collect()] == list(range(1, 9))


def test_replay_is_idempotent_and_torn_commits_do_not_count(vault):
    put(vault, ("a", A))
    n = vault.log.last()
    with open(f"{vault.root}/_log/{n + 1:020d}.json", "w") as f:
        f.write('{"lsn": 3, "actions": [{"op"')
    again = Vault.open(vault.spark, vault.root, sizes=SIZES)
    assert again.get("a") == A and again.log.files() == vault.log.files()
    put(again, ("a", B))
    assert [r.version for r in again.versions("a").collect()] == [1, 2]


def test_encrypted(spark, tmp_path):
    root = str(tmp_path / "e")
    v = Vault.open(spark, root, "long enough", sizes=SIZES)
    put(v, ("a", A), ("b", A))
    assert v.stats()["dedup_ratio"] >= 1.9 and v.get("a") == A
    assert A[:200] not in b"".join(bytes(r.payload) for r in v.events("chunks").collect())
    v.delete("b")
    v.gc()
    assert v.fsck()["healthy"]
    assert Vault.open(spark, root, "long enough", sizes=SIZES).get("a") == A
    with pytest.raises(AuthenticationError):
        Vault.open(spark, root, "another one")
    with pytest.raises(PasswordRequired):
        Vault.open(spark, root)


def test_plain_store_refuses_a_passphrase(vault):
    with pytest.raises(NotEncrypted):
        Vault.open(vault.spark, vault.root, "long enough")


def test_shares_tracking_config_and_optimize(vault):
    put(vault, ("a", A))
    i, token = vault.add_share("a", 100)
    j, _ = vault.add_share("b")
    assert {r.id for r in vault.shares(99).collect()} == {i, j} and {r.id for r in vault.shares(100).collect()} == {j}
    vault.revoke_share(j)
    vault.track("r", ["x", "y"])
    vault.track("r", ["y"], on=False)
    assert [r.name for r in vault.tracked("r").collect()] == ["x"] and vault.watch_config() == (None, 3, 60, 10)
    vault.save_watch_config("r", 5, 6, 7)
    assert vault.watch_config() == ("r", 5, 6, 7)
    vault.optimize()
    assert vault.get("a") == A and vault.shares(99).count() == 1


def test_folder_round_trip(spark, vault, tmp_path):
    src = tmp_path / "src"
    for name, data in (("a.txt", A), ("sub/b.bin", B), ("node_modules/x.js", B), (".hidden/y", B), ("t.tmp", B)):
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_bytes(data)
    assert sorted(r.name for r in sources.walk_folder(spark, str(src)).collect()) == ["a.txt", "sub/b.bin", "t.tmp"]
    vault.put(sources.read_stable(spark, str(src)).where("name in ('a.txt', 'sub/b.bin')"))
    vault.snapshot("s")
    entries = vault.snapshot_entries("s")
    got = entries.join(vault.contents(entries), "manifest_id").select("name", "content")
    out = str(tmp_path / "out")
    assert sources.extract(got, out).count() == 2
    assert open(f"{out}/a.txt", "rb").read() == A and open(f"{out}/sub/b.bin", "rb").read() == B
    assert sources.physical_bytes(spark, out) == len(A) + len(B)
    z = sources.zip_folders(got.withColumn("folder", F.lit("all"))).first()
    import io
    import zipfile

    assert sorted(zipfile.ZipFile(io.BytesIO(bytes(z.zip))).namelist()) == ["a.txt", "sub/b.bin"]


def test_failed_extract_leaves_nothing(spark, vault, tmp_path):
    put(vault, ("a", A))
    bad = vault.contents(vault.versions("a").select(F.lit("0" * 64).alias("manifest_id"))).select(F.lit("a").alias("name"), "content")
    out = str(tmp_path / "out")
    with pytest.raises(Exception):
        sources.extract(bad, out).collect()
    assert not os.path.exists(out) or os.listdir(out) == []


def test_command_line(spark, tmp_path, capsys):
    from vaultspark.__main__ import main

    store, folder = str(tmp_path / "s"), tmp_path / "in"
    (folder / "d").mkdir(parents=True)
    (folder / "d" / "a.txt").write_bytes(A)
    go = lambda *a: main(["--store", store, *a], spark)
    assert go("init") == 0 and go("ingest", str(folder), "--label", "s") == 0
    assert go("put", str(folder / "d" / "a.txt"), "--name", "b") == 0
    capsys.readouterr()
    assert go("list") == 0 and [x.split("\t")[0] for x in capsys.readouterr().out.splitlines()] == ["b", "d/a.txt"]
    assert go("get", "b", str(tmp_path / "o")) == 0 and (tmp_path / "o").read_bytes() == A
    assert go("snapshot", "restore", "--label", "s", "--to", str(tmp_path / "r")) == 0 and (tmp_path / "r" / "d" / "a.txt").read_bytes() == A
    assert go("watch", str(folder), "--once") == 0 and "phase='watching'" in capsys.readouterr().out
    assert go("rm", "b") == 0 and go("rm", "b") == 1 and go("get", "b", "x") == 1 and go("fsck") == 0


def test_a_writer_that_pauses_inside_a_commit_loses_nothing(spark, tmp_path):
    root = str(tmp_path / "p")
    slow, fast = (Vault.open(spark, root, sizes=SIZES) for _ in range(2))
    put(slow, ("n", A))
    inside, go = threading.Event(), threading.Event()

    def wait(name):
        if name.endswith(".json") and not inside.is_set():
            inside.set()
            assert go.wait(60)

    slow.log._before_publishing = wait
    t = threading.Thread(target=put, args=(slow, ("n", B)))
    t.start()
    assert inside.wait(60)
    put(fast, ("n", A + B))
    assert [r.version for r in fast.versions("n").collect()] == [1, 2]
    go.set()
    t.join()
    assert [r.version for r in fast.versions("n").collect()] == [1, 2, 3] and fast.get("n") == B and fast.get("n", 2) == A + B
    fast.gc(grace=0)
    assert fast.fsck()["healthy"] and not [f for f in os.listdir(f"{root}/_log") if f.endswith(".part")]


def test_a_missing_commit_is_damage(vault):
    put(vault, ("a", A))
    put(vault, ("a", B))
    os.remove(f"{vault.root}/_log/{vault.log.last() - 1:020d}.json")
    with pytest.raises(Corrupt):
        vault.get("a")


def _stored(root):
    return [os.path.join(d, f) for d, _, files in os.walk(root) for f in files]


def test_encrypted_vaults_hold_no_plain_bytes(spark, tmp_path):
    import pyarrow.parquet as pq

    v = Vault.open(spark, str(tmp_path / "e"), "long enough", sizes=SIZES)
    src = tmp_path / "b.bin"
    src.write_bytes(B)
    seen = []
    keep = v._drop
    v._drop = lambda path: (seen.extend(_plain(f"{v.root}/{path}")), keep(path))  # staging, just before it goes

    def _plain(folder):
        out = []
        for f in _stored(folder):
            if f.endswith(".parquet"):
                t = pq.read_table(f, partitioning=None)
                out += [x for c in t.column_names if t.schema.field(c).type == "binary" for x in t[c].to_pylist() if x]
        return out

    put(v, ("a", A))
    v.put_paths(spark.createDataFrame([("b", str(src))], "name string, path string"))
    assert v.get("a") == A and v.get("b") == B and seen
    everything = b"".join(seen + _plain(v.root))
    assert not any(data[i : i + 40] in everything for data in (A, B) for i in range(0, len(data) - 40, 97))
    assert not os.path.exists(f"{v.root}/data/_staging") or not os.listdir(f"{v.root}/data/_staging")


def test_gc_gives_bytes_back(spark, vault):
    put(vault, ("a", os.urandom(50_000)), ("b", B))
    vault.delete("a")
    before = sources.physical_bytes(spark, f"{vault.root}/data")
    vault.gc()
    assert sources.physical_bytes(spark, f"{vault.root}/data") > before  # what was swept stays for the grace period
    out = vault.gc(grace=0)
    assert out["bytes_deleted"] > 50_000 and sources.physical_bytes(spark, f"{vault.root}/data") < before - 50_000
    assert vault.get("b") == B and vault.fsck()["healthy"] and vault.vacuum(0)["folders_deleted"] == 0


def test_files_are_put_and_written_in_blocks(spark, vault, tmp_path, monkeypatch):
    big = os.urandom(300_000) + b"tail" * 1000
    for name, data in (("big", big), ("empty", b""), ("small", A)):
        (tmp_path / name).write_bytes(data)
    df = spark.createDataFrame([(n, str(tmp_path / n)) for n in ("big", "empty", "small")], "name string, path string")
    got = {r.name: r for r in vault.put_paths(df).collect()}
    assert got["big"].size_bytes == len(big) and got["empty"].chunk_count == 0 and got["small"].version == 1
    put(vault, ("whole", big))
    assert {r.chunk_id for r in vault.events("manifest_chunks").collect()} and vault.resolve("whole") == vault.resolve("big")
    again = vault.put_paths(df.where("name = 'big'")).first()
    assert again.version == 2 and again.new_chunks == 0 and vault.get("big") == big
    vault.snapshot("s")
    assert vault.restore("s", str(tmp_path / "out")) == 4
    assert (tmp_path / "out" / "big").read_bytes() == big and (tmp_path / "out" / "empty").read_bytes() == b""


def test_a_file_that_never_rests_is_an_error(spark, vault, tmp_path, monkeypatch):
    f = tmp_path / "busy"
    f.write_bytes(A)
    os.utime(f, (1, 1))
    rows = sources._path_chunker(SIZES)

    class Moving(sources.cdc.StreamChunker):
        def feed(self, block):
            os.utime(f, None)
            return super().feed(block)

    monkeypatch.setattr(sources.cdc, "StreamChunker", Moving)
    import pyarrow as pa

    out = [r for b in rows([pa.RecordBatch.from_arrays([pa.array(["busy"]), pa.array([0]), pa.array([str(f)])], ["name", "seq", "path"])]) for r in b.to_pylist()]
    assert [r["attempt"] for r in out if r["ordinal"] == -1] == [0] and {r["attempt"] for r in out} == {0, 1, 2, 3}


def test_read_ranges_and_delete_by_id(vault, spark):
    put(vault, ("a", A), ("b", B), ("e", b""))
    asked = [("a", 0, 10), ("a", 1000, 1500), ("a", 3990, 100), ("a", 9999, 5), ("b", 7, 0), ("e", 0, 5), ("none", 0, 5)]
    got = {(r.name, r.offset, r.size): bytes(r.bytes) for r in vault.read_ranges(spark.createDataFrame(asked, "name string, offset long, size long")).collect()}
    assert got == {(n, o, s): d[o : o + s] for n, o, s in asked if (d := {"a": A, "b": B, "e": b""}.get(n)) is not None}
    m, o = vault.resolve("a"), vault.versions("a").first().object_id
    with pytest.raises(Corrupt):
        vault.delete_manifest(m)
    assert vault.delete_object(o) and not vault.delete_object(o) and sorted(r.name for r in vault.names().collect()) == ["a", "b", "e"]
    assert sorted(r.name for r in vault.list_files().collect()) == ["b", "e"]
    assert vault.delete_manifest(m) and not vault.delete_manifest(m)
    vault.gc(grace=0)
    assert vault.fsck()["healthy"] and vault.get("b") == B
