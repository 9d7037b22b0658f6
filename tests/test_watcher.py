"""The watcher's state machine, as a table and as a stream."""

import datetime as dt

import pytest

from vaultspark.plans import catalogue
from vaultspark.plans.vault import Vault
from vaultspark.streaming import watcher
from vaultspark.streaming.watcher import WatchConfig, WatchState

C = WatchConfig(debounce=0.4, cooldown=5)


def run(events, config=C, until=1000.0, state=None):
    return [(a, p, to) for a, p, to, _ in (state or WatchState()).run(events, until, config)]


def ev(kind, path, t, to=None, tracker=None):
    return (kind, path, to, tracker, t)


def test_burst_is_one_put_and_a_change_in_cooldown_lands_later():
    got = list(WatchState().run([ev("modify", "a", t) for t in (1, 1.05, 1.1)] + [ev("modify", "a", 3)], 1000, C))
    assert [(a, p) for a, p, _, _ in got] == [("put", "a"), ("put", "a")]
    assert got[0][3] == pytest.approx(1.5) and got[1][3] == pytest.approx(6.5)


def test_rename_then_modify():
    assert run([ev("rename_both", "a", 1, "b"), ev("modify", "b", 1.1)]) == [("move", "a", "b"), ("put", "b", None)]


def test_chained_renames_hold_updates_back():
    got = run([ev("modify", "a", 1), ev("rename_both", "a", 1.1, "b"), ev("modify", "b", 1.2), ev("rename_both", "b", 1.3, "c"), ev("modify", "c", 1.4)])
    assert got == [("move", "a", "b"), ("move", "b", "c"), ("put", "c", None)]


def test_folder_renames_keep_to_whole_components():
    got = run([ev("modify", "docs/a", 1), ev("modify", "docs-old/a", 1), ev("rename_both", "docs", 1.1, "x"), ev("rename_both", "x", 1.2, "y")])
    assert ("put", "y/a", None) in got and ("put", "docs-old/a", None) in got and ("put", "docs/a", None) not in got


def test_pairing_by_tracker_and_in_turn():
    assert run([ev("rename_from", "a", 1, tracker=9), ev("modify", "q", 1.1), ev("rename_to", "b", 1.2, tracker=9)])[0] == ("move", "a", "b")
    assert run([ev("rename_from", "a", 1), ev("rename_from", "b", 1), ev("rename_to", "c", 1.1), ev("rename_to", "d", 1.1)])[:2] == [("move", "a", "c"), ("move", "b", "d")]
    assert run([ev("rename_to", "new", 1)]) == [("put", "new", None)]
    assert run([ev("rename_from", "a", 1, tracker=1), ev("rename_from", "b", 1.1, tracker=1), ev("rename_to", "c", 1.2, tracker=1)])[:2] == [("unbind", "a", None), ("move", "b", "c")]


def test_no_put_while_a_rename_is_open():
    got = list(WatchState().run([ev("modify", "z", 1), ev("rename_from", "a", 1.1, tracker=1)], 1000, C))
    assert got[0][:2] == ("unbind", "a") and got[0][3] == pytest.approx(3.1) and got[1][:2] == ("put", "z")


def test_backoff_doubles_up_to_a_cap():
    assert [watcher.retry_delay(i, WatchConfig(debounce=3)) for i in range(6)] == [3, 6, 12, 24, 30, 30]
    s = WatchState()
    s.failed("a", 10, C)
    s.failed("a", 10.4, C)
    assert s.updates["a"] == [pytest.approx(11.2), 2] and [x[0] for x in run([], state=s)] == ["put"]


def test_state_survives_its_text():
    s = WatchState()
    list(s.run([ev("modify", "a", 1), ev("rename_from", "b", 1, tracker=3)], None, C))
    assert WatchState.load(s.dump()) == s


def test_config_bounds():
    with pytest.raises(ValueError):
        WatchConfig(debounce=61)


def _table(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(r, i, base + dt.timedelta(seconds=t), k, p, to, None) for i, (r, k, p, t, to) in enumerate(rows)], watcher.EVENTS)


ROWS = [("r1", "modify", "a", 0, None), ("r1", "modify", "a", 1, None), ("r1", "rename_both", "a", 2, "b"), ("r2", "create", "x", 0, None), ("r2", "remove", "x", 60, None), ("r1", "modify", "c", 500, None), ("r2", "modify", "y", 500, None)]


def test_stream_equals_replay(spark, tmp_path):
    events = _table(spark, ROWS)
    whole = sorted((r.watch_root, r.seq, r.action, r.path, r.to_path) for r in watcher.replay(events, C).collect())
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = watcher.watch(stream, C).writeStream.format("memory").queryName("acts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.watch_root, r.seq, r.action, r.path, r.to_path) for r in spark.sql("select * from acts").collect())
    # The last puts fall due after the watermark's end; reconciliation or later events bring them.
    assert got and set(got) <= set(whole)


def test_autoingest_runs_a_stream_that_loses_no_action(spark, monkeypatch):
    sf, ran = "/root/testdata/sf0.001", []
    whole = watcher.replay(catalogue._folder_events(spark.read.parquet(f"{sf}/events.parquet")), WatchConfig(debounce=3, cooldown=60)).collect()
    monkeypatch.setattr(watcher, "watch", lambda events, *a, f=watcher.watch: ran.append(events.isStreaming) or f(events, *a))
    got = catalogue.QUERIES["stream_autoingest"](spark, sf).collect()
    assert ran == [True] and whole and sorted(map(repr, got)) == sorted(map(repr, whole))


def test_a_locked_put_is_tried_again(spark):
    class Store:
        def __init__(self):
            self.stored, self.on, self.moved = [], [], []

        def put(self, names):
            self.stored.append(names)

        def track(self, root, names, on=True):
            self.on += names

        def tracked(self, root):
            return spark.createDataFrame([], "name string")

        def move(self, pairs, whole=True):
            self.moved += pairs

    now, locked = [100.0], {"a": 2, "b": 99}

    def read(names):
        for n in names:
            if locked.get(n, 0):
                locked[n] -= len(names) == 1
                raise BlockingIOError(n)
        return names

    acts = spark.createDataFrame([("r", i, "put", p, None, 0.0) for i, p in enumerate("abc")], watcher.ACTIONS)
    store = Store()
    sleep = lambda s: now.__setitem__(0, now[0] + s)
    left = watcher.apply_actions(store, acts, read, "r", WatchConfig(debounce=1), patience=10, clock=lambda: now[0], sleep=sleep)
    assert store.stored == [["c"], ["a"]] and store.on == ["c", "a"]
    assert list(left.updates) == ["b"] and left.updates["b"][1] == 4 and now[0] == pytest.approx(107)
    locked.clear()
    move = spark.createDataFrame([("r", 9, "move", "b", "d", 0.0)], watcher.ACTIONS)
    left = watcher.apply_actions(store, move, read, "r", WatchConfig(debounce=1), left, clock=lambda: now[0], sleep=sleep)
    assert store.moved == [("b", "d")] and store.stored[-1] == ["d"] and not left.updates


def test_actions_and_reconciliation(spark, tmp_path):
    v = Vault.open(spark, str(tmp_path / "v"), sizes=(64, 256, 1024))
    disk = {"b": b"new", "c": b"see", "y": b"y"}

    def read(names):
        return spark.createDataFrame([(n, bytearray(disk[n])) for n in names if n in disk], "name string, content binary")

    v.put(spark.createDataFrame([("a", bytearray(b"old")), ("manual", bytearray(b"m"))], "name string, content binary"))
    v.track("r1", ["a"])
    watcher.apply_actions(v, watcher.replay(_table(spark, ROWS), C), read, "r1")
    assert sorted(r.name for r in v.list_files().collect()) == ["b", "c", "manual"] and v.get("b") == b"new"
    assert [r.version for r in v.versions("b").collect()] == [1, 2]
    import hashlib

    listing = spark.createDataFrame([("b", 3, hashlib.sha256(b"NEW").hexdigest()), ("d", 1, "0")], "name string, size long, content_hash string")
    changes, deletes = watcher.reconcile(v, "r1", listing, complete=True)
    assert {r.name: r.why for r in changes.collect()} == {"b": "hash", "d": "unbound"}
    assert [r.name for r in deletes.collect()] == ["c"]
    for kw in ({"complete": False}, {"complete": True, "renames_pending": True}, {"complete": True, "generation_changed": True}):
        assert watcher.reconcile(v, "r1", listing, **kw)[1].count() == 0


def _service(spark, tmp_path, **more):
    from vaultspark.plans.vault import Vault
    from vaultspark.streaming.service import WatchService

    folder = tmp_path / "watched"
    (folder / "d").mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"one")
    (folder / "d" / "b.txt").write_bytes(b"two")
    (folder / "skip.log1").write_bytes(b"no")
    vault = Vault.open(spark, str(tmp_path / "store"), sizes=(64, 256, 1024))
    return folder, vault, WatchService(vault, str(folder), WatchConfig(debounce=0.2, cooldown=0.2, throttle_ms=0, **more), rules=lambda: ["*.log1"])


def test_service_scans_counts_and_unbinds(spark, tmp_path):
    folder, vault, service = _service(spark, tmp_path)
    s = service.scan_once()
    assert (s.phase, s.scanned_files, s.saved_files, s.removed_files, s.last_error) == ("watching", 2, 2, 0, None) and s.last_sync_at
    (folder / "a.txt").write_bytes(b"eno")  # of the same size
    (folder / "d" / "b.txt").unlink()
    vault.put(spark.createDataFrame([("by hand", bytearray(b"x"))], "name string, content binary"))
    s = service.scan_once()
    assert (s.scanned_files, s.saved_files, s.removed_files) == (3, 3, 1)
    assert vault.get("a.txt") == b"eno" and sorted(r.name for r in vault.names().collect()) == ["a.txt", "by hand"]
    (folder / "a.txt").unlink()
    folder.joinpath("d").rmdir()
    folder.joinpath("skip.log1").unlink()
    folder.rmdir()
    s = service.scan_once()  # what cannot be listed deletes nothing
    assert s.phase == "degraded" and s.last_error and s.removed_files == 1 and vault.names().count() == 2


def test_service_runs_takes_events_and_retries(spark, tmp_path):
    import time

    from vaultspark.functions.errors import AlreadyExists, WouldBlock
    from vaultspark.streaming.service import WatchService

    folder, vault, service = _service(spark, tmp_path)

    def until(what, seconds=60):
        end = time.time() + seconds
        while not what() and time.time() < end:
            time.sleep(0.05)
        assert what()

    service.start()
    try:
        with pytest.raises(AlreadyExists):
            service.scan_once()
        until(lambda: service.status().saved_files == 2 and service.status().phase == "watching")
        put, busy = vault.put_paths, [True]

        def locked(files):
            if busy[0]:
                raise WouldBlock("a.txt is in use")
            return put(files)

        vault.put_paths = locked
        (folder / "a.txt").write_bytes(b"later")
        service.notify("modify", "a.txt")
        until(lambda: service.status().phase == "degraded")
        assert service.status().last_error == "a.txt is in use" and service.status().pending_files == 1
        busy[0] = False
        until(lambda: service.status().saved_files == 3 and service.status().phase == "watching")
        assert vault.get("a.txt") == b"later" and service.status().last_error is None
        (folder / "d").rename(folder / "e")
        service.notify("rename_both", "d", "e")
        until(lambda: "e/b.txt" in {r.name for r in vault.names().collect()})
    finally:
        service.stop()
    assert service.status().phase == "stopped"
    with pytest.raises(ValueError):
        WatchService(vault, str(tmp_path))


def test_asked_settings_have_lower_bounds():
    for bad in ((0, 60, 0), (3, 0, 0), (61, 60, 0), (3, 60, 5001)):
        with pytest.raises(ValueError):
            WatchConfig.asked(*bad)
    assert WatchConfig.asked(1, 1, 5000).debounce == 1
