"""Folder events to vault actions: debounce, cooldown, rename pairing, back-off, reconciliation.

:class:`WatchState` is the state machine of one watch root. Events of a root are applied in
order of (ts, event_id); renames hold back all updates of their root, so state is keyed by root, and
roots run in parallel. :func:`watch` runs it as a stateful stream with event-time
timers; :func:`replay` runs it over a finished table; both give rows of actions.
Missed events are repaired by :func:`reconcile`.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vaultspark.functions.errors import Conflict
from vaultspark.operators import relops

#: Fixed value: seconds that a rename's first half waits for its second.
RENAME_TIMEOUT = 2.0
#: Bounds of the back-off in seconds.
BACKOFF_LEAST, BACKOFF_MOST = 0.05, 30.0
EVENTS = "watch_root string, event_id long, ts timestamp, kind string, path string, to_path string, tracker long"
ACTIONS = "watch_root string, seq long, action string, path string, to_path string, at double"


@dataclass(frozen=True)
class WatchConfig:
    debounce: float = 3.0
    cooldown: float = 60.0
    throttle_ms: int = 10
    reconcile: float = 3600.0

    def __post_init__(self):
        if not (0 <= self.debounce <= 60 and 0 <= self.cooldown <= 3600 and 0 <= self.throttle_ms <= 5000):
            raise ValueError("debounce is up to 60 s, cooldown up to 3600 s, throttle up to 5000 ms")

    @classmethod
    def asked(cls, debounce: int = 3, cooldown: int = 60, throttle_ms: int = 10) -> WatchConfig:
        """The settings that a user may ask for: a second at least of debounce and of cooldown."""
        if not (1 <= debounce <= 60 and 1 <= cooldown <= 3600 and 0 <= throttle_ms <= 5000):
            raise ValueError("debounce is 1 to 60 s, cooldown 1 to 3600 s, throttle up to 5000 ms")
        return cls(debounce, cooldown, throttle_ms)


@dataclass
class WatchState:
    """Pending work of one root. ``updates``: path -> [due, back-off step]."""

    updates: dict[str, list[float]] = field(default_factory=dict)
    renames: list[list[str | None]] = field(default_factory=list)
    tracked_from: dict[str, list] = field(default_factory=dict)
    untracked_from: list[list] = field(default_factory=list)
    synced: dict[str, float] = field(default_factory=dict)
    generation: int = 0
    seq: int = 0

    # Events.

    def receive(self, kind: str, path: str, to: str | None, tracker: int | None, now: float, config: WatchConfig) -> None:
        self.generation += 1
        self.expire(now)
        if kind == "rename_both":
            self.renames.append([path, to])
        elif kind == "rename_from":
            if tracker is None:
                self.untracked_from.append([path, now])
            else:
                old = self.tracked_from.pop(str(tracker), None)
                if old:
                    self.renames.append([old[0], None])
                self.tracked_from[str(tracker)] = [path, now]
        elif kind == "rename_to":
            if tracker is not None:
                first = self.tracked_from.pop(str(tracker), None)
            else:
                first = self.untracked_from.pop(0) if self.untracked_from else None
            if first:
                self.renames.append([first[0], path])
            else:
                self.updates[path] = [now + config.debounce, 0]
        elif kind == "remove":
            self.renames.append([path, None])
        elif kind in ("create", "modify"):
            self.updates[path] = [now + config.debounce, 0]

    def expire(self, now: float) -> None:
        """First halves that waited too long are removals."""
        for key in [k for k, (_, t) in self.tracked_from.items() if now - t >= RENAME_TIMEOUT]:
            self.renames.append([self.tracked_from.pop(key)[0], None])
        while self.untracked_from and now - self.untracked_from[0][1] >= RENAME_TIMEOUT:
            self.renames.append([self.untracked_from.pop(0)[0], None])

    def next_time(self) -> float | None:
        """When something falls due if no event comes."""
        waits = [t + RENAME_TIMEOUT for _, t in [*self.tracked_from.values(), *self.untracked_from]]
        if not waits:
            waits = [due for due, _ in self.updates.values()]
        return min(waits, default=None)

    # Work.

    def advance(self, now: float, config: WatchConfig) -> Iterator[tuple[str, str, str | None, float]]:
        """What is to be done at ``now``: (action, path, to_path, at), action put, move or unbind."""
        self.expire(now)
        for old, new in self.renames:
            yield from self._rename(old, new, now, config)
        self.renames = []
        if self.tracked_from or self.untracked_from:
            return
        for path, (due, step) in sorted(self.updates.items(), key=lambda x: (x[1][0], x[0])):
            if due > now or path not in self.updates:
                continue
            del self.updates[path]
            last = self.synced.get(path)
            if last is not None and now - last < config.cooldown:
                # A change in the cooldown is put off, never lost.
                self.updates[path] = [last + config.cooldown, step]
                continue
            self.synced[path] = now
            yield "put", path, None, now

    def _rename(self, old: str, new: str | None, now: float, config: WatchConfig):
        below = lambda p: p == old or p.startswith(old + "/")
        if new is None:
            for p in [p for p in self.updates if below(p)]:
                del self.updates[p]
            yield "unbind", old, None, now
            return
        for table in (self.updates, self.synced):
            for p in [p for p in table if below(p)]:
                value = table.pop(p)
                to = new + p[len(old) :]
                if table is self.updates:
                    value = [max(value[0], now + config.debounce), value[1]]
                table[to] = value
        self.updates.setdefault(new, [now + config.debounce, 0])
        yield "move", old, new, now

    def failed(self, path: str, now: float, config: WatchConfig) -> None:
        """A put met a lock: try again, each time after twice as long."""
        step = self.updates.get(path, [0, 0])[1]
        self.synced.pop(path, None)
        self.updates[path] = [now + retry_delay(int(step), config), step + 1]

    def run(self, events: list[tuple], until: float | None, config: WatchConfig) -> Iterator[tuple[str, str, str | None, float]]:
        """Apply events (kind, path, to, tracker, ts), in order, and the timers between them; then timers up to ``until``."""
        for kind, path, to, tracker, ts in events:
            yield from self._timers(ts, config, before=True)
            self.receive(kind, path, to, tracker, ts, config)
            yield from self.advance(ts, config)
        if until is not None:
            yield from self._timers(until, config, before=False)

    def _timers(self, until: float, config: WatchConfig, before: bool):
        while (t := self.next_time()) is not None and (t < until if before else t <= until):
            waiting = (len(self.updates), json.dumps(self.updates, sort_keys=True), len(self.tracked_from), len(self.untracked_from))
            yield from self.advance(t, config)
            if waiting == (len(self.updates), json.dumps(self.updates, sort_keys=True), len(self.tracked_from), len(self.untracked_from)):
                break

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> WatchState:
        return cls(**json.loads(text))


def retry_delay(step: int, config: WatchConfig) -> float:
    return min(min(max(config.debounce, BACKOFF_LEAST), BACKOFF_MOST) * 2**step, BACKOFF_MOST)


def _rows(root: str | None, state: WatchState, found) -> list[tuple]:
    out = []
    for action, path, to, at in found:
        state.seq += 1
        out.append((root, state.seq, action, path, to, at))
    return out


_COLUMNS = ["watch_root", "seq", "action", "path", "to_path", "at"]


def _events(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf.sort_values(["us", "event_id"])
    none = lambda x: None if x is None or x != x else x
    return [(r.kind, r.path, none(r.to_path), None if none(r.tracker) is None else int(r.tracker), r.us / 1e6) for r in pdf.itertuples()]


def watch(events: DataFrame, config: WatchConfig = WatchConfig(), lateness: str = "5 seconds") -> DataFrame:
    """Actions of a stream of events; the watermark drives the timers.

    Events later than ``lateness`` are left to reconciliation.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w = WatchState.load(state.get[0]) if state.exists else WatchState()
        frames = list(batches)
        got = _events(pd.concat(frames)) if frames and not state.hasTimedOut else []
        mark = state.getCurrentWatermarkMs() / 1000
        rows = _rows(key[0], w, w.run(got, mark if mark > 0 else None, config))
        state.update((w.dump(),))
        due = w.next_time()
        if due is not None:
            state.setTimeoutTimestamp(max(int(due * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=_COLUMNS)

    keyed = events.withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts")).groupBy("watch_root")
    return keyed.applyInPandasWithState(step, ACTIONS, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def closing(events: DataFrame, config: WatchConfig) -> DataFrame:
    """For each root one event of no kind, so late that all that waits falls due before it."""
    wait = config.debounce + config.cooldown + RENAME_TIMEOUT + 1
    last = events.groupBy("watch_root").agg(F.max("event_id").alias("event_id"), (F.max("ts") + F.make_dt_interval(secs=F.lit(wait))).alias("ts"))
    return last.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("path", "string"), ("to_path", "string"), ("tracker", "long"))])


def ingest(stream: DataFrame, close: DataFrame, config: WatchConfig = WatchConfig()) -> DataFrame:
    """All actions of :func:`watch` over what ``stream`` has now (availableNow, one batch); ``close`` brings what still waits at its end."""
    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="vaultspark-")
    path = f"{root.rstrip('/')}/vaultspark/watch-{uuid.uuid4().hex}"
    close.write.parquet(f"{path}/close")
    both = stream.unionByName(spark.readStream.schema(close.schema).parquet(f"{path}/close"))
    run = watch(both, config).writeStream.format("parquet").outputMode("append").option("path", f"{path}/actions").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(ACTIONS).parquet(f"{path}/actions")


def replay(events: DataFrame, config: WatchConfig = WatchConfig()) -> DataFrame:
    """Actions of a finished table of events; a root's events stream through its task in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, state, held = None, None, []

        def flush(end: bool):
            nonlocal held
            rows = _rows(root, state, state.run(held, float("inf") if end else None, config))
            held = []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()))], _COLUMNS)

        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["watch_root"] != root:
                    if state is not None:
                        yield flush(True)
                    root, state = r["watch_root"], WatchState()
                held.append((r["kind"], r["path"], r["to_path"], r["tracker"], r["t"]))
            if state is not None:
                yield flush(False)
        if state is not None:
            yield flush(True)

    slim = events.select("watch_root", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "kind", "path", "to_path", "tracker")
    dealt = slim.repartition("watch_root").sortWithinPartitions("watch_root", "us", "event_id")
    return dealt.select("watch_root", "kind", "path", "to_path", "tracker", (F.col("us") / 1e6).alias("t")).mapInArrow(run, ACTIONS)


#: What a put that meets a lock raises: a file in use, or a vault that others keep writing.
LOCKED = (BlockingIOError, PermissionError, Conflict)


def apply_actions(vault, actions: DataFrame, read, watch_root: str, config: WatchConfig = WatchConfig(), waiting: WatchState | None = None, patience: float = 60.0, clock=time.time, sleep=time.sleep) -> WatchState:
    """Carry out one batch of a root's actions in order; ``read(paths)`` gives (name, content) of those that exist.

    Runs of puts make one commit. Where it meets a lock that ``read`` or the commit raises here, each file is put by itself, and what is locked is tried again with
    back-off for up to ``patience`` seconds after the batch. What is locked even then is in the state that is returned, for the next call's
    ``waiting``. For ``foreachBatch``.
    """
    rows = actions.where(F.col("watch_root") == watch_root).orderBy("seq").collect()
    puts: list[str] = []
    waiting = waiting or WatchState()

    def put(paths: list[str]) -> None:
        try:
            vault.put(read(paths))
        except LOCKED:
            if len(paths) > 1:
                for p in paths:
                    put([p])
            else:
                waiting.failed(paths[0], clock(), config)
            return
        vault.track(watch_root, paths)
        for p in paths:
            waiting.updates.pop(p, None)

    def flush():
        if puts:
            paths = list(dict.fromkeys(puts))
            puts.clear()
            put(paths)

    for r in rows:
        if r.action == "put":
            puts.append(r.path)
            continue
        flush()
        # What waits for a lock goes with its folder.
        for p in [p for p in waiting.updates if p == r.path or p.startswith(r.path + "/")]:
            entry = waiting.updates.pop(p)
            if r.action == "move":
                waiting.updates[r.to_path + p[len(r.path) :]] = entry
        tracked = {t.name for t in vault.tracked(watch_root).collect()}
        mine = sorted(t for t in tracked if t == r.path or t.startswith(r.path + "/"))
        if r.action == "move":
            vault.move([(r.path, r.to_path)])
            if mine:
                vault.track(watch_root, mine, on=False)
                vault.track(watch_root, [r.to_path + m[len(r.path) :] for m in mine])
        elif mine:
            # Only what the watcher itself stored is unbound.
            vault.move([(m, None) for m in mine], whole=False)
            vault.track(watch_root, mine, on=False)
    flush()
    until = clock() + patience
    while (due := waiting.next_time()) is not None and due <= until:
        if due > clock():
            sleep(due - clock())
        for p in [p for p, (t, _) in waiting.updates.items() if t <= due]:
            put([p])
    return waiting


def reconcile(vault, watch_root: str, listing: DataFrame, complete: bool, renames_pending: bool = False, generation_changed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(changes, deletes) of a full listing (name, size, content_hash). Deletes are empty unless the listing is
    complete, no rename waits and nothing happened since it began."""
    current = relops.list_files(vault.names(), vault.versions_table()).select("name", "size_bytes", "manifest_id")
    safe = complete and not renames_pending and not generation_changed
    guard = vault.spark.range(1).select(F.lit(safe).alias("scan_complete"))
    return relops.reconcile_changes(listing, current), relops.reconcile_deletes(vault.tracked(watch_root).select("name"), listing, guard)
