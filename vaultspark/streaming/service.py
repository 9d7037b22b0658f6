"""The folder watcher as a service: scans, queued events, retries and a status.

A service owns one folder and one vault. A scan lists the folder as a DataFrame, finds what differs from the
vault by size first and then by hash, and puts all of it in one commit; files that are gone are unbound, if the listing is
complete, no rename waits and no event came meanwhile. Between scans, events given to :meth:`WatchService.notify` go
through the same state machine as the stream's, and files that were locked are tried again with back-off.

Phases: scanning, watching, degraded (an error is open), stopping, stopped. Errors are kept by what they belong to and go
when that succeeds; the one whose key comes first is shown.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import paths
from vaultspark.functions.errors import AlreadyExists, WouldBlock
from vaultspark.operators import relops
from vaultspark.sources import files as sources
from vaultspark.streaming.watcher import LOCKED, WatchConfig, WatchState, reconcile

#: Fixed value: seconds after which a pause looks whether the service was stopped.
CANCEL_EVERY = 0.025


@dataclass(frozen=True)
class Status:
    phase: str = "stopped"
    scanned_files: int = 0
    saved_files: int = 0
    removed_files: int = 0
    pending_files: int = 0
    last_sync_at: int | None = None
    last_error: str | None = None


class WatchService:
    def __init__(self, vault, folder: str, config: WatchConfig = WatchConfig(), rules: Callable[[], list[str]] | None = None, clock=time.time, sleep=time.sleep):
        """``rules`` gives the ignore patterns and is asked anew before each scan."""
        self.vault, self.folder, self.config, self.rules = vault, folder.rstrip("/"), config, rules
        self.clock, self.sleep = clock, sleep
        strip = lambda p: p.split("://", 1)[-1]
        one = vault.spark.range(1).select(paths.overlaps(F.lit(strip(self.folder)), F.lit(strip(vault.root))))
        if one.first()[0]:
            raise ValueError(f"the folder and the vault overlap: {folder}")
        self.state, self._status, self._errors = WatchState(), Status(), {}
        self._queue: list[tuple] = []
        self._lock, self._stop, self._dirty, self._rescan = threading.RLock(), threading.Event(), False, False
        self._thread: threading.Thread | None = None

    # Status.

    def status(self) -> Status:
        with self._lock:
            return replace(self._status, pending_files=len(self.state.updates) + len(self._queue))

    def _note(self, **changes) -> None:
        with self._lock:
            self._status = replace(self._status, **changes)

    def _count(self, **more: int) -> None:
        with self._lock:
            self._status = replace(self._status, **{k: getattr(self._status, k) + n for k, n in more.items()})

    def _error(self, key: str, message: str | None) -> None:
        """Open an error, or with None close it."""
        with self._lock:
            self._errors.pop(key, None)
            if message is not None:
                self._errors[key] = message
            first = self._errors[min(self._errors)] if self._errors else None
            phase = self._status.phase
            if first is not None and phase not in ("stopping", "stopped"):
                phase = "degraded"
            self._status = replace(self._status, last_error=first, phase=phase)

    def _finish(self) -> None:
        if self._stop.is_set():
            return
        with self._lock:
            if self._errors:
                self._note(phase="degraded")
                return
            self._note(phase="watching")
            if self._dirty and not self.state.updates and not self._queue:
                self._note(last_sync_at=int(self.clock()))
                self._dirty = False

    # Life.

    def start(self) -> None:
        with self._lock:
            if self._thread is not None and self._thread.is_alive():
                raise AlreadyExists("the watcher is running")
            self._stop.clear()
            self._note(phase="scanning")
            self._thread = threading.Thread(target=self._loop, daemon=True)
            self._thread.start()

    def stop(self) -> None:
        self._note(phase="stopping")
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
        self._note(phase="stopped")

    def notify(self, kind: str, path: str, to_path: str | None = None, tracker: int | None = None) -> None:
        """An event of the folder: create, modify, remove, rename_both, rename_from or rename_to; error asks for a scan."""
        with self._lock:
            if kind == "error":
                self._rescan = True
            else:
                self._queue.append((kind, path, to_path, tracker, self.clock()))

    def scan_once(self) -> Status:
        """One scan now, after what waits for a lock; refused while the service runs."""
        if self._thread is not None and self._thread.is_alive():
            raise AlreadyExists("the watcher is running")
        self._stop.clear()
        self._retry(float("inf"))
        self._scan()
        self._finish()
        return self.status()

    def _loop(self) -> None:
        due = self.clock()
        while not self._stop.is_set():
            if self.clock() >= due or self._rescan:
                self._rescan = False
                self._scan()
                due = self.clock() + self.config.reconcile
            self._events()
            self._retry(self.clock())
            self._finish()
            self._pause(CANCEL_EVERY)

    def _pause(self, seconds: float) -> None:
        until = self.clock() + seconds
        while not self._stop.is_set() and (left := until - self.clock()) > 0:
            self.sleep(min(left, CANCEL_EVERY))

    # Work.

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _events(self) -> None:
        with self._lock:
            events, self._queue = self._queue, []
        now = self.clock()
        for action, path, to, _ in list(self.state.run(events, None, self.config)) + list(self.state.advance(now, self.config)):
            if self._stop.is_set():
                return
            if action == "put":
                self._put_one(path)
            elif action == "move":
                self.vault.move([(path, to)])
                mine = self._tracked_below(path)
                self.vault.track(self.folder, mine, on=False)
                self.vault.track(self.folder, [to + m[len(path) :] for m in mine])
            else:
                self._unbind(self._tracked_below(path))
            self._dirty = True

    def _tracked_below(self, path: str) -> list[str]:
        return [r.name for r in self.vault.tracked(self.folder).where(paths.under("name", path)).collect()]

    def _unbind(self, names: list[str]) -> None:
        if names:
            self.vault.move([(n, None) for n in names], whole=False)
            self.vault.track(self.folder, names, on=False)
            self._count(removed_files=len(names))

    def _put_one(self, path: str) -> None:
        one = self.vault.spark.createDataFrame([(path, self._path(path))], "name string, path string")
        try:
            self.vault.put_paths(one)
        except (WouldBlock, *LOCKED) as e:
            self.state.failed(path, self.clock(), self.config)
            self._error(path, str(e))
            return
        self.vault.track(self.folder, [path])
        self._error(path, None)
        self._count(saved_files=1)
        self._pause(self.config.throttle_ms / 1000)

    def _retry(self, until: float) -> None:
        """Files that were locked and are due."""
        with self._lock:
            due = [p for p, (t, step) in self.state.updates.items() if step and t <= until]
        for p in due:
            if self._stop.is_set():
                return
            self.state.updates.pop(p, None)
            self._put_one(p)

    def _changes(self, listing: DataFrame) -> DataFrame:
        """(name, path) of what differs from the vault; only files of equal size are read."""
        now = relops.list_files(self.vault.names(), self.vault.versions_table(), self.vault.state("objects"))
        same = listing.join(now.select("name", "size_bytes"), "name").where("size = size_bytes")
        hashed = sources.hash_paths(same.select("name", F.concat(F.lit(f"{self.folder}/"), "name").alias("path")))
        full = listing.join(hashed, "name", "left")
        return relops.reconcile_changes(full, now).select("name", F.concat(F.lit(f"{self.folder}/"), "name").alias("path"))

    def _scan(self) -> None:
        self._note(phase="scanning")
        with self._lock:
            generation = self.state.generation + len(self._queue)
        try:
            listing = sources.list_folder(self.vault.spark, self.folder, self.rules() if self.rules else None).select("name", "size")
            self._count(scanned_files=listing.count())
            changed = self._changes(listing)
            n = changed.count()
            if n and not self._stop.is_set():
                try:
                    self.vault.put_paths(changed)
                    self.vault.track_names(self.folder, changed.select("name"))
                    self._count(saved_files=n)
                    self._pause(n * self.config.throttle_ms / 1000)
                except (WouldBlock, *LOCKED):
                    # Some file is in use: each by itself, and what is locked again later.
                    for r in changed.select("name").toLocalIterator():
                        self._put_one(r.name)
                self._dirty = True
            with self._lock:
                moved = self.state.generation + len(self._queue) != generation
                waits = bool(self.state.tracked_from or self.state.untracked_from or self.state.renames)
            _, gone = reconcile(self.vault, self.folder, listing.withColumn("content_hash", F.lit(None).cast("string")), complete=not self._stop.is_set(), renames_pending=waits, generation_changed=moved)
            self._unbind([r.name for r in gone.collect()])
            self._error("scan", None)
        except Exception as e:  # an unreadable folder must not look like an empty one
            self._error("scan", str(e).splitlines()[0] if str(e) else type(e).__name__)
