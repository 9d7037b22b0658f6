"""Command line: ``python -m vaultspark [--store DIR] COMMAND ...``.

The store comes from --store, else $VAULT_STORE, else ./vault; the passphrase from
--password-file, else $VAULT_PASSWORD.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vaultspark.functions import scalars
from vaultspark.functions.errors import VaultError
from vaultspark.plans.vault import Vault
from vaultspark.sources import files
from vaultspark.streaming.service import WatchService
from vaultspark.streaming.watcher import WatchConfig


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vaultspark", description=__doc__)
    p.add_argument("--store", default=os.environ.get("VAULT_STORE", "./vault"))
    p.add_argument("--password-file")
    sub = p.add_subparsers(dest="command", required=True)

    def add(command: str, /, *arguments, **options):
        c = sub.add_parser(command)
        for a in arguments:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument(f"--{k}", **v)

    add("init")
    add("put", "path", name={})
    add("get", "target", "out", version={"type": int})
    add("list")
    add("versions", "target")
    add("rollback", "name", "version")
    add("rm", "name")
    add("rename", "old", "new")
    add("prune", name={}, keep={"type": int, "default": 10})
    add("snapshot", "action", label={}, to={})
    add("ingest", "folder", label={})
    add("stats")
    add("gc")
    add("fsck")
    add("watch", "folder", debounce={"type": int, "default": 3}, cooldown={"type": int, "default": 60}, throttle={"type": int, "default": 10}, once={"action": "store_true"})
    return p


def show(df) -> None:
    for row in df.collect():
        print("\t".join(str(x) for x in row))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("vaultspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    passphrase = os.environ.get("VAULT_PASSWORD")
    if a.password_file:
        with open(a.password_file) as f:
            passphrase = f.read().rstrip("\n")
    try:
        return run(a, Vault.open(spark, a.store, passphrase))
    except VaultError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


def run(a: argparse.Namespace, v: Vault) -> int:
    now = F.lit(int(time.time()))
    if a.command == "put":
        show(v.put_paths(v.spark.createDataFrame([(a.name or os.path.basename(a.path), os.path.abspath(a.path))], "name string, path string")))
    elif a.command == "get":
        content = v.get(a.target, a.version)
        temp = f"{a.out}.part"
        with open(temp, "wb") as f:
            f.write(content)
        os.replace(temp, a.out)
    elif a.command == "list":
        show(v.list_files().select("name", "latest_version", scalars.format_bytes_long("size_bytes")).orderBy("name"))
    elif a.command == "versions":
        show(v.versions(a.target).select("version", scalars.format_bytes_long("size_bytes"), scalars.relative_age(F.unix_timestamp("created_at"), now), "manifest_id"))
    elif a.command == "rollback":
        print(v.rollback(a.name, int(a.version)))
    elif a.command == "rm":
        return 0 if v.delete(a.name) else 1
    elif a.command == "rename":
        return 0 if v.rename(a.old, a.new) else 1
    elif a.command == "prune":
        print(v.prune(a.keep, a.name))
    elif a.command == "snapshot":
        if a.action == "create":
            print(v.snapshot(a.label))
        elif a.action == "list":
            show(v.snapshots())
        elif a.action == "restore":
            print(v.restore(a.label, a.to))
        elif a.action == "delete":
            return 0 if v.delete_snapshot(a.label) else 1
        else:
            raise VaultError(f"no such action: {a.action}")
    elif a.command == "ingest":
        print(v.ingest(files.walk_folder(v.spark, a.folder), a.label))
    elif a.command == "stats":
        for k, x in v.stats().items():
            print(f"{k}\t{x}")
    elif a.command == "gc":
        print(v.gc())
    elif a.command == "fsck":
        report = v.fsck()
        print(report)
        return 0 if report["healthy"] else 1
    elif a.command == "watch":
        # A running service is told of events by its caller; the command line scans, once or every minute.
        config = WatchConfig.asked(a.debounce, a.cooldown, a.throttle)
        v.save_watch_config(a.folder, a.debounce, a.cooldown, a.throttle)
        service = WatchService(v, os.path.abspath(a.folder), replace(config, reconcile=60.0))
        if a.once:
            print(service.scan_once())
        else:
            service.start()
            try:
                while True:
                    time.sleep(5)
                    print(service.status())
            except KeyboardInterrupt:
                service.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
