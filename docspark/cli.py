"""Maintenance from the command line: inspect, verify-backup, restore, migrate."""

from __future__ import annotations

import argparse
import json
import sys

from .errors import DocsparkError
from .sources.backup import restore_backup, verify_backup
from .sources.storage import discover, inspect_storage


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docspark")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("inspect").add_argument("path")
    sub.add_parser("verify-backup").add_argument("path")
    r = sub.add_parser("restore")
    r.add_argument("source")
    r.add_argument("target")
    r.add_argument("--overwrite", action="store_true")
    m = sub.add_parser("migrate", help="rewrite every collection in the current layout")
    m.add_argument("path")
    m.add_argument("--yes", action="store_true")
    a = p.parse_args(args)
    try:
        if a.command == "inspect":
            out = inspect_storage(a.path)
        elif a.command == "verify-backup":
            out = {"ok": True, "collections": verify_backup(a.path)["collections"]}
        elif a.command == "restore":
            out = {"ok": True, "collections": restore_backup(a.source, a.target, a.overwrite)["collections"]}
        else:
            if not a.yes:
                print("migrate rewrites files; repeat with --yes", file=sys.stderr)
                return 2
            from pathlib import Path

            from pyspark.sql import SparkSession

            from .engine import Engine

            with Engine(SparkSession.builder.getOrCreate(), a.path) as e:
                out = {n: e.vacuum(n) for n in discover(Path(a.path))}
    except DocsparkError as e:
        print(json.dumps({"ok": False, "code": e.code, "error": str(e)}), file=sys.stderr)
        return 1
    print(json.dumps(out, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
