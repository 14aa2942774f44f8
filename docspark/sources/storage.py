"""Collections on disk: immutable Parquet parts, a JSON catalog that names the current ones.

A commit writes new parts, then replaces the catalog file in one step; readers keep the version
they began with. The storage path is a folder that the driver and the executors share.
"""

from __future__ import annotations

import fcntl
import json
import os
import re
import shutil
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import IntegrityError, InvalidOption, ReadOnly
from ..types import ID, NULLS

CATALOG, LOCK, LAYOUT = "catalog.json", ".lock", 1
_NAME = re.compile(r"[A-Za-z0-9_-]{1,128}")
BASE = T.StructType([T.StructField(ID, T.LongType()), T.StructField(NULLS, T.ArrayType(T.StringType()))])


def check_name(name: str) -> str:
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise InvalidOption(f"{name!r} is not a collection name")
    return name


class Store:
    """One collection's folder."""

    def __init__(self, root: Path, name: str, readonly: bool = False, durable: bool = False) -> None:
        self.name, self.readonly, self.durable = check_name(name), readonly, durable
        self.dir = root / name.lower()

    def exists(self) -> bool:
        return (self.dir / CATALOG).exists()

    def read(self) -> dict:
        try:
            body = json.loads((self.dir / CATALOG).read_text())
        except FileNotFoundError:
            return {"layout": LAYOUT, "name": self.name, "version": 0, "parts": [], "rows": 0, "schema": BASE.jsonValue(), "next_id": 1, "history": [], "learner": {}, "policy": None, "layout_paths": []}
        if body["layout"] > LAYOUT:
            raise IntegrityError(f"{self.name} has a newer layout")
        return body

    @contextmanager
    def lock(self) -> Iterator[None]:
        if self.readonly:
            raise ReadOnly("the engine is read-only")
        self.dir.mkdir(parents=True, exist_ok=True)
        with (self.dir / LOCK).open("w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            try:
                yield
            finally:
                fcntl.flock(f, fcntl.LOCK_UN)

    def load(self, spark: SparkSession, body: dict) -> DataFrame:
        schema = T.StructType.fromJson(body["schema"])
        if not body["parts"]:
            return spark.createDataFrame([], schema)
        paths = [str(self.dir / p) for p in body["parts"]]
        known = body.get("files", {})
        for name, p in zip(body["parts"], paths, strict=True):
            if not os.path.exists(p):
                raise IntegrityError(f"{self.name} lacks {p}")
            if name in known and known[name] != self.content(name):
                raise IntegrityError(f"{self.name} has lost or changed files in {p}")
        return spark.read.schema(schema).parquet(*paths)

    def new_part(self, df: DataFrame, options: dict[str, str] | None = None) -> str:
        name = f"part-{uuid.uuid4().hex}"
        df.write.options(**(options or {})).parquet(str(self.dir / name))
        return name

    def content(self, part: str) -> list[int]:
        """Number and bytes of a part's data files: what the catalog remembers of it."""
        sizes = [f.stat().st_size for f in os.scandir(self.dir / part) if f.name.endswith(".parquet")]
        return [len(sizes), sum(sizes)]

    def commit(self, body: dict, version: int) -> None:
        """Make ``body`` current if nobody has committed since ``version``; the caller holds the lock."""
        if self.read()["version"] != version:
            raise IntegrityError("the collection changed meanwhile")
        old, now = self.read(), time.time()
        known = old.get("files", {})
        # A part is written before it is committed and never changed, so its files are counted once.
        files = {p: known.get(p) or self.content(p) for p in body["parts"]}
        body = body | {"version": version + 1, "committed": now, "files": files}
        tmp = self.dir / f".{uuid.uuid4().hex}"
        with tmp.open("w") as f:
            json.dump(body, f)
            if self.durable:
                f.flush()
                os.fsync(f.fileno())
        os.replace(tmp, self.dir / CATALOG)

    def stale(self, body: dict) -> list[Path]:
        return [p for p in self.dir.iterdir() if p.is_dir() and p.name.startswith("part-") and p.name not in body["parts"]] if self.dir.exists() else []

    def sizes(self, body: dict) -> dict:
        size = lambda p: sum(f.stat().st_size for f in p.rglob("*") if f.is_file())
        return {"bytes": sum(size(self.dir / p) for p in body["parts"]), "reclaimable_bytes": sum(size(p) for p in self.stale(body)), "parts": len(body["parts"]), "rows": body["rows"], "version": body["version"]}

    def lease(self, body: dict) -> None:
        """Note that readers were given this version now."""
        for p in body["parts"]:
            _leases[str(self.dir / p)] = time.time()

    def sweep(self, body: dict, lease_s: float) -> tuple[int, int]:
        """Delete stale parts, but for those that a reader of this process was given in the last ``lease_s``
        seconds; how many went, and how many stay for now."""
        gone, left = 0, 0
        for p in self.stale(body):
            if time.time() - _leases.get(str(p), 0) < lease_s:
                left += 1
            else:
                shutil.rmtree(p)
                _leases.pop(str(p), None)
                gone += 1
        return gone, left


#: When readers were last given a part, by its folder.
_leases: dict[str, float] = {}


def discover(root: Path) -> list[str]:
    """Names of the collections under ``root``; links and stray folders are not collections."""
    if not root.exists():
        return []
    return sorted(json.loads((d / CATALOG).read_text())["name"] for d in root.iterdir() if d.is_dir() and not d.is_symlink() and (d / CATALOG).is_file())


def inspect_storage(root: str | Path) -> dict:
    """What a storage folder holds, from its catalogs alone; nothing is opened or changed."""
    root, out, broken = Path(root), [], []
    for d in sorted(root.iterdir()) if root.exists() else []:
        if not d.is_dir() or d.is_symlink():
            continue
        try:
            body = json.loads((d / CATALOG).read_text())
            missing = [p for p in body["parts"] if not (d / p / "_SUCCESS").exists()]
            out.append({"name": body["name"], "version": body["version"], "layout": body["layout"], "rows": body["rows"], "parts": len(body["parts"]), "ok": not missing and body["layout"] <= LAYOUT})
        except (OSError, ValueError, KeyError):
            broken.append(d.name)
    return {"path": str(root), "collections": out, "orphans": broken, "ok": all(c["ok"] for c in out)}
