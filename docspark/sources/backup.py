"""Backups: a copied, hashed and verified image of a storage folder, promoted and restored in one step."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from pathlib import Path

from ..errors import IntegrityError, InvalidOption
from .storage import CATALOG

MANIFEST, FORMAT = "backup.json", 1


def _sha(path: Path) -> str:
    h = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def _overlap(a: Path, b: Path) -> bool:
    a, b = a.resolve(), b.resolve()
    return a == b or a in b.parents or b in a.parents


def _promote(stage: Path, target: Path, overwrite: bool) -> None:
    """Put ``stage`` where ``target`` is; what was there is put back if that fails."""
    aside = target.with_name(f".{target.name}-{uuid.uuid4().hex}")
    had = target.exists()
    if had and not overwrite and any(target.iterdir()):
        raise InvalidOption(f"{target} exists")
    if had:
        os.replace(target, aside)
    try:
        os.replace(stage, target)
    except OSError:
        if had:
            os.replace(aside, target)
        raise
    if had:
        shutil.rmtree(aside)


def write_backup(root: Path, target: str | Path, bodies: dict[str, dict], overwrite: bool = False) -> dict:
    target = Path(target)
    if _overlap(root, target):
        raise InvalidOption("a backup cannot lie in its storage folder, or around it")
    target.parent.mkdir(parents=True, exist_ok=True)
    stage = target.with_name(f".{target.name}-stage-{uuid.uuid4().hex}")
    stage.mkdir()
    try:
        files = []
        for folder, body in bodies.items():
            (stage / folder).mkdir()
            (stage / folder / CATALOG).write_text(json.dumps(body))
            for part in body["parts"]:
                shutil.copytree(root / folder / part, stage / folder / part)
        for f in sorted(p for p in stage.rglob("*") if p.is_file()):
            files.append({"path": f.relative_to(stage).as_posix(), "bytes": f.stat().st_size, "sha256": _sha(f)})
        manifest = {"format": FORMAT, "collections": {b["name"]: {"folder": n, "version": b["version"], "rows": b["rows"]} for n, b in bodies.items()}, "files": files}
        (stage / MANIFEST).write_text(json.dumps(manifest, indent=1))
        verify_backup(stage)
        _promote(stage, target, overwrite)
        return manifest
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def verify_backup(path: str | Path, spark=None) -> dict:
    """Check the manifest, exact files, sizes and hashes; with a session also every row count."""
    path = Path(path)
    try:
        manifest = json.loads((path / MANIFEST).read_text())
        listed = {f["path"]: f for f in manifest["files"]}
        if manifest["format"] != FORMAT or len(listed) != len(manifest["files"]) or any(p.startswith("/") or ".." in p.split("/") for p in listed):
            raise IntegrityError("the manifest is not valid")
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise IntegrityError(f"{path} is not a backup") from e
    there = {f.relative_to(path).as_posix() for f in path.rglob("*") if f.is_file()} - {MANIFEST}
    if there != set(listed):
        raise IntegrityError(f"files differ from the manifest: {sorted(there ^ set(listed))[:3]}")
    for p, f in listed.items():
        if (path / p).is_symlink() or (path / p).stat().st_size != f["bytes"] or _sha(path / p) != f["sha256"]:
            raise IntegrityError(f"{p} is damaged")
    if spark is not None:
        for name, c in manifest["collections"].items():
            body = json.loads((path / c["folder"] / CATALOG).read_text())
            rows = sum(spark.read.parquet(str(path / c["folder"] / p)).count() for p in body["parts"])
            if rows != c["rows"]:
                raise IntegrityError(f"{name} has {rows} rows instead of {c['rows']}")
    return manifest


def restore_backup(source: str | Path, target: str | Path, overwrite: bool = False) -> dict:
    source, target = Path(source), Path(target)
    if _overlap(source, target):
        raise InvalidOption("a backup cannot be restored into itself")
    manifest = verify_backup(source)
    target.parent.mkdir(parents=True, exist_ok=True)
    stage = target.with_name(f".{target.name}-stage-{uuid.uuid4().hex}")
    try:
        shutil.copytree(source, stage)
        verify_backup(stage)
        (stage / MANIFEST).unlink()
        _promote(stage, target, overwrite)
        return manifest
    finally:
        shutil.rmtree(stage, ignore_errors=True)
