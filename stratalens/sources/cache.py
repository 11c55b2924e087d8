"""Opened files kept as stored tables, named by path, size, time and options; the least recently used go when the cache grows too large."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from stratalens.sources.ingest import Manifest, Options, ingest

LEAST_LIMIT = 512 << 20


def dataset_id(path: str, o: Options) -> str:
    stat = os.stat(path)
    return hashlib.sha1(json.dumps([os.path.abspath(path), stat.st_size, stat.st_mtime, asdict(o)], sort_keys=True).encode()).hexdigest()[:20]


def folder_size(folder: Path) -> int:
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


class Cache:
    """folder: one that all executors share, on a cluster."""

    def __init__(self, folder: str, limit: int = 20 << 30):
        self.root = Path(folder) / "datasets"
        self.root.mkdir(parents=True, exist_ok=True)
        self.limit = max(limit, LEAST_LIMIT)

    def folder(self, dataset: str) -> Path:
        return self.root / dataset

    def manifest(self, dataset: str) -> Manifest | None:
        at = self.folder(dataset) / "manifest.json"
        return Manifest(**json.loads(at.read_text())) if at.exists() else None

    def open(self, spark: SparkSession, path: str, o: Options | None = None) -> tuple[Manifest, bool]:
        """(manifest, whether it was there); a file that has changed since has another name."""
        o = o or Options()
        dataset = dataset_id(path, o)
        m = self.manifest(dataset)
        if m is not None:
            os.utime(self.folder(dataset))
            return m, True
        m = ingest(spark, path, str(self.folder(dataset)), dataset, o)
        self.prune(keep={dataset})
        return m, False

    def info(self) -> list[dict]:
        return [{"id": d.name, "bytes": folder_size(d), "used": d.stat().st_mtime, "path": m.path if (m := self.manifest(d.name)) else None} for d in sorted(self.root.iterdir()) if d.is_dir()]

    def prune(self, keep: set[str] = frozenset()) -> list[str]:
        gone, entries = [], sorted(self.info(), key=lambda x: x["used"])
        total = sum(x["bytes"] for x in entries)
        for x in entries:
            if total <= self.limit:
                break
            if x["id"] not in keep:
                self.remove(x["id"])
                total -= x["bytes"]
                gone.append(x["id"])
        return gone

    def remove(self, dataset: str) -> bool:
        there = self.folder(dataset).exists()
        shutil.rmtree(self.folder(dataset), ignore_errors=True)
        return there

    def clear(self) -> int:
        names = [d.name for d in self.root.iterdir() if d.is_dir()]
        return sum(map(self.remove, names))

    def clear_views(self) -> int:
        n = 0
        for d in self.root.iterdir():
            views = d / "views"
            n += len(list(views.iterdir())) if views.exists() else 0
            shutil.rmtree(views, ignore_errors=True)
        return n

    def set_limit(self, limit: int) -> int:
        self.limit = max(int(limit), LEAST_LIMIT)
        self.prune()
        return self.limit
