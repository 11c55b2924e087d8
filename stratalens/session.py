"""One object for all that a front end asks for: opening files, views and pages, profiles, SQL, differences, exports, the cache, and stopping what runs."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from stratalens.operators import diff, profile, rows, sqlconsole, views
from stratalens.operators.viewspec import Search, ViewSpec, is_identity, view_key
from stratalens.sources import detect as detection
from stratalens.sources import export as exporting
from stratalens.sources.cache import Cache
from stratalens.sources.ingest import Manifest, Options, opened
from stratalens.sources.ingest import preview as preview_rows


class Workbench:
    """cache_folder has to be one that all executors share."""

    def __init__(self, spark: SparkSession, cache_folder: str, cache_limit: int = 20 << 30):
        self.spark, self.cache = spark, Cache(cache_folder, cache_limit)
        self.datasets: dict[str, Manifest] = {}
        self.views: dict[str, views.Built] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._lock = threading.Lock()
        self.started = time.time()

    # -- control
    def init(self, cache_limit: int | None = None) -> dict:
        if cache_limit:
            self.cache.set_limit(cache_limit)
        return {"version": self.spark.version, "cache": str(self.cache.root), "limit": self.cache.limit}

    def ping(self) -> str:
        return "pong"

    def stats(self) -> dict:
        tracker = self.spark.sparkContext.statusTracker()
        return {"seconds": time.time() - self.started, "datasets": len(self.datasets), "views": len(self.views), "active_jobs": len(tracker.getActiveJobsIds()), "active_stages": len(tracker.getActiveStageIds())}

    def progress(self) -> float | None:
        """Ended tasks of the stages that run, as a share; None where none runs."""
        tracker = self.spark.sparkContext.statusTracker()
        infos = [i for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s))]
        total = sum(i.numTasks for i in infos)
        return sum(i.numCompletedTasks for i in infos) / total if total else None

    def job(self, tag: str):
        """A with-block whose Spark jobs `cancel` can stop by the tag's beginning."""
        return _Tagged(self.spark, tag)

    def cancel(self, tag: str) -> None:
        """Stops the jobs of a tag and of the tags that begin with it."""
        for t in list(_Tagged.active):
            if t.startswith(tag):
                self.spark.sparkContext.cancelJobsWithTag(t)

    # -- files
    def detect(self, path: str) -> dict:
        return asdict(detection.detect(path))

    def preview_rows(self, path: str, options: Options | None = None, limit: int = 50) -> list[dict]:
        return [r.asDict() for r in preview_rows(self.spark, path, options, limit).collect()]

    def raw_slice(self, path: str, offset: int, length: int) -> dict:
        return detection.raw_slice(path, offset, length)

    def open_dataset(self, path: str, options: Options | None = None) -> dict:
        m, hit = self.cache.open(self.spark, path, options)
        self.datasets[m.id] = m
        return asdict(m) | {"cached": hit}

    def close_dataset(self, dataset: str) -> bool:
        for key in [k for k in self.views if k.startswith(dataset)]:
            del self.views[key]
        return self.datasets.pop(dataset, None) is not None

    def list_datasets(self) -> list[dict]:
        return [asdict(m) for m in self.datasets.values()]

    def parquet_of(self, dataset: str) -> str:
        return str(self.cache.folder(dataset) / "base")

    def table(self, dataset: str) -> DataFrame:
        if dataset not in self.datasets:
            raise KeyError(f"no such dataset: {dataset}")
        return opened(self.spark, str(self.cache.folder(dataset)))

    # -- views
    def build_view(self, dataset: str, spec: ViewSpec = ViewSpec()) -> dict:
        """Builds a view once, however many ask for it at the same time; one that an earlier session stored is taken."""
        table = self.table(dataset)
        key = f"{dataset}/{view_key(dataset, spec, table.drop(rows.ROW).schema)}"
        with self._lock:
            lock = self._locks.setdefault(key, threading.Lock())
        with lock:
            if key not in self.views:
                path = self.cache.folder(dataset) / "views" / key.split("/")[1]
                with self.job(f"view-{key}"):
                    self.views[key] = views.build(table, spec, str(path), fresh=is_identity(spec) or not (path / "_SUCCESS").exists())
        return {"view": key, "rows": self.views[key].count, "columns": self.views[key].columns}

    def _built(self, dataset: str, spec: ViewSpec) -> views.Built:
        return self.views[self.build_view(dataset, spec)["view"]]

    def get_page(self, dataset: str, spec: ViewSpec = ViewSpec(), offset: int = 0, limit: int = 200, max_chars: int = views.CELL) -> list[dict]:
        return [r.asDict() for r in views.page(self._built(dataset, spec), offset, limit, max_chars).collect()]

    def get_row_json(self, dataset: str, spec: ViewSpec, row: int) -> str | None:
        return views.row_json(self._built(dataset, spec), row)

    def find_next_match(self, dataset: str, spec: ViewSpec, search: Search, after: int = -1, forward: bool = True) -> int | None:
        return views.find_match(self._built(dataset, spec), search, after, forward)

    def count_matches(self, dataset: str, spec: ViewSpec, search: Search) -> int:
        return views.count_matches(self._built(dataset, spec), search)

    # -- profiles
    def _rows(self, dataset: str, spec: ViewSpec) -> DataFrame:
        return views.view(self.table(dataset), spec).drop(rows.ROW)

    def profile_column(self, dataset: str, column: str, spec: ViewSpec = ViewSpec(), top: int = 20) -> dict:
        df = self._rows(dataset, spec)
        if column not in df.columns:
            raise KeyError(f"no such column: {column}")
        out = profile.profile_column(df, column).first().asDict()
        out["top"] = [r.asDict() for r in profile.top_values(df, column, top).collect()]
        out["histogram"] = [r.asDict() for r in profile.histogram(df, column).collect()] if out["avg"] is not None else None
        return out

    def profile_all(self, dataset: str, spec: ViewSpec = ViewSpec()) -> list[dict]:
        return [r.asDict() for r in profile.profile_all(self._rows(dataset, spec)).collect()]

    def distinct_values(self, dataset: str, column: str, spec: ViewSpec = ViewSpec(), limit: int = 100, like: str | None = None) -> list[dict]:
        return [r.asDict() for r in profile.distinct_values(self._rows(dataset, spec), column, limit, like).collect()]

    # -- SQL
    def _run_sql(self, sql: str, data: DataFrame, source: DataFrame, limit: int) -> dict:
        session = sqlconsole.console(self.spark)
        for name, df in (("data", data), ("source", source)):
            # views belong to a session, so the data goes over as a view of all sessions, named at random
            shared = f"v{uuid.uuid4().hex}"
            df.createGlobalTempView(shared)
            session.table(f"global_temp.{shared}").createOrReplaceTempView(name)
            self.spark.catalog.dropGlobalTempView(shared)
        got = sqlconsole.run(session, sql, limit)
        return {"columns": got.types, "rows": [tuple(r) for r in got.rows.collect()], "truncated": got.truncated}

    def run_sql(self, dataset: str, sql: str, limit: int = sqlconsole.LIMIT) -> dict:
        t = self.table(dataset).drop(rows.ROW)
        return self._run_sql(sql, t, t, limit)

    def run_sql_on_view(self, dataset: str, spec: ViewSpec, sql: str, limit: int = sqlconsole.LIMIT) -> dict:
        return self._run_sql(sql, self._rows(dataset, spec), self.table(dataset).drop(rows.ROW), limit)

    # -- differences and exports
    def diff_datasets(self, left: str, right: str, keys: list[str] | None = None, columns: list[str] | None = None, examples: int = 100) -> dict:
        c = diff.compare(self.table(left), self.table(right), keys, columns)
        return c.summary().first().asDict() | {"columns": [r.asDict() for r in c.by_column().collect()], "examples": [r.asDict(True) for r in c.examples(examples).collect()], "columns_only_left": c.only_left, "columns_only_right": c.only_right}

    def export_view(self, dataset: str, spec: ViewSpec, path: str, format: str = "csv", view_rows: list[int] | None = None, source_rows: list[int] | None = None, limit: int | None = None, **options) -> dict:
        size = exporting.export(exporting.chosen(self._built(dataset, spec), view_rows, source_rows, limit), path, format, **options)
        return {"path": path, "bytes": size}

    # -- cache
    def cache_info(self) -> dict:
        entries = self.cache.info()
        return {"entries": entries, "bytes": sum(e["bytes"] for e in entries), "limit": self.cache.limit, "folder": str(Path(self.cache.root))}

    def clear_cache(self) -> int:
        self.datasets.clear()
        self.views.clear()
        return self.cache.clear()

    def remove_cache_entry(self, dataset: str) -> bool:
        self.close_dataset(dataset)
        return self.cache.remove(dataset)

    def set_cache_limit(self, limit: int) -> int:
        return self.cache.set_limit(limit)

    def clear_views(self) -> int:
        self.views.clear()
        return self.cache.clear_views()


class _Tagged:
    active: set[str] = set()

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag.replace(",", "_")

    def __enter__(self) -> _Tagged:
        self.spark.sparkContext.addJobTag(self.tag)
        self.active.add(self.tag)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)
        self.active.discard(self.tag)
