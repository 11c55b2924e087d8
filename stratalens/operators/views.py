"""Views: filtered, searched, sorted and projected tables that keep their source row numbers, and pages of them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators import rows
from stratalens.operators.viewspec import Search, ViewSpec, is_identity, search_column, selected, shown, sort_columns, where_column

MAX_PAGE, MIN_CELL, MAX_CELL, CELL = 5000, 16, 200_000, 2000


def view(table: DataFrame, spec: ViewSpec) -> DataFrame:
    """The view's rows, not yet sorted, with their source row numbers; filters and columns reach the scan."""
    fields = {f.name: f.dataType for f in table.schema if f.name != rows.ROW}
    condition = where_column(spec, fields)
    out = table if condition is None else table.where(condition)
    need = [f"`{c}`" for c in selected(spec, list(fields))]
    keys = [s.column for s in spec.sort if s.column in fields and f"`{s.column}`" not in need]
    return out.select(*need, *(f"`{k}`" for k in keys), rows.ROW)


def ordered(table: DataFrame, spec: ViewSpec) -> DataFrame:
    """The view sorted, ties by source row; without sort keys in the source's order."""
    fields = {f.name: f.dataType for f in table.schema if f.name != rows.ROW}
    out = view(table, spec).orderBy(*sort_columns(spec, fields), rows.ROW)
    return out.select(*(f"`{c}`" for c in selected(spec, list(fields))), rows.ROW)


@dataclass(frozen=True)
class Built:
    """A stored view: its table, the columns it shows and the sizes of its parts, or none where the source's own row numbers serve."""

    table: DataFrame
    columns: list[str]
    sizes: list[tuple[int, int, int]] | None

    @property
    def count(self) -> int:
        return self.table.count() if self.sizes is None else sum(n for _, _, n in self.sizes)

    def rows_between(self, start: int, stop: int) -> DataFrame:
        if self.sizes is None:
            return self.table.where((F.col(rows.ROW) >= start) & (F.col(rows.ROW) < stop)).withColumn(rows.VIEW_ROW, F.col(rows.ROW))
        return rows.between(self.table, self.sizes, start, stop)

    def numbered(self) -> DataFrame:
        if self.sizes is None:
            return self.table.withColumn(rows.VIEW_ROW, F.col(rows.ROW))
        return self.table.withColumn(rows.VIEW_ROW, F.col(rows.PLACE) + rows.view_start(self.sizes))


def build(table: DataFrame, spec: ViewSpec, path: str, fresh: bool = True) -> Built:
    """The view, sorted and stored as Parquet at path unless it is the table itself; fresh=False takes the one that is there."""
    fields = {f.name: f.dataType for f in table.schema if f.name != rows.ROW}
    columns = selected(spec, list(fields))
    if is_identity(spec):
        return Built(table.select(*(f"`{c}`" for c in columns), rows.ROW), columns, None)
    if fresh:
        keys = [*sort_columns(spec, fields), F.col(rows.ROW).asc()]
        rows.in_order(view(table, spec), keys).write.mode("overwrite").option("compression", "zstd").parquet(path)
    stored = table.sparkSession.read.parquet(path)
    return Built(stored.select(*(f"`{c}`" for c in columns), rows.ROW, rows.PART, rows.PLACE), columns, rows.part_sizes(stored))


def page(built: Built, offset: int, limit: int, max_chars: int = CELL) -> DataFrame:
    """Rows offset .. offset + limit in the view's order, all cells as text, with the view and source rows and, exactly, which cells are cut."""
    limit, max_chars = max(1, min(int(limit), MAX_PAGE)), max(MIN_CELL, min(int(max_chars), MAX_CELL))
    offset = max(0, int(offset))
    types = {f.name: f.dataType for f in built.table.schema}
    part = built.rows_between(offset, offset + limit)
    cells = [shown(F.col(f"`{c}`"), types[c], max_chars).alias(c) for c in built.columns]
    return part.select(rows.VIEW_ROW, F.col(rows.ROW).alias("__source_row"), *cells).orderBy(rows.VIEW_ROW)


def row_json(built: Built, row: int) -> str | None:
    """One row of the view as JSON, null fields kept, two spaces a level; None beyond the end."""
    got = built.rows_between(row, row + 1).select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in built.columns)), {"ignoreNullFields": "false", "pretty": "true"})).head()
    return got and got[0]


def _found(built: Built, search: Search) -> DataFrame:
    types = {f.name: f.dataType for f in built.table.schema if f.name in built.columns}
    condition = search_column(search, types)
    return built.numbered().where(F.lit(False) if condition is None else condition)


def find_match(built: Built, search: Search, after: int, forward: bool = True) -> int | None:
    """The next (or previous) view row that the search finds, going around at the end: one aggregation gives both candidates."""
    v = F.col(rows.VIEW_ROW)
    near, far = (F.min(F.when(v > after, v)), F.min(v)) if forward else (F.max(F.when(v < after, v)), F.max(v))
    a, b = _found(built, search).agg(near, far).first()
    return b if a is None else a


def count_matches(built: Built, search: Search) -> int:
    return _found(built, search).count()


def with_search(spec: ViewSpec, search: Search) -> ViewSpec:
    return replace(spec, search=search)
