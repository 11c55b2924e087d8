"""What a view asks for, and its compilation to columns that Catalyst can push into the scan."""

from __future__ import annotations

import hashlib
import json
import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.functions import can_contain, kind_of, text_form, typed_literal

OPS = ("eq", "ne", "lt", "lte", "gt", "gte", "between", "contains", "ncontains", "startswith", "endswith", "in", "regex", "isnull", "notnull")
_COMPARE = {"lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: str = ""
    value2: str = ""
    case_sensitive: bool = False
    enabled: bool = True


@dataclass(frozen=True)
class Search:
    query: str
    mode: str = "contains"
    case_sensitive: bool = False
    columns: tuple[str, ...] | None = None
    include_nested: bool = False
    as_filter: bool = True


@dataclass(frozen=True)
class Sort:
    column: str
    dir: str = "asc"
    nulls_first: bool = False


@dataclass(frozen=True)
class ViewSpec:
    filters: tuple[Filter, ...] = ()
    combine: str = "and"
    search: Search | None = None
    sort: tuple[Sort, ...] = ()
    select: tuple[str, ...] | None = None


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _folded(c: Column, case_sensitive: bool) -> Column:
    return c if case_sensitive else F.lower(c)


def same_text(txt: Column, value: str, case_sensitive: bool) -> Column:
    return _folded(txt, case_sensitive) == _folded(F.lit(value), case_sensitive)


def contains(txt: Column, value: str, case_sensitive: bool) -> Column:
    return F.contains(_folded(txt, case_sensitive), _folded(F.lit(value), case_sensitive))


def matches(txt: Column, pattern: str, case_sensitive: bool) -> Column:
    """A partial match. Patterns that look around or back are refused: they aren't regular."""
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise ValueError("look-around and back-references aren't supported")
    return txt.rlike(pattern if case_sensitive else f"(?i){pattern}")


def filter_column(f: Filter, fields: dict[str, T.DataType]) -> Column | None:
    """The filter as a condition, or None where it asks for nothing: disabled, unknown column, empty value."""
    if not f.enabled or f.column not in fields:
        return None
    if f.op not in OPS:
        raise ValueError(f"unknown filter operator: {f.op}")
    dtype, c = fields[f.column], quoted(f.column)
    txt = text_form(c, dtype)
    if f.op == "isnull":
        return c.isNull()
    if f.op == "notnull":
        return c.isNotNull()
    if f.value == "" and f.op not in ("eq", "ne"):
        return None
    if f.op in ("eq", "ne"):
        if kind_of(dtype) in ("numeric", "temporal") and (lit := typed_literal(f.value, dtype)) is not None:
            return ~c.eqNullSafe(lit) if f.op == "ne" else c == lit
        same = same_text(txt, f.value, f.case_sensitive)
        return ~same | c.isNull() if f.op == "ne" else same
    if f.op in _COMPARE:
        lit = typed_literal(f.value, dtype)
        return _COMPARE[f.op](txt, F.lit(f.value)) if lit is None else _COMPARE[f.op](c, lit)
    if f.op == "between":
        a, b = typed_literal(f.value, dtype), typed_literal(f.value2, dtype)
        return txt.between(F.lit(f.value), F.lit(f.value2)) if a is None or b is None else c.between(a, b)
    if f.op == "contains":
        return contains(txt, f.value, f.case_sensitive)
    if f.op == "ncontains":
        return txt.isNull() | ~contains(txt, f.value, f.case_sensitive)
    if f.op in ("startswith", "endswith"):
        return getattr(F, f.op)(_folded(txt, f.case_sensitive), _folded(F.lit(f.value), f.case_sensitive))
    if f.op == "in":
        parts = [p.strip() for p in re.split(r"[\n,]", f.value) if p.strip()]
        return _folded(txt, f.case_sensitive).isin([p if f.case_sensitive else p.lower() for p in parts]) if parts else None
    return matches(txt, f.value, f.case_sensitive)


def search_column(s: Search | None, fields: dict[str, T.DataType]) -> Column | None:
    if s is None or not s.query:
        return None
    names = [n for n in fields if n in s.columns] if s.columns else [n for n, t in fields.items() if s.include_nested or kind_of(t) != "nested"]
    if not names:
        return None
    if s.mode != "regex":
        names = [n for n in names if can_contain(fields[n], s.query)]
        if not names:
            return F.lit(False)
    test = {"exact": same_text, "regex": matches}.get(s.mode, contains)
    return reduce(operator.or_, (test(text_form(quoted(n), fields[n]), s.query, s.case_sensitive) for n in names))


def where_column(spec: ViewSpec, fields: dict[str, T.DataType]) -> Column | None:
    """All filters, joined by and or by or; a search that filters is joined to them by and."""
    parts = [c for f in spec.filters if (c := filter_column(f, fields)) is not None]
    out = reduce(operator.or_ if spec.combine == "or" else operator.and_, parts) if parts else None
    if spec.search is not None and spec.search.as_filter and (s := search_column(spec.search, fields)) is not None:
        out = s if out is None else out & s
    return out


def sort_columns(spec: ViewSpec, fields: dict[str, T.DataType]) -> list[Column]:
    """Nulls come last in both directions unless the key says otherwise; nested values sort by their text; unknown columns are dropped."""
    out = []
    for s in spec.sort:
        if s.column in fields:
            c = quoted(s.column)
            c = text_form(c, fields[s.column]) if kind_of(fields[s.column]) == "nested" else c
            out.append(getattr(c, f"{'desc' if s.dir == 'desc' else 'asc'}_nulls_{'first' if s.nulls_first else 'last'}")())
    return out


def selected(spec: ViewSpec, names: list[str]) -> list[str]:
    """In the table's order; all columns where none is named or known."""
    return [n for n in names if n in (spec.select or ())] or names


def is_identity(spec: ViewSpec) -> bool:
    return not any(f.enabled for f in spec.filters) and not spec.sort and not (spec.search and spec.search.query and spec.search.as_filter)


def view_key(dataset: str, spec: ViewSpec, schema: T.StructType) -> str:
    """A name for the view's rows: the order of filters and columns doesn't matter, that of sort keys does."""
    s = spec.search
    plain = {
        "filters": sorted([f.column, f.op, f.value, f.value2, f.case_sensitive] for f in spec.filters if f.enabled),
        "combine": spec.combine,
        "search": [s.query, s.mode, s.case_sensitive, s.include_nested, sorted(s.columns or ())] if s and s.query and s.as_filter else None,
        "sort": [[k.column, k.dir, k.nulls_first] for k in spec.sort],
        "select": sorted(spec.select) if spec.select else None,
        "columns": [f"{f.name}:{f.dataType.simpleString()}" for f in schema],
    }
    return hashlib.sha1((dataset + json.dumps(plain)).encode()).hexdigest()[:20]


def shown(c: Column, dtype: T.DataType, max_chars: int) -> Column:
    """A cell's text, cut to max_chars with an ellipsis."""
    t = text_form(c, dtype)
    return F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit("…"))).otherwise(t)
