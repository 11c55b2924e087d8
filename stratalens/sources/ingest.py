"""Reading delimited text and Parquet into stored tables with row numbers, by the first of a ladder of readings that works."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.operators.rows import ROW, scan
from stratalens.sources.detect import Detected, detect, head_of, looks_like_header, split_line

RESERVED = {ROW, "__vrn", "__part", "__place"}
FALLBACK = [",", "\t", "|", ";"]
MAX_PREVIEW, PREVIEW_CHARS = 200, 400


@dataclass
class Options:
    delimiter: str | None = None
    delimiter_explicit: bool = False
    quote: str | None = '"'
    escape: str | None = '"'
    has_header: bool | None = None
    header_explicit: bool = False
    encoding: str = "utf-8"
    skip_rows: int = 0
    null_padding: bool = True
    ignore_errors: bool = False
    all_varchar: bool = False
    column_types: dict[str, str] = field(default_factory=dict)
    flatten: bool = False
    keep_order: bool = True


@dataclass(frozen=True)
class Plan:
    """One way to read a file, and the columns that it has to give."""

    strategy: str
    delimiter: str | None = None
    quote: str | None = '"'
    header: bool | None = None
    encoding: str | None = None
    lenient: bool = False
    all_text: bool = False
    min_columns: int = 1
    note: str = ""


def plans(o: Options, candidates: list[str], suggested: str | None = '"') -> Iterator[Plan]:
    """With a delimiter that the user names: as it is, then without the lines that don't fit, then all as text. Else every delimiter with and without quotes, two columns at least; then as Latin-1; then leniently; then as text; then one column; at last whole lines."""
    quotes = [None, '"'] if suggested is None else ['"', None]
    if o.delimiter_explicit and o.delimiter:
        for q in quotes:
            yield Plan("csv-auto", o.delimiter, q)
        for q in quotes:
            yield Plan("csv-lenient", o.delimiter, q, lenient=True, note="Lines that don't fit were skipped.")
        yield Plan("csv-all-varchar", o.delimiter, quotes[0], lenient=True, all_text=True, note="All columns were read as text.")
    else:
        every = list(dict.fromkeys(d for d in (o.delimiter, *candidates, *FALLBACK) if d))
        for d in every:
            for q in quotes:
                yield Plan("csv-auto", d, q, min_columns=2)
                if not o.header_explicit:
                    yield Plan("csv-auto", d, q, header=True, min_columns=2, note="The first row was read as names.")
        if o.encoding == "utf-8":
            for d in every[:4]:
                yield Plan("csv-auto", d, quotes[0], encoding="latin-1", min_columns=2, note="Read as Latin-1.")
        for d in every[:4]:
            for q in quotes:
                yield Plan("csv-lenient", d, q, lenient=True, min_columns=2, note="Lines that don't fit were skipped.")
        for d in every[:4]:
            yield Plan("csv-all-varchar", d, quotes[0], lenient=True, all_text=True, min_columns=2, note="All columns were read as text.")
        for q in quotes:
            yield Plan("csv-auto", ",", q)
        yield Plan("csv-all-varchar", ",", None, lenient=True, all_text=True)
    yield Plan("raw-lines", note="The file was read as one line a row.")


def _sample(path: str, encoding: str, skip: int) -> list[str]:
    text = head_of(path).decode({"utf-16": "utf-16"}.get(encoding, encoding), "replace").lstrip("﻿")
    lines = [x for x in re.split(r"\r?\n", text) if x.strip()]
    return lines[skip : skip + 1000]


_SPARK_ENCODING = {"latin-1": "ISO-8859-1", "utf-16be": "UTF-16BE", "utf-16": "UTF-16"}


def read(spark: SparkSession, path: str, plan: Plan, o: Options) -> Texts:
    """The file's texts as the plan reads them; raises ValueError where the plan doesn't fit. Names, width and the types to look for come from the file's head; nothing is scanned."""
    encoding = plan.encoding or o.encoding
    if plan.strategy == "raw-lines":
        lines = spark.read.option("encoding", _SPARK_ENCODING.get(encoding, encoding)).text(path)
        return Texts(lines.withColumnRenamed("value", "line"), {})
    lines = _sample(path, encoding, o.skip_rows)
    rows = [split_line(x, plan.delimiter, plan.quote is not None) for x in lines]
    if plan.encoding is None and encoding == "utf-8" and any("�" in x for x in lines):
        raise ValueError("not UTF-8")
    width = max(map(len, rows), default=0) if o.null_padding else len(rows[0]) if rows else 0
    if width < plan.min_columns:
        raise ValueError(f"{width} columns, {plan.min_columns} asked for")
    counts = [len(r) for r in rows]
    if plan.min_columns > 1 and sum(c < 2 for c in counts) > len(counts) / 2:
        raise ValueError("most lines have one field")
    stated = o.has_header if o.header_explicit else None
    header = plan.header if plan.header is not None else stated if stated is not None else bool(rows) and looks_like_header(rows[0], rows[1] if len(rows) > 1 else None)
    names = (rows[0] if header and rows else []) + [f"column{i}" for i in range(len(rows[0]) if header and rows else 0, width)]
    names, _ = safe_names(names)
    if not names:
        raise ValueError("no column")
    reader = spark.read.options(sep=plan.delimiter, encoding=_SPARK_ENCODING.get(encoding, encoding), mode="DROPMALFORMED" if plan.lenient or o.ignore_errors else "PERMISSIVE", quote=plan.quote or "", escape=(o.escape or "\\") if plan.quote else "\\", enforceSchema=True, nullValue="", multiLine=False)
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    skip = o.skip_rows + (1 if header else 0)
    if skip <= 1:
        source = reader.option("header", str(skip == 1).lower()).schema(texts).csv(path)
    else:
        whole = spark.read.option("encoding", _SPARK_ENCODING.get(encoding, encoding)).text(path)
        dropped = set(_head_lines(path, encoding, skip))
        options = {"sep": plan.delimiter, "quote": plan.quote or "\0", "escape": (o.escape or "\\") if plan.quote else "\\", "nullValue": "", "mode": "PERMISSIVE"}
        # the preamble's lines, told by their text
        kept = whole.where(~F.col("value").isin(*dropped) & (F.trim("value") != ""))
        source = kept.select(F.from_csv("value", ", ".join(f"`{n}` STRING" for n in names), options).alias("r")).select("r.*")
    if plan.all_text or o.all_varchar:
        return Texts(source, {})
    body = rows[1:] if header else rows
    return Texts(source, {n: candidates([r[i] for r in body if i < len(r)]) for i, n in enumerate(names)})


def _head_lines(path: str, encoding: str, n: int) -> list[str]:
    text = head_of(path).decode(encoding, "replace").lstrip("﻿")
    return [x for x in re.split(r"\r?\n", text) if x.strip()][:n]


_KINDS = [("bigint", r"[+-]?\d{1,18}"), ("double", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"), ("boolean", r"(?i:true|false)"), ("date", r"\d{4}-\d{2}-\d{2}"), ("timestamp_ntz", r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?")]


def candidates(cells: list[str]) -> list[tuple[str, str]]:
    """The types that a sample of a column's values leaves, which only the whole column can confirm."""
    filled = [c.strip() for c in cells if c.strip()]
    return [(k, p) for k, p in _KINDS if all(re.fullmatch(p, c) for c in filled)]


@dataclass(frozen=True)
class Texts:
    """A table of texts, the types that each column may have, and whether these are wanted."""

    table: DataFrame
    may: dict[str, list[tuple[str, str]]]


def counted(t: Texts, given: dict[str, str]) -> tuple[DataFrame, list[int]]:
    """(columns in the narrowest type that all their values have, rows of each partition): one aggregation over the whole table, so that no later row can fail a type that a sample promised. Numbers of 18 digits at most are whole numbers."""
    parts: list[Column] = [F.count(F.lit(1)).alias("n")]
    checks = [(c, k, p) for c, kinds in t.may.items() if c not in given for k, p in kinds]
    for i, (c, k, p) in enumerate(checks):
        v = F.trim(F.col(f"`{c}`"))
        cast = F.expr(f"try_cast(trim(`{c}`) as {k}) is not null")
        # whole numbers are what the cast takes but for their length
        fits = cast & (F.length(v) < 19) if k == "bigint" else cast & v.rlike(f"^{p}$")
        parts += [F.bool_and(F.when(v.isNotNull(), fits)).alias(f"f{i}")]
    got = sorted(t.table.groupBy(F.spark_partition_id().alias("part")).agg(*parts).collect())  # a row for each partition
    kinds = dict(given)
    for i, (c, k, _) in enumerate(checks):
        some = [r[f"f{i}"] for r in got if r[f"f{i}"] is not None]
        if c not in kinds and some and all(some):
            kinds[c] = k
    sizes = [0] * (got[-1].part + 1 if got else 0)
    for r in got:
        sizes[r.part] = r.n
    df = t.table.select(*(F.expr(f"try_cast(trim(`{c}`) as {kinds[c]})").alias(c) if kinds.get(c, "string") != "string" else F.col(f"`{c}`") for c in t.table.columns))
    return df, sizes


def safe_names(names: list[str]) -> tuple[list[str], dict[str, str]]:
    """Names that are neither blank, reserved nor taken; and what was renamed."""
    used: set[str] = set()
    out, renamed = [], {}
    for raw in names:
        name = raw.strip() or "column"
        for taken, suffix in ((RESERVED, "_1"), (used, "_dup")):
            if name in taken:
                fresh, n = name + suffix, 1
                while fresh in used or fresh in RESERVED:
                    n += 1
                    fresh = f"{name}{suffix[:-1] if suffix == '_1' else suffix}{n}"
                renamed[raw] = fresh
                name = fresh
        used.add(name)
        out.append(name)
    return out, renamed


def projected(df: DataFrame, flatten: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """df with safe names, and with flatten the fields of its structs as columns parent.child, one level deep."""
    parts: list[tuple[Column, str]] = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if flatten and isinstance(f.dataType, T.StructType) and len(f.dataType):
            parts += [(c.getField(x.name), f"{f.name}.{x.name}") for x in f.dataType]
        else:
            parts.append((c, f.name))
    names, renamed = safe_names([n for _, n in parts])
    return df.select(*(c.alias(n) for (c, _), n in zip(parts, names, strict=True))), renamed


@dataclass
class Manifest:
    id: str
    path: str
    size: int
    mtime: float
    strategy: str
    columns: list[dict]
    rows: int
    renamed: dict[str, str]
    notes: list[str]
    options: dict
    delimiter: str | None = None


def choose(spark: SparkSession, path: str, o: Options, found: Detected) -> tuple[DataFrame, Plan]:
    """The first reading that works and is wide enough."""
    df, _, plan = chosen(spark, path, o, found)
    return df, plan


def chosen(spark: SparkSession, path: str, o: Options, found: Detected, count: bool = True) -> tuple[DataFrame, list[int] | None, Plan]:
    """(table, rows of each of its partitions where they are counted, plan); without counting, nothing but the file's head is read and all columns are texts."""
    if found.format == "unsupported":
        raise ValueError("tables only: delimited text and Parquet; open JSON and XML as documents")
    if found.format == "parquet":
        return spark.read.parquet(path), None, Plan("parquet-passthrough")
    o.skip_rows = o.skip_rows or found.skip_rows
    o.delimiter = o.delimiter or found.delimiter
    if o.encoding == "utf-8":
        o.encoding = found.encoding
    failed: list[str] = []
    for p in plans(o, found.candidates, found.suggest_quote):
        try:
            texts = read(spark, path, p, o)
            names = [n for n in texts.table.columns if not re.fullmatch(r"column\d+", n)]
            if not names and p.strategy == "csv-auto" and p.header is None and not o.header_explicit:
                first = texts.table.limit(1).collect()
                if first and looks_like_header(["" if v is None else str(v) for v in first[0]], None):
                    raise ValueError("the header was taken for data")
            return (*counted(texts, o.column_types), p) if count else (texts.table, None, p)
        except (ValueError, PySparkException) as e:
            failed.append(f"{p.strategy}: {e}")
    raise ValueError("; ".join(failed))


def preview(spark: SparkSession, path: str, o: Options | None = None, limit: int = 50) -> DataFrame:
    """The first rows as texts of at most PREVIEW_CHARS characters, read as the whole file would be."""
    df, _, _ = chosen(spark, path, o or Options(), detect(path), count=False)
    df = df.limit(max(1, min(int(limit), MAX_PREVIEW)))
    return df.select(*(F.substring(F.col(f"`{c}`").cast("string"), 1, PREVIEW_CHARS).alias(c) for c in df.columns))


def ingest(spark: SparkSession, path: str, folder: str, dataset: str, o: Options | None = None) -> Manifest:
    """path as a Parquet table at folder/base with a manifest beside it, put in place by one renaming; rows keep the file's order and their numbers. The pass that settles the types counts the rows of each split, so the pass that writes knows where each split begins."""
    o = o or Options()
    found = detect(path)
    df, sizes, plan = chosen(spark, path, o, found)
    df, renamed = projected(df, o.flatten)
    work = f"{folder}.{uuid.uuid4().hex}"
    if sizes is None:
        base = scan(spark, path)
        parts, _ = projected(base.withColumnRenamed(ROW, "row number"), o.flatten)
        base = parts.withColumnRenamed("row number", ROW)
        total = base.count()
    else:
        starts = [0]
        for n in sizes:
            starts.append(starts[-1] + n)
        total = starts.pop()
        start = F.get(F.lit(starts or [0]).cast("array<bigint>"), F.spark_partition_id())
        base = df.select("*", (start + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias(ROW))
    base.write.option("compression", "snappy").option("parquet.block.row.count.limit", 122_880).parquet(f"{work}/base")
    written, last = spark.read.parquet(f"{work}/base").agg(F.count(F.lit(1)), F.max(ROW)).first()
    if (written, last) != (total, total - 1 if total else None):
        shutil.rmtree(work, ignore_errors=True)
        raise RuntimeError(f"{path} changed while it was read")
    m = Manifest(dataset, path, found.size, found.mtime, plan.strategy, [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema], total, renamed, [*found.warnings, *([plan.note] if plan.note else [])], asdict(o), plan.delimiter)
    with open(f"{work}/manifest.json", "w") as f:
        json.dump(asdict(m), f)
    shutil.rmtree(folder, ignore_errors=True)
    os.replace(work, folder)
    return m


def opened(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, f"{folder}/base")
