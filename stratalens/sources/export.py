"""Views written as files."""

from __future__ import annotations

import csv
import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import text_form
from stratalens.operators.rows import ROW, VIEW_ROW
from stratalens.operators.views import Built

MAX_SELECTION, MAX_JSON = 200_000, 200_000
SEPARATORS = {"csv": ",", "tsv": "\t", "psv": "|", "xlsx-csv": ","}


def chosen(built: Built, view_rows: list[int] | None = None, source_rows: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """The view's rows in its order, or those of the given view or source row numbers."""
    df = built.numbered()
    for rows, column in ((view_rows, VIEW_ROW), (source_rows, ROW)):
        if rows is not None:
            if len(rows) > MAX_SELECTION:
                raise ValueError(f"at most {MAX_SELECTION} rows can be selected, export the whole view instead")
            ids = df.sparkSession.createDataFrame([(int(r),) for r in set(rows)], f"`{column}` long")
            df = df.join(F.broadcast(ids), column, "left_semi")
    df = df.orderBy(VIEW_ROW)
    return (df.limit(int(limit)) if limit else df).select(*(f"`{c}`" for c in built.columns))


def export(df: DataFrame, path: str, format: str = "csv", header: bool = True, delimiter: str | None = None, compression: str = "none", one_file: bool = True) -> int:
    """df as one file (or a folder of parts, in order by their names, which is the way for large ones); its size in bytes. Files are put in place by a renaming."""
    work = f"{path}.{uuid.uuid4().hex}"
    if format == "parquet":
        writer = df.write.option("compression", compression if compression != "none" else "zstd")
        (df.coalesce(1).write.option("compression", compression if compression != "none" else "zstd") if one_file else writer).parquet(work)
    elif format == "json":
        texts = df.select(*(text_form(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema)).limit(MAX_JSON)
        (texts.coalesce(1) if one_file else texts).write.option("ignoreNullFields", "false").json(work)
    elif format in SEPARATORS:
        texts = df.select(*(text_form(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))
        options = {"sep": delimiter or SEPARATORS[format], "header": str(header).lower(), "escape": '"', "emptyValue": '""', "compression": compression, "lineSep": "\n"}
        (texts.coalesce(1) if one_file else texts).write.options(**options).csv(work)
    else:
        raise ValueError(f"unknown export format: {format}")
    if not one_file:
        shutil.rmtree(path, ignore_errors=True)
        os.replace(work, path)
        return sum(f.stat().st_size for f in Path(path).rglob("*") if f.is_file())
    part = next(f for f in sorted(Path(work).iterdir()) if f.name.startswith("part-"))
    if format == "xlsx-csv" and compression == "none":
        with open(part, "rb") as a, open(f"{work}.bom", "wb") as b:
            b.write("﻿".encode())
            shutil.copyfileobj(a, b)
        os.replace(f"{work}.bom", path)
    else:
        os.replace(part, path)
    shutil.rmtree(work, ignore_errors=True)
    return os.path.getsize(path)


def matches_as_text(rows: list[dict], format: str = "json") -> str:
    """Search matches (path, name, value) as JSON or CSV."""
    if format == "json":
        return json.dumps(rows, ensure_ascii=False, indent=2)
    from io import StringIO

    out = StringIO()
    w = csv.DictWriter(out, ["path", "name", "value"], lineterminator="\n")
    w.writeheader()
    w.writerows(rows)
    return out.getvalue()
