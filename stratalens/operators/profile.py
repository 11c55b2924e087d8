"""Profiles of columns: counts, ranges, moments, top values, histograms; one aggregation serves any number of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stratalens.functions import kind_of, text_form
from stratalens.operators.rows import ROW
from stratalens.operators.viewspec import contains, quoted

BUCKETS = 12


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def profile_column(df: DataFrame, name: str, exact: bool = False) -> DataFrame:
    """One row: column, rows, non_null, nulls, empty, distinct, avg_length, min, max, avg, stddev. Distinct values are estimated unless exact; min and max are texts, avg and stddev (of the population) are there for numbers."""
    dtype, c = df.schema[name].dataType, quoted(name)
    txt, kind = text_form(c, dtype), kind_of(dtype)
    number = c.cast("double") if kind == "numeric" else F.lit(None).cast("double")
    low, high = (f(c if kind in ("numeric", "temporal") else txt) for f in (F.min, F.max))
    text = (lambda x: text_form(x, dtype)) if kind in ("numeric", "temporal") else (lambda x: x)
    return df.agg(
        F.lit(name).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(c).alias("non_null"), _count(c.isNull()).alias("nulls"), _count(txt == "").alias("empty"),
        (F.count_distinct(txt) if exact else F.approx_count_distinct(txt)).alias("distinct"), F.avg(F.length(txt)).alias("avg_length"),
        text(low).alias("min"), text(high).alias("max"), F.avg(number).alias("avg"), F.stddev_pop(number).alias("stddev"))


def top_values(df: DataFrame, name: str, n: int = 20, like: str | None = None, most: int = 200) -> DataFrame:
    """(value, count) of the n most frequent values as text, nulls a value like others, ties by value; like keeps those that contain it, in any case."""
    txt = text_form(quoted(name), df.schema[name].dataType).alias("value")
    d = df.select(txt)
    if like:
        d = d.where(contains(F.col("value"), like, False))
    return d.groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(max(1, min(int(n), most)))


def distinct_values(df: DataFrame, name: str, limit: int = 100, like: str | None = None) -> DataFrame:
    return top_values(df, name, limit, like, 1000)


def histogram(df: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, lo, hi, label, count) of equal-width buckets from the least to the greatest number, the last with its upper end; empty buckets are absent, and there is none where all numbers are equal."""
    x = quoted(name).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None or not float("-inf") < low < high < float("inf"):
        return df.sparkSession.createDataFrame([], "bucket int, lo double, hi double, label string, count long")
    width = (high - low) / buckets
    b = F.least(F.lit(buckets - 1), F.floor((x - F.lit(low)) / F.lit(width)).cast("int")).alias("bucket")
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(b).agg(F.count(F.lit(1)).alias("count"))
    lo = F.lit(low) + F.col("bucket") * F.lit(width)
    hi = F.when(F.col("bucket") == buckets - 1, F.lit(high)).otherwise(lo + F.lit(width))
    label = F.udf(lambda a, b: f"{short(a)} – {short(b)}", "string")  # a call for each bucket, not for each row
    return counts.select("bucket", lo.alias("lo"), hi.alias("hi"), "count").withColumn("label", label("lo", "hi"))


def short(v: float) -> str:
    if v == int(v):
        return str(int(v))
    if abs(v) >= 1000:
        return f"{v:.0f}"
    return f"{v:.2f}" if abs(v) >= 1 else f"{v:#.3g}"


def profile_all(df: DataFrame, exact: bool = False) -> DataFrame:
    """(column, type, rows, non_null, nulls, empty, distinct) of every column: one aggregation over one scan, turned into rows afterwards."""
    fields = [f for f in df.schema if f.name != ROW]
    parts: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = quoted(f.name)
        txt = text_form(c, f.dataType)
        # only texts can be empty, and distinct values are those of the column where its text tells them apart
        empty = _count(c == "") if isinstance(f.dataType, T.StringType) else F.lit(0).cast("long")
        same = txt if kind_of(f.dataType) == "nested" else c
        parts += [F.count(c).alias(f"n{i}"), empty.alias(f"e{i}"), (F.count_distinct(same) if exact else F.approx_count_distinct(same)).alias(f"d{i}")]
    one = df.agg(*parts)
    entries = F.array(*(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("rows"), F.col(f"n{i}").alias("non_null"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"), F.col(f"e{i}").alias("empty"), F.col(f"d{i}").alias("distinct")) for i, f in enumerate(fields)))
    return one.select(F.explode(entries).alias("x")).select("x.*")


def coverage(df: DataFrame, name: str, n: int = 20) -> DataFrame:
    """(value, count, share, cumulative): the top values with their shares of all rows, in percent, and the running sums of these."""
    total = df.select(F.count(F.lit(1)).alias("total"))
    top = top_values(df, name, n, None, 1000).crossJoin(F.broadcast(total))
    w = Window.orderBy(F.desc("count"), F.asc_nulls_last("value"))  # n rows
    share = F.col("count") * 100.0 / F.col("total")
    return top.select("value", "count", share.alias("share"), F.sum(share).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
