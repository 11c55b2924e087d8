"""Row numbers, which Spark doesn't have by itself: of the rows of files, and of the rows of a sorted table."""

from __future__ import annotations

import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "__rn"
PART, PLACE, VIEW_ROW = "__part", "__place", "__vrn"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with ROW, each row's 0-based number in the order of the files' names and of the rows in them. The number of one file's rows is its row index; of several, counts from the footers give the offsets, one a file."""
    df = spark.read.parquet(path)
    names = df.columns
    if ROW in names:
        return df
    if len(df.inputFiles()) < 2:
        return df.select("*", F.col("_metadata.row_index").alias(ROW))
    counts = sorted((r[0], r[1]) for r in df.groupBy(F.col("_metadata.file_path")).agg(F.count(F.lit(1))).collect())
    starts = list(accumulate((n for _, n in counts), initial=0))
    offsets = spark.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], "__file string, __start long")
    numbered = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    return numbered.join(F.broadcast(offsets), "__file").select(*names, (F.col("__start") + F.col("__index")).alias(ROW))


def in_order(df: DataFrame, keys: list[Column]) -> DataFrame:
    """df sorted by keys over all partitions, with PART and PLACE, a row's partition and its place there. One range exchange; no task has more rows than a partition."""
    at = F.monotonically_increasing_id()
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", at).withColumns({PART: F.shiftright("__at", 33).cast("int"), PLACE: F.col("__at").bitwiseAND((1 << 33) - 1)}).drop("__at")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over as many tasks as the session's shuffles have. A file is read by as many tasks as it has row groups, often one, and work that is long for each row, as parsing is, would stay with them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def part_sizes(df: DataFrame) -> list[tuple[int, int, int]]:
    """(part, first view row, rows) of a stored table that in_order sorted: a row for each partition, whatever the number of rows."""
    sizes = sorted((r[0], r[1]) for r in df.groupBy(PART).agg(F.count(F.lit(1))).collect())
    starts = accumulate((n for _, n in sizes), initial=0)
    return [(p, s, n) for (p, n), s in zip(sizes, starts, strict=False)]


def between(df: DataFrame, sizes: list[tuple[int, int, int]], start: int, stop: int) -> DataFrame:
    """The rows start <= VIEW_ROW < stop; conditions on PART and PLACE, which the scan can prune by."""
    hit = [(p, s, n) for p, s, n in sizes if s < stop and s + n > start]
    if not hit:
        return df.where(F.lit(False)).withColumn(VIEW_ROW, F.lit(0).cast("long"))
    condition = None
    for p, s, n in hit:
        c = (F.col(PART) == p) & (F.col(PLACE) >= max(0, start - s)) & (F.col(PLACE) < min(n, stop - s))
        condition = c if condition is None else condition | c
    return df.where(condition).withColumn(VIEW_ROW, F.col(PLACE) + view_start(hit))


def view_start(sizes: list[tuple[int, int, int]]) -> Column:
    """The first view row of a row's part, from a literal array by part."""
    starts = {p: s for p, s, _ in sizes}
    low = min(starts, default=0)
    table = F.array(*(F.lit(starts.get(p, 0)).cast("long") for p in range(low, max(starts, default=0) + 1)))
    return F.get(table, F.col(PART) - low)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that all executors share, spark.checkpoint.dir (where that is unset on one machine, a temporary one), and read again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stratalens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/stratalens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
