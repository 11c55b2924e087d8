"""What the operators share: reading tables, tables in the shared folder, ranks and prefix sums without a single hot task."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Estimated bytes up to which a table is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset on one machine, as in tests, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stratalens-")
        atexit.register(shutil.rmtree, folder[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later steps restart from it, whichever executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/stratalens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that `stored` wrote and nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.fullmatch(r".*/stratalens/\w+-[0-9a-f]{32}", path):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, unless the session asks for other ones: a batch holds whole texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def with_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """A join in which small is broadcast if its rows, counted first, have at most BROADCAST_BYTES by estimate, and shuffled otherwise."""
    texts = [f.name for f in small.schema if isinstance(f.dataType, T.StringType)]
    length = sum((F.coalesce(F.length(c), F.lit(0)) for c in texts), F.lit(24 * len(small.columns)))
    return big.join(F.broadcast(small) if (small.agg(F.sum(length)).first()[0] or 0) <= BROADCAST_BYTES else small, on, how)


def in_order(df: DataFrame, by: list[str], name: str, add: dict[str, Column] | None = None) -> DataFrame:
    """df with `rank`, the 0-based position of each row in the order of the columns by, which should be unique; add: name -> numeric expression, of which the sum over all rows before is added under that name.

    One range exchange sorts the rows; each partition numbers its own, and the partitions' sizes and sums, one row each, give the offsets. No task has more than a partition's rows however few groups there are.
    """
    add = add or {}
    d = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    for k, x in add.items():
        d = d.withColumn(f"__a_{k}", x)
    d = stored(d, name).withColumns({"__part": F.shiftright("__at", 33), "__i": F.col("__at").bitwiseAND((1 << 33) - 1)})
    parts = d.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(f"__a_{k}").alias(f"__s_{k}") for k in add))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), *(F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in add))
    out = d.join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__before") + F.col("__i"))
    if add:
        within = Window.partitionBy("__part").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({k: F.col(f"__b_{k}") + F.coalesce(F.sum(f"__a_{k}").over(within), F.lit(0)) for k in add})
    return out.select(*df.columns, "rank", *add)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Edges (a, b) -> (node, root): the least node of each connected component, by alternating large and small stars; each round is a table in the shared folder, and their number grows with the logarithm of the size."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    size = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was, now = None, size(e)
    while was != now:
        low = Window.partitionBy("a")
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.withColumn("m", F.least(F.min("b").over(low), F.col("a"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        old = e
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        e = stored(large.withColumn("m", F.min("b").over(low)).select(F.explode(ends).alias("x")).select("x.*").where("a <> b").distinct(), name)
        was, now = now, size(e)
        dropped(old)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def has(df: DataFrame, column: str, kind: T.DataType) -> Column:
    """The column as kind, or null where df has no such column."""
    return F.col(column).cast(kind) if column in df.columns else F.lit(None).cast(kind)
