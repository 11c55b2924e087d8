"""Sharding by proportional stratified interleaving (operator 5) and mixing sources to target weights by a low-discrepancy schedule (operator 9).

All orders are total and come from range exchanges over (source, hash) or over numbers that spread evenly, so a hot source is cut into as many tasks as its size asks for.

Defined cases: a null source is a source of its own; repeated rows are sharded each on its own, while in mixing the rows of one doc_id travel together, with their tokens added and the least source; in mixing, rows with a null doc_id aren't scheduled (mixed() puts them at the end); a null or empty text has no token; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.llm import common

SHARDS, SHARD_SEED = 64, 5
#: Tokens (words) of a block, exponent of the sources' token counts that gives the default target weights, seed of the shuffle.
BLOCK_TOKENS, TEMPER, MIX_SEED = 4096, 0.9, 9
#: A source whose weight would make the schedule longer than this many times all blocks is raised to the weight that doesn't.
MAX_LENGTH = 4
GOLDEN = 0.6180339887498949
_CELLS = 4096


def shuffle_key(column: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))))


def stratum(column: Column) -> Column:
    """A text that isn't null and differs for null and ''."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: int = SHARD_SEED) -> DataFrame:
    """(doc_id, source, position, shard) of every row: rows are shuffled within their source, row r of the n of a source gets the fraction (r + 1/2) / n, and the order of the fractions is cut into `shards` runs of equal size (to one row), so that each shard, like every other stretch, has the whole table's mixture to about one row a source."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    d = d.withColumns({"part": stratum(F.col("source")), "key": shuffle_key(F.col("doc_id"), seed)})
    d = common.in_order(d, ["part", "key", "doc_id"], "strata")
    sizes = d.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    d = common.with_small(d, sizes, "part", "inner").withColumn("fraction", (F.col("rank") - F.col("first") + F.lit(0.5)) / F.col("n"))
    d = common.in_order(d.select("doc_id", "source", "fraction", "part", "key"), ["fraction", "part", "key", "doc_id"], "fractions")
    total = d.count()
    return d.select("doc_id", "source", F.col("rank").alias("position"), F.floor(F.col("rank") * shards / F.lit(max(1, total))).cast("int").alias("shard"))


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = MIX_SEED, temper: float = TEMPER, max_length: float = MAX_LENGTH) -> DataFrame:
    """(slot, epoch, doc_id, source, block, n_tokens): which documents each slot of the mixture has.

    The documents of a source, shuffled, are cut into blocks of block_tokens tokens (a document belongs to the block in which it starts; a block that lies within one long document is empty). Slot i takes the point frac(1/2 + i * golden ratio) through the cumulative target weights to its source; the slot's rank r among that source's slots names block r mod blocks of epoch r div blocks. The schedule ends with the slot that gives the last source its last block: every document comes at least once, sources above their natural share come again, in further epochs, and every stretch of slots has the target weights to a few blocks. So that a tiny source can't make the others come again and again, a source gets at least the weight by which its blocks fit into max_length times all blocks.

    weights: by source; sources without a weight, or with none above 0, are left out. By default the weights follow (tokens + 1) ** temper.
    """
    d = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(stratum(F.col("source"))).alias("part"), F.sum(F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x00-\x20]+")), F.lit(0)).cast("long")).alias("n_tokens"))
    d = common.in_order(d.withColumn("key", shuffle_key(F.col("doc_id"), seed)), ["part", "key", "doc_id"], "sources", {"before": F.col("n_tokens")})
    d = d.withColumn("token", F.col("before"))
    starts = d.groupBy("part").agg(F.min("before").alias("first"))
    d = common.with_small(d, starts, "part", "inner").withColumn("block", F.floor((F.col("token") - F.col("first")) / block_tokens))
    d = common.stored(d.select("doc_id", "part", "block", "rank", "n_tokens"), "blocks")
    sizes = d.groupBy("part").agg((F.max("block") + 1).alias("blocks"), F.sum("n_tokens").alias("tokens"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("tokens") + F.lit(1.0), F.lit(temper)))
    else:
        given = [("-" if k is None else f"={k}", float(v)) for k, v in weights.items() if v > 0]
        sizes = common.with_small(sizes, docs.sparkSession.createDataFrame(given, "part string, w double"), "part", "inner")
    every, upto = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("part")  # a row for each source
    sizes = sizes.withColumn("w", F.greatest(F.col("w") / F.sum("w").over(every), F.col("blocks") / (F.sum("blocks").over(every) * F.lit(float(max_length)))))
    sizes = sizes.withColumn("w", F.col("w") / F.sum("w").over(every)).withColumn("hi", F.sum("w").over(upto)).withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0.0)))
    sizes = common.stored(sizes.withColumn("hi", F.when(F.lead("part").over(upto).isNull(), 2.0).otherwise(F.col("hi"))), "sizes")
    need = sizes.agg(F.max(F.col("blocks") / F.col("w")), F.min("w")).first()
    slots = 0 if need[0] is None else math.ceil(need[0] + (8 + 6 * math.log(need[0] + 2)) / need[1])  # beyond the sequence's discrepancy; cut below
    points = docs.sparkSession.range(slots).select(F.col("id").alias("slot"), (F.lit(0.5) + F.col("id") * F.lit(GOLDEN)).alias("u")).withColumn("u", F.col("u") - F.floor("u")).withColumn("cell", F.floor(F.col("u") * _CELLS))
    cells = sizes.select("part", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * _CELLS), F.least(F.floor(F.col("hi") * _CELLS), F.lit(_CELLS - 1).cast("long")))).alias("cell"))
    taken = common.with_small(points, cells, "cell", "inner").where("u >= lo and u < hi").select("slot", "part", "blocks")
    taken = common.in_order(taken, ["part", "slot"], "slots")
    taken = common.with_small(taken, taken.groupBy("part").agg(F.min("rank").alias("first")), "part", "inner").withColumn("r", F.col("rank") - F.col("first"))
    last = taken.where(F.col("r") == F.col("blocks") - 1).agg(F.max("slot")).first()[0]
    taken = taken.where(F.col("slot") <= F.lit(-1 if last is None else last)).select("slot", "part", F.floor(F.col("r") / F.col("blocks")).alias("epoch"), (F.col("r") % F.col("blocks")).alias("block"))
    source = F.when(F.col("part") != "-", F.substring("part", 2, 1 << 30)).alias("source")
    return d.join(taken, ["part", "block"]).select("slot", "epoch", "doc_id", source, "block", "n_tokens", F.col("rank").alias("__within"))


def mixed_order(docs: DataFrame, **parameters) -> DataFrame:
    return schedule(docs, **parameters).drop("__within")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """docs, all columns, once for each time the schedule has them and in its order (files and row groups follow the slots); rows with a null doc_id come last, once."""
    plan = common.stored(schedule(docs, **parameters).select("slot", F.col("__within").alias("within"), F.col("doc_id").alias("planned")), "schedule")
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.withColumnsRenamed(names)
    plan = plan.withColumnRenamed("planned", names["doc_id"])
    out = common.with_small(inner, plan, names["doc_id"], "inner")
    rest = inner.where(F.col(names["doc_id"]).isNull()).withColumns({"slot": F.lit((1 << 62)), "within": F.lit(0).cast("long")})
    out = out.unionByName(rest).repartitionByRange("slot", "within").sortWithinPartitions("slot", "within")
    return out.select(*(F.col(v).alias(k) for k, v in names.items()))


INTERLEAVED_SQL = f"""WITH d AS (SELECT doc_id, source, coalesce('=' || source, '-') AS part, md5('{SHARD_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
f AS (SELECT *, (row_number() OVER (PARTITION BY part ORDER BY key, doc_id) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY part) AS fraction FROM d),
p AS (SELECT doc_id, source, row_number() OVER (ORDER BY fraction, part, key, doc_id) - 1 AS position, count(*) OVER () AS n FROM f)
SELECT doc_id, source, position, CAST(floor(position * {SHARDS} / n) AS INTEGER) AS shard FROM p"""

SCHEDULE_SQL = f"""WITH t AS (SELECT doc_id, min(coalesce('=' || source, '-')) AS part, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\\x00-\\x20]+')), 0)) AS BIGINT) AS n_tokens FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
b AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY part ORDER BY md5('{MIX_SEED}:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {BLOCK_TOKENS} AS block FROM t),
s AS (SELECT part, max(block) + 1 AS blocks, pow(sum(n_tokens) + 1.0::DOUBLE, {TEMPER}::DOUBLE) AS w FROM b GROUP BY part),
g AS (SELECT part, blocks, greatest(w / sum(w) OVER (), blocks / (sum(blocks) OVER () * {MAX_LENGTH}.0::DOUBLE)) AS w FROM s),
c AS (SELECT part, blocks, w / sum(w) OVER () AS w FROM g),
k AS (SELECT *, sum(w) OVER (ORDER BY part) AS hi FROM c),
l AS (SELECT part, blocks, w, coalesce(lag(hi) OVER (ORDER BY part), 0) AS lo, CASE WHEN lead(part) OVER (ORDER BY part) IS NULL THEN 2 ELSE hi END AS hi FROM k),
m AS (SELECT CAST(ceil(max((blocks + 200) / w)) AS BIGINT) AS n FROM l),
i AS (SELECT unnest(range(n)) AS slot FROM m),
u AS (SELECT slot, 0.5::DOUBLE + slot * {GOLDEN}::DOUBLE AS x FROM i),
z AS (SELECT slot, part, blocks, row_number() OVER (PARTITION BY part ORDER BY slot) - 1 AS r FROM u JOIN l ON x - floor(x) >= lo AND x - floor(x) < hi),
e AS (SELECT max(slot) AS last FROM z WHERE r = blocks - 1)
SELECT slot, CAST(r // z.blocks AS BIGINT) AS epoch, doc_id, CASE WHEN z.part <> '-' THEN substr(z.part, 2) END AS source, CAST(b.block AS BIGINT) AS block, n_tokens
FROM z JOIN e ON slot <= last JOIN b ON b.part = z.part AND b.block = z.r % z.blocks"""
