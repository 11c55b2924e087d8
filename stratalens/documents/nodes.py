"""The table of nodes, and walking it: children, one node, paths, search, counts."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.documents import parse
from stratalens.operators import rows

TYPES = {"doc": pa.string(), "rec": pa.int64(), "id": pa.int64(), "parent_id": pa.int64(), "ord": pa.int64(), "depth": pa.int32(), "kind": pa.int32(), "name": pa.string(), "value": pa.string(), "n_children": pa.int64(), "path": pa.string(), "key": pa.string()}
ROOT = 1
MAX_CHILDREN, MAX_VALUE, MAX_WHOLE, MAX_FOUND = 1000, 4096, 10_000_000, 500
#: Nodes and characters of text after which a batch of nodes is handed on.
BATCH_NODES, BATCH_CHARS = 20_000, 8 << 20
_READERS = {"json": parse.parse_json, "strict": lambda t: parse.parse_json(t, True), "xml": parse.parse_xml, "csv": parse.csv_nodes}


def _select(texts: DataFrame, more: list[str] | None = None) -> DataFrame:
    return texts.select(F.col("doc").cast("string"), F.col("rec").cast("long"), F.col("text").cast("string"), *(more or []))


def _batch(records: list[tuple[tuple, parse.Shape, list]], own: list[str], columns: list[str]) -> pa.RecordBatch:
    """Records (values of own, shape, values) as nodes: each shape's nodes stand once in a table from which the rows are taken, so that the work for a node isn't Python's."""
    starts: dict[int, int] = {}
    table: list[parse.Node] = []
    slots: list[int] = []
    for _, shape, _ in records:
        if id(shape) not in starts:
            starts[id(shape)] = len(table)
            table += shape.nodes
            slots += shape.slots
    sizes = np.array([len(s.nodes) for _, s, _ in records])
    record = np.repeat(np.arange(len(records)), sizes)
    at = np.arange(len(record)) + (np.array([starts[id(s)] for _, s, _ in records]) - (np.cumsum(sizes) - sizes))[record]
    taken = pa.array(at)

    def column(name: str) -> pa.Array:
        if name in own:
            return pa.array([r[0][own.index(name)] for r in records], TYPES.get(name, pa.int64())).take(pa.array(record))
        k = parse.Node._fields.index("parent" if name == "parent_id" else name)
        fixed = pa.array([x[k] for x in table], TYPES[name])
        if name != "value":
            return fixed.take(taken)
        counts = np.array([len(v) for _, _, v in records])
        slot = np.array(slots)[at]
        values = pa.array([v for _, _, vs in records for v in vs], pa.string())
        varied = values.take(pa.array((np.cumsum(counts) - counts)[record] + slot, mask=slot < 0))
        return pc.if_else(pa.array(slot < 0), fixed.take(taken), varied)

    return pa.RecordBatch.from_arrays([column(c) for c in columns], columns)


def shred(texts: DataFrame, format: str = "json", on_error: str = "raise", columns: list[str] | None = None, own: list[str] | None = None) -> DataFrame:
    """(doc, rec, text) -> nodes with ids local to their record, from 1, in pre-order; only these columns if they are named, as Spark can't leave out what Python makes. Records are read where they lie, no exchange; on_error="skip" drops the ones that can't be read (see `broken`). own: more columns of texts, numbers, that each node of a record repeats."""
    read = _READERS[format]
    own = ["doc", "rec", *(own or [])]
    columns = columns or [*own, *(c for c in TYPES if c not in own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = parse.Reader(read)
        for b in batches:
            texts_, rest = b.column(2).to_pylist(), [b.column(k).to_pylist() for k in range(b.num_columns) if k != 2]
            records: list[tuple[tuple, parse.Shape, list]] = []
            n = chars = 0
            for text, *ids in zip(texts_, *rest, strict=True):
                try:
                    shape, values = reader.read(text or "")
                except parse.Bad:
                    if on_error == "raise":
                        raise
                    continue
                if records and (n + len(shape.nodes) > BATCH_NODES or chars > BATCH_CHARS):
                    yield _batch(records, own, columns)
                    records, n, chars = [], 0, 0
                if len(shape.nodes) > BATCH_NODES:
                    for k in range(0, len(shape.nodes), BATCH_NODES):
                        yield _batch([(ids, parse.Shape(shape.nodes[k : k + BATCH_NODES], shape.slots[k : k + BATCH_NODES]), values)], own, columns)
                elif shape.nodes:
                    records.append((ids, shape, values))
                    n, chars = n + len(shape.nodes), chars + len(text)
            if records:
                yield _batch(records, own, columns)

    types = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int"}
    return _select(texts, own[2:]).mapInArrow(run, ", ".join(f"`{c}` {types[TYPES.get(c, pa.int64())]}" for c in columns))


def broken(texts: DataFrame, format: str = "json") -> DataFrame:
    """(doc, rec, message) of the records that can't be read."""
    read = _READERS[format]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, rec, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    read(text or "")
                except parse.Bad as e:
                    out.append((doc, rec, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["doc", "rec", "message"])

    return _select(texts).mapInArrow(run, "doc string, rec long, message string")


def _numbered(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, rec, __n, __tops, ...), a row for each record -> the same with __ids and __before, the nodes and tops of the document's records before, and __all, its tops; and (doc, __all), a row for each document. A range exchange sorts the records, and the sums of each part of a document, one row each, give the part's offsets: no task has all records of a large document."""
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = rows.stored(sizes.repartitionByRange(tasks, "doc", "rec").withColumn("__part", F.spark_partition_id()), "numbered")
    before = Window.partitionBy("doc").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda w: [F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("__n", "__tops")]
    parts = d.groupBy("doc", "__part").agg(F.sum("__n").alias("__n"), F.sum("__tops").alias("__tops"))
    ids, tops = sums(before)
    offsets = parts.select(F.col("doc").alias("__doc"), F.col("__part").alias("__of"), ids.alias("__ids0"), tops.alias("__before0"), F.sum("__tops").over(Window.partitionBy("doc")).alias("__all"))
    ids, tops = sums(Window.partitionBy("doc", "__part").orderBy("rec").rowsBetween(Window.unboundedPreceding, -1))
    out = d.withColumns({"__ids": ids, "__before": tops}).join(offsets, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("__part") == F.col("__of")))
    own = {"__ids": F.col("__ids") + F.col("__ids0"), "__before": F.col("__before") + F.col("__before0")}
    return out.withColumns(own).drop("__doc", "__of", "__ids0", "__before0", "__part"), parts.groupBy("doc").agg(F.sum("__tops").alias("__all"))


def _placed(nodes: DataFrame, docs: DataFrame, xml: bool) -> DataFrame:
    """Nodes with their records' __ids, __before and __all, by the document's numbering, and the roots."""
    top = F.col("parent_id").isNull()
    ord_ = F.when(top, F.col("ord") + F.col("__before")).otherwise(F.col("ord"))
    # every record's own tops are in order, and a path begins with its top's place where a document has several
    first = F.coalesce(F.regexp_extract("key", r"^i(\d+)", 1).cast("long"), F.lit(0)) + F.col("__before")
    lead = F.lit("") if xml else F.when(F.col("__all") == 1, F.lit("$")).otherwise(F.concat(F.lit("$["), first.cast("string"), F.lit("]")))
    body = nodes.select("doc", "rec", (F.col("id") + F.col("__ids") + ROOT).alias("id"), F.when(top, F.lit(ROOT).cast("long")).otherwise(F.col("parent_id") + F.col("__ids") + ROOT).alias("parent_id"), ord_.alias("ord"), "depth", "kind", "name", "value", "n_children", F.concat(lead, F.col("path")).alias("path"), "key")
    roots = docs.select("doc", F.lit(-1).cast("long").alias("rec"), F.lit(ROOT).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("ord"), F.lit(0).alias("depth"), F.lit(parse.ARRAY).alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"), F.col("__all").cast("long").alias("n_children"), F.lit("" if xml else "$").alias("path"), F.lit(None).cast("string").alias("key"))
    return roots.unionByName(body)


def document(nodes: DataFrame, xml: bool = False) -> DataFrame:
    """Nodes with one numbering a document: the synthetic root is 1, an array, then the records' nodes in order; of JSON with one value that value's path is $, of several $[i]. The offsets come from a row for each record, so only these are sorted by document; but the nodes are joined with them, which `shred_document` spares."""
    at, docs = _numbered(nodes.groupBy("doc", "rec").agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col("parent_id").isNull(), F.lit(1))).alias("__tops")))
    return _placed(nodes.join(at, ["doc", "rec"]), docs, xml)


def shred_document(texts: DataFrame, format: str = "json", on_error: str = "raise") -> DataFrame:
    """`document(shred(texts))`, but it is the texts that are counted, sorted and numbered, at once, and their nodes are made with their final places and stay where they are."""
    read = _READERS[format]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = parse.Reader(read)
        for b in batches:
            sizes: list[tuple[int, int]] = []
            for text in b.column(2).to_pylist():
                try:
                    found = reader.read(text or "")[0].nodes
                except parse.Bad:
                    if on_error == "raise":
                        raise
                    found = []
                sizes.append((len(found), sum(x.parent is None for x in found)))
            counts = [pa.array([s[k] for s in sizes], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *counts], ["doc", "rec", "text", "__n", "__tops"]).filter(pc.greater(counts[0], 0))

    at, docs = _numbered(_select(texts).mapInArrow(run, "doc string, rec long, text string, __n long, __tops long"))
    return _placed(shred(at, format, own=["__ids", "__before", "__all"]), docs, format == "xml")


def write(nodes: DataFrame, path: str) -> None:
    """The table stored by document, its rows by parent and order, so that a page of children is a few row groups."""
    nodes.repartition("doc").sortWithinPartitions("doc", "parent_id", "ord").write.mode("overwrite").partitionBy("doc").parquet(path)


def meta(nodes: DataFrame, format: str = "json") -> dict[str, object]:
    n, tops = nodes.agg(F.count(F.lit(1)), F.max(F.when(F.col("id") == ROOT, F.col("n_children")))).first()
    return {"format": format, "total_nodes": n, "root_id": 2 if tops == 1 else 1, "engine": "spark"}


def _shown(limit: int) -> list[Column]:
    return [F.substring("value", 1, limit).alias("value"), F.length("value").alias("value_length")]


def children(nodes: DataFrame, parent: int, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of a node's children; orders are dense, so that it is a range."""
    limit = max(1, min(int(limit), MAX_CHILDREN))
    page = nodes.where((F.col("parent_id") == parent) & (F.col("ord") >= offset) & (F.col("ord") < offset + limit))
    return page.select("id", "ord", "kind", "name", *_shown(MAX_VALUE), "n_children").orderBy("ord")


def node(nodes: DataFrame, id: int) -> DataFrame:
    return nodes.where(F.col("id") == id).select("id", "parent_id", "ord", "depth", "kind", "name", *_shown(MAX_WHOLE), "n_children", "path")


def path_of(nodes: DataFrame, id: int) -> str | None:
    got = nodes.where(F.col("id") == id).select("path").head()
    return got and got[0]


def ancestors(nodes: DataFrame, id: int) -> list[int]:
    """Ids from the root to the node. A pre-order node's ancestors are, of each smaller depth, the last before it, one aggregation in all."""
    depth = nodes.where(F.col("id") == id).select("depth").head()
    if depth is None:
        return []
    above = nodes.where((F.col("id") <= id) & (F.col("depth") < depth[0])).groupBy("depth").agg(F.max("id").alias("id")).orderBy("depth").collect()  # a row for each level
    return [r.id for r in above] + [id]


def at_path(nodes: DataFrame, path: str) -> DataFrame:
    """The first node of a path; for XML, /k[n] is the n-th k, from 1."""
    import re

    if path.startswith("/") and re.search(r"\[\d+\]", path):
        return _xml_at(nodes, path)
    return nodes.where(F.col("path") == path).orderBy("id").limit(1)


def _xml_at(nodes: DataFrame, path: str) -> DataFrame:
    import re

    now = nodes.where(F.col("id") == ROOT).select(F.col("id").alias("at"))
    for part in path.strip("/").split("/"):
        name, n = re.fullmatch(r"(.*?)(?:\[(\d+)\])?", part).groups()
        kind = parse.ATTRIBUTE if name.startswith("@") else parse.TEXT if name == "text()" else parse.ELEMENT
        match = (F.col("kind") == kind) & (F.lit(True) if kind == parse.TEXT else F.col("name") == name.lstrip("@"))
        w = Window.partitionBy("parent_id").orderBy("ord")
        now = nodes.join(F.broadcast(now), F.col("parent_id") == F.col("at"), "left_semi").where(match).withColumn("__k", F.row_number().over(w)).where(F.col("__k") == int(n or 1)).select(F.col("id").alias("at"))
    return nodes.join(F.broadcast(now), F.col("id") == F.col("at"), "left_semi")


def found(nodes: DataFrame, query: str | list[str], scope: str = "all", exact: bool = False, regex: bool = False) -> DataFrame:
    """Nodes whose name or value (scope: all, keys, values or attributes) has the query in it in any case, is it exactly, or matches it; of several queries, one of them, in one pass."""
    one = (lambda c, q: c == q) if exact else (lambda c, q: c.rlike(q)) if regex else (lambda c, q: F.contains(F.lower(c), F.lower(F.lit(q))))
    test = lambda c: reduce(operator.or_, (one(F.col(c), q) for q in ([query] if isinstance(query, str) else query)))
    parts = {"keys": lambda: [test("name")], "values": lambda: [test("value")], "attributes": lambda: [(F.col("kind") == parse.ATTRIBUTE) & (test("name") | test("value"))]}.get(scope, lambda: [test("name"), test("value")])()
    return nodes.where(reduce(operator.or_, (F.coalesce(p, F.lit(False)) for p in parts)))


def search(nodes: DataFrame, query: str, scope: str = "all", exact: bool = False, after: int = 0, limit: int = 100, regex: bool = False) -> DataFrame:
    """A page of matches in the order of their ids, beginning after one."""
    limit = max(1, min(int(limit), MAX_FOUND))
    return found(nodes, query, scope, exact, regex).where(F.col("id") > after).select("id", "parent_id", "ord", "kind", "name", *_shown(MAX_VALUE), "n_children", "path").orderBy("id").limit(limit)


def trigrams(nodes: DataFrame) -> DataFrame:
    """An index (gram, doc, id) of the runs of three characters, in small letters, of names and values."""
    parts = F.array(F.lower("name"), F.lower("value"))
    grams = F.flatten(F.transform(F.filter(parts, lambda x: F.length(x) > 2), lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3)))))
    return nodes.select("doc", "id", F.explode(F.array_distinct(grams)).alias("gram")).select("gram", "doc", "id")


def write_index(nodes: DataFrame, path: str) -> None:
    """The index stored by gram, so that a query reads the row groups of its own runs."""
    trigrams(nodes).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(path)


def drop_index(spark: SparkSession, path: str) -> bool:
    """Deletes a stored index; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def matches(nodes: DataFrame, query: str, scope: str = "all", limit: int = 5000) -> list[dict]:
    """Path, name and value of the first matches, for `export.matches_as_text`."""
    rows = found(nodes, query, scope).select("id", "path", "name", "value").orderBy("id").limit(min(int(limit), 5000)).collect()
    return [{"path": r.path, "name": r.name, "value": r.value} for r in rows]


def search_indexed(nodes: DataFrame, index: DataFrame, query: str, scope: str = "all") -> DataFrame:
    """The matches of a query of three characters or more by the index: nodes that have all its runs, then looked at."""
    q = query.lower()
    grams = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    if not grams:
        return found(nodes, query, scope)
    ids = index.where(F.col("gram").isin(grams)).groupBy("doc", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    return found(nodes.join(ids, ["doc", "id"], "left_semi"), query, scope)


def stats(nodes: DataFrame, parent: int) -> DataFrame:
    """One row on a node's children: how many, of each kind, how many different values, and the range and mean of its numbers."""
    return child_stats(nodes.where(F.col("parent_id") == parent))


def child_stats(kids: DataFrame, by: list[str] | None = None) -> DataFrame:
    number = F.when(F.col("kind") == parse.NUMBER, F.expr("try_cast(value as double)"))
    counts = [F.count(F.when(F.col("kind") == k, F.lit(1))).alias(n) for k, n in enumerate(parse.KINDS)]
    return kids.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("children"), *counts, F.count_distinct("value").alias("distinct_values"), F.min(number).alias("min"), F.max(number).alias("max"), F.avg(number).alias("avg"))


def read_lines(spark: SparkSession, path: str, doc: str) -> DataFrame:
    """The lines of an NDJSON file or folder as (doc, rec, text), blank ones left out."""
    lines = spark.read.text(path).select(F.lit(doc).alias("doc"), F.monotonically_increasing_id().alias("rec"), F.col("value").alias("text"))
    return lines.where(F.trim("text") != "")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """Each file whole, as (doc: its path, rec: 0, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.lit(0).cast("long").alias("rec"), F.col("value").alias("text"))


def read_yaml(texts: DataFrame) -> DataFrame:
    """(doc, rec, text) with YAML texts turned into JSON; asks for the package yaml, which isn't one of ours."""

    @F.pandas_udf("string")
    def convert(s):
        import json

        import yaml

        return s.map(lambda t: None if t is None else json.dumps(yaml.safe_load(t), ensure_ascii=False, default=str))

    return texts.withColumn("text", convert("text"))
