import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.functions import text_form
from stratalens.operators import rows, sqlconsole, views
from stratalens.operators.viewspec import Filter, Search, Sort, ViewSpec, filter_column, is_identity, view_key
from stratalens.plans import star

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("x", [0.0, -0.0, 1.5, 12345678.9, -12345678.0, 1e15, 1e16, 1.5e16, 0.001, 0.0001, 0.00001, -1.25e-7, 1e300, float("inf"), float("nan"), 123456789012345680.0, 9999999.0, 10000000.0])
def test_real_numbers_as_text(spark, x):
    got = spark.createDataFrame([(x,)], "x double").select(text_form(F.col("x"), T.DoubleType())).first()[0]
    assert got == repr(x)


def test_filters_reach_the_scan(spark, capsys):
    spec = ViewSpec(filters=(Filter("l_quantity", "gt", "25"),), select=("l_orderkey",))
    views.view(star.table(spark, FOLDER, "lineitem"), spec).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(l_quantity,25.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,_tmp_metadata_row_index:bigint>" in plan


def test_row_numbers_over_several_files(spark, tmp_path):
    spark.range(1000).repartition(4).write.parquet(str(tmp_path / "t"))
    got = rows.scan(spark, str(tmp_path / "t")).select(rows.ROW).collect()
    assert sorted(r[0] for r in got) == list(range(1000))


def test_pages(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k"), F.col("id").alias(rows.ROW))
    built = views.build(df, ViewSpec(sort=(Sort("k", "desc"), Sort("id"))), str(tmp_path / "v"))
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    for start in (0, 150, 990, 2000):
        got = [r["__source_row"] for r in views.page(built, start, 100).collect()]
        assert got == want[start : start + 100]
    assert built.count == 1000
    assert len(views.page(built, 0, 10**9).collect()) == 1000
    again = views.build(df, ViewSpec(sort=(Sort("k", "desc"), Sort("id"))), str(tmp_path / "v"), fresh=False)
    assert [r.id for r in views.page(again, 5, 3).collect()] == [str(i) for i in want[5:8]]


def test_empty_view(spark, tmp_path):
    built = views.build(spark.range(10).withColumn(rows.ROW, F.col("id")), ViewSpec(filters=(Filter("id", "gt", "50"),)), str(tmp_path / "v"))
    assert views.page(built, 0, 10).collect() == []
    assert views.row_json(built, 0) is None
    assert views.find_match(built, Search("1"), -1) is None


def test_row_as_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None, [1, 2])], "a int, b string, c array<int>").withColumn(rows.ROW, F.lit(0).cast("long"))
    text = views.row_json(views.build(df, ViewSpec(), ""), 0)
    import json

    assert json.loads(text) == {"a": 1, "b": None, "c": [1, 2]}
    assert text.startswith("{\n  ")


def test_cells_are_cut(spark):
    df = spark.createDataFrame([("x" * 30,)], "a string").withColumn(rows.ROW, F.lit(0).cast("long"))
    assert views.page(views.build(df, ViewSpec(), ""), 0, 1, 20).first().a == "x" * 20 + "…"


def test_nested_columns(spark):
    df = spark.createDataFrame([(1, {"x": None}), (2, {"x": "needle"})], "id int, s struct<x:string>").withColumn(rows.ROW, F.col("id").cast("long"))
    find = lambda nested: [r.id for r in views.view(df, ViewSpec(search=Search("needle", include_nested=nested))).collect()]
    assert find(False) == []
    assert find(True) == [2]
    assert [r.id for r in views.ordered(df, ViewSpec(sort=(Sort("s"),))).collect()] == [2, 1]
    assert [r.id for r in views.view(df, ViewSpec(filters=(Filter("s", "eq", '{"x":null}'),))).collect()] == [1]


def test_literals(spark):
    fields = {"i": T.ByteType(), "d": T.DateType()}
    with pytest.raises(ValueError, match="range"):
        filter_column(Filter("i", "eq", "300"), fields)
    with pytest.raises(ValueError, match="unknown filter"):
        filter_column(Filter("i", "like", "3"), fields)
    with pytest.raises(ValueError, match="look-around"):
        filter_column(Filter("i", "regex", "(?=x)"), fields)
    df = spark.sql("SELECT DATE '2024-01-02' AS d").withColumn(rows.ROW, F.lit(0).cast("long"))
    count = lambda *f: views.view(df, ViewSpec(filters=(Filter(*f),))).count()
    assert count("d", "eq", "2024/01/02") == 1
    assert count("d", "eq", "2024-13-02") == 0
    assert count("d", "contains", "01-0") == 1


def test_view_keys():
    schema = T.StructType().add("a", "integer").add("b", "integer")
    a, b = Filter("a", "eq", "1"), Filter("b", "eq", "2")
    key = lambda **k: view_key("d", ViewSpec(**k), schema)
    assert key(filters=(a, b)) == key(filters=(b, a)) != key(filters=(a,))
    assert key(sort=(Sort("a"), Sort("b"))) != key(sort=(Sort("b"), Sort("a")))
    assert key(select=("a", "b")) == key(select=("b", "a"))
    assert key(filters=(Filter("a", "eq", "1", enabled=False),)) == key()
    assert is_identity(ViewSpec(filters=(Filter("a", "eq", "1", enabled=False),), search=Search("")))


@pytest.mark.parametrize("sql", ["DROP TABLE x", "CREATE TABLE x (a INT)", "INSERT INTO x VALUES (1)", "SET a = 1", "DELETE FROM x", "SELECT 1; SELECT 2", "", "-- nothing", "UPDATE x SET a = 1", "TRUNCATE TABLE x", "CACHE TABLE x", "ADD JAR 'x'"])
def test_console_refuses(spark, sql):
    with pytest.raises(Exception):  # noqa: B017
        sqlconsole.query(sqlconsole.console(spark), sql)


def test_console(spark):
    s = sqlconsole.console(spark)
    got = sqlconsole.run(s, "SELECT 'drop table' AS \"a b\", x FROM range(10) t(x) ORDER BY x DESC -- set", 3)
    assert [tuple(r) for r in got.rows.collect()] == [("drop table", 9), ("drop table", 8), ("drop table", 7)]
    assert got.truncated
    assert got.types == {"a b": "string", "x": "bigint"}
    assert not sqlconsole.run(s, "SELECT 1", 1).truncated
    assert sqlconsole.query(s, "DESCRIBE SELECT 1 AS a").first()[0] == "a"
