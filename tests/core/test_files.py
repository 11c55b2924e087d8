import gzip
import json

import pytest
from pyspark.sql import functions as F

from stratalens.operators import rows
from stratalens.operators.viewspec import Filter, Search, Sort, ViewSpec
from stratalens.session import Workbench
from stratalens.sources import detect as d
from stratalens.sources import export, ingest
from stratalens.sources.ingest import Options


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


BODY = [("id", "name", "price"), ("1", "bolt", "0.5"), ("2", "nut", "1.25"), ("3", "hose", "7")]


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|", "~", "^", "\x01"])
def test_delimiters(tmp_path, delimiter):
    got = d.detect(put(tmp_path / "a.txt", "".join(delimiter.join(r) + "\n" for r in BODY)))
    assert (got.delimiter, got.has_header, got.skip_rows) == (delimiter, True, 0)
    assert got.confidence == 0.95
    assert got.format == {",": "csv", "\t": "tsv", "|": "psv"}.get(delimiter, "delimited")


def test_preamble_and_quotes(tmp_path):
    got = d.detect(put(tmp_path / "a.csv", "Sales export\n" + "".join(",".join(r) + "\n" for r in BODY)))
    assert (got.delimiter, got.skip_rows, got.has_header) == (",", 1, True)
    got = d.detect(put(tmp_path / "b.csv", 'size|id\n3/4" NPT|1\n5" x|2\n7|3\n'))
    assert (got.delimiter, got.suggest_quote) == ("|", None)


def test_encodings(tmp_path):
    text = "naïve,café\n1,é\n2,é\n"
    assert d.detect(put(tmp_path / "a", text, "latin-1")).encoding == "latin-1"
    assert d.detect(put(tmp_path / "b", text, "utf-16")).encoding == "utf-16"
    assert d.detect(put(tmp_path / "c", text, "utf-8-sig")).encoding == "utf-8"
    assert d.detect(put(tmp_path / "d", "a,b\n" * 100, "utf-16-le")).encoding == "utf-16"
    late = b"a,b\n" * 200_000 + b"\xe9,1\n" * 50_000
    (tmp_path / "e").write_bytes(late)
    assert d.detect(str(tmp_path / "e")).encoding == "latin-1"


def test_contents_count_more_than_names(tmp_path):
    assert d.detect(put(tmp_path / "a.csv", '{"a": 1}')).format == "unsupported"
    (tmp_path / "b.csv").write_bytes(b"PAR1....")
    assert d.detect(str(tmp_path / "b.csv")).format == "parquet"
    assert d.detect(put(tmp_path / "c.csv", "")).confidence == 0.1
    (tmp_path / "d.csv.gz").write_bytes(gzip.compress(b"a,b\n1,2\n3,4\n"))
    got = d.detect(str(tmp_path / "d.csv.gz"))
    assert (got.compression, got.delimiter) == ("gzip", ",")
    with pytest.raises(FileNotFoundError):
        d.detect(str(tmp_path))


def test_headers_and_small_sniffers():
    assert d.looks_like_header(["a", "2024", "b", "c"], ["1", "2", "3", "4"])
    assert not d.looks_like_header(["1", "2"], ["3", "4"])
    assert not d.looks_like_header(["a", "a", "a"], ["b", "b", "b"])
    assert not d.looks_like_header([], None)
    assert d.split_line('a,"b ""x"", c",d', ",") == ["a", 'b "x", c', "d"]
    assert [d.most_frequent_delimiter(x) for x in ("a;b;c,d", '"a,b,c";d', "a|b", "abc")] == [";", ";", "|", ","]
    assert [d.sniff_text(x) for x in (' {"a"', "[1", "<a>", "a\tb", "a,b", "x")] == ["json", "json", "xml", "tsv", "csv", "json"]
    assert [d.document_format(x) for x in ("a.jsonl", "a.XML", "a")] == ["ndjson", "xml", "json"]


def test_raw_slice(tmp_path):
    path = put(tmp_path / "a", "".join(f"line {i}\n" for i in range(1000)))
    got = d.raw_slice(path, 103, 50)
    assert got["text"].startswith("line ") and got["text"].endswith("\n")
    assert not got["at_end"]
    assert d.raw_slice(path, 10**9, 10)["at_end"]


def read(spark, path, **o):
    df, plan = ingest.choose(spark, path, Options(**o), d.detect(path))
    return df, plan


def test_types_and_short_and_long_rows(spark, tmp_path):
    path = put(tmp_path / "a.csv", "id,name,day,ok,zip\n1,x,2024-01-02,true,02134\n2,,2024-02-03,false,1\n3,z\n4,w,2024-01-01,true,5,more\n")
    df, plan = read(spark, path)
    assert plan.strategy == "csv-auto"
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "day": "date", "ok": "boolean", "zip": "bigint", "column5": "string"}
    got = {r.id: r for r in df.collect()}
    assert got[2].name is None and got[3].day is None and got[4].column5 == "more"


def test_ladder(spark, tmp_path):
    assert [r[0] for r in read(spark, put(tmp_path / "a", "alpha\nbeta\ngamma\n"))[0].collect()] == ["beta", "gamma"]
    df, plan = read(spark, put(tmp_path / "b.csv", "id;name\n1;café\n", "latin-1"))
    assert [tuple(r) for r in df.collect()] == [(1, "café")]
    df, plan = read(spark, put(tmp_path / "c.csv", "Title\n\nid,name\n1,x\n2,y\n"))
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x"), (2, "y")]
    df, plan = read(spark, put(tmp_path / "d.csv", "1,2\n3,4\n"))
    assert df.columns == ["column0", "column1"] and df.count() == 2
    df, plan = read(spark, put(tmp_path / "e.psv", 'id|size\n1|3/4" NPT\n2|5" x\n'))
    assert sorted(tuple(r) for r in df.collect()) == [(1, '3/4" NPT'), (2, '5" x')]
    df, plan = read(spark, put(tmp_path / "f.csv", "a,b\n1,2\n"), delimiter=";", delimiter_explicit=True, quote='"')
    assert len(df.columns) == 1
    df, plan = read(spark, put(tmp_path / "g.csv", "a,b\n1,2\n"), column_types={"a": "string"})
    assert dict(df.dtypes) == {"a": "string", "b": "bigint"}
    df, plan = read(spark, put(tmp_path / "h.csv", "a,b\n1,2\n"), all_varchar=True)
    assert dict(df.dtypes) == {"a": "string", "b": "string"}
    with pytest.raises(ValueError, match="tables only"):
        read(spark, put(tmp_path / "i.json", "{}"))


def test_names():
    assert ingest.safe_names(["a", "a", "", "__rn", " "])[0] == ["a", "a_dup", "column", "__rn_1", "column_dup"]


def test_structs_are_flattened(spark):
    df = spark.createDataFrame([((1, "x"), 2)], "s struct<a:int,b:string>, c int")
    assert ingest.projected(df, True)[0].columns == ["s.a", "s.b", "c"]
    assert ingest.projected(df)[0].columns == ["s", "c"]


@pytest.fixture
def bench(spark, tmp_path):
    return Workbench(spark, str(tmp_path / "cache"))


def test_workbench(spark, tmp_path, bench):
    path = put(tmp_path / "a.csv", "id,name,price\n" + "".join(f"{i},item {i % 10},{i / 4}\n" for i in range(500)))
    m = bench.open_dataset(path)
    assert (m["rows"], m["cached"]) == (500, False)
    assert bench.open_dataset(path)["cached"]
    x = m["id"]
    assert bench.preview_rows(path, limit=2) == [{"id": "0", "name": "item 0", "price": "0.0"}, {"id": "1", "name": "item 1", "price": "0.25"}]
    assert [r["id"] for r in bench.get_page(x, offset=100, limit=3)] == ["100", "101", "102"]
    spec = ViewSpec(filters=(Filter("name", "eq", "ITEM 3"),), sort=(Sort("id", "desc"),))
    assert [r["id"] for r in bench.get_page(x, spec, 0, 3)] == ["493", "483", "473"]
    assert bench.build_view(x, spec)["rows"] == 50
    assert json.loads(bench.get_row_json(x, spec, 1)) == {"id": 483, "name": "item 3", "price": 120.75}
    s = Search("13")
    assert bench.count_matches(x, spec, s) == sum("13" in f"{i} {i / 4}" for i in range(3, 500, 10))
    assert bench.find_next_match(x, spec, s, 49) == bench.find_next_match(x, spec, s, -1)
    p = bench.profile_column(x, "price", spec)
    assert (p["rows"], p["min"], p["max"]) == (50, "0.75", "123.25")
    assert sum(h["count"] for h in p["histogram"]) == 50
    assert [r["column"] for r in bench.profile_all(x)] == ["id", "name", "price"]
    assert bench.distinct_values(x, "name", limit=2) == [{"value": "item 0", "count": 50}, {"value": "item 1", "count": 50}]
    assert bench.run_sql(x, "SELECT count(*) AS n FROM data")["rows"] == [(500,)]
    assert bench.run_sql_on_view(x, spec, 'SELECT count(*) AS n, (SELECT count(*) FROM source) AS m FROM "data"')["rows"] == [(50, 500)]
    out = str(tmp_path / "out.csv")
    bench.export_view(x, spec, out, limit=2)
    assert open(out).read() == "id,name,price\n493,item 3,123.25\n483,item 3,120.75\n"
    bench.export_view(x, spec, out, source_rows=[3, 13, 14])
    assert open(out).read() == "id,name,price\n13,item 3,3.25\n3,item 3,0.75\n"
    bench.export_view(x, spec, out, view_rows=[0])
    assert open(out).read() == "id,name,price\n493,item 3,123.25\n"
    other = put(tmp_path / "b.csv", "id,name,price\n" + "".join(f"{i},item {i % 9},{i / 4}\n" for i in range(1, 501)))
    y = bench.open_dataset(other)["id"]
    diff = bench.diff_datasets(x, y, ["id"])
    assert (diff["only_left"], diff["only_right"], diff["left_rows"]) == (1, 1, 500)
    assert {c["column"] for c in diff["columns"] if c["changed"]} == {"name"}
    assert diff["examples"][0]["changed_columns"] == ["name"]
    with pytest.raises(ValueError):
        bench.diff_datasets(x, y, columns=["nothing"])
    assert len(bench.list_datasets()) == 2 and bench.cache_info()["bytes"] > 0
    assert spark.read.parquet(bench.parquet_of(x)).count() == 500
    fresh = Workbench(spark, str(tmp_path / "cache"))
    assert fresh.open_dataset(path)["cached"] and fresh.build_view(x, spec)["rows"] == 50
    assert bench.clear_views() >= 1 and bench.close_dataset(y) and not bench.close_dataset(y)
    with pytest.raises(KeyError):
        bench.get_page(y)
    assert bench.remove_cache_entry(x) and bench.set_cache_limit(1) == 512 << 20 and bench.clear_cache() == 1
    assert bench.ping() == "pong" and bench.init()["limit"] == 512 << 20 and bench.stats()["datasets"] == 0 and bench.progress() is None
    assert bench.detect(path)["delimiter"] == "," and bench.raw_slice(path, 0, 10)["offset"] == 0


def test_cancel(spark, bench):
    import threading
    import time

    failed = []

    def slow():
        with bench.job("view-x"):
            try:
                spark.range(8, numPartitions=8).select(F.udf(lambda i: time.sleep(30) or i, "long")("id")).collect()
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    t = threading.Thread(target=slow)
    t.start()
    for _ in range(40):
        bench.cancel("view-")
        t.join(0.5)
    assert not t.is_alive() and failed


def test_order_is_kept_over_many_splits(spark, tmp_path):
    path = put(tmp_path / "a.csv", "id,x\n" + "".join(f"{i},{'y' * 50}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        m = ingest.ingest(spark, path, str(tmp_path / "t"), "t")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert m.rows == 20_000
    assert ingest.opened(spark, str(tmp_path / "t")).where(F.col("id") != F.col(rows.ROW)).count() == 0


@pytest.mark.parametrize(("format", "want"), [("csv", 'a,b\n1,"x,""y"""\n,\n'), ("tsv", 'a\tb\n1\t"x,""y"""\n\t\n'), ("psv", 'a|b\n1|"x,""y"""\n|\n'), ("xlsx-csv", '\ufeffa,b\n1,"x,""y"""\n,\n')])
def test_exports(spark, tmp_path, format, want):
    df = spark.createDataFrame([(1, 'x,"y"'), (None, None)], "a int, b string").coalesce(1)
    export.export(df, str(tmp_path / "o"), format)
    assert (tmp_path / "o").read_bytes().decode() == want


def test_more_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, None]), (2, None)], "a int, b array<int>").coalesce(1)
    export.export(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).collect() == df.collect()
    export.export(df, str(tmp_path / "j"), "json")
    assert [json.loads(x) for x in open(tmp_path / "j")] == [{"a": "1", "b": "[1,null]"}, {"a": "2", "b": None}]
    export.export(df, str(tmp_path / "c.gz"), "csv", compression="gzip", header=False)
    assert gzip.decompress((tmp_path / "c.gz").read_bytes()) == b'1,"[1,null]"\n2,\n'
    assert export.export(df, str(tmp_path / "parts"), "csv", one_file=False) > 0
    with pytest.raises(ValueError):
        export.export(df, str(tmp_path / "x"), "xlsx")
    assert export.matches_as_text([{"path": "$.a", "name": "a", "value": "x,y"}], "csv") == 'path,name,value\n$.a,a,"x,y"\n'
