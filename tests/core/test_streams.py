import datetime as dt

from stratalens.streaming import records


def test_records_that_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text('{"a":1}\nbroken{\n\n{"a":2}\n')
    q = records.node_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    (tmp_path / "in" / "b.ndjson").write_text('{"a":3}\n')
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.table("arrived").where("path = '.a'").collect()) == ["1", "2", "3"]


def test_windows(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m, tzinfo=dt.timezone.utc)
    spark.createDataFrame([(at(1), "x", 1), (at(4), "x", 2), (at(6), "y", 3), (at(59), "x", 4)], "ts timestamp, kind string, v long").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("ts timestamp, kind string, v long").parquet(str(tmp_path / "e"))
    q = records.windowed(events, "ts", "5 minutes", "10 minutes", ["kind"], "v").writeStream.format("memory").outputMode("append").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window_start.minute, r.kind, r.n, r.total) for r in spark.table("windows").collect()}
    assert got == {(0, "x", 2, 3), (5, "y", 1, 3)}
