"""Partition lifecycle, parsers and streaming."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.sources import io, parsers
from driftline.streaming import hourly


def day_rows(spark, rows):
    return spark.createDataFrame(rows, "id long, label string, d string").select("id", "label", F.to_date("d").alias(io.DAY))


def test_partitions(spark, tmp_path):
    s = io.Store(spark, f"file://{tmp_path}/root")
    s.write("t", day_rows(spark, [(1, "a", "2024-01-01"), (2, "b", "2024-01-02")]))
    s.write("t", day_rows(spark, [(3, "c", "2024-01-02")]))
    s.write("t", day_rows(spark, [(3, "c", "2024-01-02")]))
    assert sorted(r["id"] for r in s.read("t").collect()) == [1, 3]
    assert s.days("t") == ["2024-01-01", "2024-01-02"]
    assert s.window("t", "2024-01-08", 7).count() == 2 and s.window("t", "2024-01-09", 7).count() == 1
    s.merge("t", "2024-01-02", spark.createDataFrame([(3, "z")], "id long, label string"), ["id"], "label")
    assert {r["id"]: r["label"] for r in s.read("t").collect()} == {1: "a", 3: "z"}
    s.update_where("t", "2024-01-01", "label", F.lit("n"), F.col("id") == 1)
    assert s.day("t", "2024-01-01").first()["label"] == "n"
    new = s.first_writer_wins("t", day_rows(spark, [(3, "z", "2024-01-03"), (4, None, "2024-01-03"), (4, None, "2024-01-03")]), ["id", "label"], "2024-01-03")
    assert [r["id"] for r in new.collect()] == [4]
    other = io.Store(spark, f"file://{tmp_path}/other")
    other.copy_days("t", s, "2024-01-01", "2024-01-02")
    assert other.days("t") == ["2024-01-01", "2024-01-02"]
    assert s.delete_days(["t", "none"], ["2024-01-01"]) == [] and "2024-01-01" not in s.days("t")
    with pytest.raises(PermissionError):
        io.Store(spark, s.root, read_only=True).write("t", s.read("t"))
    s.create_like("u", T.StructType().add("a", T.LongType()))
    assert s.read("u").count() == 0


def test_sanitize_and_assert(spark):
    d = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (1.5, 3)], "x double, k int")
    assert [r["x"] for r in io.sanitize(d).orderBy("k").collect()] == [None, None, 1.5]
    assert io.assert_rows(d, F.col("k") > 0, "positive").count() == 3
    with pytest.raises(Exception, match="under three"):
        io.assert_rows(d, F.col("k") < 3, "under three").collect()


def test_days_and_files():
    assert len(io.missing_baseline(["2026-06-01"], "2026-06-09")) == 7
    assert len(io.missing_baseline(["2026-06-02", "2026-06-03"], "2026-06-09")) == 5
    assert len(io.fill_list([], ["2026-06-09"])) == 8
    big = 200 << 20
    files = [("x_2024-01-01.mmdb", big), ("x_2024-01-05.mmdb", big), ("x_2024-01-03.mmdb", 5), ("x_bad.mmdb", big)]
    assert io.closest_snapshot(files, "2024-01-03") == "x_2024-01-01.mmdb"
    assert io.closest_snapshot([], "2024-01-03") is None
    assert io.day_or_near({"2024-01-02", "2024-01-04"}, "2024-01-03") == "2024-01-02"
    assert io.day_or_near({"2024-01-05"}, "2024-01-03") == "2024-01-05"
    names = ["20240101.v2.x", "20240115.v10.x", "20230901.v99.x"]
    assert io.best_version(names, "2024-01-20") == "20240115.v10.x"


def test_rdns(spark):
    """Answers at either place, several answers, other record types, other states, and lines that are no JSON."""
    record = lambda *pairs: {"answers": [{"type": k, "answer": v} for k, v in pairs]}
    nested = lambda status, data: {"PTR": {"status": status, "timestamp": "2023-05-06T07:08:09Z", "data": data}}
    lines = [
        {"name": "192.0.2.10", "results": nested("NOERROR", record(("CNAME", "alias.example."), ("PTR", "edge1.fra.example.net.")))},
        {"name": "198.51.100.20", "status": "NOERROR", "timestamp": "2023-05-06T07:08:10Z", "data": record(("PTR", "core.example.org."), ("PTR", "second.example.org."))},
        {"name": "203.0.113.30", "results": nested("SERVFAIL", record(("PTR", "ignored.example.")))},
        {"name": "203.0.113.31", "results": nested("NOERROR", record())},
        {"name": "2001:db8::40", "results": nested("NOERROR", record(("TXT", "text")))},
        {"results": nested("NOERROR", record(("PTR", "nameless.example.")))},
    ]
    d = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("{not json",), ("",)], "value string")
    got = {r["ip"]: (r["hostname"], str(r["timestamp"])) for r in parsers.rdns(d).collect()}
    assert {k: v[0] for k, v in got.items()} == {"192.0.2.10": "edge1.fra.example.net.", "198.51.100.20": "core.example.org.", "203.0.113.30": None, "203.0.113.31": None, "2001:db8::40": None}
    assert got["198.51.100.20"][1] == "2023-05-06 07:08:10"


def test_text_tables(spark, tmp_path):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    got = parsers.prefix_origins(t("10.0.0.0\t8\t12,13", "1.0.0.0\t24\t64512", "2.0.0.0\t24\t4200000001", "bad")).collect()
    assert [tuple(r) for r in got] == [("10.0.0.0", 8, 12)]
    assert [tuple(r) for r in parsers.exchange_members(t("# c", "1.2.3.4\t5\tname ", "1\t2", "1\t2\t3\t4")).collect()] == [("1.2.3.4", 5, "name")]
    rows = [(1, 1, "1.1.1.1,x,Paris,s,st,FR,1.0,2.0,0.9,z"), (2, 1, "1.1.1.1,x,Lyon,s,st,FR,3.0,4.0,0.9,z"), (1, 2, "2.2.2.2\tx\tWashington, D.C.\ts\tst\tUS\t1\t2\t0.1\tz")]
    g = parsers.geo_csv(spark.createDataFrame(rows, "file_date int, line_no int, value string"))
    assert {r["ip"]: (r["city"], r["lat"]) for r in g.collect()} == {"1.1.1.1": ("Paris", 3.0), "2.2.2.2": ("Washington D.C.", 1.0)}
    f = tmp_path / "e.csv"
    f.write_text("title\nrank,as,name,cc,users\n1,AS5,n,US,10\n2,AS5,n,CA,7\n3,x,n,US,1\n")
    assert [tuple(r) for r in parsers.eyeballs(spark, f"file://{f}").collect()] == [(5, "n", [7, 10])]
    h = spark.createDataFrame([(" A.b.",), ("c",)], "hostname string")
    assert [r[0] for r in parsers.uncached(h, spark.createDataFrame([("a.B",)], "hostname string")).collect()] == ["c"]
    a = spark.createDataFrame([(1,), (2,)], "asn int")
    people = spark.createDataFrame([(1, [5, 6])], "asn int, population array<int>")
    places = spark.createDataFrame([(1, ["f"])], "asn int, facilities array<string>")
    names = spark.createDataFrame([(1, "v")], "asn int, registered_name string")
    assert {tuple(map(str, r)) for r in parsers.as_metadata(a, people, places, names).collect()} == {("1", "[5, 6]", "['f']", "v"), ("2", "[]", "[]", "")}


def test_raw_scans(spark, tmp_path):
    """Client metadata, exchange files with their dates, records of networks, windows of annotations."""
    meta = "array<struct<Name:string,Value:string>>"
    up = spark.createDataFrame([("2024-01-01", [("tool", "x"), ("access_token", "t1")], 1.5), ("2024-01-01", [("access_token", "t2"), ("access_token", "t3")], 2.5), ("2024-01-01", [], 3.5), ("2024-01-01", None, 4.5), ("2024-01-02", [("access_token", "t9")], 5.5)], f"d string, ClientMetadata {meta}, rtt double")
    up = up.select(F.to_date("d").alias("date"), F.struct(F.struct("ClientMetadata").alias("Upload")).alias("raw"), "rtt")
    got = parsers.uploads_by_token(up, "2024-01-01").select("token", "rtt").collect()
    assert sorted(map(tuple, got)) == [("t1", 1.5), ("t2", 2.5), ("t3", 2.5)]
    for day, asn in (("2024-02-01", 7), ("2024-02-08", 8)):
        (tmp_path / f"members_{day}.txt").write_text(f"# head\n192.0.2.1\t{asn}\tname\n")
    (tmp_path / "members_undated.txt").write_text("192.0.2.2\t9\tname\n")
    assert sorted((r["asn"], str(r["date"])) for r in parsers.exchange_files(spark, f"file://{tmp_path}/members_*.txt").collect()) == [(7, "2024-02-01"), (8, "2024-02-08"), (9, "None")]
    (tmp_path / "as.ndjson").write_text('{"asn": "64496", "asnName": "one", "organization": {"orgName": "org"}}\n{"asn": "x"}\nnot json\n{"asn": "64497"}\n')
    assert sorted(map(tuple, parsers.network_records(spark, f"file://{tmp_path}/as.ndjson").collect()), key=str) == [(64496, "one", "org"), (64497, None, None)]
    h = spark.createDataFrame([("2024-01-15",), ("2023-12-10",), ("2023-12-20",), ("2024-01-20",)], "d string").select(F.to_date("d").alias("date"))
    assert sorted(str(r["date"]) for r in parsers.annotation_window(h, "2024-01-15").collect()) == ["2023-12-20", "2024-01-15"]


def test_run_cost(spark, tmp_path):
    """Bytes by query from an event log, dearest first."""
    from driftline.plans import legacy

    start = lambda i, what: {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": i, "description": what}
    job = lambda i, stages: {"Event": "SparkListenerJobStart", "Stage IDs": stages, "Properties": {"spark.sql.execution.id": str(i)}}
    task = lambda stage, n: {"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Task Metrics": {"Input Metrics": {"Bytes Read": n}}}
    log = [start(0, "cheap"), start(1, "dear"), job(0, [0]), job(1, [1, 2]), task(0, 5), task(1, 2**39), task(2, 2**39), task(9, 7), {"Event": "SparkListenerTaskEnd", "Stage ID": 0}]
    (tmp_path / "log").write_text("\n".join(json.dumps(x) for x in log))
    assert [(r["query"], r["bytes"], r["usd"]) for r in legacy.cost(spark, f"file://{tmp_path}/log").collect()] == [("dear", 2**40, 6.25), ("cheap", 5, pytest.approx(0, abs=1e-6))]


def test_hourly_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"file://{tmp_path}/in")
    q = hourly.hourly(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["hour"], r["event_type"]): r["n"] for r in hourly.hourly(e).collect()}
    assert {(r["hour"], r["event_type"]): r["n"] for r in spark.table("hours").collect()} == want
    assert hourly.first_rows(e, ["user_id"]).count() == e.select("user_id").distinct().count()
