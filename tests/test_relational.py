"""Relational operators, sinks, gates and matching on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from windrose.operators import analytics, quality, resolve, sinks
from windrose.operators import relational as rel

DAY = lambda n: dt.date(2024, 1, n)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_latest_and_asof(spark):
    s = spark.createDataFrame([(1, DAY(1), 1, 1.0), (1, DAY(5), 2, 1.1), (1, DAY(5), 3, 1.2), (2, None, 4, 0.9), (2, DAY(2), 5, 0.8)], "k int, day date, id int, v double")
    assert rows(rel.latest_per_key(s, "k", ["day", "id"]), "k") == [(1, DAY(5), 3, 1.2), (2, DAY(2), 5, 0.8)]
    left = spark.createDataFrame([(10, 1, DAY(1)), (11, 1, DAY(4)), (12, 1, DAY(5)), (13, 2, DAY(1)), (14, 3, DAY(9))], "e int, k int, at date")
    got = rel.asof_join(left, s.filter("day IS NOT NULL"), "k", "at", "day", "e", "id").select("e", "id")
    assert rows(got, "e") == [(10, 1), (11, 1), (12, 3), (13, None), (14, None)]


def test_expected_share_falls_back(spark):
    r = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (2, 5.0), (3, None), (3, 1.0)], "race int, rating double")
    got = rows(rel.expected_share(r, ["race"], "rating"), "race", "rating")
    assert [x[2] for x in got] == [1.0, pytest.approx(1 / 3), pytest.approx(1 / 3), None, None, None]


def test_head_to_head_and_components(spark):
    r = spark.createDataFrame([("e", None, 1, 1), ("e", None, 2, 2), ("f", "x", 1, 2), ("f", "x", 2, 1), ("f", None, 3, 1)], "event string, race string, boat int, place int")
    assert (1, 2, 1, 1, 2) in rows(analytics.head_to_head(r, "boat", ["event", "race"], "place"))
    c = spark.createDataFrame([(1, "AUS1&2"), (2, "2&77"), (3, "77"), (4, "FRA9"), (5, None)], "result_id int, sail string")
    assert rows(resolve.token_groups(c).select("result_id", "group_id"), "result_id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]


def test_certificate_rules(spark):
    boats = spark.createDataFrame([(1, "AUS1213", "Foo", "AUS"), (2, "AUS9999", "Bar", "AUS"), (3, "77", "Zed", "GBR"), (4, "GBR55", "Twin", "GBR"), (5, "IRL55", "Other", "IRL")], "boat_id int, boat_sail string, boat_name string, boat_country string")
    certs = spark.createDataFrame([(1, "EAUS1213", "x", "AUS"), (2, "77", "nobody", "GBR"), (3, "77", "zed", "GBR"), (4, "55", "twin - sec", "GBR"), (5, "55", "?", "IRL"), (6, "none", "bar", "AUS"), (7, "none", "bar", "FRA")], "result_id int, sail string, name string, country string")
    got = {r.result_id: (r.boat_id, r.method) for r in resolve.certificate_match(certs, boats).collect()}
    assert got == {1: (1, "token"), 2: (None, "skipped"), 3: (3, "token"), 4: (4, "token_name"), 5: (5, "token_country"), 6: (2, "name_country"), 7: (None, "unmatched")}


def test_similar_pairs_equal_all_pairs(spark):
    names = ["sun fish", "sunfish", "sun fisher", "moon", "moonlight", "fish sun", "", None]
    x = spark.createDataFrame([(n,) for n in names], "x string")
    y = x.withColumnRenamed("x", "y")
    from windrose.functions.text import trigram_similarity

    for least in (0.3, 0.5, 0.9):
        want = x.crossJoin(y).withColumn("s", trigram_similarity("x", "y")).filter(F.col("s") >= least).select("x", "y")
        assert rows(resolve.similar_pairs(x, y, "x", "y", least).select("x", "y"), "x", "y") == rows(want, "x", "y")


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (None, "m", 1)], "k int, v string, _batch long")
    assert rows(rel.upsert(old, new, ["k"]), "k") == [(None, "m"), (1, "a"), (2, "d"), (3, "e")]
    assert rows(rel.insert_ignore(old, new.drop("_batch"), ["k"]), "k")[0] == (None, "n")
    path = str(tmp_path / "t")
    old.write.parquet(path)
    sinks.upsert_table(spark, path, new, ["k"])
    assert spark.read.parquet(path).count() == 4
    ids = rows(sinks.with_ids(spark.createDataFrame([(7, "x"), (None, "b"), (None, "a")], "id long, v string"), "id", 7, ["v"]), "id")
    assert ids == [(7, "x"), (8, "a"), (9, "b")]


def test_change_detection(spark):
    old = spark.createDataFrame([("a", DAY(1), 1), ("b", DAY(1), 1)], "k string, day date, v int")
    new = spark.createDataFrame([("a", DAY(3), 1), ("b", DAY(3), 2), ("c", DAY(3), 9)], "k string, day date, v int")
    assert rows(sinks.change_upsert(old, new, ["k"], "day", ["v"]), "k", "day") == [("a", DAY(3), 1, False), ("b", DAY(1), 1, False), ("b", DAY(3), 2, True), ("c", DAY(3), 9, True)]
    t, audit = sinks.audited_update(old, "k", "a", "v", 5, "me", "2024-01-01")
    assert rows(t, "k")[0] == ("a", DAY(1), 5) and audit.first().old == "1"


def test_merge_keeps_the_better_row(spark):
    s = spark.createDataFrame([(1, DAY(1), 2020, "w"), (2, DAY(1), 2021, "l"), (2, DAY(2), None, "m"), (3, DAY(1), 1, "o"), (1, DAY(4), 5, "tie"), (2, DAY(4), 5, "lost")], "boat int, day date, cert_year int, v string")
    losers = spark.createDataFrame([(2, 1)], "loser int, winner int")
    got = resolve.merge_rows(s, losers, "boat", ["day"], [F.coalesce("cert_year", F.lit(0)).desc()])
    assert [(r.boat, r.day.day, r.v) for r in got.orderBy("boat", "day").collect()] == [(1, 1, "l"), (1, 2, "m"), (1, 4, "tie"), (3, 1, "o")]
    assert rows(resolve.merge_rows(got, losers, "boat", ["day"], [F.desc("cert_year")]), "boat", "day") == rows(got, "boat", "day")  # once more changes nothing


def test_robust_aggregates(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5, 6, 7, 8, 9, 1000)] + [("b", 1.0), ("b", 4.0)], "g string, v double")
    assert rows(rel.winsorised_means(df, "g", ["v"]), "g") == [("a", 104.6), ("b", 2.5)]  # of ten, the places 1 and 9
    m = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "q"), ("b", "p")] + [("c", str(i)) for i in range(6)], "k string, v string")
    assert rows(rel.modal_value(m, "k", "v").select("k", "mode"), "k") == [("a", "x"), ("b", "p"), ("c", None)]


def test_filter_language_never_runs_text(spark):
    df = spark.createDataFrame([(1, "Sun Fish"), (2, None), (3, "Moon")], "id int, name string")
    n = lambda e: df.filter(rel.row_filter(df, e)).count()
    assert [n(e) for e in ("id=2", "id!=2", "id>=2", "name~fish", "name:null", "name:not_null", "sunFISH", "1 OR 1=1", "nope=3")] == [1, 2, 2, 1, 1, 2, 1, 0, 0]


def test_gates_and_names(spark):
    g = spark.createDataFrame([(0.9, 0.8, 10), (0.9, 0.5, 10), (0.9, 0.5, 2), (0.5, 1.0, 10), (None, 1.0, 10)], "c double, r double, b int")
    assert [r.accepted for r in quality.gate(g, "c", "r", "b").collect()] == [True, False, True, False, False]
    a = spark.createDataFrame([("u", "Sun Fish"), ("u", "Moon"), ("u", "XY"), ("w", "Solo")], "url string, name string")
    b = spark.createDataFrame([("u", "sunfish"), ("u", "Moonlight III"), ("u", "xyz"), ("v", "Solo")], "url string, name string")
    assert {(r.a, r.b) for r in quality.match_names(a, b, "url", "name").collect()} == {("Sun Fish", "sunfish"), ("Moon", "Moonlight III")}
    said = spark.createDataFrame([(1, "rated 1.05, not 9.9, of 12")], "k int, s string")
    ok = spark.createDataFrame([(1, 1.0487), (1, -12.0)], "k int, v double")
    assert {r.x for r in quality.number_audit(said, "k", "s", ok, "v").collect()} == {9.9}


def test_modal_segment_gives_the_operator_every_customer(spark, monkeypatch):
    from windrose.plans import operations

    seen = []
    monkeypatch.setattr(operations.rel, "modal_value", lambda df, *a: seen.append(df) or df)
    operations.modal_segment(spark, "/root/testdata/sf0.001")
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert seen[0].count() == customers > seen[0].filter("c_mktsegment IS NOT NULL").count() > 0
