"""Upkeep on hand-made rows, and the data source interface."""

import pytest
from pyspark.sql import functions as F

from windrose.operators import upkeep
from windrose.sources import registry


def test_new_boats(spark):
    r = spark.createDataFrame([(1, "EAUS1213", "Foo", None), (2, "2561&011", "Baz", 1.05), (3, "011", "Bazaar", 1.06), (4, "x", "short", 1.0), (5, "777", None, 1.0), (6, "192561&2561", "Ba", 1.0), (7, "55 5", "Twin", 1.0)], "result_id int, sail string, name string, tcc double")
    b = spark.createDataFrame([(10, "AUS1213", "Foo"), (11, "GBR555", "Twin"), (12, "IRL555", "Other")], "boat_id int, boat_sail string, boat_name string")
    links, created = upkeep.new_boats(r, b)
    assert {(x.result_id, x.boat_id) for x in links.collect()} == {(1, 10), (7, 11)}
    (one,) = created.collect()
    assert (one.boat_name, one.boat_sail, one.tcc, one.n_results) == ("Bazaar", "2561&011", 1.05, 3)


def test_triage(spark):
    rows = [("a", 1, "J 109", 2000, "GBR", True, "GBR1"), ("a", 2, "j 109 ", 2001, None, False, "1"), ("b", 3, "X", 2000, "GBR", False, "7"), ("b", 4, "Y", 2000, "GBR", False, "8"), ("c", 5, "Z", 2000, "IRL", True, "5"), ("c", 6, None, 2004, "IRL", True, "6"), ("d", 7, None, None, "A", False, "70"), ("d", 8, None, None, "B", False, "80")]
    f = upkeep.cluster_facts(spark.createDataFrame(rows, "cluster string, boat_id int, design string, year int, country string, signal boolean, sail string"))
    got = {r.cluster: (r.d, r.t) for r in f.select("cluster", upkeep.merge_decision().alias("d"), upkeep.triage_tier().alias("t")).collect()}
    assert got == {"a": ("AUTO_MERGE", "A"), "b": ("design_conflict", "C"), "c": ("multi_signal", "B"), "d": ("AUTO_MERGE", "D")}


def test_mentions(spark):
    m = spark.createDataFrame([(1, 1, "AUS 1", "x", 0.9), (1, 2, None, "foo", 0.7), (1, 3, "zz", "two", 0.9), (2, 4, "AUS1", "x", 0.5)], "news_id int, mention_id int, sail string, name string, confidence double")
    b = spark.createDataFrame([(1, "AUS1", "One"), (2, "9", "Foo"), (3, "8", "Two"), (4, "7", "two")], "boat_id int, boat_sail string, boat_name string")
    assert {(r.news_id, r.boat_id) for r in upkeep.link_mentions(m, b).collect()} == {(1, 1), (1, 2)}


def test_read_only(spark):
    spark.range(70).createOrReplaceTempView("seventy")
    df, n = upkeep.read_only_sql(spark, " select id FROM seventy")
    assert (df.count(), n) == (50, 70)
    with pytest.raises(ValueError):
        upkeep.read_only_sql(spark, "DROP VIEW seventy")
    assert [r.id for r in upkeep.sorted_by(spark.range(3), "down", {"up": [F.col("id")], "down": [F.desc("id")]}, "id").collect()] == [2, 1, 0]


def test_data_source(spark):
    spark.dataSource.register(registry.RaceResults)
    got = spark.read.format("race_results").option("module", "tests.demo_source").load()
    assert {(r.source, r.event, r.boat_name) for r in got.collect()} == {("demo_source", "e1", "Boat e1"), ("demo_source", "e2", "Boat e2")}
