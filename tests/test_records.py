"""Two-pass imports, merges table by table, matching cycles, table swaps and stable ids."""

import datetime

from pyspark.sql import functions as F

from windrose.operators import matching, records, sinks
from windrose.operators import relational as rel


def test_listing_in_two_passes(spark):
    boats = spark.createDataFrame([(1, "Alpha", "GBR1"), (2, "Beta", "GBR2")], "boat_id long, boat_name string, boat_sail string")
    day = datetime.date(2024, 5, 1)
    old = spark.createDataFrame([(1, datetime.date(2024, 4, 1), 0.9, "SEC"), (1, day, 0.8, None), (2, day, 1.0, None)], "boat_id long, day date, rating double, secondary string")
    rows = [("GAMMA", "GBR3", 1.1, None), ("alpha", "GBR1", 0.95, ""), ("ALPHA - SEC", "GBR1", 0.5, None), ("Nobody", "X9", 0.7, "Y"), ("beta", "GBR2", 0.1, "yes"), ("delta", "GBR4", 1.2, None), ("DELTA", "GBR4", 1.3, None)]
    listing = spark.createDataFrame(rows, "name string, sail string, rating double, flag string")
    b, r, skipped = records.import_listing(boats, old, listing, "2024-05-01")
    ids = {x.boat_name: x.boat_id for x in b.collect()}
    assert ids == {"Alpha": 1, "Beta": 2, "GAMMA": 3, "DELTA": 4}
    got = {(x.boat_id, str(x.day)): (x.rating, x.secondary) for x in r.collect()}
    assert got == {(1, "2024-04-01"): (0.9, "SEC"), (1, "2024-05-01"): (0.95, "SEC"), (2, "2024-05-01"): (1.0, "yes"), (3, "2024-05-01"): (1.1, None), (4, "2024-05-01"): (1.3, None)}
    assert [(x.name, x.sail) for x in skipped.collect()] == [("NOBODY", "X9")]


def test_merges_every_table_by_its_rule(spark):
    losers = spark.createDataFrame([(2, 1)], "loser long, winner long")
    ratings = spark.createDataFrame([(1, "d1", 1.0), (2, "d1", 2.0), (2, "d2", 3.0), (3, "d1", 4.0)], "boat_id long, day string, rating double")
    names = spark.createDataFrame([("x",)], "name string")
    out = records.merge_tables({"ratings": ratings, "names": names}, losers, {"ratings": ("boat_id", ["day"], [])})
    assert sorted(map(tuple, out["ratings"].select("boat_id", "day", "rating").collect())) == [(1, "d1", 1.0), (1, "d2", 3.0), (3, "d1", 4.0)] and out["names"] is names


def test_a_cycle_fills_boats_once(spark):
    boats = spark.createDataFrame([(1, "ALPHA", "GBR 101", "Sun 1"), (2, "BETA", "GBR 102", "Sun 2")], "boat_id long, boat_name string, boat_sail string, boat_design string")
    ratings = spark.createDataFrame([(1, 0.95, datetime.date(2024, 1, 1)), (2, 1.05, datetime.date(2024, 1, 1))], "boat_id long, rating double, day date")
    certs = spark.createDataFrame([], "boat_id long, cert_name string, cert_sail string, cert_class string")
    known = spark.createDataFrame([(2, "OLD BETA", "GBR 7")], "boat_id long, name string, sail string")
    owners = spark.createDataFrame([("ann", 1)], "owner string, boat_id long")
    rows = [
        (1, "club", "alpha", None, None, None, None, None, "r1", None),
        (2, "club", "Alpha", "GBR101", None, None, None, None, "r1", None),  # the same race: only the first gets the boat
        (3, "owned", None, None, None, "ANN", None, None, "r2", None),
        (4, "other", "old beta", None, None, None, None, None, "r1", None),
        (5, "other", "nobody", "Q1234", None, None, None, None, "r1", None),
        (6, "club", None, None, None, None, "sun 2", 1.051, "r3", None),
        (7, "other", "beta", None, None, None, None, None, "r4", 2),
        (8, "other", "beta", None, None, None, None, None, "r4", None),  # taken
    ]
    results = spark.createDataFrame(rows, "result_id long, source string, name string, sail string, hull string, owner string, design string, rating double, race string, boat_id long")
    out = matching.rematch(results, boats, ratings, certs, known, owners, ["race"], "club", "owned")
    assert {r.result_id: r.boat_id for r in out.collect()} == {1: 1, 2: None, 3: 1, 4: 2, 5: None, 6: 2, 7: 2, 8: None}


def test_ids_and_sums_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"), (F.col("id") * 7919 % 1000).alias("v"))
    runs = [sorted(map(tuple, sinks.with_ids(df.repartition(n), "id", 5000, ["v"]).collect())) for n in (1, 3, 8)]
    assert runs[0] == runs[1] == runs[2] and len({i for i, _ in runs[0]}) == 1000
    per = df.select((F.col("v") % 4).alias("g"), "v", F.lit(1).alias("n"))
    got = rel.running(per.repartition(5), ["g"], "v", "n").collect()
    assert all(r.before == r.v // 4 and r.whole == 250 for r in got)


def test_winsorised_means_of_groups(spark):
    rows = [("a", float(x)) for x in [*range(1, 10), 1000]] + [("b", 2.0), ("b", 3.0), (None, 5.0), ("c", None)]
    got = {r.g: r.v for r in rel.winsorised_means(spark.createDataFrame(rows, "g string, v double"), "g", ["v"]).collect()}
    assert got == {"a": 104.6, "b": 2.5, None: 5.0, "c": None}


def test_a_table_is_swapped_whole(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["t"]
