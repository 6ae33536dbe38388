"""Backfills, result upserts and run logs where the tables of the queries have no such cases."""

import datetime as dt

from windrose.operators import backfill


def test_designs_come_from_the_last_certificate(spark):
    boats = spark.createDataFrame([(1, None), (2, "Own"), (3, None), (4, None), (None, None)], "boat_id long, design string")
    certs = spark.createDataFrame([(1, "OLD", 1), (1, " j/109 ", 2), (2, "X", 1), (3, "", 5), (3, "BIG BOAT", 1), (None, "Y", 1), (1, None, 9)], "boat_id long, class_name string, day long")
    aliases = spark.createDataFrame([("J/109", "J 109"), (None, None)], "alias string, name string")
    got = {r.boat_id: (r.design, r.how) for r in backfill.designs_from_certificates(boats, certs, aliases).collect()}
    assert got == {1: ("J 109", "lookup"), 2: ("Own", None), 3: ("Big Boat", "direct"), 4: (None, None), None: (None, None)}


def test_countries_of_clubs_come_before_those_of_sources(spark):
    boats = spark.createDataFrame([(1, None), (2, None), (3, "NZL"), (4, None)], "boat_id long, country string")
    results = spark.createDataFrame([(1, "X", "rorc"), (1, "CYCA", "club"), (2, None, "rorc"), (3, "CYCA", None), (None, "CYCA", "rorc"), (4, "X", None)], "boat_id long, organizing_club string, source string")
    assert {r.boat_id: r.country for r in backfill.countries_from_results(boats, results).collect()} == {1: "AUS", 2: "GBR", 3: "NZL", 4: None}


def test_second_certificates_and_their_boats(spark):
    rows = [("Sun", "1", "D"), ("Sun - SEC", "1", "D"), ("Sun (SH)", "2", None), ("Moon- SEC", "3", "D"), ("Moon", "3", "D"), (None, "1", "D")]
    got = backfill.second_certificates(spark.createDataFrame(rows, "boat_name string, boat_sail string, design string")).collect()
    assert {r.design: (r.n, r.matched, r.unmatched) for r in got} == {"D": (2, 2, 0), "UNKNOWN": (1, 0, 1)}


def test_results_with_and_without_a_boat_have_places_of_their_own(spark):
    schema = "boat_id long, boat_name string, event_name string, race_name string, event_date date, place int, transport string, created_at int"
    day = dt.date(2024, 1, 1)
    old = spark.createDataFrame([(1, "A", "E", None, day, 3, "x", 10), (None, "B", "E", None, None, 4, "x", 11), (1, "A", "E", "r2", day, 5, None, 12)], schema)
    new = spark.createDataFrame([(1, "other name", "E", None, day, 1, None, 90, 1), (1, "A", "E", None, day, 2, "y", 91, 2), (None, "B", "E", None, None, 6, None, 92, 1), (None, "C", "E", None, None, 7, None, 93, 1)], schema + ", batch long")
    got = {(r.boat_id, r.boat_name, r.race_name): (r.place, r.transport, r.created_at) for r in backfill.upsert_results(old, new).collect()}
    assert got == {(1, "A", None): (2, "y", 10), (None, "B", None): (6, "legacy", 11), (1, "A", "r2"): (5, None, 12), (None, "C", None): (7, "legacy", 93)}


def test_a_log_that_is_only_appended_to(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, "start", t(1), "orc", None, None), (1, "end", t(2), "orc", "failed", 0), (1, "end", t(3), "orc", None, 9), (2, "start", t(1), "club", None, None), (3, "end", t(5), "x", "completed", 1)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "run long, kind string, at timestamp, source string, status string, records_found long, records_new long, records_updated long, error string")
    got = {r.run: (r.started_at, r.completed_at, r.status, r.records_found) for r in backfill.run_log(df).collect()}
    assert got == {1: (t(1), t(3), "completed", 9), 2: (t(1), None, "running", None), 3: (None, t(5), "completed", 1)}
