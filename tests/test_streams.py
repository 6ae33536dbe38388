"""State that ends, a source as a stream, and the matching cycle: restarts, replays and late arrivals."""

import datetime as dt
import time

from pyspark.sql import functions as F

from windrose.operators.merges import Versions
from windrose.sources.registry import RaceResults
from windrose.streaming import cycle, feeds, state

SNAPSHOT = "ref string, country string, at timestamp, name string, sail string"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def run(query):
    query.awaitTermination()
    return query


def test_a_run_is_forgotten_after_its_time(spark, tmp_path):
    src, ck, out = (str(tmp_path / x) for x in ("in", "ck", "out"))

    def step(rows):
        spark.createDataFrame(rows, "k string, o long, v string").coalesce(1).write.mode("append").parquet(src)
        s = state.compact_runs(feeds.events_stream(spark, src, "k string, o long, v string"), "k", "o", "v", dt.timedelta(seconds=4))
        run(s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(once=True).start())  # one batch: time goes on by itself
        return sorted((r.k, r.o) for r in spark.read.schema("k string, o long, v string").parquet(out).collect())

    assert step([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y")]) == [("a", 1), ("b", 1)]
    time.sleep(6)
    assert step([("a", 3, "x")]) == [("a", 1), ("a", 3), ("b", 1)]


def test_snapshots_close_alike_in_stream_and_table(spark, tmp_path):
    """Two starts from one checkpoint; content that changes, comes back, is null, and keys that fall silent."""
    src, ck, out = (str(tmp_path / x) for x in ("in", "ck", "out"))
    keep = dt.timedelta(days=30)
    first = [("r1", "AUS", day(0), "Sun", None), ("r1", "AUS", day(3), "Sun", None), ("r1", "AUS", day(5), "Sun", "7"), ("r1", "GBR", day(1), "Moon", "1"), ("r2", "AUS", day(2), None, None)]
    second = [("r1", "AUS", day(8), "Sun", "7"), ("r1", "AUS", day(9), "Sun", None), ("r2", "AUS", day(9), None, None), ("r3", "X", day(9), "n", "n")]
    third = [("r2", "AUS", day(45), None, None), ("r9", "X", day(60), "clock", None)]
    last = [("r9", "X", day(200), "clock", None), ("r9", "X", day(300), "clock", None)]

    def step(rows):
        spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("append").parquet(src)
        s = state.snapshot_runs(feeds.events_stream(spark, src, SNAPSHOT), ["ref", "country"], "at", ["name", "sail"], keep)
        run(s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())

    for rows in (first, second, third, last):
        step(rows)
    step([])
    schema = "ref string, country string, content string, first timestamp, last timestamp, n long"
    got = {tuple(r) for r in spark.read.schema(schema).parquet(out).collect()}
    table = spark.createDataFrame(first + second + third + last, SNAPSHOT)
    runs = state.snapshot_runs_table(table, ["ref", "country"], "at", ["name", "sail"], keep)
    want = {tuple(r) for r in runs.select("ref", "country", "content", "first", "last", "n").collect()}
    assert {r for r in want if r[0] != "r9"} == {r for r in got if r[0] != "r9"}
    assert [r[2] for r in sorted(x for x in got if x[:2] == ("r1", "AUS"))] == ['{"name":"Sun","sail":"7"}', '{"name":"Sun","sail":null}', '{"name":"Sun","sail":null}']
    assert {r[3:] for r in got if r[0] == "r2"} == {(day(2), day(9), 2), (day(45), day(45), 1)}  # expired in between
    assert got <= want


def test_a_late_snapshot_is_a_run_of_its_own(spark, tmp_path):
    src, ck, out = (str(tmp_path / x) for x in ("in", "ck", "out"))
    for rows in ([("r", "A", day(5), "n", "1")], [("r", "A", day(4), "old", "1"), ("r", "A", day(3), "n", "1")], [("z", "A", day(90), "n", "1")], [("z", "A", day(91), "n", "1")]):
        spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("append").parquet(src)
        s = state.snapshot_runs(feeds.events_stream(spark, src, SNAPSHOT), ["ref", "country"], "at", ["name", "sail"], dt.timedelta(days=30), "10 days")
        run(s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
    got = {(r.content, r.first, r.last, r.n) for r in spark.read.schema("ref string, country string, content string, first timestamp, last timestamp, n long").parquet(out).collect()}
    assert got == {('{"name":"old","sail":"1"}', day(4), day(4), 1), ('{"name":"n","sail":"1"}', day(3), day(5), 2)}


def test_a_source_as_a_stream(spark, tmp_path, monkeypatch):
    """New references arrive with the next start; those of before aren't read again."""
    folder = tmp_path / "listed"
    folder.mkdir()
    module = tmp_path / "growing_source.py"
    module.write_text(
        f"import os\nFOLDER = {str(folder)!r}\n\ndef discover():\n    return sorted(x for x in os.listdir(FOLDER) if x.startswith('e'))\n\n"
        "def scrape(reference):\n    yield ('Boat ' + reference, 'AUS1', 1, 1.05, 'finished')\n\n"
        "def done(references):\n    open(os.path.join(FOLDER, 'done'), 'w').write(','.join(references))\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.environment["PYTHONPATH"] = f"{tmp_path}:{spark.sparkContext.environment.get('PYTHONPATH', '')}"
    import os

    monkeypatch.setenv("PYTHONPATH", f"{tmp_path}:{os.environ['PYTHONPATH']}")
    spark.dataSource.register(RaceResults)

    def step(*references):
        for r in references:
            (folder / r).write_text("")
        rows = spark.readStream.format("race_results").option("module", "growing_source").load()
        run(rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        return sorted(r.event for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert step("e1", "e2") == ["e1", "e2"]
    assert step("e3") == ["e1", "e2", "e3"]
    assert step() == ["e1", "e2", "e3"]


RESULT = "result_id long, name string, race string"


def test_the_cycle_matches_late_boats_and_ignores_replays(spark, tmp_path):
    src, path, ck = (str(tmp_path / x) for x in ("in", "store", "ck"))
    boats = {"Sun": 1}

    def match(results):
        table = spark.createDataFrame(list(boats.items()), "name string, _b long")
        return results.join(table, "name", "left").withColumn("boat_id", F.coalesce("boat_id", "_b")).select("result_id", "name", "race", "boat_id")

    def step(rows):
        spark.createDataFrame(rows, RESULT).coalesce(1).write.mode("append").parquet(src)
        run(cycle.start_cycle(feeds.events_stream(spark, src, RESULT), path, ck, match))
        return {r.result_id: r.boat_id for r in Versions(spark, path).read()["results"].collect()}

    assert step([(1, "Sun", "a"), (2, "Moon", "a"), (2, "Moon", "again")]) == {1: 1, 2: None}
    boats["Moon"] = 2
    assert step([(3, "Star", "b"), (1, "Sun", "late repeat")]) == {1: 1, 2: 2, 3: None}
    store = Versions(spark, path)
    number = store.current()[0]
    again = spark.createDataFrame([(9, "Sun", "c")], RESULT)
    assert not cycle.run_batch(again, 1, store, match, ck) and store.current()[0] == number  # the number of a batch that is done
    assert cycle.run_batch(again, 2, store, match, ck) and store.read()["results"].count() == 4
    assert cycle.run_batch(again, 1, store, match, "another query") and store.read()["results"].count() == 4


def test_a_cycle_that_fails_is_run_again(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "store"))
    batch = spark.createDataFrame([(1, "Sun", "a")], RESULT)
    try:
        cycle.run_batch(batch, 0, store, lambda r: r.withColumn("boat_id", F.raise_error(F.lit("lost")).cast("long")))
    except Exception as e:
        assert "lost" in str(e)
    assert store.current() == (0, {})
    assert cycle.run_batch(batch, 0, store, lambda r: r) and store.read()["results"].count() == 1
