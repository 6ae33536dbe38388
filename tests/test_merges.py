"""Merges over several tables: chains, collisions against a sequential merge, audit, and commits that fail midway."""

import json
import random

import pytest
from pyspark.sql import functions as F

from windrose.operators import merges


def test_chains_and_circles(spark):
    pairs = [(9, 8), (8, 7), (7, 1), (5, 4), (3, 2), (2, 3), (6, 3), (1, 1), (20, 21), (20, 19)] + [(100 + i, 101 + i) for i in range(70)]
    links, circles = merges.follow(spark.createDataFrame(pairs, "loser long, winner long"))
    want = {9: 1, 8: 1, 7: 1, 5: 4, 20: 19} | {100 + i: 170 for i in range(70)}
    assert {r.loser: r.winner for r in links.collect()} == want
    assert {r.loser for r in circles.collect()} == {2, 3, 6}
    links, circles = merges.follow(spark.createDataFrame([], "loser long, winner long"))
    assert links.count() == circles.count() == 0


def sequential(rows, order, unique, rank):
    """One loser after another; rows: (id, boat, key, value)."""
    rows, gone = {r[0]: list(r) for r in rows}, []
    for loser, winner in order:
        for i in sorted(i for i, r in rows.items() if r[1] == loser):
            if i not in rows:
                continue
            mine = rows[i]
            other = next((r for r in rows.values() if r[1] == winner and r[2] == mine[2] and (unique == "null" or r[2] is not None)), None)
            if other is None:
                mine[1] = winner
            elif rank(other[3]) >= rank(mine[3]):
                gone.append((loser, "dropped", i))
                del rows[i]
            else:
                gone.append((loser, "replaced_winner", other[0]))
                del rows[other[0]]
                mine[1] = winner
    return sorted(map(tuple, rows.values()), key=repr), sorted(gone)


@pytest.mark.parametrize("unique", ["null", "not null"])
def test_collisions_as_one_after_another(spark, unique):
    rng = random.Random(4)
    rows, n = [], 0
    for boat in range(30):
        for key in [None, 1, 2, 3]:
            if rng.random() < 0.7:
                rows.append((n, boat, key, rng.choice([None, 0, 1, 2, 3])))
                n += 1
    order = [(b, b - b % 6) for b in range(24) if b % 6]
    df = spark.createDataFrame(rows, "id long, boat long, k long, v long")
    rule = merges.Rule("boat", "id", "row", [F.col("k")], [F.col("k")] if unique == "not null" else [], F.coalesce("v", F.lit(0)))
    kept, gone = merges.merged(df, spark.createDataFrame(order, "loser long, winner long"), rule)
    want, want_gone = sequential(rows, order, unique, lambda v: v or 0)
    assert sorted(map(tuple, kept.collect()), key=repr) == want
    assert sorted((r.loser, r.kind.split("collision_")[1], json.loads(r.row)["id"]) for r in gone.collect()) == want_gone and len(want_gone) > 20


def tables(spark):
    boats = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "B")], "id long, name string")
    results = spark.createDataFrame([(10, 1, "e", None), (11, 2, "e", ""), (12, 2, "f", "r"), (13, 4, "e", None), (14, 3, None, None), (15, 2, None, "")], "id long, boat_id long, event string, race string")
    orders = spark.createDataFrame([(7, 3), (8, 4)], "id long, boat_id long")
    blank = lambda c: F.coalesce(c, F.lit(""))
    rules = {"results": merges.Rule("boat_id", "id", "race_result", [blank("event"), blank("race")]), "orders": merges.Rule("boat_id", "id")}
    return boats, {"results": results, "orders": orders}, rules


def test_every_table_and_the_audit(spark):
    boats, dfs, rules = tables(spark)
    pairs = spark.createDataFrame([(3, 2), (2, 1), (77, 1), (4, 99)], "loser long, winner long")
    out = merges.merge_boats(boats, pairs, dfs, rules)
    assert sorted(map(tuple, out["boats"].collect())) == [(1, "A"), (4, "B")]
    assert sorted((r.id, r.boat_id) for r in out["results"].collect()) == [(10, 1), (12, 1), (13, 4), (15, 1)]
    assert sorted(map(tuple, out["orders"].collect())) == [(7, 1), (8, 4)]
    audit = {r.loser_id: (r.winner_id, json.loads(r.loser_snapshot)) for r in out["boat_merges"].collect()}
    assert audit[2][0] == audit[3][0] == 1 and audit[2][1]["boat"] == {"id": 2, "name": "A"}
    assert [(x["kind"], json.loads(x["row"])["id"]) for x in audit[2][1]["extras"]] == [("race_result_collision_dropped", 11)]
    assert [json.loads(x["row"])["id"] for x in audit[3][1]["extras"]] == [14]
    again = merges.merge_boats(out["boats"], pairs, {n: out[n] for n in dfs}, rules)
    assert again["boat_merges"].count() == 0 and sorted(map(tuple, again["results"].collect()), key=repr) == sorted(map(tuple, out["results"].collect()), key=repr)


def test_winners(spark):
    members = [("c", 1, 5), ("c", 2, 3), ("c", 3, 1), ("d", 4, 2), ("d", 5, 2), ("e", 6, 1), ("f", 7, 1), ("f", 8, 9)]
    m = spark.createDataFrame(members, "cluster string, boat_id long, created_at long")
    certs = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-05-01"), (2, None), (7, None)], "boat_id long, issue_date string").withColumn("issue_date", F.to_date("issue_date"))
    results = spark.createDataFrame([(8,), (8,), (1,), (1,)], "boat_id long")
    got = {(r.cluster, r.loser): r.winner for r in merges.choose_winners(m, certs, results).collect()}
    assert got == {("c", 1): 2, ("c", 3): 2, ("d", 5): 4, ("f", 7): 8}


def test_a_commit_that_dies_between_two_tables_changes_nothing(spark, tmp_path):
    boats, dfs, rules = tables(spark)
    store = merges.Versions(spark, str(tmp_path / "store"))
    assert store.read() == {} and store.commit({"boats": boats, **dfs}) == 1
    out = merges.merge_boats(boats, spark.createDataFrame([(2, 1)], "loser long, winner long"), dfs, rules)
    broken = out["results"].withColumn("boat_id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"boats": out["boats"], "results": broken, "orders": out["orders"]})
    now = store.read()
    assert store.current()[0] == 1 and now["boats"].count() == 4 and sorted(map(tuple, now["results"].collect()), key=repr) == sorted(map(tuple, dfs["results"].collect()), key=repr)
    assert store.commit(out, appended=["boat_merges"]) == 2 and store.read()["boats"].count() == 3
    assert store.commit({"boat_merges": out["boat_merges"]}, appended=["boat_merges"]) == 3 and store.read()["boat_merges"].count() == 2
    store.clean()
    assert len(list((tmp_path / "store" / "boats").iterdir())) == 1 and store.read()["orders"].count() == 2 and store.current()[0] == 3


def test_two_commits_at_once(spark, tmp_path, monkeypatch):
    boats, _, _ = tables(spark)
    one, two = (merges.Versions(spark, str(tmp_path / "store")) for _ in range(2))
    one.commit({"boats": boats})
    seen = two.current()
    monkeypatch.setattr(two, "current", lambda: seen)
    one.commit({"boats": boats.limit(1)})
    with pytest.raises(OSError):
        two.commit({"boats": boats.limit(2)})
    assert one.read()["boats"].count() == 1
