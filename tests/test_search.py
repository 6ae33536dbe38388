"""Search and matching of many names at once, against loops over all of them."""

import random
import re

from pyspark.sql import functions as F

from windrose.functions.text import race_bucket
from windrose.operators import quality, resolve


def grams(s):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"\w+", (s or "").lower()) for i in range(len(w) + 1)}


def alike(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def fixture():
    rng = random.Random(3)
    words = ["sun", "moon", "fast", "kite", "blue", "star", "seven", "éclair"]
    boats = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", " - SEC"]), rng.choice(["AUS", "GBR", "F"]) + str(rng.randrange(900)) if i % 7 else None) for i in range(120)]
    boats += [(500, None, "GBR12"), (501, "", "")]
    asked = ["AUZ55", "GBQ1", "F 12", "xx", "x", "", None, "sunn", "fastest starling of them all", "a b c d e f g h", "seven", "gbr 12", "ABCDEFGHIJKL", "kit eclair"]
    return list(enumerate(asked)), boats


def test_suggestions_of_both_branches(spark):
    asked, boats = fixture()
    open_boats = [b for b in boats if not (b[1] or "").endswith(" - SEC")]
    want, hits = {}, set()
    for i, q in asked:
        if q is None:
            continue
        found = {(i, b, round(max(alike(n, q), alike(s, q)), 6)) for b, n, s in open_boats if alike(n, q) > 0.3 or alike(s, q) > 0.5}
        hits |= found
        if found or len(q.strip()) < 2:
            continue
        rows = []
        for b, n, s in open_boats:
            gate = s is not None and abs(len(s) - len(q)) <= 2
            far = edits(s.upper(), q.upper()) if gate else 999
            if (3 <= len(q) <= 10 and gate and far <= 2) or alike(n, q) > 0.18:
                rows.append((far, -alike(n, q), n or "", b))
        want[i] = [(b, far) for far, _, _, b in sorted(rows)[:5]]
    q, b = spark.createDataFrame(asked, "query_id long, q string"), spark.createDataFrame(boats, "boat_id long, boat_name string, boat_sail string")
    assert {(r.query_id, r.boat_id, round(r.score, 6)) for r in resolve.search_batch(q, b).collect()} == hits and hits
    got = {}
    for r in sorted(resolve.suggest_batch(q, b).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.boat_id, r.sail_dist))
    assert got == {i: x for i, x in want.items() if x} and len(got) >= 4
    assert resolve.suggest_batch(q, b.limit(0)).count() == 0


def test_near_texts_loses_no_pair(spark):
    rng = random.Random(6)
    texts = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(60)})
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "x string")
    got = {(r.x, r.y, r.distance) for r in resolve.near_texts(df, df.withColumnRenamed("x", "y"), "x", "y").collect()}
    assert got == {(a, b, edits(a, b)) for a in texts for b in texts if edits(a, b) <= 2}


def one_after_another(left, right, least):
    norm = lambda s: "".join((s or "").split()).lower()
    out = set()
    for g in {g for g, _ in left + right}:
        x, y = {}, {}
        for rows, into in ((left, x), (right, y)):
            for h, n in rows:
                if h == g and norm(n):
                    into[norm(n)] = min(n, into.get(norm(n), n))
        out |= {(g, x[k], y[k]) for k in x.keys() & y.keys()}
        rest, free = [k for k in x if k not in y], sorted((k for k in y if k not in x), key=lambda k: (-len(k), k))
        for k in sorted(rest, key=lambda k: (-len(k), k)):
            for m in free:
                if min(len(k), len(m)) >= least and (k in m or m in k):
                    out.add((g, x[k], y[m]))
                    free.remove(m)
                    break
    return out


def test_names_in_rounds_as_one_after_another(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9)))
    for least in (1, 3):
        left, right = ([(rng.choice("gh"), name()) for _ in range(40)] + [("g", None), ("g", "")] for _ in range(2))
        got = quality.match_names(spark.createDataFrame(left, "u string, n string"), spark.createDataFrame(right, "u string, n string"), "u", "n", least)
        assert {tuple(r) for r in got.collect()} == one_after_another(left, right, least)


def test_chains_of_names_that_wait(spark):
    """Each name of the left can take two of the right, and the first to choose decides for all behind it."""
    left = [("g", "abc" * 3 + "x" * (4 - i) + "y" * i) for i in range(4)]
    right = [("g", "abc"), ("g", "abcabc"), ("g", "cabc")]
    got = quality.match_names(spark.createDataFrame(left, "u string, n string"), spark.createDataFrame(right, "u string, n string"), "u", "n")
    assert {tuple(r) for r in got.collect()} == one_after_another(left, right, 3) and len(one_after_another(left, right, 3)) == 3


def test_race_buckets(spark):
    names = {"Friday TWILIGHT": "twilight", "Twilight Offshore": "twilight", "Rolex Sydney-Hobart": "offshore", "Hobart to Sydney": "series", "Coastal Passage": "offshore", "Brisbane to Gladstone": "offshore", "Ocean Series": "series", "Fastnet": "series", "": "series"}
    df = spark.createDataFrame([(n,) for n in [*names, None]], "n string").withColumn("b", race_bucket("n"))
    assert {r.n: r.b for r in df.collect()} == names | {None: "series"}


def test_top_rows_of_a_key_are_cut_off_before_the_shuffle(spark):
    from windrose.operators.relational import pick_per_key

    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = pick_per_key(df, ["k"], [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    before = plan.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before  # a task keeps a row a key, however many rows the key has
