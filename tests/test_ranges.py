"""Operators over ranges of an order, against the ones that sort a group in one task."""

import random

import pytest
from pyspark.sql import functions as F

from windrose.operators import ranges
from windrose.operators import relational as rel


@pytest.fixture(params=[1, 7])
def parts(spark, request):
    """Few and many ranges, none put together."""
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_asof_by_ranges_gives_the_rows_of_asof_join(spark, parts):
    rng = random.Random(1)
    keys = ["hot"] * 30 + ["a", "b", None]
    left = [(i, rng.choice(keys), rng.choice([None, *range(40)])) for i in range(250)]
    right = [(1000 + i, rng.choice(["hot"] * 4 + ["a", "only right"]), rng.randrange(10, 40), rng.random()) for i in range(60)]
    a = spark.createDataFrame(left, "id long, k string, at long")
    b = spark.createDataFrame(right, "rid long, k string, day long, v double")
    got = ranges.asof_by_ranges(a, b, "k", "at", "day", "id", "rid")
    want = rel.asof_join(a, b, "k", "at", "day", "id", "rid")
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert ranges.asof_by_ranges(a, b.limit(0), "k", "at", "day", "id", "rid").filter("rid IS NOT NULL").count() == 0
    assert ranges.asof_by_ranges(a.limit(0), b, "k", "at", "day", "id", "rid").count() == 0


def test_quantiles_equal_those_of_a_buffer(spark, parts):
    rng = random.Random(2)
    rows = [(rng.choice(["a"] * 9 + ["b", None]), rng.choice([None, 1.0, 2.5, 2.5, rng.random()])) for _ in range(400)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {r.g: (r.n, [None if x is None else round(x, 9) for x in r.q]) for r in ranges.group_quantiles(df, ["g"], "v", shares).collect()}
    want = {r.g: (r.n, [None if x is None else round(x, 9) for x in (r.q or [None] * 5)]) for r in df.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert got == want


def test_sketches_of_parts_merge(spark):
    df = spark.range(40_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 40).alias("day"), F.rand(3).alias("v"))
    parts = ranges.quantile_sketches(df, ["g", "day"], "v")
    for r in ranges.merged_quantiles(parts, ["g"], (0.1, 0.5, 0.9)).collect():
        assert r.n in (13333, 13334) and all(abs(x - s) < 2 * ranges.RANK_ERROR for x, s in zip(r.q, (0.1, 0.5, 0.9), strict=True))


def by_hand(rows, k):
    line = sorted((v, i) for i, v in rows if v is not None)
    out = set()
    for at, (v, i) in enumerate(line):
        near = sorted((abs(w - v), abs(j - at), j, o) for j, (w, o) in enumerate(line) if j != at)[:k]
        out |= {(i, o, gap, n) for n, (gap, _, _, o) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize(("n", "k"), [(0, 3), (1, 3), (3, 5), (60, 1), (60, 4)])
def test_nearest_of_all_rows(spark, parts, n, k):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, float(rng.randrange(12)), rng.random() * 12])) for i in range(n)]
    got = ranges.nearest(spark.createDataFrame(rows, "id long, v double"), "id", "v", k).collect()
    assert {(r.id, r.other, r.gap, r.n) for r in got} == by_hand(rows, k) and len(got) == len(by_hand(rows, k))


def test_nearest_over_ranges_shorter_than_k(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    rows = [(i, float(i * i % 17)) for i in range(30)]
    got = ranges.nearest(spark.createDataFrame(rows, "id long, v double"), "id", "v", 6).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.id, r.other, r.gap, r.n) for r in got} == by_hand(rows, 6)
