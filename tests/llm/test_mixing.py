"""Mixing: targets against repeated water-filling, and what the mix takes."""

import random

from pyspark.sql import functions as F

from windrose.llm import mixing


def fill(sizes, weights, expand, most):
    """By rounds: full sources leave, the rest share what is left."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, target, open_ = expand * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(w[n] for n in open_)
        full = {n for n in open_ if left * w[n] / total > most * sizes[n]}
        if not full:
            return target | {n: left * w[n] / total for n in open_}
        for n in full:
            target[n] = most * sizes[n]
        left -= sum(target[n] for n in full)
        open_ -= full
    return target


def rows(seed, n=400):
    r = random.Random(seed)
    sources = [None, "a", "b", "é", "Z", "hot"]
    out = [(i, " ".join("w" * (1 + k % 3) for k in range(r.randint(0, 60))) if i % 17 else None, r.choices(sources, [1, 2, 1, 3, 1, 8])[0]) for i in range(n)]
    return out


def test_targets_and_takes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 40)
    for seed in range(2):
        data = rows(seed)
        df = spark.createDataFrame(data, "doc_id long, text string, source string")
        got = mixing.mix(df).collect()
        size = {i: len((t or "").split()) for i, t, _ in data}
        per = {}
        for i, _, s in data:
            per[s] = per.get(s, 0) + size[i]
        want = fill(per, mixing.WEIGHTS, mixing.EXPAND, mixing.MAX_EPOCHS)
        taken = {}
        for r in got:
            assert r.size == size[r.doc_id] and r.source_size == per[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
            assert 0 <= r.taken <= 2 * r.size and r.taken == r.repeats * r.size + r.part
            taken[r.source] = taken.get(r.source, 0) + r.taken
        assert all(abs(taken[s] - want[s]) <= 1 + len(data) / 40 for s in per)
        assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))


def test_small_caps_and_empty(spark):
    s = spark.createDataFrame([("a", 10.0), ("b", 0.0), ("c", 5.0)], "source string, source_size double")
    got = {r.source: r.target for r in mixing.water_fill(s, (5.0, 2.0, 1.0), 3.0, 2.0).collect()}
    assert got == {"a": 20.0, "b": 0.0, "c": 10.0}  # the budget is beyond all caps
    empty = spark.createDataFrame([], "doc_id long, text string, source string, size int, target string")
    assert mixing.mix(empty).count() == 0


def test_drawn_documents_hold_the_words_taken(spark):
    data = rows(5, 120)
    df = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in data], "doc_id long, text string, source string, n_chars long")
    plan = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    out = mixing.drawn(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("n")).collect()}
    assert got == {i: n for i, n in plan.items() if n}


def test_first_words():
    assert mixing.first_words("  a  b\nc ", 2) == "  a  b"
