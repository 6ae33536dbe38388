"""Toxic passages: the segment search against brute force, held-out accuracy, odd texts."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from windrose.llm import toxicity

DIR = "/root/testdata/sf0.01"


def by_definition(x):
    """Maximal segments by recursion: the best segment (shortest, then leftmost), then both sides of it."""
    if not len(x):
        return []
    upto = np.concatenate([[0.0], np.cumsum(x)])
    best = max(((upto[j] - upto[i], -(j - i), -i) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i = -best[2]
    j = i - best[1]
    left, right = by_definition(x[:i]), by_definition(x[j:])
    return left + [(i, j)] + [(a + j, b + j) for a, b in right]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -2.25, -1.0, -0.5, 0.25, 1.5, 2.0, 4.0]), max_size=24))
def test_segments(scores):
    got = toxicity.maximal_segments(np.array(scores))
    total = lambda segs: sorted(round(sum(scores[a:b]), 6) for a, b in segs)
    assert total([(a, b) for a, b, _ in got]) == total(by_definition(np.array(scores)))
    assert all(abs(sum(scores[a:b]) - s) < 1e-9 for a, b, s in got)


def test_held_out_accuracy(spark):
    out = toxicity.op4_toxic_segments(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) >= 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, f"the quiet sea was {'vile scum' if i % 3 == 0 else 'calm today'} and the boat sailed {i}") for i in range(300)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(900, 0), (901, 0), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    rows = [(1, None), (2, ""), (3, "calm sea " * 50_000), (4, "you vile scum"), (5, "…"), (5, "…")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1].score == got[2].score < 0.5 and got[3].score < 0.5 and got[4].score > 0.5 and got[4].n_passages >= 1
    assert [(p.start, p.end) for p in got[4].passages] == [(1, 3)]
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, labels.filter("toxic = 0"), F.lit(True)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
