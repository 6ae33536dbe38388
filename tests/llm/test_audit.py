"""The filter audit against every order applied document by document."""

import re
from itertools import permutations

import pytest

from windrose.llm import audit

LIMITS = audit.Limits(least_words=4)


def brute(rows, labels):
    """rows: (doc_id, text, source); every order applied to every document."""
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    text = [t or "" for _, t, _ in rows]
    fails = []
    for (i, _, _), t in zip(rows, text, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 4, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = i is not None and any(j is not None and j < i and u == t for (j, _, _), u in zip(rows, text, strict=True))
        fails.append(f)
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for step, letter in enumerate(order, 1):
            for (i, _, source), f in zip(rows, fails, strict=True):
                r = out.setdefault((source or "", order, step), [0] * 7)
                gone = any(f[x] for x in order[: step - 1])
                removed = f[letter] and not gone
                alone = f[letter] and sum(f.values()) == 1
                for k, x in enumerate([not gone and not f[letter], removed, f[letter] and gone, alone, removed and i in good, removed and i in toxic]):
                    r[k] += x
    shapley = {}
    for (source, order, step), r in out.items():
        shapley[source, order[step - 1]] = shapley.get((source, order[step - 1]), 0) + r[1]
    for (source, order, step), r in out.items():
        r[6] = shapley[source, order[step - 1]]
    return {k: tuple(v) for k, v in out.items()}


def found(spark, rows, labels, more=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if more:
        docs = docs.selectExpr("*", *more)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = audit.interactions(audit.counters(audit.failures(docs, LIMITS), marks))
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out.collect()}


ROWS = [
    (1, "four quite different words", "a"),
    (2, "four quite different words", "a"),
    (3, "x x x x x x x", "a"),
    (4, "LOUD and marked with #", "b"),
    (5, "few", "b"),
    (6, None, None),
    (7, "", ""),
    (None, "", "b"),
    (None, "four quite different words", "b"),
    (7, "", "b"),
    (8, "four quite different words", None),
    (9, "a\x0bb\x0cc d e É É É É É " + "long " * 300, "a"),
]
LABELS = [(2, 1, 0), (3, 0, 1), (5, 1, 1), (5, 0, 0), (7, None, 1), (None, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_every_order_by_hand(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert found(spark, ROWS, LABELS) == brute(ROWS, LABELS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_copies_over_the_edges_of_ranges(spark):
    """One text fills most ranges, once with own ids and once with a repeated one."""
    rows = [(i, "a text that nearly all documents have", "a") for i in range(300)] + [(0, "a text that nearly all documents have", "b")] * 40
    rows += [(i, f"text number {i} of its own kind", "b") for i in range(300, 340)] + [(500, "copied under one id only, as it seems", "c")] * 40
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows, LABELS) == brute(rows, LABELS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_fingerprints_of_different_texts():
    """Runs of one fingerprint are told apart by their texts, also where the range begins or ends within them."""
    rows = [(3, "p", b"one", 5), (8, "p", b"one", 5), (1, "p", b"two", 5), (9, "p", b"two", 5), (4, "p", b"three", 6)]
    reader = audit.Predecessors(2, LIMITS)
    out = [x for r in rows for x in reader.rows(*r)] + reader.ends()
    documents = [(x[0], bool(x[2] & audit.COPY), x[3] is not None) for x in out if x[2] is not None]
    assert documents == [(3, False, True), (8, True, False), (1, False, True), (9, True, False), (4, False, False)]
    assert {(x[0], x[4], x[5]) for x in out if x[2] is None} == {(3, 5, b"one"), (1, 5, b"two"), (4, 6, b"three")}
    assert len({x[3] for x in out if x[2] is None}) == 3


def test_columns_with_clashing_names(spark):
    more = ["7 AS mask", "'u' AS part", "1 AS run", "2 AS print", "3 AS n"]
    assert found(spark, ROWS, LABELS, more) == brute(ROWS, LABELS)


def test_empty_tables(spark):
    assert found(spark, [], LABELS) == {}
    assert found(spark, ROWS, []) == brute(ROWS, [])


def test_effects_have_a_fixed_size():
    assert len(audit.effects(5)) == 120 * 5 * 32 and len(audit.effects(2)) == 2 * 2 * 4
