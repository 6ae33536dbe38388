"""Near-duplicate groups against brute force."""

import numpy as np
import pytest

from windrose.llm import neardup


def brute(rows, percent=85):
    def items(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        n = min(5, len(words))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()

    sets = {i: items(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def fixture_rows():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: list(rng.choice(words, n))
    docs = [text(int(n)) for n in rng.integers(1, 120, 60)]
    for n, copies, edits in ((200, 40, 3), (60, 30, 1), (400, 25, 9)):  # copies near the threshold, and chains of them
        base = text(n)
        for _ in range(copies):
            c = list(base)
            for at in rng.integers(0, n, int(rng.integers(0, edits + 1))):
                c[at] = "edit%d" % rng.integers(0, 50)
            docs.append(c)
            if rng.random() < 0.3:
                base = c
    line = text(30)
    docs += [text(8) + line + text(4) for _ in range(20)]
    docs = [" ".join(d) for d in docs] + ["", None, "  \n", "one", "ONE", "one two three four", "One two three\tfour", "été ÉTÉ"]
    return list(enumerate(docs)) + [(1000 + i, docs[i]) for i in range(10)]


@pytest.mark.parametrize("percent, rounds", [(85, 2), (85, 0), (80, 2)])
def test_equals_brute_force(spark, monkeypatch, percent, rounds):
    """With and without the stars over rare items."""
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    rows = fixture_rows()
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, percent)


def test_edited_copies_without_their_original(spark):
    """Copies with two edits each, most of them too far apart to link, and none of the text that they come from: the
    exact search meets few pairs."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        c = list(base)
        for at in rng.choice(150, 2 + i % 2, replace=False):
            c[at] = f"own{i}x{at}" if i % 3 else f"own{at}"
        rows.append((i, " ".join(c)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, 85)


def test_default_threshold():
    assert neardup.PERCENT == 80


def test_repeated_ids_and_very_long_texts(spark):
    """Rows that share an id are documents of their own; a text of 60,000 words and its near copy are linked."""
    rng = np.random.default_rng(5)
    long = [f"w{i}" for i in rng.integers(0, 5000, 60_000)]
    near = list(long)
    for at in rng.integers(0, len(near), 300):
        near[at] = "edit"
    rows = [(3, "a b c d e f g"), (3, "one two three four five six"), (2, "one two three four five six"), (8, " ".join(long)), (9, " ".join(near))]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(2, 2), (3, 2), (3, 3), (8, 8), (9, 8)]


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n int, key string, comp int")
    assert neardup.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(1, "a b c", 1, "k", 2), (1, "a b c", 1, "k", 2)], df.schema)
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()] == [(1, 1, 1)] * 2


def test_estimates_follow_the_truth():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.6, 0.9):
        a = rng.integers(0, 2**63, 2000).astype(np.uint64)
        b = a.copy()
        cut = int(2000 * (1 - share))
        b[:cut] = rng.integers(0, 2**63, cut).astype(np.uint64)
        true = (2000 - cut) / (2000 + cut)
        ra, rb = neardup.sketch(np.unique(a)), neardup.sketch(np.unique(b))
        got = neardup.estimate(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))[0]
        assert abs(got - true) < 5 * np.sqrt(true * (1 - true) / neardup.M) + 0.01


def test_registers_merge_by_maximum():
    x = np.arange(1, 3000, dtype=np.uint64) * np.uint64(2654435761)
    assert (np.maximum(neardup.sketch(x[:1700]), neardup.sketch(x[1000:])) == neardup.sketch(x)).all()
