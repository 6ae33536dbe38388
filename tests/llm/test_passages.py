"""Repeated passages against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from windrose.llm import passages

LENGTH, GRAM = 40, 12


def brute(rows, length):
    seen = Counter(b[k : k + length] for _, b in rows for k in range(len(b) - length + 1))
    out = {}
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def fixture_rows():
    rng = np.random.default_rng(3)
    words = ["alpha", "béta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    text = lambda n: " ".join(rng.choice(words, n))
    shared, line = text(30), "a line that stands in nearly every document."
    docs = [text(int(n)) for n in rng.integers(1, 60, 40)]
    docs += [text(10) + shared + text(5) for _ in range(6)] + [line + text(9) for _ in range(8)]
    docs += [docs[0]] * 4 + [docs[1] + "x"] * 3
    docs += ["aaaa" * 40, "ab" * 100, "", None, "short", shared[:40], "\x00" * 90, "日本語" * 30]
    return list(enumerate(docs))


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = passages.remove_repeats(df, LENGTH, GRAM)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()}


def test_equals_brute_force(spark):
    rows = fixture_rows()
    assert found(spark, rows) == brute([(i, (t or "").encode()) for i, t in rows], LENGTH)


def test_hot_anchors_counted_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(passages, "LARGE", 3)
    rows = fixture_rows()
    assert found(spark, rows) == brute([(i, (t or "").encode()) for i, t in rows], LENGTH)


def test_several_buckets_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(passages, "BUCKET", 10)
    rows = fixture_rows()
    assert found(spark, rows) == brute([(i, (t or "").encode()) for i, t in rows], LENGTH)


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_repeated_rows_remove_each_other_and_extra_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "x" * 3 + "word " * 20, 5, "u"), (1, "x" * 3 + "word " * 20, 5, "u")], "doc_id long, text string, uid int, spans string")
    out = passages.remove_repeats(df, LENGTH, GRAM).collect()
    assert [r.n_removed for r in out] == [r.n_bytes for r in out] and len(out) == 2


@pytest.mark.parametrize("n", [1, 5, 200])
def test_every_window_holds_an_anchor(n):
    raw = np.random.default_rng(n).integers(97, 100, 500 + n).astype(np.uint8)
    at, _, _ = passages.anchors(raw, LENGTH, GRAM)
    starts = np.arange(len(raw) - LENGTH + 1)
    assert (np.searchsorted(at, starts) < np.searchsorted(at, starts + LENGTH - GRAM + 1)).all()
