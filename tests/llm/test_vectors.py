"""One-bit search against brute force."""

import numpy as np
import pytest

from windrose.llm import vectors


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, qv in ok:
        if q % 20 == 0:
            scored = sorted(((-float(np.add.accumulate(qv * v)[-1]), i) for i, v in ok if i != q and len(v) == len(qv)))[:k]
            for r, (s, i) in enumerate(scored, 1):
                out[q, r] = (i, -s)
    return out


@pytest.mark.parametrize("block", [8192, 37])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "CANDIDATES", block)
    monkeypatch.setattr(vectors, "QUERIES", max(3, block // 8))
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(16) * (1 + i % 3)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(30)]  # copies: ties go to the smaller id
    rows += [(400, None), (401, [0.0] * 16), (402, [1.0, None] + [0.0] * 14), (403, [float("nan")] * 16), (404, [float("inf")] * 16), (405, [1.0, 2.0]), (420, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]  # as floats
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vectors.nearest(df, lambda c: c % 20 == 0).collect()}
    assert got == brute(rows, 20)


def test_bounds_hold_for_nearly_all_pairs():
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal(64)
    turn, centre = vectors.rotation(64), x.mean(0)
    bits, norm, along = vectors.encode(x, centre, turn)
    signs = (np.unpackbits(bits, axis=1) * 2.0 - 1) / 8
    d = q - centre
    guess = norm / along * (signs @ (d @ turn))
    error = np.abs(guess - (x - centre) @ d) / (norm * np.sqrt(d @ d))
    bound = vectors.EPSILON * np.sqrt(1 - along**2) / along / np.sqrt(63)
    assert (error <= bound).mean() > 0.99


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, id int, v string, dim int, q int")
    assert vectors.nearest(df, lambda c: c % 20 == 0).count() == 0
