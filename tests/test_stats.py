"""Numbers against published or directly computed ones."""

import itertools

import numpy as np
import pandas as pd
import pytest

from windrose.functions import stats
from windrose.operators import analytics


def test_student():
    assert stats.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.t_quantile(0.975, 4) == pytest.approx(2.776445105, abs=1e-7)
    assert stats.t_quantile(0.975, 1) == pytest.approx(12.7062047, abs=1e-5)
    assert stats.t_test(np.array([1.0, 2.0])) is None


def test_wilcoxon_counts_all_signs():
    x = np.array([1.2, -0.4, 2.2, 3.1, -0.9, 1.7, 0.6])
    ranks = np.argsort(np.argsort(np.abs(x))) + 1
    w = min(ranks[x > 0].sum(), ranks[x < 0].sum())
    below = sum(sum(r for r, s in zip(ranks, signs, strict=True) if s) <= w for signs in itertools.product([0, 1], repeat=7))
    assert stats.wilcoxon(x) == pytest.approx(2 * below / 2**7)
    assert stats.wilcoxon(np.zeros(8)) is None and 0 < stats.wilcoxon(np.array([1.0, 1, 1, -1, 2, 2, 0, 3])) < 1


def test_ridge_matches_normal_equations():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 3)) * [1, 5, 0.1] + 2
    y = x @ [0.5, -0.2, 3] + rng.standard_normal(40) * 0.01
    m = stats.ridge_cv(x, y)
    assert m["cv_r2"] > 0.99 and np.allclose(m["beta"], [0.5, -0.2, 3], atol=0.1)
    assert stats.ridge_cv(x[:10], y[:10])["cv_r2"] is None and stats.ridge_cv(x[:10], y[:10])["alpha"] == pytest.approx(0.01)


def test_large_groups_choose_alpha_and_drop_sparse_features(spark):
    """One group above 20,000 rows, one small one and one with a null key, each as ridge_cv fits it."""
    rng = np.random.default_rng(4)
    parts = []
    for g, n in (("large", 20_011), ("small", 37), (None, 52)):
        pdf = pd.DataFrame({"g": [g] * n, "i": rng.permutation(n), "x": rng.standard_normal(n) + 7, "z": rng.standard_normal(n), "thin": rng.standard_normal(n)})
        pdf.loc[rng.random(n) < 0.9, "thin"] = np.nan
        pdf.loc[rng.random(n) < 0.1, "z"] = np.nan
        pdf["y"] = 0.02 * pdf.x + rng.standard_normal(n)
        parts.append(pdf)
    flat = pd.DataFrame({"g": "flat", "i": range(20_001), "x": rng.standard_normal(20_001), "z": 0.1, "thin": np.nan, "y": 1.0})
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pd.concat([*parts, flat]).astype(object).itertuples(index=False)]
    df = spark.createDataFrame(rows, "g string, i long, x double, z double, thin double, y double")
    got = {(r.grp, r.feature): r for r in analytics.class_models(df, "g", "y", ["x", "z", "thin"], "i").collect()}
    assert got.keys() == {(g, f) for g in ("large", "small", None, "flat") for f in ("x", "z")}
    for pdf in parts:
        own = pdf.sort_values("i").dropna(subset=["x", "z"])
        m = stats.ridge_cv(own[["x", "z"]].to_numpy(), own.y.to_numpy())
        for k, f in enumerate(("x", "z")):
            r = got[pdf.g.iloc[0], f]
            assert r.n == len(own) and r.alpha == m["alpha"] and r.tier == "B"
            assert (r.std_beta, r.beta, r.r2, r.cv_r2) == pytest.approx((m["std_beta"][k], m["beta"][k], m["r2"], m["cv_r2"]), abs=1e-9)
    assert {r.tier for (g, _), r in got.items() if g == "flat"} == {"one-design"}


def test_tiers_of_small_groups(spark):
    rows = [("few", i, float(i), 1.0 + i) for i in range(3)] + [("flat", i, float(i), 1.0) for i in range(6)] + [("one", 0, 1.0, 1.0)]
    got = {(r.grp, r.tier) for r in analytics.class_models(spark.createDataFrame(rows, "g string, i int, x double, y double"), "g", "y", ["x"], "i").collect()}
    assert got == {("few", "C"), ("flat", "one-design")}


def test_drift_p_values(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.standard_normal(30) + 0.3, "b": rng.integers(-2, 4, 40).astype(float), "c": np.array([0.5, 0.1])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, d double")
    for r in analytics.drift_stats(df, "g", "d").collect():
        x = data[r.g]
        assert r.n == len(x) and r.mean_drift == pytest.approx(x.mean()) and r.std_drift == pytest.approx(x.std(ddof=1))
        for got, want in ((r.p_ttest, stats.t_test(x)), (r.p_wilcoxon, stats.wilcoxon(x))):
            assert (got is None or np.isnan(got)) if want is None else got == pytest.approx(want, abs=1e-9)


def test_rating_advantage_interval(spark):
    rng = np.random.default_rng(3)
    rows = [(race, b, int(p), 5, float(rng.integers(1, 4))) for race in range(6) for b, p in enumerate(rng.permutation(5) + 1)]
    df = pd.DataFrame(rows, columns=["race", "boat", "place", "fleet", "rating"])
    got = {r.boat: r for r in analytics.rating_advantage(spark.createDataFrame(df), "boat", ["race"], "place", "fleet", "rating").collect()}
    for b, own in df.groupby("boat"):
        gain = np.array([((df[df.race == r.race].rating > r.rating).sum() + 1 - r.place) / 5 * 100 for r in own.itertuples()])
        half = stats.t_quantile(0.975, 5) * gain.std(ddof=1) / np.sqrt(6)
        assert got[b].rai == pytest.approx(gain.mean()) and got[b].ci_upper == pytest.approx(gain.mean() + half)
