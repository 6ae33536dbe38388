"""Racing and rating analytics over result and snapshot tables, for all boats at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .relational import checkpoint_dir, expected_share, running

# How hard a measurement is to change (1 easy, 8 not at all), and what a step of each class costs.
FEASIBILITY = {
    "headsails": 1, "spinnakers": 1, "crew": 1, "dlr": 2, "hlu": 3, "hlp": 3, "sym_slu": 3, "sym_sf": 3, "stl": 3,
    "e": 4, "p": 4, "j": 4, "muw": 5, "mhw": 5, "displacement": 6, "draft": 7, "lh": 8, "beam": 8,
}
COST = {1: 0.0, 2: 0.0, 3: 2500.0, 4: 4000.0, 5: 10000.0, 6: 15000.0, 7: 25000.0, 8: 0.0}
EVIDENCE = {"strong": 1.0, "moderate": 0.7, "limited": 0.4}


def rating_advantage(results: DataFrame, boat: str, race: Sequence[str], place: str, fleet: str, rating: str) -> DataFrame:
    """Per boat: the mean of 100 * (expected - actual share of the fleet), a 95 % interval from three races on, wins and
    podiums. One window by race and one aggregation by boat."""
    r = expected_share(results, race, rating).filter((F.col(place).isNotNull()) & (F.col(fleet) > 0))
    actual = F.col(place) / F.col(fleet)
    r = r.withColumn("actual", actual).withColumn("e", F.coalesce("expected", F.lit(0.5))).withColumn("gain", (F.col("e") - F.col("actual")) * 100)
    per = r.groupBy(boat).agg(
        F.avg("gain").alias("rai"),
        F.count("*").alias("n_races"),
        F.stddev("gain").alias("sd"),
        F.avg("actual").alias("avg_finish_pct"),
        F.avg("e").alias("avg_expected_pct"),
        F.count_if(F.col(place) == 1).alias("wins"),
        F.count_if(F.col(place) <= 3).alias("podiums"),
    )
    # the t quantile by degrees of freedom: a table up to 200, beyond it the normal's expansion
    quantiles = F.array(*[F.lit(stats.t_quantile(0.975, d)) for d in range(1, 201)])
    df = F.col("n_races") - 1
    z = 1.959963984540054
    far = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
    half = F.when(F.col("n_races") >= 3, F.when(df <= 200, F.get(quantiles, (df - 1).cast("int"))).otherwise(far) * F.col("sd") / F.sqrt("n_races")).otherwise(0.0)
    return per.withColumn("ci_lower", F.col("rai") - half).withColumn("ci_upper", F.col("rai") + half).drop("sd")


def head_to_head(results: DataFrame, boat: str, race: Sequence[str], place: str, least: int = 1) -> DataFrame:
    """Wins, losses and meetings of every pair that met in at least `least` races. The pairs are the result; within a
    race they come from an equi-join on the race. A pair is counted once, and turned round when it has met often enough."""
    key = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in race])
    side = lambda x: results.select(key.alias("k"), F.col(boat).alias(x), F.col(place).alias(f"p_{x}"))
    met = side("boat").join(side("rival"), "k").filter("boat < rival")
    out = met.groupBy("boat", "rival").agg(
        F.sum(F.when(F.col("p_boat") < F.col("p_rival"), 1).otherwise(0)).alias("wins"),
        F.sum(F.when(F.col("p_boat") > F.col("p_rival"), 1).otherwise(0)).alias("losses"),
        F.count("*").alias("meetings"),
    )
    often = out.filter(F.col("meetings") >= least)
    both = F.array(F.struct("boat", "rival", "wins", "losses"), F.struct(F.col("rival").alias("boat"), F.col("boat").alias("rival"), F.col("losses").alias("wins"), F.col("wins").alias("losses")))
    return often.select(F.explode(both).alias("p"), "meetings").select("p.*", "meetings")


def top_share(df: DataFrame, group: Sequence[str], order: Sequence, share: float = 0.1) -> DataFrame:
    """The first max(1, floor(n * share)) rows of each group."""
    w = Window.partitionBy(*group)
    return df.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order))).filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_n", "_r")


def usable_features(df: DataFrame, group: str, features: Sequence[str], coverage: float = 0.5) -> DataFrame:
    """Features under the coverage set to null for the whole group, then rows with a null among the others dropped."""
    w = Window.partitionBy(group)
    for f in features:
        df = df.withColumn(f"_k_{f}", F.count(f).over(w) / F.count("*").over(w) >= coverage)
    whole = F.lit(True)
    for f in features:
        whole = whole & (F.col(f).isNotNull() | ~F.col(f"_k_{f}"))
    kept = df.filter(whole)
    return kept.select(*[F.when(F.col(f"_k_{c}"), F.col(c)).alias(c) if c in features else F.col(c) for c in df.columns if not c.startswith("_k_")])


def class_models(df: DataFrame, group: str, target: str, features: Sequence[str], order: str, least: int = 5) -> DataFrame:
    """A ridge model of target on features for every group, a row a feature: std_beta, beta, rank, tier, alpha, r2,
    cv_r2, n. Groups of fewer than `least` rows get correlations (tier 'C'), groups without spread tier 'one-design'.
    Features filled below half of a group's rows are left out there; rows with a null in the others are dropped.

    Groups of every size take one path: rows are numbered in the order given over range partitions, dealt into
    contiguous folds, and reduced to means and sums of products by (group, fold), from which alpha is chosen and the
    model fitted. Rows with a null key are a group of their own."""
    schema = "grp string, feature string, std_beta double, beta double, rank int, tier string, alpha double, r2 double, cv_r2 double, n long"
    features, columns = list(features), [c.split()[0] for c in schema.split(", ")]
    xs = [f"x{i}" for i in range(len(features))]
    names = [*xs, "y"]
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("o"), *[number(f).alias(x) for f, x in zip(features, xs, strict=True)], number(target).alias("y"))

    filled = rows.groupBy(F.col("grp").alias("g")).agg(*[(F.count(x) / F.count("*") >= 0.5).alias(f"k_{x}") for x in xs])
    x = rows.join(filled, F.col("grp").eqNullSafe(F.col("g"))).drop("g").filter(F.col("y").isNotNull())
    for c in xs:
        x = x.filter(F.col(c).isNotNull() | ~F.col(f"k_{c}")).withColumn(c, F.when(F.col(f"k_{c}"), F.col(c)))

    # written, so that the offsets and the rows see the same partitions
    checkpoint_dir(df.sparkSession)
    inside = [F.col("o").asc_nulls_last(), *names]
    dealt = x.select("grp", "o", *names).repartitionByRange("grp", *inside).withColumn("p", F.spark_partition_id()).checkpoint()
    per = dealt.groupBy(F.col("grp").alias("g"), F.col("p").alias("q")).agg(F.count("*").alias("c"))
    whole = Window.partitionBy("g")
    per = per.withColumn("before", F.sum("c").over(whole.orderBy("q")) - F.col("c")).withColumn("n", F.sum("c").over(whole))
    at = F.row_number().over(Window.partitionBy("grp", "p").orderBy(*inside)) - 1 + F.col("before")
    size, more = F.expr(f"n div {stats.FOLDS}"), F.col("n") % stats.FOLDS
    fold = F.when(F.col("at") < more * (size + 1), F.floor(F.col("at") / (size + 1))).otherwise(more + F.floor((F.col("at") - more * (size + 1)) / size))
    numbered = dealt.join(per, F.col("grp").eqNullSafe(F.col("g")) & (F.col("p") == F.col("q"))).withColumn("at", at)
    folds = numbered.withColumn("fold", F.when(F.col("n") >= stats.LEAST_CV, fold).otherwise(0).cast("int"))
    moments = [F.count("*").alias("n"), *[how(a).alias(f"{k}_{a}") for a in names for k, how in (("lo", F.min), ("hi", F.max), ("m", F.avg))]]
    moments += [F.covar_pop(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fold")
        g, n = pdf.grp.iloc[0], int(pdf.n.sum())
        kept = [i for i, c in enumerate(xs) if pdf[f"m_{c}"].notna().all()]
        cols, used = [features[i] for i in kept], [*[xs[i] for i in kept], "y"]
        made = lambda rows: pd.DataFrame(rows, columns=columns)
        if n < 2 or not cols:
            return made([])
        if pdf.hi_y.max() - pdf.lo_y.min() < 0.001:
            return made([(g, c, 0.0, 0.0, i + 1, "one-design", None, None, None, n) for i, c in enumerate(cols)])
        parts = []
        for r in pdf.to_dict("records"):
            products = [[r[f"c_{a}_{b}"] if f"c_{a}_{b}" in r else r[f"c_{b}_{a}"] for b in used] for a in used]
            parts.append((r["n"], np.array([r[f"m_{a}"] for a in used]), np.array(products) * r["n"]))
        for i, a in enumerate(used):  # a mean is a rounded sum: keep a constant feature's spread at 0
            if (low := pdf[f"lo_{a}"].min()) == pdf[f"hi_{a}"].max():
                for _, m, p in parts:
                    m[i], p[i], p[:, i] = low, 0.0, 0.0
        if n < least:
            s = stats.merged(parts)[2]
            r = [float(s[i, -1] / np.sqrt(s[i, i] * s[-1, -1])) if s[i, i] > 0 else 0.0 for i in range(len(cols))]
            return made([(g, cols[i], r[i], None, k + 1, "C", None, None, None, n) for k, i in enumerate(np.argsort([-abs(v) for v in r], kind="stable"))])
        m = stats.ridge_from_moments(parts)
        tier = "A" if m["r2"] > 0.3 else "B"
        order_ = np.argsort(-np.abs(m["std_beta"]), kind="stable")
        return made([(g, cols[i], m["std_beta"][i], m["beta"][i], k + 1, tier, m["alpha"], m["r2"], m["cv_r2"], n) for k, i in enumerate(order_)])

    return folds.groupBy("grp", "fold").agg(*moments).groupBy("grp").applyInPandas(one, schema)


# The step of a measurement that a coefficient is told for.
SCALES = {"displacement": 100.0, "draft": 0.1, "lh": 0.1, "beam": 0.1, "p": 0.1, "e": 0.1, "j": 0.1, "hlu": 0.1, "hlp": 0.1, "muw": 0.1, "mhw": 0.1, "stl": 0.1, "sym_slu": 0.1, "sym_sf": 0.1}
UNITS = {"displacement": "per 100kg", "headsails": "per sail", "spinnakers": "per sail", "crew": "per person", "dlr": "per unit"}


def in_units(models: DataFrame) -> DataFrame:
    """Adds effect, what a step of the feature moves the target by, and unit, the step in words."""
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    scale = F.coalesce(F.try_element_at(as_map(SCALES), F.col("feature")), F.lit(1.0))
    unit = F.coalesce(F.try_element_at(as_map(UNITS), F.col("feature")), F.when(scale == 0.1, "per 0.1m"), F.lit("per unit"))
    return models.withColumn("effect", F.col("beta") * scale).withColumn("unit", unit)


def chosen_models(full: DataFrame, short: DataFrame, group: str, target: str, full_features: Sequence[str], short_features: Sequence[str], order: str, least: int = 5) -> DataFrame:
    """Of every group the model of the rows with full measurements (tier 'A') where there are enough of them and it
    explains more than 0.3, else that of the short ones ('B'); groups of fewer rows get correlations ('C')."""
    a = class_models(full, group, target, full_features, order, least).filter(F.col("tier").isin("A", "B") & (F.col("r2") > 0.3)).withColumn("tier", F.lit("A"))
    b = class_models(short, group, target, short_features, order, least)
    b = b.withColumn("tier", F.when(F.col("tier") == "A", "B").otherwise(F.col("tier")))
    done = a.select(F.col("grp").alias("g")).distinct()
    return a.unionByName(b.join(done, F.col("grp").eqNullSafe(F.col("g")), "left_anti"))


def fleet_model(df: DataFrame, target: str, features: Sequence[str], order: str, least: int = 5) -> DataFrame:
    """One model over all groups together (tier 'fleet'); nothing for fewer than least rows."""
    m = class_models(df.withColumn("_fleet", F.lit("all")), "_fleet", target, features, order, least)
    return m.filter(F.col("tier").isin("A", "B")).withColumn("tier", F.lit("fleet"))


def model_sweep(models: DataFrame) -> DataFrame:
    """A row a group, the best explained first: tier, n, r2, cv_r2 and the feature that weighs most."""
    per = models.groupBy("grp").agg(F.first("tier").alias("tier"), F.max("n").alias("n"), F.max("r2").alias("r2"), F.max("cv_r2").alias("cv_r2"), F.min_by("feature", "rank").alias("top_feature"))
    return per.orderBy(F.desc_nulls_last("r2"), "grp")


def collinear_pairs(df: DataFrame, features: Sequence[str], limit: float = 0.9) -> DataFrame:
    """Pairs of features with |r| above the limit, by one aggregation."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = df.agg(F.count("*").alias("n"), *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    packed = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]))
    return row.filter("n >= 3").select(packed.alias("p")).select("p.*").filter(F.abs("r") > limit)


def drift_stats(deltas: DataFrame, group: str, delta: str) -> DataFrame:
    """Per group: n, mean, median, sample deviation, Cohen's d, share decreased, and p-values of the t and Wilcoxon tests.
    The t test comes from the aggregation, the signed ranks from counts by size."""
    per = deltas.filter(F.col(delta).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"),
        F.avg(delta).alias("mean_drift"),
        F.percentile(delta, F.lit(0.5)).alias("median_drift"),
        F.coalesce(F.stddev(delta), F.lit(0.0)).alias("std_drift"),
        (F.count_if(F.col(delta) < 0) / F.count("*") * 100).alias("pct_decreased"),
    )
    nonzero = deltas.filter(F.col(delta).isNotNull() & (F.col(delta) != 0))
    ties = nonzero.groupBy(group, F.abs(delta).alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col(delta) > 0).alias("up"))
    ranked = running(ties, [group], "size", "t").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    sums = ranked.groupBy(F.col(group).alias("_g")).agg(F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum("t").alias("nz"), F.max("t").alias("most"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tied"))
    joined = per.join(sums, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    schema = f"{joined.select(group).schema.simpleString()[7:-1].replace(':', ' ')}, n long, mean_drift double, median_drift double, std_drift double, pct_decreased double, cohens_d double, p_ttest double, p_wilcoxon double"

    def p_values(it):
        for pdf in it:
            t, w = [], []
            for r in pdf.itertuples():
                t.append(stats.t_two_sided(r.mean_drift / (r.std_drift / np.sqrt(r.n)), r.n - 1) if r.n >= 3 and r.std_drift > 0 else None)
                w.append(_signed_rank_p(r))
            out = pdf.drop(columns=["plus", "nz", "most", "tied"])
            yield out.assign(cohens_d=np.where(out.std_drift > 0, out.mean_drift / out.std_drift.replace(0, np.nan), np.nan), p_ttest=pd.array(t, "Float64"), p_wilcoxon=pd.array(w, "Float64"))

    return joined.mapInPandas(p_values, schema)


def _signed_rank_p(r) -> float | None:
    if r.n < 6 or pd.isna(r.nz) or not r.nz:
        return None
    n = int(r.nz)
    least = min(r.plus, n * (n + 1) / 2 - r.plus)
    if n <= 50 and r.most == 1 and n == r.n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        return float(min(1.0, 2 * ways[: int(least) + 1].sum() / 2.0**n))
    import math

    var = n * (n + 1) * (2 * n + 1) / 24 - r.tied / 48
    return math.erfc(abs(least - n * (n + 1) / 4) / math.sqrt(2 * var)) if var > 0 else None


def recommendations(values: DataFrame, models: DataFrame, means: DataFrame, scales: dict[str, float] | None = None) -> DataFrame:
    """values: boat, grp, feature, current. models: grp, feature, std_beta, beta, tier. means: grp, feature, mean, smart.
    Ranked changes per boat, those that would move the rating by less than 0.0005 left out."""
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    x = values.join(models, ["grp", "feature"]).join(means, ["grp", "feature"])
    scale = F.coalesce(F.try_element_at(as_map(scales), F.col("feature")), F.lit(1.0)) if scales else F.lit(1.0)
    x = x.withColumn("delta", (F.coalesce("smart", "mean") - F.col("current")) * F.col("beta") / scale).filter(F.abs("delta") >= 0.0005)
    x = x.withColumn("feasibility", F.coalesce(F.try_element_at(as_map(FEASIBILITY), F.col("feature")), F.lit(5)))
    strong = F.abs("std_beta") > 0.3
    evidence = F.when(F.col("tier") == "A", F.when(strong, "strong").otherwise("moderate")).when((F.col("tier") == "B") & strong, "moderate").otherwise("limited")
    x = x.withColumn("evidence", evidence).withColumn("direction", F.when(F.col("std_beta") > 0, "decrease").otherwise("increase"))
    x = x.withColumn("seconds_per_hour", F.round(F.abs(F.col("delta") / 0.001) * 3.6, 1)).withColumn("cost", F.element_at(as_map(COST), F.col("feasibility")))
    x = x.withColumn("return", F.when(F.col("cost") > 0, F.round(F.col("seconds_per_hour") / (F.col("cost") / 1000), 2)).otherwise(999.0))
    score = F.abs("delta") * (9 - F.col("feasibility")) / 8 * F.element_at(as_map(EVIDENCE), F.col("evidence"))
    w = Window.partitionBy("boat").orderBy(F.round(score, 12).desc(), "feature")
    return x.withColumn("rank", F.row_number().over(w))
