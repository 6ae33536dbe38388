"""Freshness, health, gates and audits. Every look back in time has its own as_of, so results don't depend on the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import checkpoint_dir


def since(time: str, as_of: str, hours: float) -> Column:
    return F.col(time) > F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(int(hours)))


def rolling_counts(events: DataFrame, time: str, as_of: str, windows: dict[str, int], failed: Column) -> DataFrame:
    """window, n, n_failed for look-backs in hours, overlapping; empty ones stay, with 0. One pass of conditional sums."""
    sums = [x for name, h in windows.items() for x in (F.count_if(since(time, as_of, h)).alias(f"n_{name}"), F.count_if(since(time, as_of, h) & failed).alias(f"f_{name}"))]
    packed = F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"n_{n}").alias("n"), F.col(f"f_{n}").alias("n_failed")) for n in windows]))
    return events.agg(*sums).select(packed.alias("p")).select("p.*")


def source_state(events: DataFrame, source: str, time: str, as_of: str, fresh_hours: int, expected: DataFrame | None = None) -> DataFrame:
    """source, last, n, state: fresh, stale or never; expected: sources that should be there."""
    seen = events.groupBy(source).agg(F.max(time).alias("last"), F.count("*").alias("n"))
    if expected is not None:
        seen = expected.select(source).distinct().join(seen, source, "full")
    state = F.when(F.col("last").isNull(), "never").when(since("last", as_of, fresh_hours), "fresh").otherwise("stale")
    return seen.withColumn("state", state).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def worst_state(states: DataFrame) -> DataFrame:
    rank = F.when(F.col("state") == "never", 2).when(F.col("state") == "stale", 1).otherwise(0)
    return states.agg(F.element_at(F.array(F.lit("fresh"), F.lit("stale"), F.lit("never")), F.coalesce(F.max(rank), F.lit(0)) + 1).alias("worst"))


def watchdog(config: DataFrame, runs: DataFrame, data: DataFrame, as_of: str) -> DataFrame:
    """config: source, run_within_h, data_within_h, optional. runs and data: source, at. alert and its reason."""
    hours = lambda c: F.timestamp_diff("HOUR", F.col(c), F.lit(as_of).cast("timestamp_ntz"))
    x = config.join(runs.groupBy("source").agg(F.max("at").alias("run")), "source", "left").join(data.groupBy("source").agg(F.max("at").alias("seen")), "source", "left")
    reason = F.when(F.col("optional") & F.col("run").isNull(), None).when(F.col("run").isNull(), "never ran").when(hours("run") > F.col("run_within_h"), "run overdue")
    return x.withColumn("reason", reason.when(F.col("seen").isNull(), "no data").when(hours("seen") > F.col("data_within_h"), "data stale")).withColumn("alert", F.col("reason").isNotNull())


def gate(rows: DataFrame, confidence: str, recall: str, baseline: str, least_confidence: float = 0.70, least_recall: float = 0.75, least_baseline: int = 5) -> DataFrame:
    """Adds accepted: enough confidence, and enough recall wherever the baseline is large enough to tell."""
    ok = (F.col(confidence) >= least_confidence) & ((F.col(baseline) < least_baseline) | (F.col(recall) >= least_recall))
    return rows.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def audit(stored: str, found: str) -> Column:
    """How far a value found again is from the stored one."""
    s, f = F.col(stored), F.col(found)
    off = F.abs(s - f) / F.when(s != 0, F.abs(s)).otherwise(F.abs(f))
    return (
        F.when(s.isNull() & f.isNull(), "BOTH_NULL")
        .when(s.isNull(), "MISSING_DB")
        .when(f.isNull(), "MISSING_PDF")
        .when((s == f) | (off < 0.005), "OK")
        .when(off <= 0.01, "MINOR")
        .when(off <= 0.05, "MODERATE")
        .otherwise("MAJOR")
    )


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Foreign keys without a parent: how often each occurs."""
    keys = parent.select(F.col(pk).alias(fk)).distinct()
    return child.filter(F.col(fk).isNotNull()).join(keys, fk, "left_anti").groupBy(fk).agg(F.count("*").alias("n"))


def match_names(left: DataFrame, right: DataFrame, group: str, name: str, least: int = 3) -> DataFrame:
    """group, a, b: names matched one to one within a group, case and blanks aside. Equal names first; what is left goes in the order
    longest first, then by letters: each name of the left takes the first free one of the right that holds it or is held
    by it, the shorter one of at least `least` letters.

    Names take turns in rounds: a pair counts as soon as each is the other's first among what is left, which gives the same as
    one after another, because all names of the right rank those of the left alike. A round is two aggregations and
    joins over the pairs left; there are as many as the longest chain of names that wait for each other, mostly two or three.
    Candidates are joined on the group and the first `least` letters of the shorter name, so no group has to fit in a task."""
    checkpoint_dir(left.sparkSession)

    def norm(df: DataFrame, n: str) -> DataFrame:
        k = F.lower(F.regexp_replace(name, r"\s+", ""))
        return df.select(group, k.alias("k"), F.col(name).alias(n)).filter("k <> ''").groupBy(group, "k").agg(F.min(n).alias(n))

    x, y = norm(left, "a"), norm(right, "b")
    equal = x.join(y, [group, "k"])
    size = max(least, 1)
    restx = x.join(equal, [group, "k"], "left_anti").filter(F.length("k") >= least).withColumnRenamed("k", "ka")
    resty = y.join(equal, [group, "k"], "left_anti").filter(F.length("k") >= least).withColumnRenamed("k", "kb")

    def held(inner: DataFrame, i: str, outer: DataFrame, o: str) -> DataFrame:
        pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(o) - size + 1, F.lit(1))), lambda at: F.substring(F.col(o), at, F.lit(size))))
        spread = outer.withColumn("_g", F.explode(pieces))
        return inner.withColumn("_g", F.substring(i, 1, size)).join(spread, [group, "_g"]).filter(F.contains(F.col(o), F.col(i))).select(group, "ka", "a", "kb", "b")

    pairs = held(restx, "ka", resty, "kb").union(held(resty, "kb", restx, "ka")).distinct().checkpoint()
    out = equal.select(group, "a", "b")
    turn = lambda k: F.struct(-F.length(k), F.col(k))
    while pairs.limit(1).count():
        first_b = pairs.groupBy(group, "ka").agg(F.min(turn("kb")).alias("_b"))
        first_a = pairs.groupBy(group, "kb").agg(F.min(turn("ka")).alias("_a"))
        agreed = pairs.join(first_b, [group, "ka"]).join(first_a, [group, "kb"]).filter((F.col("_b") == turn("kb")) & (F.col("_a") == turn("ka"))).select(group, "ka", "a", "kb", "b").checkpoint()
        out = out.unionByName(agreed.select(group, "a", "b"))
        pairs = pairs.join(agreed.select(group, "ka"), [group, "ka"], "left_anti").join(agreed.select(group, "kb"), [group, "kb"], "left_anti").checkpoint()
    return out


def number_audit(texts: DataFrame, key: str, text: str, allowed: DataFrame, value: str) -> DataFrame:
    """Numbers of a text that no allowed value of its key gives when rounded to 0 to 4 digits, with or without sign."""
    from ..functions.text import numbers_in

    said = texts.select(key, F.explode(numbers_in(text)).alias("x")).distinct()
    forms = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda d: F.array(F.round(F.col(value), 4), F.round(F.col(value) * F.pow(F.lit(10.0), d)) / F.pow(F.lit(10.0), d)))))
    ok = allowed.select(key, forms.alias("v")).select(key, F.explode(F.array("v", F.abs("v"))).alias("x")).distinct()
    return said.join(ok, [key, "x"], "left_anti")


def health(tables: dict[str, tuple[DataFrame, str, int]], log: DataFrame, as_of: str) -> DataFrame:
    """check, value and alert. tables: name -> (rows, day column, most days old); log: source, status, started_at. Age is
    counted in whole days; failures count over a day, and running jobs are stuck after two hours."""
    now = F.lit(as_of).cast("timestamp_ntz")
    rows = None
    for name, (df, day, most) in tables.items():
        age = df.agg(F.date_diff(now.cast("date"), F.max(day).cast("date")).cast("long").alias("value"))
        one = age.select(F.lit(f"{name} days").alias("check"), "value", F.coalesce(F.col("value") > most, F.lit(False)).alias("alert"))
        rows = one if rows is None else rows.unionByName(one)
    failed = F.count_if((F.col("status") == "failed") & (F.col("started_at") > now - F.make_dt_interval(hours=F.lit(24))))
    stuck = F.count_if((F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(hours=F.lit(2))))
    jobs = log.agg(failed.alias("f"), stuck.alias("s")).select(F.explode(F.array(F.struct(F.lit("failed in a day").alias("check"), F.col("f").alias("value")), F.struct(F.lit("stuck").alias("check"), F.col("s").alias("value")))).alias("x"))
    jobs = jobs.select("x.*").withColumn("alert", F.col("value") > 0)
    return jobs if rows is None else rows.unionByName(jobs)


def name_diff(old: DataFrame, new: DataFrame, group: str, name: str, most: int = 25) -> DataFrame:
    """Per group: how many old names the new ones hold too, the share, up to `most` missing and extra names in order, and
    the percentage of old rows without a name."""
    norm = lambda df: df.select(group, F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", "")).alias("k"))
    o, n = norm(old), norm(new)
    both = o.filter("k <> ''").distinct().withColumn("o", F.lit(True)).join(n.filter("k <> ''").distinct().withColumn("n", F.lit(True)), [group, "k"], "full")
    kind = F.when(F.col("n").isNull(), "missing").when(F.col("o").isNull(), "extra").otherwise("both")
    both = both.withColumn("kind", kind).withColumn("r", F.row_number().over(Window.partitionBy(group, "kind").orderBy("k")))
    first = lambda c: F.array_sort(F.collect_list(F.when((F.col("kind") == c) & (F.col("r") <= most), F.col("k")))).alias(c)
    per = both.groupBy(group).agg(F.count("o").alias("named"), F.count_if(F.col("kind") == "both").alias("matched"), first("missing"), first("extra"))
    hollow = o.groupBy(group).agg(F.floor((F.count("*") - F.countDistinct(F.nullif("k", F.lit("")))) * 100 / F.count("*")).alias("hollow_pct"))
    rate = F.round(F.when(F.col("named") > 0, F.col("matched") / F.col("named")).otherwise(0.0), 3)
    return per.withColumn("rate", rate).join(hollow, group, "left")
