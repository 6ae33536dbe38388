"""Facts about boats, classes and the fleet, for all of them at once: what a report on one boat reads a row of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import drift_stats
from .relational import pick_per_key

# Bands of the coefficient of variation, and what counts as a gap or as enough finishes to report.
ONE_DESIGN_CV, MODERATE_CV, GAP, ENOUGH = 0.005, 0.015, 0.005, 10
FEET = 3.28084


def evolution(snapshots: DataFrame, boat: str, day: str, rating: str, tie: str) -> DataFrame:
    """Per boat: how many snapshots, first and last rating, total movement, and the largest jump with its day (the first
    of equally large ones; 0 and none if nothing moved)."""
    w = Window.partitionBy(boat).orderBy(day, tie)
    s = snapshots.withColumn("_d", F.col(rating) - F.lag(rating).over(w))
    at = F.struct(day, tie)
    out = s.groupBy(boat).agg(
        F.count("*").alias("n"),
        F.min_by(rating, at).alias("first_rating"),
        F.max_by(rating, at).alias("last_rating"),
        F.min(F.when(F.abs("_d") > 0, F.struct((-F.abs("_d")).alias("size"), F.col(day).alias("day"), F.col(tie).alias("tie"), F.col("_d").alias("jump")))).alias("_j"),
    )
    return out.select(boat, "n", "first_rating", "last_rating", (F.col("last_rating") - F.col("first_rating")).alias("movement"), F.coalesce("_j.jump", F.lit(0.0)).alias("jump"), F.col("_j.day").alias("jump_day"))


def class_context(boats: DataFrame, design: str, boat: str, rating: str, wins: str, top: int = 5) -> DataFrame:
    """Per class: its ratings' spread and middle, and the first boats by wins, then rating."""
    rated = boats.filter(F.col(rating).isNotNull() & F.col(design).isNotNull())
    stats = rated.groupBy(design).agg(F.count("*").alias("n"), F.min(rating).alias("least"), F.max(rating).alias("most"), F.percentile(rating, F.lit(0.5)).alias("median"), F.avg(rating).alias("mean"))
    w = Window.partitionBy(design).orderBy(F.desc(wins), F.desc(rating), boat)
    best = rated.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).groupBy(design).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", boat))), lambda x: x[boat]).alias("top"))
    return stats.join(best, design)


def summary(boats: DataFrame, context: DataFrame, design: str) -> DataFrame:
    """boats: boat, design, rating, finishes, wins, podiums. The headline numbers: the gap to the class median where it
    is worth a line, and the share of wins where there are enough finishes."""
    x = boats.join(context.select(design, "median"), design, "left")
    gap = F.col("rating") - F.col("median")
    told = F.abs(gap) > GAP
    return x.withColumn("gap", F.when(told, gap)).withColumn("side", F.when(told, F.when(gap > 0, "above").otherwise("below"))).withColumn("win_pct", F.when(F.col("finishes") >= ENOUGH, F.col("wins") * 100 / F.col("finishes")))


def drivers(anatomy: DataFrame, boat: str, most: int = 10) -> DataFrame:
    """Of every boat's contributions (feature, contrib) the largest ones either way, numbered."""
    w = Window.partitionBy(boat).orderBy(F.abs("contrib").desc(), "feature")
    return anatomy.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def histogram(df: DataFrame, group: Sequence[str], value: str, bins: int = 20) -> DataFrame:
    """bin, low, high and n of equal bins between a group's least and largest value; without spread half a unit to either
    side. Empty bins are left out."""
    ends = df.filter(F.col(value).isNotNull()).groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.select(*[f"_{g}" for g in group], F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width)).cast("int")
    x = df.filter(F.col(value).isNotNull()).join(ends, same).withColumn("bin", at)
    return x.groupBy(*group, "bin").agg(F.min(F.col("_lo") + width * F.col("bin")).alias("low"), F.min(F.col("_lo") + width * (F.col("bin") + 1)).alias("high"), F.count("*").alias("n"))


def fleet_drift(deltas: DataFrame, delta: str, stable: str, country: str) -> tuple[DataFrame, DataFrame]:
    """The fleet's drift from the boats whose measurements didn't change, or from all (whole fleet false) where there are
    none; and the drift of every country from stable boats only."""
    known = deltas.filter(F.col(delta).isNotNull())
    kinds = F.when(F.col(stable), F.array(F.lit("all"), F.lit("stable"))).otherwise(F.array(F.lit("all")))
    both = drift_stats(known.select(F.explode(kinds).alias("_of"), delta), "_of", delta)  # two rows
    best = both.agg(F.max_by(F.struct("*"), "_of").alias("r"), F.max(F.when(F.col("_of") == "all", F.col("n"))).alias("n_total")).filter("n_total IS NOT NULL")
    fleet = best.select("r.*", "n_total").withColumn("from_stable", F.col("_of") == "stable").drop("_of")
    by_country = known.filter(F.col(stable) & F.col(country).isNotNull()).groupBy(country).agg(
        F.count("*").alias("n_stable"),
        F.round(F.avg(delta), 5).alias("mean_drift"),
        F.round(F.percentile(delta, F.lit(0.5)), 5).alias("median_drift"),
        F.round(F.count_if(F.col(delta) < 0) / F.count("*") * 100, 1).alias("pct_decreased"),
    )
    return fleet, by_country


def design_profiles(boats: DataFrame, results: DataFrame, certificates: DataFrame, races: int = 3) -> DataFrame:
    """A row a design. boats: boat, design, rating (latest), loa, lh, country. results: boat, place, fleet.
    certificates: boat, gph, day."""
    b = boats.filter(F.col("rating").isNotNull() & F.col("design").isNotNull())
    sd = F.coalesce(F.stddev("rating"), F.lit(0.0))
    stats = b.groupBy("design").agg(
        F.count("*").alias("n_boats"), F.avg("rating").alias("mean"), F.percentile("rating", F.lit(0.5)).alias("median"), sd.alias("sd"), F.min("rating").alias("least"), F.max("rating").alias("most"),
        F.coalesce(F.avg("loa"), F.avg("lh")).alias("avg_loa"), F.countDistinct(F.nullif("country", F.lit(""))).alias("n_countries"),
    )
    per = results.groupBy("boat").agg(F.count("*").alias("races"), F.count_if(F.col("place").isNotNull()).alias("finished"), F.avg(F.col("place") / F.col("fleet")).alias("share"))
    mine = b.select("boat", "design").join(per, "boat")
    enough = F.col("finished") >= races
    gain = F.when(enough, (0.5 - F.col("share")) * 100)
    activity = mine.groupBy("design").agg(F.count_if(enough).alias("n_with_races"), F.avg(gain).alias("mean_gain"), F.percentile(gain, F.lit(0.5)).alias("median_gain"), F.sum("races").alias("races"), (F.sum("races") / F.count("*")).alias("races_per_boat"))
    last = pick_per_key(certificates.withColumn("_l", F.max("day").over(Window.partitionBy("boat"))).filter("day = _l AND gph IS NOT NULL"), ["boat", "gph"], ["day"])
    gph = b.select("boat", "design").join(last, "boat").groupBy("design").agg(F.avg("gph").alias("avg_gph"), F.count("*").alias("n_gph"))
    cv = F.col("sd") / F.col("mean")
    potential = F.when((F.col("sd") == 0) | (F.col("mean") == 0), None).when(cv < ONE_DESIGN_CV, "low").when(cv < MODERATE_CV, "moderate").otherwise("high")
    per_foot: Column = F.when(F.col("avg_loa") > 0, F.col("mean") / (F.col("avg_loa") * FEET))
    out = stats.join(activity, "design", "left").join(gph, "design", "left")
    return out.withColumn("spread", F.col("most") - F.col("least")).withColumn("rating_per_foot", per_foot).withColumn("potential", potential)


def stated(column: str | Column) -> Column:
    """A text that says something; blank is null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(c, F.lit(""))


def skipper_stints(results: DataFrame, boat: str = "boat") -> DataFrame:
    """boat, skipper, races, first_date, last_date, wins, podiums, is_current. results: boat, skipper, day, place. Current is the
    skipper of the last race; then the one of more races, then by name. A stint without a dated race is current only if there is no other."""
    rows = results.withColumn("skipper", stated("skipper")).filter("skipper IS NOT NULL")
    per = rows.groupBy(boat, "skipper").agg(F.count("*").alias("races"), F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.count_if(F.col("place") == 1).alias("wins"), F.count_if(F.col("place").between(1, 3)).alias("podiums"))
    order = F.struct(F.col("last_date").isNull(), -F.unix_date("last_date"), -F.col("races"), F.col("skipper"))
    now = per.groupBy(F.col(boat).alias("_b")).agg(F.min_by("skipper", order).alias("_now"))
    return per.join(now, F.col(boat).eqNullSafe(F.col("_b"))).withColumn("is_current", F.col("skipper") == F.col("_now")).drop("_b", "_now")


def home_clubs(results: DataFrame, boat: str = "boat", latest: int = 15) -> DataFrame:
    """boat, club, n: the club named most often in a boat's last dated results, ties to the smaller name. results: boat, id, day,
    club_name, organizing_club, boat_club; the first of these that says something is a result's club. Results without one take up their
    place among the last."""
    club = F.coalesce(stated("club_name"), stated("organizing_club"), stated("boat_club")).alias("club")
    w = Window.partitionBy(boat).orderBy(F.desc("day"), F.desc("id"))
    recent = results.filter("day IS NOT NULL").select(boat, "id", "day", club).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= latest)
    per = recent.filter("club IS NOT NULL").groupBy(boat, "club").agg(F.count("*").alias("n"))
    return per.groupBy(boat).agg(F.min_by("club", F.struct(-F.col("n"), F.col("club"))).alias("club"), F.max("n").alias("n"))


def performance_facts(results: DataFrame, boat: str = "boat") -> DataFrame:
    """boat, finishes (finished and placed), wins, podiums, distinct_events. results: boat, status, place, event."""
    placed = (F.col("status") == "finished") & F.col("place").isNotNull()
    return results.groupBy(boat).agg(F.count_if(placed).alias("finishes"), F.count_if(F.col("place") == 1).alias("wins"), F.count_if(F.col("place").between(1, 3)).alias("podiums"), F.countDistinct("event").alias("distinct_events"))


def recent_results(results: DataFrame, boat: str = "boat", most: int = 20) -> DataFrame:
    """The last placed results of every boat, numbered from 1: the latest day first, none last, then the larger id. Each task keeps
    as many rows of a boat at most before the shuffle."""
    w = Window.partitionBy(boat).orderBy(F.col("day").desc_nulls_last(), F.desc("id"))
    return results.filter("place IS NOT NULL").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
