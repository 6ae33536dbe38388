"""Upkeep of the entity tables: new boats, backfills, cluster triage, design-class merges and derived values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import country_from_sail, normalize_name, sail_tokens
from .relational import winsorised_means
from .resolve import dealt, token_groups

YEARS_A, YEARS_B, LARGE_CLUSTER = 2, 5, 6  # spread of build years for tiers A and B; rows of a large cluster


def new_boats(results: DataFrame, boats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results: result_id, sail, name, tcc of unmatched rows. Links to existing boats that share a token (of several the
    one of the same name), and one new boat for each remaining group of shared tokens: longest name, first rating."""
    usable = dealt(results, "result_id").filter((F.length(F.trim("sail")) >= 3) & (F.trim(F.coalesce("name", F.lit(""))) != ""))
    known = boats.select("boat_id", "boat_name", F.explode(sail_tokens("boat_sail")).alias("token"))
    hits = usable.select("result_id", "name", F.explode(sail_tokens("sail")).alias("token")).join(known, "token").select("result_id", "name", "boat_id", "boat_name").distinct()
    n = F.count("*").over(Window.partitionBy("result_id"))
    ok = hits.withColumn("n", n).filter((F.col("n") == 1) | (normalize_name("name") == normalize_name("boat_name")))
    links = ok.groupBy("result_id").agg(F.min("boat_id").alias("boat_id"))
    groups = token_groups(usable.join(links, "result_id", "left_anti"))
    created = groups.groupBy("group_id").agg(
        F.max_by(F.trim("name"), F.struct(F.length(F.trim("name")), -F.col("result_id"))).alias("boat_name"),
        F.min_by(F.trim("sail"), "result_id").alias("boat_sail"),
        F.min_by("tcc", F.when(F.col("tcc").isNotNull(), F.col("result_id"))).alias("tcc"),
        F.count("*").alias("n_results"),
    )
    return links, created.withColumn("country", country_from_sail("boat_sail"))


def country_backfill(boats: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """country where null, by the longest prefix of the sail."""
    s = F.trim("sail")
    hits = [F.when(s.startswith(p), c) for p, c in sorted(prefixes.items(), key=lambda kv: (-len(kv[0]), kv[0]))]
    return boats.withColumn("country", F.coalesce("country", *hits, F.when(s.rlike("^F[0-9]+"), "AUS")))


def repair_dnf(results: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Finished rows of these sources without place and finish time did not finish."""
    bare = F.coalesce(F.get_json_object("raw", "$.finish_time"), F.lit("")) == ""
    return results.withColumn("status", F.when(F.col("source").isin(*sources) & (F.col("status") == "finished") & F.col("place").isNull() & bare, "DNF").otherwise(F.col("status")))


def cluster_facts(members: DataFrame, cluster: str = "cluster") -> DataFrame:
    """members: cluster, boat_id, design, year, country, signal (boolean), sail. A row a cluster."""
    m = members.withColumn("design", F.nullif(F.trim(F.upper("design")), F.lit("")))
    tokens = m.select(cluster, "boat_id", F.explode(sail_tokens("sail")).alias("token")).distinct()
    shared = tokens.groupBy(cluster, "token").agg(F.count("*").alias("n")).filter("n > 1").groupBy(cluster).agg(F.min("token").alias("shared_sail"))
    facts = m.groupBy(cluster).agg(
        F.count("*").alias("size"),
        F.count_if("signal").alias("bearers"),
        F.min(F.when(F.col("signal"), F.col("boat_id"))).alias("bearer"),
        F.countDistinct("design").alias("designs"),
        (F.max("year") - F.min("year")).alias("years"),
        F.countDistinct(F.nullif(F.trim(F.upper("country")), F.lit(""))).alias("countries"),
    )
    return facts.join(shared, cluster, "left")


def merge_decision(largest: int = 4) -> Column:
    """Of cluster facts: AUTO_MERGE, or the first reason against it."""
    return (
        F.when(F.col("size") > largest, "big_cluster")
        .when(F.col("bearers") > 1, "multi_signal")
        .when(F.col("designs") > 1, "design_conflict")
        .when(F.col("years") > YEARS_A, "year_conflict")
        .otherwise("AUTO_MERGE")
    )


def triage_tier() -> Column:
    """Of cluster facts: A shared identifier, B same design, years and country, C separate, D unclear."""
    spread = F.coalesce("years", F.lit(0))
    shared = F.col("shared_sail").isNotNull()
    return (
        F.when((F.col("designs") > 1) | (spread > YEARS_B), "C")
        .when((F.col("size") > LARGE_CLUSTER) & ~shared, "C")
        .when(shared & (spread <= YEARS_A), "A")
        .when((F.col("designs") == 1) & (F.col("countries") <= 1), "B")
        .otherwise("D")
    )


def design_merge_plan(classes: DataFrame, boats: DataFrame, columns: Sequence[str], canonical: Column) -> DataFrame:
    """classes: id, name and columns. Per canonical name with several rows: the winner (exact name, most columns set,
    most boats, lowest id), the losers, and the winner's columns with gaps filled from the losers by id."""
    per = boats.groupBy(F.col("design").alias("name")).agg(F.count("*").alias("boats"))
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    m = classes.join(per, "name", "left").withColumn("canonical", canonical).withColumn("filled", filled)
    w = Window.partitionBy("canonical").orderBy((F.col("name") == F.col("canonical")).desc(), F.desc("filled"), F.coalesce("boats", F.lit(0)).desc(), "id")
    m = m.withColumn("r", F.row_number().over(w))
    order = F.when(F.col("r") == 1, F.lit(-1)).otherwise(F.col("id"))
    fills = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    return m.groupBy("canonical").agg(F.count("*").alias("n"), F.min_by("id", "r").alias("winner"), F.array_sort(F.collect_list(F.when(F.col("r") > 1, F.col("id")))).alias("losers"), *fills).filter("n > 1").drop("n")


# Exclusive ranges that a sample has to lie in to count.
SANE = {"loa": (2, 50), "beam": (0.5, 12), "draft": (0.1, 8), "displacement": (100, 50_000), "year": (1800, 2100)}


def derived_design_values(samples: DataFrame, texts: Sequence[str] = ("designer", "builder"), numbers: Sequence[str] = ("loa", "beam", "draft", "displacement")) -> DataFrame:
    """Per design: modal texts, the modal year where at most 30 % disagree, winsorised means of sane numbers."""
    ok = {c: F.when((F.col(c) > lo) & (F.col(c) < hi), F.col(c)) for c, (lo, hi) in SANE.items()}
    means = winsorised_means(samples.select("design", *[ok[c].alias(c) for c in numbers]), "design", numbers)
    out = means
    for c in texts:
        per = samples.filter(F.trim(F.coalesce(c, F.lit(""))) != "").groupBy("design", F.trim(c).alias("v")).agg(F.count("*").alias("n"))
        out = out.join(per.groupBy("design").agg(F.when(F.count("*") < 5, F.min_by("v", F.struct(-F.col("n"), "v"))).alias(c)), "design", "left")
    per = samples.withColumn("v", ok["year"]).filter("v IS NOT NULL").groupBy("design", "v").agg(F.count("*").alias("n"))
    year = per.groupBy("design").agg(F.when(F.max("n") >= 0.7 * F.sum("n"), F.min_by("v", F.struct(-F.col("n"), "v"))).alias("year"))
    return out.join(year, "design", "left")


def ambiguous_classes(samples: DataFrame, open_classes: Sequence[str], column: str, least: int = 3) -> DataFrame:
    """Open classes with at least so many different values after clean-up: these get none."""
    clean = F.initcap(F.trim(column))
    per = samples.filter(F.lower(F.trim("design")).isin(*[c.strip().lower() for c in open_classes])).groupBy("design").agg(F.countDistinct(clean).alias("n"))
    return per.filter(F.col("n") >= least)


def link_mentions(mentions: DataFrame, boats: DataFrame, least: float = 0.6) -> DataFrame:
    """news_id, boat_id: confident mentions, by exact sail and else by a name that one boat has."""
    from ..functions.text import normalize_sail

    m = mentions.filter(F.col("confidence") >= least)
    by_sail = m.filter(normalize_sail("sail") != "").join(boats.groupBy(normalize_sail("boat_sail").alias("_s")).agg(F.min("boat_id").alias("by_sail")), normalize_sail("sail") == F.col("_s")).groupBy("news_id", "mention_id").agg(F.min("by_sail").alias("by_sail"))
    names = boats.groupBy(normalize_name("boat_name").alias("_n")).agg(F.count("*").alias("c"), F.min("boat_id").alias("by_name")).filter("c = 1 AND _n <> ''")
    j = m.join(by_sail, ["news_id", "mention_id"], "left").join(names, normalize_name("name") == F.col("_n"), "left")
    return j.withColumn("boat_id", F.coalesce("by_sail", "by_name")).filter("boat_id IS NOT NULL").groupBy("news_id", "boat_id").agg(F.max("confidence").alias("confidence"))


def anatomy(values: DataFrame, models: DataFrame, scale: float = 1.0) -> DataFrame:
    """values: boat, grp, feature, value. What each measurement's distance from the class mean adds to the rating."""
    means = values.groupBy("grp", "feature").agg(F.avg("value").alias("class_mean"))
    x = values.join(means, ["grp", "feature"]).join(models.select("grp", "feature", "beta"), ["grp", "feature"])
    delta = F.col("value") - F.col("class_mean")
    return x.select("boat", "feature", F.round("value", 3).alias("value"), F.round("class_mean", 3).alias("class_mean"), F.round(delta, 3).alias("delta"), F.round(delta / scale * F.col("beta"), 5).alias("contrib"))


def coefficient_drift(before: DataFrame, after: DataFrame, target: str, features: Sequence[str], order: str, least: int = 20) -> DataFrame:
    """The change of standardised coefficients between two dates, above 0.001; nothing for fewer than least rows."""
    from .analytics import class_models

    fit = lambda df, name: class_models(df.withColumn("_all", F.lit("all")), "_all", target, features, order, least).filter(F.col("tier").isin("A", "B")).select("feature", F.col("std_beta").alias(name))
    return fit(before, "was").join(fit(after, "now"), "feature").withColumn("change", F.col("now") - F.col("was")).filter(F.abs("change") > 0.001)


def read_only_sql(spark: SparkSession, sql: str, show: int = 50) -> tuple[DataFrame, int]:
    """A SELECT or WITH over the session's views: the first rows, and how many there are."""
    if sql.lstrip().split(None, 1)[0].upper() not in ("SELECT", "WITH"):
        raise ValueError("only SELECT and WITH are allowed")
    df = spark.sql(sql)
    return df.limit(show), df.count()


def describe(df: DataFrame, name: str) -> DataFrame:
    """A row a column: its type, how many values it has, and how many rows there are."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"`{c}`").alias("filled")) for c, t in df.dtypes]))
    return counts.select(F.lit(name).alias("table"), F.col("_rows").alias("rows"), each.alias("c")).select("table", "rows", "c.*")


def sorted_by(df: DataFrame, choice: str, allowed: dict[str, Sequence[Column]], tie: str) -> DataFrame:
    """A sort that the caller names, among allowed ones; unknown names take the first."""
    return df.orderBy(*allowed.get(choice, next(iter(allowed.values()))), tie)
