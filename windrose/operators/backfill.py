"""Filling what boats lack from their certificates and results, typed class statistics, result upserts and run logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import latest_per_key, pick_per_key

# Clubs whose results make a boat one of a country, and sources that do so for boats without those.
CLUBS = {"AUS": ("CYCA", "RPAYC", "RSYS", "MHYC")}
SOURCES = {"GBR": ("rorc",)}
# Endings of the names of secondary certificates.
SECOND = ("- SEC", "(SH)")


def designs_from_certificates(boats: DataFrame, certificates: DataFrame, aliases: DataFrame) -> DataFrame:
    """boats (boat_id, design) with an empty design filled from the class of the last certificate (boat_id, class_name, day; of one day the
    larger name): its name in the alias table (alias, name; canonical names are aliases of themselves), else the class as it stands,
    in capitalised words if it is all capitals. how: 'lookup', 'direct', or null for boats that weren't filled."""
    c = certificates.filter("boat_id IS NOT NULL AND class_name <> ''").select("boat_id", "class_name", "day")
    last = latest_per_key(c, "boat_id", ["day", "class_name"]).select("boat_id", F.trim("class_name").alias("_c"))
    known = aliases.select(F.upper(F.trim("alias")).alias("_u"), "name").union(aliases.select(F.upper(F.trim("name")), "name")).groupBy("_u").agg(F.min("name").alias("_n"))
    rows = boats.join(last, "boat_id", "left").withColumn("_u", F.when(F.col("design").isNull(), F.upper("_c"))).join(known, "_u", "left")
    plain = F.when((F.col("_c") == F.upper("_c")) & (F.col("_c") != F.lower("_c")), F.initcap("_c")).otherwise(F.col("_c"))
    how = F.when(F.col("_n").isNotNull(), "lookup").when(F.col("_u").isNotNull(), "direct")
    design = F.coalesce("design", F.when(F.col("_u").isNotNull(), F.coalesce("_n", plain)))
    return rows.select(*[design.alias(x) if x == "design" else F.col(x) for x in boats.columns], how.alias("how"))


def second_certificates(boats: DataFrame) -> DataFrame:
    """design, n, matched, unmatched: boats that are another certificate of a boat, by their name's ending; matched where a boat has the
    name without it and the same sail. Boats without a design count as UNKNOWN."""
    name = F.trim("boat_name")
    plain = F.when(name.endswith(SECOND[0]), F.trim(F.substring(name, F.lit(1), F.length(name) - len(SECOND[0])))).when(name.endswith(SECOND[1]), F.trim(F.substring(name, F.lit(1), F.length(name) - len(SECOND[1]))))
    second = boats.select(F.coalesce("design", F.lit("UNKNOWN")).alias("design"), F.col("boat_sail").alias("_s"), plain.alias("_p")).filter("_p IS NOT NULL")
    first = boats.select(F.col("boat_sail").alias("_s"), F.col("boat_name").alias("_p")).distinct().withColumn("_m", F.lit(1))
    both = second.join(first, ["_s", "_p"], "left")
    return both.groupBy("design").agg(F.count("*").alias("n"), F.count("_m").alias("matched"), F.count_if(F.col("_m").isNull()).alias("unmatched"))


def countries_from_results(boats: DataFrame, results: DataFrame, clubs: Mapping[str, Sequence[str]] = CLUBS, sources: Mapping[str, Sequence[str]] = SOURCES) -> DataFrame:
    """boats (boat_id, country) with an empty country filled from results (boat_id, organizing_club, source): that of a club they sailed with,
    else that of a source. Of several the first in the order given."""
    one = lambda column, table: [F.max(F.when(F.col(column).isin(*names), F.lit(country))).alias(f"_{column}{i}") for i, (country, names) in enumerate(table.items())]
    seen = results.filter("boat_id IS NOT NULL").groupBy("boat_id").agg(*one("organizing_club", clubs), *one("source", sources))
    found = [F.col(f"_organizing_club{i}") for i in range(len(clubs))] + [F.col(f"_source{i}") for i in range(len(sources))]
    return boats.join(seen, "boat_id", "left").select(*[F.coalesce("country", *found).alias(c) if c == "country" else F.col(c) for c in boats.columns])


# Digits before and behind the point of the stored statistics.
RATING, LENGTH, CREW = "decimal(8,5)", "decimal(8,3)", "decimal(6,2)"


def class_statistics(boats: DataFrame, design: str, ratings: Mapping[str, str], certificate: str, least: int = 2) -> DataFrame:
    """design, n_boats, n_with_certs, and mean, std, min and max of each rating, rounded half up to its stored type, of designs with at least so
    many boats. ratings: column -> type. The spread of one known value is null."""
    sums = [x for c, kind in ratings.items() for x in (F.avg(c).cast(kind).alias(f"mean_{c}"), F.stddev(c).cast(kind).alias(f"std_{c}"), F.min(c).cast(kind).alias(f"min_{c}"), F.max(c).cast(kind).alias(f"max_{c}"))]
    rows = boats.filter(F.col(design).isNotNull()).groupBy(design)
    return rows.agg(F.count("*").alias("n_boats"), F.count(certificate).alias("n_with_certs"), *sums).filter(F.col("n_boats") >= least)


def upsert_results(old: DataFrame, new: DataFrame, transport: str = "legacy") -> DataFrame:
    """old with the results of new: event_name, race_name, event_date, boat_id, boat_name and more. A result with a boat has the place of one of the same
    boat, event, race and day; one without a boat that of one without a boat and of the same name there. Nulls in event, race or day are equal. Of
    several new ones for a place the last by batch counts. A missing transport is the one given. created_at stays as it was."""
    unmatched = F.when(F.col("boat_id").isNull(), F.coalesce("boat_name", F.lit("")))
    key = ["boat_id", "_name", "event_name", "race_name", "event_date"]
    n = new.withColumn("transport", F.coalesce("transport", F.lit(transport)))
    tagged = old.withColumns({"_new": F.lit(0), "batch": F.lit(0).cast("long"), "_name": unmatched}).unionByName(n.withColumns({"_new": F.lit(1), "_name": unmatched}))
    first = F.min(F.when(F.col("_new") == 0, F.col("created_at"))).alias("_created")
    places = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    was = tagged.groupBy(*places).agg(first).filter("_created IS NOT NULL")
    best = pick_per_key(tagged, key, [F.desc("_new"), F.desc("batch")])
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return best.join(was, same, "left").withColumn("created_at", F.coalesce("_created", "created_at")).select(*old.columns)


def orphans_report(certificates: DataFrame, events: DataFrame, as_of: str, country: str = "country", days: int = 7, countries: int = 20, reasons: int = 10) -> tuple[DataFrame, DataFrame]:
    """(country, orphans) of certificates without a boat, the worst countries; (reason, n) of failed matches (source, event_type, status,
    reason, created_at) in the days up to as_of, the most common ones. Ties by name."""
    by_country = certificates.filter("boat_id IS NULL").groupBy(country).agg(F.count("*").alias("orphans")).orderBy(F.desc("orphans"), country).limit(countries)
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = events.filter((F.col("event_type") == "match") & (F.col("status") == "orphan") & (F.col("created_at") > now - F.make_dt_interval(F.lit(days))) & (F.col("created_at") <= now))
    return by_country, recent.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(reasons)


def detail_coverage(certificates: DataFrame, country: str, detail: str) -> DataFrame:
    """country, total, with_detail, missing_detail."""
    known = F.col(detail).isNotNull()
    return certificates.groupBy(country).agg(F.count("*").alias("total"), F.count_if(known).alias("with_detail"), F.count_if(~known).alias("missing_detail"))


def run_log(events: DataFrame) -> DataFrame:
    """One row a run from its appended start and end entries (run, kind, at, source, status, records_found, records_new, records_updated, error): a log
    that is only ever appended to. A run without an end is running; of several ends the last counts; an end without a start has no
    started_at."""
    start, end = F.col("kind") == "start", F.col("kind") == "end"
    last: Column = F.max_by(F.struct("at", "status", "records_found", "records_new", "records_updated", "error"), F.when(end, F.col("at")))
    rows = events.groupBy("run").agg(F.min(F.when(start, F.col("at"))).alias("started_at"), F.min("source").alias("source"), last.alias("_e"), F.max(end).alias("_ended"))
    state = F.when(F.col("_ended"), F.coalesce("_e.status", F.lit("completed"))).otherwise("running")
    own = {c: F.when(F.col("_ended"), F.col(f"_e.{c}")).alias(c) for c in ("records_found", "records_new", "records_updated", "error")}
    return rows.select("run", "source", "started_at", F.when(F.col("_ended"), F.col("_e.at")).alias("completed_at"), state.alias("status"), *own.values())
