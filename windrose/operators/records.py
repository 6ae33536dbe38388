"""Imports and record keeping: identities, listings in two passes, seeds, lookups, duplicate tiers, merges table by table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hull_number, is_secondary, normalize_name
from .matching import KEY, NEAR, contains_pairs, counted, first_of, rated
from .relational import pick_per_key
from .resolve import merge_rows
from .sinks import with_ids

upper_name = lambda c: F.upper(F.trim(c))


def certificate_identities(known: DataFrame, certs: DataFrame) -> DataFrame:
    """New identities from certificates: one a boat, name and sail, as first seen, unless the boat already has the sail
    from a certificate. known: boat_id, sail, source. certs: boat_id, name, sail, owner, country, day."""
    have = known.filter("source = 'certificate'").select("boat_id", "sail").distinct()
    fresh = certs.filter("boat_id IS NOT NULL").join(have, ["boat_id", "sail"], "left_anti")
    first = fresh.groupBy("boat_id", "name", "sail").agg(F.min(F.struct("day", "owner", "country")).alias("f"))
    return first.select("boat_id", "name", "sail", "f.owner", "f.country", F.lit("certificate").alias("source"), "f.day")


def listing_identities(known: DataFrame, boats: DataFrame, ratings: DataFrame) -> DataFrame:
    """New identities from the boats themselves, seen on the day of their last rating, for boats that have none yet."""
    have = known.filter("source = 'listing'").select("boat_id").distinct()
    last = ratings.groupBy("boat_id").agg(F.max("day").alias("day"))
    return boats.join(have, "boat_id", "left_anti").join(last, "boat_id", "left").select("boat_id", F.col("boat_name").alias("name"), F.col("boat_sail").alias("sail"), "country", F.lit("listing").alias("source"), "day")


def import_listing(boats: DataFrame, ratings: DataFrame, listing: DataFrame, day: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A listing (name, sail, rating, flag) of one day, in two passes: primary rows add boats and set the day's ratings;
    secondary rows then only mark the day's rating of the boat of the same sail and name. Boats, ratings with the column
    secondary, and the secondary rows that found no boat. Of several rows for a boat the one with the highest rating
    counts."""
    clean = listing.withColumn("_second", is_secondary("name", "flag")).withColumn("name", normalize_name("name"))
    primary, second = clean.filter("NOT _second"), clean.filter("_second")
    primary = pick_per_key(primary, ["sail", "name"], [F.desc_nulls_last("rating")])
    named = boats.withColumn("_n", normalize_name("boat_name"))
    new = primary.join(named.select(F.col("boat_sail").alias("sail"), F.col("_n").alias("name")), ["sail", "name"], "left_anti")
    new = new.select(F.lit(None).cast(boats.schema["boat_id"].dataType).alias("boat_id"), F.col("name").alias("boat_name"), F.col("sail").alias("boat_sail"))
    last = boats.agg(F.coalesce(F.max("boat_id"), F.lit(0))).first()[0]
    all_boats = boats.select("boat_id", "boat_name", "boat_sail").unionByName(with_ids(new, "boat_id", last, ["boat_sail", "boat_name"]))
    ids = all_boats.groupBy(F.col("boat_sail").alias("sail"), normalize_name("boat_name").alias("name")).agg(F.min("boat_id").alias("boat_id"))
    at = F.lit(day).cast("date")
    now = primary.join(ids, ["sail", "name"]).groupBy("boat_id").agg(F.max("rating").alias("rating")).withColumn("day", at)
    marks = second.join(ids, ["sail", "name"]).groupBy("boat_id").agg(F.max(F.coalesce(F.nullif(F.trim("flag"), F.lit("")), F.lit("SEC"))).alias("_flag"))
    others = ratings.filter(F.col("day") != at).unionByName(ratings.filter(F.col("day") == at).join(now.select("boat_id"), "boat_id", "left_anti"))
    out = others.select("boat_id", "day", "rating", "secondary").unionByName(now.select("boat_id", "day", "rating", F.lit(None).cast("string").alias("secondary")))
    out = out.join(marks, "boat_id", "left").withColumn("secondary", F.when(F.col("day") == at, F.coalesce("_flag", "secondary")).otherwise(F.col("secondary"))).drop("_flag")
    return all_boats, out, second.join(ids, ["sail", "name"], "left_anti").select("sail", "name")


def fill_empty(classes: DataFrame, seeds: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns that are null or blank from the seeds (one row a key); others stay."""
    s = seeds.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return classes.join(s, key, "left").select(*[F.when(blank(c) & ~blank(f"_{c}"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in classes.columns])


def boats_by_name(wanted: DataFrame, boats: DataFrame, ratings: DataFrame) -> DataFrame:
    """result_id and boat_id of wanted (result_id, name, rating): the only boat of the name, else the one of a near rating
    that was rated last."""
    side = lambda df, c: df.withColumn("_k", normalize_name(c)).filter("_k <> ''")
    same = counted(side(wanted, "name").select(KEY, "_k").join(boats.select("boat_id", upper_name("boat_name").alias("_k")), "_k"))
    near = first_of(rated(same.filter("n > 1").select(KEY, "boat_id"), wanted, ratings, NEAR), -F.unix_date(F.col("day").cast("date")))
    return same.filter("n = 1").select(KEY, "boat_id").unionByName(near)


def boats_by_sail(wanted: DataFrame, boats: DataFrame) -> DataFrame:
    """result_id and the first boat of exactly the sail."""
    return first_of(wanted.select(KEY, "sail").join(boats.select("boat_id", F.col("boat_sail").alias("sail")), "sail"))


def classes_of(wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """design and the first class (id) of its name, case aside, or with an alias that holds it. classes: id, name,
    aliases."""
    names = classes.select("id", F.lower("name").alias("_n"))
    w = wanted.select("design").distinct()
    equal = w.join(names, F.lower("design") == F.col("_n")).select("design", "id")
    aliases = classes.select("id", F.explode("aliases").alias("t"))
    held = contains_pairs(w.withColumnRenamed("design", "p"), aliases).join(aliases, "t").select(F.col("p").alias("design"), "id")
    return equal.unionByName(held).groupBy("design").agg(F.min("id").alias("id"))


def duplicate_tiers(boats: DataFrame) -> DataFrame:
    """tier, k1, k2 and ids of likely duplicates, from the surest tier to the widest. boats: boat_id, boat_name, boat_sail,
    design, year, country. A cluster's ids are its result, one row."""
    b = boats.filter(F.col("boat_sail") > "").withColumn("bn", upper_name("boat_name")).withColumn("hull", hull_number("boat_sail"))
    second = F.coalesce(F.lower("boat_name").rlike(r"- sec$|\(sh\)$"), F.lit(False))
    plain = F.upper(F.trim(F.regexp_replace(F.regexp_replace("boat_name", r"(?i)\s*-\s*SEC\s*$", ""), r"(?i)\s*\(\s*SH\s*\)\s*$", "")))
    b = b.withColumn("second", second).withColumn("plain", plain)

    def tier(name: str, keys: Sequence[str], k1: str, k2: Column, where: Column | None = None, keep: Column | None = None) -> DataFrame:
        g = (b.filter(where) if where is not None else b).groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("boat_id")).alias("ids"), F.bool_or("second").alias("any_second"))
        g = g.filter((F.col("n") > 1) & (keep if keep is not None else F.lit(True)))
        return g.select(F.lit(name).alias("tier"), F.col(k1).alias("k1"), k2.cast("string").alias("k2"), "ids")

    hull = F.col("hull") != ""
    twin = b.filter(F.lower("boat_name").endswith(" - sec")).select(F.col("boat_id").alias("sec"), "boat_sail", F.upper(F.trim(F.regexp_replace("boat_name", r"(?i)\s*-\s*SEC\s*$", ""))).alias("bn"))
    pairs = twin.join(b.filter(~F.coalesce(F.lower("boat_name").endswith(" - sec"), F.lit(False))).select("boat_sail", "bn", "boat_id"), ["boat_sail", "bn"])
    one = pairs.groupBy("sec", "boat_sail", "bn").agg(F.count("*").alias("n"), F.min("boat_id").alias("first")).filter("n = 1")
    out = tier("S", ["boat_sail", "design", "year"], "boat_sail", F.col("design"), F.col("design").isNotNull() & F.col("year").isNotNull())
    out = out.unionByName(one.select(F.lit("S'").alias("tier"), F.col("boat_sail").alias("k1"), F.col("bn").alias("k2"), F.array("first", "sec").alias("ids")))
    out = out.unionByName(tier("S''", ["boat_sail", "plain"], "boat_sail", F.col("plain"), keep=F.col("any_second")))
    has = F.col("design").isNotNull()
    out = out.unionByName(tier("T", ["bn", "design", "country", "hull"], "bn", F.col("country"), has & hull & F.col("country").isNotNull() & (F.col("country") != "")))
    out = out.unionByName(tier("T'", ["bn", "design", "hull"], "bn", F.col("design"), has & hull))
    out = out.unionByName(tier("U", ["bn", "country", "hull"], "bn", F.coalesce("country", F.lit("")), hull))
    return out.unionByName(tier("U'", ["bn", "hull"], "bn", F.col("hull"), hull))


def merge_tables(tables: dict[str, DataFrame], losers: DataFrame, rules: dict[str, tuple[str, Sequence[str], Sequence[Column]]]) -> dict[str, DataFrame]:
    """Every table with losing ids replaced. rules: table -> (id column, columns that must not repeat within an id, order
    by which one of the rows that then agree stays)."""
    return {name: merge_rows(df, losers, *rules[name]) if name in rules else df for name, df in tables.items()}
