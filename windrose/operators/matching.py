"""Matching results to boats by ordered rules. Every rule is a table of candidates for all results at once; a rule counts
only where its own condition leaves one boat, and the first rule that does decides.

results: result_id, source, name, sail, hull, owner, design, rating. boats: boat_id, boat_name, boat_sail, boat_design.
ratings: boat_id, rating, day of all snapshots. certificates: boat_id, cert_name, cert_sail, cert_class of linked ones.
identities: boat_id, name, sail as observed over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_name, normalize_sail, sail_candidates
from .resolve import cascade, similar_pairs, token_candidates

# How far ratings may differ, and how similar names must be.
NEAR, FUZZY_NEAR, DESIGN_NEAR, OWNER_NEAR = 0.005, 0.01, 0.003, 0.01
SIMILAR_WITH_RATING, SIMILAR_ALONE = 0.7, 0.85
KEY = "result_id"


def only_boats(candidates: DataFrame, *by: str) -> DataFrame:
    """by and boat_id, where all rows of by name the same boat."""
    return candidates.groupBy(*by).agg(F.min("boat_id").alias("boat_id"), F.max("boat_id").alias("_last")).filter("boat_id = _last").drop("_last")


def one_of(candidates: DataFrame, *by: str) -> DataFrame:
    """The result's (and by's) boat where candidates name just one."""
    return only_boats(candidates, KEY, *by)


def counted(candidates: DataFrame) -> DataFrame:
    """Distinct candidates with n, how many the result has."""
    c = candidates.select(KEY, "boat_id").distinct()
    return c.join(c.groupBy(KEY).agg(F.count("*").alias("n")), KEY)


def first_of(candidates: DataFrame, *order: Column) -> DataFrame:
    """The candidate that comes first by order, then by boat."""
    return candidates.groupBy(KEY).agg(F.min_by("boat_id", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "boat_id")).alias("boat_id"))


def longer_than(column: str, n: int) -> Column:
    return F.length(F.trim(F.coalesce(F.col(column), F.lit("")))) > n


def rated(candidates: DataFrame, results: DataFrame, ratings: DataFrame, near: float) -> DataFrame:
    """candidates with off and day of every snapshot whose rating is near the result's."""
    c = candidates.join(results.select(KEY, F.col("rating").alias("_rating")).filter("_rating IS NOT NULL"), KEY)
    off = F.abs(F.col("rating") - F.col("_rating"))
    return c.join(ratings.select("boat_id", "rating", "day"), "boat_id").withColumn("off", off).filter(F.col("off") < near)


def near_ratings(asked: DataFrame, had: DataFrame, by: Sequence[str], near: float) -> DataFrame:
    """Rows of asked (by, _rating) and had (by, rating) that are near each other, with off; joined on bands twice as wide."""
    band = lambda c: F.rint(F.col(c) / (2 * near))
    x = asked.withColumn("_band", F.explode(F.array(*[band("_rating") + i for i in (-1.0, 0.0, 1.0)])))
    off = F.abs(F.col("rating") - F.col("_rating"))
    return x.join(had.withColumn("_band", band("rating")), [*by, "_band"]).withColumn("off", off).filter(F.col("off") < near).drop("_band")


def sail_rules(results: DataFrame, boats: DataFrame, ratings: DataFrame | None, names: Sequence[str]) -> list[tuple[str, DataFrame]]:
    """One boat by shared tokens; of several the one of the same name; then, where ratings are given, one of a near rating."""
    r = results.filter(longer_than("sail", 2))
    shared = counted(token_candidates(r, boats))
    several = shared.filter("n > 1").join(r.select(KEY, "name", "rating"), KEY).filter(longer_than("name", 0)).join(boats.select("boat_id", "boat_name"), "boat_id")
    rules = [(names[0], shared.filter("n = 1")), (names[1], first_of(several.filter(normalize_name("name") == normalize_name("boat_name"))))]
    if ratings is not None:
        rules.append((names[2], first_of(rated(several.select(KEY, "boat_id"), results, ratings, NEAR))))
    return rules


def name_rules(results: DataFrame, boats: DataFrame, ratings: DataFrame, names: Sequence[str]) -> list[tuple[str, DataFrame]]:
    """One boat of the same name; of several the last one of a near rating; then names that are similar. Boats are reduced to the
    first of a name and rating, results to their different ones, before they meet, so results and boats never meet one by one."""
    k = lambda df, c: df.withColumn("_k", normalize_name(c)).filter("_k <> ''")
    r = k(results, "name").select(KEY, "_k", "rating", F.length("name").alias("_long"))
    fleet = k(boats, "boat_name").select("boat_id", "_k").distinct()
    sizes = fleet.groupBy("_k").agg(F.count("*").alias("n"), F.min("boat_id").alias("boat_id"))
    late = (-F.unix_date(F.col("day").cast("date"))).alias("late")
    had = fleet.join(ratings.select("boat_id", "rating", late), "boat_id").groupBy("_k", "rating").agg(F.min(F.struct("late", "boat_id")).alias("_b"), F.min("boat_id").alias("_first"))
    asked = r.filter("rating IS NOT NULL").select("_k", F.col("rating").alias("_rating")).distinct()
    several = had.join(sizes.filter("n > 1").select("_k"), "_k").select("_k", "rating", "_b.*")
    last = near_ratings(asked, several, ["_k"], NEAR).groupBy("_k", "_rating").agg(F.min(F.struct("late", "boat_id")).alias("_b"))
    long = r.filter("_long >= 4")
    pairs = similar_pairs(long.select(F.col("_k").alias("x")).distinct(), sizes.select(F.col("_k").alias("y")), "x", "y", SIMILAR_WITH_RATING)
    pairs = pairs.filter(F.col("similarity") > SIMILAR_WITH_RATING).select(F.col("x"), F.col("y").alias("_k"), (-F.col("similarity")).alias("unlike"))
    best = F.min(F.struct("unlike", "boat_id")).alias("_b")
    alike = pairs.join(had.select("_k", "rating", F.col("_first").alias("boat_id")), "_k").groupBy(F.col("x").alias("_k"), "rating").agg(best)
    alike = near_ratings(asked, alike.select("_k", "rating", "_b.*"), ["_k"], FUZZY_NEAR).groupBy("_k", "_rating").agg(best)
    alone = pairs.filter(F.col("unlike") < -SIMILAR_ALONE).join(sizes, "_k").groupBy(F.col("x").alias("_k"), F.lit(None).cast("double").alias("_rating")).agg(best)
    found = lambda df, near: df.join(near.select("_k", F.col("_rating"), "_b.boat_id"), "_k").filter(F.col("rating").eqNullSafe(F.col("_rating")))
    return [(names[0], r.join(sizes.filter("n = 1"), "_k")), (names[1], found(r, last)), (names[2], found(long, alike.union(alone)))]


def contains_pairs(patterns: DataFrame, texts: DataFrame, p: str = "p", t: str = "t") -> DataFrame:
    """Distinct pairs of a pattern of three letters and more and a text that holds it, case aside: joined on the
    pattern's first three letters among all of the text's."""
    a = patterns.select(p).distinct().filter(F.length(p) >= 3)
    b = texts.select(t).distinct().filter(F.length(t) >= 3)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(F.lower(F.col(t)), i, F.lit(3))))
    return a.withColumn("_g", F.substring(F.lower(p), 1, 3)).join(b.withColumn("_g", F.explode(grams)), "_g").filter(F.lower(t).contains(F.lower(p))).select(p, t)


def certificate_rules(results: DataFrame, certificates: DataFrame, names: Sequence[str], design_name: str | None = None) -> list[tuple[str, DataFrame]]:
    """One boat whose certificates have the name, and the design too where the result has one and design_name is given;
    then by sail, the first form of it that leaves one boat."""
    certs = certificates.filter("boat_id IS NOT NULL")
    by_name = results.filter(longer_than("name", 2)).select(KEY, "design", normalize_name("name").alias("_k"))
    found = by_name.join(certs.select("boat_id", "cert_class", F.upper(F.trim("cert_name")).alias("_k")), "_k")
    rules = []
    if design_name:
        has = longer_than("design", 2)
        fits = F.lower("cert_class").contains(F.lower(F.trim("design")))
        rules.append((design_name, one_of(found.filter(has & fits))))
        found = found.filter(~has)
    rules.append((names[0], one_of(found)))
    forms = results.filter(longer_than("sail", 2)).select(KEY, F.posexplode(sail_candidates("sail")).alias("pos", "_s"))
    forms = forms if design_name else forms.filter("pos = 0")
    known = certs.select("boat_id", F.upper(F.regexp_replace("cert_sail", "[ -]", "")).alias("_s"))
    rules.append((names[1], first_of(one_of(forms.join(known, "_s"), "pos"), F.col("pos"))))
    return rules


def design_rule(results: DataFrame, boats: DataFrame, ratings: DataFrame) -> DataFrame:
    """A boat of the design with the nearest rating, the last of equally near ones. Boats are reduced to the first of a design
    and rating, results to their different ratings, before they meet, so a result never meets the boats of its design one by one."""
    r = results.filter(longer_than("design", 2)).filter("rating IS NOT NULL").select(KEY, F.trim("design").alias("p"), "rating")
    b = boats.filter("boat_design IS NOT NULL").select("boat_id", F.col("boat_design").alias("t"))
    best = lambda *order: F.min(F.struct(*order, "late", "boat_id")).alias("_b")
    late = (-F.unix_date(F.col("day").cast("date"))).alias("late")
    had = b.join(ratings.select("boat_id", "rating", late), "boat_id").groupBy("t", "rating").agg(best()).select("t", "rating", "_b.*")
    had = contains_pairs(r, b).join(had, "t").groupBy("p", "rating").agg(best()).select("p", "rating", "_b.*")
    asked = r.select("p", F.col("rating").alias("_rating")).distinct()
    near = near_ratings(asked, had, ["p"], DESIGN_NEAR).groupBy("p", "_rating").agg(best("off")).select("p", F.col("_rating").alias("rating"), "_b.*")
    return r.join(near, ["p", "rating"]).select(KEY, "boat_id")


def identity_rules(results: DataFrame, identities: DataFrame, names: Sequence[str], all_forms: bool) -> list[tuple[str, DataFrame]]:
    """One boat that ever had the name, then the sail."""
    known = identities.filter("boat_id IS NOT NULL")
    by_name = results.select(KEY, normalize_name("name").alias("_k")).filter("_k <> ''").join(known.select("boat_id", normalize_name("name").alias("_k")), "_k")
    forms = results.filter(longer_than("sail", 2)).select(KEY, F.posexplode(sail_candidates("sail")).alias("pos", "_s"))
    forms = forms if all_forms else forms.filter("pos = 0")
    by_sail = one_of(forms.join(known.select("boat_id", normalize_sail("sail").alias("_s")), "_s"), "pos")
    return [(names[0], one_of(by_name)), (names[1], first_of(by_sail, F.col("pos")))]


def match_club(results: DataFrame, boats: DataFrame, ratings: DataFrame, certificates: DataFrame, identities: DataFrame) -> DataFrame:
    """Club results, which carry sail, hull, name and design: boat_id and method."""
    hull = counted(token_candidates(results.filter(longer_than("hull", 2)), boats, "hull"))
    rules = sail_rules(results, boats, None, ("sail", "sail_name"))
    rules += [("hull", hull.filter("n = 1"))]
    rules += name_rules(results, boats, ratings, ("name", "name_rating", "name_fuzzy"))
    rules += certificate_rules(results, certificates, ("certificate_name", "certificate_sail"), "certificate_design")
    rules += [("design_rating", design_rule(results, boats, ratings))]
    rules += identity_rules(results, identities, ("identity_name", "identity_sail"), True)
    return cascade(results, rules)


def match_any(results: DataFrame, boats: DataFrame, ratings: DataFrame, certificates: DataFrame, identities: DataFrame) -> DataFrame:
    """Results of any source that have a name or a sail."""
    r = results.filter(longer_than("name", 0) | longer_than("sail", 0))
    rules = sail_rules(r, boats, ratings, ("sail", "sail_name", "sail_rating"))
    rules += name_rules(r, boats, ratings, ("name", "name_rating", "name_fuzzy"))
    rules += certificate_rules(r, certificates, ("certificate_name", "certificate_sail"))
    rules += identity_rules(r, identities, ("identity_name", "identity_sail"), False)
    return cascade(results, rules)


def match_owner(results: DataFrame, owners: DataFrame, ratings: DataFrame) -> DataFrame:
    """Results that carry an owner. owners: owner, boat_id. An owner of one boat; of several the one of a near rating;
    then the only boat that ever had the very rating. Owners and ratings are reduced to their first and last boat before
    results meet them, so a result never meets the boats of its owner one by one."""
    key = lambda c: F.upper(F.trim(c))
    r = results.select(KEY, key("owner").alias("_o"), "rating")
    owned = owners.filter("boat_id IS NOT NULL").select("boat_id", key("owner").alias("_o")).filter("_o <> ''")
    fleets = only_boats(owned, "_o")
    had = owned.join(ratings.select("boat_id", "rating"), "boat_id").groupBy("_o", "rating").agg(F.min("boat_id").alias("_first"), F.max("boat_id").alias("_last"))
    asked = r.filter("rating IS NOT NULL").select("_o", F.col("rating").alias("_rating")).distinct()
    pairs = near_ratings(asked, had, ["_o"], OWNER_NEAR).groupBy("_o", "_rating").agg(F.min("_first").alias("boat_id"), F.max("_last").alias("_last"))
    near = pairs.filter("boat_id = _last").select("_o", F.col("_rating").alias("rating"), "boat_id")
    exact = only_boats(ratings, "rating")
    return cascade(results, [("owner", r.join(fleets, "_o")), ("owner_rating", r.join(near, ["_o", "rating"])), ("rating", r.join(exact, "rating"))])


def apply_matches(results: DataFrame, matches: DataFrame, taken: Sequence[str]) -> DataFrame:
    """results with boat_id filled where it was null, unless another result of the boat has the same key (taken); of new
    ones for one key the first by result_id counts."""
    new = results.filter("boat_id IS NULL").join(matches.filter("boat_id IS NOT NULL").select(KEY, F.col("boat_id").alias("_new")).distinct(), KEY)
    w = Window.partitionBy("_new", *taken).orderBy(KEY)
    first = new.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    held = results.filter("boat_id IS NOT NULL").select(F.col("boat_id").alias("_b"), *[F.col(c).alias(f"_{c}") for c in taken]).distinct()
    same = F.col("_new") == F.col("_b")
    for c in taken:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    ok = first.join(held, same, "left_anti").select(KEY, "_new")
    return results.join(ok, KEY, "left").withColumn("boat_id", F.coalesce("boat_id", "_new")).drop("_new")


def rematch(results: DataFrame, boats: DataFrame, ratings: DataFrame, certificates: DataFrame, identities: DataFrame, owners: DataFrame, taken: Sequence[str], club: str, owned: str) -> DataFrame:
    """One cycle over the results that have no boat yet: by their source's rules, then by those for any source."""
    open_ = results.filter("boat_id IS NULL").drop("boat_id")
    own = match_club(open_.filter(F.col("source") == club), boats, ratings, certificates, identities).select(KEY, "boat_id")
    own = own.unionByName(match_owner(open_.filter(F.col("source") == owned), owners, ratings).select(KEY, "boat_id"))
    after = apply_matches(results, own, taken)
    rest = match_any(after.filter("boat_id IS NULL").drop("boat_id"), boats, ratings, certificates, identities)
    return apply_matches(after, rest.select(KEY, "boat_id"), taken)


def due(results: DataFrame, seen: str, as_of: str, days: int) -> DataFrame:
    """Results without a boat that a cycle looks at again: those of the last days."""
    return results.filter(F.col("boat_id").isNull() & (F.col(seen) > F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))) & (F.col(seen) <= F.lit(as_of).cast("timestamp")))
