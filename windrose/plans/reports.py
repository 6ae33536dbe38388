"""Queries on record keeping and facts. Views are written once, in expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, quality, records
from .base import ORDERS, orders, query, r6, t
from .matching import VIEWS as MATCHING
from .matching import WITH as MATCHING_WITH

VIEWS = {
    "boats": ("customer", """c_custkey AS boat_id, CASE c_custkey % 6 WHEN 0 THEN 'Boat ' || CAST(c_custkey % 90 AS STRING) || ' - SEC' WHEN 1 THEN 'boat ' || CAST(c_custkey % 90 AS STRING) || ' (SH)' WHEN 2 THEN ' BOAT ' || CAST(c_custkey % 90 AS STRING) ELSE 'BOAT ' || CAST(c_custkey % 90 AS STRING) END AS boat_name,
CASE c_custkey % 5 WHEN 0 THEN 'GBR' || CAST(c_custkey % 45 AS STRING) WHEN 1 THEN CAST(c_custkey % 45 AS STRING) WHEN 2 THEN '' ELSE 'X' || CAST(c_custkey % 45 AS STRING) END AS boat_sail,
CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS design, CASE WHEN c_custkey % 3 > 0 THEN CAST(1990 + c_custkey % 2 AS INT) END AS "year", CASE WHEN c_custkey % 7 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'GBR' ELSE '' END END AS country"""),
    "known": ("supplier", "s_suppkey AS boat_id, CASE WHEN s_suppkey % 2 = 0 THEN 'certificate' ELSE 'listing' END AS source, 'S' || CAST(s_suppkey % 7 AS STRING) AS sail"),
    "certs": ("customer", "CASE WHEN c_custkey % 9 > 0 THEN c_custkey % 20 END AS boat_id, 'N' || CAST(c_custkey % 3 AS STRING) AS name, CASE WHEN c_custkey % 4 > 0 THEN 'S' || CAST(c_custkey % 11 AS STRING) END AS sail, c_name AS owner, c_mktsegment AS country, c_custkey AS day"),
    "classes": ("part", "p_partkey AS id, p_brand || CAST(p_partkey % 30 AS STRING) AS name, p_name AS alias, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE p_type END AS builder"),
    "deltas": ("part", "p_partkey AS boat, CASE WHEN p_partkey % 11 > 0 THEN CAST(p_size % 13 - 6 AS DOUBLE) / 1000 END AS delta, p_partkey % 3 > 0 AS stable, CASE WHEN p_partkey % 5 > 0 THEN 'C' || CAST(p_partkey % 4 AS STRING) END AS country"),
    "profiles": ("part", "p_partkey AS boat, CASE WHEN p_partkey % 19 > 0 THEN p_brand END AS design, CASE WHEN p_partkey % 13 > 0 THEN CAST(900 + p_size AS DOUBLE) / 1000 END AS rating, CASE WHEN p_brand > 'Brand#3' THEN CAST(p_size AS DOUBLE) END AS loa, CAST(p_size + 1 AS DOUBLE) AS lh, CASE WHEN p_partkey % 3 > 0 THEN 'C' || CAST(p_partkey % 4 AS STRING) ELSE '' END AS country"),
    "places": ("lineitem", "l_partkey AS boat, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS place, 7 AS fleet"),
    "gphs": ("lineitem", "l_partkey AS boat, CASE WHEN l_suppkey % 3 > 0 THEN l_quantity END AS gph, l_orderkey % 4 AS day"),
}
LISTED = ", ".join(f"{name} AS (SELECT {what} FROM {of})" for name, (of, what) in VIEWS.items())
WITH = f"WITH {LISTED}"


def view(spark, d, name, of=VIEWS):
    table, what = of[name]
    return spark.sql(f"SELECT {what} FROM {{src}}".replace('"year"', "`year`"), src=t(spark, d, table))


@query(f"""{WITH}, f AS (SELECT * FROM certs c WHERE boat_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known k WHERE k.source = 'certificate' AND k.boat_id = c.boat_id AND k.sail = c.sail))
SELECT boat_id, name, sail, arg_min(owner, day) AS owner, arg_min(country, day) AS country, 'certificate' AS source, min(day) AS day FROM f GROUP BY 1, 2, 3""")
def identities_from_certificates(spark, d):
    return records.certificate_identities(view(spark, d, "known"), view(spark, d, "certs"))


@query(f"""{WITH}, l AS (SELECT o_custkey AS boat_id, max(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY 1) SELECT boat_id, boat_name AS name, boat_sail AS sail, country, 'listing' AS source, day FROM boats LEFT JOIN l USING (boat_id) WHERE boat_id NOT IN (SELECT boat_id FROM known WHERE source = 'listing')""")
def identities_from_listing(spark, d):
    return records.listing_identities(view(spark, d, "known"), view(spark, d, "boats"), orders(spark, d).withColumnRenamed("o_custkey", "boat_id"))


@query(f"""{WITH} SELECT id, CASE WHEN trim(builder) = '' AND id % 2 = 0 THEN 'seed ' || id ELSE builder END AS builder FROM classes""")
def seeds_fill_empty(spark, d):
    c = view(spark, d, "classes").select("id", "builder")
    seeds = c.filter("id % 2 = 0").select("id", F.concat(F.lit("seed "), F.col("id").cast("string")).alias("builder")).unionByName(c.filter("id % 2 = 1").select("id", F.lit(" ").alias("builder")))
    return records.fill_empty(c, seeds, "id", ["builder"])


@query(f"""{MATCHING_WITH}, m AS (SELECT result_id, boat_id, r.rating, count(*) OVER (PARTITION BY result_id) AS n FROM r JOIN b ON name = upper(trim(boat_name)))
SELECT result_id, boat_id FROM m WHERE n = 1 UNION ALL SELECT result_id, arg_min(m.boat_id, (-epoch(day), m.boat_id)) FROM m JOIN g ON g.boat_id = m.boat_id WHERE n > 1 AND abs(g.rating - m.rating) < 0.005 GROUP BY 1""")
def boats_by_name(spark, d):
    return records.boats_by_name(*(view(spark, d, x, MATCHING) for x in "rbg"))


@query(f"""{MATCHING_WITH} SELECT result_id, min(boat_id) AS boat_id FROM r JOIN b ON replace(boat_sail, ' ', '') = sail GROUP BY 1""")
def boats_by_sail(spark, d):
    return records.boats_by_sail(view(spark, d, "r", MATCHING), view(spark, d, "b", MATCHING).withColumn("boat_sail", F.replace("boat_sail", F.lit(" "), F.lit(""))))


@query(f"""{WITH}, w AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN 'brand#1' || CAST(n_nationkey AS STRING) ELSE 'RING' END AS design FROM nation),
m AS (SELECT design, id FROM w, classes WHERE lower(name) = lower(design) OR (length(design) >= 3 AND contains(lower(alias), lower(design)))) SELECT design, min(id) AS id FROM m GROUP BY 1""")
def classes_by_alias(spark, d):
    k = F.col("n_nationkey")
    w = t(spark, d, "nation").select(F.when(k % 2 == 0, F.concat(F.lit("brand#1"), k.cast("string"))).otherwise("RING").alias("design"))
    return records.classes_of(w, view(spark, d, "classes").withColumn("aliases", F.array("alias", "builder")).drop("builder"))


BN = "b AS (SELECT *, upper(trim(boat_name)) AS bn, regexp_replace(upper(boat_sail), '[^0-9]', '', 'g') AS hull, upper(trim(regexp_replace(regexp_replace(boat_name, '\\s*-\\s*SEC\\s*$', '', 'i'), '\\s*\\(\\s*SH\\s*\\)\\s*$', '', 'i'))) AS plain FROM boats WHERE boat_sail > '')"


def tier(name: str, keys: str, k1: str, k2: str, where: str = "true", having: str = "true") -> str:
    return f"SELECT '{name}' AS tier, {k1} AS k1, CAST({k2} AS VARCHAR) AS k2, list(boat_id ORDER BY boat_id) AS ids FROM b WHERE {where} GROUP BY {keys} HAVING count(*) > 1 AND {having}"


@query(f"""{WITH}, {BN}, p AS (SELECT s.boat_id AS sec, x.boat_id, s.boat_sail, x.bn FROM b s JOIN b x ON x.boat_sail = s.boat_sail AND x.bn = upper(trim(regexp_replace(s.boat_name, '\\s*-\\s*SEC\\s*$', '', 'i'))) WHERE s.boat_name ILIKE '% - SEC' AND x.boat_name NOT ILIKE '% - SEC')
{tier("S", 'boat_sail, design, "year"', "boat_sail", "design", 'design IS NOT NULL AND "year" IS NOT NULL')}
UNION ALL SELECT 'S''', min(boat_sail), min(bn), [min(boat_id), sec] FROM p GROUP BY sec HAVING count(*) = 1
UNION ALL {tier("S''''", "boat_sail, plain", "boat_sail", "plain", having="bool_or(boat_name ILIKE '%- SEC' OR boat_name ILIKE '%(SH)')")}
UNION ALL {tier("T", "bn, design, country, hull", "bn", "country", "country <> '' AND design IS NOT NULL AND hull <> ''")}
UNION ALL {tier("T''", "bn, design, hull", "bn", "design", "design IS NOT NULL AND hull <> ''")}
UNION ALL {tier("U", "bn, country, hull", "bn", "coalesce(country, '')", "hull <> ''")}
UNION ALL {tier("U''", "bn, hull", "bn", "hull", "hull <> ''")}""")
def duplicate_tiers(spark, d):
    return records.duplicate_tiers(view(spark, d, "boats"))


# --- facts ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {ORDERS}, s AS (SELECT *, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS dlt FROM o),
j AS (SELECT o_custkey, arg_min(dlt, (-abs(dlt), day, o_orderkey)) AS jump, arg_min(day, (-abs(dlt), day, o_orderkey)) AS jump_day FROM s WHERE abs(dlt) > 0 GROUP BY 1),
a AS (SELECT o_custkey, count(*) AS n, arg_min(o_totalprice, (day, o_orderkey)) AS first_rating, arg_max(o_totalprice, (day, o_orderkey)) AS last_rating FROM o GROUP BY 1)
SELECT o_custkey, n, first_rating, last_rating, round(last_rating - first_rating, 6) AS movement, round(coalesce(jump, 0), 6) AS jump, jump_day FROM a LEFT JOIN j USING (o_custkey)""")
def rating_evolution(spark, d):
    e = facts.evolution(orders(spark, d), "o_custkey", "day", "o_totalprice", "o_orderkey")
    return e.withColumn("movement", r6("movement")).withColumn("jump", r6("jump"))


CONTEXT = """w AS (SELECT c_mktsegment AS design, c_custkey AS boat, CASE WHEN c_custkey % 9 > 0 THEN c_acctbal END AS rating, c_nationkey AS wins FROM customer),
k AS (SELECT *, row_number() OVER (PARTITION BY design ORDER BY wins DESC, rating DESC, boat) AS p FROM w WHERE rating IS NOT NULL),
c AS (SELECT design, count(*) AS n, min(rating) AS least, max(rating) AS most, quantile_cont(rating, 0.5) AS median, avg(rating) AS mean, list(boat ORDER BY p) FILTER (p <= 5) AS top FROM k GROUP BY 1)"""


def fleet(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(F.col("c_mktsegment").alias("design"), k.alias("boat"), F.when(k % 9 > 0, F.col("c_acctbal")).alias("rating"), F.col("c_nationkey").alias("wins"))


@query(f'WITH {CONTEXT} SELECT design, n, least, most, round(median, 6) AS median, round(mean, 6) AS mean, top FROM c')
def class_context(spark, d):
    c = facts.class_context(fleet(spark, d), "design", "boat", "rating", "wins")
    return c.withColumn("median", r6("median")).withColumn("mean", r6("mean"))


@query(f"""WITH {CONTEXT} SELECT boat, CASE WHEN abs(rating - median) > 0.005 THEN round(rating - median, 6) END AS gap, CASE WHEN abs(rating - median) > 0.005 THEN CASE WHEN rating > median THEN 'above' ELSE 'below' END END AS side,
 CASE WHEN boat % 25 >= 10 THEN round(wins * 100.0 / (boat % 25), 6) END AS win_pct FROM w LEFT JOIN c USING (design)""")
def boat_summaries(spark, d):
    f = fleet(spark, d)
    s = facts.summary(f.withColumn("finishes", F.col("boat") % 25), facts.class_context(f, "design", "boat", "rating", "wins"), "design")
    return s.select("boat", r6("gap").alias("gap"), "side", r6("win_pct").alias("win_pct"))


@query("""WITH x AS (SELECT c_nationkey AS boat, c_mktsegment || CAST(c_custkey % 5 AS VARCHAR) AS feature, sum(c_acctbal) AS contrib FROM customer GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY boat ORDER BY abs(round(contrib, 4)) DESC, feature) AS rank FROM x)
SELECT boat, feature, round(contrib, 4) AS contrib, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def rating_drivers(spark, d):
    c = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("boat"), F.concat("c_mktsegment", (F.col("c_custkey") % 5).cast("string")).alias("feature")).agg(r6(F.sum("c_acctbal"), 4).alias("contrib"))
    return facts.drivers(c, "boat").select("boat", "feature", "contrib", "rank")


@query("""WITH e AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1), x AS (SELECT p_brand, least(19, CAST(floor((p_retailprice - lo) / ((hi - lo) / 20)) AS INTEGER)) AS bin, lo, hi FROM part JOIN e USING (p_brand))
SELECT p_brand, bin, count(*) AS n, round(min(lo + (hi - lo) / 20 * bin), 6) AS low, round(min(lo + (hi - lo) / 20 * (bin + 1)), 6) AS high FROM x GROUP BY 1, 2""")
def price_histogram(spark, d):
    h = facts.histogram(t(spark, d, "part"), ["p_brand"], "p_retailprice")
    return h.withColumn("low", r6("low")).withColumn("high", r6("high"))


@query(f"""{WITH}, s AS (SELECT * FROM deltas WHERE delta IS NOT NULL AND stable), p AS (SELECT count(*) AS n, avg(delta) AS m, stddev(delta) AS sd FROM s),
z AS (SELECT delta, abs(round(delta * 1000)) AS size FROM s WHERE delta <> 0), rk AS (SELECT delta, size, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY size) AS c FROM z),
q AS (SELECT sum(r) FILTER (delta > 0) AS plus, count(*) AS k, sum(c * c - 1) AS tied FROM rk), v AS (SELECT abs(least(plus, k * (k + 1) / 2.0 - plus) - k * (k + 1) / 4.0) / sqrt(k * (k + 1.0) * (2 * k + 1) / 24 - tied / 48) / sqrt(2) AS x, 1 / (1 + 0.3275911 * x) AS u FROM q)
SELECT n, round(m, 9) AS mean_drift, round(quantile_cont(delta, 0.5), 9) AS median_drift, round(sd, 9) AS std_drift, round(count(*) FILTER (delta < 0) * 100.0 / n, 6) AS pct_decreased, round(m / sd, 9) AS cohens_d, round(min(u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + 1.061405429 * u)))) * exp(-x * x)), 4) AS p_wilcoxon,
 true AS from_stable, (SELECT count(*) FROM deltas WHERE delta IS NOT NULL) AS n_total FROM s, p, v GROUP BY n, m, sd""")
def fleet_drift(spark, d):
    f, _ = facts.fleet_drift(view(spark, d, "deltas"), "delta", "stable", "country")
    return f.select("n", r6("mean_drift", 9).alias("mean_drift"), r6("median_drift", 9).alias("median_drift"), r6("std_drift", 9).alias("std_drift"), r6("pct_decreased").alias("pct_decreased"), r6("cohens_d", 9).alias("cohens_d"), r6("p_wilcoxon", 4).alias("p_wilcoxon"), "from_stable", "n_total")


@query(f"""{WITH} SELECT country, count(*) AS n_stable, round(avg(delta), 5) AS mean_drift, round(quantile_cont(delta, 0.5), 5) AS median_drift, round(count(*) FILTER (delta < 0) * 100.0 / count(*), 1) AS pct_decreased
FROM deltas WHERE delta IS NOT NULL AND stable AND country IS NOT NULL GROUP BY 1""")
def country_drift(spark, d):
    return facts.fleet_drift(view(spark, d, "deltas"), "delta", "stable", "country")[1]


@query(f"""{WITH}, b AS (SELECT * FROM profiles WHERE rating IS NOT NULL AND design IS NOT NULL),
s AS (SELECT design, count(*) AS n_boats, avg(rating) AS mean, quantile_cont(rating, 0.5) AS median, coalesce(stddev(rating), 0) AS sd, max(rating) - min(rating) AS spread, coalesce(avg(loa), avg(lh)) AS loa, count(DISTINCT nullif(country, '')) AS n_countries FROM b GROUP BY 1),
p AS (SELECT boat, count(*) AS races, count(place) AS fin, avg(place / fleet) AS share FROM places GROUP BY 1),
m AS (SELECT design, count(*) FILTER (fin >= 3) AS n_with_races, avg((0.5 - share) * 100) FILTER (fin >= 3) AS mean_gain, quantile_cont((0.5 - share) * 100, 0.5) FILTER (fin >= 3) AS median_gain, sum(races) AS races, sum(races) / count(*) AS per FROM b JOIN p USING (boat) GROUP BY 1),
l AS (SELECT DISTINCT boat, gph FROM gphs g WHERE gph IS NOT NULL AND day = (SELECT max(day) FROM gphs h WHERE h.boat = g.boat)), g AS (SELECT design, avg(gph) AS avg_gph, count(*) AS n_gph FROM b JOIN l USING (boat) GROUP BY 1)
SELECT design, n_boats, round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd, round(spread, 6) AS spread, n_countries, CAST(n_with_races AS BIGINT) AS n_with_races, round(mean_gain, 6) AS mean_gain, round(median_gain, 6) AS median_gain, CAST(races AS BIGINT) AS races, round(per, 6) AS races_per_boat,
 round(avg_gph, 6) AS avg_gph, n_gph, round(mean / (loa * 3.28084), 6) AS rating_per_foot, CASE WHEN sd = 0 OR mean = 0 THEN NULL WHEN sd / mean < 0.005 THEN 'low' WHEN sd / mean < 0.015 THEN 'moderate' ELSE 'high' END AS potential FROM s LEFT JOIN m USING (design) LEFT JOIN g USING (design)""")
def design_profiles(spark, d):
    p = facts.design_profiles(*(view(spark, d, x) for x in ("profiles", "places", "gphs")))
    return p.select("design", "n_boats", *[r6(c).alias(c) for c in ("mean", "median", "sd", "spread", "mean_gain", "median_gain", "races_per_boat", "avg_gph", "rating_per_foot")], "n_countries", "n_with_races", "races", "n_gph", "potential")


# --- health -----------------------------------------------------------------------------------------------------------

NOW = "2024-01-31 00:00:00"


@query(f"""SELECT 'orders days' AS "check", date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '2024-01-31') AS value, date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '2024-01-31') > 8 AS alert FROM orders
UNION ALL SELECT 'failed in a day', count(*), count(*) > 0 FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR UNION ALL SELECT 'stuck', count(*), count(*) > 0 FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '{NOW}' - INTERVAL 2 HOUR""")
def health_checks(spark, d):
    log = t(spark, d, "events").select(F.lit("s").alias("source"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").alias("status"), F.col("ts").cast("timestamp_ntz").alias("started_at"))
    return quality.health({"orders": (orders(spark, d), "day", 8)}, log, NOW)


@query("""WITH o AS (SELECT c_nationkey AS g, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'name' || (c_custkey % 70) END AS k FROM customer), n AS (SELECT c_nationkey AS g, 'name' || (c_custkey % 50) AS k FROM customer WHERE c_custkey % 3 = 0),
b AS (SELECT g, k, x.k IS NOT NULL AS isold, y.k IS NOT NULL AS isnew FROM (SELECT DISTINCT g, k, k AS kk FROM o WHERE k IS NOT NULL) x FULL JOIN (SELECT DISTINCT g, k, k AS kk FROM n) y USING (g, k)),
h AS (SELECT g, CAST(floor((count(*) - count(DISTINCT k)) * 100 / count(*)) AS BIGINT) AS hollow_pct FROM o GROUP BY 1)
SELECT g, count(*) FILTER (isold) AS named, count(*) FILTER (isold AND isnew) AS matched, coalesce(list(k ORDER BY k) FILTER (isold AND NOT isnew), [])[1:25] AS missing, coalesce(list(k ORDER BY k) FILTER (isnew AND NOT isold), [])[1:25] AS extra,
 round(CASE WHEN count(*) FILTER (isold) > 0 THEN count(*) FILTER (isold AND isnew) / count(*) FILTER (isold) ELSE 0 END, 3) AS rate, min(hollow_pct) AS hollow_pct FROM b LEFT JOIN h USING (g) GROUP BY 1""")
def name_differences(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("g"), k)
    old = c.select("g", F.when(k % 4 != 0, F.concat(F.lit(" Name"), (k % 70).cast("string"))).alias("name"))
    new = c.filter(k % 3 == 0).select("g", F.concat(F.lit("na me"), (k % 50).cast("string")).alias("name"))
    return quality.name_diff(old, new, "g", "name")
