"""Upkeep queries: triage, merges, backfills, derived values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upkeep
from .base import query, r6, t

CLUSTERS = """m AS (SELECT c_nationkey || '-' || (c_custkey % 40) AS cluster, c_custkey AS boat_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS design, CASE WHEN c_custkey % 2 = 0 THEN 1990 + c_custkey % 9 END AS yr,
 CASE WHEN c_custkey % 11 = 0 THEN 'FRA' ELSE 'GBR' END AS country, c_custkey % 13 = 0 AS signal, 'X' || (c_custkey % 57) AS sail FROM customer),
s AS (SELECT cluster, min(sail) AS shared FROM (SELECT cluster, sail FROM m GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
f AS (SELECT cluster, count(*) AS size, count(*) FILTER (signal) AS bearers, count(DISTINCT design) AS designs, max(yr) - min(yr) AS years, count(DISTINCT country) AS countries FROM m GROUP BY 1)"""


def members(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(
        F.concat_ws("-", "c_nationkey", k % 40).alias("cluster"), k.alias("boat_id"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("design"), F.when(k % 2 == 0, 1990 + k % 9).alias("year"),
        F.when(k % 11 == 0, "FRA").otherwise("GBR").alias("country"), (k % 13 == 0).alias("signal"), F.concat(F.lit("X"), (k % 57).cast("string")).alias("sail"),
    )


@query(f"""WITH {CLUSTERS} SELECT cluster, CASE WHEN size > 4 THEN 'big_cluster' WHEN bearers > 1 THEN 'multi_signal' WHEN designs > 1 THEN 'design_conflict' WHEN years > 2 THEN 'year_conflict' ELSE 'AUTO_MERGE' END AS decision,
 CASE WHEN designs > 1 OR coalesce(years, 0) > 5 THEN 'C' WHEN size > 6 AND shared IS NULL THEN 'C' WHEN shared IS NOT NULL AND coalesce(years, 0) <= 2 THEN 'A' WHEN designs = 1 AND countries <= 1 THEN 'B' ELSE 'D' END AS tier FROM f LEFT JOIN s USING (cluster)""")
def cluster_triage(spark, d):
    return upkeep.cluster_facts(members(spark, d)).select("cluster", upkeep.merge_decision().alias("decision"), upkeep.triage_tier().alias("tier"))


@query("""WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE ' ' || p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS builder, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS loa FROM part),
b AS (SELECT p_name AS name, count(*) AS boats FROM part WHERE p_size > 25 GROUP BY 1), m AS (SELECT c.*, coalesce(boats, 0) AS boats, upper(trim(c.name)) AS canonical, CAST(builder IS NOT NULL AS INT) + CAST(loa IS NOT NULL AS INT) AS filled FROM c LEFT JOIN b ON c.name = b.name),
w AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY name = canonical DESC, filled DESC, boats DESC, id) AS r FROM m)
SELECT canonical, min(id) FILTER (r = 1) AS winner, list(id ORDER BY id) FILTER (r > 1) AS losers, arg_min(builder, CASE WHEN r = 1 THEN -1 ELSE id END) FILTER (builder IS NOT NULL) AS builder,
 arg_min(loa, CASE WHEN r = 1 THEN -1 ELSE id END) FILTER (loa IS NOT NULL) AS loa FROM w GROUP BY 1 HAVING count(*) > 1""")
def design_merge_plan(spark, d):
    p, k = t(spark, d, "part"), F.col("p_partkey")
    name = F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit(" "), "p_name"))
    c = p.select(k.alias("id"), name.alias("name"), F.when(k % 2 == 0, F.col("p_brand")).alias("builder"), F.when(k % 5 != 0, F.col("p_size")).alias("loa"))
    b = p.filter("p_size > 25").select(F.col("p_name").alias("design"))
    return upkeep.design_merge_plan(c, b, ["builder", "loa"], F.upper(F.trim("name")))


@query("""WITH s AS (SELECT p_brand AS design, CASE WHEN p_size > 2 THEN CAST(p_size AS DOUBLE) END AS loa, p_type AS builder, 1900 + p_size % 3 AS yr FROM part),
a AS (SELECT design, list_sort(list(loa) FILTER (loa > 2 AND loa < 50)) AS a FROM s GROUP BY 1),
n AS (SELECT design, round(list_sum(list_transform(a, lambda x: greatest(least(x, a[1 + CAST(floor(len(a) * 0.9) AS INTEGER)]), a[1 + CAST(floor(len(a) * 0.1) AS INTEGER)]))) / len(a), 2) AS loa FROM a),
y AS (SELECT design, yr, count(*) AS c FROM s GROUP BY 1, 2), z AS (SELECT design, CASE WHEN max(c) >= 0.7 * sum(c) THEN arg_min(yr, (-c, yr)) END AS "year" FROM y GROUP BY 1),
b AS (SELECT design, builder, count(*) AS c FROM s GROUP BY 1, 2), q AS (SELECT design, CASE WHEN count(*) < 5 THEN arg_min(builder, (-c, builder)) END AS builder FROM b GROUP BY 1)
SELECT design, loa, builder, "year" FROM n JOIN z USING (design) JOIN q USING (design)""")
def derived_design_values(spark, d):
    s = t(spark, d, "part").select(F.col("p_brand").alias("design"), F.col("p_size").cast("double").alias("loa"), F.col("p_type").alias("builder"), (1900 + F.col("p_size") % 3).alias("year"), *[F.lit(None).cast("double").alias(c) for c in ("beam", "draft", "displacement")])
    return upkeep.derived_design_values(s, ["builder"], ["loa"]).select("design", "loa", "builder", "year")


@query("""SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'AUS' WHEN 1 THEN 'GBR' WHEN 2 THEN 'SUI' WHEN 3 THEN 'AUS' WHEN 4 THEN 'KEPT' END AS country FROM nation""")
def country_backfilled(spark, d):
    k = F.col("n_nationkey")
    sail = F.concat(F.when(k % 6 == 0, "MYC").when(k % 6 == 1, "GB").when(k % 6 == 2, " CH").when(k % 6 == 3, "F").otherwise("Q"), k.cast("string"))
    b = t(spark, d, "nation").select("n_nationkey", sail.alias("sail"), F.when(k % 6 == 4, "KEPT").alias("country"))
    return upkeep.country_backfill(b, {"MYC": "AUS", "GBR": "GBR", "GB": "GBR", "CH": "SUI", "CHN": "CHN"}).select("n_nationkey", "country")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'DNF' ELSE 'finished' END AS status FROM orders")
def dnf_repaired(spark, d):
    k = F.col("o_orderkey")
    r = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source"), F.lit("finished").alias("status"), F.when(k % 3 != 0, 1).alias("place"), F.when(k % 2 == 0, '{"finish_time": ""}').otherwise('{"finish_time": "10:00"}').alias("raw"))
    return upkeep.repair_dnf(r, ["5-LOW"]).select("o_orderkey", "status")


@query("SELECT p_brand AS design, count(DISTINCT p_type) AS n FROM part WHERE p_brand IN ('Brand#2', 'Brand#17') GROUP BY 1 HAVING count(DISTINCT p_type) >= 3")
def ambiguous_classes(spark, d):
    s = t(spark, d, "part").select(F.col("p_brand").alias("design"), "p_type")
    return upkeep.ambiguous_classes(s, ["brand#2", "Brand#17 "], "p_type")


@query("""WITH v AS (SELECT p_partkey AS boat, p_brand AS grp, CAST(p_size AS DOUBLE) AS v FROM part), m AS (SELECT grp, avg(v) AS m FROM v GROUP BY 1) SELECT boat, round((v - m) * 0.0013, 5) AS contrib, round(v - m, 3) AS delta FROM v JOIN m USING (grp)""")
def rating_anatomy(spark, d):
    v = t(spark, d, "part").select(F.col("p_partkey").alias("boat"), F.col("p_brand").alias("grp"), F.lit("crew").alias("feature"), F.col("p_size").cast("double").alias("value"))
    m = v.select("grp", "feature").distinct().withColumn("beta", F.lit(0.0013))
    return upkeep.anatomy(v, m).select("boat", "contrib", "delta")


@query("SELECT 'part' AS \"table\", count(*) AS rows, 'p_name' AS \"column\", 'string' AS type, count(p_name) AS filled FROM part UNION ALL SELECT 'part', count(*), 'p_size', 'int', count(p_size) FROM part")
def table_columns(spark, d):
    return upkeep.describe(t(spark, d, "part").select("p_name", "p_size"), "part")


def new_boats(spark, d):
    """Without SQL: the groups are connected components."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("result_id"), F.concat(F.lit("YAUS"), (F.col("c_custkey") % 700).cast("string"), F.lit("&"), (F.col("c_custkey") % 900 + 5000).cast("string")).alias("sail"), F.col("c_name").alias("name"), F.lit(1.0).alias("tcc"))
    boats = t(spark, d, "supplier").select(F.col("s_suppkey").alias("boat_id"), F.concat(F.lit("AUS"), F.col("s_suppkey").cast("string")).alias("boat_sail"), F.col("s_name").alias("boat_name"))
    links, created = upkeep.new_boats(c, boats)
    return created.select("group_id", "boat_name", "country", "n_results").unionByName(links.select(F.col("result_id").alias("group_id"), F.lit(None).cast("string").alias("boat_name"), F.lit(None).cast("string").alias("country"), F.lit(0).cast("long").alias("n_results")))


query()(new_boats)


def coefficient_drift(spark, d):
    """Without SQL: ridge models of two dates."""
    p = t(spark, d, "part")
    at = lambda s: p.select("p_partkey", "p_size", (F.col("p_partkey") % 7).alias("cls"), (F.col("p_retailprice") + F.col("p_size") * s).alias("y"))
    x = upkeep.coefficient_drift(at(0.0), at(3.0), "y", ["p_size", "cls"], "p_partkey")
    return x.select("feature", r6("change", 4).alias("change"))


query()(coefficient_drift)
