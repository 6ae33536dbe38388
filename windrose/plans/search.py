"""Queries on search and matching of many names at once: parts as boats, suppliers as those who ask."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import quality, resolve
from .base import RACES, query, r6, races, t

S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")

GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
ALIKE = "coalesce(len(list_intersect({0}, {1})) / nullif(len(list_distinct(list_concat({0}, {1}))), 0), 0)"
ASKED = f"""q AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 5 WHEN 0 THEN 'AUZ' || (s_suppkey * 3) WHEN 1 THEN ['small', 'blue', 'red', 'anvil'][s_suppkey % 4 + 1] || ' box of things' WHEN 2 THEN 'x' WHEN 3 THEN 'aus ' || s_suppkey || 'x' WHEN 4 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'smal rng' END END AS q FROM supplier),
b AS (SELECT p_partkey AS boat_id, CASE WHEN p_partkey % 9 = 0 THEN p_name || ' - SEC' WHEN p_partkey % 9 = 1 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 11 > 0 THEN 'AUS' || p_partkey END AS sail FROM part),
g AS (SELECT query_id, q, boat_id, name, sail, {ALIKE.format('n', 'g')} AS s_name, {ALIKE.format('l', 'g')} AS s_sail FROM (SELECT *, {GRAMS.format('q')} AS g FROM q WHERE q IS NOT NULL), (SELECT *, {GRAMS.format('name')} AS n, {GRAMS.format('sail')} AS l FROM b) WHERE coalesce(name NOT LIKE '% - SEC', true)),
h AS (SELECT query_id, boat_id, greatest(s_name, s_sail) AS score FROM g WHERE s_name > 0.3 OR s_sail > 0.5)"""


def asked(spark, d):
    k = F.col("s_suppkey")
    word = F.element_at(F.array(*map(F.lit, ("small", "blue", "red", "anvil"))), (k % 4 + 1).cast("int"))
    q = F.when(k % 5 == 0, F.concat(F.lit("AUZ"), S(k * 3))).when(k % 5 == 1, F.concat(word, F.lit(" box of things"))).when(k % 5 == 2, "x").when(k % 5 == 3, F.concat(F.lit("aus "), S(k), F.lit("x"))).when(k % 2 == 0, "smal rng")
    return t(spark, d, "supplier").select(k.alias("query_id"), q.alias("q"))


def searched(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 9 == 0, F.concat("p_name", F.lit(" - SEC"))).when(k % 9 != 1, F.col("p_name"))
    return t(spark, d, "part").select(k.alias("boat_id"), name.alias("boat_name"), F.when(k % 11 > 0, F.concat(F.lit("AUS"), S(k))).alias("boat_sail"))


@query(f"WITH {ASKED} SELECT query_id, boat_id, round(score, 6) AS score FROM h")
def search_batch(spark, d):
    return resolve.search_batch(asked(spark, d), searched(spark, d)).withColumn("score", r6("score"))


SUGGESTED = """f AS (SELECT *, CASE WHEN abs(length(sail) - length(q)) <= 2 THEN levenshtein(upper(sail), upper(q)) ELSE 999 END AS sail_dist FROM g WHERE length(trim(q)) >= 2 AND query_id NOT IN (SELECT query_id FROM h)
 AND (s_name > 0.18 OR coalesce(length(q) BETWEEN 3 AND 10 AND abs(length(sail) - length(q)) <= 2 AND levenshtein(upper(sail), upper(q)) <= 2, false))),
r AS (SELECT query_id, boat_id, CAST(sail_dist AS INTEGER) AS sail_dist, round(s_name, 6) AS name_sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sail_dist, s_name DESC, name NULLS FIRST, boat_id) AS INTEGER) AS rank FROM f)"""


@query(f"WITH {ASKED}, {SUGGESTED} SELECT * FROM r WHERE rank <= 5")
def suggest_batch(spark, d):
    return resolve.suggest_batch(asked(spark, d), searched(spark, d)).withColumn("name_sim", r6("name_sim"))


@query(f"WITH {ASKED.replace('FROM supplier', 'FROM (SELECT 5 AS s_suppkey)')}, {SUGGESTED} SELECT boat_id, sail_dist, name_sim FROM r WHERE rank <= 5")
def levenshtein_suggestions(spark, d):
    return resolve.suggestions(searched(spark, d), "AUZ15").withColumn("name_sim", r6("name_sim"))


LEFT = "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_size ELSE substr(p_name, 1, 6) END"
RIGHT = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN substr(p_name, 3, 7) WHEN 2 THEN p_type || p_name ELSE p_size || ' x' END"


@query(f"""WITH RECURSIVE n AS (SELECT p_size AS g, 'a' AS side, {LEFT} AS v FROM part UNION ALL SELECT p_size, 'b', {RIGHT} FROM part),
k AS (SELECT g, side, regexp_replace(lower(v), '\\s+', '', 'g') AS k, min(v) AS v FROM n GROUP BY 1, 2, 3),
e AS (SELECT x.g, x.k, x.v AS a, y.v AS b FROM k x JOIN k y ON x.g = y.g AND x.k = y.k AND x.side = 'a' AND y.side = 'b'),
l AS (SELECT g, side, list(struct_pack(k := k, v := v) ORDER BY -length(k), k) AS names FROM k WHERE length(k) >= 3 AND NOT EXISTS (SELECT 1 FROM e WHERE e.g = k.g AND e.k = k.k) GROUP BY 1, 2),
p AS (SELECT x.g, x.names AS a, y.names AS b FROM l x JOIN l y ON x.g = y.g AND x.side = 'a' AND y.side = 'b'),
s(g, i, used, took) AS (SELECT g, 0, CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR) FROM p
 UNION ALL SELECT g, i + 1, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, hit FROM (SELECT s.g, i, used, list_filter(list_transform(b, lambda y: y.k), lambda y: (contains(y, a[i + 1].k) OR contains(a[i + 1].k, y)) AND NOT list_contains(used, y))[1] AS hit FROM s JOIN p ON s.g = p.g WHERE i < len(a)))
SELECT g AS "group", a, b FROM e UNION ALL SELECT s.g, a[i].v, list_filter(b, lambda y: y.k = took)[1].v FROM s JOIN p ON s.g = p.g WHERE took IS NOT NULL""")
def one_to_one_names(spark, d):
    """Names of one size group matched as one after another would be."""
    k, name, size = F.col("p_partkey"), F.col("p_name"), S("p_size")
    p = t(spark, d, "part").withColumn("group", F.col("p_size"))
    left = p.select("group", F.when(k % 3 == 0, name).when(k % 3 == 1, F.concat(name, F.lit(" "), size)).otherwise(F.substring(name, 1, 6)).alias("n"))
    right = p.select("group", F.when(k % 4 == 0, F.upper(name)).when(k % 4 == 1, F.substring(name, 3, 7)).when(k % 4 == 2, F.concat("p_type", name)).otherwise(F.concat(size, F.lit(" x"))).alias("n"))
    return quality.match_names(left, right, "group", "n")


EVENT = "CASE race % 7 WHEN 0 THEN 'Friday TWILIGHT' WHEN 1 THEN 'Sydney to Hobart' WHEN 2 THEN 'Coastal Dash' WHEN 3 THEN 'Hobart Sydney' WHEN 4 THEN 'Ocean Series' WHEN 5 THEN 'twilight passage' END"


@query(f"""WITH {RACES}, x AS (SELECT boat, flag, place, lower(coalesce({EVENT}, '')) AS name FROM r) SELECT boat, CASE WHEN contains(name, 'twilight') THEN 'twilight' WHEN regexp_matches(name, 'offshore|coastal|passage|sydney.*hobart|gladstone') THEN 'offshore' ELSE 'series' END AS bucket,
 count(*) FILTER (flag <> 'R') AS n, count(*) FILTER (place = 1) AS wins, count(*) FILTER (place BETWEEN 1 AND 3) AS podiums FROM x GROUP BY 1, 2""")
def race_buckets(spark, d):
    k = F.col("race") % 7
    event = F.when(k == 0, "Friday TWILIGHT").when(k == 1, "Sydney to Hobart").when(k == 2, "Coastal Dash").when(k == 3, "Hobart Sydney").when(k == 4, "Ocean Series").when(k == 5, "twilight passage")
    r = races(spark, d).withColumn("bucket", tx.race_bucket(event))
    return r.groupBy("boat", "bucket").agg(F.count_if(F.col("flag") != "R").alias("n"), F.count_if(F.col("place") == 1).alias("wins"), F.count_if(F.col("place").between(1, 3)).alias("podiums"))
