"""Racing and time queries: windows, races, bands, drift, run lengths, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics
from ..operators import relational as rel
from ..streaming import feeds
from .base import LATEST, ORDERS, RACES, orders, query, r6, races, t


@query(f"""WITH {ORDERS}, x AS (SELECT *, lag(o_totalprice) OVER w AS prev, lag(o_orderstatus) OVER w AS ps, lag(o_orderpriority) OVER w AS pp FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey))
SELECT o_orderkey, round(o_totalprice - prev, 6) AS delta, coalesce(o_orderstatus = ps, true) AND coalesce(o_orderpriority = pp, true) AS stable FROM x""")
def price_drift(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    return orders(spark, d).select("o_orderkey", r6(F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("delta"), rel.stable_since(["o_orderstatus", "o_orderpriority"], w).alias("stable"))


@query(f"""WITH {ORDERS}, x AS (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS prev FROM o)
SELECT day, count(*) AS n, round(avg(o_totalprice - prev), 6) AS mean, list(o_custkey ORDER BY o_custkey) AS boats FROM x WHERE prev IS NOT NULL AND prev <> o_totalprice GROUP BY 1 HAVING count(*) > 1""")
def price_change_dates(spark, d):
    c = rel.changes(orders(spark, d), ["o_custkey"], ["day", "o_orderkey"], "o_totalprice")
    return c.groupBy("day").agg(F.count("*").alias("n"), r6(F.avg("delta")).alias("mean"), F.array_sort(F.collect_list("o_custkey")).alias("boats")).filter("n > 1")


@query(f"WITH {LATEST} SELECT o_custkey, CAST(rank() OVER (ORDER BY o_totalprice DESC NULLS LAST) AS INTEGER) AS place, (SELECT count(*) FROM l) AS fleet FROM l")
def rank_and_fleet(spark, d):
    last = rel.latest_per_key(orders(spark, d), "o_custkey", ["day", "o_orderkey"]).select("o_custkey", "o_totalprice")
    # ranks without one sort of everything in a task: counts by value, then running sums over the values
    per = last.groupBy((-F.col("o_totalprice")).alias("v")).agg(F.count("*").alias("n"))
    place = rel.running(per, [], "v", "n").select("v", (F.col("before") + 1).cast("int").alias("place"), F.col("whole").alias("fleet"))
    return last.join(place, -F.col("o_totalprice") == F.col("v")).select("o_custkey", "place", "fleet")


@query(f"""WITH {RACES} SELECT race, boat, round(CASE WHEN count(rating) OVER (PARTITION BY race) >= 2 THEN rank() OVER (PARTITION BY race ORDER BY rating DESC) / count(rating) OVER (PARTITION BY race) END, 6) AS expected FROM r""")
def race_expected_share(spark, d):
    return rel.expected_share(races(spark, d), ["race"], "rating").select("race", "boat", r6("expected").alias("expected"))


@query(f"""WITH {RACES}, x AS (SELECT *, CASE WHEN fleet >= 2 THEN rank() OVER (PARTITION BY race ORDER BY rating DESC) / fleet ELSE 0.5 END AS e, place / fleet AS a FROM r)
SELECT boat, round(avg((e - a) * 100), 6) AS rai, count(*) AS n_races, round(avg(a), 6) AS avg_finish_pct, round(avg(e), 6) AS avg_expected_pct,
 count(*) FILTER (place = 1) AS wins, count(*) FILTER (place <= 3) AS podiums FROM x GROUP BY 1""")
def supplier_rai(spark, d):
    x = analytics.rating_advantage(races(spark, d), "boat", ["race"], "place", "fleet", "rating")
    return x.select("boat", r6("rai").alias("rai"), "n_races", r6("avg_finish_pct").alias("avg_finish_pct"), r6("avg_expected_pct").alias("avg_expected_pct"), "wins", "podiums")


def supplier_rai_interval(spark, d):
    """Without SQL: DuckDB has no quantile of Student's t."""
    return analytics.rating_advantage(races(spark, d), "boat", ["race"], "place", "fleet", "rating").select("boat", r6("ci_lower").alias("ci_lower"), r6("ci_upper").alias("ci_upper"))


query()(supplier_rai_interval)


@query(f"""WITH {RACES} SELECT a.boat AS boat, b.boat AS rival, CAST(sum(CASE WHEN a.place < b.place THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN a.place > b.place THEN 1 ELSE 0 END) AS BIGINT) AS losses,
 count(*) AS meetings FROM r a JOIN r b ON a.race = b.race AND a.boat <> b.boat GROUP BY 1, 2 HAVING count(*) >= 3""")
def supplier_head_to_head(spark, d):
    return analytics.head_to_head(races(spark, d), "boat", ["race"], "place", 3)


@query(f"""WITH {RACES} SELECT boat, count(*) AS n, count(*) FILTER (place = 1) AS wins, count(*) FILTER (place <= 3) AS podiums, round(avg(place / fleet), 6) AS avg_pct, min(day) AS first, max(day) AS last,
 count(DISTINCT race) AS races, count(*) FILTER (flag = 'R') AS returned, min(place) AS best, max(place) AS worst FROM r GROUP BY 1 HAVING count(*) > 0""")
def supplier_performance_summary(spark, d):
    # a boat has one row a race, so its races are counted without keeping them apart
    return races(spark, d).groupBy("boat").agg(
        F.count("*").alias("n"), F.count_if(F.col("place") == 1).alias("wins"), F.count_if(F.col("place") <= 3).alias("podiums"), r6(F.avg(F.col("place") / F.col("fleet"))).alias("avg_pct"), F.min("day").alias("first"),
        F.max("day").alias("last"), F.count("race").alias("races"), F.count_if(F.col("flag") == "R").alias("returned"), F.min("place").alias("best"), F.max("place").alias("worst"),
    )


@query(f"""WITH {RACES} SELECT boat, CAST(year(day) AS INTEGER) AS y, round(avg(place), 6) AS avg_place, count(*) FILTER (place = 1) AS wins, min(place) AS best, max(place) AS worst, list(place ORDER BY day, race) AS places FROM r GROUP BY 1, 2""")
def event_standings(spark, d):
    return races(spark, d).groupBy("boat", F.year("day").alias("y")).agg(
        r6(F.avg("place")).alias("avg_place"), F.count_if(F.col("place") == 1).alias("wins"), F.min("place").alias("best"), F.max("place").alias("worst"), rel.sorted_list("place", "day", "race").alias("places")
    )


@query(f"""WITH {RACES}, x AS (SELECT boat, place, race, lag(place) OVER (PARTITION BY boat ORDER BY day, race) - place AS gain FROM r) SELECT boat, max(gain) AS best_gain FROM x GROUP BY 1""")
def best_improvement(spark, d):
    w = Window.partitionBy("boat").orderBy("day", "race")
    return races(spark, d).withColumn("gain", F.lag("place").over(w) - F.col("place")).groupBy("boat").agg(F.max("gain").alias("best_gain"))


@query(f"""WITH {RACES}, b AS (SELECT boat, avg(rating) AS rating, avg(place) AS mean FROM r GROUP BY 1) SELECT floor(rating * 4) / 4 AS band, count(*) AS n, round(avg(mean), 6) AS avg_place FROM b GROUP BY 1""")
def rating_bands(spark, d):
    b = races(spark, d).groupBy("boat").agg(F.avg("rating").alias("rating"), F.avg("place").alias("mean"))
    return b.groupBy((F.floor(F.col("rating") * 4) / 4).alias("band")).agg(F.count("*").alias("n"), r6(F.avg("mean")).alias("avg_place"))


@query(f"""WITH {RACES} SELECT CAST(year(day) AS INTEGER) AS y, min(day) AS first, max(day) AS last, count(DISTINCT race) AS races, count(DISTINCT boat) AS boats, count(*) FILTER (rating < 5) AS low, CAST(max(fleet) AS BIGINT) AS fleet,
 list_sort(list(DISTINCT flag) FILTER (place = 1)) AS flags FROM r GROUP BY 1""")
def event_list(spark, d):
    return races(spark, d).groupBy(F.year("day").alias("y")).agg(
        F.min("day").alias("first"), F.max("day").alias("last"), F.countDistinct("race").alias("races"), F.countDistinct("boat").alias("boats"), F.count_if(F.col("rating") < 5).alias("low"), F.max("fleet").alias("fleet"),
        F.array_sort(F.collect_set(F.when(F.col("place") == 1, F.col("flag")))).alias("flags"),
    )


@query(f"WITH {RACES} SELECT CAST(year(day) AS INTEGER) AS y, count(DISTINCT coalesce(CASE WHEN boat % 5 <> 0 THEN CAST(boat AS VARCHAR) END, flag)) AS entrants FROM r GROUP BY 1")
def distinct_entrants(spark, d):
    who = F.coalesce(F.when(F.col("boat") % 5 != 0, F.col("boat").cast("string")), F.col("flag"))
    return races(spark, d).groupBy(F.year("day").alias("y")).agg(F.countDistinct(who).alias("entrants"))


@query("""SELECT nullif(trim(concat_ws(' ', p_brand, nullif(p_type, 'ECONOMY'))), '') AS class, count(*) AS n FROM part WHERE nullif(trim(concat_ws(' ', p_brand, nullif(p_type, 'ECONOMY'))), '') IS NOT NULL GROUP BY 1 ORDER BY n DESC, class LIMIT 20""")
def class_breakdown(spark, d):
    c = F.nullif(F.trim(F.concat_ws(" ", F.col("p_brand"), F.nullif(F.col("p_type"), F.lit("ECONOMY")))), F.lit(""))
    return t(spark, d, "part").withColumn("class", c).filter("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").limit(20)


@query(f"""WITH {LATEST}, j AS (SELECT * FROM l JOIN customer ON o_custkey = c_custkey) SELECT c_custkey, round((rank() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice) - 1) / count(*) OVER (PARTITION BY c_mktsegment) * 100, 6) AS pct FROM j""")
def percentile_rank_in_class(spark, d):
    j = rel.latest_per_key(orders(spark, d), "o_custkey", ["day", "o_orderkey"]).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("c_custkey", r6(rel.percent_below(j, ["c_mktsegment"], "o_totalprice")).alias("pct"))


@query(f"""WITH {LATEST}, j AS (SELECT * FROM l JOIN customer ON o_custkey = c_custkey), s AS (SELECT c_mktsegment, avg(o_totalprice) AS m, stddev(o_totalprice) AS sd FROM j GROUP BY 1)
SELECT c_custkey, round((o_totalprice - m) / nullif(sd, 0), 6) AS z FROM j JOIN s USING (c_mktsegment)""")
def boat_in_class(spark, d):
    j = rel.latest_per_key(orders(spark, d), "o_custkey", ["day", "o_orderkey"]).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = j.groupBy("c_mktsegment").agg(F.avg("o_totalprice").alias("m"), F.stddev("o_totalprice").alias("sd"))
    return j.join(s, "c_mktsegment").select("c_custkey", r6(F.try_divide(F.col("o_totalprice") - F.col("m"), F.nullif("sd", F.lit(0.0)))).alias("z"))


@query(f"""WITH {RACES}, b AS (SELECT boat, avg(place / fleet) AS pct, avg(rating) AS rating, boat % 3 AS grp FROM r GROUP BY 1),
x AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(pct, 9), boat) AS n, count(*) OVER (PARTITION BY grp) AS c FROM b)
SELECT grp, count(*) AS n, round(avg(rating), 6) AS mean, round(stddev_pop(rating), 6) AS sd FROM x WHERE n <= greatest(1, floor(c * 0.1)) GROUP BY 1""")
def smart_top_decile(spark, d):
    b = races(spark, d).groupBy("boat").agg(F.avg(F.col("place") / F.col("fleet")).alias("pct"), F.avg("rating").alias("rating")).withColumn("grp", F.col("boat") % 3)
    top = analytics.top_share(b, ["grp"], [F.round("pct", 9), "boat"])
    return top.groupBy("grp").agg(F.count("*").alias("n"), r6(F.avg("rating")).alias("mean"), r6(F.stddev_pop("rating")).alias("sd"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT event_id, user_id, event_type FROM e WHERE p IS NULL OR p <> event_type""")
def run_starts(spark, d):
    return rel.run_starts(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query("""WITH e AS (SELECT user_id, ts, event_id, nullif(event_type, 'view') AS v FROM events), f AS (SELECT *, row_number() OVER w AS n, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, v NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, v NULLS FIRST)) SELECT event_id, user_id, v FROM f WHERE n = 1 OR (v IS NOT NULL AND b IS NOT NULL AND v <> b)""")
def run_length_dedup(spark, d):
    e = t(spark, d, "events").select("user_id", "ts", "event_id", F.nullif(F.col("event_type"), F.lit("view")).alias("v"))
    return feeds.run_length_compact(e, "user_id", "ts", "v").select("event_id", "user_id", "v")


@query("SELECT p_type, count(*) AS n, round(corr(p_size, p_retailprice), 6) AS r FROM part GROUP BY 1 HAVING count(*) >= 2")
def class_correlation(spark, d):
    return t(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), r6(F.corr("p_size", "p_retailprice")).alias("r")).filter("n >= 2")


def class_ridge(spark, d):
    """Without SQL: the penalty is chosen by cross-validation."""
    p = t(spark, d, "part").select("p_type", "p_partkey", "p_size", (F.col("p_partkey") % 17).alias("cls"), "p_retailprice")
    m = analytics.class_models(p, "p_type", "p_retailprice", ["p_size", "cls"], "p_partkey")
    return m.select("grp", "feature", r6("std_beta", 4).alias("std_beta"), "rank", "tier", r6("r2", 4).alias("r2"), "n")


query()(class_ridge)


@query("""WITH p AS (SELECT p_brand || '-' || (p_partkey % 10) AS grp, p_size AS x, p_retailprice AS y FROM part), g AS (SELECT grp, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(y) AS vy, max(y) - min(y) AS spread FROM p GROUP BY 1),
m AS (SELECT *, n * c / sx / (n + 0.01) AS w FROM g WHERE n BETWEEN 5 AND 14 AND sx > 0 AND spread >= 0.001) SELECT grp, n, round(w, 6) AS std_beta, round(w / sx, 6) AS beta, round((2 * w * n * c / sx - w * w * n) / (n * vy), 6) AS r2 FROM m""")
def small_class_models(spark, d):
    """Groups too small for cross-validation, by one feature: the closed form with the least penalty."""
    p = t(spark, d, "part").select(F.concat_ws("-", "p_brand", F.col("p_partkey") % 10).alias("g"), "p_partkey", "p_size", "p_retailprice")
    m = analytics.class_models(p, "g", "p_retailprice", ["p_size"], "p_partkey").filter("n BETWEEN 5 AND 14 AND tier IN ('A', 'B') AND std_beta <> 0")
    return m.select("grp", "n", r6("std_beta").alias("std_beta"), r6("beta").alias("beta"), r6("r2").alias("r2"))


def model_sweep(spark, d):
    """Without SQL: the penalty is chosen by cross-validation."""
    p = t(spark, d, "part").select("p_brand", "p_partkey", "p_size", F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") % 17).alias("crew"), (F.col("p_retailprice") + F.col("p_size") * F.when(F.col("p_brand") > "Brand#3", 40).otherwise(0)).alias("y"))
    m = analytics.chosen_models(p.filter("crew IS NOT NULL"), p, "p_brand", "y", ["p_size", "crew"], ["p_size"], "p_partkey")
    u = analytics.in_units(m).select("grp", "effect", "unit", "rank").filter("rank = 1")
    return analytics.model_sweep(m).join(u, "grp").select("grp", "tier", "n", r6("r2", 4).alias("r2"), "top_feature", r6("effect", 4).alias("effect"), "unit")


query()(model_sweep)


@query("""WITH l AS (SELECT l_quantity AS q, l_extendedprice AS e, l_discount AS d, -2 * l_quantity + l_discount * 20 AS t FROM lineitem), c AS (SELECT count(*) AS n, corr(q, e) AS qe, corr(q, d) AS qd, corr(q, t) AS qt, corr(e, d) AS ed, corr(e, t) AS et, corr(d, t) AS dt FROM l),
p AS (SELECT n, unnest([('q', 'e', qe), ('q', 'd', qd), ('q', 't', qt), ('e', 'd', ed), ('e', 't', et), ('d', 't', dt)]) AS x FROM c) SELECT x[1] AS a, x[2] AS b, round(x[3], 6) AS r FROM p WHERE n >= 3 AND abs(x[3]) > 0.9""")
def collinear_features(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"), F.col("l_discount").alias("d"), (-2 * F.col("l_quantity") + F.col("l_discount") * 20).alias("t"))
    return analytics.collinear_pairs(x, ["q", "e", "d", "t"]).withColumn("r", r6("r"))


@query("""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS a, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS b FROM part), k AS (SELECT p_brand, count(a) / count(*) >= 0.5 AS ka, count(b) / count(*) >= 0.5 AS kb FROM p GROUP BY 1)
SELECT p_partkey, CASE WHEN ka THEN a END AS a, CASE WHEN kb THEN b END AS b FROM p JOIN k USING (p_brand) WHERE (a IS NOT NULL OR NOT ka) AND (b IS NOT NULL OR NOT kb)""")
def feature_matrix(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).alias("a"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("b"))
    return analytics.usable_features(p, "p_brand", ["a", "b"]).select("p_partkey", "a", "b")


@query(f"""WITH {ORDERS}, x AS (SELECT o_orderpriority AS grp, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS delta FROM o)
SELECT grp, count(*) AS n, round(avg(delta), 4) AS mean_drift, round(quantile_cont(delta, 0.5), 4) AS median_drift, round(stddev(delta), 4) AS std_drift, round(count(*) FILTER (delta < 0) / count(*) * 100, 4) AS pct_decreased,
 round(avg(delta) / stddev(delta), 4) AS cohens_d FROM x WHERE delta IS NOT NULL GROUP BY 1""")
def drift_statistics(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    x = orders(spark, d).select(F.col("o_orderpriority").alias("grp"), (F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("delta"))
    s = analytics.drift_stats(x, "grp", "delta")
    return s.select("grp", "n", *[r6(c, 4).alias(c) for c in ("mean_drift", "median_drift", "std_drift", "pct_decreased", "cohens_d")])


@query(f"""WITH {ORDERS}, x AS (SELECT o_custkey, day, o_orderkey, o_totalprice, abs(o_totalprice - lag(o_totalprice) OVER w) AS jump FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey))
SELECT o_custkey, round(max(jump), 6) AS largest_jump, round(max_by(o_totalprice, (day, o_orderkey)) - min_by(o_totalprice, (day, o_orderkey)), 6) AS movement FROM x GROUP BY 1""")
def largest_jump(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    o, at = orders(spark, d).withColumn("jump", F.abs(F.col("o_totalprice") - F.lag("o_totalprice").over(w))), F.struct("day", "o_orderkey")
    return o.groupBy("o_custkey").agg(r6(F.max("jump")).alias("largest_jump"), r6(F.max_by("o_totalprice", at) - F.min_by("o_totalprice", at)).alias("movement"))


@query(f"""WITH {ORDERS}, y AS (SELECT o_custkey, CAST(year(day) AS INTEGER) AS y, avg(o_totalprice) AS m FROM o GROUP BY 1, 2), f AS (SELECT y, avg(m) AS fm FROM y GROUP BY 1),
x AS (SELECT o_custkey, y, m - lag(m) OVER w AS total, fm - lag(fm) OVER w AS formula FROM y JOIN f USING (y) WINDOW w AS (PARTITION BY o_custkey ORDER BY y))
SELECT o_custkey, y, round(total, 4) AS total, round(formula, 4) AS formula, round(total - formula, 4) AS measurement FROM x WHERE total IS NOT NULL""")
def drift_decomposition(spark, d):
    y = orders(spark, d).groupBy("o_custkey", F.year("day").alias("y")).agg(F.avg("o_totalprice").alias("m"))
    x = y.join(y.groupBy("y").agg(F.avg("m").alias("fm")), "y")
    w = Window.partitionBy("o_custkey").orderBy("y")
    x = x.withColumn("total", F.col("m") - F.lag("m").over(w)).withColumn("formula", F.col("fm") - F.lag("fm").over(w)).filter("total IS NOT NULL")
    return x.select("o_custkey", "y", r6("total", 4).alias("total"), r6("formula", 4).alias("formula"), r6(F.col("total") - F.col("formula"), 4).alias("measurement"))


@query(f"""WITH {RACES} SELECT p_brand, count(*) AS entries, count(DISTINCT p_partkey) AS boats, round(avg(p_retailprice), 6) AS mean, round(stddev(p_retailprice), 6) AS sd, round(avg(p_retailprice / (p_size * 3.28084)), 6) AS per_foot,
 max(CAST(l_shipdate AS DATE)) AS last FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1""")
def design_profile(spark, d):
    j = t(spark, d, "part").join(t(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy("p_brand").agg(
        F.count("*").alias("entries"), F.countDistinct("p_partkey").alias("boats"), r6(F.avg("p_retailprice")).alias("mean"), r6(F.stddev("p_retailprice")).alias("sd"),
        r6(F.avg(F.col("p_retailprice") / (F.col("p_size") * 3.28084))).alias("per_foot"), F.max(F.to_date("l_shipdate")).alias("last"),
    )


@query(f"""WITH {RACES}, b AS (SELECT boat, avg((rank_e - place) / fleet) AS gain, avg(rating) AS rating, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY race ORDER BY rating DESC) AS rank_e FROM r) GROUP BY 1 HAVING count(*) >= 3)
SELECT count(*) AS n, round(corr(gain, rating), 6) AS r FROM b HAVING count(*) >= 5""")
def performance_correlation(spark, d):
    x = races(spark, d).withColumn("rank_e", F.rank().over(Window.partitionBy("race").orderBy(F.desc("rating"))))
    b = x.groupBy("boat").agg(F.avg((F.col("rank_e") - F.col("place")) / F.col("fleet")).alias("gain"), F.avg("rating").alias("rating"), F.count("*").alias("n")).filter("n >= 3")
    return b.agg(F.count("*").alias("n"), r6(F.corr("gain", "rating")).alias("r")).filter("n >= 5")


@query("""WITH v AS (SELECT p_partkey AS boat, p_brand AS grp, f.feature, CAST(f.v AS DOUBLE) AS cur FROM part, LATERAL (SELECT 'crew' AS feature, p_size AS v UNION ALL SELECT 'draft', p_partkey % 13) f),
m AS (SELECT grp, feature, CASE WHEN feature = 'draft' AND grp > 'Brand#3' THEN avg(cur) + 1 ELSE avg(cur) END AS mean FROM v GROUP BY 1, 2), x AS (SELECT boat, feature, (mean - cur) * CASE feature WHEN 'crew' THEN 0.001 ELSE -0.002 END AS delta, CASE feature WHEN 'crew' THEN 1 ELSE 7 END AS feas, CASE feature WHEN 'crew' THEN 1.0 ELSE 0.7 END AS ev FROM v JOIN m USING (grp, feature)),
k AS (SELECT boat, feature, round(delta, 8) AS delta, round(abs(delta / 0.001) * 3.6, 1) AS seconds_per_hour, CAST(CASE feas WHEN 1 THEN 0 ELSE 25000 END AS DOUBLE) AS cost, CASE feas WHEN 1 THEN 999.0 ELSE round(round(abs(delta / 0.001) * 3.6, 1) / 25, 2) END AS "return", CAST(row_number() OVER (PARTITION BY boat ORDER BY round(abs(delta) * (9 - feas) / 8 * ev, 12) DESC, feature) AS INTEGER) AS rank FROM x WHERE abs(delta) >= 0.0005) SELECT * FROM k""")
def ranked_recommendations(spark, d):
    p = t(spark, d, "part")
    each = F.explode(F.array(F.struct(F.lit("crew").alias("feature"), F.col("p_size").cast("double").alias("current")), F.struct(F.lit("draft").alias("feature"), (F.col("p_partkey") % 13).cast("double").alias("current"))))
    v = p.select(F.col("p_partkey").alias("boat"), F.col("p_brand").alias("grp"), each.alias("f")).select("boat", "grp", "f.*")
    means = v.groupBy("grp", "feature").agg(F.avg("current").alias("mean")).withColumn("smart", F.when((F.col("feature") == "draft") & (F.col("grp") > "Brand#3"), F.col("mean") + 1))
    crew = F.col("feature") == "crew"
    models = v.select("grp", "feature").distinct().select("grp", "feature", F.when(crew, 0.5).otherwise(-0.2).alias("std_beta"), F.when(crew, 0.001).otherwise(-0.002).alias("beta"), F.lit("A").alias("tier"))
    return analytics.recommendations(v, models, means).select("boat", "feature", r6("delta", 8).alias("delta"), "seconds_per_hour", "cost", "return", "rank")
