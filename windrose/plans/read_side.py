"""Read-side queries: latest rows, class statistics, filters, joins, sets, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import matching, quality, sinks
from ..operators import relational as rel
from .base import LATEST, ORDERS, RACES, orders, query, r6, races, t

# --- latest rows and class statistics ---------------------------------------------------------------------------------


def latest(spark: SparkSession, d: str) -> DataFrame:
    return rel.latest_per_key(orders(spark, d), "o_custkey", ["day", "o_orderkey"])


@query(f"WITH {LATEST} SELECT o_custkey, o_orderkey, o_totalprice, day FROM l")
def latest_order_per_customer(spark, d):
    return latest(spark, d).select("o_custkey", "o_orderkey", "o_totalprice", "day")


@query(f"""WITH {LATEST} SELECT c_mktsegment, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 6) AS mean,
  round(quantile_cont(o_totalprice, 0.5), 6) AS median FROM l JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def segment_fleet_stats(spark, d):
    j = latest(spark, d).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), r6(F.avg("o_totalprice")).alias("mean"), r6(F.percentile("o_totalprice", F.lit(0.5))).alias("median"))


@query(f"""WITH {LATEST} SELECT c_nationkey, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev(o_totalprice), 6) AS sd,
  round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.75), 6) AS p75,
  count(o_orderkey) AS n_with FROM customer LEFT JOIN l ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 2""")
def nation_class_distribution(spark, d):
    j = t(spark, d, "customer").join(latest(spark, d), F.col("o_custkey") == F.col("c_custkey"), "left")
    q = lambda p: r6(F.percentile("o_totalprice", F.lit(p))).alias(f"p{int(p * 100)}")
    return j.groupBy("c_nationkey").agg(F.count("*").alias("n"), r6(F.avg("o_totalprice")).alias("mean"), r6(F.stddev("o_totalprice")).alias("sd"), q(0.25), q(0.5), q(0.75), F.count("o_orderkey").alias("n_with")).filter("n >= 2")


@query(f"WITH {ORDERS} SELECT c_nationkey, CAST(date_trunc('month', day) AS DATE) AS month, count(DISTINCT o_custkey) AS boats, round(avg(o_totalprice), 6) AS mean FROM o JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def nation_month_trend(spark, d):
    j = orders(spark, d).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_nationkey", F.trunc("day", "month").alias("month")).agg(F.countDistinct("o_custkey").alias("boats"), r6(F.avg("o_totalprice")).alias("mean"))


@query("SELECT p_brand, p_size, count(*) AS n, list(p_partkey ORDER BY p_partkey) AS parts FROM part GROUP BY 1, 2")
def config_groups(spark, d):
    return t(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("p_partkey")).alias("parts"))


@query(f"""WITH {LATEST} SELECT o_orderpriority, CASE WHEN count(*) >= 2 THEN count(*) END AS n, CASE WHEN count(*) >= 2 THEN min(o_totalprice) END AS lo,
  CASE WHEN count(*) >= 2 THEN max(o_totalprice) END AS hi, CASE WHEN count(*) >= 2 THEN round(stddev(o_totalprice), 6) END AS sd,
  CASE WHEN count(*) >= 2 THEN round(max(o_totalprice) - min(o_totalprice), 6) END AS spread FROM l GROUP BY 1""")
def rating_spread(spark, d):
    many = lambda c: F.when(F.count("*") >= 2, c)
    return latest(spark, d).groupBy("o_orderpriority").agg(
        many(F.count("*")).alias("n"), many(F.min("o_totalprice")).alias("lo"), many(F.max("o_totalprice")).alias("hi"), many(r6(F.stddev("o_totalprice"))).alias("sd"), many(r6(F.max("o_totalprice") - F.min("o_totalprice"))).alias("spread")
    )


@query(f"""WITH {LATEST}, a AS (SELECT o_custkey, avg(o_totalprice) AS raced, count(*) AS n FROM o GROUP BY 1 HAVING count(*) >= 2)
SELECT o_custkey, round(raced, 6) AS raced, o_totalprice AS official, round(abs(raced - o_totalprice), 6) AS diff FROM a JOIN l USING (o_custkey)
WHERE abs(raced - o_totalprice) >= 0.0001 ORDER BY round(abs(raced - o_totalprice), 6) DESC, o_custkey LIMIT 10""")
def raced_against_official(spark, d):
    a = orders(spark, d).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("raced"), F.count("*").alias("n")).filter("n >= 2")
    j = a.join(latest(spark, d), "o_custkey").withColumn("diff", r6(F.abs(F.col("raced") - F.col("o_totalprice")))).filter("diff >= 0.0001")
    return j.select("o_custkey", r6("raced").alias("raced"), F.col("o_totalprice").alias("official"), "diff").orderBy(F.desc("diff"), "o_custkey").limit(10)


@query(f"""WITH {LATEST} SELECT n_name, count(DISTINCT c_custkey) AS boats, count(DISTINCT c_mktsegment) AS designs, round(avg(o_totalprice), 6) AS mean, max(day) AS last
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN l ON o_custkey = c_custkey GROUP BY 1""")
def country_fleet(spark, d):
    n = F.broadcast(t(spark, d, "nation"))  # 25 rows by definition
    j = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(latest(spark, d), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("n_name").agg(F.countDistinct("c_custkey").alias("boats"), F.countDistinct("c_mktsegment").alias("designs"), r6(F.avg("o_totalprice")).alias("mean"), F.max("day").alias("last"))


@query("""SELECT (SELECT count(*) FROM customer) AS boats, (SELECT count(*) FROM orders) AS snapshots, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS last_snapshot,
 (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS races, (SELECT count(*) FROM part) AS designs""")
def global_stats(spark, d):
    one = lambda name, *a: t(spark, d, name).agg(*a)
    parts = [
        one("customer", F.count("*").alias("boats")),
        one("orders", F.count("*").alias("snapshots"), F.max(F.to_date("o_orderdate")).alias("last_snapshot")),
        one("lineitem", F.countDistinct("l_orderkey").alias("races")),
        one("part", F.count("*").alias("designs")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out


# --- filters ----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE NOT contains(lower(coalesce(p_name, '')), 'ring') AND NOT contains(lower(coalesce(p_type, '')), 'ring') AND p_retailprice IS NOT NULL")
def without_word(spark, d):
    keep = lambda c: ~F.lower(F.coalesce(F.col(c), F.lit(""))).contains("ring")
    return t(spark, d, "part").filter(keep("p_name") & keep("p_type") & F.col("p_retailprice").isNotNull()).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%7%' AND c_nationkey = 3 AND upper(c_mktsegment) = upper('building') AND c_acctbal BETWEEN -500 AND 5000 AND c_name NOT LIKE '% - SEC'")
def optional_filters(spark, d):
    asked = {"name": "7", "nation": 3, "segment": "building", "balance": (-500, 5000)}
    rules = {"name": lambda v: F.col("c_name").ilike(f"%{v}%"), "nation": lambda v: F.col("c_nationkey") == v, "segment": lambda v: F.upper("c_mktsegment") == F.upper(F.lit(v)), "balance": lambda v: F.col("c_acctbal").between(*v)}
    out = t(spark, d, "customer").filter(~F.endswith("c_name", F.lit(" - SEC")))
    for k, v in asked.items():
        out = out.filter(rules[k](v))
    return out.select("c_custkey", "c_name")


@query("""SELECT 'eq' AS expr, count(*) AS n FROM part WHERE p_brand = 'Brand#2' UNION ALL SELECT 'ge', count(*) FROM part WHERE p_size >= 20 UNION ALL SELECT 'part', count(*) FROM part WHERE contains(lower(p_name), 'red')
UNION ALL SELECT 'null', count(*) FROM part WHERE p_name IS NULL UNION ALL SELECT 'text', count(*) FROM part WHERE
 contains(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), 'redwidget') OR contains(regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g'), 'redwidget') OR contains(regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g'), 'redwidget')""")
def filter_language(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    asked = {"eq": "p_brand=Brand#2", "ge": "p_size>=20", "part": "p_name~red", "null": "p_name:null", "text": "Red Widget"}
    return p.agg(*[F.count_if(rel.row_filter(p, e)).alias(k) for k, e in asked.items()]).select(F.explode(F.array(*[F.struct(F.lit(k).alias("expr"), F.col(f"`{k}`").alias("n")) for k in asked])).alias("x")).select("x.*")


@query(f"WITH {ORDERS} SELECT o_orderstatus, count(*) AS n FROM o WHERE o_orderstatus IN ('F', 'O') AND year(day) = 1996 AND o_orderpriority IS DISTINCT FROM '5-LOW' GROUP BY 1")
def year_and_list_filter(spark, d):
    o = orders(spark, d).filter(F.col("o_orderstatus").isin("F", "O") & (F.year("day") == 1996) & ~F.col("o_orderpriority").eqNullSafe("5-LOW"))
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN regexp_matches(p_name, 'red|blue') THEN 'colour' WHEN regexp_matches(p_name, 'ring|bolt') THEN 'metal' ELSE 'other' END AS bucket, count(*) AS n FROM part GROUP BY 1""")
def regex_buckets(spark, d):
    b = F.when(F.col("p_name").rlike("red|blue"), "colour").when(F.col("p_name").rlike("ring|bolt"), "metal").otherwise("other")
    return t(spark, d, "part").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT l_linenumber * 7 + CAST(l_quantity AS BIGINT) AS n, any_value(CAST(l_linenumber * 7 + CAST(l_quantity AS BIGINT) AS VARCHAR) ||
 CASE WHEN (l_linenumber * 7 + CAST(l_quantity AS BIGINT)) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN (l_linenumber * 7 + CAST(l_quantity AS BIGINT)) % 10 = 1 THEN 'st'
 WHEN (l_linenumber * 7 + CAST(l_quantity AS BIGINT)) % 10 = 2 THEN 'nd' WHEN (l_linenumber * 7 + CAST(l_quantity AS BIGINT)) % 10 = 3 THEN 'rd' ELSE 'th' END) AS label FROM lineitem GROUP BY 1""")
def ordinal_labels(spark, d):
    n = (F.col("l_linenumber") * 7 + F.col("l_quantity").cast("long")).alias("n")
    return t(spark, d, "lineitem").select(n).distinct().withColumn("label", tx.ordinal("n"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL OR json_extract_string(props, '$.speeds') IS NOT NULL) AS n_keyed FROM events GROUP BY 1")
def json_any_key(spark, d):
    has = F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.speeds")).isNotNull()
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(has).alias("n_keyed"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def rolling_filter(spark, d):
    e = t(spark, d, "events").filter(quality.since("ts", "2024-01-20 00:00:00", 7 * 24) & (F.col("ts") <= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {ORDERS}, x AS (SELECT e.event_id, o.o_orderkey, row_number() OVER (PARTITION BY e.event_id ORDER BY o.day DESC, o.o_orderkey DESC) AS n
 FROM events e LEFT JOIN o ON o.o_custkey = e.user_id AND o.day <= CAST(e.ts AS DATE) - (e.event_id % 3000)::INTEGER)
SELECT event_id, o_orderkey FROM x WHERE n = 1""")
def asof_order_for_event(spark, d):
    e = t(spark, d, "events").select("event_id", F.col("user_id").alias("o_custkey"), F.date_sub(F.to_date("ts"), (F.col("event_id") % 3000).cast("int")).alias("at"))
    return rel.asof_join(e, orders(spark, d), "o_custkey", "at", "day", "event_id", "o_orderkey").select("event_id", "o_orderkey")


def as_rated(spark, d):
    return orders(spark, d).select("o_custkey", "o_orderkey", "day", (F.col("o_orderkey") % 10 / 100).alias("tcc"), (F.col("o_orderkey") % 7 / 100).alias("non_spi"))


@query(f"""WITH s AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, (o_orderkey % 10) / 100 AS tcc, (o_orderkey % 7) / 100 AS non_spi FROM orders),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, tcc, non_spi, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ORDER BY s.day DESC, s.o_orderkey DESC) AS n
 FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey LEFT JOIN s ON s.o_custkey = o.o_custkey AND s.day <= CAST(l_shipdate AS DATE))
SELECT l_linenumber, count(*) AS kept FROM x WHERE n = 1 AND NOT coalesce(abs(l_discount - non_spi) < 0.001 AND abs(l_discount - tcc) > 0.003, false) GROUP BY 1""")
def non_spinnaker_exclusion(spark, d):
    li = t(spark, d, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    x = li.join(o, "l_orderkey").select("o_custkey", "l_linenumber", "l_partkey", "l_discount", F.to_date("l_shipdate").alias("at"))
    j = rel.asof_join(x, as_rated(spark, d), "o_custkey", "at", "day", "l_partkey", "o_orderkey")
    other = (F.abs(F.col("l_discount") - F.col("non_spi")) < 0.001) & (F.abs(F.col("l_discount") - F.col("tcc")) > 0.003)
    return j.filter(~F.coalesce(other, F.lit(False))).groupBy("l_linenumber").agg(F.count("*").alias("kept"))


@query(f"""WITH {ORDERS}, y AS (SELECT year(day) AS y, o_custkey, max_by(o_totalprice, (day, o_orderkey)) AS p FROM o WHERE year(day) IN (1996, 1997) GROUP BY 1, 2)
SELECT a.o_custkey, a.p AS before, b.p AS after, round(b.p - a.p, 6) AS delta FROM y a JOIN y b USING (o_custkey) WHERE a.y = 1996 AND b.y = 1997 AND abs(b.p - a.p) > 0.0005""")
def snapshot_diff(spark, d):
    at = lambda y, name: orders(spark, d).filter(F.year("day") == y).groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("day", "o_orderkey")).alias(name))
    j = at(1996, "before").join(at(1997, "after"), "o_custkey")
    return j.withColumn("delta", r6(F.col("after") - F.col("before"))).filter(F.abs("delta") > 0.0005)


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def exists_and_not_exists(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = t(spark, d, "customer").join(o.filter("o_orderstatus = 'F'"), "c_custkey", "left_semi")
    return c.join(o.filter("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer")
def correlated_counts(spark, d):
    per = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
    return t(spark, d, "customer").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "most")


@query("""WITH b AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name || ' - SEC' ELSE p_name END AS name, p_brand AS sail FROM part)
SELECT a.sail, a.name, count(*) AS n FROM b a JOIN b s ON s.sail = a.sail AND s.name = a.name || ' - SEC' GROUP BY 1, 2""")
def secondary_twins(spark, d):
    p = t(spark, d, "part")
    b = p.select(F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" - SEC"))).otherwise(F.col("p_name")).alias("name"), F.col("p_brand").alias("sail"))
    # counts a side first, so equal keys never meet pair by pair
    a = b.groupBy("sail", "name").agg(F.count("*").alias("x"))
    s = b.groupBy("sail", F.col("name").alias("twin")).agg(F.count("*").alias("y"))
    return a.withColumn("twin", F.concat("name", F.lit(" - SEC"))).join(s, ["sail", "twin"]).select("sail", "name", (F.col("x") * F.col("y")).alias("n"))


@query("""WITH own AS (SELECT c_custkey AS boat, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey UNION SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey + 1)
SELECT boat, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY boat ORDER BY o_totalprice ASC NULLS LAST, o_orderkey) AS n FROM own) WHERE n = 1""")
def own_or_twin(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("boat"), F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") + 1)).alias("o_custkey"))
    j = c.join(t(spark, d, "orders"), "o_custkey").select("boat", "o_orderkey", "o_totalprice")
    return rel.pick_per_key(j, ["boat"], [F.col("o_totalprice").asc_nulls_last(), "o_orderkey"]).select("boat", "o_orderkey")


@query("""SELECT a.p_partkey AS a, min(b.p_partkey) AS b, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND a.p_name = b.p_name
 AND abs(a.p_retailprice - b.p_retailprice) < 0.3 GROUP BY 1""")
def tolerance_join(spark, d):
    p = rel.later_within(t(spark, d, "part"), "p_partkey", ["p_brand", "p_name"], "p_retailprice", 0.3)
    return p.select(F.col("p_partkey").alias("a"), F.col("next").alias("b"), "n")


@query("SELECT s_suppkey, any_value(c_custkey) AS c_custkey FROM supplier JOIN customer ON round(s_acctbal) = round(c_acctbal) GROUP BY 1 HAVING count(*) = 1")
def unique_reverse_lookup(spark, d):
    one = t(spark, d, "customer").groupBy(F.round("c_acctbal").alias("b")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("c_custkey")).filter("n = 1")
    return t(spark, d, "supplier").join(one, F.round("s_acctbal") == F.col("b")).select("s_suppkey", "c_custkey")


@query("""WITH p AS (SELECT DISTINCT upper(substr(p_name, 2, 3 + p_size % 4)) AS p FROM part WHERE length(substr(p_name, 2, 3 + p_size % 4)) >= 3), t AS (SELECT DISTINCT p_name AS t FROM part)
SELECT p, count(*) AS n, min(t) AS first FROM p JOIN t ON contains(lower(t), lower(p)) GROUP BY 1""")
def substring_join(spark, d):
    part = t(spark, d, "part")
    patterns = part.select(F.upper(F.substring(F.col("p_name"), F.lit(2), 3 + F.col("p_size") % 4)).alias("p"))
    return matching.contains_pairs(patterns, part.select(F.col("p_name").alias("t"))).groupBy("p").agg(F.count("*").alias("n"), F.min("t").alias("first"))


@query("SELECT 'only_left' AS side, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'only_right', count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_difference(spark, d):
    o = t(spark, d, "orders")
    side = lambda s: o.filter(F.col("o_orderstatus") == s).select("o_custkey").distinct()
    left, right = rel.set_difference(side("F"), side("O"), ["o_custkey"])
    return left.agg(F.lit("only_left").alias("side"), F.count("*").alias("n")).union(right.agg(F.lit("only_right"), F.count("*")))


@query("SELECT 'snapshot' AS kind, o_custkey AS boat, CAST(o_orderdate AS DATE) AS day, o_totalprice AS rating FROM orders UNION ALL SELECT 'race', l_suppkey, CAST(l_shipdate AS DATE), l_quantity FROM lineitem WHERE l_quantity IS NOT NULL")
def history_union(spark, d):
    a = t(spark, d, "orders").select(F.lit("snapshot").alias("kind"), F.col("o_custkey").alias("boat"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("rating"))
    b = t(spark, d, "lineitem").filter("l_quantity IS NOT NULL").select(F.lit("race").alias("kind"), F.col("l_suppkey").alias("boat"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("rating"))
    return a.unionByName(b)


# --- sorts and limits -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 25 OFFSET 50")
def paging(spark, d):
    return rel.page(t(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), [F.desc_nulls_last("p_retailprice"), "p_partkey"], 25, 50)[0]


@query("""WITH a AS (SELECT p_type, avg(p_retailprice) AS m FROM part GROUP BY 1),
x AS (SELECT a.p_type, b.p_type AS other, round(abs(a.m - b.m), 6) AS gap, row_number() OVER (PARTITION BY a.p_type ORDER BY round(abs(a.m - b.m), 6), b.p_type) AS n FROM a JOIN a b ON a.p_type <> b.p_type)
SELECT p_type, other, gap, CAST(n AS INTEGER) AS n FROM x WHERE n <= 3""")
def comparable_types(spark, d):
    a = t(spark, d, "part").groupBy("p_type").agg(F.avg("p_retailprice").alias("m"))
    # of each type only its nearest by order on either side can be among its nearest by distance
    w = Window.orderBy("m", "p_type")
    near = [f(F.struct("p_type", "m"), i).over(w).alias(f"{n}{i}") for i in (1, 2, 3) for f, n in ((F.lag, "a"), (F.lead, "b"))]
    x = a.select("p_type", "m", *near).select("p_type", "m", F.explode(F.array_compact(F.array(*[F.col(f"{n}{i}") for i in (1, 2, 3) for n in "ab"]))).alias("o"))
    gap = r6(F.abs(F.col("m") - F.col("o.m")))
    return rel_top(x.select("p_type", F.col("o.p_type").alias("other"), gap.alias("gap")), "p_type", ["gap", "other"], 3)


def rel_top(df, key, order, k):
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("n") <= k)


@query(f"WITH {RACES} SELECT boat, count(*) FILTER (place = 1) AS wins, round(avg(rating), 6) AS rating FROM r GROUP BY 1 ORDER BY wins DESC, rating, boat LIMIT 5")
def top_five_by_wins(spark, d):
    per = races(spark, d).groupBy("boat").agg(F.count_if(F.col("place") == 1).alias("wins"), r6(F.avg("rating")).alias("rating"))
    return per.orderBy(F.desc("wins"), "rating", "boat").limit(5)


@query(f"""WITH {ORDERS}, band AS (SELECT * FROM o WHERE o_totalprice BETWEEN 100000 AND 200000), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey DESC) AS n FROM band) WHERE n = 1),
act AS (SELECT o_custkey, count(*) AS activity FROM o WHERE day > DATE '1996-06-01' GROUP BY 1) SELECT o_custkey, o_totalprice, activity FROM one JOIN act USING (o_custkey) ORDER BY activity DESC, o_custkey LIMIT 10""")
def rival_watch(spark, d):
    o = orders(spark, d)
    one = rel.latest_per_key(o.filter(F.col("o_totalprice").between(100000, 200000)), "o_custkey", ["day", "o_orderkey"])  # the band before the pick
    act = o.filter(F.col("day") > F.lit("1996-06-01").cast("date")).groupBy("o_custkey").agg(F.count("*").alias("activity"))
    return one.join(act, "o_custkey").select("o_custkey", "o_totalprice", "activity").orderBy(F.desc("activity"), "o_custkey").limit(10)


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice ASC, p_partkey) AS n FROM part) WHERE n = 1")
def winner_selection(spark, d):
    return rel.pick_per_key(t(spark, d, "part"), ["p_brand"], [F.desc("p_size"), "p_retailprice", "p_partkey"]).select("p_brand", "p_partkey")


# --- upserts ----------------------------------------------------------------------------------------------------------


def halves(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    old = c.filter("c_custkey % 3 <> 0")
    new = c.filter("c_custkey % 2 = 0 OR c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return old, new


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_rows(spark, d):
    old, new = halves(spark, d)
    return rel.upsert(old, new.withColumn("_batch", F.col("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def insert_ignore_rows(spark, d):
    old, new = halves(spark, d)
    return rel.insert_ignore(old, new, ["c_custkey"])


@query("SELECT p_brand, min(p_size) AS first_size, max(p_size) AS last_size FROM part GROUP BY 1")
def widen_years(spark, d):
    p = t(spark, d, "part")
    span = lambda x: x.groupBy("p_brand").agg(F.min("p_size").alias("first_size"), F.max("p_size").alias("last_size"))
    return sinks.widen_years(span(p.filter("p_partkey % 2 = 0")), span(p.filter("p_partkey % 2 = 1")), ["p_brand"], "first_size", "last_size")


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus IN ('O', 'P') THEN coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'new' END, o_orderpriority) ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def guarded_upsert(spark, d):
    old = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = old.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, "new"))
    return sinks.guarded_upsert(old, new, "o_orderkey", "o_orderstatus", ["O", "P"], ["o_orderpriority"])


@query("SELECT s_suppkey, s_name, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END, c_acctbal) AS s_acctbal FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey")
def fill_nulls(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("s_acctbal"))
    other = t(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"))
    return rel.fill_null(s, other, "s_suppkey", ["s_acctbal"])


@query("""WITH old AS (SELECT p_partkey, DATE '2024-01-01' AS day, p_size FROM part), new AS (SELECT p_partkey, DATE '2024-02-01' AS day, p_size + (p_partkey % 2) AS p_size FROM part)
SELECT o.p_partkey, CASE WHEN o.p_size = n.p_size THEN n.day ELSE o.day END AS day, CAST(o.p_size AS BIGINT) AS p_size, false AS was_new FROM old o JOIN new n USING (p_partkey)
UNION ALL SELECT n.p_partkey, n.day, n.p_size, true FROM old o JOIN new n USING (p_partkey) WHERE o.p_size <> n.p_size""")
def change_detecting_upsert(spark, d):
    p = t(spark, d, "part")
    at = lambda day, size: p.select("p_partkey", F.lit(day).cast("date").alias("day"), size.cast("long").alias("p_size"))
    return sinks.change_upsert(at("2024-01-01", F.col("p_size")), at("2024-02-01", F.col("p_size") + F.col("p_partkey") % 2), ["p_partkey"], "day", ["p_size"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_by_ids(spark, d):
    ids = t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.delete_ids(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ids, "o_orderkey")


@query("""WITH k AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE o_orderpriority END AS pri, o_totalprice AS price FROM orders) SELECT * FROM k""")
def corrections_applied(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("pri"), F.col("o_totalprice").alias("price"))
    fix = o.filter("id % 4 = 0").select(F.col("id").alias("key"), F.lit("pri").alias("column"), F.lit("x").alias("value"), F.lit("pending").alias("status"), F.col("id"))
    return sinks.apply_corrections(o.withColumnRenamed("id", "key"), fix, "key").withColumnRenamed("key", "id")
