"""Queries on operators that work by ranges of an order, whatever a group's size."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranges
from .base import ORDERS, orders, query, r6, t


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders), x AS (SELECT e.event_id, o.o_orderkey, o.o_totalprice FROM (SELECT event_id, CAST(ts AS DATE) - (event_id % 9000)::INTEGER AS at FROM events) e
 ASOF LEFT JOIN (SELECT day, max(o_orderkey) AS o_orderkey, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM o GROUP BY 1) o ON e.at >= o.day) SELECT event_id, o_orderkey, o_totalprice FROM x""")
def asof_one_key(spark, d):
    """One key holds all orders and events."""
    o = orders(spark, d).select(F.lit(1).alias("k"), "o_orderkey", "day", "o_totalprice")
    e = t(spark, d, "events").select(F.lit(1).alias("k"), "event_id", F.date_sub(F.to_date("ts"), (F.col("event_id") % 9000).cast("int")).alias("at"))
    return ranges.asof_by_ranges(e, o, "k", "at", "day", "event_id", "o_orderkey").select("event_id", "o_orderkey", "o_totalprice")


SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("""SELECT l_returnflag, l_linenumber % 2 AS odd, count(v) AS n, list_transform([quantile_cont(v, 0.05), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75), quantile_cont(v, 0.95)], lambda x: round(x, 6)) AS q
 FROM (SELECT *, CASE WHEN l_linenumber <> 2 OR l_returnflag <> 'A' THEN l_extendedprice END AS v FROM lineitem) GROUP BY 1, 2""")
def price_quantiles(spark, d):
    """Six groups of a sixth of all line items each."""
    v = F.when((F.col("l_linenumber") != 2) | (F.col("l_returnflag") != "A"), F.col("l_extendedprice"))
    li = t(spark, d, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 2).alias("odd"), v.alias("v"))
    q = ranges.group_quantiles(li, ["l_returnflag", "odd"], "v", SHARES)
    return q.withColumn("q", F.transform("q", lambda x: F.round(x, 6)))


@query("""SELECT l_returnflag, count(*) AS n, unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS share, true AS near FROM lineitem GROUP BY 1""")
def sketched_quantiles(spark, d):
    """Quantiles from sketches of each month merged, held against the ranks that the values really have."""
    li = t(spark, d, "lineitem").select("l_returnflag", F.trunc("l_shipdate", "month").alias("month"), F.col("l_extendedprice").alias("v"))
    q = ranges.merged_quantiles(ranges.quantile_sketches(li, ["l_returnflag", "month"], "v"), ["l_returnflag"], SHARES)
    below = li.join(q.select("l_returnflag", "q", F.col("n").alias("whole")), "l_returnflag").groupBy("l_returnflag").agg(F.max("whole").alias("n"), *[F.count_if(F.col("v") < F.get("q", F.lit(i))).alias(f"lo{i}") for i in range(5)], *[F.count_if(F.col("v") <= F.get("q", F.lit(i))).alias(f"hi{i}") for i in range(5)])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), ((F.col(f"lo{i}") / F.col("n") <= s + 2 * ranges.RANK_ERROR) & (F.col(f"hi{i}") / F.col("n") >= s - 2 * ranges.RANK_ERROR)).alias("near")) for i, s in enumerate(SHARES)]))
    return below.select("l_returnflag", "n", each.alias("e")).select("l_returnflag", "n", "e.share", "e.near")


@query(f"""WITH {ORDERS}, p AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos FROM o WHERE o_totalprice IS NOT NULL),
x AS (SELECT a.o_orderkey, b.o_orderkey AS other, b.o_totalprice - a.o_totalprice AS d, b.pos - a.pos AS far, b.pos FROM p a JOIN p b ON b.pos BETWEEN a.pos - 3 AND a.pos + 3 AND b.pos <> a.pos),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(d), abs(far), pos) AS INTEGER) AS n FROM x) SELECT o_orderkey, other, round(abs(d), 6) AS gap, n FROM r WHERE n <= 3""")
def nearest_rivals(spark, d):
    return ranges.nearest(orders(spark, d), "o_orderkey", "o_totalprice", 3).withColumn("gap", r6("gap"))
