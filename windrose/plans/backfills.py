"""Queries on backfills, typed statistics, result upserts and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backfill
from .base import LATEST, query, t
from .read_side import latest

S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


@query("""WITH l AS (SELECT o_custkey, max_by(o_orderkey % 6, (o_orderdate, CASE o_orderkey % 6 WHEN 0 THEN 'SUN FAST' WHEN 1 THEN 'J/109 ' WHEN 2 THEN 'Odd one' WHEN 3 THEN 'first 35' ELSE 'BIG BOAT' END)) AS c FROM orders WHERE o_orderkey % 6 <> 5 GROUP BY 1)
SELECT c_custkey AS boat_id, CASE WHEN c_custkey % 4 = 0 THEN 'Own' WHEN c = 0 THEN 'Sun Fast' WHEN c = 1 THEN 'J 109' WHEN c = 2 THEN 'Odd one' WHEN c = 3 THEN 'First 35' WHEN c = 4 THEN 'Big Boat' END AS design, CASE WHEN c_custkey % 4 = 0 OR c IS NULL THEN NULL WHEN c IN (1, 3) THEN 'lookup' ELSE 'direct' END AS how FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def designs_from_certificates(spark, d):
    k = F.col("o_orderkey") % 6
    c = t(spark, d, "orders").select(F.col("o_custkey").alias("boat_id"), F.when(k == 0, "SUN FAST").when(k == 1, "J/109 ").when(k == 2, "Odd one").when(k == 3, "first 35").when(k == 4, "BIG BOAT").otherwise("").alias("class_name"), F.col("o_orderdate").alias("day"))
    boats = t(spark, d, "customer").select(F.col("c_custkey").alias("boat_id"), F.when(F.col("c_custkey") % 4 == 0, "Own").alias("design"))
    names = spark.createDataFrame([("j/109", "J 109"), ("F35", "First 35")], "alias string, name string")
    return backfill.designs_from_certificates(boats, c, names)


@query("""WITH b AS (SELECT p_name || CASE p_partkey % 4 WHEN 0 THEN ' - SEC' WHEN 1 THEN ' (SH)' ELSE '' END AS name, p_size % 3 AS sail, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS design, p_name AS plain, p_partkey % 4 < 2 AS second FROM part)
SELECT coalesce(design, 'UNKNOWN') AS design, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM b p WHERE p.sail = b.sail AND p.name = b.plain)) AS matched, count(*) FILTER (NOT EXISTS (SELECT 1 FROM b p WHERE p.sail = b.sail AND p.name = b.plain)) AS unmatched FROM b WHERE second GROUP BY 1""")
def second_certificates(spark, d):
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 4 == 0, " - SEC").when(k % 4 == 1, " (SH)").otherwise(""))
    return backfill.second_certificates(t(spark, d, "part").select(name.alias("boat_name"), (F.col("p_size") % 3).alias("boat_sail"), F.when(k % 3 > 0, F.col("p_brand")).alias("design")))


@query("""WITH r AS (SELECT o_custkey AS b, bool_or(o_orderkey % 17 = 0) AS club, bool_or(o_orderkey % 5 = 0) AS rorc FROM orders GROUP BY 1) SELECT c_custkey AS boat_id, CASE WHEN c_custkey % 3 = 0 THEN 'NZL' WHEN club THEN 'AUS' WHEN rorc THEN 'GBR' END AS country FROM customer LEFT JOIN r ON b = c_custkey""")
def countries_from_results(spark, d):
    k = F.col("o_orderkey")
    r = t(spark, d, "orders").select(F.col("o_custkey").alias("boat_id"), F.when(k % 17 == 0, "RSYS").when(k % 2 == 0, "XYZ").alias("organizing_club"), F.when(k % 5 == 0, "rorc").otherwise("club").alias("source"))
    boats = t(spark, d, "customer").select(F.col("c_custkey").alias("boat_id"), F.when(F.col("c_custkey") % 3 == 0, "NZL").alias("country"))
    return backfill.countries_from_results(boats, r)


@query(f"""WITH {LATEST} SELECT c_mktsegment AS design, count(*) AS n_boats, count(CASE WHEN c_custkey % 2 = 0 THEN 1 END) AS n_with_certs, CAST(round(avg(o_totalprice), 3) AS DOUBLE) AS mean_price, CAST(round(stddev(o_totalprice), 3) AS DOUBLE) AS std_price, CAST(min(o_totalprice) AS DOUBLE) AS min_price, CAST(max(o_totalprice) AS DOUBLE) AS max_price
 FROM customer LEFT JOIN l ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 2""")
def class_statistics(spark, d):
    b = t(spark, d, "customer").join(latest(spark, d), F.col("o_custkey") == F.col("c_custkey"), "left")
    b = b.select(F.col("c_mktsegment").alias("design"), F.col("o_totalprice").alias("price"), F.when(F.col("c_custkey") % 2 == 0, 1).alias("cert"))
    s = backfill.class_statistics(b, "design", {"price": "decimal(14,3)"}, "cert")
    return s.select("design", "n_boats", "n_with_certs", *[F.col(f"{x}_price").cast("double").alias(f"{x}_price") for x in ("mean", "std", "min", "max")])


RESULT = "CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 40 END AS boat_id, 'N' || (o_orderkey % 3) AS boat_name, o_orderpriority AS event_name, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS race_name, CASE WHEN o_orderkey % 5 > 0 THEN year(CAST(o_orderdate AS DATE)) END AS event_date"


@query(f"""WITH x AS (SELECT o_orderkey AS batch, {RESULT}, o_orderkey AS place, CASE WHEN o_orderkey % 4 < 2 THEN 'new' END AS transport, o_orderkey % 100 AS created_at FROM orders),
o AS (SELECT * FROM (SELECT * FROM x WHERE batch % 2 = 1) QUALIFY row_number() OVER (PARTITION BY boat_id, CASE WHEN boat_id IS NULL THEN boat_name END, event_name, race_name, event_date ORDER BY batch) = 1),
n AS (SELECT * FROM x WHERE batch % 2 = 0), a AS (SELECT *, 0 AS new FROM o UNION ALL SELECT *, 1 FROM n), w AS (SELECT *, min(CASE WHEN new = 0 THEN created_at END) OVER p AS was, row_number() OVER (PARTITION BY boat_id, CASE WHEN boat_id IS NULL THEN boat_name END, event_name, race_name, event_date ORDER BY new DESC, batch DESC) AS r FROM a WINDOW p AS (PARTITION BY boat_id, CASE WHEN boat_id IS NULL THEN boat_name END, event_name, race_name, event_date))
SELECT boat_id, boat_name, event_name, race_name, event_date, place, CASE WHEN new = 1 THEN coalesce(transport, 'legacy') ELSE transport END AS transport, coalesce(was, created_at) AS created_at FROM w WHERE r = 1""")
def upsert_results(spark, d):
    k = F.col("o_orderkey")
    x = t(spark, d, "orders").select(
        k.alias("batch"), F.when(k % 3 > 0, F.col("o_custkey") % 40).alias("boat_id"), F.concat(F.lit("N"), S(k % 3)).alias("boat_name"), F.col("o_orderpriority").alias("event_name"), F.when(k % 4 > 0, F.col("o_orderstatus")).alias("race_name"),
        F.when(k % 5 > 0, F.year("o_orderdate").cast("long")).alias("event_date"), k.alias("place"), F.when(k % 4 < 2, "new").alias("transport"), (k % 100).alias("created_at"),
    )
    key = [F.col("boat_id"), F.when(F.col("boat_id").isNull(), F.col("boat_name")), F.col("event_name"), F.col("race_name"), F.col("event_date")]
    old = backfill.pick_per_key(x.filter("batch % 2 = 1"), key, [F.col("batch")]).drop("batch")  # one half is there, the other comes
    return backfill.upsert_results(old, x.filter("batch % 2 = 0"))


@query("""SELECT 'country' AS kind, CAST(n AS VARCHAR) AS name, orphans AS n FROM (SELECT c_nationkey AS n, count(*) AS orphans FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'reason', reason, count(*) AS n FROM (SELECT 'r' || (event_id % 13) AS reason, ts, event_type FROM events) WHERE event_type = 'view' AND ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""")
def orphans_report(spark, d):
    c = t(spark, d, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 3 > 0, 1).alias("boat_id"))
    e = t(spark, d, "events").select(F.lit("match").alias("event_type"), F.when(F.col("event_type") == "view", "orphan").otherwise("ok").alias("status"), F.concat(F.lit("r"), S(F.col("event_id") % 13)).alias("reason"), F.col("ts").alias("created_at"))
    countries, reasons = backfill.orphans_report(c, e, "2024-01-20 00:00:00", "c_nationkey")
    return countries.select(F.lit("country").alias("kind"), S("c_nationkey").alias("name"), F.col("orphans").alias("n")).union(reasons.select(F.lit("reason"), "reason", "n"))


@query("SELECT c_nationkey, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS with_detail, count(*) FILTER (NOT coalesce(c_acctbal > 0, false)) AS missing_detail FROM customer GROUP BY 1")
def detail_coverage(spark, d):
    return backfill.detail_coverage(t(spark, d, "customer").select("c_nationkey", F.when(F.col("c_acctbal") > 0, 1).alias("gph")), "c_nationkey", "gph")


@query("""WITH e AS (SELECT user_id AS run, ts AS moment, event_id, CASE WHEN event_type = 'view' THEN 'start' ELSE 'end' END AS kind FROM events), f AS (SELECT run, moment, event_id, row_number() OVER (PARTITION BY run ORDER BY moment DESC) AS r FROM e WHERE kind = 'end')
SELECT e.run, min(CASE WHEN kind = 'start' THEN e.moment END) AS started_at, any_value(f.moment) AS completed_at, CASE WHEN any_value(f.run) IS NULL THEN 'running' WHEN any_value(f.event_id) % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, any_value(f.event_id) AS records_found FROM e LEFT JOIN f ON f.run = e.run AND f.r = 1 GROUP BY 1""")
def run_log(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("run"), F.when(F.col("event_type") == "view", "start").otherwise("end").alias("kind"), F.col("ts").alias("at"), F.lit("x").alias("source"), F.when(F.col("event_id") % 2 > 0, "failed").alias("status"), F.col("event_id").alias("records_found"), *[F.lit(None).cast("long").alias(c) for c in ("records_new", "records_updated")], F.lit(None).cast("string").alias("error"))
    return backfill.run_log(e).select("run", "started_at", "completed_at", "status", "records_found")
