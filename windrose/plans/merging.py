"""Queries on merges over several tables: customers as boats, orders as their certificates and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merges
from .base import query, t

S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")

# 9 loses to 8 and 8 to 7; 11 and 12 lose to each other, which is refused; 6 loses to one that isn't there
PAIRS = """b AS (SELECT c_custkey AS id, c_name AS name FROM customer),
m AS (SELECT id AS loser, CASE id % 20 WHEN 9 THEN id - 2 ELSE id - 1 END AS winner FROM b WHERE id % 20 IN (8, 9, 14)),
u AS (SELECT loser AS boat, winner AS target, loser FROM m UNION SELECT winner, winner, NULL FROM m)"""
CERTIFICATES = """c AS (SELECT min(o_orderkey) AS id, o_custkey AS boat, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 END AS cert_number, max(CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderdate AS DATE) END) AS issue_date FROM orders GROUP BY 2, 3)"""
SNAPSHOTS = """s AS (SELECT min(o_orderkey) AS id, o_custkey AS boat, month(CAST(o_orderdate AS DATE)) AS snapshot_date, max(CASE WHEN o_orderkey % 5 > 0 THEN year(CAST(o_orderdate AS DATE)) END) AS cert_year FROM orders GROUP BY 2, 3)"""


def boats(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def pairs(spark, d):
    k = F.col("id")
    return boats(spark, d).filter((k % 20).isin(6, 8, 9, 11, 12, 14)).select(k.alias("loser"), F.when(k % 20 == 11, k + 1).when(k % 20 == 6, -k).otherwise(k - 1).alias("winner"))


def merged(spark, d, only):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    o = t(spark, d, "orders")
    tables = {
        "certificates": o.groupBy(F.col("o_custkey").alias("boat"), F.when(k % 7 > 0, k % 7).alias("cert_number")).agg(F.min(k).alias("id"), F.max(F.when(k % 13 > 0, day)).alias("issue_date")),
        "snapshots": o.groupBy(F.col("o_custkey").alias("boat"), F.month(day).cast("long").alias("snapshot_date")).agg(F.min(k).alias("id"), F.max(F.when(k % 5 > 0, F.year(day))).cast("long").alias("cert_year")),
    }
    number, date = F.col("cert_number"), F.col("snapshot_date")
    rules = {
        "certificates": merges.Rule("boat", "id", "certificate", [number], [number], F.coalesce("issue_date", F.lit("0001-01-01").cast("date"))),
        "snapshots": merges.Rule("boat", "id", "tcc_snapshot", [date], [], F.coalesce("cert_year", F.lit(0))),
    }
    return merges.merge_boats(boats(spark, d), pairs(spark, d), {n: tables[n].select("id", "boat", *[c for c in tables[n].columns if c not in ("id", "boat")]) for n in only}, rules)


def best(table, unique, rank):
    """SQL: of the rows of boats that become one, the best of each key, the winner's own before those of losers."""
    return f"""SELECT id, coalesce(target, {table}.boat) AS boat, {unique}, {rank[0]}, row_number() OVER (PARTITION BY coalesce(target, {table}.boat), {unique}{rank[2]} ORDER BY coalesce({rank[0]}, {rank[1]}) DESC, loser NULLS FIRST) AS n
 FROM {table} LEFT JOIN u ON u.boat = {table}.boat"""


@query(f"""WITH {PAIRS}, {CERTIFICATES}, r AS ({best("c", "cert_number", ("issue_date", "DATE '0001-01-01'", ", CASE WHEN cert_number IS NULL THEN id END"))}) SELECT id, boat, cert_number, issue_date FROM r WHERE n = 1""")
def merged_certificates(spark, d):
    return merged(spark, d, ["certificates"])["certificates"]


@query(f"""WITH {PAIRS}, {SNAPSHOTS}, r AS ({best("s", "snapshot_date", ("cert_year", "0", ""))}) SELECT id, boat, snapshot_date, cert_year FROM r WHERE n = 1""")
def merged_snapshots(spark, d):
    return merged(spark, d, ["snapshots"])["snapshots"]


@query(f"""WITH {PAIRS} SELECT id, name FROM b WHERE id NOT IN (SELECT loser FROM m)""")
def merged_boats(spark, d):
    return merged(spark, d, [])["boats"]


def falls(table, unique, rank, kind):
    """SQL: the rows that go, by comparing each with those before and after it: the first that is no worse drops it."""
    x = f"x AS (SELECT {table}.*, target, loser, coalesce(loser, -1) AS turn, coalesce({rank[0]}, {rank[1]}) AS rank FROM {table} JOIN u ON u.boat = {table}.boat WHERE {unique} IS NOT NULL)"
    earlier = f"SELECT x.id, x.loser, '{kind}_collision_dropped' AS kind FROM x WHERE EXISTS (SELECT 1 FROM x y WHERE y.target = x.target AND y.{unique} = x.{unique} AND y.turn < x.turn AND y.rank >= x.rank)"
    later = f"SELECT x.id, min(y.loser) AS loser, '{kind}_collision_replaced_winner' AS kind FROM x JOIN x y ON y.target = x.target AND y.{unique} = x.{unique} AND y.turn > x.turn AND y.rank > x.rank WHERE x.id NOT IN (SELECT id FROM e) GROUP BY x.id"
    return f"WITH {x}, e AS ({earlier}) SELECT * FROM e UNION ALL {later}"


@query(f"""WITH {PAIRS}, {CERTIFICATES}, {SNAPSHOTS}, g AS (SELECT * FROM ({falls("c", "cert_number", ("issue_date", "DATE '0001-01-01'"), "certificate")}) UNION ALL SELECT * FROM ({falls("s", "snapshot_date", ("cert_year", "0"), "tcc_snapshot")}))
SELECT m.winner AS winner_id, m.loser AS loser_id, any_value(b.name) AS name, count(kind) AS n_gone, coalesce(string_agg(kind || ':' || g.id, ',' ORDER BY kind || ':' || g.id), '') AS gone FROM m JOIN b ON b.id = m.loser LEFT JOIN g ON g.loser = m.loser GROUP BY 1, 2""")
def merge_audit(spark, d):
    a = merged(spark, d, ["certificates", "snapshots"])["boat_merges"]
    row = F.from_json("loser_snapshot", "boat struct<id:long,name:string>, extras array<struct<kind:string,row:string>>").alias("s")
    gone = F.array_sort(F.transform("s.extras", lambda x: F.concat(x["kind"], F.lit(":"), F.get_json_object(x["row"], "$.id"))))
    return a.select("winner_id", "loser_id", row).select("winner_id", "loser_id", F.col("s.boat.name").alias("name"), F.size("s.extras").cast("long").alias("n_gone"), F.array_join(gone, ",").alias("gone"))
