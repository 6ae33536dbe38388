"""Queries on the readers: lists, certificates, pages and lines, written as text from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import sinks
from ..sources import files
from .base import query, t


def k():
    return F.col("p_partkey")


S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def listed(spark, d):
    """Rating lists as their files hold them: a heading a column, all text."""
    return t(spark, d, "part").select(
        F.concat(F.when(k() % 4 == 0, F.concat(F.lit(" "), "p_name", F.lit(" - SEC"))).otherwise(F.col("p_name")), F.lit(" ")).alias("Boat Name"),
        F.concat(F.when(k() % 3 == 0, "GBR").when(k() % 3 == 1, "D").otherwise("Q"), S(k())).alias("Sail No"),
        S(k() % 500).alias("Cert No"),
        F.when(k() % 2 == 0, "01/02/2023").otherwise("2023-03-04").alias("Valid Date"),
        F.when(k() % 9 > 0, F.concat(F.lit("0.9"), F.lpad(S(k() % 100), 2, "0"))).otherwise(" ").alias("TCC"),
        F.concat(S("p_size"), F.lit(".7")).alias(" Crew"),
        F.when(k() % 7 == 0, "x").otherwise(S("p_size")).alias("LH"),
        F.lit("").alias("Secondary"),
        F.concat(F.lit("tcc_"), S(2010 + k() % 13), F.lit("_a.csv")).alias("_file"),
    )


LISTED = """l AS (SELECT p_partkey AS k, trim(p_name) AS boat_name, p_partkey % 4 = 0 AS is_secondary, CASE p_partkey % 3 WHEN 0 THEN 'GBR' WHEN 1 THEN 'D' ELSE 'Q' END || p_partkey AS sail_number, CASE p_partkey % 3 WHEN 0 THEN 'GBR' WHEN 1 THEN 'GER' END AS country,
 CAST(p_partkey % 500 AS VARCHAR) AS cert_number, CASE WHEN p_partkey % 2 = 0 THEN DATE '2023-02-01' ELSE DATE '2023-03-04' END AS issue_date, 0.9 + CAST(p_partkey % 100 AS DOUBLE) / 1000 AS tcc, CAST(p_size AS INTEGER) AS crew, CASE WHEN p_partkey % 7 > 0 THEN CAST(p_size AS DOUBLE) END AS lh,
 2010 + p_partkey % 13 AS yr, 'tcc_' || (2010 + p_partkey % 13) || '_a.csv' AS file FROM part WHERE p_partkey % 9 > 0)"""


@query(f"WITH {LISTED} SELECT boat_name, is_secondary, sail_number, country, cert_number, issue_date, round(tcc, 4) AS tcc, crew, lh FROM l")
def rating_list_rows(spark, d):
    r = files.rating_rows(listed(spark, d))
    return r.select("boat_name", "is_secondary", "sail_number", "country", "cert_number", "issue_date", F.round(F.col("tcc").cast("double"), 4).alias("tcc"), "crew", F.col("lh").cast("double").alias("lh"))


@query(f"WITH {LISTED} SELECT cert_number, CAST(max(yr) AS INTEGER) AS \"year\" FROM l GROUP BY 1")
def certificate_years(spark, d):
    return files.certificate_index(files.rating_rows(listed(spark, d))).select("cert_number", "year")


@query(f"WITH {LISTED} SELECT cert_number, min(file) AS file FROM l GROUP BY 1")
def first_certificate_files(spark, d):
    return files.all_known_certificates(files.rating_rows(listed(spark, d))).select("cert_number", F.col("_file").alias("file"))


@query("SELECT p_partkey, 'N' || p_partkey AS name, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS gph FROM part")
def certificate_elements(spark, d):
    xml = F.concat(F.when(k() % 2 == 0, "﻿").otherwise(""), F.lit("<ROW><YachtName>N"), S(k()), F.lit("</YachtName>"), F.when(k() % 3 > 0, F.concat(F.lit("<GPH>"), S("p_retailprice"), F.lit("</GPH>"))).otherwise(""), F.lit("<Other>1</Other></ROW>"))
    c = t(spark, d, "part").select("p_partkey", files.certificates_from_xml(xml, "YachtName string, GPH double").alias("c"))
    return c.select("p_partkey", F.col("c.YachtName").alias("name"), F.col("c.GPH").alias("gph"))


@query("SELECT p_partkey, p_retailprice AS gph, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size END AS DOUBLE) AS area_main, CAST(p_size + 1 AS DOUBLE) AS area_jib, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2 * p_size + 1 END AS DOUBLE) AS sail_area_upwind FROM part")
def performance_details(spark, d):
    detail = F.to_json(F.struct(F.col("p_retailprice").alias("GPH"), F.when(k() % 2 == 0, S("p_size")).alias("AreaMain"), (F.col("p_size") + 1).alias("Area_Jib")))
    p = t(spark, d, "part").withColumn("detail", detail)
    return p.select("p_partkey", *files.performance_fields("detail")).select("p_partkey", "gph", "area_main", "area_jib", "sail_area_upwind")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'S' ELSE 'Unknown Series' END AS event_name, DATE '2024-05-01' AS event_date, 'Boat ' || p_partkey AS boat_name, CASE WHEN p_partkey % 3 > 0 THEN 'AUS' || p_size ELSE '' END AS sail_number, CAST(p_size AS VARCHAR) AS hull_id,
 CASE WHEN p_partkey % 7 > 0 THEN p_retailprice END AS rating_value FROM part WHERE p_partkey % 5 > 0""")
def result_lists(spark, d):
    one = F.struct(
        F.when(k() % 2 == 0, "S").alias("series"), F.lit("1 May 2024").alias("race_date"), F.when(k() % 3 > 0, F.concat(F.lit(" AUS"), S("p_size"))).alias("sail_no"), S("p_size").alias("boat_name"),
        F.when(k() % 5 > 0, F.concat(F.lit("Boat "), S(k()), F.lit(" "))).otherwise(" ").alias("skipper"), F.when(k() % 7 > 0, S("p_retailprice")).otherwise("n/a").alias("irc_tcc"),
    )
    p = t(spark, d, "part").select(k().alias("id"), F.to_json(F.array(one)).alias("body"))
    return files.list_rows(p, "body").select("id", "event_name", "event_date", "boat_name", "sail_number", "hull_id", "rating_value")


@query("""WITH c AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT k AS "key", CAST(p AS INTEGER) AS place, 'Boat & ' || c_custkey AS boat_name, 'GBR' || c_custkey AS sail_number, CAST(CASE WHEN c_custkey % 3 > 0 THEN 1.25 END AS DOUBLE) AS rating, CAST(n AS INTEGER) AS fleet_size FROM c""")
def result_tables(spark, d):
    """Pages with a table of results beside one of something else, cells without end marks."""
    c = F.col("c_custkey")
    row = F.concat(F.lit("<tr><td>{}.<td>Boat &amp; "), S(c), F.lit("<td class=x> GBR"), S(c), F.lit("\n</td><td>"), F.when(c % 3 > 0, "1.25").otherwise("-"), F.lit("</td>"))
    rows = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct(c.alias("c"), row.alias("r")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x, i: F.replace(x["r"], F.lit("{}"), (i + 1).cast("string"))), "")
    page = F.concat(F.lit("<html><table><tr><td>Menu</td><td>Home</td></tr></table><table class='res big'><caption>Div 1</caption><tr><th>Rank<th>Boat Name<th>Sail No<th>TCC</tr>"), body, F.lit("</table></html>"))
    cells = files.html_cells(rows.select("k", page.alias("html")), "k", "html")
    return files.result_rows(cells, only_class="res", only_caption="Div").select("key", "place", "boat_name", "sail_number", "rating", "fleet_size")


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 90 + 1 END AS INTEGER) AS place, 'AUS' || (p_partkey % 1000) AS sail_number, 'FAST BOAT' AS boat_name, CASE WHEN p_partkey % 3 > 0 THEN '3:04:05' END AS elapsed, CAST(1.012 AS DOUBLE) AS rating, CASE WHEN p_partkey % 3 > 0 THEN 'finished' ELSE 'DNF' END AS status FROM part""")
def result_lines(spark, d):
    sail = F.concat(F.lit("AUS"), S(k() % 1000), F.lit(" FAST BOAT "))
    line = F.when(k() % 3 > 0, F.concat(S(k() % 90 + 1), F.lit("  "), sail, F.lit("10:00:00 13:04:05 3:04:05 2:59:59 1.012"))).otherwise(F.concat(sail, F.lit("1.012")))
    r = files.line_rows(t(spark, d, "part").select("p_partkey", line.alias("line")), "line")
    return r.select("p_partkey", "place", "sail_number", "boat_name", "elapsed", "rating", "status")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'A B C' ELSE 'X' END AS name, p_partkey % 3 = 0 AS short, CAST(CASE WHEN p_partkey % 4 > 0 THEN p_size END AS INTEGER) AS whole, CAST(p_size AS VARCHAR) AS hull, CASE WHEN p_partkey % 5 > 0 THEN 'GBR' END AS office,
 CASE WHEN p_size BETWEEN 20 AND 30 THEN 'Sunfast 3300' END AS design, DATE '2024-05-09' AS day, [1234.5, CAST(p_size AS DOUBLE)] AS numbers, '{"a":' || p_partkey || '}' AS body FROM part""")
def text_cleanup(spark, d):
    name = F.when(k() % 2 == 0, " a  b c - SEC ").otherwise("x")
    dates = F.element_at(F.array(*map(F.lit, ("2024-05-09", "09/05/2024", "9 May 2024", "May 9, 2024", "2024-05-09T10:00:00", "Race 2 (9/5/2024)"))), (k() % 6 + 1).cast("int"))
    return t(spark, d, "part").select(
        "p_partkey", tx.normalize_name(name).alias("name"), tx.ambiguous_sail(F.when(k() % 3 == 0, " 12-34").otherwise("GBR12")).alias("short"), tx.safe_int(F.when(k() % 4 > 0, F.concat(F.lit(" "), S("p_size"), F.lit(".9 "))).otherwise("n/a")).alias("whole"),
        tx.hull_number(F.concat(F.lit("gbr-"), S("p_size"))).alias("hull"), tx.country_of_office(F.when(k() % 5 > 0, "GBR").otherwise("MU_")).alias("office"), tx.design_from_hull(F.when(F.col("p_size").between(20, 30), "10.0").otherwise("11"), F.lit("3.4")).alias("design"),
        tx.flexible_date(dates).alias("day"), tx.numbers_in(F.concat(F.lit("of 1,234.5 and "), S("p_size"), F.lit(" m"))).alias("numbers"), sinks.json_row(k().alias("a")).alias("body"),
    )


@query("""SELECT p_partkey, p_name, 'after' AS kind, CASE WHEN p_partkey = 7 THEN 99 ELSE p_size END AS p_size, NULL AS old FROM part UNION ALL SELECT 7, p_name, 'audit', 99, CAST(p_size AS VARCHAR) FROM part WHERE p_partkey = 7""")
def audited_cell(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_size")
    after, audit = sinks.audited_update(p, "p_partkey", 7, "p_size", 99, "ann", "2024-05-01 10:00:00")
    audit = audit.join(p.select(S(k()).alias("pk_value"), "p_name"), "pk_value")
    return after.select("p_partkey", "p_name", F.lit("after").alias("kind"), "p_size", F.lit(None).cast("string").alias("old")).unionByName(audit.select(F.col("pk_value").cast("long").alias("p_partkey"), "p_name", F.lit("audit").alias("kind"), F.col("new").cast("int").alias("p_size"), "old"))
