"""Queries on certificate pages and club sheets, written as words, lines and cells from parts and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import certificates, club
from .base import query, t

S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def k():
    return F.col("p_partkey")


@query("""WITH RECURSIVE w AS (SELECT p_partkey // 6 AS cert, p_partkey % 2 AS page, round_even(p_partkey * 7 % 23 + j * 3.25, 0) AS top, CAST((p_partkey * 13 + j * 29) % 97 AS DOUBLE) AS x, CASE j WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type ELSE CAST(p_size AS VARCHAR) END AS text FROM part, range(4) r(j)),
s AS (SELECT cert, page, min(top) AS top FROM w GROUP BY 1, 2 UNION ALL SELECT s.cert, s.page, min(w.top) FROM s JOIN w ON w.cert = s.cert AND w.page = s.page AND w.top > s.top + 5 GROUP BY s.cert, s.page),
n AS (SELECT cert, page, top, CAST(row_number() OVER (PARTITION BY cert, page ORDER BY top) AS INTEGER) AS line FROM s)
SELECT w.cert, w.page, line, string_agg(text, ' ' ORDER BY w.top, x, text) AS text FROM w JOIN n ON n.cert = w.cert AND n.page = w.page AND w.top BETWEEN n.top AND n.top + 5 GROUP BY 1, 2, 3""")
def certificate_lines(spark, d):
    """Words at scattered places, so that lines begin where a fold over their tops puts them."""
    j = F.explode(F.array(*[F.struct(F.lit(i).alias("j"), S(c).alias("text")) for i, c in enumerate(("p_name", "p_brand", "p_type", "p_size"))]))
    w = t(spark, d, "part").select(F.expr("p_partkey div 6").alias("cert"), (k() % 2).alias("page"), "p_partkey", j.alias("w"))
    w = w.select("cert", "page", (k() * 7 % 23 + F.col("w.j") * 3.25).alias("top"), ((k() * 13 + F.col("w.j") * 29) % 97).alias("x"), "w.text")
    return certificates.page_lines(w, "cert")


def certificate_words(spark, d):
    """One certificate a part, in four languages."""
    label = lambda *of: F.element_at(F.array(*map(F.lit, of)), (k() % 4 + 1).cast("int"))
    size, design = S("p_size"), "SUN FAST 3300 1.95 WB"
    words = [
        (10, 10, label("Name:", "Nom:", "Nombre:", "Nome:")),
        (12.4, 50, F.concat(F.lit("BOAT "), S(k()))),
        (20, 60, F.concat(F.lit("GBR"), S(k()))),
        (20, 10, label("Sail Number:", "No. de voile:", "N° de vela:", "N° Velico:")),
        (30, 10, label(f"Design: {design}", f"Type {design}", f"Tipo: {design}", f"Typo: {design}")),
        (30, 90, label("", "CERTIFICAT", "CERTIFICADO", "CERTIFICATO")),
        (40, 10, label("Cert No:", "N° de Cert.:", "No. de Cert.:", "N° di Cert.:")),
        (43, 60, S(k() % 500)),
        (50, 10, label("Expires: 31 Dec 26", "Au: 31 Déc 26", "Hasta el: 29 Feb 2024 10:00:00", "Al: 31 Dicembre 26")),
        (60, 10, F.concat(label("Crew No:", "Equipiers:", "No. de tripulantes:", "N° di Equipaggio:"), F.lit(" "), size)),
        (66, 10, F.lit("Measured LH 6.25, E 12/25, mast carbon")),
        (72.5, 10, F.lit("HULL")),
        (80, 90, F.lit("LWP 9.5")),
        (81, 10, F.concat(F.lit("LH "), size, F.lit(".25"))),
        (90, 10, label("Boat Weight: 1,234 kg", "Poids: 5000", "Peso: 4321 kgs", "Peso : 99")),
        (100, 10, label("Draft: 2", "Tirant d'eau : 2.1", "Calado: 2.25", "Pescaggio: 2.5")),
        (110, 10, F.lit("P 12.34")),
        (110, 40, F.lit("E 4.56")),
        (114, 70, F.lit("HLU/HLUmax 13.01")),
        (120, 10, F.lit("Aft rigging")),
        (130, 10, size),
        (140, 10, F.when(k() % 3 == 0, "WB 300.5 L")),
        (150, 10, F.lit("2 Spreaders DLR 140")),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(float(top)).alias("top"), F.lit(float(x)).alias("x"), text.alias("text")) for top, x, text in words]))
    return t(spark, d, "part").select("p_partkey", "p_size", rows.alias("w")).select("p_partkey", F.lit(1).alias("page"), "w.*")


@query("""SELECT p_partkey, 'BOAT ' || p_partkey AS name, 'GBR' || p_partkey AS sail_number, 'SUN FAST 3300' AS design, CAST(p_partkey % 500 AS VARCHAR) AS cert_number, CAST(p_size AS INTEGER) AS crew,
 CASE p_partkey % 4 WHEN 2 THEN DATE '2023-02-28' WHEN 3 THEN NULL ELSE DATE '2025-12-31' END AS issue_date, p_size + 0.25 AS lh, CAST(9.5 AS DOUBLE) AS lwp, CAST(CASE p_partkey % 4 WHEN 0 THEN 1.234 WHEN 1 THEN 5000 WHEN 2 THEN 4321 ELSE 99 END AS DOUBLE) AS displacement,
 CAST(CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2.1 WHEN 2 THEN 2.25 ELSE 2.5 END AS DOUBLE) AS draft, CAST(12.34 AS DOUBLE) AS p, CAST(4.56 AS DOUBLE) AS e, CAST(13.01 AS DOUBLE) AS hlu, CAST(p_size AS INTEGER) AS aft_rigging, CAST(CASE WHEN p_partkey % 3 = 0 THEN 300 ELSE 0 END AS DOUBLE) AS water_ballast,
 2 AS spreaders, 140 AS dlr, 'carbon' AS mast_material, CAST(NULL AS DOUBLE) AS spa FROM part""")
def certificate_fields(spark, d):
    lines = certificates.page_lines(certificate_words(spark, d), "p_partkey")
    c = certificates.certificate_fields(certificates.certificate_pages(lines, "p_partkey"))
    return c.select("p_partkey", "name", "sail_number", "design", "cert_number", "crew", "issue_date", F.col("lh"), "lwp", "displacement", "draft", "p", "e", "hlu", "aft_rigging", "water_ballast", "spreaders", "dlr", "mast_material", "spa")


SHEET = "p_partkey // 50 AS sheet, p_partkey AS k, CAST(p_partkey % 90 + 1 AS INTEGER) AS n, 'HKG' || (p_partkey % 9000 + 100) AS sail"


@query(f"""WITH s AS (SELECT {SHEET}, p_size FROM part), f AS (SELECT sheet, count(*) AS fleet FROM s WHERE k % 5 < 4 GROUP BY 1)
SELECT sheet, k AS line, CASE WHEN k % 5 IN (0, 3) THEN n END AS place, CASE k % 5 WHEN 0 THEN 'Fast Fleet 3' WHEN 1 THEN 'Dragon' WHEN 2 THEN 'Big Boat' ELSE 'IRC A1' END AS division, CASE WHEN k % 5 = 1 THEN 'D' || (k % 900 + 100) ELSE sail END AS sail_no,
 CASE k % 5 WHEN 0 THEN 'Rampage ' || p_size || ' Noel Chan' WHEN 1 THEN 'Phyloong Martin Tsai' WHEN 2 THEN 'Name 12.5 only' ELSE 'Wind -' END AS boat_name, CASE k % 5 WHEN 0 THEN '11:00:00' WHEN 1 THEN '8:40:00' WHEN 3 THEN '10:00:00' END AS start,
 CASE k % 5 WHEN 0 THEN '14:34:48' END AS finish, CASE k % 5 WHEN 0 THEN '3:34:48' WHEN 3 THEN '1:00:00' END AS elapsed, CASE k % 5 WHEN 0 THEN '4:55:47' END AS corrected, CAST(CASE k % 5 WHEN 0 THEN 1.377 WHEN 3 THEN 0.962 END AS DOUBLE) AS rating,
 CASE k % 5 WHEN 0 THEN 'Lady Helm' WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'OCS' ELSE 'DNS' END END AS additional, CASE k % 5 WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'OCS' ELSE 'DNS' END WHEN 2 THEN 'DNF' ELSE 'finished' END AS status, CAST(fleet AS INTEGER) AS fleet_size
FROM s JOIN f USING (sheet) WHERE k % 5 < 4""")
def club_result_lines(spark, d):
    p = t(spark, d, "part").select(F.expr("p_partkey div 50").alias("sheet"), k().alias("line"), "p_partkey", "p_size")
    kind, place, sail = k() % 5, S(k() % 90 + 1), F.concat(F.lit("HKG"), S(k() % 9000 + 100))
    text = (
        F.when(kind == 0, F.concat(place, F.lit(" Fast Fleet 3 "), sail, F.lit(" Rampage "), S("p_size"), F.lit(" Noel Chan 11:00:00 14:34:48\t3:34:48 1.377 4:55:47 Lady Helm ")))
        .when(kind == 1, F.concat(F.lit("Dragon D"), S(k() % 900 + 100), F.lit(" Phyloong Martin Tsai 8:40:00 - - - "), F.when(k() % 2 == 0, "OCS").otherwise("DNS")))
        .when(kind == 2, F.concat(F.lit("  Big Boat "), sail, F.lit(" Name 12.5 only")))
        .when(kind == 3, F.concat(place, F.lit(" IRC A1 "), sail, F.lit(" Wind - 10:00:00 - 1:00:00 0.962 -")))
        .otherwise(F.when(k() % 2 == 0, "Page 3 of HKG12").otherwise("Place Division Sail No. Name Skipper"))
    )
    lines = p.select("sheet", F.lit(1).alias("page"), "line", text.alias("text"))
    above = p.select("sheet").distinct().select("sheet", F.lit(0).alias("page"), F.posexplode(F.array(F.lit("1 Results HKG77 of the day 1:00:00"), F.lit("Place  Division  Sail No.  Name  Skipper  Start"))).alias("line", "text"))
    rows = club.club_lines(lines.unionByName(above.withColumn("line", F.col("line").cast("long"))), "sheet")
    return rows.select("sheet", "line", "place", "division", "sail_no", "boat_name", "start", "finish", "elapsed", "corrected", "rating", "additional", "status", "fleet_size")


@query(f"""WITH s AS (SELECT {SHEET}, p_name, p_size FROM part WHERE p_partkey % 7 > 0), f AS (SELECT sheet, count(*) AS fleet FROM s GROUP BY 1)
SELECT sheet, k AS "row", CASE WHEN k % 4 > 0 THEN n END AS place, CASE WHEN sheet % 2 = 0 THEN 'Big Boat IRC' ELSE 'Big' END AS division, sail AS sail_no, p_name AS boat_name, 'Skipper ' || p_size AS skipper, CASE WHEN k % 4 > 1 THEN '3:04:05' END AS elapsed,
 CASE WHEN k % 4 = 3 THEN '2:59:59' END AS corrected, CAST(CASE WHEN k % 3 > 0 THEN 1234.5 END AS DOUBLE) AS rating, CASE WHEN k % 4 = 0 THEN 'scored dnc' WHEN k % 4 = 2 THEN 'U18' END AS additional, CASE WHEN k % 4 = 0 THEN 'DNC' ELSE 'finished' END AS status, CAST(fleet AS INTEGER) AS fleet_size FROM s JOIN f USING (sheet)""")
def club_result_tables(spark, d):
    """Tables whose heading is broken, repeated in the middle, and on every other sheet without a division."""
    p = t(spark, d, "part").select(F.expr("p_partkey div 50").alias("key"), k().alias("row"), "p_partkey", "p_name", "p_size")
    sheet = F.col("key")
    heading = F.array(F.lit(""), F.lit("Place"), F.when(sheet % 2 == 1, "Division"), F.lit(""), F.lit(None), F.lit("Sail\nNo."), F.lit("Name"), F.lit("S"), F.lit("kipper"), F.lit("Elapsed"), F.lit("RHKATI"), F.lit("Corrected"), F.lit("Additional"))
    place = F.when(k() % 4 > 0, F.concat(S(k() % 90 + 1), F.lit(".")))
    body = F.array(
        F.lit("x"), place, F.lit("Big "), F.lit("Boat"), F.lit("IRC"), F.concat(F.lit(" HKG"), S(k() % 9000 + 100)), F.when(k() % 7 > 0, F.col("p_name")).otherwise(" "), F.lit("Mr"), F.concat(F.lit("Skipper "), S("p_size")),
        F.when(k() % 4 > 1, "3:04:05").otherwise("late"), F.when(k() % 3 > 0, "1,234.5").otherwise("-"), F.when(k() % 4 == 3, "2:59:59"), F.when(k() % 4 == 0, "scored dnc").when(k() % 4 == 2, "U18"),
    )
    rows = p.select("key", F.lit(0).alias("table"), "row", body.alias("cells"))
    heads = p.groupBy("key").agg(F.min("row").alias("low")).select("key", F.lit(0).alias("table"), F.explode(F.array(F.lit(-2.0), F.lit(-1.0), F.col("low") + F.lit(20.5).cast("double"))).alias("row"), F.when(F.lit(True), heading).alias("cells"))
    heads = heads.withColumn("cells", F.when(F.col("row") == -2, F.array(F.lit("Sheet"), F.lit("of the day"))).otherwise(F.col("cells")))
    found = club.club_tables(rows.withColumn("row", F.col("row").cast("double")).unionByName(heads))
    return found.select(F.col("key").alias("sheet"), F.col("row").cast("long").alias("row"), "place", "division", "sail_no", "boat_name", "skipper", "elapsed", "corrected", "rating", "additional", "status", "fleet_size")
