"""Queries on the upkeep of design classes: parts as certificates, boats and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classes, upkeep
from .base import query, t

S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def k():
    return F.col("p_partkey")


def certificates(spark, d):
    raw = F.to_json(F.struct(F.lit("Raw Designer").alias("Designer"), (k() % 3).alias("Age_Year"), (F.col("p_size") + 0.5).alias("LOA"), F.when(k() % 2 == 0, 0).otherwise(F.col("p_size")).alias("Dspl_Sailing"), F.col("p_retailprice").alias("Dspl_Measurement"), F.lit("deep").alias("Draft")))
    p = t(spark, d, "part").withColumn("raw", F.when(k() % 7 == 0, "{broken").when(k() % 7 != 1, raw))
    return p.select(
        "p_partkey", "raw", F.when(k() % 4 == 0, "").when(k() % 4 == 1, F.col("p_brand")).alias("designer"), F.col("p_type").alias("builder"), F.when(k() % 5 > 0, 0).otherwise(1990).alias("year"),
        F.when(k() % 6 == 0, 0.0).when(k() % 6 == 1, 7.5).alias("loa"), F.lit(None).cast("double").alias("draft"), F.lit(None).cast("double").alias("displacement"), F.concat("p_name", F.lit(" "), S("p_size"), F.lit(".25 WB")).alias("design_raw"), "p_name",
    )


@query("""WITH c AS (SELECT *, p_partkey % 7 NOT IN (0, 1) AS ok FROM part) SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN p_brand WHEN ok THEN 'Raw Designer' END AS designer, p_type AS builder, CAST(CASE WHEN p_partkey % 5 = 0 THEN 1990 WHEN ok AND p_partkey % 3 > 0 THEN p_partkey % 3 END AS INTEGER) AS "year",
 CAST(CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 7.5 ELSE CASE WHEN ok THEN p_size + 0.5 END END AS DOUBLE) AS loa, CAST(NULL AS DOUBLE) AS draft, CAST(CASE WHEN ok THEN CASE WHEN p_partkey % 2 = 1 AND p_size > 0 THEN p_size ELSE p_retailprice END END AS DOUBLE) AS displacement, p_name AS design FROM c""")
def design_samples(spark, d):
    c = classes.design_samples(certificates(spark, d)).withColumn("design", classes.design_of_raw("design_raw"))
    return c.select("p_partkey", "designer", "builder", "year", "loa", "draft", "displacement", "design")


def derived(spark, d):
    s = t(spark, d, "part").select(F.col("p_name").alias("design"), F.col("p_size").cast("double").alias("loa"), F.col("p_brand").alias("designer"), F.lit(1999).alias("year"))
    return upkeep.derived_design_values(s, ["designer"], ["loa"])


def class_table(spark, d):
    c = t(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.avg("p_size").alias("m"), F.min("p_brand").alias("b"))
    k = F.col("k")
    return c.select(F.upper("p_name").alias("design"), F.when(k % 3 == 0, None).when(k % 3 == 1, F.round("m")).otherwise(1.0).alias("loa"), F.when(k % 2 == 0, F.col("b")).alias("designer"), F.when(k % 5 == 0, 1999).alias("year"))


UPDATES = """s AS (SELECT p_name AS design, CAST(p_size AS DOUBLE) AS loa, p_brand AS designer FROM part), a AS (SELECT design, list_sort(list(loa) FILTER (loa > 2 AND loa < 50)) AS a FROM s GROUP BY 1),
n AS (SELECT design, CASE WHEN len(a) < 4 THEN round(list_avg(a), 2) ELSE round(list_sum(list_transform(a, lambda x: greatest(least(x, a[1 + CAST(floor(len(a) * 0.9) AS INTEGER)]), a[1 + CAST(floor(len(a) * 0.1) AS INTEGER)]))) / len(a), 2) END AS loa FROM a),
q AS (SELECT design, CASE WHEN count(*) < 5 THEN arg_min(designer, (-c, designer)) END AS designer FROM (SELECT design, designer, count(*) AS c FROM s GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT p_name, min(p_partkey) AS k, avg(p_size) AS m, min(p_brand) AS b FROM part GROUP BY 1), c AS (SELECT p_name AS design, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN round(m) ELSE 1.0 END AS loa, CASE WHEN k % 2 = 0 THEN b END AS designer, CASE WHEN k % 5 = 0 THEN 1999 END AS yr FROM m),
j AS (SELECT c.*, n.loa AS new_loa, q.designer AS new_designer FROM c JOIN n USING (design) JOIN q USING (design))"""


@query(f"""WITH {UPDATES} SELECT upper(design) AS design, 'loa' AS "column", CASE WHEN loa IS NULL THEN 'fill' ELSE 'differs' END AS action, loa AS old_number, new_loa AS new_number FROM j WHERE new_loa IS NOT NULL AND (loa IS NULL OR abs(loa - new_loa) > 0.5)
UNION ALL SELECT upper(design), 'designer', CASE WHEN designer IS NULL THEN 'fill' ELSE 'differs' END, NULL, NULL FROM j WHERE new_designer IS NOT NULL AND designer IS DISTINCT FROM new_designer UNION ALL SELECT upper(design), 'year', 'fill', NULL, 1999 FROM j WHERE yr IS NULL""")
def design_updates(spark, d):
    u = classes.design_updates(class_table(spark, d), derived(spark, d), "design", ["loa", "designer", "year"])
    return u.select("design", "column", "action", F.col("old").try_cast("double").alias("old_number"), F.col("new").try_cast("double").alias("new_number"))


@query(f"""WITH {UPDATES} SELECT upper(design) AS design, coalesce(loa, new_loa) AS loa, coalesce(designer, new_designer) AS designer, CAST(1999 AS INTEGER) AS "year" FROM j""")
def design_fills(spark, d):
    c = class_table(spark, d)
    return classes.apply_fills(c, classes.design_updates(c, derived(spark, d), "design", ["loa", "designer", "year"]), "design").select("design", "loa", "designer", "year")


def swept(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_size")
    boats = p.select("p_partkey", F.when(k() % 4 == 0, F.upper("p_name")).when(k() % 4 == 1, F.col("p_name")).when(k() % 4 == 2, F.concat(F.lit("the "), "p_name")).alias("design"))
    aliases = p.select(F.concat(F.lit("The "), "p_name").alias("alias"), F.col("p_name").alias("name"))
    first = p.groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    table = first.select(F.explode(F.array(F.when(F.col("k") % 2 == 0, F.col("p_name")), F.when(F.col("k") % 3 == 0, F.initcap("p_name")))).alias("p_name"))
    return classes.Sweep(classes.canonical_by(aliases, boats, "design"), table, "p_partkey", "design", F.col("canonical"), "p_name")


SWEPT = """m AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1), title AS (SELECT p_name, list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda x, y: x || ' ' || y) AS title FROM m),
n AS (SELECT p_name AS name FROM m WHERE k % 2 = 0 UNION SELECT title FROM m JOIN title USING (p_name) WHERE k % 3 = 0),
b AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name WHEN 2 THEN 'the ' || p_name END AS old, CASE p_partkey % 4 WHEN 0 THEN title WHEN 1 THEN p_name WHEN 2 THEN p_name END AS new FROM part JOIN title USING (p_name)),
x AS (SELECT *, CASE WHEN old IS NULL THEN 'none' WHEN old = new THEN 'kept' WHEN new IN (SELECT name FROM n) THEN 'applied' ELSE 'skipped' END AS plan, old NOT IN (SELECT name FROM n) AS lost FROM b)"""


@query(f"WITH {SWEPT} SELECT p_partkey, old AS old_value, new AS new_value FROM x WHERE plan = 'applied'")
def sweep_audit(spark, d):
    return swept(spark, d).audit()


@query(f"WITH {SWEPT} SELECT new AS target, count(*) AS n FROM x WHERE plan = 'skipped' GROUP BY 1")
def sweep_skipped(spark, d):
    return swept(spark, d).skipped()


@query(f"WITH {SWEPT} SELECT p_partkey, CASE WHEN plan = 'applied' THEN new ELSE old END AS design FROM x")
def swept_boats(spark, d):
    return swept(spark, d).boats().select("p_partkey", "design")


@query(f"""WITH {SWEPT} SELECT count(*) FILTER (plan <> 'none') AS considered, count(*) FILTER (plan = 'kept') AS kept, count(*) FILTER (plan IN ('applied', 'skipped')) AS planned, count(*) FILTER (plan = 'applied') AS applied, count(*) FILTER (plan = 'skipped') AS skipped,
 count(*) FILTER (lost) AS orphans_before, count(DISTINCT old) FILTER (lost) AS orphans_before_distinct, count(*) FILTER (lost AND plan <> 'applied') AS orphans_after, count(DISTINCT old) FILTER (lost AND plan <> 'applied') AS orphans_after_distinct FROM x""")
def sweep_counts(spark, d):
    return swept(spark, d).counts()
