"""Matching queries: results from customers, boats from suppliers. The views are written once, in expressions that both
engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching
from .base import query, t
from .operations import GRAMS, ONE

S, C = "s_suppkey", "c_custkey"
VIEWS = {
    "r": ("customer", f"""{C} AS result_id, CASE WHEN {C} % 3 = 0 THEN 'club' WHEN {C} % 3 = 1 THEN 'owned' ELSE 'other' END AS source, CASE WHEN {C} % 5 > 0 THEN 'BOAT ' || CAST({C} % 160 AS STRING) END AS name,
CASE {C} % 4 WHEN 0 THEN 'GBR' || CAST(100 + {C} % 170 AS STRING) WHEN 2 THEN 'X' WHEN 3 THEN 'FRA' || CAST(100 + {C} % 190 AS STRING) END AS sail, CASE WHEN {C} % 7 = 0 THEN CAST(100 + {C} % 130 AS STRING) END AS hull,
'Owner ' || CAST({C} % 50 AS STRING) AS owner, CASE WHEN {C} % 6 < 2 THEN 'sun ' || CAST({C} % 9 AS STRING) END AS design, CASE WHEN {C} % 2 = 0 THEN CAST(90 + {C} % 45 AS DOUBLE) / 100 END AS rating, {C} % 40 AS race"""),
    "b": ("supplier", f"{S} AS boat_id, 'Boat ' || CAST({S} - {S} % 3 AS STRING) AS boat_name, 'GBR ' || CAST(100 + {S} - {S} % 2 AS STRING) AS boat_sail, 'Sunfast Sun ' || CAST({S} % 9 AS STRING) || ' Mk' AS boat_design"),
    "g": ("supplier", f"{S} AS boat_id, CAST(90 + {S} % 40 AS DOUBLE) / 100 AS rating, DATE '2024-01-01' AS day"),
    "z": ("supplier", f"CASE WHEN {S} % 4 > 0 THEN {S} END AS boat_id, ' boat ' || CAST({S} - {S} % 2 + 60 AS STRING) AS cert_name, 'fra-' || CAST(180 + {S} AS STRING) AS cert_sail, 'Big SUN ' || CAST({S} % 9 AS STRING) AS cert_class"),
    "i": ("supplier", f"{S} AS boat_id, 'BOAT ' || CAST({S} + 100 AS STRING) AS name, 'FRA ' || CAST(150 + {S} - {S} % 2 AS STRING) AS sail"),
    "o": ("supplier", f"{S} AS boat_id, 'owner ' || CAST({S} % 70 AS STRING) AS owner"),
}
WITH = "WITH " + ", ".join(f"{name} AS (SELECT {what} FROM {of})" for name, (of, what) in VIEWS.items())


def view(spark, d, name):
    of, what = VIEWS[name]
    return spark.sql(f"SELECT {what} FROM {{src}}", src=t(spark, d, of))


SAIL = """st AS (SELECT DISTINCT result_id, boat_id FROM (SELECT result_id, unnest([sail, substr(sail, 4)]) AS k FROM r WHERE length(sail) > 2) JOIN (SELECT boat_id, unnest([replace(boat_sail, ' ', ''), substr(boat_sail, 5)]) AS k FROM b) USING (k)),
sn AS (SELECT *, count(*) OVER (PARTITION BY result_id) AS n FROM st),
nt AS (SELECT result_id, boat_id, count(*) OVER (PARTITION BY result_id) AS n FROM r JOIN b ON name = upper(boat_name)),
sm AS (SELECT x, y, $ONE AS v FROM (SELECT DISTINCT name AS x, $A AS a FROM r WHERE name IS NOT NULL), (SELECT DISTINCT upper(boat_name) AS y, $B AS b FROM b)),
fz AS (SELECT r.result_id, b.boat_id, v FROM r JOIN sm ON x = name AND v > 0.7 JOIN b ON y = upper(boat_name) JOIN g ON g.boat_id = b.boat_id WHERE length(name) >= 4 AND CASE WHEN r.rating IS NULL THEN v > 0.85 ELSE abs(g.rating - r.rating) < 0.01 END),
cn AS (SELECT result_id, name, design, cert_class, boat_id FROM r JOIN z ON upper(trim(cert_name)) = name WHERE boat_id IS NOT NULL),
cs AS (SELECT result_id, min(boat_id) AS boat_id FROM r JOIN z ON upper(replace(cert_sail, '-', '')) = sail WHERE boat_id IS NOT NULL AND length(sail) > 2 GROUP BY 1 HAVING count(DISTINCT boat_id) = 1),
im AS (SELECT result_id, min(boat_id) AS boat_id FROM r JOIN i USING (name) GROUP BY 1 HAVING count(DISTINCT boat_id) = 1),
ix AS (SELECT result_id, min(boat_id) AS boat_id FROM r JOIN i ON r.sail = replace(i.sail, ' ', '') WHERE length(r.sail) > 2 GROUP BY 1 HAVING count(DISTINCT boat_id) = 1)""".replace("$ONE", ONE).replace("$A", GRAMS.format("name")).replace("$B", GRAMS.format("boat_name"))
NAMES = """UNION ALL SELECT result_id, boat_id, 5, 'name' FROM nt WHERE n = 1
UNION ALL SELECT result_id, min(nt.boat_id), 6, 'name_rating' FROM nt JOIN r USING (result_id) JOIN g USING (boat_id) WHERE n > 1 AND abs(g.rating - r.rating) < 0.005 GROUP BY 1
UNION ALL SELECT result_id, arg_min(boat_id, (-v, boat_id)), 7, 'name_fuzzy' FROM fz GROUP BY 1"""
BEST = "SELECT r.result_id, boat_id, method FROM r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY p) AS k FROM c) x ON x.result_id = r.result_id AND k = 1"


@query(f"""{WITH}, {SAIL}, c(result_id, boat_id, p, method) AS (SELECT result_id, boat_id, 1, 'sail' FROM sn WHERE n = 1
UNION ALL SELECT result_id, min(boat_id), 2, 'sail_name' FROM sn JOIN r USING (result_id) JOIN b USING (boat_id) WHERE n > 1 AND name = upper(boat_name) GROUP BY 1
UNION ALL SELECT result_id, min(sn.boat_id), 3, 'sail_rating' FROM sn JOIN r USING (result_id) JOIN g USING (boat_id) WHERE n > 1 AND name IS NOT NULL AND abs(g.rating - r.rating) < 0.005 GROUP BY 1
{NAMES}
UNION ALL SELECT result_id, min(boat_id), 9, 'certificate_name' FROM cn GROUP BY 1 HAVING count(DISTINCT boat_id) = 1
UNION ALL SELECT result_id, boat_id, 10, 'certificate_sail' FROM cs
UNION ALL SELECT result_id, boat_id, 12, 'identity_name' FROM im UNION ALL SELECT result_id, boat_id, 13, 'identity_sail' FROM ix) {BEST}""")
def match_any_source(spark, d):
    r, b, g, z, i = (view(spark, d, x) for x in "rbgzi")
    return matching.match_any(r, b, g, z, i).select("result_id", "boat_id", "method")


@query(f"""{WITH}, {SAIL}, ht AS (SELECT *, count(*) OVER (PARTITION BY result_id) AS n FROM (SELECT DISTINCT result_id, boat_id FROM r JOIN b ON hull = substr(boat_sail, 5))),
dz AS (SELECT result_id, arg_min(b.boat_id, (abs(g.rating - r.rating), b.boat_id)) AS boat_id FROM r JOIN b ON contains(lower(boat_design), lower(design)) JOIN g ON g.boat_id = b.boat_id WHERE abs(g.rating - r.rating) < 0.003 GROUP BY 1),
c(result_id, boat_id, p, method) AS (SELECT result_id, boat_id, 1, 'sail' FROM sn WHERE n = 1
UNION ALL SELECT result_id, min(boat_id), 2, 'sail_name' FROM sn JOIN r USING (result_id) JOIN b USING (boat_id) WHERE n > 1 AND name = upper(boat_name) GROUP BY 1
UNION ALL SELECT result_id, boat_id, 4, 'hull' FROM ht WHERE n = 1
{NAMES}
UNION ALL SELECT result_id, min(boat_id), 8, 'certificate_design' FROM cn WHERE contains(lower(cert_class), design) GROUP BY 1 HAVING count(DISTINCT boat_id) = 1
UNION ALL SELECT result_id, min(boat_id), 9, 'certificate_name' FROM cn WHERE design IS NULL GROUP BY 1 HAVING count(DISTINCT boat_id) = 1
UNION ALL SELECT result_id, boat_id, 10, 'certificate_sail' FROM cs UNION ALL SELECT result_id, boat_id, 11, 'design_rating' FROM dz
UNION ALL SELECT result_id, boat_id, 12, 'identity_name' FROM im UNION ALL SELECT result_id, boat_id, 13, 'identity_sail' FROM ix) {BEST}""")
def match_club_results(spark, d):
    r, b, g, z, i = (view(spark, d, x) for x in "rbgzi")
    return matching.match_club(r, b, g, z, i).select("result_id", "boat_id", "method")


@query(f"""{WITH}, w AS (SELECT result_id, o.boat_id, count(*) OVER (PARTITION BY result_id) AS n FROM r JOIN o ON upper(r.owner) = upper(o.owner)),
c(result_id, boat_id, p, method) AS (SELECT result_id, boat_id, 1, 'owner' FROM w WHERE n = 1
UNION ALL SELECT result_id, min(w.boat_id), 2, 'owner_rating' FROM w JOIN r USING (result_id) JOIN g USING (boat_id) WHERE n > 1 AND abs(g.rating - r.rating) < 0.01 GROUP BY 1 HAVING count(DISTINCT w.boat_id) = 1
UNION ALL SELECT result_id, min(g.boat_id), 3, 'rating' FROM r JOIN g USING (rating) GROUP BY 1 HAVING count(DISTINCT g.boat_id) = 1) {BEST}""")
def match_owners(spark, d):
    return matching.match_owner(view(spark, d, "r"), view(spark, d, "o"), view(spark, d, "g")).select("result_id", "boat_id", "method")


@query(f"""{WITH}, x AS (SELECT result_id, race, CASE WHEN result_id % 3 = 0 THEN result_id % 10 END AS boat_id, CASE WHEN result_id % 7 > 0 THEN result_id % 10 END AS new FROM r),
n AS (SELECT result_id, new FROM (SELECT *, row_number() OVER (PARTITION BY new, race ORDER BY result_id) AS k FROM x WHERE boat_id IS NULL AND new IS NOT NULL) f WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM x h WHERE h.boat_id = f.new AND h.race = f.race))
SELECT result_id, race, coalesce(boat_id, new) AS boat_id FROM x LEFT JOIN n USING (result_id)""".replace("coalesce(boat_id, new)", "coalesce(boat_id, n.new)"))
def apply_matches_once(spark, d):
    r = view(spark, d, "r")
    x = r.select("result_id", "race", F.when(F.col("result_id") % 3 == 0, F.col("result_id") % 10).alias("boat_id"))
    m = r.select("result_id", F.when(F.col("result_id") % 7 > 0, F.col("result_id") % 10).alias("boat_id"))
    return matching.apply_matches(x, m, ["race"]).select("result_id", "race", "boat_id")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'view' AND ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-31 00:00:00'")
def rematch_due(spark, d):
    e = t(spark, d, "events").select("event_id", "event_type", "ts", F.when(F.col("event_type") == "view", 1).alias("boat_id"))
    return matching.due(e, "ts", "2024-01-31 00:00:00", 7).select("event_id", "event_type")
