"""Queries on facts about boats: suppliers as boats, their line items' orders as races."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts
from .base import RACES, query, races

RESULTS = f"""{RACES}, x AS (SELECT boat, race AS id, CASE WHEN race % 11 > 0 THEN day END AS day, CASE WHEN race % 6 > 0 THEN place END AS place, CASE WHEN flag = 'R' THEN 'RET' ELSE 'finished' END AS status, CASE race % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Skipper ' || (race % 7) END AS skipper,
 CASE race % 3 WHEN 0 THEN 'Club ' || (race % 4) WHEN 1 THEN '' END AS club_name, CASE race % 4 WHEN 0 THEN '' WHEN 1 THEN 'Org ' || (race % 2) END AS organizing_club, CASE WHEN race % 5 > 1 THEN 'Home' END AS boat_club, CASE WHEN race % 9 > 0 THEN race % 40 END AS event FROM r)"""


def results(spark, d):
    k = F.col("race")
    name = lambda text, n: F.concat(F.lit(text), (k % n).cast("string"))
    return races(spark, d).select(
        "boat", k.alias("id"), F.when(k % 11 > 0, F.col("day")).alias("day"), F.when(k % 6 > 0, F.col("place")).alias("place"), F.when(F.col("flag") == "R", "RET").otherwise("finished").alias("status"), F.when(k % 5 == 0, "").when(k % 5 > 1, name("Skipper ", 7)).alias("skipper"),
        F.when(k % 3 == 0, name("Club ", 4)).when(k % 3 == 1, "").alias("club_name"), F.when(k % 4 == 0, "").when(k % 4 == 1, name("Org ", 2)).alias("organizing_club"), F.when(k % 5 > 1, "Home").alias("boat_club"), F.when(k % 9 > 0, k % 40).alias("event"),
    )


@query(f"""WITH {RESULTS}, s AS (SELECT boat, skipper, count(*) AS races, min(day) AS first_date, max(day) AS last_date, count(*) FILTER (place = 1) AS wins, count(*) FILTER (place BETWEEN 1 AND 3) AS podiums FROM x WHERE skipper <> '' GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY boat ORDER BY last_date DESC NULLS LAST, races DESC, skipper) = 1 AS is_current FROM s""")
def skipper_stints(spark, d):
    return facts.skipper_stints(results(spark, d))


@query(f"""WITH {RESULTS}, l AS (SELECT boat, coalesce(nullif(club_name, ''), nullif(organizing_club, ''), nullif(boat_club, '')) AS club, row_number() OVER (PARTITION BY boat ORDER BY day DESC, id DESC) AS r FROM x WHERE day IS NOT NULL),
c AS (SELECT boat, club, count(*) AS n FROM l WHERE r <= 15 AND club IS NOT NULL GROUP BY 1, 2) SELECT boat, club, n FROM (SELECT *, row_number() OVER (PARTITION BY boat ORDER BY n DESC, club) AS k FROM c) WHERE k = 1""")
def home_clubs(spark, d):
    return facts.home_clubs(results(spark, d))


@query(f"""WITH {RESULTS} SELECT boat, count(*) FILTER (status = 'finished' AND place IS NOT NULL) AS finishes, count(*) FILTER (place = 1) AS wins, count(*) FILTER (place BETWEEN 1 AND 3) AS podiums, count(DISTINCT event) AS distinct_events FROM x GROUP BY 1""")
def performance_facts(spark, d):
    return facts.performance_facts(results(spark, d))


@query(f"""WITH {RESULTS} SELECT boat, id, day, place, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY boat ORDER BY day DESC NULLS LAST, id DESC) AS k FROM x WHERE place IS NOT NULL) WHERE k <= 20""")
def recent_results(spark, d):
    return facts.recent_results(results(spark, d)).select("boat", "id", "day", "place", "rank")
