"""Operations queries: sources, freshness, gates, text clean-up, matching, feeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import quality, resolve
from ..operators import relational as rel
from ..sources import files
from ..streaming import feeds
from .base import ORDERS, RACES, orders, query, r6, races, t

AS_OF = "2024-01-31 00:00:00"


@query(f"""SELECT w AS window, count(ts) AS n, count(ts) FILTER (event_type = 'error') AS n_failed FROM (VALUES ('d1', 1), ('d7', 7), ('d30', 30)) v(w, days) LEFT JOIN events ON ts > TIMESTAMP '{AS_OF}' - to_days(CAST(days AS INTEGER)) GROUP BY 1""")
def rolling_windows(spark, d):
    return quality.rolling_counts(t(spark, d, "events"), "ts", AS_OF, {"d1": 24, "d7": 168, "d30": 720}, F.col("event_type") == "error")


@query(f"""SELECT event_type, max(ts) AS last, max(ts) FILTER (value > 10) AS last_big, count(*) FILTER (ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS n_week, round(sum(value) FILTER (ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY), 4) AS sum_week FROM events GROUP BY 1""")
def source_rollup(spark, d):
    week = quality.since("ts", AS_OF, 168)
    return t(spark, d, "events").groupBy("event_type").agg(
        F.max("ts").alias("last"), F.max(F.when(F.col("value") > 10, F.col("ts"))).alias("last_big"), F.count_if(week).alias("n_week"), r6(F.sum(F.when(week, F.col("value"))), 4).alias("sum_week")
    )


@query(f"""WITH s AS (SELECT event_type, max(ts) AS last, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1), x AS (SELECT * FROM (VALUES ('signup'), ('view'), ('other')) v(event_type))
SELECT event_type, coalesce(n, 0) AS n, CASE WHEN last IS NULL THEN 'never' WHEN last > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR THEN 'fresh' ELSE 'stale' END AS state FROM s FULL JOIN x USING (event_type)""")
def freshness_state(spark, d):
    config = spark.createDataFrame([("signup",), ("view",), ("other",)], "event_type string")
    return quality.source_state(t(spark, d, "events").filter("event_type <> 'signup'"), "event_type", "ts", AS_OF, 1, config).select("event_type", "n", "state")


@query(f"SELECT CASE WHEN max(ts) > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR THEN 'fresh' ELSE 'stale' END AS worst FROM (SELECT min(last) AS ts FROM (SELECT event_type, max(ts) AS last FROM events GROUP BY 1))")
def worst_freshness(spark, d):
    return quality.worst_state(quality.source_state(t(spark, d, "events"), "event_type", "ts", AS_OF, 1))


@query(f"""WITH c AS (SELECT * FROM (VALUES ('click', 24, 24, false), ('nobody', 24, 24, true), ('gone', 24, 24, false), ('view', 1, 1, false)) v(source, run_h, data_h, opt)), s AS (SELECT event_type AS source, max(ts) AS run_at FROM events GROUP BY 1)
SELECT source, CASE WHEN run_at IS NULL AND opt THEN 'no data' WHEN run_at IS NULL THEN 'never ran' WHEN floor(date_diff('second', run_at, TIMESTAMP '{AS_OF}') / 3600) > run_h THEN 'run overdue' WHEN floor(date_diff('second', run_at, TIMESTAMP '{AS_OF}') / 3600) > data_h THEN 'data stale' END AS reason FROM c LEFT JOIN s USING (source)""")
def watchdog(spark, d):
    config = spark.createDataFrame([("click", 24, 24, False), ("nobody", 24, 24, True), ("gone", 24, 24, False), ("view", 1, 1, False)], "source string, run_within_h int, data_within_h int, optional boolean")
    seen = t(spark, d, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("at"))
    w = quality.watchdog(config, seen, seen, AS_OF)
    return w.select("source", F.when(F.col("optional") & F.col("run").isNull(), "no data").otherwise(F.col("reason")).alias("reason"))


@query("SELECT source, count(*) AS n, round(count(lang) * 100.0 / nullif(count(*), 0), 4) AS lang_pct, round(count(nullif(text, '')) * 100.0 / nullif(count(*), 0), 4) AS text_pct FROM documents GROUP BY 1")
def fill_rates(spark, d):
    pct = lambda c: r6(F.try_divide(F.count(c) * F.lit(100.0), F.count("*")), 4)
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), pct("lang").alias("lang_pct"), pct(F.nullif(F.col("text"), F.lit(""))).alias("text_pct"))


@query("SELECT quality, count(*) AS n, round(avg(n_chars), 4) AS mean, round(quantile_cont(n_chars, 0.1), 4) AS p10, avg(n_chars) >= 1000 AND quantile_cont(n_chars, 0.1) >= 100 AND count(*) >= 20 AS passes FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def gate_p10(spark, d):
    j = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    p10 = F.percentile("n_chars", F.lit(0.1))
    return j.groupBy("quality").agg(F.count("*").alias("n"), r6(F.avg("n_chars"), 4).alias("mean"), r6(p10, 4).alias("p10"), ((F.avg("n_chars") >= 1000) & (p10 >= 100) & (F.count("*") >= 20)).alias("passes"))


@query("SELECT coalesce(o_custkey % 20 < 14 AND (o_custkey % 9 < 5 OR o_custkey % 11 >= 3), false) AS accepted, count(*) AS n FROM orders GROUP BY 1")
def confidence_gate(spark, d):
    o = t(spark, d, "orders").select((1 - F.col("o_custkey") % 20 * 0.02).alias("c"), (F.col("o_custkey") % 11 * 0.25).alias("r"), (F.col("o_custkey") % 9).alias("b"))
    return quality.gate(o, "c", "r", "b", least_confidence=0.73).groupBy("accepted").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'MISSING_PDF' WHEN (o_orderkey % 5) / 1000.0 * 10 < 0.005 THEN 'OK' WHEN (o_orderkey % 5) / 1000.0 * 10 <= 0.0101 THEN 'MINOR' WHEN (o_orderkey % 5) / 1000.0 * 10 <= 0.05 THEN 'MODERATE' ELSE 'MAJOR' END AS grade, count(*) AS n FROM orders GROUP BY 1""")
def field_audit(spark, d):
    o = t(spark, d, "orders").select(F.lit(1000.0).alias("stored"), F.when(F.col("o_orderkey") % 7 != 0, 1000.0 + F.col("o_orderkey") % 5 * 10).alias("found"))
    return o.groupBy(quality.audit("stored", "found").alias("grade")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') GROUP BY 1 ORDER BY n DESC, l_orderkey LIMIT 30")
def orphan_keys(spark, d):
    parents = t(spark, d, "orders").filter("o_orderstatus <> 'P'")
    return quality.orphans(t(spark, d, "lineitem"), parents, "l_orderkey", "o_orderkey").orderBy(F.desc("n"), "l_orderkey").limit(30)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error' AND value > 5) AS bad FROM events GROUP BY 1")
def parity_per_day(spark, d):
    return t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 5)).alias("bad"))


@query("SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS domain, count(*) AS n, round(avg(length(html)), 4) AS size FROM pages GROUP BY 1")
def usage_by_domain(spark, d):
    return t(spark, d, "pages").groupBy(tx.url_domain("url").alias("domain")).agg(F.count("*").alias("n"), r6(F.avg(F.length("html")), 4).alias("size"))


@query("SELECT json_extract_string(props, '$.k') AS k, min(ts) AS first, max(ts) AS last, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def stints_by_json_key(spark, d):
    e = t(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")).filter("k IS NOT NULL")
    return e.groupBy("k").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


@query("""WITH x AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), c AS (SELECT user_id, event_type, count(*) AS c FROM x WHERE n <= 15 GROUP BY 1, 2)
SELECT user_id, event_type, c FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS k FROM c) WHERE k = 1""")
def mode_of_last(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    c = t(spark, d, "events").withColumn("n", F.row_number().over(w)).filter("n <= 15").groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    return rel.pick_per_key(c, ["user_id"], [F.desc("c"), "event_type"])


@query("SELECT json_extract_string(props, '$.k') AS k, event_type, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2 ORDER BY n DESC, k LIMIT 20")
def top_unmatched(spark, d):
    e = t(spark, d, "events").filter("event_type = 'error'").groupBy(F.get_json_object("props", "$.k").alias("k"), "event_type").agg(F.count("*").alias("n"))
    return e.orderBy(F.desc("n"), "k").limit(20)


@query("""SELECT user_id, max_by(nullif(event_type, 'error'), (ts, event_id)) FILTER (event_type <> 'error') AS event_type, max_by(json_extract_string(props, '$.k'), (ts, event_id)) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS k FROM events GROUP BY 1""")
def latest_non_empty(spark, d):
    e = t(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("event_type"), F.get_json_object("props", "$.k").alias("k"))
    return rel.latest_non_empty(e, "user_id", ["ts", "event_id"], ["event_type", "k"])


@query("""WITH g AS (SELECT p_brand, list_sort(list(p_retailprice)) AS a FROM part GROUP BY 1) SELECT p_brand, round(list_sum(list_transform(a, lambda x: greatest(least(x, a[1 + CAST(floor(len(a) * 0.9) AS INTEGER)]), a[1 + CAST(floor(len(a) * 0.1) AS INTEGER)]))) / len(a), 2) AS mean FROM g""")
def winsorised_price(spark, d):
    return rel.winsorised_means(t(spark, d, "part").select("p_brand", F.col("p_retailprice").alias("mean")), "p_brand", ["mean"])


@query("""WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1, 2), k AS (SELECT nation, count(*) AS kinds FROM c GROUP BY 1)
SELECT nation, CASE WHEN kinds < 5 THEN seg END AS mode, kinds AS n_distinct FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY n DESC, seg) AS r FROM c) JOIN k USING (nation) WHERE r = 1""")
def modal_segment(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("c_mktsegment"))  # every row, half of them without a value
    return rel.modal_value(c, "nation", "c_mktsegment")


@query("SELECT p_brand, count(DISTINCT lower(regexp_replace(p_name, '\\s+', '', 'g'))) AS names, round(avg(p_size), 6) AS mean, bool_or(p_size > 49) AS any_large, count(p_name) AS named FROM part GROUP BY 1")
def normalised_names(spark, d):
    name = F.lower(F.regexp_replace("p_name", r"\s+", ""))
    return t(spark, d, "part").groupBy("p_brand").agg(F.countDistinct(name).alias("names"), r6(F.avg("p_size")).alias("mean"), F.bool_or(F.col("p_size") > 49).alias("any_large"), F.count("p_name").alias("named"))


@query("WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_mktsegment, list(c_nationkey ORDER BY n DESC, c_nationkey) AS nations, list(n ORDER BY n DESC, c_nationkey) AS counts FROM c GROUP BY 1")
def country_counts(spark, d):
    c = t(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return c.groupBy("c_mktsegment").agg(rel.sorted_list("c_nationkey", -F.col("n"), "c_nationkey").alias("nations"), rel.sorted_list("n", -F.col("n"), "c_nationkey").alias("counts"))


# --- text clean-up and matching ---------------------------------------------------------------------------------------

SAIL = "CASE c_custkey % 4 WHEN 0 THEN 'e-aus ' || c_custkey WHEN 1 THEN 'GBR' || c_custkey || '&' || (c_custkey + 1) WHEN 2 THEN ' ' || c_custkey || ' ' ELSE 'Y' || c_custkey || ';FRA.77' END"
ISO = "|".join(tx.ISO_PREFIXES)
CLS = "|".join(tx.CLASS_PREFIXES)


def sail(spark, d):
    k = F.col("c_custkey").cast("string")
    one = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("e-aus "), k)).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("GBR"), k, F.lit("&"), (F.col("c_custkey") + 1).cast("string")))
    return t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", one.when(F.col("c_custkey") % 4 == 2, F.concat(F.lit(" "), k, F.lit(" "))).otherwise(F.concat(F.lit("Y"), k, F.lit(";FRA.77"))).alias("sail"))


TOKENS = f"""s AS (SELECT c_custkey, {SAIL} AS sail FROM customer), p AS (SELECT c_custkey, unnest(regexp_split_to_array(sail, '[&,;|]')) AS chunk FROM s),
n AS (SELECT c_custkey, regexp_replace(upper(trim(chunk)), '[\\s\\-./]+', '', 'g') AS norm FROM p WHERE trim(chunk) <> ''),
b AS (SELECT *, nullif(regexp_extract(norm, '^({CLS})([0-9].*)$', 2), '') AS cls, nullif(regexp_extract(norm, '^({ISO})([0-9].*)$', 2), '') AS iso FROM n),
k AS (SELECT DISTINCT c_custkey, token FROM (SELECT c_custkey, unnest([norm, 'AUS' || cls, cls, iso]) AS token FROM b) WHERE token IS NOT NULL AND token <> '')"""


@query(f"WITH {TOKENS} SELECT c_custkey, list(token ORDER BY token) AS tokens FROM k GROUP BY 1")
def identifier_tokens(spark, d):
    return sail(spark, d).select("c_custkey", tx.sail_tokens("sail").alias("tokens"))


@query(f"WITH {TOKENS}, o AS (SELECT token, min(c_custkey) AS boat, count(*) AS n FROM k GROUP BY 1 HAVING count(*) = 1) SELECT token, boat FROM o WHERE length(token) > 3")
def unique_tokens(spark, d):
    k = sail(spark, d).select("c_custkey", F.explode(tx.sail_tokens("sail")).alias("token"))
    return k.groupBy("token").agg(F.min("c_custkey").alias("boat"), F.count("*").alias("n")).filter("n = 1 AND length(token) > 3").select("token", "boat")


@query("""WITH b AS (SELECT s_suppkey AS boat_id, 'GBR' || s_suppkey AS sail, 'Customer#' || lpad(CAST(s_suppkey * 2 AS VARCHAR), 9, '0') AS name FROM supplier),
c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'GBR' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS sail, c_name AS name FROM customer),
bt AS (SELECT boat_id, name, unnest([sail, CAST(boat_id AS VARCHAR)]) AS token FROM b), ct AS (SELECT id, sail, name, unnest(CASE WHEN sail LIKE 'GBR%' THEN [sail, substr(sail, 4)] ELSE [sail] END) AS token FROM c),
j AS (SELECT DISTINCT id, boat_id, ct.name = bt.name AS same, length(sail) <= 4 AND regexp_matches(sail, '^[0-9]+$') AS short FROM ct JOIN bt USING (token)),
g AS (SELECT id, count(*) AS n, min(boat_id) AS boat_id, bool_or(same) AS same, bool_or(short) AS short FROM j GROUP BY 1),
nm AS (SELECT id, min(boat_id) AS boat_id FROM c JOIN b ON c.name = b.name GROUP BY 1 HAVING count(DISTINCT boat_id) = 1)
SELECT c.id AS result_id, CASE WHEN g.n = 1 AND NOT (short AND NOT same) THEN g.boat_id WHEN g.n = 1 THEN NULL ELSE nm.boat_id END AS boat_id,
 CASE WHEN g.n = 1 AND NOT (short AND NOT same) THEN 'token' WHEN g.n = 1 THEN 'skipped' WHEN nm.boat_id IS NOT NULL THEN 'name_country' ELSE 'unmatched' END AS method FROM c LEFT JOIN g USING (id) LEFT JOIN nm USING (id)""")
def certificate_match(spark, d):
    boats = t(spark, d, "supplier").select(F.col("s_suppkey").alias("boat_id"), F.concat(F.lit("GBR"), F.col("s_suppkey").cast("string")).alias("boat_sail"), F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 2).cast("string"), 9, "0")).alias("boat_name"), F.lit("GBR").alias("boat_country"))
    key = F.col("c_custkey").cast("string")
    certs = t(spark, d, "customer").select(F.col("c_custkey").alias("result_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("GBR"), key)).otherwise(key).alias("sail"), F.col("c_name").alias("name"), F.lit("GBR").alias("country"))
    return resolve.certificate_match(certs, boats).select("result_id", "boat_id", "method")


def token_groups(spark, d):
    """Without SQL: connected components take as many joins as there are rounds."""
    c = sail(spark, d).withColumnRenamed("c_custkey", "result_id")
    return resolve.token_groups(c).groupBy("group_id").agg(F.count("*").alias("n"), F.max("result_id").alias("last"))


query()(token_groups)

GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
ONE = "(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))))"


@query(f"WITH x AS (SELECT p_partkey, p_name, {GRAMS.format('p_name')} AS a, {GRAMS.format(chr(39) + 'small rng' + chr(39))} AS b FROM part) SELECT p_partkey, p_name, round({ONE}, 6) AS similarity FROM x WHERE {ONE} > 0.3 ORDER BY round({ONE}, 6) DESC, p_partkey LIMIT 20")
def trigram_search(spark, d):
    boats = t(spark, d, "part").select(F.col("p_partkey").alias("boat_id"), F.col("p_name").alias("boat_name"), F.lit("").alias("boat_sail"))
    return resolve.fuzzy_search(boats, "small rng").select(F.col("boat_id").alias("p_partkey"), F.col("boat_name").alias("p_name"), r6("score").alias("similarity"))


@query(f"""WITH n AS (SELECT DISTINCT p_name AS x, {GRAMS.format('p_name')} AS a FROM part), m AS (SELECT r_name AS y, {GRAMS.format('p_name')} AS b, p_name AS z FROM region, (SELECT DISTINCT p_name FROM part) WHERE r_name = 'ASIA')
SELECT x, z AS y, round({ONE}, 6) AS similarity FROM n, m WHERE x < z AND {ONE} >= 0.4""")
def trigram_pairs(spark, d):
    names = t(spark, d, "part").select("p_name").distinct()
    p = resolve.similar_pairs(names.withColumnRenamed("p_name", "x"), names.withColumnRenamed("p_name", "y"), "x", "y", 0.4)
    return p.filter("x < y").select("x", "y", r6("similarity").alias("similarity"))


@query("""SELECT md5(lower(regexp_replace(text, '[^a-zA-Z0-9]+', '', 'g'))) AS key, count(*) AS size, list(doc_id ORDER BY doc_id) AS ids FROM documents WHERE regexp_replace(text, '[^a-zA-Z0-9]+', '', 'g') <> '' GROUP BY 1 HAVING count(*) > 1""")
def duplicate_clusters(spark, d):
    norm = F.lower(F.regexp_replace("text", "[^a-zA-Z0-9]+", ""))
    # behind the explode the text is cleaned once, not once a use
    docs = t(spark, d, "documents").select("doc_id", F.explode(F.array(norm)).alias("norm"))
    c = resolve.duplicate_clusters(docs, [F.when(F.col("norm") != "", F.md5("norm"))], "doc_id")
    return c.withColumnRenamed("k0", "key")


@query("""WITH l AS (SELECT c_custkey AS k, c_nationkey AS nation, c_mktsegment AS seg, c_acctbal AS bal FROM customer), m AS (SELECT CASE WHEN k % 10 = 0 AND k > 0 THEN k - 10 + (k // 10 % 2) * 0 ELSE k END AS k, nation, seg, bal, k % 10 <> 0 OR k = 0 AS own FROM l)
SELECT k, seg, nation, bal FROM (SELECT *, row_number() OVER (PARTITION BY k, seg ORDER BY bal DESC, own DESC) AS n FROM m) WHERE n = 1""")
def merged_rows(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    losers = c.filter("k % 10 = 0 AND k > 0").select(F.col("k").alias("loser"), (F.col("k") - 10).alias("winner"))
    return resolve.merge_rows(c, losers, "k", ["seg"], [F.desc("bal")]).select("k", "seg", "nation", "bal")


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' - SEC' WHEN 1 THEN upper(p_name) || '  -  sec ' ELSE p_name END AS n, CASE WHEN p_partkey % 5 = 0 THEN 'Y' END AS flag FROM part)
SELECT p_partkey, trim(regexp_replace(n, '(?i)\\s+-\\s+SEC\\s*$', '')) AS name, regexp_matches(n, '(?i)\\s+-\\s+SEC\\s*$') OR coalesce(flag, '') = 'Y' AS secondary FROM x""")
def secondary_suffix_clean(spark, d):
    n = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" - SEC"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.upper("p_name"), F.lit("  -  sec "))).otherwise(F.col("p_name"))
    x = t(spark, d, "part").select("p_partkey", n.alias("n"), F.when(F.col("p_partkey") % 5 == 0, "Y").alias("flag"))
    return x.select("p_partkey", tx.clean_name("n").alias("name"), tx.is_secondary("n", "flag").alias("secondary"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 3) * 86400 + (o_orderkey % 30) * 3600 + 5 * 60 + o_orderkey % 60 WHEN 1 THEN (o_orderkey % 3) * 86400 + (o_orderkey % 30) * 3600 + 5 * 60 + o_orderkey % 60
 WHEN 2 THEN (o_orderkey % 30) * 3600 + 5 * 60 + o_orderkey % 60 END AS seconds FROM orders""")
def elapsed_seconds(spark, d):
    k = F.col("o_orderkey")
    s = lambda n: (k % n).cast("string")
    hms = F.concat(s(30), F.lit(":05:"), s(60))
    e = F.when(k % 4 == 0, F.concat(s(3), F.lit(" - "), hms)).when(k % 4 == 1, F.concat(s(3), F.lit(":"), hms)).when(k % 4 == 2, hms).otherwise(F.lit("DNF"))
    return t(spark, d, "orders").select("o_orderkey", tx.elapsed_seconds(e).alias("seconds"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'DNS' WHEN o_orderkey % 3 <> 0 THEN 'finished' WHEN o_orderkey % 2 = 0 THEN 'DNF' ELSE 'finished' END AS status FROM orders""")
def status_derived(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, F.create_map(F.lit("status"), F.lit(" dns "))).when(k % 3 == 1, F.create_map(F.lit("finish_time"), F.lit("10:00:00"))).when(k % 3 == 0, F.create_map(F.lit("finish_time"), F.lit(None).cast("string"))).otherwise(F.lit(None))
    return t(spark, d, "orders").withColumn("raw", raw).select("o_orderkey", tx.derive_status("raw", F.when(k % 2 == 1, 1)).alias("status"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'AUS' WHEN n_nationkey % 5 = 1 THEN 'GER' WHEN n_nationkey % 5 = 2 THEN 'GBR' END AS by_sail,
 CASE WHEN n_nationkey % 5 = 0 THEN 'AUS' WHEN n_nationkey % 5 = 1 THEN 'GER' END AS by_listing FROM nation""")
def country_of_sail(spark, d):
    k = F.col("n_nationkey")
    s = F.concat(F.when(k % 5 == 0, "aus").when(k % 5 == 1, "D").when(k % 5 == 2, "K").when(k % 5 == 3, "").otherwise("QQ"), (k + 100).cast("string"))
    return t(spark, d, "nation").select("n_nationkey", tx.country_from_sail(s).alias("by_sail"), tx.country_from_listing(s).alias("by_listing"))


@query("""WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS ref FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT CAST(o_custkey AS VARCHAR) AS ref, max(CAST(o_orderdate AS DATE)) AS day FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT ref, 'order' AS event_type FROM n WHERE ref NOT IN (SELECT ref FROM f)""")
def feed_anti_join(spark, d):
    o = orders(spark, d)
    rows = lambda s: feeds.feed_rows(o.filter(F.col("o_orderstatus") == s), "order", "o_custkey", "day", ["day"])
    return feeds.not_yet_fed(rows("O"), rows("F")).select(F.get_json_object("payload", "$.ref").alias("ref"), "event_type")


@query(f"WITH {ORDERS} SELECT o_orderstatus, CAST(max(day) - INTERVAL 1 DAY AS DATE) AS start FROM o GROUP BY 1")
def high_water_mark(spark, d):
    return orders(spark, d).groupBy("o_orderstatus").agg(feeds.high_water(F.col("day")).alias("start"))


@query(f"""WITH {RACES} SELECT CAST(year(day) AS INTEGER) AS y, 'series ' || flag AS name, min(day) AS first, max(day) AS last, CAST(max(fleet) AS BIGINT) AS fleet, count(*) AS entries FROM r GROUP BY 1, 2""")
def events_derived(spark, d):
    return races(spark, d).groupBy(F.year("day").alias("y"), F.concat(F.lit("series "), F.col("flag")).alias("name")).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.max("fleet").alias("fleet"), F.count("*").alias("entries"))


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def page_titles(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).cast("long").alias("links"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS cert_number, 'BOAT' AS boat_name, 'AUS' || o_custkey AS sail_number FROM orders")
def file_name_parts(spark, d):
    name = F.concat_ws("_", F.col("o_orderkey").cast("string"), F.lit("BOAT"), F.concat(F.lit("AUS"), F.col("o_custkey").cast("string"), F.lit(".pdf")))
    return t(spark, d, "orders").select(*files.name_parts(name))


@query("""SELECT c_custkey AS id, c_name AS boat_name, CASE WHEN c_custkey % 4 <> 3 THEN CAST(1 + (c_custkey % 10) / 100.0 AS DOUBLE) END AS rating, 'finished' AS status FROM customer""")
def result_payloads(spark, d):
    k = F.col("c_custkey")
    caps = F.when(k % 4 == 3, F.array().cast("array<struct<definition:string,value:double>>")).when(k % 2 == 0, F.array(F.struct(F.lit("PHS").alias("definition"), F.lit(9.0).alias("value")), F.struct(F.lit("IRC").alias("definition"), (1 + k % 10 / 100).alias("value")))).otherwise(F.array(F.struct(F.lit("PHS").alias("definition"), (1 + k % 10 / 100).alias("value"))))
    item = F.struct(F.col("c_name").alias("boatName"), k.cast("string").alias("sailNo"), F.lit(1).alias("place"), F.lit("").alias("placingText"), F.lit("10:00").alias("finishTime"), caps.alias("handicaps"))
    body = F.to_json(F.struct(F.lit("E").alias("eventName"), F.lit("R").alias("raceName"), F.lit("2024-05-01").alias("date"), F.array(F.struct(F.lit("D").alias("division"), F.array(item).alias("items"))).alias("competitors")))
    r = files.race_rows(t(spark, d, "customer").select(body.alias("body")), "body")
    return r.select(F.col("sail_number").cast("long").alias("id"), "boat_name", F.col("rating_value").alias("rating"), F.when(F.col("placing_code") != "", F.col("placing_code")).otherwise("finished").alias("status"))
