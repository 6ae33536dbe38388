"""Entity resolution: token, name and fuzzy matching by ordered rules, duplicate clusters, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ambiguous_sail, normalize_name, sail_tokens, trigram_similarity, trigrams
from .relational import checkpoint_dir, pick_per_key


def cascade(results: DataFrame, rules: Sequence[tuple[str, DataFrame]], key: str = "result_id") -> DataFrame:
    """The first rule that names exactly one boat for a result. rules: (method, candidates with key and boat_id)."""
    found = None
    for i, (method, cands) in enumerate(rules):
        one = cands.select(key, "boat_id").distinct().groupBy(key).agg(F.count("*").alias("n"), F.min("boat_id").alias("boat_id")).filter("n = 1")
        part = one.select(key, "boat_id", F.lit(method).alias("method"), F.lit(i).alias("priority"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(key).agg(F.min(F.struct("priority", "boat_id", "method")).alias("b"))
    return results.join(best.select(key, "b.boat_id", "b.method"), key, "left")


def token_candidates(results: DataFrame, boats: DataFrame, sail: str = "sail", key: str = "result_id") -> DataFrame:
    left = results.select(key, F.explode(sail_tokens(sail)).alias("token"))
    right = boats.select("boat_id", F.explode(sail_tokens("boat_sail")).alias("token"))
    return left.join(right, "token").select(key, "boat_id").distinct()


def name_candidates(results: DataFrame, boats: DataFrame, name: str = "name", key: str = "result_id", extra: Column | None = None) -> DataFrame:
    """Equal names after clean-up; extra: a further condition over both sides' columns."""
    j = results.withColumn("_k", normalize_name(name)).join(boats.withColumn("_k", normalize_name("boat_name")), "_k").filter("_k <> ''")
    return (j.filter(extra) if extra is not None else j).select(key, "boat_id")


def certificate_match(certs: DataFrame, boats: DataFrame) -> DataFrame:
    """certs: result_id, sail, name, country. One candidate by tokens is taken, unless the sail is a short number and
    the name differs (then the row is skipped); of several, one by name, then one by country; else name and country.
    The candidates of a row are counted once, with what they have in common with it; no rule reads them again."""
    b = boats.select("boat_id", normalize_name("boat_name").alias("_bn"), F.col("boat_country").alias("_bc"))
    c = certs.withColumn("_n", normalize_name("name"))
    cand = token_candidates(certs, boats).join(b, "boat_id").join(c.select("result_id", "_n", "country"), "result_id")
    named, at_home = F.col("_n") == F.col("_bn"), F.col("country") == F.col("_bc")
    per = cand.groupBy("result_id").agg(
        F.count("*").alias("_all"), F.min("boat_id").alias("_any"), F.count_if(named).alias("_named"), F.min(F.when(named, F.col("boat_id"))).alias("_by_name"), F.count_if(at_home).alias("_home"), F.min(F.when(at_home, F.col("boat_id"))).alias("_by_country")
    )
    both = c.filter("_n <> ''").join(b, named & at_home).groupBy("result_id").agg(F.countDistinct("boat_id").alias("_both"), F.min("boat_id").alias("_by_both"))
    x = c.join(per, "result_id", "left").join(both, "result_id", "left")
    one, several = F.col("_all") == 1, F.col("_all") > 1
    skipped = one & ambiguous_sail("sail") & (F.col("_named") == 0) & (F.col("_n") != "")
    rules = [("token", one, "_any"), ("token_name", several & (F.col("_named") == 1), "_by_name"), ("token_country", several & (F.col("_home") == 1), "_by_country"), ("name_country", F.col("_both") == 1, "_by_both")]
    boat, method = F.when(skipped, None), F.when(skipped, "skipped")
    for name, holds, column in rules:
        boat, method = boat.when(holds, F.col(column)), method.when(holds, name)
    return x.withColumn("boat_id", boat).withColumn("method", method.otherwise("unmatched")).select(*certs.columns, "boat_id", "method")


# Fixed value: joins that work long on few bytes are dealt over at least so many tasks; what is sent to all is told by size only.
SPREAD = 64


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df by hash over at least SPREAD tasks, which aren't put together again because their bytes are few."""
    return df.repartition(max(SPREAD, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def similar_texts(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """a, b, similarity of the distinct pairs of texts with a trigram similarity of at least `least`, blocked on the trigrams
    that any such pair must share: of a set of n, ordered by rarity, the first n - ceil(least * n) + 1. A pair is tried if what
    its sets can still share from a common trigram on is enough. Only the counts of the trigrams are sent to all."""
    tag = lambda df, c: df.select(F.col(c).alias("_v")).filter("_v IS NOT NULL").distinct().withColumn("_g", trigrams("_v")).filter(F.size("_g") > 0)
    x, y = tag(left, a), tag(right, b)
    freq = x.select(F.explode("_g").alias("g")).union(y.select(F.explode("_g").alias("g"))).groupBy("g").agg(F.count("*").alias("f"))
    # three code points of 21 bits: a number for each trigram, no two alike
    freq = freq.withColumn("i", sum(F.shiftleft(F.ascii(F.substring("g", k + 1, 1)).cast("long"), 42 - 21 * k) for k in range(3)))

    def prefixes(df: DataFrame, side: str) -> DataFrame:
        each = df.select("_v", F.explode("_g").alias("g")).join(F.broadcast(freq), "g").groupBy("_v").agg(F.array_sort(F.collect_list(F.struct("f", "i"))).alias("_s"))
        n = F.size("_s")
        first = F.slice("_s", F.lit(1), (n - F.ceil(F.lit(least) * n) + 1).cast("int"))
        out = each.select("_v", n.alias("n"), F.transform("_s", lambda s: s["i"]).alias("gs"), F.posexplode(first).alias("r", "_p"))
        return out.select(F.col("_p.i").alias("g"), *[F.col(c).alias(f"{side}{c}") for c in ("_v", "n", "gs", "r")])

    both = F.col("xn") + F.col("yn")
    enough = F.least(F.col("xn") - F.col("xr"), F.col("yn") - F.col("yr")) >= F.lit(least / (1 + least)) * both - 1e-6
    same = F.size(F.array_intersect("xgs", "ygs"))
    pairs = dealt(prefixes(x, "x"), "g").join(dealt(prefixes(y, "y"), "g").hint("merge"), "g").filter(enough & (same / (both - same) >= least))
    return pairs.select(F.col("x_v").alias(a), F.col("y_v").alias(b), (same / (both - same)).alias("similarity")).distinct()


def similar_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """All pairs of rows with a trigram similarity of at least `least`; equal strings are compared once. Neither table is sent
    whole through the driver: the size of a file says little about its rows."""
    close = similar_texts(left, right, a, b, least).withColumnsRenamed({a: "_l", b: "_r"})
    both = left.withColumn("_l", F.col(a)).join(close.hint("merge"), "_l").drop("_l")
    return both.join(right.withColumn("_r", F.col(b)).hint("merge"), "_r").drop("_r")


def fuzzy_search(boats: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """By the larger of the similarities to name and sail; names above 0.3 or sails above 0.5 count."""
    q = F.lit(query)
    s = boats.withColumn("s_name", trigram_similarity("boat_name", q)).withColumn("s_sail", trigram_similarity("boat_sail", q))
    return s.filter("s_name > 0.3 OR s_sail > 0.5").withColumn("score", F.greatest("s_name", "s_sail")).orderBy(F.desc("score"), "boat_id").limit(limit)


def open_boats(boats: DataFrame) -> DataFrame:
    """Without secondary certificates."""
    return boats.filter(~F.coalesce(F.endswith("boat_name", F.lit(" - SEC")), F.lit(False))).select("boat_id", "boat_name", "boat_sail")


def search_texts(texts: DataFrame, boats: DataFrame) -> DataFrame:
    """q, boat_id, score of every boat that a text (q) finds; a boat found by its name isn't looked for by its sail."""
    b = open_boats(boats)
    named = similar_texts(texts, b, "q", "boat_name", 0.3).filter("similarity > 0.3").join(b.hint("merge"), "boat_name")
    named = named.select("q", "boat_id", F.greatest("similarity", trigram_similarity("boat_sail", "q")).alias("score"))
    sailed = similar_texts(texts, b, "q", "boat_sail", 0.5).filter("similarity > 0.5").join(b.hint("merge"), "boat_sail").withColumn("_n", trigram_similarity("boat_name", "q"))
    return named.union(sailed.filter("_n <= 0.3").select("q", "boat_id", F.greatest("similarity", "_n").alias("score")))


def search_batch(queries: DataFrame, boats: DataFrame) -> DataFrame:
    """query_id, boat_id, score of every boat that a query (query_id, q) finds: as fuzzy_search for all queries at once, secondary
    certificates apart. Pairs come from trigrams that they must share, not from all boats for each query; equal queries are
    searched once. Their rows come last, in tasks that each hold a share of a text's boats."""
    hits = search_texts(queries.select("q").filter("q IS NOT NULL").distinct(), boats)
    hits = hits.withColumn("_s", F.pmod(F.xxhash64("boat_id"), F.lit(SPREAD)).cast("int"))
    asked = queries.select("query_id", "q", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_s"))
    return dealt(hits, "q", "_s").join(dealt(asked, "q", "_s").hint("merge"), ["q", "_s"]).select("query_id", "boat_id", "score")


def deletions(text: Column, most: int = 2) -> Column:
    """The text and all that is left of it without up to `most` letters: texts within `most` edits of each other share one."""
    out = F.array(text)
    shorter = lambda s: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))), lambda x: F.length(s) > 0)
    last = out
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, shorter)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def near_texts(left: DataFrame, right: DataFrame, a: str, b: str, most: int = 2) -> DataFrame:
    """a, b, distance of the distinct pairs within `most` edits, joined on what deletions leave of both; texts of a length that
    is near none of the other side's leave nothing. What is left is many times the texts, so it isn't broadcast."""
    x = left.select(a).filter(F.col(a).isNotNull()).distinct()
    y = right.select(b).filter(F.col(b).isNotNull()).distinct().withColumn("_n", F.length(b))
    sizes = x.select(F.explode(F.sequence(F.length(a) - most, F.length(a) + most)).alias("_n")).distinct()
    rest = lambda df, c: df.select(c, F.explode(deletions(F.col(c), most)).alias("_v"))
    pairs = dealt(rest(x, a), "_v").join(dealt(rest(dealt(y.join(sizes, "_n", "left_semi"), b), b), "_v").hint("merge"), "_v").select(a, b).distinct()
    return pairs.withColumn("distance", F.levenshtein(a, b)).filter(F.col("distance") <= most)


# Sails count from 3 to 10 letters of the query, within 2 of its length and 2 edits; names above 0.18; a
# sail of another length is as far as this.
SHORTEST, LONGEST, EDITS, ALIKE, FAR = 3, 10, 2, 0.18, 999


def suggest_batch(queries: DataFrame, boats: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, rank, boat_id, sail_dist, name_sim: for every query (query_id, q) of two letters and more that finds
    nothing, the boats with a sail within two edits or a name that is alike, nearest sail first, then the most alike name, then
    by name and boat_id. Both branches are joins over all different texts; ranks are cut off before the shuffle. A text that finds
    a name or a sail needs none of its boats to be out. No join sends a side that grows to all."""
    checkpoint_dir(queries.sparkSession)
    b = open_boats(boats).withColumn("_s", F.upper("boat_sail"))
    asked = queries.select("query_id", "q").filter(F.length(F.trim("q")) >= 2)
    texts = asked.select("q").distinct()
    unnamed = texts.join(similar_texts(texts, b, "q", "boat_name", 0.3).filter("similarity > 0.3").hint("merge"), "q", "left_anti").checkpoint()
    lost = unnamed.join(similar_texts(unnamed, b, "q", "boat_sail", 0.5).filter("similarity > 0.5").hint("merge"), "q", "left_anti").checkpoint()
    short = lost.filter(F.length("q").between(SHORTEST, LONGEST)).withColumn("_q", F.upper("q"))
    near = short.join(near_texts(short, b.filter(F.length("_s") <= LONGEST + EDITS), "_q", "_s", EDITS).hint("merge"), "_q").select("q", "_s")
    by_sail = near.join(b.hint("merge"), "_s").select("q", "boat_id", "boat_name", "boat_sail", "_s")
    alike = similar_texts(lost, b, "q", "boat_name", ALIKE).filter(F.col("similarity") > ALIKE)
    found = by_sail.union(alike.join(b.hint("merge"), "boat_name").select("q", "boat_id", "boat_name", "boat_sail", "_s")).distinct()
    gate = F.abs(F.length("boat_sail") - F.length("q")) <= EDITS
    found = found.withColumn("sail_dist", F.coalesce(F.when(gate, F.levenshtein("_s", F.upper("q"))), F.lit(FAR))).withColumn("name_sim", trigram_similarity("boat_name", "q"))
    w = Window.partitionBy("q").orderBy("sail_dist", F.desc("name_sim"), "boat_name", "boat_id")
    first = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return first.join(asked.hint("merge"), "q").select("query_id", "rank", "boat_id", "sail_dist", "name_sim")


def suggestions(boats: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """boat_id, sail_dist, name_sim suggested for one query that finds nothing, in order: as suggest_batch, but one query needs
    no joins. Every boat is compared with it once, and only whether any is found is sent to all."""
    q = F.lit(query).cast("string")
    size = F.length(q)
    b = dealt(open_boats(boats), "boat_id").withColumn("name_sim", trigram_similarity("boat_name", q))
    asked = b.filter(F.length(F.trim(q)) >= 2)
    finds = asked.agg(F.max((F.col("name_sim") > 0.3) | (trigram_similarity("boat_sail", q) > 0.5)).alias("_finds"))
    gate = F.abs(F.length("boat_sail") - size) <= EDITS
    near = asked.withColumn("sail_dist", F.coalesce(F.when(gate, F.levenshtein(F.upper("boat_sail"), F.upper(q))), F.lit(FAR)))
    near = near.filter((size.between(SHORTEST, LONGEST) & (F.col("sail_dist") <= EDITS)) | (F.col("name_sim") > ALIKE))
    # where nothing is found no name is, so every row meets the one row that says so
    out = near.withColumn("_finds", F.col("name_sim") > 0.3).join(F.broadcast(finds.filter("NOT _finds")), "_finds")
    return out.orderBy("sail_dist", F.desc("name_sim"), "boat_name", "boat_id").limit(limit).select("boat_id", "sail_dist", "name_sim")


def duplicate_clusters(df: DataFrame, key: Sequence[Column], id_col: str) -> DataFrame:
    """Groups of two and more rows with an equal, non-empty key: size, ids in order; a group's ids are its result,
    one row. The key is worked out once a row: what stands behind the explode isn't pushed below it."""
    names = [f"k{i}" for i in range(len(key))]
    packed = F.explode(F.array(F.struct(*[k.alias(n) for k, n in zip(key, names, strict=True)])))
    keyed = df.select(id_col, packed.alias("_k")).select(id_col, "_k.*")
    for n in names:
        keyed = keyed.filter(F.col(n).isNotNull() & (F.col(n).cast("string") != ""))
    return keyed.groupBy(*names).agg(F.count("*").alias("size"), F.array_sort(F.collect_list(id_col)).alias("ids")).filter("size > 1")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component: the least id reachable. Every round writes its labels to the shared checkpoint folder, halves the
    way along label chains, and stops when nothing changed."""
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct().checkpoint()
    labels = both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("component")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("component").alias("m"))
        low = labels.join(near, "id").select("id", "component", F.least("component", "m").alias("low"))
        far = labels.select(F.col("id").alias("low"), F.col("component").alias("far"))
        new = low.join(far, "low", "left").select("id", F.col("component").alias("was"), F.least("low", F.coalesce("far", "low")).alias("component")).checkpoint()
        labels = new.select("id", "component")
        if not new.filter("was <> component").limit(1).count():
            return labels


def token_groups(results: DataFrame, sail: str = "sail", key: str = "result_id") -> DataFrame:
    """Rows joined by shared tokens, over any number of steps, with a group number: unlike a one-pass grouping, a row
    that bridges two groups merges them, whatever the order of the rows. A row belongs to the first rows of its shared tokens;
    only rows with several link these, so the rounds pass over different links, not over rows."""
    checkpoint_dir(results.sparkSession)
    tokens = dealt(results.select(key, sail), key).select(key, F.explode(sail_tokens(sail)).alias("token"))
    shared = tokens.groupBy("token").agg(F.min(key).alias("a"), F.count("*").alias("n")).filter("n > 1").select("token", "a")
    hubs = tokens.join(shared.hint("merge"), "token").groupBy(key).agg(F.array_sort(F.collect_set("a")).alias("_h")).checkpoint()
    comp = connected_components(hubs.select(F.get("_h", F.lit(0)).alias("a"), F.explode(F.slice("_h", F.lit(2), F.size("_h"))).alias("b")).distinct())
    first = hubs.select(key, F.get("_h", F.lit(0)).alias("_first")).join(comp.withColumnRenamed("id", "_first"), "_first", "left")
    first = first.select(key, F.coalesce("component", "_first").alias("group_id"))
    return results.join(first.hint("merge"), key, "left").withColumn("group_id", F.coalesce("group_id", key))


def merge_rows(df: DataFrame, losers: DataFrame, key: str, same: Sequence[str], keep: Sequence[Column]) -> DataFrame:
    """df with losing ids (loser, winner) replaced; of rows that then agree in `same`, the first by `keep` stays, the
    winner's own before others."""
    moved = df.join(losers.withColumnRenamed("loser", key), key, "left")
    moved = moved.withColumn("_own", F.col("winner").isNull()).withColumn(key, F.coalesce("winner", key)).drop("winner")
    return pick_per_key(moved, [key, *same], [*keep, F.desc("_own")]).drop("_own")
