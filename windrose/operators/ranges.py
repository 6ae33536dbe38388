"""Operators on order, for groups of any size: rows are dealt by ranges of the order, each range is worked on by itself, and
only a few rows cross from one range to the next. The ranges are written (dealt_by_range), so a lost executor gets the
same ones; all that one task sees of all ranges is a row or so for each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import dealt_by_range, running


def asof_by_ranges(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, left_id: str, tie: str) -> DataFrame:
    """The rows of asof_join: each left row with the last right row of its key at or before its time, nulls if there is
    none. There one task sorts a key; here a key is spread over ranges of (key, time), and the last right row that a range knows
    of its last key is carried into those after it. Null keys have no right row."""
    values = [c for c in right.columns if c != key]
    kind = right.select(F.struct(*values).alias("v")).schema["v"].dataType
    marked = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_v": F.lit(None).cast(kind), "_tie": F.lit(None).cast(right.schema[tie].dataType)})
    known = right.filter(F.col(key).isNotNull()).select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"), F.col(tie).alias("_tie"))
    order = [F.col("_t").asc_nulls_first(), F.col("_side").asc(), F.col("_tie").asc_nulls_last(), F.col(left_id).asc_nulls_first()]
    dealt = dealt_by_range(marked.unionByName(known, allowMissingColumns=True), F.col(key).asc_nulls_first(), *order)
    # keys in several ranges: the first and the last of a range at most
    per = dealt.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k"), F.col("_p").alias("_q")).agg(F.max_by("_v", F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_last"))
    spread = Window.partitionBy("_k")
    carried = per.withColumn("_n", F.count("*").over(spread)).filter("_n > 1")
    carried = carried.withColumn("_carried", F.last("_last", ignorenulls=True).over(spread.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1))).select("_k", "_q", "_carried").filter("_carried IS NOT NULL")
    w = Window.partitionBy(key, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    out = own.join(carried, (F.col(key) == F.col("_k")) & (F.col("_p") == F.col("_q")), "left").withColumn("_v", F.coalesce("_v", "_carried"))
    return out.select(*left.columns, *[F.col(f"_v.{c}").alias(c) for c in values if c not in left.columns])


def group_quantiles(df: DataFrame, group: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """group and n, q: the number of known values and their exact quantiles at the given shares, interpolated between the two values
    next to (n - 1) * share; nulls for a group without a value. A group's values are counted and their running counts
    give the two places, so no buffer holds a group. Null groups are a group."""
    rows = df.select(*group, F.col(value).cast("double").alias("_value"))
    counts = running(rows.filter("_value IS NOT NULL").groupBy(*group, "_value").agg(F.count("*").alias("_n")), list(group), "_value", "_n")
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("_n")), F.col("_value")))
    places = []
    for i, share in enumerate(shares):
        place = (F.col("whole") - 1) * F.lit(float(share))
        places += [at(F.floor(place)).alias(f"_a{i}"), at(F.ceil(place)).alias(f"_b{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
    found = counts.groupBy(*group).agg(F.max("whole").alias("n"), *places)
    q = F.array(*[F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}") for i in range(len(shares))])
    found = found.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "n", q.alias("q"))
    same: Column = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    none = F.array(*[F.lit(None).cast("double") for _ in shares])
    return rows.select(*group).distinct().join(found, same, "left").select(*group, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("q", none).alias("q"))


#: Accuracy of a sketch; the rank of a quantile is then within RANK_ERROR of what was asked, in 99 of 100 cases.
ACCURACY, RANK_ERROR = 200, 0.0165


def quantile_sketches(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """group and sketch: a summary of a group's values of a few kilobytes, whatever their number. Sketches of parts, such as days,
    can be stored and merged, so a refresh reads what is new only."""
    return df.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(ACCURACY)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, group: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """group and n, q of stored sketches, merged: estimates of group_quantiles."""
    whole = sketches.groupBy(*group).agg(F.kll_merge_agg_double("sketch").alias("_s"))
    return whole.select(*group, F.kll_sketch_get_n_double("_s").alias("n"), F.array(*[F.kll_sketch_get_quantile_double("_s", F.lit(float(s))) for s in shares]).alias("q"))


def nearest(df: DataFrame, id_col: str, value: str, k: int) -> DataFrame:
    """id, other, gap, n: for every row the k others (n from 1) with the nearest values. Equally near ones: fewer rows between
    them in the order of (value, id) come first, then the lower one. Rows without a value take no part; ids must differ.

    Each range gets the k rows before and after it, from further ranges too where its neighbours are short."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(id_col).alias("id"), F.col(value).alias("v"))
    dealt = dealt_by_range(rows, F.col("v").asc(), F.col("id").asc())
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    line = Window.orderBy("_p")  # a row a range
    sizes = sizes.select("_p", F.row_number().over(line).alias("_d"), F.sum("_n").over(line).alias("_upto"), (F.sum("_n").over(line) - F.col("_n")).alias("_before"))
    own = Window.partitionBy("_p").orderBy("v", "id")
    placed = dealt.withColumn("_at", F.row_number().over(own)).join(F.broadcast(sizes), "_p").withColumn("_at", F.col("_at") + F.col("_before"))  # broadcast: a row a range
    ranges = sizes.select(F.col("_d").alias("_to"), (F.col("_before") + 1).alias("_low"), F.col("_upto").alias("_high"))
    edge = placed.filter((F.col("_at") <= F.col("_before") + k) | (F.col("_at") > F.col("_upto") - k))
    # at most k ranges can lie between a row and the last range that it is a neighbour of, as none is empty
    reach = F.explode(F.concat(F.sequence(F.col("_d") - k, F.col("_d") - 1), F.sequence(F.col("_d") + 1, F.col("_d") + k)))
    guests = edge.select("id", "v", "_at", reach.alias("_to")).join(F.broadcast(ranges), "_to").filter((F.col("_at") >= F.col("_low") - k) & (F.col("_at") <= F.col("_high") + k))
    held = placed.select("id", "v", "_at", F.col("_d").alias("_to"), F.lit(True).alias("_own")).union(guests.select("id", "v", "_at", "_to", F.lit(False)))
    w = Window.partitionBy("_to").orderBy("_at")
    around = [f(F.struct("id", "v", "_at"), i).over(w) for i in range(1, k + 1) for f in (F.lag, F.lead)]
    near = held.select("id", "v", "_at", "_own", F.array_compact(F.array(*around)).alias("_others")).filter("_own")
    turn = F.transform("_others", lambda o: F.struct(F.abs(o["v"] - F.col("v")).alias("gap"), F.abs(o["_at"] - F.col("_at")).alias("far"), o["_at"].alias("at"), o["id"].alias("other")))
    best = F.slice(F.array_sort(turn), 1, k)
    return near.select("id", F.posexplode(best).alias("n", "o")).select(F.col("id").alias(id_col), F.col("o.other").alias("other"), F.col("o.gap").alias("gap"), (F.col("n") + 1).alias("n"))
