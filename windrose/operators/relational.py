"""Relational building blocks: latest rows, as-of joins, change detection, ranks, bands, upserts. DataFrame in,
DataFrame out; each says which key it shuffles on."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import C, latin_key

Cols = Sequence[str | Column]


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; a temporary one only in local mode (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="windrose-"))


def later_within(df: DataFrame, key: str, same: Sequence[str], value: str, width: float) -> DataFrame:
    """key, next, n of every row that agrees in `same` with rows of a larger key and a value less than `width` away: the least
    such key and their number. Different values meet in bands, rows never do: keys are counted in their order."""
    rows = df.select(*same, value, key).dropna()
    values = rows.select(*same, value).distinct()
    # a band more on both sides: a quotient may be rounded
    near = values.withColumn("_b", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda i: F.floor(F.col(value) / width) + i)))
    far = values.withColumnRenamed(value, "_y").withColumn("_b", F.floor(F.col("_y") / width))
    pairs = near.join(far.hint("merge"), [*same, "_b"]).filter(F.abs(F.col(value) - F.col("_y")) < width).drop("_b")
    asks = rows.join(pairs.hint("merge"), [*same, value]).select(*same, value, "_y", key, F.lit(0).alias("_t"))
    told = rows.withColumnRenamed(value, "_y").join(pairs.hint("merge"), [*same, "_y"]).select(*same, value, "_y", key, F.lit(1).alias("_t"))
    w = Window.partitionBy(*same, value, "_y").orderBy(F.desc(key), "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asks.union(told).withColumn("n", F.sum("_t").over(w)).withColumn("next", F.min(F.when(F.col("_t") == 1, F.col(key))).over(w))
    return both.filter("_t = 0 AND n > 0").groupBy(key).agg(F.min("next").alias("next"), F.sum("n").alias("n"))


def pick_per_key(df: DataFrame, key: Cols, order: Cols) -> DataFrame:
    """The first row of each key by order; null keys are a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row with the largest order columns, nulls least. One aggregation with partial results, so a hot key costs
    one row a task, unlike a window."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_r")).select(key, "_r.*").select(*df.columns)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, left_id: str, tie: str) -> DataFrame:
    """Each left row with the last right row of its key at or before its time; none: nulls. One sort of both sides
    together by key and time, in place of a join of all earlier rows."""
    values = [c for c in right.columns if c != key]
    marked = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType))
    right_rows = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"), F.col(tie).alias("_tie"))
    both = marked.unionByName(right_rows, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_side", F.col("_tie").asc_nulls_last(), F.col(left_id).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select(*left.columns, *[F.col(f"_v.{c}").alias(c) for c in values if c not in left.columns])


def changes(df: DataFrame, key: Cols, order: Cols, value: str) -> DataFrame:
    """Rows whose value differs from the row before it of the same key, with prev and delta."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("prev", F.lag(value).over(w)).filter(F.col("prev").isNotNull() & (F.col("prev") != F.col(value))).withColumn("delta", F.col(value) - F.col("prev"))


def stable_since(columns: Sequence[str], w) -> Column:
    """True where each column equals the one before or either is null."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.col(c) == F.lag(c).over(w), F.lit(True))
    return out


def expected_share(df: DataFrame, race: Cols, rating: str) -> DataFrame:
    """Adds expected: (1 + how many of the race rate higher) / how many rate at all; null for fewer than two."""
    by = Window.partitionBy(*race)
    n = F.count(rating).over(by)
    rank = F.rank().over(by.orderBy(F.col(rating).desc_nulls_last()))
    return df.withColumn("expected", F.when((n >= 2) & F.col(rating).isNotNull(), rank / n))


def percent_below(df: DataFrame, group: Cols, value: str) -> Column:
    """100 * share of the group's values below one's own, without comparing all pairs."""
    below = F.rank().over(Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_last())) - 1
    return below / F.count(value).over(Window.partitionBy(*group)) * 100


def run_starts(df: DataFrame, key: Cols, order: Cols, value: Cols) -> DataFrame:
    """The first row of every run of equal values (nulls equal)."""
    w = Window.partitionBy(*key).orderBy(*order)
    packed = F.struct(*[C(v) for v in value])
    return df.withColumn("_p", F.lag(F.to_json(packed)).over(w)).filter(F.col("_p").isNull() | (F.col("_p") != F.to_json(packed))).drop("_p")


def sorted_list(value: str | Column, *order: str | Column) -> Column:
    """The values of a group in order, nulls kept."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[C(o).alias(f"o{i}") for i, o in enumerate(order)], C(value).alias("v")))), lambda s: s["v"])


def dealt_by_range(df: DataFrame, *order: Column) -> DataFrame:
    """df by ranges of the order, with each row's partition in _p. Written, so that counts by partition and the rows
    themselves see the same partitions, after a lost executor too."""
    checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).checkpoint()


def running(df: DataFrame, group: Sequence[str], order: str, weight: str) -> DataFrame:
    """Adds before, the sum of weight over the group's rows that come first by order (no two may be equal in group and
    order), and whole, the group's. Null groups are a group. No task sorts a whole group."""
    dealt = dealt_by_range(df, *[F.col(g).asc_nulls_first() for g in group], F.col(order).asc_nulls_first())
    names = [f"_g{i}" for i in range(len(group))]
    per = dealt.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col("_p").alias("_q")).agg(F.sum(weight).alias("_s"))
    w = Window.partitionBy(*names)
    per = per.withColumn("_first", F.sum("_s").over(w.orderBy("_q")) - F.col("_s")).withColumn("whole", F.sum("_s").over(w))
    same = F.col("_p") == F.col("_q")
    for g, n in zip(group, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    own = F.sum(weight).over(Window.partitionBy(*group, "_p").orderBy(F.col(order).asc_nulls_first())) - F.col(weight)
    return dealt.withColumn("_own", own).join(per, same).withColumn("before", F.col("_first") + F.col("_own")).drop("_p", "_q", "_s", "_first", "_own", *names)


def winsorised_means(df: DataFrame, group: str, values: Sequence[str], share: float = 0.1, least: int = 4, digits: int = 2) -> DataFrame:
    """A row a group with the winsorised mean of each column's values: values beyond the places int(n * share) and
    int(n * (1 - share)), from 0, take the values there; few values: mean. Counts by value, whose running sums give the two
    places."""
    long = df.select(F.col(group).alias("g"), F.explode(F.array(*[F.struct(F.lit(v).alias("c"), F.col(v).cast("double").alias("v")) for v in values])).alias("x")).select("g", "x.*")
    counts = running(long.filter("v IS NOT NULL").groupBy("g", "c", "v").agg(F.count("*").alias("n")), ["g", "c"], "v", "n")
    n = F.col("whole")
    first, last = F.when(n < least, 0).otherwise(F.floor(n * share)), F.when(n < least, n - 1).otherwise(F.least(F.floor(n * (1 - share)), n - 1))
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col("v")))
    cut = counts.groupBy(F.col("g").alias("h"), F.col("c").alias("d")).agg(at(first).alias("low"), at(last).alias("high"))
    held = counts.join(cut, F.col("g").eqNullSafe(F.col("h")) & (F.col("c") == F.col("d")))
    clipped = F.greatest(F.least("v", "high"), "low").cast("decimal(28,8)") * F.col("n")  # exact, whatever the order of the sum
    of = lambda v, x: F.sum(F.when(F.col("c") == v, x))
    wide = held.groupBy("g").agg(*[F.round(of(v, clipped) / of(v, F.col("n")), digits).cast("double").alias(f"_m{i}") for i, v in enumerate(values)])
    groups = df.select(F.col(group).alias("_g")).distinct()
    return groups.join(wide, F.col("_g").eqNullSafe(F.col("g")), "left").select(F.col("_g").alias(group), *[F.col(f"_m{i}").alias(v) for i, v in enumerate(values)])


def modal_value(df: DataFrame, key: str, value: str, most_distinct: int = 5) -> DataFrame:
    """key, mode: the most frequent value, ties to the smaller; null where there are most_distinct or more."""
    per = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    best = F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value)))
    return per.groupBy(key).agg(F.when(F.count("*") < most_distinct, best).alias("mode"), F.count("*").alias("n_distinct"))


def latest_non_empty(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of each column by itself, the last value that is neither null nor blank."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return df.groupBy(key).agg(*[F.max_by(text(c), F.when(text(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def upsert(old: DataFrame, new: DataFrame, key: Cols, batch: str = "_batch") -> DataFrame:
    """new over old by key; of several new rows the last batch position wins. Nulls in keys are equal."""
    tagged = old.withColumn("_src", F.lit(0)).withColumn(batch, F.lit(0).cast("long")).unionByName(new.withColumn("_src", F.lit(1)))
    return pick_per_key(tagged, key, [F.desc("_src"), F.desc(batch)]).drop("_src", batch)


def insert_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old and the rows of new whose key it lacks, one a key."""
    fresh = new.dropDuplicates(list(key)).alias("n").join(old.select(*key).distinct().alias("o"), [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key], "left_anti")
    return old.unionByName(fresh)


def fill_null(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Null columns of df from other (one row a key)."""
    src = other.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(src, key, "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def set_difference(left: DataFrame, right: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return left.join(right, list(key), "left_anti"), right.join(left, list(key), "left_anti")


FILTER_MARKS = ("!=", "~", ">=", "<=", "=", ">", "<")


def row_filter(df: DataFrame, expression: str) -> Column:
    """A small filter language as a Column: col=v, col!=v, col~part, comparisons, col:null, col:not_null; other text is
    looked for in all columns, by letters and digits alone. The text never becomes SQL."""
    e = expression.strip()
    for c in df.columns:
        if e == f"{c}:null":
            return F.col(c).isNull()
        if e == f"{c}:not_null":
            return F.col(c).isNotNull()
    for mark in FILTER_MARKS:
        head, found, value = e.partition(mark)
        if found and head.strip() in df.columns:
            c, v = F.col(head.strip()), F.lit(value.strip()).cast(df.schema[head.strip()].dataType)
            if mark == "~":
                return F.lower(c.cast("string")).contains(value.strip().lower())
            return {"!=": c != v, ">=": c >= v, "<=": c <= v, "=": c == v, ">": c > v, "<": c < v}[mark]
    needle = "".join(ch for ch in e.lower() if ch.isascii() and ch.isalnum())
    hits = [F.coalesce(latin_key(c).contains(needle), F.lit(False)) for c in df.columns]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def page(df: DataFrame, order: Cols, limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    return df.orderBy(*order).offset(offset).limit(limit), df.count()
