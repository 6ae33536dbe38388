"""Table writers without MERGE: each reads the old table, builds the new one as a plan, and writes it beside the old
before swapping, so a failed run leaves the old one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import dealt_by_range, latest_per_key, upsert


def replace_table(df: DataFrame, path: str) -> None:
    """The new table is written beside the old one, which is put aside before the new one takes its place and deleted
    after; whatever fails, the old one is under path or under path__old."""
    spark, bare = df.sparkSession, path.rstrip("/")
    df.write.mode("overwrite").parquet(f"{bare}__new")
    p = spark._jvm.org.apache.hadoop.fs.Path
    old, new, at = p(f"{bare}__old"), p(f"{bare}__new"), p(bare)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(at)
    if had:
        fs.delete(old, True)
        if not fs.rename(at, old):
            raise OSError(f"could not put {path} aside")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"could not put the new table at {path}")
    fs.delete(old, True)


def with_ids(df: DataFrame, id_col: str, start: int, order: Sequence[str]) -> DataFrame:
    """Consecutive ids after start for rows without one, by order, from ranges of the order with offsets: no task sorts
    everything, and the ranges are written, so that a rerun task gives the same ids."""
    have, need = df.filter(F.col(id_col).isNotNull()), df.filter(F.col(id_col).isNull())
    need = dealt_by_range(need, *[F.col(c).asc_nulls_first() for c in order])
    counts = need.groupBy(F.col("_p").alias("_q")).agg(F.count("*").alias("_n"))
    first = counts.select("_q", (F.sum("_n").over(Window.orderBy("_q")) - F.col("_n")).alias("_first"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    out = need.withColumn("_own", own).join(first, F.col("_p") == F.col("_q")).withColumn(id_col, (F.lit(start) + F.col("_first") + F.col("_own")).cast(df.schema[id_col].dataType))
    return have.unionByName(out.select(*df.columns))


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: Sequence[str], batch: str = "_batch") -> None:
    replace_table(upsert(spark.read.parquet(path), new, key, batch), path)


def widen_years(old: DataFrame, new: DataFrame, key: Sequence[str], first: str, last: str) -> DataFrame:
    """Union by key with the smallest first and the largest last year; other columns from the old row where set."""
    others = [c for c in old.columns if c not in (*key, first, last)]
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    keep = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in others]
    return both.groupBy(*key).agg(*keep, F.min(first).alias(first), F.max(last).alias(last)).select(*old.columns)


def guarded_upsert(old: DataFrame, new: DataFrame, key: str, state: str, open_states: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows in an open state take new values (null keeps the old one); others stay; unknown keys are added."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    kept = old.join(n, key, "left").select(*[F.when(F.col(state).isin(*open_states), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])
    return kept.unionByName(new.join(old, key, "left_anti"), allowMissingColumns=True).select(*old.columns)


def change_upsert(old: DataFrame, new: DataFrame, key: Sequence[str], date: str, content: Sequence[str]) -> DataFrame:
    """Dated snapshots: where new content equals the key's latest row its date moves forward (unless that date is
    taken); otherwise the row is added. was_new tells which."""
    packed = F.to_json(F.struct(*content))
    k = F.struct(*key)
    tagged = old.withColumn("_k", k)
    latest = latest_per_key(tagged.select("_k", F.col(date).alias("_last"), packed.alias("_c")), "_k", ["_last"])
    n = new.withColumn("_k", k).withColumn("_new", packed).join(latest, "_k", "left")
    same = F.coalesce(F.col("_new") == F.col("_c"), F.lit(False)) & (F.col(date) >= F.col("_last"))
    moved = n.filter(same).select("_k", "_last", F.col(date).alias("_to"))
    moved = moved.groupBy("_k", "_last").agg(F.max("_to").alias("_to"))
    kept = tagged.join(moved, (tagged["_k"] == moved["_k"]) & (tagged[date] == moved["_last"]), "left").select(*[F.coalesce("_to", date).alias(date) if c == date else F.col(c) for c in old.columns], F.lit(False).alias("was_new"))
    taken = old.select(*key, date)
    added = n.filter(~same).select(*old.columns).join(taken, [*key, date], "left_anti").dropDuplicates([*key, date]).withColumn("was_new", F.lit(True))
    return kept.unionByName(added)


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def audited_update(df: DataFrame, pk: str, pk_value, column: str, value, who: str, as_of: str) -> tuple[DataFrame, DataFrame]:
    """The table with one cell changed, and the audit row with the old value."""
    hit = F.col(pk) == F.lit(pk_value)
    audit = df.filter(hit).select(F.lit(pk).alias("pk"), F.col(pk).cast("string").alias("pk_value"), F.lit(column).alias("column"), F.col(column).cast("string").alias("old"), F.lit(str(value)).alias("new"), F.lit(who).alias("who"), F.lit(as_of).cast("timestamp").alias("at"))
    return df.withColumn(column, F.when(hit, F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(column))), audit


def apply_corrections(df: DataFrame, corrections: DataFrame, pk: str) -> DataFrame:
    """corrections: pk, column, value, status. Pending ones are applied, of several for a cell the last by id."""
    pending = corrections.filter("status = 'pending'").groupBy(F.col(pk), "column").agg(F.max_by("value", "id").alias("value"))
    wide = pending.groupBy(pk).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_fix"))
    fixed = lambda c: F.when(F.map_contains_key("_fix", c), F.element_at("_fix", c).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return df.join(wide, pk, "left").withColumn("_fix", F.coalesce("_fix", F.expr("map()").cast("map<string,string>"))).select(*[F.col(c) if c == pk else fixed(c) for c in df.columns])


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def json_row(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*(columns or ("*",))))
