"""Incremental feeds on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def feed_rows(events: DataFrame, kind: str, ref: str, date: str, payload: Sequence[str]) -> DataFrame:
    """Feed entries with a JSON payload that carries the reference."""
    body = F.to_json(F.struct(F.col(ref).alias("ref"), *payload))
    return events.select(F.lit(kind).alias("event_type"), F.col(date).alias("event_date"), body.alias("payload"))


def not_yet_fed(rows: DataFrame, feed: DataFrame) -> DataFrame:
    """Entries whose reference the feed lacks; of several with one reference the least payload."""
    ref = lambda: F.get_json_object("payload", "$.ref")
    known = feed.select("event_type", ref().alias("ref")).distinct()
    return rows.withColumn("ref", ref()).join(known, ["event_type", "ref"], "left_anti").groupBy("event_type", "ref").agg(F.min(F.struct("payload", "event_date")).alias("b")).select("event_type", "b.event_date", "b.payload")


def run_feed(source: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], interval: str | None = None):
    """Append new entries micro-batch by micro-batch; a batch that runs again after a failure adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = make(batch)
        try:
            feed = spark.read.schema(rows.schema).parquet(path)
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            feed = rows.limit(0)
        not_yet_fed(rows, feed).write.mode("append").parquet(path)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def high_water(time: str | Column, overlap_days: int = 1) -> Column:
    """Where an incremental read starts: the newest day less an overlap for late rows."""
    return F.date_sub(F.max(F.to_date(time)), overlap_days)


def sliding_counts(stream: DataFrame, time: str, key: str, length: str = "1 day", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, length, slide), key).agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n")


def once_each(stream: DataFrame, time: str, ids: Sequence[str], late: str = "1 day") -> DataFrame:
    """Late repeats of an id are dropped while the watermark remembers it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(ids))


def run_length_compact(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The same over a table: rows are compared with the start of their run, which isn't the same as with the row
    before, because null agrees with anything. Carried as the last known value of the run: only non-null values can
    begin a run, so comparing with the last non-null value before gives the same runs, in one window."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order, F.col(value).asc_nulls_first())
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(w) == 1
    return df.withColumn("_b", before).withColumn("_f", first).filter(F.col("_f") | (F.col(value).isNotNull() & F.col("_b").isNotNull() & (F.col(value) != F.col("_b")))).drop("_b", "_f")


def events_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
