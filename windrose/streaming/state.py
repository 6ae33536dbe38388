"""Operators with state per key that ends: runs of unchanged content over streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """State of processors lies in RocksDB, so it may be larger than an executor's memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Running(StatefulProcessor):
    """Emits the rows whose value differs from the start of the running one."""

    def __init__(self, key: str, order: str, value: str, keep_ms: int | None):
        self.key, self.order, self.value, self.keep_ms = key, order, value, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "value string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = self.current.exists()
        current = self.current.get()[0] if known else None
        frame = pd.concat(list(rows)).sort_values([self.order, self.value], na_position="first")
        out = []
        for o, v in zip(frame[self.order], frame[self.value], strict=True):
            v = None if pd.isna(v) else v
            if not known or (v is not None and current is not None and v != current):
                out.append((key[0], o, v))
                current, known = v, True
            elif current is None:
                current = v
        self.current.update((current,))
        yield pd.DataFrame(out, columns=[self.key, self.order, self.value])

    def close(self) -> None:
        pass


def compact_runs(stream: DataFrame, key: str, order: str, value: str, keep: dt.timedelta | None = None) -> DataFrame:
    """Of every key's arriving rows, those whose value differs from the start of the running one; a null value agrees
    with anything. The state is that one value; a key that nothing was heard of for the time `keep`, by the clock, is forgotten,
    and its next row begins a run. As the clock goes on without rows, a query with `keep` runs by an interval or once: it never
    has all that is available."""
    with_state_store(stream.sparkSession)
    key_type, order_type = (stream.schema[c].dataType.simpleString() for c in (key, order))
    processor = _Running(key, order, value, int(keep.total_seconds() * 1000) if keep else None)
    rows = stream.select(key, order, F.col(value).cast("string").alias(value)).groupBy(key)
    return rows.transformWithStateInPandas(processor, f"{key} {key_type}, {order} {order_type}, {value} string", "Append", "ProcessingTime" if keep else "None")


class _Snapshots(StatefulProcessor):
    """One open run a key: content, first and last time, rows. It is emitted when other content begins, or when the
    watermark has passed its last time by the time to live."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "content string, first long, last long, n long")

    def frame(self, key, runs: list[tuple]) -> pd.DataFrame:
        at = lambda ms: pd.Timestamp(ms, unit="ms")
        out = pd.DataFrame([(*key, c, at(a), at(z), n) for c, a, z, n in runs], columns=["key", "content", "first", "last", "n"])
        return out.astype({"first": "datetime64[ns]", "last": "datetime64[ns]", "n": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        run = self.run.get() if self.run.exists() else None
        before, done = run, []
        frame = pd.concat(list(rows)).sort_values(["ms", "content"])
        for at, content in zip(frame["ms"].tolist(), frame["content"], strict=True):
            if run is not None and content == run[0] and at <= run[2] + self.keep_ms:
                run = (run[0], min(run[1], at), max(run[2], at), run[3] + 1)
            elif run is not None and at < run[2]:
                done.append((content, at, at, 1))  # late: a run of its own, the open one goes on
            else:
                if run is not None:
                    done.append(tuple(run))
                run = (content, at, at, 1)
        if before is not None and before[2] != run[2]:
            self.handle.deleteTimer(before[2] + self.keep_ms)
        if before is None or before[2] != run[2]:
            self.handle.registerTimer(run[2] + self.keep_ms)
        self.run.update(run)
        yield self.frame(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        run = self.run.get() if self.run.exists() else None
        if run is None or run[2] + self.keep_ms > expiredTimerInfo.getExpiryTimeInMs():
            return
        self.run.clear()
        yield self.frame(key, [tuple(run)])

    def close(self) -> None:
        pass


def packed(columns: Sequence[str]):
    """The content of a row as text, nulls included, so that equal texts are equal content."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def snapshot_runs(stream: DataFrame, keys: Sequence[str], time: str, content: Sequence[str], keep: dt.timedelta, late: str = "1 day") -> DataFrame:
    """keys, content (JSON), first, last, n: a closed run of snapshots of equal content. A snapshot that repeats its key's content only
    moves the run's end; other content, or nothing for longer than `keep`, ends it, so the state holds one run of each key seen within that
    time. A late snapshot of other content is a run of its own."""
    with_state_store(stream.sparkSession)
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    # names without an underscore before them: the processor gets others for such
    rows = stream.withWatermark(time, late).select(packed(keys).alias("key"), F.col(time).alias("time"), F.unix_millis(F.col(time)).alias("ms"), packed(content).alias("content"))
    schema = "key string, content string, first timestamp, last timestamp, n long"
    runs = rows.groupBy("key").transformWithStateInPandas(_Snapshots(int(keep.total_seconds() * 1000)), schema, "Append", "EventTime")
    return runs.withColumn("key", F.from_json("key", kinds)).select("key.*", "content", "first", "last", "n")


def snapshot_runs_table(df: DataFrame, keys: Sequence[str], time: str, content: Sequence[str], keep: dt.timedelta) -> DataFrame:
    """The same over a table: all runs, those still open included."""
    from pyspark.sql import Window

    rows = df.select(*keys, F.col(time).alias("_t"), packed(content).alias("content"))
    w = Window.partitionBy(*keys).orderBy("_t", "content")
    far = F.col("_t") > F.lag("_t").over(w) + F.lit(keep)
    begins = F.lag("content").over(w).isNull() | (F.lag("content").over(w) != F.col("content")) | far
    rows = rows.withColumn("_run", F.sum(F.when(begins, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*keys, "_run").agg(F.min("content").alias("content"), F.min("_t").alias("first"), F.max("_t").alias("last"), F.count("*").alias("n")).drop("_run")

