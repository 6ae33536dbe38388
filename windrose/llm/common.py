"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule shared by several operators: space and \t \n \v \f \r.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(sc, "_windrose_dir", None):
        sc._windrose_dir = tempfile.mkdtemp(prefix="windrose-")
        sc.setCheckpointDir(sc._windrose_dir)
    return sc._windrose_dir


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again, so that a lost executor costs
    the work since then only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._windrose_path = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_windrose_path", None)
        if path:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def unused(name: str, df: DataFrame) -> str:
    """name, with underscores before it as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, row: str = "_row") -> DataFrame:
    """df as a written table with an own number for every row, so that rows whose keys are null or repeated can be told
    apart by all that reads it."""
    return stage(df.withColumn(row, F.monotonically_increasing_id()))


def bucket_of(col: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo n: the folds that the held-out columns use."""
    return F.pmod(F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")), F.lit(n))


def py_bucket_of(value: object, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n


def sample_ids(df: DataFrame, key: str, n: int, seed: int = 17) -> DataFrame:
    """The n rows of df that come first by a seeded hash of the key: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def frame(column) -> list:
    """An Arrow text column as Python strings, null as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


PORTION = 2 << 20  # bytes of text that a worker holds as Python objects at a time


def portions(batches: Iterator[pa.RecordBatch], at: int, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts (column at) take about `most` bytes, one row at least: Arrow batches count
    rows, so a batch of long texts would take many times its size once it is split into words."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield b.slice(start, end - start)
            start = end
