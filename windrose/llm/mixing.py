"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source's target is its weight's share of the budget, but at most its size times the most epochs allowed; what a
source can't take is dealt again among the others in proportion to their weights. In terms of the level at which a
source is full (cap / weight), the sources sorted by that level fill up one after another, so the final level follows
from running sums over the sorted sources.

A source whose target is r times its size takes each document floor(r) times whole; of the rest, the documents that
come first in a seeded order are taken once more, and the one at the edge in part. The order runs within slices of a
source, each of which fills its own share, so that no source has to be sorted in one task. Sources themselves, a row
each, are sorted by one task. The seeded order is that of the hex digits of MD5, which SQL has too.

Defined results: a null or empty text has size 0 and takes nothing; null sources are one source, the last; sources of
size 0 get target 0; ties in the seeded order go by doc_id, then size; repeated rows are documents of their own; an empty
table gives no rows; other columns are ignored, or kept as they are where documents are returned, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, portions, stage, table, unused

WEIGHTS = (5.0, 2.0, 1.0)
EXPAND, MAX_EPOCHS, SEED = 1.5, 2.0, 11
WORDS = re.compile(WORD)
SLICE_ROWS = 2_000  # documents of a source that one task orders


def sizes(docs: DataFrame, number: list[str]) -> DataFrame:
    return docs.select("doc_id", *number, "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def water_fill(sources: DataFrame, weights: tuple[float, ...], expand: float, max_epochs: float) -> DataFrame:
    """sources (source, source_size) with target. Sources are few beside documents; they are sorted as one window."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(max_epochs)).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn("caps_below", F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(expand))
    # the level if this source and all after it stay below their caps
    level = (F.col("budget") - F.coalesce("caps_below", F.lit(0.0))) / F.col("weight_left")
    s = s.withColumn("place", F.row_number().over(by_level)).withColumn("own_level", level)
    first = F.min(F.when(F.col("own_level") <= F.col("full_at"), F.struct("place", "own_level"))).over(everything)
    s = s.withColumn("level", first["own_level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level")))
    return s.select("source", "source_size", target.alias("target"))


def digits(seed: int):
    """The order's key: MD5 of seed and doc_id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(docs: DataFrame, weights=WEIGHTS, expand: float = EXPAND, max_epochs: float = MAX_EPOCHS, seed: int = SEED, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats (whole ones), part (words of one more, partial one), taken.
    row: a column of numbered() to keep, which decides ties of doc_id and size."""
    number = [row] if row else []
    sized = stage(sizes(docs, number))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    filled = water_fill(per_source.select("source", F.col("source_size").cast("double").alias("source_size")), weights, expand, max_epochs)
    slices = F.greatest(F.lit(1), F.ceil(F.col("rows") / SLICE_ROWS)).alias("slices")
    plan = stage(filled.withColumnRenamed("source", "s").join(per_source.select(F.col("source").alias("s2"), slices), F.col("s").eqNullSafe(F.col("s2"))).drop("s2"))
    x = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = F.conv(F.substring(digits(seed), 1, 8), 16, 10).cast("long")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    x = x.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio")).withColumn("slice", F.pmod(dealt, F.col("slices")))
    one = Window.partitionBy("source", "slice")
    order = one.orderBy(digits(seed + 1), "doc_id", "size", *number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quota = F.round(F.sum("size").over(one) * (F.col("ratio") - F.col("whole")))
    left = quota - (F.sum("size").over(order) - F.col("size"))
    more = F.least(F.col("size"), F.greatest(F.lit(0), left)).cast("long")
    x = x.withColumn("more", F.when(F.col("size") > 0, more).otherwise(F.lit(0)))
    extra = ((F.col("more") == F.col("size")) & (F.col("size") > 0)).cast("long")
    return x.select(
        "doc_id",
        *number,
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("whole") + extra).alias("repeats"),
        F.when(extra == 1, 0).otherwise(F.col("more")).alias("part"),
        (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"),
    )


def first_words(text: str, n: int) -> str:
    """The first n words of a text, with the white space between and before them."""
    end = 0
    for i, m in enumerate(WORDS.finditer(text)):
        if i == n:
            break
        end = m.end()
    return text[:end]


def drawn(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves, with the columns of docs: each one as often as it is repeated whole, and its
    first words where a part of it is taken. A column n_chars is set to the new length of a shortened text."""
    row, part_ = unused("_row", docs), unused("_part", docs)
    rows = numbered(docs, row)
    plan = mix(rows, row=row, **how).filter("taken > 0").select(row, F.col("repeats").alias(unused("_repeats", docs)), F.col("part").alias(part_))
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(it, at):
            part = b.column(len(names)).to_pylist()
            cols = list(b.columns)[: len(names)]
            if any(part):
                texts = [first_words(t, n) if n else t for t, n in zip(cols[at].to_pylist(), part, strict=True)]
                if chars is not None:
                    cols[chars] = pa.array([len(t) if n else c for t, n, c in zip(texts, part, cols[chars].to_pylist(), strict=True)], cols[chars].type)
                cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    repeats, part = F.col(unused("_repeats", docs)), F.col(part_)
    none = F.array().cast("array<bigint>")
    whole = F.when(repeats > 0, F.transform(F.sequence(F.lit(1), repeats), lambda _: F.lit(0).cast("long"))).otherwise(none)
    copies = F.concat(whole, F.when(part > 0, F.array(part)).otherwise(none))
    return rows.join(plan, row).select(*names, F.explode(copies).alias(part_)).mapInArrow(batches, docs.schema)


def op8_water_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, sum(size)::DOUBLE AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM p),
c AS (SELECT *, source_size * {MAX_EPOCHS} AS cap, source_size * {MAX_EPOCHS} / weight AS full_at, sum(source_size) OVER () * {EXPAND} AS budget FROM w),
l AS (SELECT *, row_number() OVER o AS place, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level FROM c WINDOW o AS (ORDER BY full_at, source NULLS LAST)),
f AS (SELECT *, (SELECT arg_min(own_level, place) FROM l WHERE own_level <= full_at) AS level FROM l),
t AS (SELECT source, source_size, n, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target FROM f),
x AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
    md5('{SEED + 1}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS place,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % greatest(1, CAST(ceil(t.n / {SLICE_ROWS}) AS BIGINT)) AS slice
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, round(sum(size) OVER (PARTITION BY source, slice) * (ratio - floor(ratio)))
    - (sum(size) OVER (PARTITION BY source, slice ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size) AS spare FROM x)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(floor(ratio) * size + CASE WHEN size > 0 THEN least(size, greatest(0, spare)) ELSE 0 END AS BIGINT) AS taken FROM q
"""
