"""Nearest neighbours by randomly rotated one-bit codes.

Each vector is centred, normalised and rotated by a seeded random orthogonal matrix; the signs of the result are packed
into 64-bit words, once, and stored beside the vector with three scalars (its centred norm, the inner product of its
direction with its code, and its inner product with the centre). A query is rotated too and cut into PLANES bits a
component, so that its inner product with a code is a weighted sum of the bits that the code shares with each plane,
counted on the packed words. The estimate of two vectors' inner product has a known error bound, to which the rounding
of the query adds its own; only vectors whose upper bound reaches the k-th best exact score are scored exactly.

Queries and candidates are dealt into blocks; a task holds one block of queries against one block of candidates, keeps
its k nearest of each query, and a window over those few rows keeps the k nearest of all. The vectors travel with their
codes: at 64 components a bound keeps some per cent of a block for a query, so among thousands of queries nearly every
vector of a block is scored exactly for one of them, and fetching them afterwards would move more. The centre is the
mean of about CENTRE vectors, a documented bound of the fit; every vector is indexed.

Defined results: vectors that are null, all zero, or hold null or non-finite components take no part, and vectors of
different lengths are never compared; repeated ids and equal vectors are rows of their own, except that a row is never
its own neighbour (rows with the query's id are left out; of repeated query ids the least vector asks); ties go to the
smaller id; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

EPSILON = 3.0  # the error bound holds but for about 1 in 400 pairs near the k-th place
CANDIDATES, QUERIES = 8192, 16384  # rows of a block
PLANES, CENTRE = 8, 10_000


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of packed bits as rows of 64-bit words."""
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, the norm of the centred vector, and the inner product of direction and code."""
    d = x - centre
    norm = np.sqrt((d * d).sum(1))
    unit = (d / np.where(norm > 0, norm, 1)[:, None]) @ turn
    return np.packbits(unit > 0, axis=1), norm, np.maximum(np.abs(unit).sum(1) / np.sqrt(x.shape[1]), 1e-9)


def code_products(codes: np.ndarray, ones: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, float]:
    """Inner products of a rotated query with the codes' signs, and how far they may be off at most. ones: bits set in
    each code."""
    low = u.min()
    step = max((u.max() - low) / (2**PLANES - 1), 1e-300)
    level = np.rint((u - low) / step).astype(np.int64)
    shared = np.zeros(len(codes))
    for j, plane in enumerate(words(np.packbits((level >> np.arange(PLANES)[:, None]) & 1, axis=1))):
        counts = np.bitwise_count(codes & plane)
        shared += float(2**j) * (counts[:, 0] if counts.shape[1] == 1 else counts.sum(1))
    return 2 * (low * ones + step * shared) - u.sum(), len(u) * step / 2


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added from the first component to the last, as a plain loop does."""
    return np.add.accumulate(x * q, axis=1)[:, -1]


def search_block(queries: pd.DataFrame, cands: pd.DataFrame, k: int, centre: np.ndarray, turn: np.ndarray) -> pd.DataFrame:
    x = np.stack(cands["v"].to_numpy()).astype(np.float64)
    qs = np.stack(queries["v"].to_numpy()).astype(np.float64)
    ids, dim = cands["id"].to_numpy(), x.shape[1]
    codes = np.frombuffer(b"".join(cands["bits"]), np.uint64).reshape(len(x), -1)
    norm, along, base = (cands[c].to_numpy() for c in ("norm", "along", "base"))
    ones = np.bitwise_count(codes).sum(1).astype(np.float64)
    scale = norm / along / np.sqrt(dim)
    spread = norm * EPSILON * np.sqrt(np.maximum(1 - along**2, 0)) / along / np.sqrt(max(dim - 1, 1))
    out = []
    for qid, q in zip(queries["id"].to_numpy(), qs, strict=True):
        d = q - centre
        signs, off = code_products(codes, ones, d @ turn)
        # <x, q> = <x - c, q - c> + <x, c> + <q - c, c>
        guess = base + d @ centre + scale * signs
        upper = guess + spread * np.sqrt(d @ d) + scale * off + 1e-9 * (1 + np.abs(guess))
        allowed = ids != qid
        guess = np.where(allowed, guess, -np.inf)
        first = np.argpartition(-guess, k)[:k] if len(guess) > k else np.arange(len(guess))
        first = first[allowed[first]]
        if not len(first):
            continue
        sure = (x[first] @ q).min() if len(first) >= k else -np.inf
        pick = np.flatnonzero(allowed & (upper >= sure))
        near = x[pick] @ q
        if len(pick) > k:
            keep = near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9 * (1 + np.abs(near).max())
            pick = pick[keep]
        score = exact(x[pick], q)
        order = np.lexsort((ids[pick], -score))[:k]
        out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[pick][order], "score": score[order]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0)
    )


def centres(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By length of the vectors the mean of a seeded sample of them: as many numbers as all lengths together."""
    chance = F.pmod(F.xxhash64("id", F.lit(31)), F.lit(1_000_000)) / 1_000_000
    means = rows.filter(chance * n < CENTRE).select(F.size("v").alias("dim"), F.posexplode("v").alias("i", "x")).groupBy("dim", "i").agg(F.avg("x").alias("m"))
    out = {r["dim"]: np.zeros(r["dim"]) for r in rows.select(F.size("v").alias("dim")).distinct().collect()}
    for r in means.collect():
        out[r["dim"]][r["i"]] = r["m"]
    return out


def encoded(rows: DataFrame, sent) -> DataFrame:
    """id, v, dim and every vector's code. sent: broadcast of (centre, rotation) by length."""
    arrow = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("dim", pa.int32()), ("bits", pa.binary()), ("norm", pa.float64()), ("along", pa.float64()), ("base", pa.float64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            size = b.column(1).value_lengths().to_numpy()
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                part = b.take(pa.array(at))
                x = part.column(1).flatten().to_numpy().reshape(len(at), dim)
                centre, turn = sent.value[int(dim)]
                bits, norm, along = encode(x, centre, turn)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(at), dim, np.int32)), pa.array([r.tobytes() for r in words(bits)], pa.binary()), pa.array(norm), pa.array(along), pa.array(x @ centre)], schema=arrow)

    return rows.select("id", "v").mapInArrow(batches, "id long, v array<double>, dim int, bits binary, norm double, along double, base double")


def nearest(vectors: DataFrame, query_filter, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row that query_filter (a function of the id column) takes, its k nearest
    other rows by inner product."""
    fine = usable(vectors, id_col, vec_col)
    n, n_q = fine.select(F.count("*"), F.count_if(query_filter(F.col("id")))).first()
    sent = fine.sparkSession.sparkContext.broadcast({dim: (c, rotation(dim)) for dim, c in centres(fine, n).items()})  # a square matrix a length
    rows = stage(encoded(fine, sent))
    slots, q_slots = max(1, -(-n // CANDIDATES)), max(1, -(-n_q // QUERIES))
    slot = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    cands = rows.withColumn("c", slot(slots, 1)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_slots - 1))))
    asked = rows.filter(query_filter(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    queries = asked.withColumn("q", slot(q_slots, 2)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def block(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return search_block(qs, cs, k, *sent.value[int(cs["dim"].iloc[0])])

    found = queries.groupBy("dim", "q", "c").cogroup(cands.groupBy("dim", "q", "c")).applyInPandas(block, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_onebit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0)


OP2_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""
