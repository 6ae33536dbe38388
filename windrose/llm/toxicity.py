"""Toxic passages by maximum-scoring segment search.

Tokens get log-odds of standing in a toxic rather than a clean document, from the documents that hold them. The odds
have Dirichlet priors one inside the other: a word's prior is its six-letter beginning, whose prior is its five-letter one, down to three letters and the
share of all tokens, so inflected and unseen words take their stem's odds. A linear scan over the tokens finds every
maximal scoring segment. Segment scores are calibrated as extreme values: lambda from the scores of tokens in clean
documents, K from the best segments of clean documents, which gives every segment a p-value that allows for the text's
length; a document's score is a logistic function of its best p-value and of what its significant segments sum to.

Bounds of the fit, and of nothing else: the odds are learned from one half of at most SAMPLE labelled documents and the
calibration from the other half. Of the words and beginnings counted there, the model keeps those that are in LEAST
documents, at least one of them toxic, or in CLEAN_LEAST clean ones, and of these the VOCABULARY most frequent; the others
take their shorter beginning's odds.

Defined results: null and empty texts have no tokens and get the score of a text without any segment; without labels
of both classes every score is 0; repeated rows get the same score; very long texts are read whole; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, discard, portions, sample_ids, stage, table

SAMPLE, VOCABULARY, STEMS, PRIOR, SHIFT, CLIP, LEAST, SIGNIFICANT, CACHE = 24_000, 500_000, (3, 4, 5, 6), 4.0, 0.7, 8.0, 3, 0.05, 200_000
CLEAN_LEAST = 20  # documents that a word or beginning seen in clean ones only is in


def clean(token: str) -> str:
    token = token.lower()
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def keys_of(word: str) -> list[str]:
    """From the shortest beginning to the whole word."""
    return [f"{n}:{word[:n]}" for n in STEMS if len(word) > n] + [f"w:{word}"]


def token_score(word: str, model: dict) -> float:
    if not word:
        return -SHIFT
    share = model["share"]
    for k in keys_of(word):
        toxic, other = model["counts"].get(k, (0, 0))
        share = (toxic + PRIOR * share) / (toxic + other + PRIOR)
    odds = math.log(share / (1 - share)) - math.log(model["share"] / (1 - model["share"]))
    return max(-CLIP, min(CLIP, odds)) - SHIFT


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time: only the runs of positive scores are visited,
    with the running sum before and after each."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    upto = np.concatenate([[0.0], scores.cumsum()])
    breaks = np.flatnonzero(np.diff(positive) > 1)
    starts, ends = positive[np.concatenate([[0], breaks + 1])], positive[np.concatenate([breaks, [len(positive) - 1]])] + 1
    stack: list[list] = []  # start, end, sum before, sum after, and the nearest earlier segment with a lower sum before
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        new = [s, e, upto[s], upto[e], -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            new[4] = j
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(s, e, after - before) for s, e, before, after, _ in stack]


class Scorer:
    """Token scores with a memory of the tokens seen."""

    def __init__(self, model: dict):
        self.model, self.known = model, {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        for t in set(tokens).difference(known):
            known[t] = token_score(clean(t), self.model)
        scores = np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))
        again = np.fromiter(map(eq, tokens, tokens[1:]), bool, max(len(tokens) - 1, 0))
        scores[1:][again] = np.minimum(scores[1:][again], -SHIFT)  # a word right after itself is no new evidence
        return scores


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> dict | None:
    """docs: doc_id, text. labels: doc_id, toxic. learn: which doc_ids may be used."""
    spark = docs.sparkSession
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = sample_ids(marked, "doc_id", SAMPLE).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(2)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # SAMPLE rows at most
    # each word once a document: junk that repeats a word says nothing more
    word = F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[^\\p{L}\\s]", ""), "\\s+")))
    words = rows.filter("half = 0").select("toxic", word.alias("w")).filter("w <> ''")
    per_word = words.groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    stems = F.array(*[F.when(F.length("w") > n, F.concat(F.lit(f"{n}:"), F.substring("w", 1, n))) for n in STEMS], F.concat(F.lit("w:"), "w"))
    per_key = per_word.select(F.explode(F.array_compact(stems)).alias("k"), "t", "c").groupBy("k").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    often = per_key.filter((F.col("t") > 0) & (F.col("t") + F.col("c") >= LEAST) | (F.col("c") >= CLEAN_LEAST))
    counts = often.orderBy(F.desc(F.col("t") + F.col("c")), "k").limit(VOCABULARY).toPandas()
    whole = per_word.agg(F.sum("t"), F.sum("c")).first()
    if not whole[0] or not whole[1]:
        return None
    model = {"share": whole[0] / (whole[0] + whole[1]), "counts": dict(zip(counts["k"], zip(counts["t"], counts["c"], strict=True), strict=True)), "lambda": 1.0, "K": 1.0}
    # calibration on the other half: every token's score in a histogram, every document's best segment
    sent = spark.sparkContext.broadcast(model)
    grid = np.linspace(-CLIP - SHIFT, CLIP - SHIFT, 321)

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in portions(it, 0):
            out = []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = scorer(text)
                out.append({"toxic": toxic, "n": len(s), "segments": [x[2] for x in maximal_segments(s)], "histogram": np.bincount(np.searchsorted(grid, s), minlength=len(grid) + 1).tolist() if not toxic else []})
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    measured = rows.filter("half = 1").select("text", "toxic").mapInArrow(measure, "toxic int, n long, segments array<double>, histogram array<long>")
    measured = stage(measured)
    hist = measured.filter("toxic = 0").select(F.posexplode("histogram").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()  # one row a bin
    mass = np.zeros(len(grid) + 1)
    for r in hist:
        mass[r["i"]] = r["n"]
    mids = np.concatenate([[grid[0]], (grid[1:] + grid[:-1]) / 2, [grid[-1]]])
    if mass.sum():
        share = mass / mass.sum()
        low, high = 1e-6, 20.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if (share * np.exp(np.minimum(mid * mids, 700))).sum() < 1 else (low, mid)
        model["lambda"] = low
    docs_ = measured.select("toxic", "n", "segments").toPandas()  # SAMPLE / 2 rows at most
    best = np.array([max(s, default=0.0) for s in docs_["segments"]])
    ok = (docs_["toxic"] == 0) & (docs_["n"] > 0) & (best > 0)
    if ok.any():
        model["K"] = float(np.exp(np.mean(model["lambda"] * best[ok] - np.log(docs_["n"][ok])) - np.euler_gamma))
    x = np.array([features_of(s, n, model) for s, n in zip(docs_["segments"], docs_["n"], strict=True)]).reshape(-1, 3)
    model["weights"] = logistic(design(x), docs_["toxic"].to_numpy(float))
    discard(measured)
    return model


ARROW = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("segments", pa.list_(pa.float64())), ("histogram", pa.list_(pa.int64()))])


def features_of(segments, n: int, model: dict) -> tuple[float, float, int]:
    """-log of the best segment's p-value, the same summed over significant segments, and how many these are."""
    if not len(segments) or not n:
        return 0.0, 0.0, 0
    e = math.log(model["K"] * n) - model["lambda"] * np.asarray(segments)
    p = -np.expm1(-np.exp(np.minimum(e, 30)))
    surprise = -np.log(np.maximum(p, 1e-300))
    sig = p <= SIGNIFICANT
    return float(surprise.max()), float(surprise[sig].sum()), int(sig.sum())


def design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.sqrt(x[:, 0]), np.log1p(x[:, 1]), np.log1p(x[:, 2])])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score, n_passages, passages: the significant segments as (first token, end token, p-value)."""
    schema = "doc_id long, score double, n_passages long, passages array<struct<start: long, end: long, p: double>>"
    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_passages", pa.int64()), ("passages", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer = Scorer(m) if m else None
        for b in portions(it, 1):
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not m:
                    out.append({"doc_id": doc_id, "score": 0.0, "n_passages": 0, "passages": []})
                    continue
                s = scorer(text)
                segments = maximal_segments(s)
                f = features_of([x[2] for x in segments], len(s), m)
                found = []
                for start, end, v in segments:
                    p = -math.expm1(-math.exp(min(math.log(m["K"] * len(s)) - m["lambda"] * v, 30)))
                    if p <= SIGNIFICANT:
                        found.append({"start": start, "end": end, "p": p})
                z = float(design(np.array([f]))[0] @ m["weights"])
                out.append({"doc_id": doc_id, "score": 1 / (1 + math.exp(-max(-30, min(30, z)))), "n_passages": len(found), "passages": found})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, schema)


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), bucket_of("doc_id", 5) != 0)
    held_out = (bucket_of("doc_id", 5) == 0).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
