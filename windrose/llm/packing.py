"""Packing documents into sequences as a cutting-stock problem, solved by column generation.

A document's tokens are cut into full sequences and a rest. Rests are counted by length, in classes of GRAIN tokens, so
the problem has at most CAPACITY / GRAIN lengths whatever the input. A pattern says how many rests of each class share
a sequence. The linear program over patterns starts with one pattern a class; a knapsack by dynamic programming prices
new ones until none lowers the total by more than GAP. Pattern counts are rounded down, what is left fills sequences
one by one by bounded knapsacks, and the rests, ranked within their class, take the places of the patterns in order.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; an empty table gives no
rows; other columns are ignored. Control words of the vocabulary inside a text get their own ids, as the tokenizer file
gives them; lone halves of surrogate pairs can't occur in a Spark string.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frame, portions, stage, table

CAPACITY, END, GRAIN, GAP, SMOOTH, MAX_ROUNDS = 2048, 1, 8, 5e-4, 0.7, 3000
SLICE_ROWS = 2_000
VOCABULARY = "byte_bpe_50k"


class Encoder:
    """Ids as the tokenizer file gives them, control words of the vocabulary included. The rank file holds the same
    vocabulary and is read several times faster; a text that its library's regular expression gives up on (very long runs
    of one kind of characters) goes through the tokenizer file itself. The ids are the same either way."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers as public
        import tiktoken

        with open(public.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.path, self.slow = public.path(f"{vocabulary}.json"), None
        with open(self.path, encoding="utf-8") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode(text, allowed_special="all"), dtype="<u4")
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # the library's panic when the pattern gives up
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece: full sequences, then the rest."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    arrow = pa.schema([(x.split()[0], pa.int64()) for x in schema.split(", ")])

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder()
        for batch in portions(it, 1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), frame(batch.column(1)), strict=True):
                ids = np.append(encode(text), np.uint32(END)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, schema)


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern that fits: its value, and how often it takes each size."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = np.searchsorted(sizes, c, "right")
        best[c], took[c] = best[c - 1], -2
        if fits:
            gain = values[:fits] + best[c - sizes[:fits]]
            i = int(gain.argmax())
            if gain[i] > best[c]:
                best[c], took[c] = gain[i], i
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[room]), counts


def plan(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: times}) with the number of sequences that use each; together they hold all of the demand."""
    sizes = np.array(sorted(demand), np.int64)
    need = np.array([demand[s] for s in sizes.tolist()], float)
    if not len(sizes):
        return []
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)  # columns are patterns
    asked = need * (1 + 1e-5 * np.random.default_rng(0).random(m))  # no two ratios tie, so no pivot is wasted
    inverse, x = np.diag(1.0 / np.diag(basis)), asked / np.diag(basis)
    # prices are taken between the program's and the best seen so far, which keeps them from swinging; a price vector
    # divided by its best pattern's value bounds the total from below
    cost, centre, bound = np.ones(m), None, 0.0
    for i in range(MAX_ROUNDS):
        dual = cost @ inverse
        if dual.min() < -1e-9:  # more places than demand cost nothing
            counts, entering = -np.eye(m)[int(dual.argmin())], 0.0
        else:
            price = dual if centre is None else SMOOTH * centre + (1 - SMOOTH) * dual
            value, counts = knapsack(np.maximum(price, 0), sizes, room)
            if asked @ price > bound * value:
                bound, centre = float(asked @ price) / value, price / value
            if bound >= cost @ x * (1 - GAP):
                break
            if dual @ counts <= 1 + 1e-9:  # no gain at the program's own prices
                value, counts = knapsack(np.maximum(dual, 0), sizes, room)
                if value <= 1 + 1e-9:
                    break
            entering = 1.0
        w = inverse @ counts
        ratio = np.where(w > 1e-7, x / np.where(w > 1e-7, w, 1), np.inf)
        out = int(np.where(ratio <= ratio.min() + 1e-9, w, -1).argmax())
        step = ratio[out]
        x = x - step * w
        x[out] = step
        inverse[out] /= w[out]
        rest = w.copy()
        rest[out] = 0
        inverse -= np.outer(rest, inverse[out])
        basis[:, out], cost[out] = counts, entering
        if i % 100 == 99:  # rounding errors of the updates
            inverse = np.linalg.inv(basis)
            x = inverse @ asked
        np.maximum(x, 0, out=x)
    basis, x = basis[:, cost > 0], x[cost > 0]
    whole = np.floor(x + 1e-9).astype(np.int64)
    out = [({int(s): int(a) for s, a in zip(sizes, basis[:, p], strict=True) if a}, int(whole[p])) for p in range(len(x)) if whole[p]]
    left = (need - basis @ whole).astype(np.int64)  # below 0: places that stay free
    rest = {s: n for s, n in zip(sizes.tolist(), left.tolist(), strict=True) if n > 0}
    while rest:
        out.append((fullest(rest, room), 1))
        for s, n in out[-1][0].items():
            rest[s] -= n
            if not rest[s]:
                del rest[s]
    return out


def fullest(rest: dict[int, int], room: int) -> dict[int, int]:
    """The largest size left, and of the others what fills the room best, large ones first: a bounded knapsack."""
    first = max(rest)
    room -= first
    counts = {s: n - (s == first) for s, n in rest.items()}
    by: list[int] = [0] + [-1] * room  # the size that completed each sum
    for s in sorted(counts, reverse=True):
        used = [0] * (room + 1)
        for c in range(s, room + 1):
            if by[c] < 0 <= by[c - s] and used[c - s] < counts[s]:
                by[c], used[c] = s, used[c - s] + 1
        if by[room] >= 0:
            break
    at = max(c for c in range(room + 1) if by[c] >= 0)
    out = {first: 1}
    while at:
        out[by[at]] = out.get(by[at], 0) + 1
        at -= by[at]
    return out


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By class: rows (first rank, places a sequence, first sequence, places of larger classes before) by first rank."""
    rows: dict[int, list] = {}
    filled: dict[int, int] = {}
    seq = 0
    for pattern, n in patterns:
        before = 0
        for size in sorted(pattern, reverse=True):
            rows.setdefault(size, []).append((filled.get(size, 0), pattern[size], seq, before))
            filled[size] = filled.get(size, 0) + pattern[size] * n
            before += pattern[size]
        seq += n
    return {size: np.array(r, np.int64) for size, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Adds sequence_id and offset to the pieces."""
    spark = pieces.sparkSession
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / grain).cast("int"))
    total = pieces.count()
    slices = max(1, -(-total // SLICE_ROWS))
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start"), F.lit(slices)).cast("int"))
    by_slice = pieces.groupBy("size", "slice").agg(F.count("*").alias("n"))
    demand = {r["size"]: r["n"] for r in by_slice.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity / grain rows
    table_ = places(plan(demand, capacity // grain))
    before = Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = by_slice.select("size", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("size", "slice").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(first, ["size", "slice"]).withColumn("rank", F.col("first") + F.col("own"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def seat(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("size", "rank"))
            seq, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                t = table_[int(s)]
                row = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                inside = rank[at] - row[:, 0]
                seq[at], slot[at] = row[:, 2] + inside // row[:, 1], row[:, 3] + inside % row[:, 1]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in columns] + [pa.array(seq), pa.array(slot)], names=[*columns, "sequence_id", "slot"])

    seated = ranked.select(*columns, "size", "rank").mapInArrow(seat, ", ".join(f"{c} long" for c in [*columns, "sequence_id", "slot"]))
    w = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return seated.select(*columns, "sequence_id", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(stage(cut(docs)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


