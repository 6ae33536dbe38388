"""Removal of repeated passages: every byte covered by a string of LENGTH bytes that also starts somewhere else.

Method: column-wise construction of the collection's Burrows-Wheeler order with common prefixes. Each round inserts one
symbol of every text, from the right; the new suffixes are ordered by a stable sort of the inserted symbols over the
order so far, and the common prefix of two neighbours is one more than the least between the places they came from.
Columns, transform and prefixes pass through sequential files; memory holds one column.

So that the work spreads over a cluster and stays linear, the texts of a construction are not whole documents but the
surroundings of anchors. An anchor is a run of GRAM bytes whose hash is least among those of some LENGTH-byte string,
so each such string holds an anchor at a place that its content alone decides. Strings that are equal therefore hold
the same anchor at the same distance, and only suffixes at equal distances can share LENGTH bytes; a round orders the
suffixes it inserts among those of the same anchor. Anchors that occur once are dropped; surroundings that occur
several times as they are count once and are repeated as a whole; the construction runs on the different surroundings
of an anchor. Where an anchor has more than LARGE different ones, its strings are counted by hash instead, with partial
sums before the shuffle, so no group has to fit in a task.

Defined results: null or empty text has no bytes; texts shorter than LENGTH keep all; texts are read whole, and strings
never cross documents; repeated rows are documents of their own and so remove each other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stage, table
from .neardup import BASE, BYTE, INVERSE, mix, powers

LENGTH, GRAM = 200, 32
BUCKET, LARGE = 20_000, 200_000  # different surroundings: of a task, and of an anchor; 200,000 are 75 MB
OUT = 256  # the symbol beyond a document's edge, equal to no byte

_powers: dict[str, np.ndarray] = {"up": powers(BASE, 1 << 12), "down": powers(INVERSE, 1 << 12)}


class Hashes:
    """Hashes of any substrings of a byte array."""

    def __init__(self, raw: np.ndarray):
        if len(raw) >= len(_powers["up"]):
            _powers["up"], _powers["down"] = powers(BASE, 2 * len(raw)), powers(INVERSE, 2 * len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE[raw] * _powers["down"][: len(raw)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _powers["up"][start])


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """The least (or largest) of every width values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, Hashes]:
    """Starts and hashes of the anchors of a text with at least length bytes."""
    h = Hashes(raw)
    grams = mix((h.sums[gram:] - h.sums[:-gram]) * _powers["up"][: len(raw) - gram + 1])
    width = length - gram + 1
    least = sliding(grams, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero(most == grams)
    return at, grams[at], h


def surroundings(at: np.ndarray, n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(at + gram - length, 0), np.minimum(at + length, n)


def occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """uid, pos, a, s of every anchor: its place, hash, and the hash of its surroundings."""
    arrow = pa.schema([("uid", pa.int64()), ("pos", pa.int32()), ("a", pa.int64()), ("s", pa.int64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            uids, cols = b.column(0).to_pylist(), []
            for uid, text in zip(uids, b.column(1), strict=True):
                if not text.is_valid or len(raw := np.frombuffer(text.as_buffer(), np.uint8)) < length:
                    continue
                at, a, h = anchors(raw, length, gram)
                lo, hi = surroundings(at, len(raw), length, gram)
                s = mix(h(lo, hi) + ((at - lo) * 1009 + hi - at).astype(np.uint64))
                cols.append((np.full(len(at), uid), at.astype(np.int32), a.view(np.int64), s.view(np.int64)))
            for i in range(0, len(cols), 500):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*cols[i : i + 500], strict=True)], schema=arrow)

    return docs.mapInArrow(batches, "uid long, pos int, a long, s long")


def cut_out(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """a, s, lead, bytes of the surroundings in wanted (uid, pos, a, s)."""
    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("pos", "a", "s")).alias("w"))  # at most a document's anchors
    arrow = pa.schema([("a", pa.int64()), ("s", pa.int64()), ("lead", pa.int32()), ("bytes", pa.binary())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for text, w in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                for x in w:
                    lo, hi = max(x["pos"] + gram - length, 0), min(x["pos"] + length, len(raw))
                    rows.append((x["a"], x["s"], x["pos"] - lo, raw[lo:hi]))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return docs.join(lists, "uid").select("text", "w").mapInArrow(batches, "a long, s long, lead int, bytes binary").dropDuplicates(["a", "s"])


def construct(groups: np.ndarray, leads: np.ndarray, texts: list[bytes], length: int, gram: int) -> list[tuple[int, int, int]]:
    """(row, first start, last start) of the runs of repeated strings, as distances from the anchor.

    groups: ascending numbers of the rows' anchors."""
    n, before = len(groups), length - gram
    width = before + length
    runs: list[tuple[int, int, int]] = []
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as transform:
        # the collection by column: one record a round, read from the last to the first
        for at in range(0, n, 4096):
            part = np.full((min(4096, n - at), width), OUT, np.uint16)
            for i in range(len(part)):
                t = texts[at + i]
                part[i, before - leads[at + i] : before - leads[at + i] + len(t)] = np.frombuffer(t, np.uint8)
            for j in range(width):
                columns.seek(2 * (j * n + at))
                columns.write(np.ascontiguousarray(part[:, j]).tobytes())
        order = np.arange(n)
        # the column at which neighbours first differ; -1: another anchor
        differ = np.where(np.concatenate([[True], groups[1:] != groups[:-1]]), -1, width).astype(np.int32)
        own = groups.astype(np.int64) * (OUT + 1)
        opened = np.full(n, -1, np.int32)
        first = before - np.asarray(leads)
        last = first + np.fromiter(map(len, texts), np.int64, n) - length
        for j in range(width - 1, -1, -1):
            columns.seek(2 * j * n)
            symbols = np.frombuffer(columns.read(2 * n), np.uint16)[order]
            key = own + symbols  # anchors keep their places, so own needs no reordering
            transform.seek(0)
            transform.write(symbols.tobytes())
            transform.write(differ.tobytes())
            if (key[1:] < key[:-1]).any():
                came = np.argsort(key, kind="stable")
                order, key = order[came], key[came]
                transform.seek(2 * n)
                old = np.frombuffer(transform.read(4 * n), np.int32)
                new = old[came]
                p, q = came[:-1] + 1, came[1:] + 1
                same = key[1:] == key[:-1]
                far = np.flatnonzero(same & (q - p > 1))
                if len(far):
                    bounds = np.column_stack([p[far], q[far]]).ravel()
                    new[far + 1] = np.minimum.reduceat(np.append(old, np.int32(-1)), bounds)[::2]
            else:
                new, same = differ.copy(), key[1:] == key[:-1]
            change = ~same & (key[1:] // (OUT + 1) == key[:-1] // (OUT + 1))
            new[1:][change] = j
            new[1:][key[1:] // (OUT + 1) != key[:-1] // (OUT + 1)] = -1
            new[:1] = -1
            differ = new
            if j <= before:
                match = differ - j >= length
                hit = match.copy()
                hit[:-1] |= match[1:]
                rows = np.zeros(n, bool)
                rows[order[hit]] = True
                rows &= (first <= j) & (j <= last)  # beyond the edges all symbols are alike
                ends = np.flatnonzero(~rows & (opened >= 0))
                runs += zip(ends.tolist(), [j + 1 - before] * len(ends), (opened[ends] - before).tolist(), strict=True)
                opened[ends] = -1
                opened[rows & (opened < 0)] = j
        ends = np.flatnonzero(opened >= 0)
        runs += zip(ends.tolist(), [-before] * len(ends), (opened[ends] - before).tolist(), strict=True)
    return runs


RUNS = pa.schema([("a", pa.int64()), ("s", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
RUNS_SQL = "a long, s long, lo int, hi int"


def constructed(snippets: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """a, s, lo, hi: bytes of the surroundings that repeated strings cover, as distances from the anchor."""

    def bucket(t: pa.Table) -> pa.Table:
        t = t.sort_by("a")
        a = t.column("a").to_numpy()
        groups = np.concatenate([[0], (a[1:] != a[:-1]).cumsum()])
        found = construct(groups, t.column("lead").to_numpy(), t.column("bytes").to_pylist(), length, gram)
        row = np.array([x[0] for x in found], np.int64)
        lo, hi = np.array([x[1] for x in found], np.int32), np.array([x[2] + length for x in found], np.int32)
        return pa.table([a[row], t.column("s").to_numpy()[row], lo, hi], schema=RUNS)

    return snippets.withColumn("b", F.pmod(F.xxhash64("a"), F.lit(buckets))).groupBy("b").applyInArrow(bucket, RUNS_SQL)


def counted(snippets: DataFrame, length: int, gram: int) -> DataFrame:
    """As constructed(), by counting the strings of each anchor and distance: for anchors of very many surroundings."""
    arrow = pa.schema([("a", pa.int64()), ("s", pa.int64()), ("d", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def strings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols = []
            for a, s, lead, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = np.frombuffer(raw, np.uint8)
                start = np.arange(len(raw) - length + 1)
                h, g = Hashes(raw), Hashes(raw[::-1])
                n = len(start)
                back = g(len(raw) - start - length, len(raw) - start)
                cols.append((np.full(n, a), np.full(n, s), (start - lead).astype(np.int32), h(start, start + length).view(np.int64), back.view(np.int64)))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*cols, strict=True)], schema=arrow)

    each = snippets.select("a", "s", "lead", "bytes").mapInArrow(strings, "a long, s long, d int, h1 long, h2 long")
    key = ["a", "d", "h1", "h2"]
    often = each.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    starts = each.join(often, key).groupBy("a", "s").agg(F.array_sort(F.collect_set("d")).alias("d"))  # at most length - gram + 1
    # a run ends where the next start isn't one further on
    last = F.filter("d", lambda x: ~F.array_contains("d", x + 1))
    first = F.filter("d", lambda x: ~F.array_contains("d", x - 1))
    runs = starts.select("a", "s", F.explode(F.arrays_zip(first.alias("lo"), last.alias("hi"))).alias("r"))
    return runs.select("a", "s", F.col("r.lo").alias("lo"), (F.col("r.hi") + length).alias("hi"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs: uid, text. uid and spans: for each document with any, the (start, end) bytes that repeated strings cover."""
    every = stage(occurrences(docs, length, gram))
    often = stage(every.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"))  # written, so that the join deals both sides and can split a hot anchor
    occ = stage(every.join(often, "a", "left_semi"))
    discard(every, often)
    per = stage(occ.groupBy("a", "s").agg(F.count("*").alias("c"), F.min(F.struct("uid", "pos")).alias("at")))
    kinds = stage(per.groupBy("a").agg(F.count("*").alias("k")).filter("k > 1"))
    mixed = per.join(kinds, "a").select("a", "s", "k", "at.uid", "at.pos")
    snippets = stage(cut_out(docs, mixed.select("uid", "pos", "a", "s"), length, gram).join(kinds, "a"))
    usual, large = snippets.filter(F.col("k") <= LARGE), snippets.filter(F.col("k") > LARGE)
    n, n_large = snippets.select(F.count_if(F.col("k") <= LARGE), F.count_if(F.col("k") > LARGE)).first()
    runs = constructed(usual, max(1, -(-n // BUCKET)), length, gram)
    if n_large:
        runs = runs.union(counted(large, length, gram))
    whole = per.filter("c > 1").select("a", "s", F.lit(gram - length).alias("lo"), F.lit(length).alias("hi"))
    partly = runs.join(per.filter("c = 1").select("a", "s"), ["a", "s"], "left_semi")
    covers = stage(whole.union(partly))
    spans = occ.join(covers, ["a", "s"]).groupBy("uid").agg(F.collect_set(F.struct((F.col("pos") + F.col("lo")).alias("start"), (F.col("pos") + F.col("hi")).alias("end"))).alias("spans"))
    spans = stage(spans)
    discard(occ, per, kinds, snippets, covers)
    return spans


def with_uid(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("uid"))


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans."""
    arrow = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if not spans:
                    rows.append((raw, len(raw), 0, 0))
                    continue
                edge = np.zeros(len(raw) + 1, np.int32)
                s = np.array([(max(x["start"], 0), min(x["end"], len(raw))) for x in spans])
                np.add.at(edge, s[:, 0], 1)
                np.add.at(edge, s[:, 1], -1)
                gone = edge[:-1].cumsum() > 0
                n_spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
                rows.append((np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), int(gone.sum()), n_spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, arrow.types[1:], strict=True))], schema=arrow)

    joined = docs.join(spans, "uid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(batches, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    docs = with_uid(docs)
    return removed(docs, repeated_spans(docs.select("uid", "text"), length, gram))


def op10_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


