"""Benchmark decontamination: documents against every window of the test items.

Method: the items' words, folded and numbered, go into a generalised suffix automaton: a state stands for word
sequences that end at the same places, links lead to the longest shorter suffix elsewhere. A document's words are
streamed through it; the automaton keeps the longest sequence of item words that ends at each word. As soon as that is
as long as a window, the window's words are hit, and the windows kept at the states along the suffix links name the
items. Words that no item has reset the automaton, so stretches of known words shorter than the shortest window are skipped: they can
hold none.

Items are dealt by hash into shards of about SHARD_WORDS words (long items are cut into pieces that overlap by a window
less one word), a task builds a shard's automaton, and one shard at a time is broadcast, so what a worker holds has a
bound however many items there are. With one shard all happens in one pass without a shuffle; with more, the hits of
each shard are merged by row.

Defined results: null text has no words, is never hit, and as an item gives no window; an item without words gives none
either; texts of any length are streamed whole; repeated rows and repeated doc_ids are judged each on their own; items
of one item_id count once; the words of an item without item_id are hit, but it isn't counted or listed; an empty table
of documents gives no rows, one of items leaves all documents clean; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, portions, stage, table, unused

WINDOW = 10
SHARD_WORDS, PIECE = 100_000, 10_000

#: Lower-cases A to Z and blanks what is neither an ASCII letter, a digit nor beyond ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows of their items at its states."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        number = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        for word_ids in number:
            at = 0
            for w in word_ids:
                at = self.extended(at, w)
        self.windows: dict[int, dict[int, set]] = {}  # state: length of the window, its items
        for (item, _), word_ids in zip(items, number, strict=True):
            n = min(window, len(word_ids))
            state = 0
            for i, w in enumerate(word_ids):
                state = self.next[state][w]
                while self.length[self.link[state]] >= n:
                    state = self.link[state]
                if i >= n - 1 >= 0:
                    self.windows.setdefault(state, {}).setdefault(n, set()).add(item)
        self.least = min((n for held in self.windows.values() for n in held), default=0)
        # the nearest state with windows along the suffix links, itself included
        self.holder = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.holder[s] = s if s in self.windows else self.holder[self.link[s]] if s else -1

    def added(self, length: int, steps: dict[int, int], link: int) -> int:
        self.next.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def redirected(self, at: int, word: int, old: int, new: int) -> None:
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = new
            at = self.link[at]

    def split(self, at: int, word: int) -> int:
        """The state of the sequences one word longer than those of at, apart from longer ones that end elsewhere too."""
        old = self.next[at][word]
        if self.length[old] == self.length[at] + 1:
            return old
        new = self.added(self.length[at] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = new
        self.redirected(at, word, old, new)
        return new

    def extended(self, at: int, word: int) -> int:
        """The state after one more word of a sequence that stands at `at`."""
        if word in self.next[at]:
            return self.split(at, word)
        new = self.added(self.length[at] + 1, {}, 0)
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self.split(at, word)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Hit words as (first, end) in order, the items of the windows found, and the longest match."""
        if not self.windows or len(words) < self.least:
            return [], set(), 0
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        unknown = np.concatenate([[-1], np.flatnonzero(ids < 0), [len(words)]])
        following, link, length, holder = self.next, self.link, self.length, self.holder
        hit, found, longest = None, set(), 0
        for k in np.flatnonzero(np.diff(unknown) > self.least):
            state = matched = 0
            start = int(unknown[k]) + 1
            for i, w in enumerate(ids[start : unknown[k + 1]].tolist(), start + 1):
                while w not in following[state]:  # ends at the root, which knows every word of the vocabulary
                    state = link[state]
                    matched = length[state]
                state = following[state][w]
                matched += 1
                if matched < self.least:
                    continue
                longest = max(longest, matched)
                at = holder[state]
                while at >= 0:
                    for n in self.windows[at]:
                        if n <= matched:
                            if hit is None:
                                hit = bytearray(len(words))
                            hit[i - n : i] = b"\1" * n
                            found.add((at, n))
                    at = holder[link[at]]
        if hit is None:
            return [], set(), longest
        edges = np.flatnonzero(np.diff(np.frombuffer(hit, np.int8), prepend=0, append=0)).reshape(-1, 2)
        return [(int(a), int(b)) for a, b in edges], set().union(*(self.windows[at][n] for at, n in found)), longest


def pieces(items: DataFrame, window: int, shard_words: int) -> tuple[DataFrame, int]:
    """shard, item and words of the items' pieces, as a written table, and the number of shards."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(PIECE, 2 * window)
        for b in portions(it, 1):
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text or b"")
                for at in range(0, max(1, len(words) - window + 1), size - window + 1):
                    if words:
                        rows.append((item, words[at : at + size]))
            columns = list(zip(*rows, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.list_(pa.binary()))], names=["item", "words"])

    cut = items.select(F.col("item_id").cast("string"), "text").mapInArrow(batches, "item string, words array<binary>")
    total = stage(cut.dropDuplicates())
    words = total.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    return total.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards))), shards


def automata(items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """shard and model, the pickled automaton of the shard's items; and the number of shards."""
    cut, shards = pieces(items, window, shard_words)

    def build(t: pa.Table) -> pa.Table:
        rows = list(zip(t.column("item").to_pylist(), t.column("words").to_pylist(), strict=True))
        return pa.table({"shard": t.column("shard")[:1], "model": pa.array([pickle.dumps(Automaton(rows, window))], pa.binary())})

    return stage(cut.groupBy("shard").applyInArrow(build, "shard long, model binary")), shards


SPANS = "array<struct<first:int,end:int>>"
FOUND = f"row long, doc_id long, n_words long, spans {SPANS}, items array<string>, longest int"
ARROW = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))]
    + [("items", pa.list_(pa.string())), ("longest", pa.int32())]
)
_held: dict[str, Automaton] = {}


class Shard:
    """One automaton, sent to the workers; a worker unpickles it once and keeps no other."""

    def __init__(self, models: DataFrame, shard: int):
        row = models.filter(F.col("shard") == shard).first()
        self.name = uuid.uuid4().hex
        self.sent = models.sparkSession.sparkContext.broadcast(row["model"] if row else pickle.dumps(Automaton([])))

    def automaton(self) -> Automaton:
        if self.name not in _held:
            _held.clear()
            _held[self.name] = pickle.loads(self.sent.value)
        return _held[self.name]


def scanned(rows: DataFrame, shard: Shard) -> DataFrame:
    """rows: row, doc_id, text. One row each, with what the shard's items hit."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shard.automaton()
        for b in portions(it, 2):
            out = []
            for text in b.column(2).cast(pa.binary()).to_pylist():
                words = words_of(text or b"")
                spans, items, longest = automaton.scan(words)
                out.append((len(words), [{"first": a, "end": e} for a, e in spans], sorted(x for x in items if x is not None), longest))
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns, ARROW.types[2:], strict=True))], schema=ARROW)

    return rows.select("row", "doc_id", "text").mapInArrow(batches, FOUND)


def merged(spans: Column) -> Column:
    """Spans of several shards in order, those that touch as one."""
    none = F.array().cast(SPANS)

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(s["first"] <= last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, add)


def found_in(rows: DataFrame, items: DataFrame, window: int, shard_words: int) -> DataFrame:
    """rows: row, doc_id, text; row may be written already. As FOUND, for the items of all shards."""
    models, n = automata(items, window, shard_words)
    if n == 1:
        return scanned(rows, Shard(models, 0))
    parts = [stage(scanned(rows, Shard(models, k))) for k in range(n)]
    hit = reduce(DataFrame.union, [p.select("row", "spans", "items", "longest").filter("longest > 0") for p in parts])
    hit = hit.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("longest").alias("longest"))
    hit = hit.select("row", merged(F.col("spans")).alias("spans"), F.array_sort("items").alias("items"), "longest")
    out = parts[0].select("row", "doc_id", "n_words").join(hit, "row", "left")
    empty = {"spans": F.array().cast(SPANS), "items": F.array().cast("array<string>"), "longest": F.lit(0)}
    return out.select("row", "doc_id", "n_words", *[F.coalesce(c, x).alias(c) for c, x in empty.items()])


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["first"]))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, spans (of words), items, longest match: one row per document."""
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "row")
    return found_in(rows, items, window, shard_words).select("doc_id", "n_words", hit_words().alias("n_hit"), "spans", "items", "longest")


def without(text: str, spans: list[dict]) -> str:
    """text without the stretches from the first to the last word of each span."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    kept, after = [], 0
    for s in spans:
        kept.append(raw[after : at[s["first"]][0]])
        after = at[s["end"] - 1][1]
    return b"".join([*kept, raw[after:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_coverage: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs without the stretches that windows of the items hit, and without the documents of whose words more than
    most_coverage are hit. All columns stay; only text changes."""
    row = unused("_row", docs)
    rows = numbered(docs, row)
    found = found_in(rows.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), "text"), items, window, shard_words)
    hit = stage(found.filter("size(spans) > 0").select(F.col("row").alias(row), (hit_words() > most_coverage * F.col("n_words")).alias("gone"), "spans"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    clean = rows.join(hit.select(row), row, "left_anti").select(*docs.columns)
    dirty = hit.filter("NOT gone").select(row, F.col("spans").alias(unused("spans", docs)))
    part = rows.join(dirty, row).withColumn("text", cut("text", unused("spans", docs)))
    return clean.union(part.select(*docs.columns))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = found_in(docs, table(spark, sf_dir, "benchmark"), WINDOW, SHARD_WORDS).withColumn("n_hit", hit_words())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


#: Every window as a joined string, met with every stretch of as many words.
OP12_SQL = r"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, m, array_to_string(w[k:k + m - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM (SELECT *, least(len(w), 10) AS m FROM i) WHERE m > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS x FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM v))),
h AS (SELECT doc_id, m, k, item FROM g JOIN v USING (m, x)),
n AS (SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM h, range(0, 10) r(o) WHERE o < m GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
