"""Spelling variant grouping: words one edit apart, and the common word that a rare one is a variant of.

Method: the words and their counts are range-sorted and cut into shards of at most SHARD words; a task builds each
shard's compact trie (flat arrays of labels and first children; a node below which one word is left holds its tail).
A few shards at a time are broadcast, and every word's distance-one Levenshtein automaton is intersected with each of
them depth-first: along the word's own path, each node is left by one insertion, deletion or replacement, and what
remains has to follow exactly. Accepted neighbours are emitted as rows, then counted and reduced to the best form by one
aggregation. Roots come by pointer doubling over the forms: a form has FACTOR times the count of its word, so chains
have a length of at most a logarithm of the largest count.

An edit is emitted once although it can be made at several places: a letter is inserted before a different one or at the
end, and deleted where it differs from the one after it: at the first letter in which both words differ.

Defined results: null or empty text has no words; texts are read whole, long ones in portions of their matches; repeated
rows count again; a row without doc_id is like one whose doc_id is an empty text; of several near words with the
largest count the first in code-point order is the form; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, portions, stage, table

SHARD, TOGETHER = 100_000, 4  # words of a shard; shards sent at a time
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
HELD = 200_000  # words that a task counts before it passes them on
EVERY = 199  # one in so many runs of a document gets a letter less

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def spelled(doc_id: int | None, raw: bytes, least: int) -> Iterator[str]:
    """The words of one text that have at least `least` letters, with the letters taken out that the contract takes out."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for m in re.finditer(f"[a-zÀ-ÿ]{{{least},}}", raw.translate(LOWER).decode()):
        run = m.group()
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run


def counted(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words with enough letters and occurrences."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in portions(it, 1):
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = spelled(doc_id, raw or b"", least_length)
                while some := list(islice(words, HELD)):
                    seen.update(some)
                    if len(seen) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
                        seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    each = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(batches, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Trie:
    """Words in flat arrays: the children of a node stand together, in the order of their labels."""

    def __init__(self, words: list[str], counts: Sequence[int]):
        """words: distinct, sorted by code point."""
        self.words, self.counts = words, counts
        labels, first, word = [chr(0)], array("q"), array("q")  # word: of a node below which one word is left, else that which ends here, or -1
        single = bytearray()
        level = [(0, len(words), 0)]
        total = 1
        while level:
            below = []
            for lo, hi, depth in level:
                first.append(total)
                single.append(hi - lo == 1)
                ends = hi > lo and len(words[lo]) == depth
                word.append(lo if ends or hi - lo == 1 else -1)
                if hi - lo == 1:
                    continue
                at = lo + ends
                while at < hi:
                    c = words[at][depth]
                    to = at + 1
                    while to < hi and words[to][depth] == c:
                        to += 1
                    below.append((at, to, depth + 1))
                    labels.append(c)
                    total += 1
                    at = to
            level = below
        first.append(total)
        self.labels, self.first, self.word, self.single = "".join(labels), first, word, bytes(single)

    def followed(self, node: int, depth: int, rest: str) -> int:
        """The word that is reached from node (whose own letters are `depth`) by the letters of rest, or -1."""
        find, first, single = self.labels.find, self.first, self.single
        for i, c in enumerate(rest):
            if single[node]:
                w = self.word[node]
                return w if self.words[w][depth + i :] == rest[i:] else -1
            node = find(c, first[node], first[node + 1])
            if node < 0:
                return -1
        w = self.word[node]
        return w if w >= 0 and len(self.words[w]) == depth + len(rest) else -1

    def near(self, word: str) -> list[int]:
        """The numbers of the words at distance one from word, each once."""
        labels, find, first, single, followed = self.labels, self.labels.find, self.first, self.single, self.followed
        size, node, out = len(word), 0, []
        for i in range(size + 1):
            if single[node]:  # one word left: its tail meets the rest of this word's automaton
                w = self.word[node]
                if one_apart(self.words[w], word):
                    out.append(w)
                break
            here, after, kept, rest = word[i : i + 1], word[i + 1 : i + 2], word[i:], word[i + 1 :]
            if here and here != after:
                out.append(followed(node, i, rest))  # a letter deleted
            lo, hi, ahead = first[node], first[node + 1], -1
            for child, c in enumerate(labels[lo:hi], lo):
                if c == here:
                    ahead = child
                elif single[child]:
                    w = self.word[child]
                    tail = self.words[w][i + 1 :]
                    if tail == kept or here and tail == rest:
                        out.append(w)
                elif not here:
                    out.append(followed(child, i + 1, ""))  # a letter added at the end
                else:
                    a, b = first[child], first[child + 1]
                    k = find(here, a, b)  # a letter inserted
                    if k >= 0:
                        out.append(followed(k, i + 2, rest))
                    if not after:
                        out.append(followed(child, i + 1, ""))  # the last letter replaced
                    else:
                        k = find(after, a, b)  # a letter replaced
                        if k >= 0:
                            out.append(followed(k, i + 2, word[i + 2 :]))
            if ahead < 0:
                break
            node = ahead
        return [w for w in out if w >= 0]


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes a of b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i + 1 :] == b[i + 1 :]


def tries(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """shard and model, the pickled trie of at most `shard` of the words: neighbouring ranges of the words together, however
    many ranges there are, so that most shards end a word's search at its first letters."""
    dealt = stage(words.repartitionByRange("word").withColumn("_p", F.spark_partition_id()))  # written, so that counts and rows see the same ranges
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_p"))  # a row a range
    sizes = sizes.select("_p", F.floor((upto - 1) / shard).alias("shard"))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("word")
        words, counts = t.column("word").to_pylist(), t.column("n").to_pylist()
        models = [pickle.dumps(Trie(words[at : at + shard], array("q", counts[at : at + shard]))) for at in range(0, len(words), shard)]
        number = t.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([number] * len(models), pa.int64()), "model": pa.array(models, pa.binary())})

    out = stage(dealt.join(F.broadcast(sizes), "_p").select("shard", "word", "n").groupBy("shard").applyInArrow(build, "shard long, model binary"))  # broadcast: a row a range
    discard(dealt)
    return out


_held: dict[str, list[Trie]] = {}


def loaded(name: str, sent) -> list[Trie]:
    """The tries of a broadcast, unpickled once in a worker, which keeps no others."""
    if name not in _held:
        _held.clear()
        _held[name] = [pickle.loads(m) for m in sent.value]
    return _held[name]


def neighbours(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n, near, near_n: one row per word and neighbour in words (word, n; distinct), and one without a neighbour
    per word. words is read several times."""
    spark, size = words.sparkSession, words.count()
    models = tries(words, shard)
    numbers = sorted(r["shard"] for r in models.select("shard").distinct().collect())  # a number per shard
    dealt = words.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(size / 20_000)), "word")
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    parts = [words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))]
    for at in range(0, len(numbers), TOGETHER):
        some = models.filter(F.col("shard").isin(numbers[at : at + TOGETHER])).select("model").collect()
        sent = spark.sparkContext.broadcast([bytes(r["model"]) for r in some])

        name = uuid.uuid4().hex

        def batches(it: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            held = loaded(name, sent)
            for b in it:
                rows = []
                for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    rows += [(word, n, t.words[i], t.counts[i]) for t in held for i in t.near(word)]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["word", "n", "near", "near_n"])

        # written, so that no more shards than these are sent at a time
        parts.append(stage(dealt.select("word", "n").mapInArrow(batches, "word string, n long, near string, near_n long")))
        sent.destroy()
    discard(models)
    return reduce(DataFrame.union, parts)


def forms(words: DataFrame, shard: int = SHARD, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n."""
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    per = neighbours(words, shard).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    often = -F.col("best.less") >= factor * F.col("n")
    return per.select("word", "n", "n_near", F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame, factor: int = FACTOR) -> DataFrame:
    """found (a written table with word, n and form) with the word at which following the forms ends."""
    link = stage(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    most = found.agg(F.max("form_n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, factor)))  # no chain is longer: counts grow by the factor at each step
    for _ in range(math.ceil(math.log2(steps))):
        on = link.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, link = link, stage(link.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        discard(before)
    return found.join(link, "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of docs."""
    words = stage(counted(docs))
    found = stage(forms(words, shard))
    discard(words)
    return roots(found)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: Near words by the places left open in both, instead of tries; the checksum by its table of 256 remainders.
OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM d WHERE length(run) >= 6 GROUP BY 1, 2),
b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)) AS bytes FROM g),
h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(bytes, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), CAST(4294967295 AS BIGINT)) AS h FROM b, t),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
x AS (SELECT word, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
s AS (SELECT DISTINCT x.word AS longer, w.word AS shorter FROM x JOIN w ON w.word = x.a || x.b),
p AS (SELECT x.word, y.word AS near FROM x JOIN x y ON x.a = y.a AND x.b = y.b AND x.word <> y.word UNION ALL SELECT longer, shorter FROM s UNION ALL SELECT shorter, longer FROM s),
q AS (SELECT p.word, count(*) AS n_near, arg_min(near, (-w.n, near)) AS near, max(w.n) AS near_n FROM p JOIN w ON w.word = p.near GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN q USING (word)),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
e AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""
