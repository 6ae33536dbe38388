"""Filter interaction audit: what each of several filters removes at each place of every order of the filters.

Method: the texts are range-sorted by (fingerprint, doc_id) and within a range by (fingerprint, text, doc_id), so equal
texts stand together and a group of copies of any size is spread over as many ranges as it fills. Each task reads its
range once: it compares every row with its predecessor, which tells a repeated text, and sets the bits of the other
filters. Two things reach over the edge of a range: the runs of its first and of its last fingerprint are written
with their text and smallest doc_id, their minima over all ranges are joined back, and only the rows that are
the smallest of a first run wait for them. Rows are then counted by part and mask (partial counts before the shuffle);
a mask has one effect on each (order, step), so all orders follow from at most 2^k counters a part by a table of fixed size.

Only (fingerprint, doc_id) is a range key: the bounds are sampled on the driver, and texts there would have no bound.

Defined results: null text is empty, and empty texts are copies of each other; null part is the empty string, the same
part as one that is empty; a row without doc_id is a copy of nothing and no label belongs to it; rows of one doc_id and
text are no copies of each other, as neither id is smaller; a doc_id with several labels has each mark that one of them
sets; texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations
from string import ascii_uppercase

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

UPPER = bytes(range(0x41, 0x5B))
LATER = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point


@dataclass(frozen=True)
class Limits:
    """Failing: A under least_words words; B distinct words below distinct_pct percent; C upper-case letters above
    upper_pct percent of the code points; D any of symbols; E equal to the text of a smaller doc_id."""

    least_words: int = 200
    distinct_pct: int = 50
    upper_pct: int = 2
    symbols: bytes = b"#$%&*|"

    def mask(self, raw: bytes) -> int:
        """A to D as bits 0 to 3."""
        words = raw.split()
        n = len(words)
        few = n < self.least_words
        alike = 100 * len(set(words)) < self.distinct_pct * n
        loud = 100 * (len(raw) - len(raw.translate(None, UPPER))) > self.upper_pct * len(raw.translate(None, LATER))
        marked = len(raw.translate(None, self.symbols)) < len(raw)
        return few | alike << 1 | loud << 2 | marked << 3


COPY = 16
ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("run", pa.int64()), ("print", pa.int64()), ("text", pa.binary())])
ROWS = "doc_id long, part string, mask int, run long, print long, text binary"


class Predecessors:
    """Compares the rows of one sorted range; a run is a sequence of equal texts."""

    def __init__(self, task: int, limits: Limits):
        self.limits, self.run = limits, task << 40
        self.first: int | None = None  # the fingerprint that the range begins with
        self.at: tuple[int, bytes] | None = None
        self.mask, self.least = 0, None
        self.open: list[tuple] = []  # the runs of the fingerprint that goes on: one, but for collisions

    def ends(self) -> list[tuple]:
        """The runs of the fingerprint that ends, as rows without a mask."""
        found = [(least, None, None, run, *at) for run, least, at in self.open]
        self.open = []
        return found

    def rows(self, doc_id: int | None, part: str, text: bytes, fingerprint: int) -> Iterator[tuple]:
        if self.first is None:
            self.first = fingerprint
        if self.at != (fingerprint, text):
            if self.at and self.at[0] != fingerprint:
                ends = self.ends()
                if self.at[0] == self.first:
                    yield from ends
            self.at, self.mask, self.least = (fingerprint, text), self.limits.mask(text), None
            self.run += 1
            self.open.append((self.run, None, self.at))
        if self.least is None and doc_id is not None:
            self.least = doc_id
            self.open[-1] = (self.run, doc_id, self.at)
        copy = doc_id is not None and doc_id > self.least
        waits = not copy and doc_id is not None and fingerprint == self.first
        yield doc_id, part, self.mask | COPY * copy, self.run if waits else None, None, None


def failures(docs: DataFrame, limits: Limits = Limits(), part: str = "source") -> DataFrame:
    """doc_id, part and mask (bits 0 to 4: the filters A to E that the row fails), as a written table."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    keyed = slim.withColumn("print", F.xxhash64("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out = Predecessors(TaskContext.get().partitionId(), limits), []
        for b in it:
            for doc_id, place, text, fingerprint in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.extend(reader.rows(doc_id, place, text, fingerprint))
            yield packed(out)
            out = []
        yield packed(reader.ends())

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)

    ranges = keyed.repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", "doc_id")
    read = stage(ranges.select("doc_id", "part", "text", "print").mapInArrow(batches, ROWS))
    ends = read.filter("text IS NOT NULL").select("run", "doc_id", "print", "text")
    least = ends.join(ends.groupBy("print", "text").agg(F.min("doc_id").alias("least")), ["print", "text"]).select("run", "least")
    documents = read.filter("text IS NULL")
    waiting = documents.filter("run IS NOT NULL").join(least, "run")
    waiting = waiting.select("doc_id", "part", F.when(F.col("least") < F.col("doc_id"), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask")).alias("mask"))
    return documents.filter("run IS NULL").select("doc_id", "part", "mask").union(waiting)


def counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic of rows (doc_id, part, mask): counts that add up over any split of the rows."""
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    marked = marked.filter("doc_id IS NOT NULL AND (good = 1 OR toxic = 1)")
    lost = rows.join(marked, "doc_id").select("part", "mask", F.lit(0).cast("long").alias("n"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    every = rows.select("part", "mask", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    # each side is counted by itself first, so the union holds a row per part, mask and task
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    return every.groupBy("part", "mask").agg(*sums).union(lost.groupBy("part", "mask").agg(*sums)).groupBy("part", "mask").agg(*sums)


def effects(filters: int) -> list[tuple]:
    """(mask, filter_order, step, kept, removed, redundant, alone, shapley): what one document with this mask adds."""
    out = []
    letters = ascii_uppercase[:filters]
    orders = list(permutations(range(filters)))
    for order in orders:
        name, before = "".join(letters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            for mask in range(1 << filters):
                fails, gone = bool(mask & bit), bool(mask & before)
                share = len(orders) // mask.bit_count() if fails else 0  # orders in which f is the first that the document fails
                out.append((mask, name, step, int(not mask & (before | bit)), int(fails and not gone), int(fails and gone), int(mask == bit), share))
            before |= bit
    return out


def interactions(counts: DataFrame, filters: int = 5) -> DataFrame:
    """One row per part, order of the filters and step, from counters(); filters: up to 6."""
    schema = "mask int, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, shapley long"
    table = F.broadcast(counts.sparkSession.createDataFrame(effects(filters), schema))  # k! * k * 2^k rows, whatever the input
    n = F.col("n")
    sums = {c: n * F.col(c) for c in ("kept", "removed", "redundant", "unique_fails")} | {"good_lost": F.col("good") * F.col("removed"), "toxic_lost": F.col("toxic") * F.col("removed"), "shapley": n * F.col("shapley")}
    return counts.join(table, "mask").groupBy("part", "filter_order", "step").agg(*[F.sum(x).alias(c) for c, x in sums.items()])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(counters(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


#: Copies by a window over equal texts, and each document pushed through every order.
OP11_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
p AS (SELECT [a, b, c, d, e] AS p FROM range(1, 6) t(a), range(1, 6) u(b), range(1, 6) v(c), range(1, 6) w(d), range(1, 6) x(e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT part, list_reduce(list_transform(p, lambda x: substr('ABCDE', x, 1)), lambda x, y: x || y) AS filter_order, step, p[step] AS which, n, good, toxic, f,
  len(list_filter(p[1:step - 1], lambda x: f[x])) > 0 AS gone FROM c, p, range(1, 6) r(step)),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, which, sum(CASE WHEN gone OR f[which] THEN 0 ELSE n END) AS kept, sum(CASE WHEN f[which] AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN f[which] AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN f[which] AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN f[which] AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN f[which] AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, which) AS BIGINT) AS shapley FROM r
"""
