"""Near-duplicate groups by SetSketch registers.

A document's set holds its distinct 5-word shingles (fewer words: the whole sequence as one). Register i of a sketch is
floor(1 - log_b of the least of exponential hashes over the set), kept within 0 and LIMIT: registers merge by their
maximum and agree with a probability close to the Jaccard similarity. Bands of registers deal documents into buckets; a
pair that shares a bucket is estimated by maximum likelihood from how many registers are larger on either side, and if
the estimate leaves a link possible, the pair is confirmed on the full sets.

Groups stay linear. Equal sets are one node. In a round of stars, every bucket that holds several components has a
leader, the member with the most neighbours, which in a group of edited copies is the text that the others come from.
Every member is paired with one leader only, the one that it shares most buckets with: one pair a member, however large
the group and many the bands.

Members of buckets that then still hold several components are searched exactly, so that no link depends on a leader. A
pair above the threshold shares an item within both sets' first items in an order from rare to frequent, counted among
these members; how many come first depends on both sizes, so items are dealt by classes of sizes. In a group of edited
copies the first items are a copy's own edits, so copies that differ too much to link don't meet. Parities of the sets'
items, a few 64-bit words a set, bound from below how many items only one of two sets holds; no pair is made that they
rule out. Rounds of stars run over these items as buckets, with leaders drawn afresh: a member is paired with the leader
whose parities are nearest, so whoever links with a fair share of a group soon belongs to it. Then all pairs between the
components that are left and share such an item are compared: items whose holders are all of one component are left out,
and of the others the largest component's holders are only set against the rest. What is left to be tried grows with the
square of a group only where many of its members lie just below the threshold; each such trial costs a few operations on
words and makes no row.

With 24 bands of 6 registers a pair at a similarity of 0.85 is missed with a probability of about 1e-5, at 0.8 of about
7e-4 by bands alone (a chain of links through other members still joins it); the estimate's margin is five standard
deviations.

Defined results: words of null or empty texts are none: size 0, linked with nothing; every row is a document of its own,
whatever its doc_id: repeated rows are linked as copies, rows with a null doc_id take part, and a group is named by its
least doc_id (null if none has one); texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, frame, numbered, portions, stage, table

SHINGLE, BANDS, ROWS = 5, 24, 6
M = BANDS * ROWS
B, A, LIMIT = 1.001, 20.0, 65_534
MARGIN = 5.0
PERCENT = 80
ROUNDS = 4  # of stars over rare items
WIDTH = 1.02  # ratio of neighbouring classes of sizes
WORDS = [f"w{i}" for i in range(8)]  # of 64 parity bits each

_rng = np.random.default_rng(99)
BYTE = _rng.integers(0, 2**64, 256, np.uint64)
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
FACTORS = _rng.integers(0, 2**64, M, np.uint64) | np.uint64(1)
STEPS = _rng.integers(0, 2**64, SHINGLE, np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {"up": powers(BASE, 1 << 12), "down": powers(INVERSE, 1 << 12)}


def shingles(text: str) -> np.ndarray:
    """The distinct 64-bit hashes of the text's shingles, ascending."""
    raw = np.frombuffer(text.encode(), np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(raw) + 1 > len(_cache["up"]):
        _cache["up"], _cache["down"] = powers(BASE, 2 * len(raw)), powers(INVERSE, 2 * len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * _cache["down"][: len(raw)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * _cache["up"][starts] + (ends - starts).astype(np.uint64))
    n = min(len(words), SHINGLE)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * STEPS[i] + words[i : len(words) - n + 1 + i]
        h ^= h >> np.uint64(32)
    return np.unique(mix(h))


def sketch(items: np.ndarray) -> np.ndarray:
    least = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 4096):
        part = items[at : at + 4096, None] * FACTORS
        part ^= part >> np.uint64(29)
        part *= np.uint64(0x9FB21C651E98DF25)
        np.minimum(least, part.min(0), out=least)
    u = (least.astype(np.float64) + 1) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, LIMIT + 1).astype("<u2")


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One signed 64-bit key a band."""
    r = registers.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * BASE
    for i in range(ROWS):
        h = mix(h * STEPS[0] + r[:, i] + np.uint64(1))
    return h.view(np.int64)


def estimate(r1: np.ndarray, r2: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs of sketches (rows) with known set sizes."""
    larger, smaller = (r1 > r2).sum(1), (r1 < r2).sum(1)
    equal = r1.shape[1] - larger - smaller
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    def likelihood(j):
        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), top
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(30):  # golden section: the likelihood has one peak
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        left = likelihood(a) > likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def parities(items: np.ndarray) -> np.ndarray:
    """Whether an odd number of items fall into each of 64 * len(WORDS) places, packed. Two sets' parities differ at no
    more places than items are in only one of them."""
    n = 64 * len(WORDS)
    odd = np.bincount((items & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


# --- Spark ------------------------------------------------------------------------------------------------------------

SKETCHED = "_row long, doc_id long, key binary, n long, registers binary"


def sketched(rows: DataFrame) -> DataFrame:
    import hashlib

    arrow = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("registers", pa.binary())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(it, 2):
            keys, sizes, regs = [], [], []
            for text in frame(b.column(2)):
                s = shingles(text)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                regs.append(sketch(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary())], schema=arrow)

    return rows.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, SKETCHED)


def buckets(nodes: DataFrame) -> DataFrame:
    """id, n, bands: the bucket keys of every node."""
    arrow = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys = [band_keys(np.frombuffer(r, "<u2")).tolist() for r in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64()))], schema=arrow)

    return nodes.select("id", "n", "registers").mapInArrow(batches, "id long, n long, bands array<long>")


def close_sizes(n1, n2, percent: int):
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def fetched(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """id, registers, items and parities of these nodes, items being the full sets. The texts are dealt by row whatever
    the number of nodes, so that the plan is the same at every size."""
    arrow = pa.schema([("id", pa.int64()), ("registers", pa.binary()), ("items", pa.list_(pa.int64())), *[(w, pa.int64()) for w in WORDS]])

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(it, 2):
            found = [shingles(t) for t in frame(b.column(2))]
            words = np.array([parities(x) for x in found]).T
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), *map(pa.array, words)], schema=arrow)

    texts = rows.select(F.col("_row").alias("id"), "text")
    return stage(texts.join(nodes.select("id", "registers").hint("merge"), "id").select("id", "registers", "text").mapInArrow(sets, f"id long, registers binary, items array<long>, {', '.join(f'{w} long' for w in WORDS)}"))


def confirmed(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: those whose estimate leaves it possible, compared on their full sets."""
    t = percent / 100
    least = t - MARGIN * np.sqrt(t * (1 - t) / M)
    side = lambda x: items.select(F.col("id").alias(x), F.col("registers").alias(f"r_{x}"), F.col("items").alias(f"s_{x}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "r_a", "r_b", "s_a", "s_b")
    edges = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                x = whole.slice(at, 256)
                r1, r2 = (np.frombuffer(b"".join(x.column(i).to_pylist()), "<u2").reshape(-1, M) for i in (2, 3))
                sets = [(s.values.to_numpy(), t.values.to_numpy()) for s, t in zip(x.column(4), x.column(5), strict=True)]
                n1, n2 = (np.array([len(s[i]) for s in sets], float) for i in (0, 1))
                good = estimate(r1, r2, n1, n2) >= least
                for i in np.flatnonzero(good):
                    both = np.concatenate(sets[i])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    good[i] = 100 * common >= percent * (len(both) - common)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], schema=edges).filter(pa.array(good, pa.bool_()))

    return stage(both.mapInArrow(compare, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """id, comp (the least id reachable) of every node that has an edge; the lineage is cut every round."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        new = labels.join(near, "id").select("id", "comp", F.least("comp", "m").alias("low"))
        # and one step along the label itself
        jump = labels.select(F.col("id").alias("low"), F.col("comp").alias("far"))
        new = stage(new.join(jump, "low", "left").select("id", F.col("comp").alias("was"), F.least("low", F.coalesce("far", "low")).alias("comp")))
        changed = new.filter("was <> comp").limit(1).count()
        discard(labels)
        labels = new.select("id", "comp")
        labels._windrose_path = new._windrose_path
        if not changed:
            discard(both)
            return labels


def with_components(ids: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return ids.withColumn("comp", F.col("id"))
    return ids.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components after more edges: those between the components so far are joined themselves."""
    if labels is None:
        return components(edges)
    name = lambda x: labels.select(F.col("id").alias(x), F.col("comp").alias(f"c_{x}"))
    between = edges.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    moved = components(between.filter("a <> b"))
    old = labels.join(moved.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    out = stage(old.union(moved.join(labels, "id", "left_anti").select("id", "comp")))
    discard(labels, moved)
    return out


def joined_by(pairs: DataFrame, labels: DataFrame | None, items: DataFrame, percent: int) -> DataFrame:
    edges = confirmed(pairs, items, percent)
    out = merged(labels, edges)
    discard(pairs, edges)
    return out


def star_pairs(dealt: DataFrame, labels: DataFrame | None, first, percent: int) -> DataFrame:
    """Pairs (a, b) of a leader and a member, one pair a member: the leader of another component that it shares most
    buckets with. dealt: id, n, weight, k of the buckets' members; first: the column whose greatest value leads."""
    rows = with_components(dealt, labels)
    lead = rows.groupBy("k").agg(F.max(F.struct(first.alias("first"), "id", "n", "comp")).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    lead = stage(lead.filter("lo <> hi").select("k", F.col("l.id").alias("a"), F.col("l.n").alias("n_a"), F.col("l.comp").alias("c_a")))  # written, so that the join can split a hot bucket
    met = rows.join(lead, "k").filter((F.col("comp") != F.col("c_a")) & close_sizes(F.col("n"), F.col("n_a"), percent))
    best = met.groupBy("id", "a").agg(F.count("*").alias("bands")).groupBy("id").agg(F.max(F.struct("bands", (-F.col("a")).alias("minus"))).alias("best"))
    return best.select((-F.col("best.minus")).alias("a"), F.col("id").alias("b"))


def needed(n, m, percent: int):
    """How many items sets of n and m items share at least if they link."""
    return F.ceil((n + m) * percent / F.lit(100 + percent) - 1e-6)


def size_class(n):
    return F.floor(F.log(n) / F.lit(float(np.log(WIDTH))) + 1e-9).cast("int")


def parity_reach(n1, n2, one: str, two: str, percent: int):
    """At least how many items only one of two sets holds, by the parities in columns one and two (prefixes), and whether
    that leaves a link possible."""
    differ = sum(F.bit_count(F.col(f"{one}{w}").bitwiseXOR(F.col(f"{two}{w}"))) for w in WORDS)
    return differ, differ * (100 + percent) <= (n1 + n2) * (100 - percent)


def near_stars(front: DataFrame, labels: DataFrame | None, first, percent: int) -> DataFrame:
    """As star_pairs, over rare items instead of bands: of the leaders of its items a member is paired with the one whose
    parities are nearest."""
    rows = with_components(front, labels)
    named = F.struct(first.alias("first"), "id", "n", "comp", *WORDS)
    lead = rows.groupBy("k").agg(F.max(named).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    lead = stage(lead.select("k", F.col("l.id").alias("a"), F.col("l.n").alias("n_a"), F.col("l.comp").alias("c_a"), *[F.col(f"l.{w}").alias(f"a_{w}") for w in WORDS]))
    differ, reach = parity_reach(F.col("n"), F.col("n_a"), "", "a_", percent)
    apart = (F.col("comp") != F.col("c_a")) & close_sizes(F.col("n"), F.col("n_a"), percent) & reach
    met = rows.join(lead, [rows["k"] == lead["k"], apart]).select("id", "a", differ.alias("differ"))
    best = met.groupBy("id").agg(F.min(F.struct("differ", "a")).alias("best"))
    return best.select(F.col("best.a").alias("a"), F.col("id").alias("b"))


def front_items(dealt: DataFrame, labels: DataFrame | None, items: DataFrame, percent: int) -> DataFrame:
    """id, n, weight, parities, x, own, other, k: of every member of a bucket with several components its first items from rare to
    frequent, as many as partners of the size class `other` ask for, if another such member holds them. k names item and
    classes."""
    rows = with_components(dealt, labels)
    mixed = rows.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("k")
    still = stage(rows.join(mixed, "k").select("id", "n", "weight", "comp").distinct())
    each = items.join(still, "id").select("id", "n", "weight", "comp", F.explode("items").alias("x"))
    often = stage(each.groupBy("x").agg(F.count("*").alias("c")).filter("c > 1"))  # written, so that the join can split a hot item
    own, n = Window.partitionBy("id"), F.col("n")
    held = each.join(often, "x").withColumn("shared", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("c", "x")))
    low, high = F.ceil(n * percent / F.lit(100) - 1e-6), F.floor(n * 100 / F.lit(percent) + 1e-6)
    held = held.withColumn("pos", n - F.col("shared") + F.col("r")).filter(F.col("pos") <= n - low + 1)
    held = stage(held.select("x", "id", "comp", "n", "weight", "pos"))
    several = stage(held.groupBy("x").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("x"))
    classes = held.drop("comp").join(several, "x").withColumn("own", size_class(n)).withColumn("other", F.explode(F.sequence(size_class(low), size_class(high))))
    least = F.greatest(low, F.floor(F.pow(F.lit(WIDTH), F.col("other"))) - 1)
    front = classes.filter(F.col("pos") <= n - needed(n, least, percent) + 1)
    front = front.join(items.select("id", *WORDS), "id")
    out = stage(front.select("id", "n", "weight", *WORDS, "x", "own", "other", F.xxhash64("x", F.least("own", "other"), F.greatest("own", "other")).alias("k")))
    discard(still, often, held, several)
    return out


def front_pairs(front: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that share one of the first items of both, as far as sizes and parities
    allow a link. Where one component holds most of an item, its members are set against the others only."""
    held = with_components(front, labels)
    per = held.groupBy("k", "comp").agg(F.count("*").alias("c"))
    tops = per.groupBy("k").agg(F.max(F.struct("c", "comp")).alias("most"), F.count("*").alias("comps"))
    tops = stage(tops.filter("comps > 1").select("k", F.col("most.comp").alias("top")))
    rows = stage(held.join(tops, "k").select("x", "own", "other", "id", "comp", "n", "top", *WORDS))
    side = rows.select(*[F.col(c).alias(f"{c}2") for c in ("x", "own", "other", "id", "comp", "n")], *[F.col(w).alias(f"other_{w}") for w in WORDS])
    same = [F.col("x") == F.col("x2"), F.col("own") == F.col("other2"), F.col("other") == F.col("own2")]
    apart = (F.col("comp") != F.col("comp2")) & ((F.col("comp2") == F.col("top")) | (F.col("id") < F.col("id2"))) & close_sizes(F.col("n"), F.col("n2"), percent)
    _, reach = parity_reach(F.col("n"), F.col("n2"), "", "other_", percent)
    pairs = rows.filter("comp <> top").join(side, [*same, apart & reach])
    out = stage(pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct())
    discard(tops, rows)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = numbered(docs.select("doc_id", "text"))
    out = grouped(rows, percent)
    discard(rows)
    return out.drop("_row", "kept")


def grouped(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """_row, doc_id, n_shingles, component_id and kept of every row of a numbered() table. Of each group one row is kept:
    the one with the least doc_id, nulls last."""
    base = stage(sketched(rows))
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "n", "registers")  # nulls last
    nodes = stage(base.filter("n > 0").groupBy("key").agg(F.min(named).alias("r")).select("key", F.col("r._row").alias("id"), F.col("r.none").alias("none"), F.col("r.doc_id").alias("doc_id"), F.col("r.n").alias("n"), F.col("r.registers").alias("registers")))
    members = stage(buckets(nodes))
    deal = members.select("id", "n", F.explode("bands").alias("k"))
    sizes = stage(deal.groupBy("k").agg(F.count("*").alias("c")).filter("c > 1"))
    shared = stage(deal.join(sizes, "k"))
    weight = shared.groupBy("id").agg(F.sum("c").alias("weight"))
    dealt = stage(shared.join(weight, "id").select("id", "n", "weight", "k"))
    items = fetched(nodes.join(dealt.select("id").distinct(), "id", "left_semi"), rows)
    discard(members, sizes, shared)

    labels = joined_by(stage(star_pairs(dealt, None, F.col("weight"), percent)), None, items, percent)
    front = front_items(dealt, labels, items, percent)
    for i in range(ROUNDS):
        pairs = stage(near_stars(front, labels, F.xxhash64("k", "id", F.lit(i)) if i else F.col("weight"), percent))
        if not pairs.limit(1).count():
            break
        labels = joined_by(pairs, labels, items, percent)
    labels = joined_by(front_pairs(front, labels, percent), labels, items, percent)
    discard(dealt, items, front)

    of_node = with_components(nodes.select("key", "id", "none", "doc_id"), labels)
    least = of_node.groupBy("comp").agg(F.min(F.struct("none", "doc_id", "id")).alias("least"))
    joined = base.join(of_node.join(least, "comp").select("key", "least"), "key", "left")
    comp = F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    kept = (F.col("n") == 0) | (F.col("_row") == F.col("least.id"))
    return joined.select("_row", "doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), kept.alias("kept"))


def op7_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = grouped(rows, 85)
    discard(rows)
    return out.drop("_row")
