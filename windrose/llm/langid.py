"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, by a forward algorithm; the probabilities are fitted by expectation maximisation over the
words of a sample. A text's score sums the logarithms over all of its words; each different word of a batch is worked
out once, for many words at a time in numpy. Words of more than LONGEST letters are worked out letter by letter with
rescaled sums, whole as well.

Bounds of the model's fit, and of nothing else: the sample holds about SAMPLE documents a language, chosen by a seeded
hash, and its words are cut every LONGEST letters. Words are runs without white space, lower-cased, letters only, in the
fit and in predictions.

Defined results: null, empty and letterless texts are 'und' with score 0; languages that the sample lacks are never
predicted, and if there is none at all, everything is 'und'; ties go to the language first by name; repeated rows get
the same result; very long texts and words are read whole; an empty table gives no rows; columns that have the names of
the results are replaced, other columns are kept.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import bucket_of, portions, table

SAMPLE, ROUNDS, LONGEST, CACHE = 600, 3, 32, 200_000
BLOCK = 1 << 19  # numbers in an array of forward sums
FLOOR = 1e-7  # of a letter that no piece covers
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
SLOTS = 20
ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def letters(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def public_pieces(name: str = "piece_bpe_32k.model") -> list[str]:
    """Pieces of a public vocabulary that consist of letters, word starts marked by a blank."""
    import public_tokenizers as public
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public.path(name))
    words = (model.id_to_piece(i).replace("▁", " ").lower() for i in range(model.get_piece_size()))
    return sorted({w for w in words if w.strip().isalpha() and " " not in w[1:]})


class Pieces:
    """Numbers of pieces, looked up for all substrings of many words at once in two open tables of hashes."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        hashes = np.array([self.hash_one(p) for p in pieces], np.uint64)
        self.tables = []
        left = np.arange(self.n)
        for shift in (64 - SLOTS, 64 - 2 * SLOTS, 4):
            slot = ((hashes[left] >> np.uint64(shift)) & np.uint64((1 << SLOTS) - 1)).astype(np.int64)
            _, keep = np.unique(slot, return_index=True)
            number = np.full(1 << SLOTS, self.n, np.int32)
            number[slot[keep]] = left[keep]
            self.tables.append((np.uint64(shift), number))
            left = np.delete(left, keep)
        self.hashes = np.append(hashes, np.uint64(0))

    @staticmethod
    def hash_one(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(MULTIPLIER)) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 31
        return h

    def find(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Lengths, and for each piece length the numbers of the substrings by start (n where there is no piece)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max(initial=0))
        codes = np.zeros((len(words), width), np.uint64)
        mask = np.arange(width) < size[:, None]
        codes[mask] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        h = np.zeros_like(codes)
        found = []
        for m in range(1, min(self.longest, width) + 1):
            h = (h[:, : width - m + 1] + codes[:, m - 1 :] + np.uint64(1)) * MULTIPLIER
            h ^= h >> np.uint64(31)
            number = np.full(h.shape, self.n, np.int32)
            for shift, slots in self.tables:
                got = slots[((h >> shift) & np.uint64((1 << SLOTS) - 1)).astype(np.int64)]
                number = np.where(self.hashes[got] == h, got, number)
            number[np.arange(width - m + 1) + m > size[:, None]] = self.n
            found.append(number)
        return size, found


def forward(size: np.ndarray, found: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """alpha[word, end, language]; p has a last row for what is no piece."""
    n, width, absent = len(size), found[0].shape[1], len(p) - 1
    alpha = np.zeros((n, width + 1, p.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, width + 1):
        alpha[:, end] = alpha[:, end - 1] * FLOOR
        for m in range(1, min(len(found), end) + 1):
            number = found[m - 1][:, end - m]
            rows = np.flatnonzero(number < absent)
            if len(rows):
                alpha[rows, end] += alpha[rows, end - m] * p[number[rows]]
    return alpha


def blocks(words: list[str], languages: int) -> Iterator[np.ndarray]:
    """Numbers of words of similar lengths, as many as BLOCK allows."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(words):
        end = min(len(words), at + 4096)
        while end > at + 1 and (end - at) * (size[order[end - 1]] + 1) * languages > BLOCK:
            end = at + (end - at) // 2
        yield order[at:end]
        at = end


def long_word(word: str, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """The same sum for a word of any length: what stands at the next ends is carried on, rescaled from time to time."""
    ahead = np.zeros((pieces.longest + 1, p.shape[1]))
    ahead[0] = 1
    log = np.zeros(p.shape[1])
    for at in range(0, len(word), 4096):
        part = word[at : at + 4096 + pieces.longest - 1]
        _, found = pieces.find([part])
        steps = min(4096, len(word) - at)
        number = np.full((steps, pieces.longest), pieces.n, np.int64)
        for m, f in enumerate(found):
            k = min(steps, f.shape[1])
            number[:k, m] = f[0, :k]
        for i in range(steps):
            ahead[1:] += ahead[0] * p[number[i]]
            ahead[1] += ahead[0] * FLOOR
            ahead[:-1] = ahead[1:]
            ahead[-1] = 0
            if i % 16 == 15:
                scale = ahead.max(0)
                log += np.log(scale)
                ahead /= scale
    return log + np.log(ahead[0])


def log_likelihoods(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), p.shape[1]))
    short = []
    for i, w in enumerate(words):
        if len(w) <= LONGEST + 1:
            short.append(i)
        else:
            out[i] = long_word(w, pieces, p)
    for rows in blocks([words[i] for i in short], p.shape[1]):
        at = np.array(short)[rows]
        size, found = pieces.find([words[i] for i in at])
        alpha = forward(size, found, p)
        out[at] = np.log(alpha[np.arange(len(at)), size])
    return out


def expectation(words: list[str], weights: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over all segmentations; weights: [word, language]."""
    counts = np.zeros_like(p)
    for rows in blocks(words, p.shape[1]):
        size, found = pieces.find([words[i] for i in rows])
        alpha = forward(size, found, p)
        width = alpha.shape[1] - 1
        beta = np.zeros_like(alpha)
        beta[np.arange(len(rows)), size] = 1
        numbers, masses = [], []
        w = weights[rows] / alpha[np.arange(len(rows)), size]
        for start in range(width - 1, -1, -1):
            beta[:, start] += FLOOR * beta[:, start + 1]
            for m in range(1, min(len(found), width - start) + 1):
                number = found[m - 1][:, start]
                at = np.flatnonzero(number < pieces.n)
                if len(at):
                    through = p[number[at]] * beta[at, start + m]
                    beta[at, start] += through
                    numbers.append(number[at])
                    masses.append(alpha[at, start] * through * w[at])
        if numbers:
            number, mass = np.concatenate(numbers), np.concatenate(masses)
            for k in range(p.shape[1]):
                counts[:, k] += np.bincount(number, mass[:, k], pieces.n + 1)
    return counts


def split_long(word: str) -> list[str]:
    return [f" {word[:LONGEST]}", *(word[i : i + LONGEST] for i in range(LONGEST, len(word), LONGEST))]


def fit(docs: DataFrame, learn: Column, lang: str = "lang", vocabulary: str = "piece_bpe_32k.model") -> dict:
    """docs: text and language; learn: which rows may be used. The sample's words are counted on Spark."""
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col("text").isNotNull())
    per = rows.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()  # a row a language, as the model has a column each
    if not per:
        return {"langs": [], "pieces": (names := public_pieces(vocabulary)), "p": np.zeros((len(names) + 1, 0))}
    size = F.element_at(F.create_map(*[F.lit(x) for r in per for x in (r["l"], r["n"])]), F.col(lang))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) / 1_000_000
    sample = rows.filter(chance < F.lit(SAMPLE) / size).withColumn("l", F.col(lang))
    word = F.explode(F.split("text", "[\\s\\p{Z}\\x1c-\\x1f\\x85]+"))
    letters_only = F.regexp_replace(F.lower("w"), "[^\\p{L}]", "")
    counted = sample.select("l", word.alias("w")).select("l", letters_only.alias("w")).filter("w <> ''").groupBy("l", "w").agg(F.count("*").alias("n")).toPandas()
    langs = sorted(counted["l"].unique())
    pieces = Pieces(names := public_pieces(vocabulary))
    words: dict[str, int] = {}
    at, by, n = [], [], []
    for w, one, k in zip(counted["w"], counted["l"], counted["n"], strict=True):
        for part in split_long(w):
            at.append(words.setdefault(part, len(words)))
            by.append(langs.index(one))
            n.append(k)
    weights = np.zeros((len(words), len(langs)))
    np.add.at(weights, (at, by), n)
    listed = list(words)
    p = np.full((pieces.n + 1, len(langs)), 1.0 / pieces.n)
    p[-1] = 0
    for _ in range(ROUNDS):
        counts = expectation(listed, weights, pieces, p)
        counts[-1] = 0
        p = counts + 0.05
        p[-1] = 0
        p /= p.sum(0)
    return {"langs": langs, "pieces": names, "p": p}


def identify(docs: DataFrame, model: dict, text: str = "text", pred: str = "lang_pred", conf: str = "score") -> DataFrame:
    """docs with the language predicted and its score: the posterior if all languages are equally likely beforehand."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as vocabulary and languages, whatever the corpus
    docs = docs.drop(pred, conf)
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(conf, DoubleType())])
    position = names.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        pieces, langs, p = Pieces(m["pieces"]), m["langs"], m["p"]
        known: defaultdict[str, int] = defaultdict()
        known.default_factory = known.__len__  # a new word gets the next number
        values = np.zeros((1024, len(langs)))
        for b in portions(it, position):
            if len(known) > CACHE:
                known.clear()
            old = len(known)
            docs_ = []
            for t in b.column(position).to_pylist():
                words = t.split() if langs and t and has_letter(t) else None
                docs_.append(None if words is None else np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            fresh = [f" {w}" if w else "" for w in map(letters, islice(known, old, None))]
            while len(values) < len(known):
                values = np.concatenate([values, np.zeros_like(values)])
            values[old : len(known)] = 0
            at = np.array([i for i, w in enumerate(fresh) if w], np.int64)
            if len(at):
                values[old + at] = log_likelihoods([fresh[i] for i in at], pieces, p)
            best, score = [], []
            for words in docs_:
                if words is None:
                    best.append("und")
                    score.append(0.0)
                    continue
                total = values[words].sum(0)
                k = int(total.argmax())
                best.append(langs[k])
                score.append(float(1 / np.exp(total - total[k]).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*names, pred, conf])

    return docs.mapInArrow(batches, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"), bucket_of("doc_id", 4) != 2)
    held = identify(docs.select("doc_id", "text"), model)
    return held.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
