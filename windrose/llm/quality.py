"""Quality rules on repetition: how much of a text lies inside duplicated n-grams and lines.

Words get numbers, n-grams of words a rolling hash (64 bits, wrapping), all lengths in numpy. For 2 to 4 words the
share of the characters inside the most frequent n-gram counts, for 5 to 10 words the share inside any n-gram that
occurs twice or more, and for lines the share of lines and of characters in lines seen before. The limits follow the
published repetition rules for web text.

Defined results: null or empty text has no words and fails the base rule; texts of any length are measured whole;
repeated rows are judged alike, each on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WORD, portions, table

#: Published limits by n-gram length, as shares of the characters in words.
TOP_LIMIT = {2: 0.20, 3: 0.18, 4: 0.16}
DUP_LIMIT = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.20
MIN_WORDS = 50

BASE = np.uint64(0x9E3779B97F4A7C15)
BODY, SYMBOLS = re.compile(WORD), re.compile(r"[#*$%&|<>]")
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_share double, dup_line_char_share double, top_gram_shares array<double>, dup_gram_shares array<double>"
)


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the words inside the n-word windows that begin at starts."""
    edge = np.zeros(total + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return edge[:-1].cumsum() > 0 if total else np.zeros(0, bool)


def repeated(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each code: how often it occurs, and its number among the distinct ones."""
    _, which, n = np.unique(codes, return_inverse=True, return_counts=True)
    return n[which], which


def measure(text: str) -> dict:
    words = text.encode().split()
    n = len(words)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    lengths = map(len, words) if text.isascii() else (len(w.decode()) for w in words)
    chars = np.fromiter(lengths, np.int64, n)
    word_chars = int(chars.sum())
    lines = [x for x in text.split("\n") if x and BODY.search(x)]
    seen: set[str] = set()
    dup_lines, dup_line_chars, line_chars = 0, 0, 0
    for x in lines:
        line_chars += len(x)
        if x in seen:
            dup_lines, dup_line_chars = dup_lines + 1, dup_line_chars + len(x)
        seen.add(x)
    # three-word windows exactly, by pairs of numbers: no hash that could collide
    repeat_words = 0
    if n >= 3:
        pairs = repeated(ids[:-1] * len(numbers) + ids[1:])[1]
        times = repeated(pairs[:-1] * len(numbers) + ids[2:])[0]
        repeat_words = int(covered(np.flatnonzero(times >= 2), 3, n).sum())
    failed = n < MIN_WORDS or 100 * repeat_words > 50 * n
    top, dup = [], []
    if n:
        total = max(word_chars, 1)
        hashes = (ids.astype(np.uint64) + np.uint64(1)) * BASE
        rolling = hashes.copy()
        alive = True  # a window is a repeat only if the shorter one in it is
        for m in range(2, max(DUP_LIMIT) + 1):
            if n < m or not alive:
                (top if m in TOP_LIMIT else dup).append(0.0)
                continue
            rolling = rolling[: n - m + 1] * BASE + hashes[m - 1 :] ^ (rolling[: n - m + 1] >> np.uint64(29))
            times, which = repeated(rolling)
            alive = bool((times >= 2).any())
            if m in TOP_LIMIT:
                best = int(times.max())
                share = 0.0
                if best >= 2:
                    i = int(np.flatnonzero(times == best)[0])
                    share = float(chars[covered(np.flatnonzero(which == which[i]), m, n)].sum() / total)
                top.append(share)
            else:
                dup.append(float(chars[covered(np.flatnonzero(times >= 2), m, n)].sum() / total) if alive else 0.0)
    line_share, line_char_share = dup_lines / max(len(lines), 1), dup_line_chars / max(line_chars, 1)
    bad = (
        failed
        or line_share > LINE_LIMIT
        or line_char_share > LINE_CHAR_LIMIT
        or any(x > limit for x, limit in zip(top, TOP_LIMIT.values(), strict=False))
        or any(x > limit for x, limit in zip(dup, DUP_LIMIT.values(), strict=False))
    )
    return {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": len(SYMBOLS.findall(text)),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": failed,
        "kept": not bad,
        "dup_line_share": line_share,
        "dup_line_char_share": line_char_share,
        "top_gram_shares": top,
        "dup_gram_shares": dup,
    }


def repetition(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, shares and verdict."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(it, 1):
            rows = [{"doc_id": i} | measure(t or "") for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return docs.select("doc_id", "text").mapInArrow(batches, SCHEMA)


ARROW = pa.schema(
    [("doc_id", pa.int64())]
    + [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_line_share", pa.float64()), ("dup_line_char_share", pa.float64())]
    + [("top_gram_shares", pa.list_(pa.float64())), ("dup_gram_shares", pa.list_(pa.float64()))]
)


def op6_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))
