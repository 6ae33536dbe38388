"""Repetition counts against a plain version."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from windrose.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeat = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines, seen = 0, set()
    for x in text.split("\n"):
        if WORD.search(x):
            lines += x in seen
            seen.add(x)
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeat), failed


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t|#é日\x1c ", max_size=200))
def test_base_counts(text):
    m = quality.measure(text)
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"], m["base_failed"]) == plain(text)


def test_shares_of_duplicated_grams():
    words = [f"w{i}" for i in range(40)]
    text = " ".join(words + words[:10])
    m = quality.measure(text)
    inside = 2 * sum(len(w) for w in words[:10]) / sum(len(w) for w in words + words[:10])
    assert all(abs(x - inside) < 1e-12 for x in m["dup_gram_shares"])
    assert quality.measure(" ".join(f"u{i}" for i in range(60)))["kept"]
    assert not quality.measure("the same line again and again\n" * 30)["kept"]


def test_cases(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a " * 200_000, 3), (3, "a " * 200_000, 3)], "doc_id long, text string, kept int")
    got = sorted((r.doc_id, r.n_words, r.kept) for r in quality.repetition(df).collect())
    assert got == [(1, 0, False), (2, 0, False), (3, 200_000, False), (3, 200_000, False)]
    assert quality.repetition(df.limit(0)).count() == 0
