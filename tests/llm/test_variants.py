"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from windrose.llm import variants as var


def counts(docs):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(docs):
    n = counts(docs)
    near = {w: [x for x in n if apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def found(spark, docs, shard=100_000, more=()):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *more)
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in var.grouped(df, shard).collect())


def fixture_docs():
    rng = random.Random(2)
    base = ["letters", "lettérs", "aaaaaa", "aabbaa", "Größen", "naïveté", "ÿÿÿÿÿÿ", "wordings"]
    pool = []
    for w in base:
        pool += [w] * 60
        for _ in range(40):
            i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            pool.append(w[:i] + rng.choice("abély") * (kind != 1) + w[i + (kind > 0) :])
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    # a chain of forms: 3,200 over 640 over 128 over 25 over 5
    chain = ["chained"] * 3200 + ["chainee"] * 640 + ["chaipee"] * 128 + ["chqipee"] * 25 + ["cwqipee"] * 5
    docs += [(200, " ".join(chain)), (200, "twice the same twicer twicers row"), (200, "twice the same twicer twicers row"), (201, None), (202, ""), (None, "nobody's nobodies nobodys " * 9)]
    return docs


@pytest.mark.parametrize("shard", [7, 50, 100_000])
def test_equals_all_pairs(spark, shard):
    docs = fixture_docs()
    want = brute(docs)
    assert len(want) > 60 and sum(r[1] is not None for r in want) > 10 and any(r[1] not in (None, r[2]) for r in want)
    assert found(spark, docs, shard) == want


def test_empty_table_and_clashing_names(spark):
    assert found(spark, []) == []
    docs = fixture_docs()[:60]
    assert found(spark, docs, more=["1 AS n", "'x' AS word", "2 AS near"]) == brute(docs)


def test_very_long_text(spark):
    docs = [(1, "lengthy " * 40_000 + "x" * 300_000 + " lengths " * 7 + " lenghts" * 300)]
    assert found(spark, docs) == brute(docs)


def test_trie_finds_each_neighbour_once():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    trie = var.Trie(words, [1] * len(words))
    for w in [*words, "ababab", "", "zz"]:
        assert sorted(words[i] for i in trie.near(w)) == [x for x in words if apart(w, x)]


def test_trie_of_one_word():
    trie = var.Trie(["single"], [5])
    assert [list(trie.near(w)) for w in ("single", "singel", "singles", "ingle", "xsingle", "sinxgle", "sinxle")] == [[], [], [0], [0], [0], [0], [0]]
