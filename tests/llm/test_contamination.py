"""Decontamination against every window of every item."""

import random
import re

import pytest

from windrose.llm import contamination as con


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, window):
    held = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            held.setdefault(tuple(w[k : k + m]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, got = words(text), set(), set()
        for x, ids in held.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    got |= ids
        out.append((doc_id, len(w), len(hit), tuple(sorted(str(i) for i in got if i is not None))))
    return sorted(out, key=repr)


def found(spark, docs, items, window=4, shard_words=10**6, more=()):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *more)
    i = spark.createDataFrame(items, "item_id long, text string")
    out = con.matches(d, i, window, shard_words).collect()
    for r in out:
        assert sum(s.end - s.first for s in r.spans) == r.n_hit and all(a.end < b.first for a, b in zip(r.spans, r.spans[1:], strict=False))
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out), key=repr)


def tables(seed=1):
    rng = random.Random(seed)
    text = lambda n, k=5: " ".join(rng.choice("abcdeé"[:k]) for _ in range(n))
    items = [(i, text(rng.randint(1, 12))) for i in range(25)]
    items += [(90, ""), (91, None), (92, "... --"), (93, "z"), (None, "Q q, Q q! q"), (7, "one more of item seven here"), (94, items[3][1]), (94, items[3][1]), (10, text(60))]
    docs = [(i, text(rng.randint(0, 40), 6)) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "?!"), (103, "x Z y"), (104, "q Q-q\x00q q"), (105, "One MORE of, item"), (105, "One MORE of, item"), (None, items[3][1]), (106, "zebra " * 30_000 + items[-1][1] + " zebra" * 30_000)]
    return docs, items


@pytest.mark.parametrize("window", [1, 3, 4, 10])
def test_equals_brute_force(spark, window):
    docs, items = tables(window)
    assert found(spark, docs, items, window) == brute(docs, items, window)


def test_items_in_several_shards_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(con, "PIECE", 12)
    docs, items = tables()
    assert found(spark, docs, items, shard_words=40) == brute(docs, items, 4)


def test_empty_tables_and_clashing_names(spark):
    docs, items = tables()
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == brute(docs, [], 4)
    assert found(spark, docs, items, more=["1 AS row", "2 AS spans", "'x' AS items", "3 AS n_words"]) == brute(docs, items, 4)


def test_longest_match(spark):
    d = spark.createDataFrame([(1, "n a b c d e n a b"), (2, "a b n")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "z a b c d e f")], "item_id long, text string")
    assert {r.doc_id: (r.longest, r.n_hit) for r in con.matches(d, i, 3).collect()} == {1: (5, 5), 2: (0, 0)}


def test_spans_and_covered_documents_go(spark):
    d = spark.createDataFrame([(1, "Kept! One, two; THREE four. And é kept too, of course", 5), (2, "one two three four", 6), (3, "clean", 7), (4, None, 8)], "doc_id long, text string, spans int")
    i = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    out = con.decontaminate(d, i, 4)
    assert out.columns == d.columns
    assert sorted((r.doc_id, r.text, r.spans) for r in out.collect()) == [(1, "Kept! . And é kept too, of course", 5), (3, "clean", 7), (4, None, 8)]


def test_states_of_the_automaton():
    """Its paths from the root are the subsequences of the items, each once."""
    rng = random.Random(5)
    items = [(i, [rng.choice([b"a", b"b"]) for _ in range(rng.randint(1, 9))]) for i in range(6)]
    a = con.Automaton(items, 3)
    want = {tuple(w[i:j]) for _, w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    got, stack = set(), [((), 0)]
    while stack:
        path, s = stack.pop()
        for w, t in a.next[s].items():
            got.add(path + (w,))
            stack.append((path + (w,), t))
            assert a.length[a.link[t]] < len(path) + 1 <= a.length[t]
    names = {n: w for w, n in a.vocabulary.items()}
    assert {tuple(names[x] for x in p) for p in got} == want
