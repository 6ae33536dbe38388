"""Packing: every id once, no gaps, little padding, and the ids themselves."""

import zlib

import numpy as np

from windrose.llm import packing


def check(df, capacity=2048):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs = {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in df.collect()}
    pieces = packing.pack_documents(df).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        ids = docs[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert by_doc.keys() == docs.keys()
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(docs[i])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_seq), sum(map(len, docs.values()))


def test_packs_all_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 20)
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["alpha", "béta", "of", "the", "thion"], int(n))) for n in rng.integers(0, 1500, 150)]
    texts += [None, "", "<|endoftext|>", "a <|endoftext|><|endoftext|>b <|endoftext", "x" * 30_000, " " * 5000, "word " * 9000, "tie"] + ["tie"] * 40
    n, total = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert n <= 1.05 * total / 2048 + 2


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", 0, 1)] * 3, "doc_id long, text string, size int, slice int")
    got = packing.pack_documents(df).collect()
    assert len(got) == 3 and len({(p.sequence_id, p.offset) for p in got}) == 3
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_plan_meets_demand_near_the_bound():
    rng = np.random.default_rng(1)
    for room in (32, 256):
        demand = {int(s): int(n) for s, n in zip(rng.permutation(np.arange(1, room))[: room // 2], rng.integers(1, 60, room // 2), strict=True)}
        patterns = packing.plan(demand, room)
        held = {}
        for p, n in patterns:
            assert sum(s * k for s, k in p.items()) <= room
            for s, k in p.items():
                held[s] = held.get(s, 0) + k * n
        assert all(held.get(s, 0) >= n for s, n in demand.items())
        bins = []  # first fit, longest first
        for size in sorted((s for s, n in demand.items() for _ in range(n)), reverse=True):
            at = next((i for i, left in enumerate(bins) if left >= size), None)
            if at is None:
                bins.append(room - size)
            else:
                bins[at] -= size
        total = sum(n for _, n in patterns)
        assert sum(s * n for s, n in demand.items()) / room <= total <= len(bins) * 1.001 + 4
