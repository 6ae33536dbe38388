"""The pipeline: each stage on what the one before kept, against a plain version where one is exact."""

import corpus_pipeline as cp
from windrose.llm import langid, mixing
from windrose.llm.common import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(10_001, None, None, None, None), (10_002, "", "en", "src0", 0), (10_003, "12 34", None, "src0", 5), (10_004, "the thing of and was here", None, None, 25)]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema))


def test_stages(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept, d = {}, docs
    for name, step in cp.STAGES:
        d = stage(step(spark, d, str(tmp_path)))
        kept[name] = d.collect()
        if name != "packing":
            assert d.columns == COLUMNS
    ids = {r.doc_id for r in kept["language"]}
    assert ids == {r.doc_id for r in docs.collect() if r.text and langid.has_letter(r.text)}
    assert all(r.lang for r in kept["language"])

    from test_neardup import brute

    groups = brute([(r.doc_id, r.text) for r in kept["language"]], 80)
    assert {r.doc_id for r in kept["near_duplicates"]} == {i for i, (_, c) in groups.items() if i == c}
    assert {r.doc_id for r in kept["personal_data"]} == {r.doc_id for r in kept["near_duplicates"]}
    from windrose.llm import pii

    assert not any(pii.base_spans(r.text) for r in kept["personal_data"])
    assert all(r.n_chars == len(r.text) for r in kept["personal_data"])

    plan = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(kept["personal_data"], docs.schema)).collect()}
    words = {}
    for r in kept["mixing"]:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == {i: n for i, n in plan.items() if n}
    packed = {}
    for p in kept["packing"]:
        packed[p.doc_id] = packed.get(p.doc_id, 0) + p.length
    assert packed.keys() == words.keys()


def test_null_and_repeated_ids_stay(spark):
    """A null-id row among copies with a near copy, a null-id row alone, null-id copies, two texts under one id."""
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text), (5, text), (6, text), (7, text + " more"), (None, "alone here as one"), (None, "a pair of copies"), (None, "a pair of copies"), (9, "the first text of nine"), (9, "another one of nine"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = [(5, text), (9, "another one of nine"), (9, "the first text of nine"), (None, "a pair of copies"), (None, "alone here as one"), (None, None)]
    kept = stage(cp.near_duplicates(spark, docs, ""))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)

    from windrose.llm import neardup

    found = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).filter("n_shingles > 90").collect()}
    assert found == {(None, 5), (5, 5), (6, 5), (7, 5)}
    drawn = mixing.drawn(docs, expand=2.0)  # every row twice, each its own words
    assert sorted((r.doc_id or 0, r.text) for r in drawn.collect()) == sorted((i or 0, t) for i, t in rows * 2 if t)


def test_clashing_columns_and_very_long_texts(spark):
    """Columns with the names that the operators give their own stay as they are; a text of 30,000 words goes through."""
    from pyspark.sql import functions as F

    docs = documents(spark).limit(40)
    long = spark.createDataFrame([(77_777, "the long and the of " * 6_000, None, "src0", 120_000)], docs.schema)
    docs = docs.unionByName(long)
    for name in ("lang_pred", "score", "_row", "_part", "_repeats", "Key", "comp"):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    d = docs
    for name, step in cp.STAGES:
        d = stage(step(spark, d, ""))
        if name != "packing":
            assert d.columns == docs.columns
            assert all(r[c] == f"{c} of {r.doc_id}" for r in d.collect() for c in docs.columns[5:])
    assert d.filter("doc_id = 77777").count()


def test_empty_table(spark):
    docs = documents(spark).limit(0)
    for name, step in cp.STAGES:
        docs = stage(step(spark, docs, ""))
        assert docs.count() == 0, name
