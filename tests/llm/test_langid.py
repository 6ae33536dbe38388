"""Language identification: the forward sum, held-out accuracy, odd texts."""

import numpy as np

from windrose.llm import langid

DIR = "/root/testdata/sf0.001"


def test_forward_sums_all_segmentations():
    names = [" a", "b", "ab", "bc", "c", "abc", " ab", "a", " "]
    pieces = langid.Pieces(names)
    p = np.vstack([np.random.default_rng(0).random((len(names), 2)), np.zeros(2)])

    def all_ways(word):
        if not word:
            return np.ones(2)
        total = all_ways(word[1:]) * langid.FLOOR
        for i, n in enumerate(names):
            if word.startswith(n):
                total = total + p[i] * all_ways(word[len(n) :])
        return total

    words = [" abc", " abcab", "b", "xyz", " a" + "bc" * 5]
    assert np.allclose(langid.log_likelihoods(words, pieces, p), [np.log(all_ways(w)) for w in words])


def test_all_pieces_are_found():
    names = langid.public_pieces()
    pieces = langid.Pieces(names)
    some = names[:: max(1, len(names) // 3000)]
    size, found = pieces.find(some)
    assert all(names[found[len(w) - 1][i, 0]] == w for i, w in enumerate(some))


def test_held_out_accuracy(spark):
    out = langid.op9_language_id(spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_texts(spark):
    train = spark.createDataFrame([(i, t, l) for i in range(30) for t, l in (("the of and thing ere", "en"), ("der und sch keit ung", "de"), ("x", None))], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    model = langid.fit(train, F.lit(True))
    assert model["langs"] == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 456 ,.!"), (4, "the thing " * 40_000), (5, "UND DER KEIT"), (6, "²③"), (6, "²③"), (7, "日本")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 6)] == ["und"] * 4 and got[4][0] == "en" and got[5][0] == "de" and got[7][0] in ("de", "en")
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    nothing = langid.fit(train.filter("lang IS NULL"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(train.select("doc_id", "text"), nothing).collect()} == {"und"}
