"""Language ID: held-out accuracy, the code, and edge cases."""

import numpy as np
from pyspark.sql import functions as F

from runfold.llm import langid
from tests.conftest import SF_MID

DOCS = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy(spark):
    import __spark_entry__ as e
    out = e.queries()["op1_language_id"](spark, SF_MID)
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = out.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and len(r.text.split()) >= 5]
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.99
    assert all(0 <= r.score <= 1 for r in got)
    long = [r for r in got if len(r.text.split()) >= 50]
    assert not any(r.ambiguous for r in long) and len(long) > 500


def test_codes_are_apart():
    for n in (2, 3, 4, 7, 8, 30):
        code = langid.code_matrix(n)
        assert code.shape[0] == n and len(np.unique(code, axis=0)) == n
        assert all((code[:, b] > 0).any() and (code[:, b] < 0).any() for b in range(code.shape[1]))
    assert langid.code_matrix(4).shape == (4, 7)


def test_margins_by_hand():
    rng = np.random.default_rng(1)
    w = rng.normal(size=(langid.N_FEATURES, 3)).astype(np.float32)
    texts = ["Ab, cd é", "", "zz" * 700000, "x1y"]
    got = langid.margins(texts, w)
    for t, m in zip(texts, got):
        s = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ") + "  "
        if len(s) < 100:
            grams, counted = langid._grams(s[:-2])
            assert np.allclose(m, (w[grams[counted]].sum(axis=0) / max(1, counted.sum())), atol=1e-4)
    assert np.allclose(got[2], langid.margins(["zz" * 1000], w)[0], atol=2e-2)  # in pieces as in one


def test_nulls_and_few_languages(spark):
    data = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 !!", "en", "x"), (None, "the river the hill", "en", "x"),
            (5, "le la une des", None, None)] + [(i, "the river runs over the hill", "en", None) for i in range(6, 40)]
    one = langid.predict(spark.createDataFrame(data, DOCS), langid.fit(spark.createDataFrame(data, DOCS), F.lit(True)), ["doc_id"])
    got = {r.doc_id: (r.lang_pred, r.score) for r in one.collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[5] == ("en", 1.0) and got[None] == ("en", 1.0)
    none = spark.createDataFrame([(1, "some text", None, None)], DOCS)
    assert langid.fit(none, F.lit(True)) is None
    assert [r.lang_pred for r in langid.predict(none, None, ["doc_id"]).collect()] == ["und"]
    empty = spark.createDataFrame([], DOCS)
    assert langid.keep_identified(empty).count() == 0


def test_keeping_leaves_columns(spark):
    data = [(i, ("the river runs over that hill " if i % 2 else "der fluss und das haus sind alt ") * 3,
             "en" if i % 2 else "de", "clash") for i in range(60)] + [(99, "??", "en", None), (100, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, lang_pred string")
    left = langid.keep_identified(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == list(range(60))
