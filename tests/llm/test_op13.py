import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import op13_language as op13

LETTERS = op13.plain_table()


def grams(text):
    """The different n-grams of 1 to 3 bytes, without those of two spaces."""
    raw = b" " + b" ".join(bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()).split()) + b" "
    return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1) if b"  " not in raw[i : i + n]}


def number(gram):
    return int.from_bytes(gram, "big") + (0, 0, 256, 65_792)[len(gram)]


@pytest.fixture(scope="module")
def model(spark, sf):
    return op13.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_kernel_is_that_of_the_sets(monkeypatch):
    monkeypatch.setattr(op13, "PIECE", 7)  # n-grams that lie over the edge of a piece count as well
    marks = ["The quick brown fox", "Ünder der Brücke 42", "où est la forêt?", "a"]
    texts = ["the brown bridge", "ÜBER der Brücke", "", "!!", "x" * 50, "forêt " * 20, "一二三"]
    chosen = sorted(set().union(*map(grams, marks)), key=number)
    have = np.array([[g in grams(m) for m in marks] for g in chosen])
    model = {"grams": np.array([number(g) for g in chosen], np.int64), "landmarks": np.packbits(have).tobytes(), "sizes": have.sum(axis=0).astype(float)}
    got = op13.kernel([op13.plain(t, LETTERS) for t in texts], model)
    for i, t in enumerate(texts):
        own = grams(t) & set(chosen)
        for j, m in enumerate(marks):
            assert got[i, j] == pytest.approx(len(own & grams(m)) / (max(len(own), 1) * len(grams(m))) ** 0.5)
    assert [{int(x) for x in op13.gram_set(m, LETTERS)} == {number(g) for g in grams(m)} for m in marks] == [True] * 4


def test_regression_is_that_of_the_features(spark, sf, model):
    """Coefficients from sums over tasks are those of one regression over all rows."""
    rows = op13.sample(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    features = op13.kernel([op13.plain(r.text, LETTERS) for r in rows], model) @ model["root"]
    y = np.array([[1.0 if r.lang == x else -1.0 for x in model["languages"]] for r in rows])
    n = features.shape[1]
    want = np.linalg.solve(features.T @ features + op13.RIDGE * len(rows) * np.eye(n), features.T @ y)
    assert np.allclose(model["coefficients"], want, atol=1e-5)


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op13.op13_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 300 and right / len(got) >= 0.99 and all(0 <= r.score <= 1 for r in got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)


def test_predictions_see_text_alone(spark, sf):
    """Wrong languages, sources and ids of the held-out rows change nothing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = op13.is_held_out(F.col("doc_id"))
    changed = docs.withColumns({"lang": F.when(out, F.lit("xx")).otherwise(F.col("lang")), "source": F.lit("s")})
    one, two = op13.predict(docs, op13.fit(docs)), op13.predict(changed, op13.fit(changed))
    assert sorted(one.collect()) == sorted(two.collect())


def test_sample_is_bounded(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "aa").otherwise("bb").alias("lang"), F.concat(F.lit("text "), F.col("id") % 50).alias("text"))
    rows = rows.union(rows.where("doc_id = 2").crossJoin(spark.range(3000)).drop("id"))  # one row stands 3,000 times
    got = op13.sample(rows, per_lang=70).groupBy("lang").count().collect()
    assert sorted(map(tuple, got)) == [("aa", 70), ("bb", 70)]
    assert [r.lang for r in op13.sample(rows, 70, languages=1).select("lang").distinct().collect()] == ["bb"]


def test_edges(spark, model):
    rows = [(None, "the text of it", "en"), (1, None, "en"), (2, "", None), (3, "1234 !!", "en"), (4, "一", "de"), (4, "一", "de"), (5, "es " * 400_000, "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"held_out": F.lit(1), "n": F.lit("x"), "h": F.lit(0), "rows": F.lit(0)})
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in op13.predict(docs, model).collect()), key=str)
    assert len(got) == 7 and [x[1:] for x in got if x[0] in (1, 2, 3)] == [("und", 0.0)] * 3
    assert all(x[1] in model["languages"] for x in got if x[0] in (None, 4, 5))
    fitted = op13.fit(docs)
    assert set(fitted["languages"]) <= {"en", "de", "es"} and op13.predict(docs, fitted).count() == 7
    none = docs.limit(0)
    assert op13.predict(none, op13.fit(none)).count() == 0
    assert {r.lang_pred for r in op13.predict(docs, op13.fit(none)).collect()} == {"und"}
