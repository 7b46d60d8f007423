"""Columns of documents with the names that operators use inside, in every operator and in the pipeline, and empty tables."""

import pytest
from pyspark.sql import functions as F

from auditlake.llm import op1_quality, op2_neardup, op3_pii, op5_lines, op6_tokens, op7_secrets, op8_substring, op9_mixing, op10_packing

corpus_pipeline = pytest.importorskip("corpus_pipeline")
NAMES = (
    "_doc _t _id _real _ask _gone _lines _chunks _f _l _h _s _r _size _range _part _text _whole _extra _target _source_size n_words n_words__q n_symbols word_chars n_lines n_dup_lines n_repeat_words base_failed kept stratum _stratum quality good"
    " whole more upto need n up h length bucket range before place fit batch slot digest bands signature rep component node key part chunk base level spans file at n_ids first label col value"
).split()


@pytest.fixture(scope="module")
def docs(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (None, "a b\nc d\ne f " * 20, "en", "s", 3), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "w " * 3000, "en", None, 6000), (10**6 + 2, "w " * 3000, "en", None, 6000)], base.select("doc_id", "text", "lang", "source", "n_chars").schema)
    every = base.select("doc_id", "text", "lang", "source", "n_chars").union(odd)
    return every.select("*", *(F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for n in NAMES)).cache()


def test_columns_pass_through(spark, sf, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf}/labels.parquet").union(spark.createDataFrame([(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int"))
    for f in (lambda d: op1_quality.quality_filter(d, labels), op5_lines.line_filter, op9_mixing.mixed_documents, lambda d: corpus_pipeline.near(spark, d, sf)):
        got = f(docs)
        assert got.columns == docs.columns
        rows, want = got.collect(), f(plain).collect()
        assert sorted((r.doc_id or -1, r.text or "", r.n_chars or 0) for r in rows) == sorted((r.doc_id or -1, r.text or "", r.n_chars or 0) for r in want)
        assert all(r[n] == f"{n}-{'' if r.doc_id is None else r.doc_id}" for r in rows for n in NAMES)
    got = op5_lines.line_dedup(docs)
    assert got.columns == [c for c in docs.columns if c not in ("_lines", "_chunks")] + ["_lines", "_chunks"] and got.schema["_lines"].dataType.simpleString() == "bigint"
    assert op9_mixing.mix(docs).columns == [c for c in docs.columns if c not in op9_mixing.OUT] + list(op9_mixing.OUT)


def test_columns_are_left_alone(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text")
    for f in (op2_neardup.near_duplicates, op3_pii.personal_data, op8_substring.substring_dedup, op10_packing.pack):
        assert sorted(map(str, f(docs).collect())) == sorted(map(str, f(plain).collect()))
    assert op7_secrets.secret_spans(docs).count() == docs.count()
    op6_tokens.write_tokens(docs, str(tmp_path / "t"))
    assert op6_tokens.read_tokens(spark, str(tmp_path / "t")).count() == docs.count()


def test_run_of_an_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
