import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import op5_lines, op9_mixing, op10_packing

from . import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    r = random.Random(4)
    block = [f"shared line {i} of many words here" for i in range(12)]
    rows = [(5000 + i, "\n".join([f"own {i} {j}" for j in range(r.randrange(5))] + block + [f"end {i}"]), "en", r.choice("ab"), 0) for i in range(60)]
    rows += [(6000, None, None, None, None), (6001, "", "en", None, 0), (6002, "\n\n\n", "en", "z", 3), (6003, "a\nb " * 9000, "en", "z", 1), (6004, "same\nsame\n" * 30, "en", "a", 1)]
    return spark.createDataFrame(rows, SCHEMA).union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"))


def test_line_dedup(spark, docs):
    got = op5_lines.line_dedup(docs.withColumn("no", F.lit(1)).repartition(6))
    assert got.columns == docs.columns + ["no", "_lines", "_chunks"]
    rows = got.collect()
    want = brute.lines([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.text for r in rows} == want
    assert sum(r._chunks for r in rows) > 60
    assert all(r.n_chars == len(r.text) for r in rows if r._chunks)


def test_line_dedup_shift(spark):
    """A passage is found again although other lines stand before it."""
    lines = [f"line {i} {i * i}" for i in range(200)]
    texts = ["\n".join(lines), "\n".join(["new"] + lines), "\n".join(["x", "y", "z"] + lines[3:])]
    got = {r.doc_id: r for r in op5_lines.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]._lines == 0 and min(got[1]._lines, got[2]._lines) > 120


def test_line_dedup_repeats_and_nulls(spark):
    t = "\n".join(f"l {i}" for i in range(50))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.text == t) for r in op5_lines.line_dedup(df).collect())
    assert got == [(0, True), (1, True), (1, True), (2, False), (3, False)]
    assert op5_lines.line_dedup(df.limit(0)).count() == 0


def water(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[n] for n in free)
        over = {n for n in free if level * w[n] >= 2 * sizes[n]}
        if not over:
            out |= {n: level * w[n] for n in free}
            break
        out |= {n: 2.0 * sizes[n] for n in over}
        left -= sum(2 * sizes[n] for n in over)
        free -= over
    return out


def test_mixing(spark, docs):
    rows = op9_mixing.mix(docs).collect()
    again = op9_mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (r.doc_id, r._whole, r._extra)
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == docs.count()
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r._size == len(brute.WORD.findall(r.text or ""))
        sizes[r.source] += r._size
        taken[r.source] += r._whole * r._size + r._extra
        assert 0 <= r._whole * r._size + r._extra <= 2 * r._size
    want = water(sizes)
    for r in rows:
        assert abs(r._target - want[r.source]) < 1e-6 and r._source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    out = op9_mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(brute.WORD.findall(r.text or ""))
    assert words == +taken or all(words[s] == taken[s] for s in sizes)
    assert op9_mixing.mix(docs.limit(0)).count() == 0


def test_boundaries_are_optimal():
    r = random.Random(8)
    for _ in range(30):
        lengths = np.array(sorted(r.sample(range(1, 60), 8)), float)
        counts = np.array([r.randrange(1, 9) for _ in lengths], float)
        cost = lambda b: sum(c * (min(x for x in b if x >= n) - n) for n, c in zip(lengths, counts))
        best = min(cost((*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], 2))
        assert abs(cost(op10_packing.boundaries(lengths, counts, 3)) - best) < 1e-9


def test_packing(spark, docs):
    rows = op10_packing.pack(docs.union(docs.limit(5)), buckets=4, budget=3000).collect()
    assert len(rows) == docs.count() + 5
    batches = defaultdict(list)
    for r in rows:
        assert r.length <= r.bucket
        batches[r.bucket, r.batch].append(r)
    assert len({b for b, _ in batches}) <= 4
    for (b, k), own in batches.items():
        assert len(own) * b <= max(3000, b) and sorted(r.slot for r in own) == list(range(len(own)))
    for b in {b for b, _ in batches}:
        full = max(1, 3000 // b)
        n = sorted(len(own) for (x, _), own in batches.items() if x == b)
        assert all(x == full for x in n[1:])
    assert op10_packing.pack(docs.limit(0)).count() == 0


def test_pipeline_stages_against_brute_force(spark, sf, docs):
    from auditlake.llm.op1_quality import quality_table

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one = corpus_pipeline.quality(spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in quality_table(docs, labels).where("kept").collect()}
    two = corpus_pipeline.lines(spark, one, sf)
    want = {d: t for d, t in brute.lines([(r.doc_id, r.text) for r in one.collect()]).items() if t and t.split()}
    got = {r.doc_id: r.text for r in two.collect()}
    assert got == want
    three = corpus_pipeline.near(spark, two, sf)
    assert {r.doc_id for r in three.collect()} == {d for d, v in brute.components(list(got.items())).items() if v[2]}
    assert one.columns == two.columns == three.columns == docs.columns
    four = corpus_pipeline.mixing(spark, three, sf)
    assert four.columns == docs.columns
    assert corpus_pipeline.packing(spark, four, sf).count() == four.count()
    assert corpus_pipeline.run(spark, sf).count() > 0
