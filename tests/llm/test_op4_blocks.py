import random

import pytest
from pyspark.sql import functions as F

from auditlake.llm import op4_topk


def brute(rows, k):
    out = []
    for q, v in rows:
        if q % 3 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block, queries", [(4096, 256), (16, 4), (5, 1)])
def test_blocks_salts_and_dimensions(spark, monkeypatch, block, queries):
    """Small blocks, so that query blocks are shared out over salts and buckets are passed over; vectors of three dimensions, one of them 0."""
    monkeypatch.setattr(op4_topk, "BLOCK", block)
    monkeypatch.setattr(op4_topk, "QUERIES", queries)
    r = random.Random(block)
    d = lambda i: 3 if i % 29 == 0 else 0 if i % 97 == 5 else 6
    rows = [(i, [r.randint(-9, 9) * (30 if i % 11 == 0 else 1) for _ in range(d(i))]) for i in range(420)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("n2", F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e)).withColumns({"bucket": F.lit("clash"), "block": F.lit(1)})
    got = op4_topk.top_k(df.select("vec_id", "v", "n2"), F.col("vec_id") % 3 == 0, 4)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert op4_topk.top_k(op4_topk.integer_vectors(none), F.col("vec_id") % 3 == 0, 4).count() == 0
