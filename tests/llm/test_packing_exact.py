import random

import numpy as np
from pyspark.sql import functions as F

from auditlake.llm import op10_packing


def least_padding(lengths, buckets):
    """By the plain programme over distinct lengths."""
    x = sorted(set(lengths))
    n = [lengths.count(v) for v in x]
    cost = lambda i, j: sum(n[t] * (x[j - 1] - x[t]) for t in range(i, j))
    best = [0] + [cost(0, j) for j in range(1, len(x) + 1)]
    for _ in range(buckets - 1):
        best = [0] + [min([best[j]] + [best[i] + cost(i, j) for i in range(1, j)]) for j in range(1, len(x) + 1)]
    return best[-1]


def test_one_long_text_does_not_coarsen(spark):
    """Boundaries stay exactly optimal beside a document far over the budget, which is a batch by itself."""
    r = random.Random(1)
    lengths = [int(r.lognormvariate(4, 1)) + 1 for _ in range(300)]
    over = [1_000_000, 200_000, 70_000]
    rows = spark.createDataFrame(list(enumerate(lengths + over)), "doc_id long, n long")
    for buckets in (5, 2):
        got = op10_packing.pack(rows, length=F.col("n"), buckets=buckets).collect()
        assert sum(x.bucket - x.length for x in got if x.length <= op10_packing.BUDGET) == least_padding(lengths, buckets - 1)
        long = [x for x in got if x.length > op10_packing.BUDGET]
        assert {x.bucket for x in long} == {1_000_000} and len({x.batch for x in long}) == 3 and {x.slot for x in long} == {0}
        assert len({x.bucket for x in got}) <= buckets and len(got) == 303
    one = op10_packing.pack(rows, length=F.col("n"), buckets=1).collect()
    assert {x.bucket for x in one} == {1_000_000} and len(one) == 303


def test_more_distinct_lengths_than_the_grid_had(spark):
    lengths = np.array([1, 2, 9_000, 9_001, 40_000, 40_001])
    assert op10_packing.boundaries(lengths, np.ones(6), 3) == [2, 9_001, 40_001]
    got = op10_packing.pack(spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, n long"), length=F.col("n"), buckets=3).collect()
    assert sorted({x.bucket for x in got}) == [2, 9_001, 40_001]


def test_rows_without_an_id_are_dealt_into_parts(spark, monkeypatch):
    """Rows of one hash fill a range: their places are still each taken once, and every bucket's batches are full but the last."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(op10_packing, "RANGE_ROWS", 50)
    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b c").otherwise("d e").alias("text")).repartition(5)
    rows = op10_packing.pack(docs, buckets=2, budget=30).collect()
    assert len(rows) == 900
    by = {}
    for r in rows:
        by.setdefault(r.bucket, []).append((r.batch, r.slot))
    for bucket, places in by.items():
        fit = 30 // bucket
        assert sorted(places) == [(n // fit, n % fit) for n in range(len(places))]
