import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import common, op2_neardup, op8_substring
from auditlake.llm.components import connected_components

from . import brute


def near_family(n, seed, words=60, edits=6):
    """n variants of one text, each with some words replaced: many links, not all pairs linked."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for i in r.sample(range(words), r.randrange(edits)):
            w[i] = f"x{r.randrange(10**6)}"
        yield " ".join(w)


@pytest.fixture(scope="module")
def rows(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    odd = [None, "", " \n", "one", "One", "one two", "ONE\ttwo", "a a a a", "a b c", "É é", "é É"]
    more = odd + list(near_family(150, 1)) + list(near_family(60, 2, 30, 4)) + [docs[3][1]] * 40 + ["x y z " * 4000]
    random.Random(5).shuffle(more)
    return docs + [(10_000 + i, t) for i, t in enumerate(more)]


def test_near_duplicates(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bands", F.lit("clash")).repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op2_neardup.near_duplicates(df).collect()}
    assert got == brute.components(rows)


def test_substring(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in op8_substring.substring_dedup(df).collect()}
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in got.items()} == brute.substring(rows)


def test_substring_alignments(spark):
    """A 13-word passage at every offset modulo the block size, in either order of documents."""
    r = random.Random(3)
    passage = [f"p{i}" for i in range(13)]
    texts = [" ".join([f"r{r.randrange(10**9)}" for _ in range(k)] + passage + [f"r{r.randrange(10**9)}" for _ in range(9)]) for k in range(16)]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(-5, " ".join(passage[:12])), (-4, " ".join(passage[1:]))]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in op8_substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.substring(rows)
    assert sum(v[1] for v in got.values()) == 13 * 15


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (None, "lonely words here"), (2, None)], "doc_id long, text string")
    got = op2_neardup.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert op2_neardup.near_duplicates(df.limit(0)).count() == 0
    long = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (7, long)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in op8_substring.substring_dedup(df).collect()) == [(0, 20), (1, 0), (1, 0), (7, 20)]
    assert op8_substring.substring_dedup(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 300), (200, 301), (50, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 50, 300: 50, 301: 50, 50: 50}


def test_word_hashes_follow_words():
    texts = ["a bb\tccc", "", " é x ", "bb a", "A BB"]
    h, at = common.word_hashes([t.encode() for t in texts])
    assert list(np.diff(at)) == [3, 0, 1, 2, 2]
    assert h[0] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 6
    low, _ = common.word_hashes([t.encode() for t in texts], lower=True)
    assert low[6] == low[0] and low[7] == low[1]
