import math
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from auditlake.llm import op11_resample, op12_search

DOCS = [
    (5, "The cat sat on the mat. " * 8),
    (6, "the dog DOG dog barks at the cat " * 7),
    (7, None),
    (8, ""),
    (9, "... -- !!"),
    (10, "Ünder über été 42 cats " * 11),
    (11, "the cat sat on the mat. " * 8),
    (11, "the cat sat on the mat. " * 8),
    (12, "rare words only here " + "x" * 5000),
    (None, "the dog barks " * 20),
    (None, "the dog barks " * 20),
    (40_000, "the mat the cat the dog " * 6),
    (-3, "mat mat mat cat " * 9),
]
ITEMS = [(1, "Cat mat?"), (2, "dog dog barks"), (3, None), (4, "!!"), (5, "ÜNDER under über zebra"), (1, "Cat mat?"), (None, "rare rare")]


def words(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))]


def frame(spark, rows, first):
    return spark.createDataFrame(rows, f"{first} long, text string").withColumns({c: F.lit("clash") for c in ("features", "block", "row", "window", "score", "rank")})


def runs(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def by_hand(docs, target, longest, buckets, seed, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in runs(text, longest):
            s[bucket(f)] += 1
    for _, text in target:
        for f in runs(text, longest):
            t[bucket(f)] += 1
    gain = lambda f: math.floor(1000 * math.log((t[bucket(f)] + 1) * (sum(s) + buckets) / ((s[bucket(f)] + 1) * (sum(t) + buckets))))
    rows = []
    for i, text in docs:
        own = runs(text, longest)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(fit):
        r.append(n + 1 if n < percent * len(fit) // 100 else None)
    return sorted((tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in rows), key=str)


@pytest.mark.parametrize("longest, percent, least", [(1, 10, 20), (2, 50, 3), (3, 100, 1), (1, 5, 20)])
def test_resampled(spark, longest, percent, least):
    docs, items = frame(spark, DOCS, "doc_id").repartition(5), frame(spark, ITEMS, "item_id")
    got = op11_resample.resampled(docs, items, longest=longest, buckets=97, seed=7, percent=percent, least_words=least)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == by_hand(DOCS, ITEMS, longest, 97, 7, percent, least)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(op11_resample, "RANGE_ROWS", 7)
    rows = op11_resample.cut(spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(30).alias("n_words"), (F.col("id") % 9 * 100).alias("score")))
    got = [r.doc_id for r in op11_resample.drawn(rows, percent=20).where("rank is not null").orderBy("rank").collect()]
    assert got == sorted(range(1000), key=lambda i: (-(i % 9), i))[:200]
    assert [r.rank for r in op11_resample.drawn(rows, percent=20).where("rank is not null").orderBy("rank").collect()] == list(range(1, 201))


def ranked(docs, items, most):
    from collections import Counter

    terms = [(i, Counter(words(text))) for i, text in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, n_all = len(terms), sum(sum(c.values()) for _, c in terms)
    out = []
    for item, text in items:
        own = set(words(text))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in terms) + 1))) for t in own}
        rows = [(-sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * sum(c.values()) * n_docs // n_all))) for t in own), i is None, i) for i, c in terms]
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted((r for r in rows if r[0] < 0), key=lambda r: (r[0], r[1], r[2] or 0))[:most])]
    return sorted(out, key=str)


@pytest.mark.parametrize("window, most, parts", [(8192, 10, 3), (2, 3, 1), (1, 2, 6), (65536, 1, 2)])
def test_search(spark, window, most, parts):
    docs, items = frame(spark, DOCS, "doc_id").repartition(parts), frame(spark, ITEMS, "item_id")
    assert sorted((tuple(r) for r in op12_search.search(docs, items, most, window).collect()), key=str) == ranked(DOCS, ITEMS, most)


def test_search_in_blocks_of_queries(spark):
    docs, items = frame(spark, DOCS, "doc_id"), frame(spark, ITEMS + [(100 + i, "cat mat " + "y" * 400_000) for i in range(8)], "item_id")
    got = sorted((tuple(r) for r in op12_search.search(docs, items, 4, block_mb=1).collect()), key=str)
    assert got == ranked(DOCS, ITEMS + [(100 + i, "cat mat") for i in range(8)], 4)


def test_empty_tables(spark):
    none, docs, items = frame(spark, [], "doc_id"), frame(spark, DOCS, "doc_id"), frame(spark, ITEMS, "item_id")
    assert op12_search.search(none, items).count() == 0 and op12_search.search(docs, items.limit(0)).count() == 0
    assert op11_resample.resampled(none, items).count() == 0
    assert {r.weight for r in op11_resample.resampled(docs, items.limit(0), percent=50).where("n_features = 0").collect()} == {0}
