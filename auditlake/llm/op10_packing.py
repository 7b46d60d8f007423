"""Packing into optimal length buckets.

The global histogram of lengths (one aggregation) goes to a dynamic programme that chooses
the bucket boundaries with the least padding, exactly: it runs on the distinct lengths up to
the budget, at most so many rows whatever the input, as a lower hull of lines.  A document
longer than the budget is a batch by itself, which pads nothing; all of these share one of
the buckets, named by the longest, and stay out of the histogram.  Inside a bucket, documents in
seeded order are cut into batches of budget // boundary rows: the rank is a count over
65,536 hash ranges plus the place inside a range, so a bucket that holds a third of all rows
is not sorted in one task, and only the last batch of a bucket can be short.  Rows of one id and
length (all that have no id, say) have one hash; where they fill a range, it is dealt into parts.

Length: number of words (or any column).  Defined results: null text has length 0 and sits
in the first bucket; a null doc_id is as good as another; equal and repeated rows each get a
place (rows of equal hash and doc_id are alike but for their place); a text longer than the
budget is a batch by itself; other columns are not read, whatever their names.  No rows give
no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small, table, word_count

BUCKETS, BUDGET, SEED = 16, 65_536, 77
#: Rows of one range of hashes that are put in order together; a range with more has rows of equal hash, and is dealt into parts.
RANGE_ROWS = 1 << 19


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most so many buckets with the least sum of counts * (bound - length); lengths ascend."""
    m = len(lengths)
    if not m or buckets < 1:
        return []
    size, total = [int(x) for x in lengths], [0]
    for c in counts:
        total.append(total[-1] + int(c))
    # best[j]: least padded words of the first j lengths; a last bucket i..j costs size[j-1] * (total[j] - total[i]),
    # so for each j the best i has the lowest of the lines best[i] - total[i] * x at x = size[j-1].  Slopes fall with
    # i and x rises with j: the lines wait in a hull whose front only moves on.  Whole numbers, so nothing is rounded.
    best = [0] + [x * t for x, t in zip(size, total[1:])]
    cuts = []
    for _ in range(min(buckets, m) - 1):
        new, at, hull, front = best[:], [-1] * (m + 1), [], 0
        for j in range(1, m + 1):
            k = j - 1
            while len(hull) - front > 1:
                a, b = hull[-2], hull[-1]
                if (best[b] - best[a]) * (total[k] - total[b]) < (best[k] - best[b]) * (total[b] - total[a]):
                    break
                hull.pop()
            hull.append(k)
            x = size[k]
            while front + 1 < len(hull) and best[hull[front + 1]] - total[hull[front + 1]] * x <= best[hull[front]] - total[hull[front]] * x:
                front += 1
            i = hull[front]
            cost = best[i] + x * (total[j] - total[i])
            if cost < new[j]:
                new[j], at[j] = cost, i
        cuts.append(at)
        best = new
    out, j = [], m
    for at in reversed(cuts):
        if at[j] >= 0:
            out.append(int(lengths[j - 1]))
            j = at[j]
    if j:
        out.append(int(lengths[j - 1]))
    return out[::-1]


def pack(docs: DataFrame, length=None, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """doc_id, length, bucket (its boundary), batch (number in the bucket), slot of every row; see the module."""
    rows = docs.select("doc_id", (word_count(F.col("text")) if length is None else length.cast("long")).alias("length"))
    rows = rows.withColumn("length", F.coalesce("length", F.lit(0).cast("long"))).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "length"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    up = F.greatest(F.lit(1).cast("long"), F.col("length"))
    longest = rows.agg(F.max(up)).first()[0]
    if longest is None:
        return rows.select("doc_id", "length", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"))
    over = [longest] if longest > budget else []
    histogram = sorted((r[0], r[1]) for r in rows.where(up <= budget).groupBy(up.alias("up")).count().collect())
    bounds = boundaries(np.array([h[0] for h in histogram], np.int64), np.array([h[1] for h in histogram], np.int64), buckets - len(over)) + over
    bucket = F.element_at(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b >= up), 1)
    rows = rows.withColumn("bucket", bucket).withColumn("range", F.shiftright("h", 48).cast("int"))
    # as many rows of one id and length as a range should hold at most are dealt out by their place in the input
    full = rows.groupBy("bucket", "range").agg(F.count("*").alias("n")).where(F.col("n") > RANGE_ROWS).select("bucket", "range", F.ceil(F.col("n") / RANGE_ROWS).cast("int").alias("parts"))
    rows = rows.join(small(cut(full)), ["bucket", "range"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int"))
    counts = rows.groupBy("bucket", "range", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("bucket").orderBy("range", "part")) - F.col("n")).drop("n")
    ranked = rows.join(before, ["bucket", "range", "part"]).withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("bucket", "range", "part").orderBy("h", "doc_id")) - 1)
    fit = F.greatest(F.lit(1).cast("long"), F.expr(f"{int(budget)} div bucket"))
    return ranked.withColumn("fit", fit).select("doc_id", "length", "bucket", F.expr("place div fit").alias("batch"), F.expr("place % fit").alias("slot"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
