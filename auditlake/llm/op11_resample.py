"""Importance resampling towards a target: a dictionary of distinct features.

Features are runs of 1 to `longest` consecutive words.  One Arrow pass over the texts makes
blocks of documents: the block's own dictionary of distinct features with their counts, and
for each document the places and counts of its features in that dictionary.  Then

* the blocks' dictionaries are summed to one global dictionary of distinct strings (map-side
  sums first, so a frequent word sends one row a block),
* each distinct string is hashed once, by Spark's crc32, and the buckets are aggregated,
* gains of buckets go back to the strings and from there to the places in each block's
  dictionary, by a join on the string that adaptive execution can split, and a block's
  documents read their weights from its gains.

What is shuffled are dictionaries (a row for each string and block) and packed counts, never
a row for each word.  Buckets and their gains are `buckets` rows, broadcast.

The draw: weight plus seeded Gumbel noise, the n highest scores.  Scores are counted in steps
(a bounded number of them), which gives the lowest score that is drawn from; only rows
from there on are ordered, by ranges of (score, doc_id), and a row's rank is the number of
rows in the ranges before plus its place in its own.

Defined results: null or empty text has no features, weight 0 and is not among the documents
that a draw is made of; a null doc_id hashes as no digits and comes after all others; equal
scores go by doc_id, rows that are equal in both have ranks in any order; a repeated row counts
each time; a text of any length is read whole; other columns are not read, whatever their names;
an empty table gives no rows, an empty target gives every bucket t = 0.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, letter_table, slices, small, table, text_bytes

LONGEST, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Scores are counted in steps of so many thousandths, to find from where on rows must be ordered.
STEP = 64
#: Bytes of texts that share a block's dictionary: more of them repeat more words.
BLOCK = 32 << 20
#: Rows that one range of the ranking holds, about.
RANGE_ROWS = 1 << 20


def _runs(words: list[bytes], longest: int) -> list[bytes]:
    out = list(words)
    for n in range(2, longest + 1):
        out += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return out


class _Block:
    """Documents of a few slices: one dictionary for all, and each document's places and counts in it."""

    def __init__(self, row):
        self.row, self.place, self.parts, self.size = row, {}, [], 0

    def add(self, batch: pa.RecordBatch, letters: bytes, longest: int) -> None:
        from collections import Counter

        ids, place, places, counts, sizes, n_words = batch.column("doc_id"), self.place, [], [], [], []
        for text in text_bytes(batch.column("text")):
            words = text.translate(letters).split()
            n_words.append(len(words))
            own = Counter(words if longest == 1 else _runs(words, longest))
            places.extend([place.setdefault(w, len(place)) for w in own])
            counts.extend(own.values())
            sizes.append(len(own))
        null = np.array([not x.is_valid for x in ids], "u1")
        self.parts.append((np.array(ids.fill_null(0), "<i8"), null, np.array(n_words, "<i8"), np.array(sizes, "<i8"), np.array(places, "<u4"), np.array(counts, "<u4")))
        self.size += batch.nbytes

    def packed(self) -> pa.RecordBatch:
        """The block as a row; its packed part is read by `_unpacked`."""
        parts = [np.concatenate(x) for x in zip(*self.parts)]
        at, n = parts[4:]
        total = np.bincount(at, n, len(self.place)).astype(np.int64)
        head = np.array([len(parts[0]), len(at)], "<i8").tobytes()
        docs = zlib.compress(head + b"".join(x.tobytes() for x in parts), 1)
        features = pa.array([list(self.place)], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([self.row, pa.array([docs], pa.binary()), features, pa.array([total], pa.list_(pa.int64()))], ["block", "docs", "features", "counts"])


def _blocks(letters: bytes, longest: int, batches):
    block = None
    for whole in batches:
        for batch in slices(whole):
            block = block or _Block(batch.column("row").slice(0, 1))
            block.add(batch, letters, longest)
            if block.size >= BLOCK:
                yield block.packed()
                block = None
    if block:
        yield block.packed()


def blocks(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """block, docs (packed), features, counts: one row for every BLOCK bytes of texts, as far as a task has them."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_blocks, letter_table(), longest), "block long, docs binary, features array<string>, counts array<long>")


def _unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    raw = zlib.decompress(raw)
    docs, entries = np.frombuffer(raw, "<i8", 2)
    out, at = [], 16
    for kind, n in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<i8", docs), ("<u4", entries), ("<u4", entries)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return tuple(out)


def _weights(batch: pa.RecordBatch) -> pa.RecordBatch:
    parts = []
    for raw, where, value in zip(batch.column("docs"), batch.column("places"), batch.column("gains")):
        ids, null, words, sizes, at, n = _unpacked(raw.as_py())
        gain = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
        if where.is_valid:
            gain[where.values.to_numpy(zero_copy_only=False)] = value.values.to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        total = np.concatenate(([0], np.cumsum(n.astype(np.int64))))[ends]
        sums = np.concatenate(([0], np.cumsum(gain[at] * n)))[ends]
        features, sums = np.diff(total), np.diff(sums)
        weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
        parts.append(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"]))
    return pa.concat_batches(parts) if parts else None


def gains(dictionary: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of the buckets that a string is in.  dictionary: bucket, s, t (counts in the documents and in the target)."""
    sums = dictionary.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    all_ = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    real = lambda c: F.col(c).cast("double")
    odds = (real("t") + 1) * (real("all_s") + buckets) / ((real("s") + 1) * (real("all_t") + buckets))
    return sums.join(F.broadcast(all_)).select("bucket", F.floor(1000 * F.ln(odds)).cast("long").alias("gain"))  # one row


def weighed(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row: the floored mean gain of its features; target: its texts."""
    own = cut(blocks(docs, longest))
    goal = blocks(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), longest)
    none = F.lit(0).cast("long")
    counted = own.select(F.inline(F.arrays_zip("features", "counts"))).select("features", F.col("counts").alias("s"), none.alias("t"))
    wanted = goal.select(F.inline(F.arrays_zip("features", "counts"))).select("features", none.alias("s"), F.col("counts").alias("t"))
    strings = counted.unionByName(wanted).groupBy(F.col("features").alias("feature")).agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    strings = cut(strings.withColumn("bucket", (F.crc32(F.encode("feature", "UTF-8")) % buckets).cast("int")))
    gain = small(cut(gains(strings, buckets)), buckets)
    known = strings.where("s > 0").join(gain, "bucket").select("feature", "gain")
    places = own.select("block", F.posexplode("features").alias("place", "feature")).join(known, "feature")
    places = places.groupBy("block").agg(F.collect_list(F.struct("place", "gain")).alias("found")).select("block", F.col("found.place").alias("places"), F.col("found.gain").alias("gains"))
    joined = own.select("block", "docs").join(places, "block", "left").select("docs", "places", "gains")
    return arrow_map(joined, _weights, "doc_id long, n_words long, n_features long, weight long")


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """weights with column score: weight plus Gumbel noise from the digits of a hash of seed and doc_id, in whole thousandths."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return weights.withColumn("score", F.col("weight") + noise)


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (cut; doc_id, n_words, score) with column rank: 1, 2, 3 ... for the highest scores of the rows with enough words, null for the rest."""
    fit = F.col("n_words") >= least_words
    by_score = rows.where(fit).groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("step"))  # gains and noise are within some 100,000 of each other, so there are at most about 1,600 steps
    many = by_score.agg(F.floor(F.sum("n") * percent / 100).cast("long")).first()[0] or 0
    last = by_score.withColumn("so_far", F.sum("n").over(down)).where(F.col("so_far") >= many).agg(F.max("step")).first()[0]
    none = F.lit(None).cast("long")
    if not many:
        return rows.withColumn("rank", none)
    high = fit & (F.col("score") >= last * STEP)
    ranges = max(1, -(-many // RANGE_ROWS))
    ordered = [F.desc("score"), F.asc_nulls_last("doc_id"), "_row"]
    top = rows.where(high).withColumn("_row", F.monotonically_increasing_id())
    top = top.repartitionByRange(ranges, *ordered).sortWithinPartitions(*ordered).drop("_row")
    top = cut(top.withColumn("_at", F.monotonically_increasing_id()))  # the partition's number, then the row's place in it
    part = F.shiftright("_at", 33)
    sizes = top.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # one row for each range
    place = F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part"), 33) + 1
    ranked = top.withColumn("_part", part).join(small(before), "_part").withColumn("rank", F.when(place <= many, place)).drop("_part", "_before", "_at")
    return ranked.unionByName(rows.where(F.coalesce(~high, F.lit(True))).withColumn("rank", none))


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row; see the module."""
    return drawn(cut(scored(weighed(docs, target, longest, buckets), seed)), percent, least_words)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH tab AS (SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc FROM (SELECT unnest(range(256)) AS n)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT unnest({_WORDS}) AS f FROM benchmark),
x AS MATERIALIZED (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(w) AS f FROM d) GROUP BY r, f),
s AS (SELECT f, CAST(sum(s) AS BIGINT) AS s, CAST(sum(t) AS BIGINT) AS t FROM (SELECT f, n AS s, 0 AS t FROM x UNION ALL SELECT f, 0, 1 FROM b) GROUP BY f),
g AS MATERIALIZED (SELECT s.*, xor(list_reduce([4294967295] || list_transform(range(CAST(length(hex(encode(f))) / 2 AS BIGINT)), lambda i: CAST('0x' || substring(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)), lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM s, tab),
k AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM g GROUP BY bucket),
v AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT CAST(sum(s) AS DOUBLE) FROM k) + {BUCKETS}) / ((CAST(s AS DOUBLE) + 1) * ((SELECT CAST(sum(t) AS DOUBLE) FROM k) + {BUCKETS})))) AS BIGINT) AS gain FROM k),
m AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS total FROM x JOIN g ON g.f = x.f JOIN v ON v.bucket = g.bucket GROUP BY r),
q AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END AS weight, CAST('0x' || substring(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m ON m.r = d.r),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM q),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= ({PERCENT} * n) // 100 THEN rank END AS rank FROM z LEFT JOIN p ON p.r = z.r"""
