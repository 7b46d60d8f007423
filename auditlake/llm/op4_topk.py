"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into norm buckets (quantiles of the squared length; a bucket
with more vectors than a block holds, as of many equal vectors, is split by a hash of the
id).  Queries form blocks too.  Every query block first meets the block of the longest
vectors, which gives each query a threshold: its k-th best score so far.  A block is then
met only by query blocks for which it is long enough (its bucket first, then the block), and
travels once to a task, which the queries that meet it stream through; inside it each query uses the
local cosine threshold  score / (|q| * longest)  : above 1 the bucket is passed over; else
the candidates are a prefix by length, or, where that is shorter, the feasible region of
the query's largest coordinate in a sorted list.  All surviving products are computed
exactly in integers (in doubles while they stay below 2**53).

A bucket's threshold only grows, bounds are widened by 1e-9 against rounding, and equal
scores are kept, so the result is exact, ties to smaller ids.  The query set is a stated
share of the rows and meets them in blocks.

Defined results: vectors that are null, hold null or non-finite components or have no id take
no part; vectors of another dimension are searched among themselves, as a product of two
dimensions is not defined; a query never gets rows of its own id; repeated rows of an id are
candidates each; with fewer candidates all come; other columns are not read, whatever their names;
no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BLOCK, QUERIES, BUCKETS = 4096, 256, 256


def integer_vectors(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v (floor(scale * x), array<long>), n2 (squared length) of the vectors that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    out = rows.where("vec_id is not null").where(x.isNotNull() & fine)
    out = out.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(scale * e.cast("double"))).alias("v"))
    return out.withColumn("n2", F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e))


def _pack(columns: list[str]):
    """Rows of a block as one row: ids and matrix as bytes, longest first."""

    def pack(rows: pa.Table) -> pa.Table:
        n2 = rows.column("n2").to_numpy()
        ids = rows.column("vec_id").to_numpy()
        order = np.lexsort((ids, -n2))
        flat = rows.column("v").combine_chunks().flatten().to_numpy()
        flat = flat.reshape(len(ids), len(flat) // len(ids))[order]
        most = int(np.abs(flat).max(initial=0))
        kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int64()), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "kind": [kind], "m": pa.array([flat.astype(kind).tobytes()], pa.binary()), "longest": pa.array([float(np.sqrt(float(n2.max())))])})

    return pack


PACKED = "block long, ids binary, kind string, m binary, longest double"


class _Block:
    def __init__(self, ids: bytes, kind: str, m: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        flat = np.frombuffer(m, kind)
        self.m = flat.reshape(len(self.ids), len(flat) // max(1, len(self.ids)))
        self.f = self.m.astype(np.float64)
        self.norm = np.sqrt((self.f * self.f).sum(axis=1))
        self.most = float(np.abs(self.f).max(initial=0))
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_by(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of a coordinate of the unit vectors, ascending, and their places."""
        if c not in self.lists:
            unit = self.f[:, c] / np.maximum(self.norm, 1e-300)
            order = np.argsort(unit, kind="stable")
            self.lists[c] = unit[order], order
        return self.lists[c]

    def scores(self, q: np.ndarray, at) -> np.ndarray:
        if self.most * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2**53:
            return (self.f[at] @ q.astype(np.float64)).astype(np.int64)
        return self.m[at].astype(np.int64) @ q.astype(np.int64)

    def search(self, q: np.ndarray, length: float, own: int, least: float, k: int) -> list[tuple[int, int]]:
        """The best k (score, id) of the block with a score of least or more."""
        longest = self.norm[0] if len(self.norm) else 0.0
        if least > 0 and length > 0:
            cosine = least / (length * max(longest, 1e-300))
            if cosine > 1 + 1e-9:
                return []
            prefix = int(np.searchsorted(-self.norm, -(least / length) * (1 - 1e-9), "right"))
            at: slice | np.ndarray = slice(0, prefix)
            c = int(np.abs(q).argmax())
            x, t = q[c] / length, min(1.0, cosine)
            spread = np.sqrt(max(0.0, 1 - x * x) * max(0.0, 1 - t * t))
            low = -1.0 if -x >= t else x * t - spread
            high = 1.0 if x >= t else x * t + spread
            values, places = self.sorted_by(c)
            a, b = np.searchsorted(values, low - 1e-9), np.searchsorted(values, high + 1e-9, "right")
            if b - a < prefix // 2:
                at = places[a:b]
                at = at[at < prefix]
        else:
            at = slice(0, len(self.ids))
        s, ids = self.scores(q, at), self.ids[at]
        ok = (ids != own) & (s >= least)
        s, ids = s[ok], ids[ok]
        if len(s) > 4 * k:
            cut_at = np.partition(s, len(s) - k)[len(s) - k]
            s, ids = s[s >= cut_at], ids[s >= cut_at]
        order = np.lexsort((ids, -s))[:k]
        return list(zip(s[order].tolist(), ids[order].tolist()))


def _search(k: int):
    """Rows come by (block, salt): the block itself (who 0), then the query blocks that meet it, one after another."""

    def run(batches):
        block = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                ids, kind, m, least = (batch.column(c)[i].as_py() for c in ("ids", "kind", "m", "least"))
                if batch.column("who")[i].as_py() == 0:
                    block = _Block(ids, kind, m)
                    continue
                queries = _Block(ids, kind, m)
                least = np.frombuffer(least, "<f8") if least else np.full(len(queries.ids), -np.inf)
                for j in range(len(queries.ids)):
                    out += [(int(queries.ids[j]), v, s) for s, v in block.search(queries.m[j].astype(np.int64), queries.norm[j], queries.ids[j], least[j], k)]
            q, v, s = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def _met(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, k: int, salts: int) -> DataFrame:
    """query_id, vec_id, score of the query blocks (asked: q_block, q_ids, q_kind, q_m, least) in the blocks that pairs (q_block, block) has them meet.

    A block that most queries meet is sent to `salts` tasks at most, each for its share of the queries.
    """
    pairs = pairs.withColumn("salt", F.pmod("q_block", F.lit(salts)))
    data = ("ids", "kind", "m")
    own = pairs.select("block", "salt").distinct().join(blocks, "block").select("block", "salt", F.lit(0).alias("who"), *data, F.lit(None).cast("binary").alias("least"))
    theirs = pairs.join(asked, "q_block").select("block", "salt", F.lit(1).alias("who"), *(F.col(f"q_{c}").alias(c) for c in data), "least")
    rows = own.unionByName(theirs).repartition("block", "salt").sortWithinPartitions("block", "salt", "who")
    return rows.mapInArrow(_search(k), "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _least(k: int):
    """The threshold of every query of a block, in the block's order, and the length a bucket must have to matter."""

    def run(rows: pa.Table) -> pa.Table:
        r = rows.slice(0, 1).to_pylist()[0]
        block = _Block(r["q_ids"], r["q_kind"], r["q_m"])
        known = {q: s for q, s in zip(rows.column("query_id").to_pylist(), rows.column("score").to_pylist()) if q is not None}
        least = np.array([known.get(q, -np.inf) for q in block.ids.tolist()], "<f8")
        need = np.where(least > 0, least / np.maximum(block.norm, 1e-300), 0.0).min(initial=np.inf)
        return pa.table({"q_block": pa.array([r["q_block"]], pa.int64()), "q_ids": pa.array([r["q_ids"]], pa.binary()), "q_kind": [r["q_kind"]], "q_m": pa.array([r["q_m"]], pa.binary()), "least": pa.array([least.tobytes()], pa.binary()), "need": pa.array([float(need) * (1 - 1e-9)])})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query; vectors as of integer_vectors."""
    sizes = sorted(r[0] for r in vectors.select(F.size("v")).distinct().collect())  # one, or the few that models have
    out = None
    for d in sizes:
        found = _top_k(vectors.where(F.size("v") == d) if len(sizes) > 1 else vectors, is_query, k)
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def _top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    vectors = cut(vectors)
    n = vectors.count()
    levels = min(BUCKETS, max(1, n // BLOCK))
    bounds = sorted(set(vectors.approxQuantile("n2", [i / levels for i in range(1, levels)], 0.2 / levels))) if levels > 1 else []
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("n2"))) if bounds else F.lit(0)  # 0: the longest
    vectors = vectors.withColumn("bucket", bucket)
    counts = dict(vectors.groupBy("bucket").count().collect())  # BUCKETS rows at most
    first, splits, at = {}, {}, 0
    for b in range(len(bounds) + 1):
        first[b], splits[b] = at, max(1, -(-counts.get(b, 0) // BLOCK))
        at += splits[b]
    starts = F.array(*(F.lit(first[b]) for b in range(len(bounds) + 1)))
    of = lambda x: F.get(F.array(*(F.lit(x[b]) for b in range(len(bounds) + 1))), F.col("bucket"))
    block = (of(first) + F.pmod(F.xxhash64("vec_id"), of(splits))).cast("long")
    pack = _pack([])
    blocks = vectors.withColumn("block", block).groupBy("block").applyInArrow(lambda rows: pack(rows), PACKED)
    blocks = cut(blocks.withColumn("bucket", F.size(F.filter(starts, lambda x: x <= F.col("block"))) - 1))
    asked = vectors.where(is_query)
    n_q = max(1, -(-asked.count() // QUERIES))
    salts = max(1, n_q // 64)
    asked = asked.dropDuplicates(["vec_id"]).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(n_q)))
    asked = asked.groupBy("block").applyInArrow(lambda rows: pack(rows), PACKED)
    asked = cut(asked.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("m").alias("q_m")))
    least = _least(k)
    early = _best(_met(asked.select("q_block", (F.col("q_block") * 0).alias("block")), asked.withColumn("least", F.lit(None).cast("binary")), blocks, k, salts), k)
    early = early.where(F.col("rank") == k).select(F.pmod(F.xxhash64(F.lit(1), "query_id"), F.lit(n_q)).alias("q_block"), "query_id", "score")
    ready = cut(asked.join(early, "q_block", "left").groupBy("q_block").applyInArrow(lambda rows: least(rows), "q_block long, q_ids binary, q_kind string, q_m binary, least binary, need double"))
    # which query block meets which block is settled by numbers: the buckets long enough first, then the blocks in these
    lengths = blocks.select("block", "bucket", "longest")
    long_ones = lengths.groupBy("bucket").agg(F.max("longest").alias("reach"))
    reach = long_ones.agg(F.collect_list(F.struct("bucket", "reach")).alias("all"))  # one row of BUCKETS numbers
    pairs = ready.select("q_block", "need").join(F.broadcast(reach)).select("q_block", "need", F.explode(F.filter("all", lambda x: x["reach"] >= F.col("need"))["bucket"]).alias("bucket"))
    pairs = pairs.join(lengths, "bucket").where("longest >= need").select("q_block", "block")
    return _best(_met(pairs, ready.drop("need"), blocks, k, salts), k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
