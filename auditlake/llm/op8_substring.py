"""Substring dedup by fixed-block anchors.

A window is WINDOW consecutive words of one document.  A word goes when a window covers it
whose word sequence also starts in a document with a smaller doc_id.

Each document is cut into non-overlapping reference blocks of BLOCK = 7 words.  A shared
passage of 13 words contains a whole block of the reference document (13 >= 2 * 7 - 1), so
probing the block index with every rolling 7-word window meets every shared passage.

* `chunk` = hash of doc_id and text; texts are shuffled to their chunks once, and every later pass
  reads that same exchange.
* Pass 1: each chunk sends to each hash bucket the sorted distinct 32-bit remainders of its
  rolling window hashes, with bits that tell which are blocks and which occur twice.  The
  bucket answers with one bit for each: it is a block somewhere and occurs twice or more.
  A few bytes a word are moved, as packed arrays, and a frequent window counts once a chunk.
* Pass 2: chunks extend the hits.  A WINDOW-word window can be a repeat only if all its
  rolling windows occur twice and one of them hits a block; those candidates go out by their
  96-bit hash with their smallest doc_id in the chunk, and the bucket answers with the
  smallest doc_id of all.  Unions of the repeated windows are the maximal repeats.
* Pass 3: each chunk drops the covered words.

Nothing is broadcast or collected.  A chunk is about 4 MB as stored, whatever the keys are,
and a bucket holds distinct hashes of each chunk, so hot passages stay small.

Defined results: null text has no words; documents under 13 words lose nothing; rows of one
doc_id are one document for the comparison (they do not remove each other) and each gets a
row; a null doc_id counts as larger than every other and is not a reference for any.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, chunks_for, rolling, table, text_bytes, word_hashes

WINDOW, BLOCK = 13, 7
_NONE = np.iinfo(np.int64).max


def _planes(x: np.ndarray) -> bytes:
    """The bytes of sorted differences, all highest first: the high planes are mostly zero and shrink in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T[::-1]).tobytes()


def _flat(x: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1)[::-1].T).view(kind).reshape(-1)


class _Chunk:
    """The documents of a chunk in a fixed order, their word hashes and rolling windows."""

    def __init__(self, rows: pa.Table, buckets: int):
        ids = rows.column("doc_id").to_numpy(zero_copy_only=False) if rows.column("doc_id").null_count == 0 else np.array([_NONE if x is None else x for x in rows.column("doc_id").to_pylist()], np.int64)
        texts = text_bytes(rows.column("text"))
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.null = {i for i, x in enumerate(rows.column("doc_id").to_pylist()) if x is None} if rows.column("doc_id").null_count else set()
        self.rows = order
        self.ids, self.texts, self.buckets = np.asarray(ids, np.int64)[order], [texts[i] for i in order], buckets
        self.words, self.at = word_hashes(self.texts)

    def starts(self, k: int) -> np.ndarray:
        """Where windows of k words begin that lie in one document."""
        ok = np.ones(max(0, len(self.words) - k + 1), bool)
        for end in self.at[1:]:
            ok[max(0, end - k + 1) : end] = False
        return np.flatnonzero(ok)

    def probes(self):
        """(distinct hash, its bucket order), inverse of every rolling window, and the flags."""
        at = self.starts(BLOCK)
        keys = rolling(self.words, BLOCK)[at]
        found, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        owner = np.searchsorted(self.at, at, "right") - 1
        block = np.zeros(len(found), bool)
        block[inverse[(at - self.at[owner]) % BLOCK == 0]] = True
        return at, found, inverse, counts > 1, block

    def edges(self, found: np.ndarray) -> np.ndarray:
        """Cuts of sorted hashes by bucket: buckets are equal ranges of the hash space."""
        step = (1 << 64) // self.buckets + 1
        return np.searchsorted(found, np.array([min(i * step, 2**64 - 1) for i in range(1, self.buckets)], U64))


def _low(found: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """32-bit remainders of hashes in a bucket's range, in the same order."""
    step = (1 << 64) // buckets + 1
    bits = max(0, step.bit_length() - 32)
    return ((found - U64(bucket * step)) >> U64(bits)).astype(np.uint32)


def _ask(buckets: int, key, rows: pa.Table) -> pa.Table:
    c = _Chunk(rows, buckets)
    _, found, _, twice, block = c.probes()
    out = []
    for b, (x, y) in enumerate(zip(np.r_[0, e := c.edges(found)], np.r_[e, len(found)])):
        if y > x:
            low = _low(found[x:y], b, buckets)
            out.append((key[0].as_py(), b, _planes(np.diff(low, prepend=np.uint32(0))), np.packbits(twice[x:y]).tobytes(), np.packbits(block[x:y]).tobytes()))
    return _table(out, _ASK)


def _answer(key, rows: pa.Table) -> pa.Table:
    lows = [np.cumsum(_flat(x, np.uint32), dtype=np.uint32) for x in rows.column("low").to_pylist()]
    flags = {c: [np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)).astype(bool) for x, y in zip(rows.column(c).to_pylist(), lows)] for c in ("twice", "block")}
    every = np.concatenate(lows)
    found, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    counts[inverse[np.concatenate(flags["twice"])]] += 1
    block = np.zeros(len(found), bool)
    block[inverse[np.concatenate(flags["block"])]] = True
    again, at = counts > 1, 0
    out = []
    for chunk, low in zip(rows.column("chunk").to_pylist(), lows):
        mine = inverse[at : at + len(low)]
        at += len(low)
        if again[mine].any():
            out.append((chunk, key[0].as_py(), np.packbits(again[mine]).tobytes(), np.packbits(again[mine] & block[mine]).tobytes()))
    return _table(out, _ANSWER)


def _candidates(c: _Chunk, answers: pa.Table):
    """Windows of WINDOW words that may be repeats: starts, two hashes."""
    at, found, inverse, _, _ = c.probes()
    again, hit = np.zeros(len(found), bool), np.zeros(len(found), bool)
    edges = np.r_[0, c.edges(found), len(found)]
    for b, x, y in zip(answers.column("bucket").to_pylist(), answers.column("again").to_pylist(), answers.column("hit").to_pylist()):
        n = edges[b + 1] - edges[b]
        again[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
        hit[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(y, np.uint8), count=n).astype(bool)
    inner = WINDOW - BLOCK + 1
    sums = {}
    for name, flag in (("again", again), ("hit", hit)):
        one = np.zeros(len(c.words) + 1, np.int64)
        one[at] = flag[inverse]
        sums[name] = np.concatenate(([0], np.cumsum(one)))
    start = c.starts(WINDOW)
    start = start[(sums["again"][start + inner] - sums["again"][start] == inner) & (sums["hit"][start + inner] > sums["hit"][start])]
    return start, rolling(c.words, WINDOW)[start], (rolling(c.words, WINDOW, 0xA24BAED4963EE407)[start] >> U64(32)).astype(np.uint32)


def _distinct(c: _Chunk, start: np.ndarray, one: np.ndarray, two: np.ndarray):
    """Distinct candidates in hash order: first hash, second hash, smallest owner, and the inverse."""
    pair = np.empty(len(one), [("a", "<u8"), ("b", "<u4")])
    pair["a"], pair["b"] = one, two
    found, inverse = np.unique(pair, return_inverse=True)
    owner = c.ids[np.searchsorted(c.at, start, "right") - 1]
    least = np.full(len(found), _NONE)
    np.minimum.at(least, inverse, owner)
    return found["a"], found["b"], least, inverse, owner


def _seek(buckets: int, key, rows: pa.Table, answers: pa.Table) -> pa.Table:
    if not rows.num_rows or not answers.num_rows:
        return _table([], _SEEK)
    c = _Chunk(rows, buckets)
    a, b, least, _, _ = _distinct(c, *_candidates(c, answers))
    out = []
    for i, (x, y) in enumerate(zip(np.r_[0, e := c.edges(a)], np.r_[e, len(a)])):
        if y > x:
            low = int(least[x:y].min())
            near = int(least[x:y].max()) - low < 1 << 32
            ids = _planes((least[x:y] - low).astype(np.uint32)) if near else least[x:y].tobytes()
            out.append((key[0].as_py(), i, _planes(np.diff(a[x:y], prepend=U64(0))), b[x:y].tobytes(), low if near else None, ids))
    return _table(out, _SEEK)


def _find(key, rows: pa.Table) -> pa.Table:
    a = [np.cumsum(_flat(x, U64), dtype=U64) for x in rows.column("a").to_pylist()]
    pair = np.empty(sum(map(len, a)), [("a", "<u8"), ("b", "<u4")])
    pair["a"], pair["b"] = np.concatenate(a), np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("b").to_pylist()])
    ids = np.concatenate([np.frombuffer(x, np.int64) if low is None else _flat(x, np.uint32).astype(np.int64) + low for x, low in zip(rows.column("ids").to_pylist(), rows.column("low").to_pylist())])
    found, inverse = np.unique(pair, return_inverse=True)
    least = np.full(len(found), _NONE)
    np.minimum.at(least, inverse, ids)
    out, at, smaller = [], 0, least[inverse] < ids
    low = np.where(smaller, 2, 0)  # an earlier chunk's document is smaller than all owners here
    for chunk, x in zip(rows.column("chunk").to_pylist(), a):
        mine = low[at : at + len(x)]
        at += len(x)
        if mine.any():
            out.append((chunk, key[0].as_py(), np.packbits(mine > 0).tobytes()))
    return _table(out, _FIND)


def _drop(buckets: int, with_text: bool, rows: pa.Table, answers: pa.Table, found: pa.Table) -> pa.Table:
    c = _Chunk(rows, buckets)
    covered = np.zeros(len(c.words) + 1, np.int64)
    if answers.num_rows:
        start, one, two = _candidates(c, answers)
        if len(start):
            a, _, least, inverse, owner = _distinct(c, start, one, two)
            away, edges = np.zeros(len(a), bool), np.r_[0, c.edges(a), len(a)]
            for b, x in zip(found.column("bucket").to_pylist(), found.column("away").to_pylist()):
                away[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=edges[b + 1] - edges[b]).astype(bool)
            gone = start[away[inverse] | (least[inverse] < owner)]
            np.add.at(covered, gone, 1)
            np.add.at(covered, gone + WINDOW, -1)
    covered = np.cumsum(covered)[: len(c.words)] > 0
    out = []
    for i, (x, y) in enumerate(zip(c.at[:-1], c.at[1:])):
        words = c.texts[i].split()
        gone = covered[x:y]
        if gone.any():
            words = [w for w, g in zip(words, gone) if not g]
        kept = b" ".join(words)
        out.append((None if c.rows[i] in c.null else int(c.ids[i]), int(y - x), int(gone.sum()), sha256(kept).hexdigest(), kept if with_text else None))
    return _table(out, _OUT)


_ASK = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("low", pa.binary()), ("twice", pa.binary()), ("block", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("again", pa.binary()), ("hit", pa.binary())])
_SEEK = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("low", pa.int64()), ("ids", pa.binary())])
_FIND = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("away", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array([v.decode() if f.type == pa.string() and isinstance(v, bytes) else v for v in col], f.type) for col, f in zip(columns, schema)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} " + {"int64": "long", "binary": "binary", "string": "string"}[str(f.type)] for f in schema)


def substring_dedup(docs: DataFrame, mb: int = 4, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words, one space between; null unless with_text) of every row.

    mb: stored MB a chunk.  Chunks and buckets exchange chunks x buckets blobs, so give
    64 beyond some TB.  See the module.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = chunks_for(docs, mb)
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("chunk"), "doc_id", "text")
    here = rows.groupBy("chunk")
    asked = here.applyInArrow(lambda key, rows: _ask(n, key, rows), _ddl(_ASK))
    answers = asked.groupBy("bucket").applyInArrow(lambda key, rows: _answer(key, rows), _ddl(_ANSWER))
    sought = here.cogroup(answers.groupBy("chunk")).applyInArrow(lambda key, rows, answers: _seek(n, key, rows, answers), _ddl(_SEEK))
    found = sought.groupBy("bucket").applyInArrow(lambda key, rows: _find(key, rows), _ddl(_FIND))
    both = answers.select("chunk", "bucket", "again", "hit", F.lit(None).cast("binary").alias("away")).unionByName(found.selectExpr("chunk", "bucket", "cast(null as binary) again", "cast(null as binary) hit", "away"))
    return here.cogroup(both.groupBy("chunk")).applyInArrow(lambda key, rows, replies: _finish(n, with_text, key, rows, replies), _ddl(_OUT))


def _finish(buckets: int, with_text: bool, key, rows: pa.Table, replies: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return _table([], _OUT)
    answered = replies.column("again").is_valid()
    return _drop(buckets, with_text, rows, replies.filter(answered), replies.filter(replies.column("away").is_valid()))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT h, min(doc_id) AS d FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN m ON g.h = m.h AND g.doc_id > m.d) GROUP BY doc_id),
o AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(ps), 0) AS r, CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS k
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM o
"""
