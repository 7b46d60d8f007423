"""Ranked lexical search: postings scored window by window.

The queries are taken in blocks (by the size of their texts); a block's distinct terms are
its vocabulary.  For each block of queries

1. one Arrow pass over all documents counts terms and makes *fragments*: for the documents of a
   batch that lie in the same window of doc_ids, the postings of the vocabulary's terms (sorted
   by term: the document's slot, its number of occurrences) and the documents' lengths; the
   numbers of documents and terms of the corpus and the document frequencies are sums over the
   fragments,
2. fragments are dealt out by window (rebalanced, so a window with most of the rows is split:
   a document's score needs its own fragment only) and each task goes through its windows: the
   postings of a query's terms are traversed, their whole-number impacts scatter-added into an
   array of `window` places, the documents that occur are kept in a bitset, and the occupied
   places are harvested into the query's heap of `most` best; the heaps live as long as the task,
   so a place that cannot enter its heap is passed over, and a task returns `most` rows a query
   at most,
3. the tasks' rows are ranked by query, limited before they are shuffled.

Only the vocabulary, the frequencies and the queries' terms of a block are with the driver and
in closures, bounded by `block_mb` of query text.

Defined results: null text and text without a term has no part in any count and is no result; a
query without terms, or null, has no rows; equal scores go by doc_id, a null doc_id comes last;
a repeated row is a document of its own each time, as a repeated query is ranked each time; a
text of any length is read whole; other columns are not read, whatever their names; empty
tables give no rows.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, letter_table, plan_bytes, slices, table, text_bytes

#: Places of a window: an array of 64 kB, and a bitset of 1 kB.
WINDOW = 8192
MOST, K, B, SCALE = 10, 8, 90, 1_000_000_000
BLOCK_MB = 4


FRAGMENT = "window long, docs long, terms long, ids binary, nulls binary, lengths binary, term binary, slot binary, tf binary, listed array<int>, df array<long>"


def _fragments(letters: bytes, vocabulary: dict[bytes, int], window: int, batches):
    """One row for each window of a batch, and first a row of the batch's own counts."""
    from itertools import repeat

    for whole in batches:
        for batch in slices(whole):
            ids = batch.column("doc_id")
            null = np.array([not x.is_valid for x in ids], bool)
            doc = np.array(ids.fill_null(0), np.int64)
            found, sizes = [], []
            for text in text_bytes(batch.column("text")):
                words = text.translate(letters).split()
                sizes.append(len(words))
                found.append(np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words)))
            sizes = np.array(sizes, np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            term = np.concatenate(found) if found else np.zeros(0, np.int32)
            hit = term >= 0
            posting, tf = np.unique(row[hit] * np.int64(len(vocabulary) or 1) + term[hit], return_counts=True)
            row, term = posting // (len(vocabulary) or 1), posting % (len(vocabulary) or 1)
            listed, df = np.unique(term, return_counts=True)
            rows = [dict(window=None, docs=int((sizes > 0).sum()), terms=int(sizes.sum()), listed=listed.astype(np.int32), df=df)]
            place = np.where(null, -1, doc // window)  # rows without an id are windows of their own batch
            used = np.unique(row)
            order = used[np.lexsort((doc[used], place[used]))]
            for group in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else ():
                for at in range(0, len(group), window):
                    own = group[at : at + window]
                    slot = np.full(len(sizes), -1, np.int32)
                    slot[own] = np.arange(len(own))
                    mine = np.flatnonzero(slot[row] >= 0)
                    mine = mine[np.argsort(term[mine], kind="stable")]
                    # two bytes hold a slot; four bytes hold how often a term occurs in a text
                    rows.append(dict(window=int(place[own[0]]), ids=doc[own].tobytes(), nulls=null[own].tobytes(), lengths=sizes[own].tobytes(), term=term[mine].astype("<i4").tobytes(), slot=slot[row[mine]].astype("<u2").tobytes(), tf=tf[mine].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_pylist(rows, schema=_schema())


def _schema() -> pa.Schema:
    kinds = [("window", pa.int64()), ("docs", pa.int64()), ("terms", pa.int64())] + [(x, pa.binary()) for x in ("ids", "nulls", "lengths", "term", "slot", "tf")]
    return pa.schema([*kinds, ("listed", pa.list_(pa.int32())), ("df", pa.list_(pa.int64()))])


class Heap:
    """The best (score, doc_id) of a query: highest scores, equal ones by doc_id, ids that are null last."""

    def __init__(self, most: int):
        self.most, self.kept, self.least = most, [], 1

    def harvest(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        go = np.flatnonzero(scores >= self.least)
        if len(go) > self.most:
            go = go[np.lexsort((ids[go], null[go], -scores[go]))[: self.most]]
        if len(go):
            rows = [(-int(s), bool(n), int(i)) for s, n, i in zip(scores[go], null[go], ids[go])]
            self.kept = sorted(self.kept + rows)[: self.most]
            if len(self.kept) == self.most:
                self.least = -self.kept[-1][0]


_PARTS = (("ids", "<i8"), ("nulls", "?"), ("lengths", "<i8"), ("term", "<i4"), ("slot", "<u2"), ("tf", "<u4"))


def _merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Fragments as one window: slots after one another, postings by term."""
    first = np.cumsum([0] + [len(x[0]) for x in held])
    ids, null, lengths, term, slot, tf = (np.concatenate(x) for x in zip(*(x[:4] + [x[4].astype(np.int64) + at, x[5].astype(np.int64)] for x, at in zip(held, first))))
    if len(held) > 1:
        order = np.argsort(term, kind="stable")
        term, slot, tf = term[order], slot[order], tf[order]
    return [ids, null, lengths, term, slot, tf]


def _windows(window: int, batches):
    """The arrays of one window after another: fragments come by window, those of one are put together as far as they fit."""
    held, filled, key = [], 0, None
    for batch in batches:
        for at, *raw in zip(batch.column("window").to_pylist(), *(batch.column(name) for name, _ in _PARTS)):
            part = [np.frombuffer(x.as_py(), kind) for x, (_, kind) in zip(raw, _PARTS)]
            if held and (at != key or filled + len(part[0]) > window):
                yield _merged(held)
                held, filled = [], 0
            held.append(part)
            filled, key = filled + len(part[0]), at
    if held:
        yield _merged(held)


def _scored(queries: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, window: int, most: int, batches):
    """query, doc_id, score of the best of each query in this task's fragments."""
    heaps = [Heap(most) for _ in queries]
    scores = np.zeros(window, np.int64)
    for ids, null, lengths, term, slot, tf in _windows(window, batches):
        wide = object if len(lengths) and B * n_docs * int(lengths.max()) >> 63 else np.int64
        m = (100 - B) + (B * n_docs * lengths.astype(wide) // n_terms).astype(np.int64)
        impact = weights[term] * (SCALE * tf // (1000 * tf + K * m[slot]))
        listed, begin = np.unique(term, return_index=True)
        end = np.append(begin[1:], len(term))
        span = {t: (b, e) for t, b, e in zip(listed.tolist(), begin.tolist(), end.tolist())}
        bits = {}  # of each term, once a window: the bitset of its documents
        for heap, terms in zip(heaps, queries):
            seen = None
            for t in terms:
                if t in span:
                    b, e = span[t]
                    scores[slot[b:e]] += impact[b:e]  # a document stands once in a term's postings
                    if t not in bits:
                        mark = np.zeros(window, bool)
                        mark[slot[b:e]] = True
                        bits[t] = np.packbits(mark)
                    seen = bits[t].copy() if seen is None else np.bitwise_or(seen, bits[t], out=seen)
            if seen is not None:
                own = np.flatnonzero(np.unpackbits(seen, count=window))
                heap.harvest(scores[own], ids[own], null[own])
                scores[own] = 0
    rows = [(q, None if n else i, -s) for q, heap in enumerate(heaps) for s, n, i in heap.kept]
    if rows:
        q, i, s = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], ["query", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, most: int = MOST, window: int = WINDOW, block_mb: int = BLOCK_MB) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents (doc_id, text) of each item (item_id, text); see the module."""
    if not 1 <= window <= 1 << 16:
        raise ValueError("a window has 1 to 65,536 places")
    letters = letter_table()
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.monotonically_increasing_id().alias("_row")).where("text is not null")
    parts = max(1, -(-plan_bytes(items) // (block_mb << 20)))
    found = []
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("_row"), F.lit(parts)) == part) if parts > 1 else items
        own = own.orderBy("item_id", "_row").select("item_id", "text").collect()
        vocabulary: dict[bytes, int] = {}
        queries = [[vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys((r.text or "").encode().translate(letters).split())] for r in own]
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        fragments = cut(rows.mapInArrow(partial(_fragments, letters, vocabulary, window), FRAGMENT))
        counts = fragments.where("window is null")
        n_docs, n_terms = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in counts.select(F.inline(F.arrays_zip("listed", "df"))).groupBy("listed").agg(F.sum("df")).collect():  # a block's vocabulary at most
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        dealt = fragments.where("window is not null").select("window", "ids", "nulls", "lengths", "term", "slot", "tf").hint("rebalance", "window").sortWithinPartitions("window")
        best = dealt.mapInArrow(partial(_scored, queries, weights, n_docs, max(n_terms, 1), window, most), "query int, doc_id long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        names = docs.sparkSession.createDataFrame([(n, r.item_id) for n, r in enumerate(own)], "query int, item_id long")
        found.append(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))  # a block's queries
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
l AS MATERIALIZED (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
i AS MATERIALIZED (SELECT DISTINCT q, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark WHERE text IS NOT NULL)),
p AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY r, t),
v AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM c) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY t),
m AS (SELECT r, doc_id, {100 - B} + ({B} * n * docs) // terms AS m FROM l, c),
s AS (SELECT q, item_id, m.r, doc_id, CAST(sum(w * (({SCALE} * tf) // (1000 * tf + {K} * m.m))) AS BIGINT) AS score FROM i JOIN p ON p.t = i.t JOIN v ON v.t = i.t JOIN m ON m.r = p.r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {MOST}"""
