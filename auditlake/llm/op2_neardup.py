"""Near-duplicate documents by MinHash with banding, verification and connected components.

A document's set holds its distinct 2-word shingles of the lower-cased (A-Z) words; with
one word, that word alone; without words it is empty and linked with nothing.  Two
documents are linked when 100 * |A and B| >= 80 * |A or B|.

1. One pass over the texts makes the set (as 64-bit hashes), its size, a 128-bit digest of
   the word sequence, HASHES universal minima, the low byte of each as signature, and a
   key for each of BANDS bands of ROWS minima.  A linked pair shares no band with
   probability (1 - 0.8**5)**40, about 1e-7.
2. Exact copies meet in their digest; its smallest doc_id stands for them.
3. In each band bucket every member is paired with the smallest one (a star, never all
   pairs).  Pairs are checked on sizes, signatures, then on the full sets, and confirmed
   pairs make components by large-star and small-star.
4. Members of buckets that still hold several components meet the one with the fewest rare
   shingles (that at most RARE such members have) in their bucket, which in a group of edited
   copies is the text they were made from.
5. What is still apart is paired within its buckets where  rare shingles common to both +
   the sum over CELLS classes of shingles of min(other shingles of A in it, those of B), the
   most that |A and B| can be, allows a link; pairs with a common rare shingle come from the
   rare shingles' lists.  Copies that were edited in different places lose different classes,
   so the sum proves nearly all of them unlinked.  So each pair that shares a bucket ends in
   one component, or was checked, or was proved unlinked: no link is lost, and pairs stay
   near linear in a group of copies however large it is.

Defined results: null or wordless text is its own component and kept; rows of one doc_id
count as one node, and each gets its row; a null doc_id with a text takes part as a copy
only: it gets its copies' component, or null and kept if there are none.
"""

from __future__ import annotations

from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ID_ROWS, U64, arrow_map, chunks_for, cut, mix, rolling, small, table, text_bytes, word_hashes
from .components import connected_components, joined_components

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
SIMILARITY = 80
_rng = np.random.default_rng(77)
#: h(x) = (a * x + b) mod 2**32 with odd a, on 32 well-mixed bits of a shingle.
_A = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=U64))
#: Equal bytes that a pair of similarity 0.8 has but with probability under 1e-12: mean 160, deviation 5.7.
SIGNATURE_LEAST = 115


def shingle_sets(texts: list[bytes], width: int = 2) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts, lower=True)
    shingles = rolling(words, width)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= width:
            own = np.sort(shingles[a : b - width + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            short = words[a : a + 1]
            for x in words[a + 1 : b]:
                short = mix(short * U64(31) + x)
            out.append(mix(short ^ U64(0x5BF03635)))
        else:
            out.append(np.zeros(0, U64))
    return out


def minima(own: np.ndarray) -> np.ndarray:
    """The HASHES minima of a set, in slices that stay in cache."""
    low, least = own.astype(np.uint32), np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 256):
        np.minimum(least, (_A[:, None] * low[None, i : i + 256] + _B[:, None]).min(axis=1), out=least)
    return least


def _digest(text: bytes) -> bytes:
    return blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = text_bytes(batch.column(1))
    sets = shingle_sets(texts)
    sizes = np.array([len(x) for x in sets], np.int64)
    mins = np.stack([minima(x) for x in sets]).astype(U64).reshape(len(sets), BANDS, ROWS)
    keys = np.broadcast_to(_BAND_SALT, mins.shape[:2])
    for j in range(ROWS):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + mins[:, :, j])
    small = mins.reshape(len(sets), HASHES).astype(np.uint8)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array([_digest(t) if n else None for t, n in zip(texts, sizes)], pa.binary()),
            pa.array(sizes),
            pa.array([s.tobytes() if n else None for s, n in zip(small, sizes)], pa.binary()),
            pa.ListArray.from_arrays(np.arange(0, len(sets) * BANDS + 1, BANDS, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64))),
        ],
        ["doc_id", "digest", "n_shingles", "signature", "bands"],
    )


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = text_bytes(batch.column(1))
    sets = shingle_sets(texts)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(t) for t in texts], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "digest", "own"])


def _likely(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Pairs whose signatures agree often enough."""
    one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sa", "sb"))
    return batch.filter(pa.array((one == two).sum(axis=1) >= SIGNATURE_LEAST)).select(["a", "b"])


def _linked(percent: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Pairs whose full sets are similar enough."""
    keep = []
    for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist()):
        x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
        both = np.concatenate((x, y))
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        keep.append(100 * common >= percent * (len(x) + len(y) - common))
    return batch.filter(pa.array(keep)).select(["a", "b"])


def _spread(buckets: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The shingles of a batch of sets (id, own, part, odd), dealt to hash buckets as packed arrays, each with its owners alone."""
    own = [np.frombuffer(x, U64) for x in batch.column("own").to_pylist()]
    every, owner = np.concatenate(own), np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])
    to = (every % U64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(buckets + 1))
    who = np.array([batch.column(c).to_pylist() for c in ("id", "part", "odd")], np.int64)
    rows = []
    for b, (x, y) in enumerate(zip(ends[:-1], ends[1:])):
        if y > x:
            here, at = np.unique(owner[order[x:y]], return_inverse=True)
            rows.append((b, every[order[x:y]].tobytes(), at.astype(np.int32).tobytes(), who[:, here].tobytes()))
    cols = list(zip(*rows)) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "h", "owner", "who"])


def _rare(most: int, rows: pa.Table) -> pa.Table:
    """Of the bucket's shingles that at most so many of these documents have: (a, null, how many a has), and
    (a, b, how many a and b have both) for odd a and b of another part; of the others, by class, how many a has (cells, with b null)."""
    who = [np.frombuffer(x, np.int64).reshape(3, -1) for x in rows.column("who").to_pylist()]
    shift = np.cumsum([0] + [x.shape[1] for x in who])
    ids, part, odd = np.concatenate(who, axis=1)
    h = np.concatenate([np.frombuffer(x, U64) for x in rows.column("h").to_pylist()])
    owner = np.concatenate([np.frombuffer(x, np.int32) + s for x, s in zip(rows.column("owner").to_pylist(), shift)])
    one, first, same = np.unique(ids, return_index=True, return_inverse=True)
    if again := len(one) < len(ids):  # repeated rows have one owner, which has a shingle once
        ids, part, odd, owner = one, part[first], odd[first], same[owner]
    order = np.lexsort((owner, h)) if again else np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    if again:
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
        h, owner = h[new], owner[new]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    counts = np.diff(np.append(starts, len(h)))
    few = np.repeat(counts <= most, counts)
    has, n = ids, np.bincount(owner[few], minlength=len(ids))
    cells = np.bincount(owner[~few].astype(np.int64) * CELLS + ((h[~few] >> U64(40)) % U64(CELLS)).astype(np.int64), minlength=len(ids) * CELLS).astype(np.int32)
    owner, group = owner[few], np.repeat(np.arange(len(counts)), counts)[few]
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for step in range(1, most):  # every pair in a list of a shingle's owners lies some step apart
        if not (near := group[step:] == group[:-step]).any():
            break
        x, y = owner[:-step][near], owner[step:][near]
        x, y = (z[(part[x] != part[y]) & ((odd[x] > 0) | (odd[y] > 0))] for z in (x, y))
        x, y = np.where(ids[x] < ids[y], x, y).astype(np.int64), np.where(ids[x] < ids[y], y, x)
        found, at, c = np.unique(np.concatenate((keys, x * len(ids) + y)), return_inverse=True, return_counts=True)
        if len(keys):
            c += np.bincount(at[: len(keys)], times - 1, len(found)).astype(np.int64)
        keys, times = found, c
    a, b = ids[keys // len(ids)], ids[keys % len(ids)]
    own = np.arange(len(has) + len(b)) < len(has)
    offsets = np.minimum(np.arange(len(own) + 1), len(has)).astype(np.int32) * CELLS
    return pa.table({"a": np.concatenate((has, a)), "b": pa.array(np.concatenate((has, b)), pa.int64(), mask=own), "n": np.concatenate((n, times)).astype(np.int64), "cells": pa.ListArray.from_arrays(offsets, pa.array(cells))})


def _sets_of(ids: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, own) with the full sets of representatives; ids: doc_id, distinct and cut."""
    sets = arrow_map(docs.join(small(ids, ID_ROWS), "doc_id", "left_semi").select("doc_id", "text"), _sets, "id long, digest binary, own binary")  # beyond ID_ROWS the texts are shuffled
    return sets.join(reps.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi").select("id", "own")  # where rows share a doc_id


def _confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, parts: int) -> DataFrame:
    """The pairs (a, b) of representatives that are linked, checked on signatures and then on full sets."""
    at = lambda side: reps.select(F.col("rep").alias(side), F.col("signature").alias(f"s{side}"))
    likely = cut(arrow_map(pairs.join(at("b"), "b").join(at("a"), "a").select("a", "b", "sa", "sb"), _likely, "a long, b long"), parts)
    sets = _sets_of(cut(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), parts), reps, docs)
    side = lambda c: sets.select(F.col("id").alias(c), F.col("own").alias(f"x{c}"))
    full = likely.join(side("b"), "b").join(side("a"), "a").select("a", "b", "xa", "xb")
    return cut(arrow_map(full, partial(_linked, SIMILARITY), "a long, b long"), parts)


def _mixed(members: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """The members (key, rep, n, ...) of buckets that still hold several components, with part and the bucket's main part."""
    named = members.join(parts, F.col("rep") == F.col("node"), "left").withColumn("part", F.coalesce("component", "rep")).drop("node", "component")
    named = cut(named, n)
    mixed = named.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min_by("part", "rep").alias("main"), F.min("n").alias("least_n"))
    return cut(named.join(mixed.where("lo < hi").select("key", "main", "least_n"), "key"), n)


def _fits(x: str, y: str, of: str = "n") -> str:
    """The sizes of two sets allow a link; of = shared: an intersection of that size at most allows it too."""
    s = SIMILARITY
    if of == "n":
        return f"100 * least({x}.n, {y}.n) >= {s} * greatest({x}.n, {y}.n)"
    return f"{100 + s} * least({x}.shared, {y}.shared) >= {s} * ({x}.n + {y}.n)"


#: Shingles that at most so many of the documents compared have count as rare; classes of the others.
RARE, CELLS = 32, 32


def _overlap(x: str, y: str) -> str:
    """The most shingles that are not rare that two members can have in common, by class."""
    return "(" + " + ".join(f"least({x}.cells[{i}], {y}.cells[{i}])" for i in range(CELLS)) + ")"


def _rare_counts(mixed: DataFrame, reps: DataFrame, docs: DataFrame, parts: int) -> DataFrame:
    """(a, null, common, cells) rare shingles of every member and the others by class, and (a, b, common) rare ones that two of unlike parts have both."""
    who = cut(mixed.groupBy(F.col("rep").alias("id")).agg(F.max("part").alias("part"), F.max((F.col("part") != F.col("main")).cast("long")).alias("odd"), F.max("n").alias("n")), parts)
    total = who.agg(F.sum("n")).first()[0] or 0
    sets = _sets_of(who.select(F.col("id").alias("doc_id")), reps, docs).join(who, "id").select("id", "own", "part", "odd")
    dealt = arrow_map(sets, partial(_spread, max(12, total // 1_000_000)), "bucket long, h binary, owner binary, who binary")
    found = dealt.groupBy("bucket").applyInArrow(lambda rows: _rare(RARE, rows), "a long, b long, n long, cells array<int>")
    sums = found.groupBy("a", "b").agg(F.sum("n").alias("common"), *(F.sum(F.get("cells", F.lit(i))).cast("int").alias(f"c{i}") for i in range(CELLS)))
    return cut(sums.select("a", "b", "common", F.when(F.col("b").isNull(), F.array(*(f"c{i}" for i in range(CELLS)))).alias("cells")), parts)


def _shared(mixed: DataFrame, rare: DataFrame) -> DataFrame:
    """mixed with shared: how many shingles of a member are not rare, and cells: the same by class."""
    own = rare.where("b is null").select(F.col("a").alias("_a"), "common", "cells")
    return mixed.join(own, F.col("rep") == F.col("_a"), "left").withColumn("shared", F.col("n") - F.coalesce("common", F.lit(0))).drop("_a", "common")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text); see the module."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = chunks_for(docs)
    signed = cut(arrow_map(docs, _sign, "doc_id long, digest binary, n_shingles long, signature binary, bands array<long>"), parts)
    reps = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "signature", "bands"), "doc_id").alias("x"))
    reps = cut(reps.select("rep", "digest", "x.*"), parts)

    banded = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("last")).where("center < last").select("key", "center")
    members = cut(banded.join(buckets, "key"), parts)
    sizes = reps.select(F.col("rep").alias("a"), F.struct(F.col("n_shingles").alias("n")).alias("x"))
    star = members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b"), F.struct("n").alias("y")).distinct()
    links = _confirm(cut(star.join(sizes, "a").where(_fits("x", "y")).select("a", "b"), parts), reps, docs, parts)
    members = members.select("key", "rep", "n")
    edges = lambda links: links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    named = cut(connected_components(edges(links), parts=parts), parts)

    mixed = _mixed(members, named, parts)
    mixed = cut(_shared(mixed, _rare_counts(mixed, reps, docs, parts)), parts)

    # every other member meets the bucket's most central one: the one with the fewest words of its own
    center = mixed.groupBy("key").agg(F.min_by(F.struct("rep", "part", "n", "shared"), F.struct(F.col("n") - F.col("shared"), F.col("rep"))).alias("c"))
    again = mixed.withColumn("m", F.struct("n", "shared")).join(center, "key").where("part <> c.part").where(_fits("m", "c"))
    again = again.select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct()
    links = _confirm(cut(again, parts), reps, docs, parts)
    named = cut(joined_components(named, edges(links), parts), parts)

    # what is still apart: members out of the main component meet all others they could be linked with
    mixed = _mixed(members, named, parts)
    rare = _rare_counts(mixed, reps, docs, parts)
    mixed = cut(_shared(mixed, rare), parts)
    room = f"{100 + SIMILARITY} * shared >= {SIMILARITY} * (n + greatest(least_n, n * {SIMILARITY} div 100))"
    odd, other = mixed.where("part <> main").where(room).alias("o"), mixed.where(room).alias("m")
    apart = (F.col("o.key") == F.col("m.key")) & (F.col("o.part") != F.col("m.part")) & ((F.col("m.part") == F.col("m.main")) | (F.col("o.rep") < F.col("m.rep")))
    most = F.expr(f"{100 + SIMILARITY} * {_overlap('o', 'm')} >= {SIMILARITY} * (o.n + m.n)")
    rest = odd.join(other, apart & F.expr(_fits("o", "m")) & F.expr(_fits("o", "m", "shared")) & most)
    rest = rest.select(F.least("o.rep", "m.rep").alias("a"), F.greatest("o.rep", "m.rep").alias("b"))
    side = lambda c, r: mixed.select(F.col("rep").alias(c), F.struct("n", "shared", "cells").alias(r)).distinct()
    both = rare.where("b is not null").join(side("a", "x"), "a").join(side("b", "y"), "b")
    both = both.where(f"{100 + SIMILARITY} * (common + {_overlap('x', 'y')}) >= {SIMILARITY} * (x.n + y.n)").where(_fits("x", "y")).select("a", "b")
    links = _confirm(cut(rest.union(both).distinct(), parts), reps, docs, parts)
    named = joined_components(named, edges(links), parts)

    copies = reps.select("digest", "rep")
    out = signed.select("doc_id", "digest", "n_shingles").join(copies, "digest", "left").join(named, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
g AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM s UNION SELECT g.v, r.m FROM r JOIN g ON g.u = r.doc_id AND r.m < g.v)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.m) AS component_id, s.doc_id = min(r.m) AS kept
FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.sh)
"""
