"""Line dedup by windows of two lines at every place.

A text's lines are split at newlines; those that hold a word are numbered, and every two
consecutive ones are a window, whatever blank lines stand between.  Windows begin at every
line, so a shared passage of two lines or more is found whole wherever it starts and ends.
A window that stands elsewhere with a smaller (doc_id, place) is repeated: its lines are
removed, after their bytes were compared with those of that first place.  Blank lines go
with the line before them (those at the top with the first line), so an exact copy of two
lines with words or more loses every line.  Lines that a repeated window shares with its own
first place stay, so of a line that stands three times in a row two are left.

Windows of a document that follow each other at their first places as well make one run
(the chunk that _chunks counts).  Only digests are grouped; bodies are shuffled for runs
alone, once, and a window that stands in a third of the documents joins one keeper row,
which Spark splits.  Texts are dealt by doc_id once and that exchange is read twice.

Defined results: a null text stays null and loses nothing; a text that loses every line
becomes empty; rows of one doc_id count as one document; rows with a null doc_id are left
alone and remove nothing; of equal windows the one with the smallest (doc_id, place) stays, so
there are no ties; a text of any length is read whole; an empty table gives no rows.  Other
columns pass through whatever their names, n_chars (where there is one) is counted again for
changed texts.
"""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table, word_count

_GAPS = " \t\n\x0b\x0c\r"


def word_lines(text: str) -> list[str]:
    """The lines that hold a word."""
    return [x for x in text.split("\n") if x.strip(_GAPS)]


def windows(text: str) -> list[tuple[int, bytes]]:
    """(place, digest) of every two consecutive lines with words."""
    own = [x.encode() for x in word_lines(text)]
    return [(no, blake2b(a + b"\n" + b, digest_size=16).digest()) for no, (a, b) in enumerate(zip(own, own[1:]))]


def without(text: str, gone: set[int]) -> tuple[str, int]:
    """text without the lines with words of these numbers and the blank lines that go with them, and how many lines went."""
    lines, kept, no = text.split("\n"), [], -1
    for x in lines:
        no += bool(x.strip(_GAPS))
        if max(no, 0) not in gone:
            kept.append(x)
    return "\n".join(kept), len(lines) - len(kept)


def _lost(no: int, same: bool, first: int) -> set[int]:
    """Lines a repeated window loses: not those of its own first place."""
    return {no, no + 1} - ({first, first + 1} if same else set())


def runs(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """found: (place, first doc, place there) of a document's repeated windows -> (place, lines, first doc, place there)."""
    out = []
    for at, no, doc in sorted((no - first, no, doc) for no, doc, first in found):
        if out and out[-1][2] == doc and out[-1][0] - out[-1][3] == at and out[-1][0] + out[-1][1] - 1 == no:
            out[-1][1] += 1
        else:
            out.append([no, 2, doc, no - at])
    return [tuple(x) for x in out]


def _sliced(batches):
    for batch in batches:
        yield from slices(batch)


def _digests(batches):
    for batch in _sliced(batches):
        rows = [(i, no, d) for i, t in zip(*(c.to_pylist() for c in batch.columns)) if i is not None and t for no, d in windows(t)]
        ids, nos, ds = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(ds, pa.binary())], ["doc_id", "no", "digest"])


def _runs(batches):
    for batch in batches:
        rows = [(i, *run) for i, w in zip(*(c.to_pylist() for c in batch.columns)) for run in runs({(x["no"], x["doc"], x["first"]) for x in w})]
        columns = zip(*rows) if rows else ((),) * 5
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "no", "n", "doc", "first"])


def _bodies(batches):
    """The lines asked for of every text, joined by newlines."""
    for batch in _sliced(batches):
        rows = []
        for i, real, text, ask in zip(*(batch.column(c).to_pylist() for c in ("_id", "_real", "_t", "_ask"))):
            own = word_lines(text) if real and text else []
            rows += [(i, x["first"], x["n"], "\n".join(own[x["first"] : x["first"] + x["n"]])) for x in ask]
        columns = zip(*rows) if rows else ((),) * 4
        types = (pa.int64(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc", "first", "n", "body"])


def _rebuild(batches):
    for batch in _sliced(batches):
        texts, lines, chunks = [], [], []
        for i, real, text, gone in zip(*(batch.column(c).to_pylist() for c in ("_id", "_real", "_t", "_gone"))):
            n_lines = n_chunks = 0
            if real and text and gone:
                own, away = word_lines(text), set()
                for g in gone:
                    there, no = g["body"].split("\n"), g["no"]
                    # window by window, as rows of one doc_id may hold different texts
                    hits = [j for j in range(len(there) - 1) if own[no + j : no + j + 2] == there[j : j + 2]]
                    n_chunks += bool(hits)
                    for j in hits:
                        away |= _lost(no + j, g["doc"] == i, g["first"] + j)
                text, n_lines = without(text, away)
            texts.append(text)
            lines.append(n_lines)
            chunks.append(n_chunks)
        yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(chunks, pa.int64())], ["_doc", "_t", "_lines", "_chunks"])


def _deduped(docs: DataFrame) -> DataFrame:
    """_doc (all columns of docs but text), _t (the shortened text), _lines and _chunks of every row."""
    rest = [c for c in docs.columns if c != "text"]
    # never null, so that no join filters below the exchange and both read the same one; rows without an id meet nothing and are spread
    own = F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id())
    base = docs.select(own.alias("_id"), F.col("doc_id").isNotNull().alias("_real"), F.col("text").alias("_t"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_doc")).repartition("_id")
    places = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digests, "doc_id long, no int, digest binary")
    repeated = places.groupBy("digest").agg(F.min(F.struct("doc_id", "no")).alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = places.join(repeated, "digest").where(F.struct("doc_id", "no") != F.col("keep"))
    members = members.groupBy("doc_id").agg(F.collect_set(F.struct("no", F.col("keep.doc_id").alias("doc"), F.col("keep.no").alias("first"))).alias("w"))
    found = cut(members.mapInArrow(_runs, "doc_id long, no int, n int, doc long, first int"))
    ask = found.select("doc", "first", "n").distinct().groupBy(F.col("doc").alias("_id")).agg(F.collect_list(F.struct("first", "n")).alias("_ask"))
    bodies = base.join(ask, "_id").mapInArrow(_bodies, "doc long, first int, n int, body string")
    gone = found.join(bodies, ["doc", "first", "n"]).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("no", "doc", "first", "body")).alias("_gone"))
    kind = base.schema["_doc"].dataType.simpleString()
    return base.join(gone, "_id", "left").mapInArrow(_rebuild, f"_doc {kind}, _t string, _lines long, _chunks long")


def _columns(docs: DataFrame, leave: tuple[str, ...] = ()) -> list:
    """The columns of docs out of the rows of _deduped, but for those of the names to leave."""
    new = {"text": F.col("_t")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_chunks") > 0, F.length("_t")).otherwise(F.col("_doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return [(new[c] if c in new else F.col("_doc").getField(c)).alias(c) for c in docs.columns if c not in leave]


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with text shortened, and how many lines and runs each lost as _lines and _chunks (columns of docs of these names give way); see the module."""
    return _deduped(docs).select(*_columns(docs, ("_lines", "_chunks")), "_lines", "_chunks")


def line_filter(docs: DataFrame) -> DataFrame:
    """The columns of docs with text shortened, without the documents that had words and are left with none."""
    return _deduped(docs).where((F.col("_chunks") == 0) | (word_count(F.col("_t")) > 0)).select(*_columns(docs))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_lines").alias("n_removed_lines"), F.col("_chunks").alias("n_removed_chunks"), F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))
