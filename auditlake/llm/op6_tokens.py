"""Token ids in a binary format: encoding, files of range-coded blocks, and reading back.

Documents are ranged by doc_id into partitions; each task encodes its texts with the
tokenizers library, appends the end id and writes files of at most FILE_IDS ids, so memory
is bounded whatever a partition holds.  A file has the ids of its documents in order, its
documents' ids and lengths, and blocks as in `codec`.  The files are rows of a Parquet
table (file, part, payload), so any store Spark writes to can hold them, and readers get
them through Spark.

Words repeat, so a task encodes each distinct piece of its texts once: a text is cut before
white space that follows a visible character and before some signs that follow a letter, where
this tokenizer always begins a new piece.  The first pieces a worker met stay with it,
up to a number and a size, for its next texts.

Defined results: null text is empty and has the end id alone; a null doc_id sorts first;
rows of one doc_id follow each other in the order of their texts.  No rows give no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import codec
from .common import chunks_for, shared_dir, slices, table, worker_store

END, FILE_IDS, SLICE = 2, 12_000_000, 32 << 20


def tokenizer(path: str | None):
    """The tokenizer of a file (None: the public byte-level BPE), loaded once a worker, and which of its tokens open with ASCII white space."""
    kept = worker_store()
    if ("tokenizer", path) not in kept:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path_ = public_tokenizers.path("byte_bpe_50k.json")
        else:
            path_ = path
        library = Tokenizer.from_file(path_)
        opens = np.zeros(library.get_vocab_size(), bool)
        # white space as this byte-level vocabulary writes it: U+0100 more for control signs, U+0120 for the space
        opens[[i for t, i in library.get_vocab().items() if t and 0x109 <= ord(t[0]) <= 0x10D or t[:1] == "\u0120"]] = True
        kept["tokenizer", path] = library, opens
    return kept["tokenizer", path]


_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_SEEN = np.zeros(256, bool)  # ASCII signs that are surely visible
_SEEN[0x21:0x7F] = True
_SIGNS = b"!\"'(),.:;?&*#%$"
JOINED = 200
KEPT, KEPT_BYTES = 1 << 19, 8 << 20


def _table(*kinds) -> bytes:
    """A number for each byte: 1 if it is of the first kind, 2 if of the second, added up."""
    out = np.zeros(256, np.uint8)
    for i, kind in enumerate(kinds):
        out[list(kind)] |= 1 << i
    return out.tobytes()


_BEFORE = _table(range(0x21, 0x7F), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_LEAD = _table(range(0xC3, 0xE0), [0xC3])
_SECOND = _table(range(0x80, 0xC0), {*range(0x80, 0xC0)} - {0x97, 0xB7})


def _pieces(raw: np.ndarray, starts: np.ndarray, fixed: bytes = b"") -> np.ndarray:
    """Where pieces begin: texts, ASCII white space after a character that is surely visible and signs after a letter, where this tokenizer begins a new piece whatever stands around.

    Surely visible are ASCII signs and characters of two bytes from U+00C0 on; letters those of ASCII and U+00C0 to U+00FF.
    fixed: bytes of tokens that are found in a text before it is cut into pieces; none of these signs begins a piece.
    """
    data = raw.tobytes()
    number = lambda table: np.frombuffer(data.translate(table), np.uint8)
    after, begin = number(_table([9, 10, 11, 12, 13, 32], set(_SIGNS) - set(fixed))), np.zeros(len(raw), np.uint8)
    np.bitwise_and(after[1:], number(_BEFORE)[:-1], out=begin[1:])
    two = number(_LEAD)[:-2] & number(_SECOND)[1:-1]
    two &= after[2:]
    begin[2:] |= two
    begin[starts] = 1
    return np.flatnonzero(begin != 0)


def _encode_pieces(library, opens: np.ndarray, pieces: pa.Array) -> pa.Array:
    """The ids of all pieces as lists.

    Pieces of one ASCII white space and more that end in a character that is surely visible are encoded many at a time,
    joined: each begins a new piece there as well, and their ids fall apart before each token that opens with white space.
    """
    ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    raw, ends = np.frombuffer(pieces.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    first, last, size = ends[:-1], ends[1:] - 1, np.diff(ends)
    two = (raw[last] >= 0x80) & (raw[last] < 0xC0) & (raw[np.maximum(last - 1, 0)] >= 0xC3) & (raw[np.maximum(last - 1, 0)] <= 0xDF)
    plain = _GAP[raw[first]] & (np.add.reduceat(_GAP[raw].astype(np.int32), first) == 1) & (size > 1) & (_SEEN[raw[last]] | two & (size > 2))
    own, rest = np.flatnonzero(plain), [np.flatnonzero(~plain)]
    joined = pieces.filter(pa.array(plain))
    upto = np.frombuffer(joined.buffers()[1], np.int64)[: len(own) + 1] if len(own) else np.zeros(1, np.int64)
    data, order, flat, counts = joined.buffers()[2], [], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for at in range(0, len(own), JOINED * 16):
        cuts = [(i, min(i + JOINED, len(own))) for i in range(at, min(at + JOINED * 16, len(own)), JOINED)]
        for (i, j), e in zip(cuts, library.encode_batch_fast([str(data[upto[i] : upto[j]], "utf-8") for i, j in cuts], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            begin = np.flatnonzero(opens[ids])
            if len(begin) == j - i and begin[0] == 0:
                order.append(own[i:j])
                flat.append(ids)
                counts.append(np.diff(begin, append=len(ids)))
            else:
                rest.append(own[i:j])
    rest = np.concatenate(rest)
    for at in range(0, len(rest), JOINED):
        alone = [e.ids for e in library.encode_batch_fast([x.decode() for x in pieces.take(pa.array(rest[at : at + JOINED])).to_pylist()], add_special_tokens=False)]
        flat.append(np.array([i for x in alone for i in x], np.uint32))
        counts.append(np.array([len(x) for x in alone], np.int64))
    number = np.zeros(len(pieces), np.int32)
    number[np.concatenate([*order, rest])] = np.arange(len(pieces), dtype=np.int32)
    upto = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
    return pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), pa.array(np.concatenate(flat), pa.uint32())).take(pa.array(number))


def _known(path: str | None, pieces: pa.Array, lists: pa.Array) -> None:
    """Keep the first KEPT pieces, of KEPT_BYTES at most, with their ids for the worker's next texts."""
    most = min(KEPT, int(np.searchsorted(np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1], KEPT_BYTES, "right")) - 1, len(pieces))
    worker_store()["pieces", path] = tuple(x if most == len(x) else x.take(pa.array(np.arange(most))) for x in (pieces, lists))


def encode_texts(texts: list[str] | pa.Array, path: str | None = None, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, as the library gives them for whole texts without special tokens, each with the end id if given; and how many each has.

    texts: strings, or an Arrow array of them without nulls.  Each distinct piece is encoded once, whatever number of
    texts hold it; pieces are compared as bytes.  A worker keeps the first pieces it met with their ids.
    """
    library, opens = tokenizer(path)
    texts = (pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts).cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    first = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first[0] : first[-1]]
    first = first - first[0]
    at = _pieces(raw, first[:-1][np.diff(first) > 0], b"".join(x.content.encode() for x in library.get_added_tokens_decoder().values()))
    found = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw)).astype(np.int64)), pa.py_buffer(raw)])
    known, lists = worker_store().get(("pieces", path)) or (pa.array([], pa.large_binary()), pa.array([], pa.large_list(pa.uint32())))
    which = np.zeros(0, np.int32)
    if len(at):
        found = pa.chunked_array([known, found]).dictionary_encode().chunks[-1]  # one dictionary, of known pieces first
        which = found.indices.to_numpy()
        if len(found.dictionary) > len(known):
            lists = pa.concat_arrays([lists, _encode_pieces(library, opens, found.dictionary.slice(len(known)))])
            _known(path, found.dictionary, lists)
    ends = np.searchsorted(at, first[1:])  # of each text's pieces
    if end is not None:
        which, ends = np.insert(which, ends, len(lists)), ends + np.arange(1, len(texts) + 1)
        lists = pa.concat_arrays([lists, pa.array([[end]], lists.type)])
    out = lists.take(pa.array(which))
    upto = out.offsets.to_numpy()
    return out.values.to_numpy(), np.diff(np.concatenate(([0], upto[ends])))


def pack_file(docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one file: the documents, then the coded ids."""
    null = np.array([d is None for d in docs], np.uint8)
    table_ = zlib.compress(null.tobytes() + np.array([d or 0 for d in docs], "<i8").tobytes() + np.array(lengths, "<u8").tobytes(), 1)
    return b"TOK1" + struct.pack("<QI", len(docs), len(table_)) + table_ + codec.encode(ids)


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, lengths and ids of a file."""
    if data[:4] != b"TOK1":
        raise codec.CorruptBlock("not a token file")
    n, size = struct.unpack_from("<QI", data, 4)
    raw = zlib.decompress(data[16 : 16 + size])
    null, docs, lengths = np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, "<i8", n, n), np.frombuffer(raw, "<u8", n, 9 * n)
    return [None if x else int(d) for x, d in zip(null, docs)], lengths.astype(np.int64), codec.decode(data[16 + size :])


def _write(path: str | None, end: int):
    def run(batches):
        file, part, docs, lengths, ids, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def out():
            whole = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            ids.clear()
            data = pack_file(docs, lengths, whole)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([part], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["file", "part", "n_docs", "n_ids", "payload"])

        def gathered():
            """Names and texts of slices of the batches, about SLICE bytes at a time."""
            names, texts, size = [], [], 0
            for whole in batches:
                for batch in slices(whole):
                    names += batch.column(0).to_pylist()
                    texts.append(batch.column(1).cast(pa.large_string()).fill_null(""))
                    size += batch.nbytes
                    if size >= SLICE:
                        yield names, pa.concat_arrays(texts)
                        names, texts, size = [], [], 0
            if names:
                yield names, pa.concat_arrays(texts)

        for names, texts in gathered():
            flat, counts = encode_texts(texts, path, end)
            taken = begin = 0
            for i, n in enumerate(counts.tolist()):
                if held and held + n > FILE_IDS:
                    ids.append(flat[begin:taken])
                    yield out()
                    part, docs, lengths, ids, held, begin = part + 1, [], [], [], 0, taken
                docs.append(names[i])
                lengths.append(n)
                held, taken = held + n, taken + n
            ids.append(flat[begin:taken])
        if docs:
            yield out()

    return run


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = END, mb: int = 6) -> None:
    """Write the files of docs (doc_id, text) in ascending doc_id as the Parquet table at folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(chunks_for(rows, mb), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows.mapInArrow(_write(path, end), "file long, part long, n_docs long, n_ids long, payload binary").write.parquet(folder)


def _read(batches):
    for batch in batches:
        for file, part, data in zip(*(batch.column(c).to_pylist() for c in ("file", "part", "payload"))):
            docs, lengths, ids = unpack_file(data)
            raw, ends = ids.astype("<u4"), np.cumsum(lengths)
            crc = [zlib.crc32(raw[b - n : b].tobytes()) for b, n in zip(ends, lengths)]
            k = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array([file] * k, pa.int64()), pa.array([part] * k, pa.int64()), pa.array(docs, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["file", "part", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; checksums are verified."""
    files = spark.read.parquet(folder)
    # a row a file, summed up in ranges of files, and the ranges' sums before them
    sizes = files.select("file", "part", "n_ids").withColumn("range", F.expr("file div 1024"))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("range").agg(F.sum("n_ids").alias("n_ids")).select("range", before(Window.orderBy("range")).alias("base"))
    starts = sizes.withColumn("own", before(Window.partitionBy("range").orderBy("file", "part"))).join(ranges, "range").select("file", "part", (F.col("base") + F.col("own")).alias("first"))
    found = files.select("file", "part", "payload").mapInArrow(_read, "file long, part long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["file", "part"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder)
