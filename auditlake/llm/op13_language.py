"""Language identification with string kernels.

The kernel of two texts is the blended spectrum of presence: how many different n-grams of 1 to
3 bytes both have, over the root of the product of how many each has.  Texts are read in
lower case; everything in ASCII that is no letter is a space and spaces stand alone.

Landmarks (`landmarks` texts a language) span a subspace: with K the kernel among them, a text's
Nyström features are its kernel with the landmarks times K to the power -1/2.  The n-grams
that count are those of the landmarks (at most `grams`, those in most landmarks), so a kernel
with all landmarks is one product of matrices: presence of n-grams (texts x n-grams) with
presence in landmarks (n-grams x landmarks).

One ridge regression a language, against the rest, is fitted on the features of the sample: the
sums that it needs (features x features, features x languages) are made by the tasks, a few
hundred numbers square.  Every text is then scored in batches: presence x landmarks x
coefficients; the largest figure names the language.

Learned from: text and lang (not null) of rows whose crc32 of doc_id, as text, modulo 3 is not
`held_out`.  The sample is bounded: `per_lang` rows at most of each of the `languages` most
frequent languages, chosen by a hash of doc_id and text; the first `landmarks` of them are the
landmarks (fewer where there are many languages, 512 in all).  All other rows are only predicted.

Defined results: null text and text without a letter is `und` with score 0; no learned language
gives `und`; a null doc_id counts as an empty one and is not held out; equal figures go to the
smaller language by code point; repeated rows count once in the sample and are predicted each
time; a text of any length is read whole, in pieces of a bounded size; other columns are not
read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, table, worker_store

LANDMARKS, PER_LANG, LANGUAGES, GRAMS, RIDGE, HELD_OUT = 32, 400, 256, 24_000, 1e-3, 1
#: Landmarks of all languages together, at most.
ALL_LANDMARKS = 512
#: Texts of one product, and bytes of a text that are looked up at once.
BATCH, PIECE = 128, 1 << 20
LONGEST = 3


def plain_table() -> bytes:
    """Of every byte: itself if it is a small letter or beyond ASCII, else a space."""
    return bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain(text: str, letters: bytes) -> bytes:
    """The text as the kernel reads it, with one space at both ends."""
    return b" " + b" ".join(text.lower().encode().translate(letters).split()) + b" "


def codes(raw: np.ndarray) -> list[np.ndarray]:
    """Numbers of the n-grams of 1, 2 and 3 bytes at every place; each length has numbers of its own."""
    b = raw.astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    return [b, two + 256, ((two[:-1] << 8) | b[2:]) + 65_792]


def gram_set(text: str, letters: bytes) -> np.ndarray:
    """The different n-grams of a text, as sorted numbers."""
    raw, found = np.frombuffer(plain(text, letters), np.uint8), np.zeros(0, np.uint32)
    for at in range(0, len(raw), PIECE):
        found = np.unique(np.concatenate([found, *codes(raw[at : at + PIECE + LONGEST - 1])]))
    return found


def is_held_out(doc_id: Column, remainder: int = HELD_OUT) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == remainder


def sample(docs: DataFrame, per_lang: int = PER_LANG, languages: int = LANGUAGES) -> DataFrame:
    """lang, n (1 to per_lang by hash), text of the rows that are learned from; cut, as they are read more than once."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(languages)
    # twice as many as wanted pass the hash on average, so a language with enough rows falls short next to never
    h = F.xxhash64("doc_id", "text")
    share = F.pmod(h, F.lit(1 << 40)) / float(1 << 40)
    some = known.withColumn("h", h).join(F.broadcast(sizes), "lang").where(share <= 2.0 * per_lang / F.col("rows"))  # `languages` rows
    some = some.groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h", "doc_id")
    return cut(some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_lang).select("lang", "n", "text"))


def _gram_rows(letters: bytes, batch: pa.RecordBatch) -> pa.RecordBatch:
    grams = [gram_set(t, letters) for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("n"), pa.array(grams, pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))], ["lang", "n", "grams"])


def _chosen_bits(chosen: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    bits = [np.packbits(np.isin(chosen, x.values.to_numpy(zero_copy_only=False))).tobytes() for x in batch.column("grams")]
    return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("n"), pa.array(bits, pa.binary())], ["lang", "n", "bits"])


def _tables(model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The column of every n-gram's number (the last column is for those that do not count) and presence in landmarks; both live as long as the worker."""
    kept, grams = worker_store(), model["grams"]
    key = ("language", hash(grams.tobytes()), hash(model["landmarks"]))
    if key not in kept:
        place = np.full(256 + 65_536 + (1 << 24), len(grams), np.uint16)
        place[grams] = np.arange(len(grams))
        kept[key] = place, np.unpackbits(np.frombuffer(model["landmarks"], np.uint8), count=len(grams) * len(model["sizes"])).reshape(len(grams), -1).astype(np.float32)
    return kept[key]


def presence(texts: list[bytes], place: np.ndarray, width: int) -> np.ndarray:
    """texts x n-grams: 1 where a text has an n-gram.  Texts are looked up together, in pieces."""
    out = np.zeros((len(texts), width + 1), np.float32)
    flat, at = out.reshape(-1), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
            size += len(texts[end])
            end += 1
        raw = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        row = np.repeat(np.arange(at, end, dtype=np.int64) * (width + 1), [len(t) for t in texts[at:end]])
        for s in range(0, len(raw), PIECE):
            piece, own = raw[s : s + PIECE + LONGEST - 1], row[s : s + PIECE + LONGEST - 1]
            for n, code in enumerate(codes(piece)):
                # texts begin and end with a space, so an n-gram over two texts holds two spaces and never counts
                flat[own[: len(code)] + place[code]] = 1
        at = end
    out[:, width] = 0
    return out


def kernel(texts: list[bytes], model: dict) -> np.ndarray:
    """texts x landmarks: the kernel of each text with each landmark."""
    place, landmarks = _tables(model)
    have = presence(texts, place, len(landmarks))
    own = np.maximum(have.sum(axis=1, dtype=np.float64), 1)
    return (have[:, :-1] @ landmarks) / np.sqrt(own[:, None] * model["sizes"][None, :])


def _sums(letters: bytes, model: dict, batches):
    """What the regressions need of this task's rows: features x features, features x languages (1, or -1 for the rest)."""
    m, names = len(model["sizes"]), {x: i for i, x in enumerate(model["languages"])}
    square, sides = np.zeros((m, m)), np.zeros((m, len(names)))
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            f = kernel([plain(t, letters) for t in part.column("text").to_pylist()], model) @ model["root"]
            y = -np.ones((len(f), len(names)))
            y[np.arange(len(f)), [names[x] for x in part.column("lang").to_pylist()]] = 1
            square += f.T @ f
            sides += f.T @ y
    yield pa.RecordBatch.from_arrays([pa.array([square.tobytes()], pa.binary()), pa.array([sides.tobytes()], pa.binary())], ["square", "sides"])


def fit(docs: DataFrame, landmarks: int = LANDMARKS, per_lang: int = PER_LANG, languages: int = LANGUAGES, grams: int = GRAMS, ridge: float = RIDGE) -> dict:
    """The model: languages, grams, landmarks (bits of n-grams x landmarks), sizes, root (K to the power -1/2), coefficients."""
    if grams > 65_535:
        raise ValueError("at most 65,535 n-grams")
    letters, known = plain_table(), sample(docs, per_lang, languages)
    names = sorted(r.lang for r in known.select("lang").distinct().collect())  # at most `languages`
    most = max(1, min(landmarks, ALL_LANDMARKS // max(len(names), 1)))
    rows = cut(arrow_map(known.where(F.col("n") <= most).select("lang", "n", "text"), partial(_gram_rows, letters), "lang string, n int, grams array<long>"))
    in_most = rows.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(grams)
    spaced = [np.arange(256) << 16 | 0x2020, 0x202000 | np.arange(256)]  # two spaces stand only between two texts
    chosen = np.setdiff1d([r.gram for r in in_most.select("gram").collect()], [0x2020 + 256, *(np.concatenate(spaced) + 65_792)]).astype(np.int64)  # at most `grams`
    model = {"languages": names, "grams": chosen}
    if not names or not len(chosen):
        return model | {"languages": []}
    bits = arrow_map(rows, partial(_chosen_bits, chosen), "lang string, n int, bits binary").collect()  # a bit for each landmark and n-gram: 1.5 MB at most
    have = np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8), count=len(chosen)) for r in sorted(bits, key=lambda r: (r.lang, r.n))], axis=1).astype(np.float32)
    sizes = np.maximum(have.sum(axis=0, dtype=np.float64), 1)
    among = (have.T @ have).astype(np.float64) / np.sqrt(sizes[:, None] * sizes[None, :])
    value, vector = np.linalg.eigh(among)
    stable = value > 1e-6 * value.max()  # landmarks that are alike add no direction
    model |= {"landmarks": np.packbits(have.astype(bool)).tobytes(), "sizes": sizes, "root": vector[:, stable] / np.sqrt(value[stable]) @ vector[:, stable].T}
    sums = known.select("lang", "text").mapInArrow(partial(_sums, letters, model), "square binary, sides binary").collect()  # one row a task, a few hundred numbers square
    m = len(sizes)
    square = sum((np.frombuffer(r.square).reshape(m, m) for r in sums), np.zeros((m, m)))
    sides = sum((np.frombuffer(r.sides).reshape(m, len(names)) for r in sums), np.zeros((m, len(names))))
    rows_seen = max(known.count(), 1)
    model["coefficients"] = np.linalg.solve(square + ridge * rows_seen * np.eye(m), sides)
    return model


def _predicted(letters: bytes, model: dict, batch: pa.RecordBatch) -> pa.RecordBatch:
    names, texts = model["languages"], batch.column("text").to_pylist()
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    real = [i for i, t in enumerate(texts) if names and t and any(map(str.isalpha, t))]
    for at in range(0, len(real), BATCH):
        rows = real[at : at + BATCH]
        figures = kernel([plain(texts[i], letters) for i in rows], model) @ model["root"] @ model["coefficients"]
        best = figures.argmax(axis=1)
        for i, k, f in zip(rows, best, figures[np.arange(len(rows)), best]):
            lang[i], score[i] = names[k], min(max((f + 1) / 2, 0.0), 1.0)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return arrow_map(rows, partial(_predicted, plain_table(), model), "doc_id long, held_out boolean, lang_pred string, score double")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
