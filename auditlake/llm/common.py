"""Helpers that several operators of this subpackage share.

A *word* everywhere is a maximal run of characters other than U+0020 and
U+0009..U+000D.  On UTF-8 bytes that is exactly what ``bytes.split()`` returns,
because its white space is those six ASCII characters.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=U64)
_BYTE[_SPACE] = 0
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = U64(0x9E3779B97F4A7C15)
_powers = np.ones(1, U64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 256), _STEP, U64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3; a bijection."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and where each text's words begin (one more than texts).

    Works on slices of texts of about 1 MB so that the temporaries stay in cache.
    """
    table, parts, counts, at = (_BYTE_LOWER if lower else _BYTE), [], [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < 1 << 20):
            size += len(texts[end]) + 1
            end += 1
        raw = np.frombuffer(b"\n".join(texts[at:end]) + b"\n", np.uint8)
        gap = _SPACE[raw]
        starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[at:end]])
        counts.append(np.diff(np.searchsorted(starts, begin)))
        if len(starts):
            raw = raw[starts[0] :]
            starts = starts - starts[0]
            lengths = np.diff(np.append(starts, len(raw)))
            inside = np.arange(len(raw)) - np.repeat(starts, lengths)
            values = table[raw]
            values *= _powers_to(int(lengths.max()) + 1)[inside]
            parts.append(mix(np.add.reduceat(values, starts)))
        at = end
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), offsets.astype(np.int64)


def rolling(hashes: np.ndarray, k: int, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of all windows of k consecutive entries; windows may cross texts, the caller masks those."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= U64(factor)
        out += hashes[j : j + n]
    return mix(out)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def letter_table() -> bytes:
    """Of every byte: itself, capitals of ASCII in lower case, if it is a digit, a letter or beyond ASCII, else a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plan_bytes(df: DataFrame, row: int = 4096) -> int:
    """Spark's own estimate of the rows' size, from file sizes where it reads files; else counted rows."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else row * df.count()


def chunks_for(df: DataFrame, mb: int = 8, least: int = 12) -> int:
    """How many chunks of about so many (stored) MB the rows make."""
    return max(least, -(-plan_bytes(df) // (mb << 20)))


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names.

    parts: at most so many files (from the size of the input, so a small table is not spread
    over as many as the shuffle before it had; never more than it has).
    """
    shared_dir(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint()


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df marked for broadcast if a count finds at most so many rows, else as it is, for a shuffled join.

    df must be cut or cheap, as it is counted here; its rows are a few numbers wide.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Ids that are broadcast at most: some 16 MB.
ID_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables, which driver and executors share.

    It is the one the session names in spark.checkpoint.dir, also where that was set after the
    start.  Only on a local master, as in tests, is a folder of this machine used where it is unset.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), in the JVM."""
    return F.coalesce(F.size(F.array_remove(F.split(text, WORD_GAP), "")), F.lit(0)).cast("long")


#: Bytes of a batch that a Python function gets at once, unless one row alone has more.
SLICE = 8 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of SLICE bytes at most, or single rows."""
    if batch.num_rows > 1 and batch.nbytes > SLICE:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half))
        yield from slices(batch.slice(half))
    elif batch.num_rows:
        yield batch


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with a function from one record batch to one; batches come in slices, so memory is bounded, and empty ones are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, for what is slow to load."""
    import sys
    import types

    name = "_auditlake_worker_store"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].kept = {}
    return sys.modules[name].kept
