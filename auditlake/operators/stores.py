"""Saved pages: markup by address, compressed, the first one of each kept; statistics, and reading back."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.urls import absolute_key

#: Bytes of markup that are saved at most, and how hard it is compressed.
MOST_BYTES, LEVEL = 4 * 1024 * 1024, 6


def saved(pages: DataFrame) -> DataFrame:
    """crawl, url_key, page_id, raw_bytes of the pages (crawl, page_id, url, html) that are saved: with markup, not too large, the first of an address."""
    rows = pages.select("crawl", "page_id", absolute_key(F.col("url")).alias("url_key"), F.octet_length("html").cast("long").alias("raw_bytes")).where(F.col("raw_bytes").between(1, MOST_BYTES))
    first = rows.groupBy("crawl", "url_key").agg(F.min(F.struct("page_id", "raw_bytes")).alias("f"))
    return first.select("crawl", "url_key", "f.page_id", "f.raw_bytes")


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):  # a few pages at a time
            part = batch.slice(i, 64)
            data = [gzip.compress(x.encode(), LEVEL, mtime=0) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("crawl", "url_key", "page_id", "raw_bytes")), pa.array(data, pa.binary())], ["crawl", "url_key", "page_id", "raw_bytes", "gzipped"])


def snapshots(pages: DataFrame) -> DataFrame:
    """saved pages with their markup compressed (gzipped) and gzip_bytes.  Ids choose the markup, which is not shuffled where they are few."""
    kept = saved(pages)
    rows = pages.select("crawl", "page_id", "html").join(kept, ["crawl", "page_id"])
    out = rows.mapInArrow(_pressed, "crawl long, url_key string, page_id long, raw_bytes long, gzipped binary")
    return out.withColumn("gzip_bytes", F.octet_length("gzipped").cast("long"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            text = [gzip.decompress(x).decode() for x in part.column("gzipped").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("crawl"), part.column("url_key"), pa.array(text, pa.string())], ["crawl", "url_key", "html"])


def loaded(store: DataFrame, asked: DataFrame) -> DataFrame:
    """crawl, url_key, html of the saved pages asked for (crawl, url)."""
    keys = asked.select("crawl", absolute_key(F.col("url")).alias("url_key")).distinct()
    return store.join(keys, ["crawl", "url_key"], "left_semi").select("crawl", "url_key", "gzipped").mapInArrow(_read, "crawl long, url_key string, html string")


def snapshot_stats(store: DataFrame) -> DataFrame:
    """crawl, pages, raw_bytes of every crawl's saved pages."""
    return store.groupBy("crawl").agg(F.count("*").alias("pages"), F.sum("raw_bytes").alias("raw_bytes"))
