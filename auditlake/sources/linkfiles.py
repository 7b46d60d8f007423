"""Exported lists of linking pages: lines of many files to (source, target) addresses, in Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a header's cells have, and what names the target's.
HEADER, TARGET = "link|url|page", "target|linked page"


def cells(line: Column) -> Column:
    """The cells of a line: commas within quotes are no ends, a doubled quote within quotes is one.

    Between quotes the line is outside, inside, outside and so on; an empty piece outside, between two
    pieces inside, is what a doubled quote leaves.
    """
    pieces = F.split(line, '"')
    last = F.size(pieces) - 1
    kept = F.transform(pieces, lambda x, i: F.when(i % 2 == 1, x).when((x == "") & (i > 0) & (i < last), F.lit('"')).otherwise(F.replace(x, F.lit(","), F.lit("\x01"))))
    return F.transform(F.split(F.array_join(kept, ""), "\x01"), lambda x: F.trim(x))


def link_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at, line of every line that is not blank; files may be read in splits, at rises with the place in the file."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no")).alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    return text.where("trim(line) <> ''")


def links(lines: DataFrame) -> DataFrame:
    """file, at, source, target of every line (file, at, line) whose first cell is an address.

    A file's first line is its header if one of its cells reads like one; the column of targets is sought in it
    either way.  One row a file is joined to its lines.
    """
    heads = lines.groupBy("file").agg(F.min(F.struct("at", "line")).alias("h"))
    names = F.transform(cells(F.col("h.line")), lambda x: F.lower(x))
    spot = F.get(F.filter(F.transform(names, lambda x, i: F.when(x.rlike(TARGET), i)), lambda i: i.isNotNull()), F.lit(0))
    heads = heads.select(F.col("file"), F.col("h.at").alias("_first"), F.exists(names, lambda x: x.rlike(HEADER)).alias("_header"), F.when(spot > 0, spot).alias("_spot"))
    rows = lines.join(heads, "file").where(~(F.col("_header") & (F.col("at") == F.col("_first"))))
    rows = rows.withColumn("_cells", cells(F.col("line")))
    address = "(?i)^https?://"
    source, target = F.get("_cells", F.lit(0)), F.get("_cells", F.col("_spot"))
    return rows.where(source.rlike(address)).select("file", "at", source.alias("source"), F.when(target.rlike(address), target).alias("target"))
