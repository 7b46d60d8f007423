"""Upserts as joins of a table with a batch: what a row becomes when its key is there already.

`merged` gives the rows as they are after the batch; each column has its rule.  `write_merged`
keeps such a table in a folder of files: keys are hashed to buckets, a batch rewrites only the
buckets that it touches, in a folder of its own, and one rename of a small file makes them the
table's.  A batch that is written again changes nothing, one that breaks off leaves the table as
it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: keep: what the row had first stays; new: the batch's last value counts, also null; filled: its last value that is not null, else the old one; add: values are summed up.
RULES = ("keep", "new", "filled", "add")


def merged(table: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, str], order: list[str], nulls_equal: bool = False) -> DataFrame:
    """table (keys and the columns of rules) after the rows of batch (those and order) have been put in, one after another.

    One aggregation with partial sums, so a key with most of a batch is no task's.  Unless nulls_equal, a
    row with a null among its keys meets no other, as in a unique constraint, and is put in as it is.
    """
    if set(rules.values()) - set(RULES):
        raise ValueError(f"rules are {RULES}")
    columns = [*keys, *rules]
    old = table.select(*columns, F.struct(F.lit(0).alias("_new"), *(F.lit(None).cast(batch.schema[c].dataType).alias(f"_{c}") for c in order)).alias("_at"))
    rows = old.unionByName(batch.select(*columns, F.struct(F.lit(1).alias("_new"), *(F.col(c).alias(f"_{c}") for c in order)).alias("_at")))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    meets = rows if nulls_equal else rows.where(whole)
    value: dict[str, Callable[[str], Column]] = {
        "keep": lambda c: F.min_by(F.struct(c), "_at")[c],
        "new": lambda c: F.max_by(F.struct(c), "_at")[c],
        "filled": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))),
        "add": lambda c: F.sum(c),
    }
    out = meets.groupBy(*keys).agg(*(value[r](c).cast(table.schema[c].dataType).alias(c) for c, r in rules.items()))
    return out if nulls_equal else out.unionByName(rows.where(~whole).select(*columns))


def absent_added(table: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """table and the rows of batch whose keys it has not, the first one of each."""
    return merged(table, batch, keys, {c: "keep" for c in table.columns if c not in keys}, order)


class _Files:
    """The small file that says which folders are the table's; it is replaced by one rename."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.jvm, self.path, conf = jvm, path, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = jvm.org.apache.hadoop.fs.FileSystem.get(jvm.org.apache.hadoop.fs.Path(path).toUri(), conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def read(self) -> dict:
        at = self._path("current.json")
        if not self.fs.exists(at):
            return {"buckets": {}, "batches": [], "count": None}
        stream = self.fs.open(at)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def switch(self, state: dict) -> None:
        new = self._path(f"next-{uuid.uuid4().hex}.json")
        stream = self.fs.create(new, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        over = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        renames = _array(self.jvm, "org.apache.hadoop.fs.Options$Rename", [over])
        self.context.rename(new, self._path("current.json"), renames)


def _array(jvm, kind: str, values: list):
    out = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName(kind), len(values))
    for i, v in enumerate(values):
        jvm.java.lang.reflect.Array.set(out, i, v)
    return out


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table's rows as of its last whole batch."""
    return _rows(spark, path, _Files(spark, path).read(), None, schema)


def _rows(spark: SparkSession, path: str, state: dict, only: list[int] | None, schema) -> DataFrame:
    at = [f"{path}/{folder}/_bucket={b}" for b, folder in state["buckets"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)


def write_merged(path: str, batch: DataFrame, name: str, keys: list[str], rules: dict[str, str], order: list[str], buckets: int = 64) -> bool:
    """Puts batch into the table at path; false where a batch of that name is in it already.

    path must be one that driver and executors share.  One writer at a time; readers see the table before or after.
    """
    spark, files = batch.sparkSession, _Files(batch.sparkSession, path)
    state = files.read()
    if name in state["batches"]:
        return False
    buckets = state["count"] or buckets
    columns = [*keys, *rules]
    schema = batch.select(*columns).schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # `buckets` at most
    new = merged(_rows(spark, path, state, touched, schema), batch, keys, rules, order)
    folder = f"rows-{uuid.uuid4().hex}"
    new.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    files.switch({"buckets": state["buckets"] | {str(b): folder for b in touched}, "batches": [*state["batches"], name], "count": buckets})
    return True
