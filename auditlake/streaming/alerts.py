"""Alerts to every channel, once each: what a micro-batch has sent is on record under its number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of an alert's text that the record keeps.
KEPT = 500
SENT = "alert_id string, site long, kind string, subject string, body string, channel string, ok boolean, error string, batch long"


def fanned_out(alerts: DataFrame, channels: list[str]) -> DataFrame:
    """One row for each alert and channel; without channels, one for the console, so that no alert is lost."""
    names = channels or ["console"]
    return alerts.withColumn("channel", F.explode(F.array(*map(F.lit, names))))


def recorder(path: str, channels: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: sends a batch's alerts (alert_id, site, kind, subject, body) by every channel and records what came of it.

    A channel is a function from rows to rows with ok and error.  path: a folder that driver and executors share;
    batch n is its folder batch=n, which is written once: a batch that the stream replays after a restart is left
    alone if it is on record, and written whole again if the record broke off.  An alert may then be sent
    a second time (a channel tells by alert_id); its record is one row for each channel.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        files = spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = files.Path(f"{path}/batch={n}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(files.Path(folder, "_SUCCESS")):
            return
        console = lambda df: df.withColumns({"ok": F.lit(True), "error": F.lit(None).cast("string")})
        rows = fanned_out(batch.dropDuplicates(["alert_id"]), list(channels))
        sent = None
        for name in channels or {"console": console}:
            own = channels.get(name, console)(rows.where(F.col("channel") == name))
            sent = own if sent is None else sent.unionByName(own)
        detail = F.coalesce("error", F.substring("body", 1, KEPT))
        sent.select("alert_id", "site", "kind", "channel", "ok", "subject", detail.alias("detail")).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write
