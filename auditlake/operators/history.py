"""Reports on history tables: polls, quotas, ranks, traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators import slots


def running_number(rows: DataFrame, group: list[str], slot: Column, *order: str) -> DataFrame:
    """rows with n, the running number of a row in its group by (slot, order), in two levels.

    slot must rise with the order.  Rows are numbered within (group, slot), and the slots' counts
    are summed up before them, so a group with a third of all rows is spread over its slots.
    """
    slotted = rows.withColumn("_slot", slot)
    counts = slotted.groupBy(*group, "_slot").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_slot", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy(*group, "_slot").orderBy(*order)
    out = slotted.withColumn("_n", F.row_number().over(here)).join(counts, [*group, "_slot"])
    return out.withColumn("n", F.col("_before") + F.col("_n")).drop("_slot", "_n", "_before")


def quota_ledger(calls: DataFrame, limit: int) -> DataFrame:
    """calls (provider, ts, id) with period, n and allowed: the first `limit` calls of a provider's month."""
    rows = calls.withColumn("period", F.date_format("ts", "yyyy-MM"))
    out = running_number(rows, ["provider", "period"], F.date_trunc("hour", "ts"), "ts", "id")
    return out.withColumn("allowed", F.col("n") <= limit)


def _day(polls: DataFrame) -> Column:
    """The day of a poll's time, or of its number of seconds."""
    return F.date_trunc("day", "at") if "timestamp" in polls.schema["at"].dataType.simpleString() else F.floor(F.col("at") / 86_400)


def uptime_transitions(polls: DataFrame) -> DataFrame:
    """polls (site, at, id, ok) with transition: none, went-down, still-down or recovered.  Null ok counts as down."""
    rows = slots.previous(polls, ["site"], _day(polls), ["at", "id"], F.coalesce("ok", F.lit(False)), "_was")
    ok, before = F.coalesce("ok", F.lit(False)), F.coalesce("_was.value", F.lit(True))
    return rows.withColumn("transition", F.when(ok & before, "none").when(ok, "recovered").when(before, "went-down").otherwise("still-down")).drop("_was")


def content_changes(polls: DataFrame) -> DataFrame:
    """The polls (site, at, id, body_hash) whose body differs from the one before of the site; null equals null."""
    rows = slots.previous(polls, ["site"], _day(polls), ["at", "id"], F.col("body_hash"), "_was").where("_was is not null")
    return rows.withColumn("previous", F.col("_was.value")).drop("_was").where(~F.col("previous").eqNullSafe(F.col("body_hash")))


def incidents(polls: DataFrame) -> DataFrame:
    """site, island, started_at, last_at, failure_count of every run of polls (site, at, id, bad) that are bad: the runs are told apart by how many good polls came before."""
    good = F.when(F.col("bad"), 0).otherwise(1)
    runs = slots.running_sum(polls, ["site"], _day(polls), ["at", "id"], good, "island").where("bad")
    return runs.groupBy("site", "island").agg(F.min("at").alias("started_at"), F.max("at").alias("last_at"), F.count("*").alias("failure_count"))


def rank_kpis(latest: DataFrame) -> DataFrame:
    """One row over keywords' latest positions: keywords, ranked, top_10, mean_position."""
    return latest.agg(F.count("*").alias("keywords"), F.count("position").alias("ranked"), F.count_if(F.col("position") <= 10).alias("top_10"), F.round(F.avg("position"), 4).alias("mean_position"))


def path_key(path: Column) -> Column:
    """Path of an analytics row: no host, query or fragment, one leading slash, none at the end, lower case."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    full = F.when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(F.lit("/"), bare))
    return F.lower(F.when(F.length(full) > 1, F.regexp_replace(full, "/$", "")).otherwise(full))


def by_path(rows: DataFrame) -> DataFrame:
    """Analytics rows (path, pageviews, sessions, bounce_rate, avg_duration_sec) summed by path key.

    Rates are weighted by sessions; a path of one row keeps its rates as they are.
    """
    weight = F.greatest(F.sum("sessions"), F.lit(1))
    rate = lambda c: F.when(F.count("*") == 1, F.max(c)).otherwise(F.sum(F.col(c) * F.col("sessions")) / weight).alias(c)
    return rows.withColumn("path", path_key(F.col("path"))).groupBy("path").agg(F.sum("pageviews").alias("pageviews"), F.sum("sessions").alias("sessions"), rate("bounce_rate"), rate("avg_duration_sec"))


def top_decile(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of rows not below the value at place max(1, ceil(n / 10)) from the top, of those above 0.

    The place is found in counts by value, numbered in two levels, not by a sort in one task.
    """
    above = rows.where(F.col(value) > 0).select(key, value)
    counts = above.groupBy(value).agg(F.count("*").alias("c"))
    slot = counts.withColumn("slot", F.ceil(F.log2(value) * 64))
    slots = slot.groupBy("slot").agg(F.sum("c").alias("sc"))  # at most 64 for each doubling of the value
    place = F.greatest(F.lit(1), F.ceil(F.sum("sc").over(Window.partitionBy(F.lit(0))) / 10))
    slots = slots.select("slot", F.sum("sc").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("slot"))).alias("upto"), "sc", place.alias("place"))
    hit = slots.where("upto >= place and upto - sc < place")
    inside = slot.join(F.broadcast(hit), "slot")  # one row
    inside = inside.withColumn("reach", F.col("upto") - F.col("sc") + F.sum("c").over(Window.partitionBy("slot").orderBy(F.desc(value))))
    least = inside.where("reach >= place").agg(F.max(value).alias("least"))
    return above.join(F.broadcast(least), F.col(value) >= F.col("least")).select(key, value)  # one row
