"""Order-dependent columns in two levels, so that a key with a third of all rows is spread over many tasks.

A slot is a stretch of the order (an hour, a day, a range of numbers).  What a row needs of
the rows before it is found within (key, slot), and what the slots before hand on is found
from one row a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _handed_on(slots: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, _slot, _before: the last value of the slots before that have one."""
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return slots.select(*keys, "_slot", F.last(value, ignorenulls=True).over(before).alias("_before"))


def _joined(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """rows with side's columns; null keys are keys as any other."""
    on = [rows[k].eqNullSafe(side[k]) for k in [*keys, "_slot"]]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return rows.join(side, condition).select(*(rows[c] for c in rows.columns), *(side[c] for c in side.columns if c not in (*keys, "_slot")))


def previous(rows: DataFrame, keys: list[str], slot: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with struct `name` (value: what the row before of its key has; null at the first row), in two levels; slot must rise with the order."""
    own = rows.withColumn("_slot", slot).withColumn("_v", F.struct(value.alias("value")))
    ends = own.groupBy(*keys, "_slot").agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    inside = own.withColumn("_in", F.lag("_v").over(Window.partitionBy(*keys, "_slot").orderBy(*order)))
    return _joined(inside, _handed_on(ends, keys, "_last"), keys).withColumn(name, F.coalesce("_in", "_before")).drop("_slot", "_v", "_in", "_before")


def running_sum(rows: DataFrame, keys: list[str], slot: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with `name`, the sum of value over the rows of its key up to the row, in two levels; slot must rise with the order."""
    own = rows.withColumn("_slot", slot).withColumn("_v", value)
    sums = own.groupBy(*keys, "_slot").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_slot", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _joined(own.withColumn("_in", F.sum("_v").over(here)), sums, keys).withColumn(name, F.col("_before") + F.col("_in")).drop("_slot", "_v", "_in", "_before")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, slot, values: list[str], tie: list[str], strict: bool = True) -> DataFrame:
    """left with struct `as_of` (values): the latest row of right with the same keys before its time (or at it, if not strict); null without one.

    The sides are put in one order and the last right row is handed on, so nothing is paired: a key's
    rows meet by slot (slot: a function of the time's Column, rising with it).  Among right rows of
    one time the last by `tie` counts.  Null keys and times meet nothing.
    """
    taken = F.struct(*values)
    columns = [F.col(c) for c in left.columns]
    known = left.where(" and ".join(f"{c} is not null" for c in [*keys, at]))
    one = known.select(*keys, F.col(at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.struct(*columns).alias("_row"), F.lit(None).cast(right.select(taken.alias("x")).schema["x"].dataType).alias("_v"), *(F.lit(None).cast(right.schema[t].dataType).alias(f"_tie{i}") for i, t in enumerate(tie)))
    two = right.where(" and ".join(f"{c} is not null" for c in [*keys, at])).select(*keys, F.col(at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), taken.alias("_v"), *(F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie)))
    both = one.unionByName(two).withColumn("_slot", slot(F.col("_at")))
    order = ["_at", "_side", *(f"_tie{i}" for i in range(len(tie)))]
    ends = both.groupBy(*keys, "_slot").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last"))
    here = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_in", F.last("_v", ignorenulls=True).over(here)).where("_row is not null")
    out = _joined(inside, _handed_on(ends, keys, "_last"), keys).select("_row.*", F.coalesce("_in", "_before").alias("as_of"))
    rest = left.where(" or ".join(f"{c} is null" for c in [*keys, at])).withColumn("as_of", F.lit(None).cast(out.schema["as_of"].dataType))
    return out.unionByName(rest)
