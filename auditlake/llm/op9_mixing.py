"""Mixing sources to target weights by capped water-filling.

Sources in the order of their names (code points, null last) get weights by a repeating
pattern and share BUDGET times all words.  A source's target stops at CAP times its size;
what is over is shared among the others by weight until none is above its cap.  With
sources ordered by cap / weight the capped ones are a prefix, so prefix sums over the table
of sources give that fixed point without a loop.

A target of e epochs takes floor(e) whole repetitions of every document and the rest from
documents in the order of a seeded hash, until the words are used up: the last one gives
only its first words.  The place where that happens is found from sums over hash ranges
(at most 65,536 a source) and then inside one range, so a hot source is never sorted in one
task, texts are not shuffled, and a source's taken words equal its target rounded.

Defined results: a null or wordless text has size 0 and is taken as often as whole
repetitions say, with 0 words; a null source is a source of its own; rows of one doc_id in
one source share a hash and are cut alike, those of a null doc_id too; equal hashes go by
doc_id; a text of any length counts whole; other columns pass through whatever their names.
No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, cut, small, table, word_count

WEIGHTS, BUDGET, CAP, SEED = (5, 2, 1), 1.5, 2, 20240611


def targets(totals: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """source, source_size, target of every row of totals (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    t = totals.withColumn("weight", w).withColumn("cap", cap * F.col("source_size"))
    rank = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, every = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))
    left = budget * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    t = t.withColumn("level", left / F.sum("weight").over(after)).withColumn("place", F.row_number().over(rank))
    free = F.col("cap") > F.col("level") * F.col("weight")
    first = F.min(F.when(free, F.struct("place", "level"))).over(every)
    target = F.when(first.isNull() | (F.col("place") < first["place"]), F.col("cap")).otherwise(first["level"] * F.col("weight"))
    return t.select("source", "source_size", target.cast("double").alias("target"))


OUT = ("_size", "_source_size", "_target", "_whole", "_extra")


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """docs with _size, _source_size, _target, _whole (repetitions) and _extra (words beyond them), which replace columns of these names; see the module."""
    return _mixed(docs, weights, budget, cap, seed).select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in OUT), *OUT)


def _mixed(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """_doc (the columns of docs, as one struct so that no name can clash), text and OUT of every row."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    keyed = docs.select(whole, "doc_id", "source", "text").withColumn("_size", word_count(F.col("text"))).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    keyed = keyed.withColumn("_range", F.shiftright("_h", 48).cast("int"))
    sums = cut(keyed.groupBy("source", "_range").agg(F.sum("_size").alias("n")))
    plan = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, budget, cap)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("more", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))
    p = plan.select(F.col("source").alias("_s"), "whole", "more", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("_range")))
    running = running.join(p, F.col("source").eqNullSafe(F.col("_s")))
    edge = running.where((F.col("upto") >= F.col("more")) & (F.col("upto") - F.col("n") < F.col("more")))
    edge = edge.select("_s", F.col("_range").alias("_r"), (F.col("more") - F.col("upto") + F.col("n")).alias("need"))
    inside = keyed.select("source", "doc_id", "_h", "_size", "_range").join(small(cut(edge)), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    inside = inside.groupBy("_s", "_h", "doc_id", "need").agg(F.sum("_size").alias("n"))
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("_s").orderBy("_h", F.col("doc_id").asc_nulls_first())))
    last = inside.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    last = last.select(F.col("_s").alias("_ls"), F.col("_h").alias("_lh"), F.col("doc_id").alias("_ld"), (F.col("need") - F.col("upto") + F.col("n")).alias("_part"), F.col("n").alias("_of"))
    p = cut(p.join(last, F.col("_s").eqNullSafe(F.col("_ls")), "left"))
    out = keyed.join(small(p), F.col("source").eqNullSafe(F.col("_s")), "left")
    here = (F.col("_h") == F.col("_lh")) & F.col("doc_id").eqNullSafe(F.col("_ld"))
    earlier = (F.col("_h") < F.col("_lh")) | ((F.col("_h") == F.col("_lh")) & (F.coalesce("doc_id", F.lit(-(1 << 63))) < F.coalesce("_ld", F.lit(-(1 << 63)))))
    extra = F.when(F.col("_lh").isNull(), 0).when(here, F.floor(F.col("_part") * F.col("_size") / F.col("_of"))).when(earlier, F.col("_size")).otherwise(0).cast("long")
    return out.select("_doc", "text", "_size", "_source_size", "_target", F.coalesce("whole", F.lit(0)).alias("_whole"), extra.alias("_extra"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: a row for each repetition, the part of a document as its first words; columns of docs.

    A wordless document stays once: it takes no words from any target.
    """
    m = _mixed(docs)
    full = F.col("_whole") + F.when((F.col("_extra") > 0) & (F.col("_extra") == F.col("_size")), 1).otherwise(0)
    full = F.when(F.col("_size") == 0, 1).otherwise(full).cast("int")
    part = F.array_join(F.slice(F.array_remove(F.split("text", WORD_GAP), ""), F.lit(1), F.col("_extra").cast("int")), " ")
    reps = F.concat(F.array_repeat("text", full), F.when((F.col("_extra") > 0) & (F.col("_extra") < F.col("_size")), F.array(part)).otherwise(F.array().cast("array<string>")))
    rows = m.withColumn("_text", F.explode(reps))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_text") == F.col("text"), F.col("_doc.n_chars")).otherwise(F.length("_text")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*((new[c] if c in new else F.col("_doc").getField(c)).alias(c) for c in docs.columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return m.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_whole") * F.col("_size") + F.col("_extra")).alias("taken"))
