"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool, parts: int | None) -> DataFrame:
    """One star step.  Every node's smallest neighbour is an aggregate joined back, so a hub is never one group in Python or a list.

    Repeated edges may come out; they change no minimum and are dropped once a round.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = both.join(least, "u")
    near = near.coalesce(parts) if parts else near
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v")


def connected_components(edges: DataFrame, max_rounds: int = 60, parts: int | None = None) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    edges: columns u, v of one ordered type; loops, repeated and reversed edges and
    nulls are allowed (nulls and loops are passed over).  No edges give no rows.
    parts: at most so many files for the edges of a round.
    Links are never collected: the driver sees a count and a checksum a round.
    """
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), parts)
    seen = None
    for _ in range(max_rounds):
        edges = cut(_star(_star(edges, True, parts), False, parts).distinct(), parts)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined_components(known: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """The components of known (node, component; as returned here, cut) with more edges: only the components that these join are named anew."""
    label = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    ends = edges.join(label("u"), "u", "left").join(label("v"), "v", "left")
    ends = ends.select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v")).where("u <> v")
    found = cut(connected_components(ends, parts=parts), parts)
    renamed = known.join(found.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left")
    return renamed.select("node", F.coalesce("new", "component").alias("component")).union(found.join(known, "node", "left_anti").select("node", "component"))
