"""The internal link graph: edges, inbound links, orphans, PageRank, duplicate groups."""

from __future__ import annotations

from tempfile import mkdtemp

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder the session names; only a local master, as in tests, may do without that setting."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def link_rows(records: DataFrame) -> DataFrame:
    """source key and every field of each link."""
    return records.select(F.col("page_id").alias("from_page"), F.col("page_key").alias("src"), F.inline("links"))


def edges(records: DataFrame) -> DataFrame:
    """(src, dst) of followed internal links between known pages, repeats kept, links to itself not."""
    known = records.select(F.col("page_key").alias("dst")).distinct()
    found = link_rows(records).where("internal and not nofollow and key <> src").select("src", F.col("key").alias("dst"))
    return found.join(known, "dst", "left_semi").select("src", "dst")


def inbound(records: DataFrame) -> DataFrame:
    """page_key, links, sources, followed of pages that are linked to, by themselves too; links to a place on the same page do not count."""
    found = link_rows(records).where("internal and key is not null and not startswith(raw_href, '#')")
    return found.groupBy(F.col("key").alias("page_key")).agg(F.count("*").alias("links"), F.count_distinct("src").alias("sources"), F.count_if(~F.col("nofollow")).alias("followed"))


def orphans(records: DataFrame) -> DataFrame:
    """HTML pages answered with 200 (where that is known), other than home pages, that no such page links to."""
    home = F.regexp_count("page_key", F.lit("^https?://[^/]+/?$")) > 0
    live = records.where("is_html and status = 200") if {"is_html", "status"} <= set(records.columns) else records
    return live.where(~home).join(inbound(live).select("page_key"), "page_key", "left_anti").select("page_id", "page_key")


def pagerank(nodes: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """node, rank (largest = 1) by power iteration; repeated links weigh more, dangling rank is spread evenly.

    nodes: column node; links: src, dst.  Each round is a join and one aggregation, whose two sums the driver
    sees.
    """
    nodes = _cut(nodes.select("node").distinct())
    n = nodes.count()
    weights = links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    weights = _cut(weights.join(weights.groupBy("src").agg(F.sum("w").alias("out")), "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    sources = weights.select(F.col("src").alias("node")).distinct().withColumn("gives", F.lit(True))
    ranks = _cut(nodes.join(sources, "node", "left").select("node", F.col("gives").isNull().alias("loose"), F.lit(1.0 / max(n, 1)).alias("rank")))
    spare = F.coalesce(F.sum(F.when(F.col("loose"), F.col("rank"))), F.lit(0.0))
    loose = ranks.agg(spare).first()[0]
    for _ in range(most):
        given = weights.join(ranks, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        new = ranks.withColumnRenamed("rank", "old").join(given, "node", "left").select("node", "loose", "old", ((1 - damping) / max(n, 1) + damping * (F.coalesce("in", F.lit(0.0)) + F.lit(loose) / max(n, 1))).alias("rank"))
        new = _cut(new)
        moved, loose = new.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0)), spare).first()  # what moved, and the next round's spare rank
        ranks = new.select("node", "loose", "rank")
        if moved < tolerance:
            break
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.crossJoin(F.broadcast(top)).select("node", (F.col("rank") / F.col("top")).alias("rank"))  # one row


def duplicates(records: DataFrame, key, name: str) -> DataFrame:
    """page_id, kind, group_size of pages whose key another page shares; empty keys have no group.  Counts are joined back, so a key that a third of the pages has is never one group in a task."""
    keyed = records.select("page_id", F.xxhash64(key).alias("h"), key.alias("k")).where("k <> ''")
    sizes = keyed.groupBy("h", "k").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return keyed.join(sizes, ["h", "k"]).select("page_id", F.lit(name).alias("kind"), "group_size")


def shared(keyed: DataFrame) -> DataFrame:
    """page_id, kind, group_size of the rows (page_id, kind, k) whose k other rows of the kind have; keyed is cut, as it is read twice."""
    hashed = keyed.withColumn("h", F.xxhash64("k"))
    sizes = hashed.groupBy("kind", "h", "k").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return hashed.join(sizes, ["kind", "h", "k"]).select("page_id", "kind", "group_size")


#: Fixed value: nodes that a picture of the link graph has at most.
PICTURED = 300


def top_graph(nodes: DataFrame, links: DataFrame, most: int = PICTURED) -> DataFrame:
    """The links among the `most` nodes of highest rank, each once and none to itself: from_at, to_at (places by rank, from 0), src, dst.

    nodes: node, rank; links: src, dst.  Equal ranks go by name.  The chosen nodes are broadcast, so links are
    read once and only those with both ends chosen are shuffled, to be told apart.
    """
    top = nodes.select("node", "rank").orderBy(F.desc("rank"), "node").limit(most)
    top = F.broadcast(top.select("node", (F.row_number().over(Window.orderBy(F.desc("rank"), "node")) - 1).alias("at")))  # `most` rows
    ends = links.where("src <> dst").join(top.select(F.col("node").alias("src"), F.col("at").alias("from_at")), "src").join(top.select(F.col("node").alias("dst"), F.col("at").alias("to_at")), "dst")
    return ends.select("from_at", "to_at", "src", "dst").distinct()
