from pyspark.sql import functions as F

from auditlake.llm import op5_lines


def test_rows_without_an_id_are_spread(spark):
    """Rows without an id keep their texts, and are not all in one place."""
    text = "one line of it\nand another one\nand a third\n"
    docs = spark.range(400).select(F.when(F.col("id") < 40, F.col("id")).alias("doc_id"), F.lit(text).alias("text"), F.lit("x").alias("_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = op5_lines.line_dedup(docs)
    got = out.select("doc_id", "text", "_lines", F.spark_partition_id().alias("at")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 400 and all(r.text == text and r._lines == 0 for r in got if r.doc_id is None)
    assert sum(r._lines > 0 for r in got) == 39 and len({r.at for r in got if r.doc_id is None}) > 1
