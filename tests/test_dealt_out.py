"""Rows that much is done with are dealt out evenly, however their file is cut."""

from pyspark.sql import functions as F

from auditlake.operators import pagespeed
from auditlake.plans import insights, reports
from auditlake.sources.html import spread


def sizes(df):
    return [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]


def test_many_parts_of_which_one_holds_all_rows(spark):
    rows = spark.range(4000, numPartitions=1).union(spark.range(0, numPartitions=64))
    assert max(sizes(spread(rows))) <= 4000 / 8


def test_payloads_are_dealt_out(spark):
    assert insights._payloads(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_savings(spark):
    audit = lambda i, ms, title: f'"{i}":{{"details":{{"overallSavingsMs":{ms}}}{title}}}'
    a = [audit(i, ms, f',"title":"t{n}"' if n else "") for n, (i, ms) in enumerate(zip(pagespeed.SAVINGS, (100, 99.9, '"x"', 700.5, "null", 100, 300, 101, 99)))]
    rows = spark.createDataFrame([(f'{{"lighthouseResult":{{"audits":{{{",".join(a)}}}}}}}',), ("{}",)], "body string")
    got = [[tuple(x) for x in r.opportunities] for r in pagespeed.metrics(rows).collect()]
    s = pagespeed.SAVINGS
    assert got == [[(s[3], "t3", 701), (s[6], "t6", 300), (s[7], "t7", 101), (s[0], s[0], 100), (s[5], "t5", 100)], []]


def test_pages_of_the_report_are_dealt_out(spark):
    assert reports._pages(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
