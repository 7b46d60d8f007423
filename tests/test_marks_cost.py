"""What is done for every page is done once and not interpreted."""

from pyspark.sql import functions as F

from auditlake.functions.dialect import Spark
from auditlake.operators import checks


def test_checks_are_not_under_a_function_of_functions(spark):
    pages = spark.createDataFrame([(1, "https://s.com/A_b"), (2, "https://s.com/" + "long-" * 40), (3, None)], "page_id long, url string")
    some = checks.url_checks()
    got = checks.marks(pages, some)
    node = got._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(array(" not in node.lower()
    named = {r.page_id: [some[i].id for i in r.failed] for r in got.collect()}
    assert {"url-uppercase", "url-underscores"} <= set(named[1]) and "long-urls" in named[2] and named[3] == []
    assert all(r.failed == sorted(r.failed) and r.scopes == sorted(r.scopes) for r in got.collect())


def test_lists_of_a_record_are_made_as_long_as_they_are(spark):
    made = Spark().upto("n", 4, "x * 10")
    assert "filter(" not in made  # all numbers up to the most were made and compared with n for every row
    rows = spark.createDataFrame([(-1,), (0,), (1,), (3,), (4,), (9,), (None,)], "n long").select("n", F.expr(made).alias("v"))
    assert [r.v for r in rows.collect()] == [[], [], [10], [10, 20, 30], [10, 20, 30, 40], [10, 20, 30, 40], []]
