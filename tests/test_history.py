import math

import pandas as pd
from pyspark.sql import functions as F

from auditlake.operators import history, locations, scoring
from auditlake.streaming import reconcile


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_running_number_is_row_number(spark):
    calls = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("provider"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7919 % 500 * 3600).alias("ts"))
    got = {r.id: (r.n, r.allowed) for r in history.quota_ledger(calls, 20).collect()}
    want, seen = {}, {}
    for r in sorted(calls.collect(), key=lambda r: (r.ts, r.id)):
        k = (r.provider, r.ts.strftime("%Y-%m"))
        seen[k] = seen.get(k, 0) + 1
        want[r.id] = (seen[k], seen[k] <= 20)
    assert got == want
    assert history.quota_ledger(calls.where("id < 0"), 20).count() == 0


def test_top_decile(spark):
    for values in ([], [0.0], [5.0], [3.0] * 30, [float(i * i % 101) for i in range(205)], [None, -1.0, 2.0, 0.5]):
        rows = spark.createDataFrame(list(enumerate(values)), "k long, v double")
        above = sorted((v for v in values if v is not None and v > 0), reverse=True)
        least = above[max(0, math.ceil(0.1 * len(above)) - 1)] if above else None
        want = sorted(k for k, v in enumerate(values) if v is not None and v > 0 and v >= least)
        assert sorted(r.k for r in history.top_decile(rows, "k", "v").collect()) == want


def test_by_path(spark):
    rows = [("/", 1200, 900, 0.42, 65.0), ("/money", 9000, 7000, 0.31, 190.0), ("/orphan", 400, 310, 0.55, 80.0), ("/Orphan/?x=1", 100, 90, 0.1, 80.0), ("https://a.com/gone#f", 300, 0, 0.88, 12.0), ("gone", 1, 0, 0.5, 1.0)]
    got = {r.path: r for r in history.by_path(spark.createDataFrame(rows, "path string, pageviews long, sessions long, bounce_rate double, avg_duration_sec double")).collect()}
    assert set(got) == {"/", "/money", "/orphan", "/gone"}
    assert got["/orphan"].sessions == 400 and abs(got["/orphan"].bounce_rate - (0.55 * 310 + 0.1 * 90) / 400) < 1e-6
    assert got["/money"].bounce_rate == 0.31 and got["/gone"].bounce_rate == 0


def test_site_scores_and_pillars(spark):
    pages = spark.createDataFrame([("a", 78.0, 1.0, 100, 5), ("a", 98.0, 0.5, 50, None), ("a", 100.0, None, None, 10), ("b", 50.0, 0.2, 0, 0)], "site string, score double, page_rank double, impressions long, sessions long")
    issues = spark.createDataFrame([("a", "critical"), ("a", "notice")], "site string, severity string")
    got = {r.site: r for r in scoring.site_scores(pages, issues).collect()}
    weights = [1 + 3 + 4 + 4 * 0.5, 1 + 1.5 + 2, 1 + 4]
    weighted = sum(w * s for w, s in zip(weights, (78, 98, 100))) / sum(weights)
    assert abs(got["a"].weighted_score - weighted) < 1e-5 and abs(got["a"].score - (weighted - 25.5 / 8)) < 1e-5
    assert abs(got["a"].impressions_at_risk - (22 + 1)) < 1e-6 and got["b"].score == 50
    outcomes = spark.createDataFrame([("x", "links", "critical", 1, 5), ("y", "links", "notice", 0, 5), ("z", "links", "blocker", 0, 0)], "check_id string, category string, severity string, affected long, applicable long")
    assert {r.pillar: (r.score, r.failed, r.passed) for r in scoring.pillars(outcomes).collect()} == {"content": (100, 0, 0), "authority": (5, 1, 1), "technicals": (100, 0, 0), "ux": (100, 0, 0)}


def test_crawl_diff(spark):
    before, after = (spark.createDataFrame([(x,) for x in s], "check_id string") for s in ("aab", "bcc"))
    assert rows_of(scoring.crawl_diff(before, after, "check_id"), "check_id") == [("a", "fixed"), ("c", "appeared")]


def test_coverage(spark):
    schema = "page_id long, url string, title string, description string, headings array<struct<level:int,text:string>>, body_text string, html string"
    full = (1, "https://a.com/x/new-york", "Plumber New York", "In New York", [(1, "New York"), (2, "about new york")], "new york new york New York 12 Main Street", '{"@type": "LocalBusiness"}')
    pages = spark.createDataFrame([full, (2, None, None, None, [], None, None)], schema)
    got = {r.page_id: r for r in locations.coverage(pages, [{"label": "New York, NY", "city": "New York"}]).collect()}
    assert got[1].coverage == 100 and got[1].gaps == [] and got[1].in_body == 3
    assert got[2].coverage == 0 and len(got[2].gaps) == 8
    assert locations.terms("Austin, Texas", "Austin", "Texas") == ["austin", "texas", "austin, texas"]


POLLS = [(1, 0, True, 30), (1, 1, False, 10), (1, 2, None, 10), (1, 30, True, 9), (2, 0, False, None), (2, 1, True, None), (2, 2, True, 20)]
WANT = {(1, 0): ("none", None), (1, 1): ("went-down", "down,ssl_expiring"), (1, 2): ("still-down", None), (1, 30): ("recovered", "recovered,ssl_expiring"), (2, 0): ("went-down", "down"), (2, 1): ("recovered", "recovered"), (2, 2): ("none", None)}


def stream(spark, tmp_path, frames, schema, fn, name):
    """What fn makes of the frames, each of which is a micro-batch."""
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    made = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = fn(made).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_uptime_stream(spark, tmp_path):
    at = lambda h: pd.Timestamp("2024-01-01").to_pydatetime() + pd.Timedelta(hours=h).to_pytimedelta()
    polls = [(s, at(h), h, ok, ssl) for s, h, ok, ssl in POLLS]
    schema = "site long, at timestamp, id long, ok boolean, ssl_days int"
    cut = [[p for p in polls if p[2] < 2], [p for p in polls if p[2] >= 2]]
    got = stream(spark, tmp_path, cut, schema, reconcile.uptime, "uptime_rows")
    assert {(r.site, r.id): (r.transition, r.alert) for r in got} == WANT
    assert {r.id: r.failure_count for r in got if r.site == 1} == {0: 0, 1: 1, 2: 2, 30: 2}
    batch = history.uptime_transitions(spark.createDataFrame(polls, schema)).collect()
    assert {(r.site, r.id): r.transition for r in batch} == {k: v[0] for k, v in WANT.items()}


def test_backlink_stream(spark, tmp_path):
    at = lambda h: pd.Timestamp("2024-01-01").to_pydatetime() + pd.Timedelta(hours=h).to_pytimedelta()
    checks = [(200, True, "dofollow"), (200, True, "nofollow"), (503, False, None), (200, True, "dofollow"), (404, False, None), (200, False, None), (None, False, None)]
    rows = [(7, at(i), i, *c) for i, c in enumerate(checks)]
    got = stream(spark, tmp_path, [rows[:3], rows[3:]], "link long, at timestamp, id long, http_status int, found boolean, rel string", reconcile.backlinks, "backlink_rows")
    seen = [(r.status, r.transition) for r in sorted(got, key=lambda r: r.id)]
    assert seen == [("active", "found"), ("active", "became-nofollow"), ("active", "broken"), ("active", "none"), ("broken", "lost"), ("lost", "none"), ("broken", "broken")]


def test_content_changes_and_kpis(spark):
    polls = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "a"), (1, 3, 3, "b"), (1, 4, 4, None), (1, 5, 5, None), (2, 1, 6, "z")], "site long, at long, id long, body_hash string")
    assert [r.id for r in history.content_changes(polls).orderBy("id").collect()] == [3, 4]
    latest = spark.createDataFrame([(3,), (12,), (None,)], "position int")
    assert rows_of(history.rank_kpis(latest), "keywords") == [(3, 2, 1, 7.5)]
