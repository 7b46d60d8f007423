import datetime as dt
import math
import random

import pytest

from auditlake.operators import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_projects(spark):
    sites = spark.createDataFrame([(1,), (2,), (3,)], "site long")
    crawls = spark.createDataFrame([(1, 10, day(1), 5.0), (1, 11, day(3), 7.0), (1, 12, day(3), 8.0), (2, 20, day(0), None)], "site long, id long, at timestamp, score double")
    assert rows(tables.projects(sites, crawls)) == [(1, 3, 5.0, day(1), 12, 8.0, day(3)), (2, 1, None, day(0), 20, None, day(0)), (3, 0, None, None, None, None, None)]


def test_history_is_the_last_crawls_oldest_first(spark):
    crawls = spark.createDataFrame([(1, i, day(i * 7 % 10), float(i)) for i in range(10)] + [(2, 50, day(2), 1.0)], "site long, id long, at timestamp, score double")
    got = rows(tables.score_history(crawls, 3).select("site", "n", "at"))
    assert got == [(1, 1, day(7)), (1, 2, day(8)), (1, 3, day(9)), (2, 1, day(2))]


def test_keywords(spark):
    keywords = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "d")], "keyword long, phrase string")
    shots = spark.createDataFrame([(1, day(1), 1, 9), (1, day(2), 2, 4), (1, day(0), 3, 1), (2, day(1), 4, 4), (3, day(1), 5, 8), (3, day(2), 6, None)], "keyword long, at timestamp, id long, position long")
    table = tables.keyword_table(keywords, shots)
    assert rows(table) == [(1, "b", 4, 9, 5), (2, "a", 4, None, None), (3, "c", None, 8, None), (4, "d", None, None, None)]
    assert [r.keyword for r in tables.keywords_first(table, 3).orderBy("place").collect()] == [2, 1, 3]


def test_backlinks(spark):
    links = spark.createDataFrame([(1, "active", day(1)), (2, "lost", day(5)), (3, "lost", None), (4, "broken", None), (5, "active", day(0))], "link long, status string, last_checked timestamp")
    assert [r.link for r in tables.backlinks_first(links, 4).orderBy("place").collect()] == [3, 2, 4, 5]
    assert [r.link for r in tables.to_verify(links, 3).orderBy("place").collect()] == [3, 4, 5]
    owned = spark.createDataFrame([(1, "active", "dofollow", "a"), (1, "active", "ugc", "a"), (1, "lost", "dofollow", "b"), (1, "active", None, None), (2, "unverified", None, "c")], "site long, status string, rel string, host string")
    assert rows(tables.backlink_totals(owned)) == [(1, 4, 3, 1, 0, 0, 1, 1, 2), (2, 1, 0, 0, 0, 1, 0, 0, 1)]


@pytest.mark.parametrize("share", [0.1, 0.25, 1.0])
def test_share_threshold(spark, share):
    r = random.Random(2)
    for values in ([], [0.5], [0.0] * 7, [r.random() for _ in range(201)], [r.choice([0.1, 0.2, 0.9]) for _ in range(50)] + [None]):
        known = sorted((v for v in values if v is not None), reverse=True)
        want = known[max(0, math.ceil(share * len(known)) - 1)] if known else None
        assert tables.share_threshold(spark.createDataFrame([(v,) for v in values], "v double"), "v", share).first().least == want


def test_explorer(spark):
    pages = [(f"https://s.com/{'Blog' if i % 2 else 'shop'}/{i}", i != 7, i / 10, i % 3, float(i), 10 - i, None if i == 4 else i % 4, i % 5 != 0) for i in range(10)]
    df = spark.createDataFrame(pages, "url string, is_html boolean, page_rank double, depth int, score double, issues int, in_degree int, indexable boolean")
    at = lambda **k: [int(r.url.rsplit("/", 1)[1]) for r in tables.explorer(df, **k).orderBy("place").collect()]
    assert at() == [9, 8, 6, 5, 4, 3, 2, 1, 0] and at(segment="top25") == [9, 8, 6] and at(segment="top10") == [9]
    assert at(segment="orphans", sort="url", ascending=True) == [0, 4, 8] and at(segment="indexable", pattern="  BLOG ", sort="issues") == [1, 3, 9]
    assert at(sort="depth", ascending=True, most=4) == [3, 9, 0, 6]  # equal ones by address


def test_tidied_robots(spark):
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /x\n\n disallow: /X \nSitemap: s"), ("b", "Allow: /\r\n"), ("c", "User-agent: *\nDisallow:")], "host string, content string")
    found = spark.createDataFrame([("a", "https://a/m"), ("b", "https://b/m2"), ("b", "https://b/m1")], "host string, url string")
    assert rows(tables.tidied_robots(files, found)) == [
        ("a", "User-agent: *\nDisallow: /x\nSitemap: s\n", True, False, False, 1, False),
        ("b", "User-agent: *\nAllow: /\nSitemap: https://b/m1\nSitemap: https://b/m2\n", True, True, True, 0, True),
        ("c", "User-agent: *\nDisallow:\n", False, False, True, 0, False),
    ]
