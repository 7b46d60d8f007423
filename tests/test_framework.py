from pyspark.sql import functions as F

from auditlake.operators import framework, stores

KIND = "page_id long, url string, html string, headers map<string,string>"


def test_marks(spark):
    head = '<script src="/b.js"></script><script src="/c.js" defer></script><script async src=/d.js></script><script src="/_next/static/x/_buildManifest.js"></script>'
    rows = [
        (1, "u", f"<html><head>{head}</head><body><script src='/late.js'></script></body></html>", {"x-matched-path": "/p", "age": "12", "cache-control": "stale-while-revalidate=5"}),
        (2, "u", '<script id="__NEXT_DATA__">{"buildId": "own"}</script>?dpl=abcdefgh', {"x-nextjs-deployment-id": "dep", "x-middleware-rewrite": "/r"}),
        (3, "u", "<a href='/x?dpl=dpl_1'>", {"x-nextjs-deployment-id": ""}),
        (4, "u", "<img data-nimg=fill src='/_next/image?a'><img data-nimg='fill' sizes='1px' src=/b.png><img data-nimg><img src=c.png>", None),
        (5, "u", "<link rel='stylesheet' href='https://fonts.googleapis.com/x'><link rel=stylesheet href=/own.css><link rel='preconnect' href='https://fonts.gstatic.com'><style>@font-face{a}@FONT-FACE { Font-Display : swap }</style>", {}),
        (6, "u", None, {}),
    ]
    got = {r.page_id: r for r in framework.fingerprints(spark.createDataFrame(rows, KIND)).collect()}
    assert [got[i].build_id for i in range(1, 7)] == ["x", "own", "dpl_1", None, None, None]
    assert (got[1].blocking_scripts, got[1].route_scripts, got[1].middleware, got[1].matched_path, got[1].age, got[1].swr) == (1, 1, True, "/p", 12, 5)
    assert got[2].rewrote and got[2].matched_path == "/r" and not got[3].middleware
    assert (got[4].pictures, got[4].unoptimized, got[4].unsized) == (2, 1, 1)
    assert (got[5].hosted_fonts, got[5].faces_without_display) == (1, 1)


def test_sites(spark):
    rows = [("https://a.com/1", True, "app", "ssr", "x"), ("https://www.a.com/2", True, "pages", "ssr", "y"), ("https://a.com/3", True, "app", "isr", None), ("https://a.com/4", False, "unknown", "unknown", "z"), ("https://b.com", True, "pages", "static", "x"), ("https://b.com/2", True, "app", "static", "x")]
    df = spark.createDataFrame(rows, "url string, is_next boolean, router string, strategy string, build_id string")
    got = {r.site: r for r in framework.site_framework(df, F.regexp_extract("url", r"//(?:www\.)?([^/]*)", 1)).collect()}
    assert (got["a.com"].pages, got["a.com"].router, got["a.com"].build_ids, got["a.com"].ssr, got["a.com"].isr) == (3, "app", 2, 2, 1)
    assert got["b.com"].router == "app"  # as many of each: by name


def test_saved_pages(spark):
    big = "x" * (stores.MOST_BYTES + 1)
    rows = [(1, 1, "https://a.com/x/", "<p>é😀</p>" * 50), (1, 2, "https://a.com/x#f", "later"), (1, 3, "https://a.com/y", ""), (1, 4, "https://a.com/z", None), (1, 5, "https://a.com/big", big), (2, 6, "https://a.com/x", "other crawl"), (2, 7, "https://a.com/full", big[:-1])]
    pages = spark.createDataFrame(rows, "crawl long, page_id long, url string, html string")
    store = stores.snapshots(pages)
    kept = {(r.crawl, r.url_key): r for r in store.collect()}
    assert set(kept) == {(1, "https://a.com/x"), (2, "https://a.com/x"), (2, "https://a.com/full")}
    assert kept[1, "https://a.com/x"].page_id == 1 and kept[2, "https://a.com/full"].gzip_bytes < 10_000
    back = stores.loaded(store, spark.createDataFrame([(1, "https://A.com:443/x/"), (1, "https://a.com/none")], "crawl long, url string")).collect()
    assert [(r.url_key, r.html) for r in back] == [("https://a.com/x", "<p>é😀</p>" * 50)]
    assert sorted(map(tuple, stores.snapshot_stats(store).collect())) == [(1, 1, len(("<p>é😀</p>" * 50).encode())), (2, 2, 11 + stores.MOST_BYTES)]
