import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import graph, hosts, merge, sitemaps, slots


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def index(*names):
    return "<sitemapindex>" + "".join(f"<sitemap><loc> {n} </loc></sitemap>" for n in names) + "</sitemapindex>"


def tree(spark, declared, files, sites=(("s", "https://s"),)):
    got = sitemaps.sitemap_tree(
        spark.createDataFrame(list(sites), "site string, origin string"), spark.createDataFrame(declared, "site string, place int, url string"),
        spark.createDataFrame([(u, 200, b) if isinstance(b, str) else (u, b, "") for u, b in files.items()], "url string, status int, body string"),
    )
    return [(r.site, r.n, r.url, r.error) for r in got.orderBy("site", "n").collect()]


def by_queue(declared, files):
    """One site's files, an address at a time."""
    queue, seen, out, named = [u for _, _, u in declared], [], [], 0
    while queue and len(out) < 60:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.append(url)
        body = files.get(url, 0)
        status = 200 if isinstance(body, str) else body
        if (status == 0 or status >= 400) and url not in [u for _, _, u in declared]:
            continue
        out.append(url)
        if isinstance(body, str) and "<sitemapindex" in body and named < 50:
            for child in body.split("<loc>")[1:]:
                child = child.split("</loc>")[0].strip()
                if child not in seen:
                    queue.append(child)
                    named += 1
    return out


def test_sitemap_tree_by_hand(spark):
    files = {"https://s/sitemap.xml": index("a", "https://s/sitemap.xml", "b", "none"), "a": index("b", "c"), "b": "<urlset><url><loc>https://s/x?a=1&amp;b</loc></url></urlset>", "c": "text", "https://t/sitemap_index.xml": "<html>", "d": 503}
    sites = (("s", "https://s"), ("t", "https://t"), ("u", "https://u"), ("v", "https://v"))
    got = tree(spark, [("u", 0, "d"), ("u", 1, "gone")], files, sites)
    assert got == [
        ("s", 1, "https://s/sitemap.xml", None), ("s", 2, "a", None), ("s", 3, "b", None), ("s", 4, "c", "not XML"),
        ("t", 1, "https://t/sitemap_index.xml", "missing <urlset> or <sitemapindex> root"), ("u", 1, "d", "HTTP 503"), ("u", 2, "gone", "could not be fetched"),
    ]
    none = tree(spark, [], {}, ())
    assert none == []


@pytest.mark.parametrize("seed", range(4))
def test_sitemap_tree_is_the_queue(spark, seed):
    """Random trees with circles, gaps and more names than the guards let through."""
    r = random.Random(seed)
    names = [f"f{i}" for i in range(120)]
    files = {n: r.choice([404, 0, "<urlset/>", "<urlset/>", index(*r.choices(names, k=r.randint(0, 30)))]) for n in names}
    files = {n: b for n, b in files.items() if b != 0}
    declared = [("s", i, n) for i, n in enumerate(r.choices(names, k=4))]
    assert [u for _, _, u, _ in tree(spark, declared, files)] == by_queue(declared, files)


def stamp(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


def test_previous_and_running_sum(spark):
    r = random.Random(3)
    data = [(r.choice(["a", "a", "a", "b", None]), stamp(r.randint(0, 5000)), i, r.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, at timestamp, id int, v int").repartition(7)
    before = {x.id: x.p and (x.p.value,) for x in slots.previous(df, ["k"], F.date_trunc("hour", "at"), ["at", "id"], F.col("v"), "p").collect()}
    sums = {x.id: x.s for x in slots.running_sum(df, ["k"], F.date_trunc("hour", "at"), ["at", "id"], F.coalesce("v", F.lit(0)), "s").collect()}
    last, total = {}, {}
    for k, _, i, v in sorted(data, key=lambda x: (str(x[0]), x[1], x[2])):
        assert before[i] == last.get(k), i
        last[k], total[k] = (v,), total.get(k, 0) + (v or 0)
        assert sums[i] == total[k]
    assert len(before) == len(sums) == 400


@pytest.mark.parametrize("strict", [True, False])
def test_as_of(spark, strict):
    r = random.Random(5)
    side = lambda n, at: [(r.choice(["a", "a", "b", None]), r.choice([None, *map(stamp, range(0, at, 7))]), i) for i in range(n)]
    left, right = side(150, 9000), side(120, 9000)
    got = slots.as_of(spark.createDataFrame(left, "k string, at timestamp, id int"), spark.createDataFrame([(*x, x[2] * 2) for x in right], "k string, at timestamp, tie int, v int"), ["k"], "at", lambda at: F.date_trunc("hour", at), ["v"], ["tie"], strict)
    want = []
    for k, at, i in left:
        ok = [x for x in right if k is not None and at is not None and x[0] == k and x[1] is not None and (x[1] < at or not strict and x[1] == at)]
        want.append((i, max(ok, key=lambda x: (x[1], x[2]))[2] * 2 if ok else None))
    assert rows(got.select("id", "as_of.v")) == sorted(want, key=str)


def test_hosts(spark):
    sites = spark.createDataFrame([("a", "https://www.a.com/x"), ("b", "http://b.a.com"), ("c", "https://com"), ("bad", "nonsense")], "site string, origin string")
    urls = spark.createDataFrame([("https://A.com/",), ("http://x.b.a.com:8/",), ("https://ba.com",), ("https://www.www.a.com/",), ("mailto:x",), (None,)], "u string")
    got = rows(hosts.on_site(urls, "u", sites).select("u", "site"))
    assert got == sorted([("https://A.com/", "a"), ("https://A.com/", "c"), ("http://x.b.a.com:8/", "a"), ("http://x.b.a.com:8/", "b"), ("http://x.b.a.com:8/", "c"), ("https://ba.com", "c"), ("https://www.www.a.com/", "a"), ("https://www.www.a.com/", "c")], key=str)
    results = spark.createDataFrame([(1, 3, "https://b.a.com/late"), (1, 2, "https://x.a.com/"), (1, 1, "https://else.com"), (2, 1, "https://else.com")], "keyword int, position int, url string")
    keywords = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "keyword int, site string")
    assert rows(hosts.rank_hits(results, keywords, sites)) == sorted([(1, "a", 2, "https://x.a.com/"), (2, "a", None, None), (3, "b", None, None)], key=str)


def test_backlinks(spark):
    sites = spark.createDataFrame([("a", "https://a.com")], "site string, origin string")
    link = lambda page, pos, rel, shut=False, href="https://a.com/", url="https://z.com/": (page, url, pos, href, rel, f"t{pos}", shut)
    links = [link(1, 0, "nofollow"), link(1, 2, None), link(1, 1, "noopener"), link(2, 0, "ugc"), link(2, 1, "sponsored ugc"), link(3, 0, "", True), link(3, 1, "UGC", True), link(4, 0, None, url="https://blog.a.com/"), link(5, 0, None, href="https://ba.com/")]
    df = spark.createDataFrame(links, "page_id int, url string, pos int, href string, rel string, anchor string, page_nofollow boolean")
    assert rows(hosts.backlink_targets(df, sites)) == [(1, "a", 3, "dofollow", "t1"), (2, "a", 2, "sponsored", "t1"), (3, "a", 2, "ugc", "t1")]


RULES = {"a": "new", "d": "filled", "c": "keep", "n": "add"}
KIND = "k string, j string, a int, d int, c int, n int"


def apply(table, batch):
    """One row after another."""
    out, loose = {(r[0], r[1]): list(r) for r in table if None not in r[:2]}, [tuple(r) for r in table if None in r[:2]]
    for *r, _ in sorted(batch, key=lambda r: r[-1]):
        key = (r[0], r[1])
        if None in key:
            loose.append(tuple(r))
        elif key in out:
            x = out[key]
            out[key] = [*key, r[2], r[3] if r[3] is not None else x[3], x[4], x[5] + r[5]]
        else:
            out[key] = list(r)
    return sorted([tuple(x) for x in out.values()] + loose, key=str)


def batch_of(seed, n=60):
    r = random.Random(seed)
    return [(r.choice("xyz"), r.choice(["p", "q", None]), r.choice([None, 1, 2]), r.choice([None, None, 3, 4]), r.randint(0, 9), 1, i) for i in range(n)]


def test_merged(spark):
    table, batch = [("x", "p", 0, 7, 1, 5), ("w", "p", 1, None, 2, 1), ("x", None, 1, 1, 1, 1)], batch_of(1)
    got = merge.merged(spark.createDataFrame(table, KIND), spark.createDataFrame(batch, KIND + ", at int"), ["k", "j"], RULES, ["at"])
    assert rows(got) == apply(table, batch)
    assert rows(merge.merged(spark.createDataFrame([], KIND), spark.createDataFrame(batch, KIND + ", at int"), ["k", "j"], RULES, ["at"], nulls_equal=True).select("k", "j", "n")) == sorted(((k, j, sum(b[:2] == (k, j) for b in batch)) for k, j in {b[:2] for b in batch}), key=str)
    added = merge.absent_added(spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b", 0), (2, "late", 5), (2, "first", 1)], "k int, v string, at int"), ["k"], ["at"])
    assert rows(added) == [(1, "a"), (2, "first")]


def test_written_batches(spark, tmp_path, monkeypatch):
    """A repeated batch changes nothing; one that breaks off before the switch leaves the table as it was."""
    path, one, two = f"file://{tmp_path}/t", batch_of(2), batch_of(3, 5)
    frame = lambda b: spark.createDataFrame(b, KIND + ", at int")
    write = lambda b, name: merge.write_merged(path, frame(b), name, ["k", "j"], RULES, ["at"], buckets=4)
    schema = frame(one).drop("at").schema
    assert rows(merge.read_table(spark, path, schema)) == []
    assert write(one, "b1") and not write(one, "b1")
    first = rows(merge.read_table(spark, path, schema))
    assert first == apply([], one)
    switch = merge._Files.switch
    monkeypatch.setattr(merge._Files, "switch", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        write(two, "b2")
    assert rows(merge.read_table(spark, path, schema)) == first
    monkeypatch.setattr(merge._Files, "switch", switch)
    assert write(two, "b2")
    assert rows(merge.read_table(spark, path, schema)) == apply(first, two)


def test_top_graph(spark):
    nodes = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.5), ("d", 0.1)], "node string, rank double")
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("c", "c"), ("c", "a"), ("d", "a"), ("a", "z")], "src string, dst string")
    assert rows(graph.top_graph(nodes, links, 3)) == [(0, 1, "a", "b"), (1, 0, "b", "a"), (2, 0, "c", "a")]
