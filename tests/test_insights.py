import json
import time

import pytest
from pyspark.sql import functions as F

from auditlake.operators import answers, pagespeed
from auditlake.sources import linkfiles
from auditlake.streaming import alerts


def payload(**over):
    """The payload of the fixtures: users' figures for a page, and a laboratory's."""
    users = {"LARGEST_CONTENTFUL_PAINT_MS": {"percentile": 3200, "category": "AVERAGE"}, "CUMULATIVE_LAYOUT_SHIFT_SCORE": {"percentile": 18, "category": "AVERAGE"}, "FIRST_CONTENTFUL_PAINT_MS": {"percentile": 1500, "category": "FAST"}, "INTERACTION_TO_NEXT_PAINT": {"percentile": 450, "category": "AVERAGE"}}
    audits = {
        "largest-contentful-paint": {"numericValue": 4100.5}, "cumulative-layout-shift": {"numericValue": 0.04}, "total-blocking-time": {"numericValue": 740}, "speed-index": {"numericValue": 6100}, "first-contentful-paint": {"numericValue": 1800},
        "unused-javascript": {"title": "Reduce unused JavaScript", "details": {"overallSavingsMs": 1250}}, "render-blocking-resources": {"details": {"overallSavingsMs": 429.6}}, "offscreen-images": {"details": {"overallSavingsMs": 99.9}},
        "largest-contentful-paint-element": {"details": {"items": [{"items": [{"node": {"selector": "main > h1", "snippet": "<h1>"}}]}]}},
    }
    return {"loadingExperience": {"metrics": users}, "lighthouseResult": {"categories": {"performance": {"score": 0.62}}, "audits": audits}} | over


def measured(spark, *bodies):
    rows = [(i, b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)]
    return pagespeed.metrics(spark.createDataFrame(rows, "id int, body string")).orderBy("id").collect()


def test_payloads(spark):
    origin = {"metrics": {"LARGEST_CONTENTFUL_PAINT_MS": {"percentile": 2100, "category": "FAST"}}}
    page, by_origin, lab, empty, bad, error, null = measured(
        spark, payload(), payload(loadingExperience={}, originLoadingExperience=origin), payload(loadingExperience=None), payload(loadingExperience={"metrics": {}, "origin_fallback": True}, originLoadingExperience=origin), "no json", {"error": {"message": "quota", "code": 429}}, None
    )
    assert page.score == 62 and tuple(page.lcp) == (3200.0, "NEEDS_IMPROVEMENT", "field") and page.cls.value == 0.18 and page.inp.value == 450 and page.field and not page.origin_fallback
    assert tuple(page.tbt) == (740.0, "POOR", "lab") and page.speed_index["class"] == "POOR" and page.lcp_element == "main > h1"
    assert [(o.id, o.title, o.savings_ms) for o in page.opportunities] == [("unused-javascript", "Reduce unused JavaScript", 1250), ("render-blocking-resources", "render-blocking-resources", 430)]
    assert tuple(by_origin.lcp) == (2100.0, "GOOD", "field") and tuple(by_origin.cls) == (0.04, "GOOD", "lab") and by_origin.inp is None and by_origin.origin_fallback
    assert tuple(lab.lcp) == (4100.5, "POOR", "lab") and not lab.field
    assert empty.field and empty.origin_fallback and tuple(empty.fcp) == (1800.0, "GOOD", "lab")  # a page's figures are there, if only an empty list of them
    assert (bad.error, error.error, null.error) == ("no JSON", "quota", "no JSON") and bad.lcp is None and error.score is None


@pytest.mark.parametrize("name", pagespeed.LIMITS)
def test_limits_are_inclusive(spark, name):
    good, poor = pagespeed.LIMITS[name]
    got = spark.createDataFrame([(float(good),), (good + 0.01,), (float(poor),), (poor + 0.01,)], "v double").select(pagespeed.classify(F.col("v"), name).alias("c")).collect()
    assert [r.c for r in got] == ["GOOD", "NEEDS_IMPROVEMENT", "NEEDS_IMPROVEMENT", "POOR"]


ROBOTS = {
    "named.com": "User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nDisallow:",
    "shared.com": "User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /\nAllow: /$\nUser-agent: *\nDisallow: /x",
    "first.com": "Disallow: /\nUser-agent: CCBot\nAllow: /",
    "twice.com": "User-agent: gptbot\nDisallow: /\nUser-agent: *\nAllow: /\nUser-agent: GPTBot\nAllow: /",
    "empty.com": "",
}


def test_agents(spark):
    sites = spark.createDataFrame([(h,) for h in [*ROBOTS, "none.com"]], "host string")
    files = spark.createDataFrame(list(ROBOTS.items()), "host string, content string")
    got = {(r.host, r.agent): (r.allowed, r.source) for r in answers.agent_access(sites, files).collect()}
    assert len(got) == 60
    assert got["named.com", "GPTBot"] == (False, "explicit") and got["named.com", "CCBot"] == (True, "wildcard")
    assert got["shared.com", "ClaudeBot"] == (True, "explicit") and got["shared.com", "Amazonbot"] == (True, "wildcard")
    assert got["first.com", "GPTBot"] == (False, "wildcard") and got["first.com", "CCBot"] == (True, "explicit")
    assert got["twice.com", "GPTBot"] == (True, "explicit")  # both groups that name it, the allowing rule among equals
    assert got["empty.com", "GPTBot"] == got["none.com", "GPTBot"] == (True, "default")
    deep = {(r.host, r.agent): r.allowed for r in answers.agent_access(sites, files, "/x/y").collect()}
    assert not deep["shared.com", "ClaudeBot"] and not deep["shared.com", "Amazonbot"] and deep["named.com", "CCBot"]


PAGE = "host string, url string, is_html boolean, status int, word_count long, server_text_length long, title string, description string, h1 string, page_rank double, indexable boolean, home boolean"


def test_readiness(spark):
    page = lambda h, u, words, served, rank=0.5, **k: (h, u, k.get("html", True), k.get("status", 200), words, served, k.get("title", "T"), k.get("about", "D"), "H", rank, k.get("index", True), k.get("home", False))
    pages = spark.createDataFrame([page("a", "a/1", 400, 2200, 0.9, home=True, title="Name | more"), page("a", "a/2", 400, 1100, 0.7, about=None), page("a", "a/3", 40, 0, 1.0, title=""), page("a", "a/4", 400, 0, status=404), page("b", "b/1", 500, 2750, index=False)], PAGE)
    sites = spark.createDataFrame([("a",), ("b",), ("c",)], "host string")
    access = answers.agent_access(sites, spark.createDataFrame([("b", "User-agent: *\nDisallow: /")], "host string, content string"))
    files = spark.createDataFrame([("a", "# me"), ("b", "  ")], "host string, body string")
    grades = spark.createDataFrame([("a", "a/1", 81), ("a", "a/2", 40)], "host string, url string, overall int")
    ready = answers.readiness(sites, access, pages, files, grades)
    got = {r.host: r for r in ready.collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.reach, a.dependent, a.ready, a.html_pages, a.grade, a.weakest) == (30.0, 1, 1, 3, 61, "a/2")
    assert a.read == pytest.approx(2 / 3 * 25) and a.understand == pytest.approx(7 + 8 / 3) and a.quote == pytest.approx(18.3)
    assert a.score == int(30 + 2 / 3 * 25 + 7 + 8 / 3 + 18.3 + 0.5)
    assert (b.reach, b.read, b.understand, b.quote, b.blocked, b.score) == (0.0, 25.0, 8.0, None, 6, int(33 / 70 * 100 + 0.5))
    assert (c.reach, c.read, c.understand, c.quote, c.score) == (30.0, None, 8.0, None, int(38 / 45 * 100 + 0.5))
    todo = [(r.host, r.severity, r.action) for r in answers.actions(ready, access).orderBy("host", "place").collect()]
    assert todo[:3] == [("a", "critical", "serve without scripts: 1"), ("a", "warning", "improve a/2"), ("a", "opportunity", "complete the basics: 2")]
    assert [x[2] for x in todo if x[0] == "b"] == [f"unblock {x}" for x in answers.CRITICAL] + ["grade the content", "publish llms.txt"]
    made = {r.host: r.body for r in answers.own_file(pages).collect()}
    assert made["a"] == "# Name\n\n> D\n\n## Pages\n\n- [a/3](a/3): D\n- [Name | more](a/1): D\n- [T](a/2)\n" and made["b"] == "# b\n\n> Pages published on b.\n\n## Pages\n\n"


def split(line):
    """Cells of a line, a character at a time."""
    out, cur, inside, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"':
            if inside and line[i + 1 : i + 2] == '"':
                cur, i = cur + '"', i + 1
            else:
                inside = not inside
        elif c == "," and not inside:
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    return [x.strip() for x in [*out, cur]]


def test_cells(spark):
    import itertools

    lines = ["".join(x) for n in range(6) for x in itertools.product('a," ', repeat=n)]
    got = {r.line: r.c for r in spark.createDataFrame([(x,) for x in lines], "line string").select("line", linkfiles.cells(F.col("line")).alias("c")).collect()}
    assert {x: [c.replace("\t", "") for c in got[x]] for x in lines} == {x: split(x) for x in lines}


def test_link_files_in_splits(spark, tmp_path):
    """Files read in splits of 200 bytes give the rows of the files read whole."""
    files = {
        "gsc.csv": "\r\n".join(["", "Linking page,Target page"] + [f'"https://s{i}.com/a,{i}","https://t.com/{i}"' for i in range(60)] + ["not an address,x", 'https://last.com/,"no address"']),
        "plain.csv": "\n".join(f"https://p{i}.com/,https://t.com/" for i in range(40)), "odd.csv": "x,linked page\n http://a.com , https://b.com \n\n", "empty.csv": "\n \n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        rows = linkfiles.links(linkfiles.link_lines(spark, str(tmp_path)))
        assert linkfiles.link_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        got = sorted((r.file.rsplit("/", 1)[1], r.source, r.target or "") for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [("gsc.csv", f"https://s{i}.com/a,{i}", f"https://t.com/{i}") for i in range(60)] + [("gsc.csv", "https://last.com/", "")] + [("plain.csv", f"https://p{i}.com/", "") for i in range(40)] + [("odd.csv", "http://a.com", "https://b.com")]
    assert got == sorted(want)


ALERT = "alert_id string, site long, kind string, subject string, body string"


def test_alerts_once_each(spark, tmp_path):
    """A stream that breaks off while it records a batch, and is started again from its checkpoint, has one record for each alert and channel."""
    source, record, kept = tmp_path / "in", tmp_path / "record", tmp_path / "checkpoint"
    source.mkdir()
    put = lambda name, ids: (source / name).write_text("".join(json.dumps(dict(alert_id=i, site=1, kind="down", subject=f"{i} is down", body="b" * 600)) + "\n" for i in ids))
    send = lambda ok: lambda df: df.withColumns({"ok": F.lit(ok), "error": F.when(F.lit(not ok), "refused")})
    channels = {"mail": send(True), "hook": send(False)}

    def run(write):
        stream = spark.readStream.schema(ALERT).option("maxFilesPerTrigger", 1).json(str(source))
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(kept)).trigger(availableNow=True).start()
        query.awaitTermination()

    put("a.json", ["x", "y", "y"])
    time.sleep(1.1)
    put("b.json", ["z"])
    write, calls = alerts.recorder(str(record), channels), []

    def breaks_off(batch, n):
        calls.append(n)
        write(batch, n)
        if n == 1:  # on record, but the stream does not learn of it
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(breaks_off)
    run(lambda batch, n: (calls.append(n), write(batch, n)))
    got = sorted((r.alert_id, r.channel, r.ok, len(r.detail)) for r in spark.read.parquet(str(record)).collect())
    assert got == sorted((i, c, ok, n) for i in "xyz" for c, ok, n in (("mail", True, 500), ("hook", False, 7)))
    assert calls == [0, 1, 1]
    alerts.recorder(str(tmp_path / "other"), {})(spark.createDataFrame([("q", 1, "down", "s", "b")], ALERT), 0)
    assert [r.channel for r in spark.read.parquet(str(tmp_path / "other")).collect()] == ["console"]
