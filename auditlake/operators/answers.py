"""Whether answer engines can reach, read, understand and quote a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of crawlers in robots files, and those without which a site is not cited.
AGENTS = ("OAI-SearchBot", "GPTBot", "ChatGPT-User", "ClaudeBot", "PerplexityBot", "Google-Extended", "Applebot-Extended", "meta-externalagent", "CCBot", "Amazonbot")
CRITICAL = AGENTS[:6]
#: Points of reach, read, understand (a file of its own, well-formed pages) and quote.
POINTS = {"reach": 30, "read": 25, "understand": 15, "quote": 30}
OWN_FILE, WELL_FORMED = 7, 8
#: Letters of a word, the share of words that must come without scripts, words of a page that can depend on them, words of a page with substance.
LETTERS, SERVED, SOME_WORDS, ENOUGH_WORDS = 5.5, 0.6, 50, 300
#: Pages that a generated file names, and the grade below which a page is weak.
NAMED, WEAK = 25, 60


def agent_groups(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, grp, agent) and (host, grp, allow, pattern, regex): robots files (host, content) by groups.

    Agent lines that follow one another share a group; rules before any agent are for all agents.  Lines
    are numbered within their file, of which a host has one.
    """
    lines = files.select("host", F.posexplode(F.split("content", r"\r?\n")).alias("no", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", "")))
    lines = lines.select("host", "no", F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value")).where("field in ('user-agent', 'allow', 'disallow')")
    order = Window.partitionBy("host").orderBy("no")
    begins = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    lines = lines.withColumn("begins", begins).withColumn("grp", F.sum(F.col("begins").cast("int")).over(order))
    named = lines.where("field = 'user-agent'").select("host", "grp", F.lower("value").alias("agent"))
    first = lines.where("grp = 0").select("host", "grp", F.lit("*").alias("agent"))
    rules = lines.where("field = 'allow' or field = 'disallow' and value <> ''").select("host", "grp", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*"))
    return named.unionByName(first).distinct(), rules.withColumn("regex", regex)


def agent_access(sites: DataFrame, files: DataFrame, path: str = "/", agents: tuple[str, ...] = AGENTS) -> DataFrame:
    """host, agent, critical, allowed, source (explicit, wildcard or default) for each of the agents on every host of sites.

    Groups that name an agent decide alone; without one those for all agents do.  The longest rule that
    matches the path counts, an allowing one among equals; without any the path is open.
    """
    named, rules = agent_groups(files)
    asked = sites.select("host").distinct().select("host", F.explode(F.array(*map(F.lit, agents))).alias("agent"))
    wanted = asked.select("host", "agent", F.explode(F.array(F.struct(F.lower("agent").alias("name"), F.lit(1).alias("own")), F.struct(F.lit("*").alias("name"), F.lit(0).alias("own")))).alias("w")).select("host", "agent", "w.*")
    groups = wanted.join(named.withColumnRenamed("agent", "name"), ["host", "name"])
    best = groups.groupBy("host", "agent").agg(F.max("own").alias("own"))
    groups = groups.join(best, ["host", "agent", "own"]).select("host", "agent", "own", "grp")
    hits = groups.join(rules.where(F.expr(f"rlike('{path}', regex)")), ["host", "grp"], "left")
    verdict = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), F.col("allow"))))
    said = hits.groupBy("host", "agent").agg(F.max("own").alias("own"), verdict.alias("v"))
    out = asked.join(said, ["host", "agent"], "left")
    source = F.when(F.col("own") == 1, "explicit").when(F.col("own") == 0, "wildcard").otherwise("default")
    return out.select("host", "agent", F.col("agent").isin(*CRITICAL).alias("critical"), F.coalesce("v.allow", F.lit(True)).alias("allowed"), source.alias("source"))


def served_share() -> Column:
    """The share of a page's words (word_count) that its first response had (server_text_length)."""
    words = F.floor(F.coalesce("server_text_length", F.lit(0)) / LETTERS + 0.5)
    return F.when(F.col("word_count") > 0, F.least(F.lit(1.0), words / F.col("word_count"))).otherwise(1.0)


def script_dependent(pages: DataFrame) -> DataFrame:
    """host, url, share, page_rank of pages with too few words without scripts, whatever their status, by how few."""
    return pages.where(F.col("is_html") & (F.col("word_count") > SOME_WORDS)).withColumn("share", served_share()).where(F.col("share") < SERVED).select("host", "url", "share", "page_rank")


def reasons() -> Column:
    """What keeps a page from being quoted, in order."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    said = (F.when(blank("title"), "no title"), F.when(blank("description"), "no summary"), F.when(blank("h1"), "no main heading"), F.when(F.col("word_count") < ENOUGH_WORDS, F.concat(F.lit("thin content ("), F.col("word_count").cast("string"), F.lit(" words)"))))
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def answerability(pages: DataFrame) -> DataFrame:
    """host, url, page_rank, reasons (empty: ready) of every HTML page answered with 200."""
    return pages.where(F.col("is_html") & (F.col("status") == 200)).select("host", "url", "page_rank", reasons().alias("reasons"))


def readiness(sites: DataFrame, access: DataFrame, pages: DataFrame, own_files: DataFrame, grades: DataFrame) -> DataFrame:
    """host, score, reach, read, understand, quote, blocked, dependent, ready, html_pages, grade, weakest: one row for every host of sites.

    The score is over what is measured: read needs pages, quote needs grades.  pages: host, url, is_html,
    status, word_count, server_text_length, title, description, h1, page_rank; own_files: host, body (llms.txt);
    grades: host, url, overall.
    """
    live = pages.where(F.col("is_html") & (F.col("status") == 200))
    counted = live.groupBy("host").agg(F.count("*").alias("html_pages"), F.count_if((F.col("word_count") > SOME_WORDS) & (served_share() < SERVED)).alias("dependent"), F.count_if(F.size(reasons()) == 0).alias("ready"))
    open_ = access.where("critical").groupBy("host").agg(F.count_if("allowed").alias("open"), F.count("*").alias("asked"))
    graded = grades.groupBy("host").agg(F.floor(F.avg("overall") + 0.5).alias("grade"), F.min_by("url", F.struct("overall", "url")).alias("weakest"), F.min("overall").alias("least"))
    files = own_files.where("trim(body) <> ''").select("host").distinct().withColumn("file", F.lit(OWN_FILE))
    out = sites.select("host").distinct()
    for side in (counted, open_, graded, files):
        out = out.join(side, "host", "left")
    out = out.na.fill(0, ["html_pages", "dependent", "ready", "open", "asked", "file"])
    some = F.col("html_pages") > 0
    share = lambda part, whole, points: F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * points).otherwise(F.lit(float(points)))
    out = out.withColumns({
        "reach": share("open", "asked", POINTS["reach"]), "read": F.when(some, (F.col("html_pages") - F.col("dependent")) / F.col("html_pages") * POINTS["read"]),
        "understand": F.col("file") + share("ready", "html_pages", WELL_FORMED), "quote": F.col("grade") / 100 * POINTS["quote"],
    })
    got = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in POINTS), F.lit(0.0))
    most = sum((F.when(F.col(p).isNotNull(), F.lit(float(n))).otherwise(0.0) for p, n in POINTS.items()), F.lit(0.0))
    return out.select("host", F.floor(got / most * 100 + 0.5).cast("int").alias("score"), *POINTS, (F.col("asked") - F.col("open")).alias("blocked"), "dependent", "ready", "html_pages", F.col("grade").cast("int").alias("grade"), "weakest", "least", (F.col("file") > 0).alias("has_file"))


def actions(ready: DataFrame, access: DataFrame) -> DataFrame:
    """host, place, severity, pillar, action: what to do next on every host, the gravest first."""
    crit = access.where("critical and not allowed").select("host", F.lit(0).alias("rank"), F.array_position(F.array(*map(F.lit, AGENTS)), F.col("agent")).cast("int").alias("no"), F.lit("reach").alias("pillar"), F.concat(F.lit("unblock "), "agent").alias("action"))
    html, do = F.col("html_pages"), []
    do.append(F.when(F.col("dependent") > 0, F.struct(F.when(F.col("dependent") > html / 4, 0).otherwise(1).alias("rank"), F.lit(100).alias("no"), F.lit("read").alias("pillar"), F.concat(F.lit("serve without scripts: "), F.col("dependent").cast("string")).alias("action"))))
    do.append(F.when(F.col("grade").isNotNull() & (F.col("least") < WEAK), F.struct(F.lit(1).alias("rank"), F.lit(101).alias("no"), F.lit("quote").alias("pillar"), F.concat(F.lit("improve "), F.col("weakest")).alias("action"))))
    do.append(F.when(F.col("grade").isNull(), F.struct(F.lit(2).alias("rank"), F.lit(102).alias("no"), F.lit("quote").alias("pillar"), F.lit("grade the content").alias("action"))))
    do.append(F.when(~F.col("has_file"), F.struct(F.lit(2).alias("rank"), F.lit(103).alias("no"), F.lit("understand").alias("pillar"), F.lit("publish llms.txt").alias("action"))))
    do.append(F.when(html > F.col("ready"), F.struct(F.lit(2).alias("rank"), F.lit(104).alias("no"), F.lit("understand").alias("pillar"), F.concat(F.lit("complete the basics: "), (html - F.col("ready")).cast("string")).alias("action"))))
    rest = ready.select("host", F.inline(F.filter(F.array(*do), lambda x: x.isNotNull())))
    order = Window.partitionBy("host").orderBy("rank", "no")  # a dozen rows a host
    out = crit.unionByName(rest).withColumn("place", F.row_number().over(order))
    return out.select("host", "place", F.element_at(F.array(F.lit("critical"), F.lit("warning"), F.lit("opportunity")), F.col("rank") + 1).alias("severity"), "pillar", "action")


def own_file(pages: DataFrame, most: int = NAMED) -> DataFrame:
    """host, body: the llms.txt of every host, with its indexable pages of highest rank (equal ones by address).

    pages: host, url, is_html, status, indexable, title, description, page_rank, home.  The first `most` pages
    are taken before the shuffle.
    """
    home = F.col("home")
    heads = pages.groupBy("host").agg(F.min_by(F.struct("title", "description"), F.when(home, F.col("url"))).alias("h"))
    top = Window.partitionBy("host").orderBy(F.desc("page_rank"), "url")
    rows = pages.where(F.col("is_html") & (F.col("status") == 200) & F.col("indexable")).withColumn("n", F.row_number().over(top)).where(F.col("n") <= most)
    full = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    line = F.concat(F.lit("- ["), F.coalesce(full("title"), F.col("url")), F.lit("]("), F.col("url"), F.lit(")"), F.coalesce(F.concat(F.lit(": "), full("description")), F.lit("")))
    lists = rows.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    name = F.coalesce(F.nullif(F.trim(F.get(F.split("h.title", "[|·—-]"), F.lit(0))), F.lit("")), F.col("host"))
    about = F.coalesce(full("h.description"), F.concat(F.lit("Pages published on "), F.col("host"), F.lit(".")))
    return heads.join(lists, "host", "left").select("host", F.concat(F.lit("# "), name, F.lit("\n\n> "), about, F.lit("\n\n## Pages\n\n"), F.coalesce(F.concat("lines", F.lit("\n")), F.lit(""))).alias("body"))
