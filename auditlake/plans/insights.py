"""Queries on PageSpeed payloads, answer engines and link lists, and their SQL.

Payloads, robots files and page facts are made from the given rows, by expressions that both
engines read (`functions.dialect` where they spell them differently); what is computed from them
is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.dialect import Duck, Spark
from auditlake.functions.urls import bare_host, host
from auditlake.operators import answers, pagespeed
from auditlake.sources import linkfiles
from auditlake.sources.html import spread


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_V = "coalesce(cast(value as string), '0')"
_METRIC = """concat('"{}":{{"percentile":', {}, {}, '}}')"""
_CAT = "case event_id % 5 when 0 then ',\"category\":\"FAST\"' when 1 then ',\"category\":\"AVERAGE\"' when 2 then ',\"category\":\"SLOW\"' when 3 then ',\"category\":\"NONE\"' else '' end"
_FIELD = "concat('{\"metrics\":{', " + ", ',', ".join((_METRIC.format("LARGEST_CONTENTFUL_PAINT_MS", "event_id * 37 % 6000", _CAT), _METRIC.format("CUMULATIVE_LAYOUT_SHIFT_SCORE", "event_id % 40", "''"), _METRIC.format("INTERACTION_TO_NEXT_PAINT", "event_id * 7 % 900", _CAT))) + ", '}}')"
_AUDIT = """concat('"{}":{{"numericValue":', {}, ',"title":"{}"}}')"""
_SAVED = """concat('"{}":{{"details":{{"overallSavingsMs":', {}, '}}}}')"""
_AUDITS = ", ',', ".join((
    _AUDIT.format("largest-contentful-paint", _V, "t"), _AUDIT.format("cumulative-layout-shift", "concat('0.', event_id % 4)", "t"), _AUDIT.format("total-blocking-time", "event_id * 11 % 800", "t"), _AUDIT.format("speed-index", "event_id * 53 % 7000", "t"),
    *(_SAVED.format(i, f"event_id * {7 + 2 * n} % 300 + 0.5") for n, i in enumerate(pagespeed.SAVINGS[:7])),
    """case when event_id % 2 = 0 then '"largest-contentful-paint-element":{"details":{"items":[{"items":[{"node":{"selector":"#a","snippet":"<p>"}}]}]}}' when event_id % 6 = 1 then '"largest-contentful-paint-element":{"details":{"items":[{"items":[{"node":{"snippet":"<p>"}}]}]}}' else '"x":{}' end""",
))
#: A payload for every event; some are no JSON, some are errors, users' figures are there for some pages, for some origins and for none.
PAYLOAD = f"""case event_id % 11 when 0 then 'no json' when 1 then '{{"error":{{"message":"quota","code":429}}}}' else concat('{{"loadingExperience":', case event_id % 4 when 0 then {_FIELD} when 1 then '{{"metrics":{{}}}}' when 2 then '{{"origin_fallback":true}}' else 'null' end,
  ',"originLoadingExperience":', case event_id % 3 when 0 then '{{"metrics":{{"LARGEST_CONTENTFUL_PAINT_MS":{{"percentile":2500}},"FIRST_CONTENTFUL_PAINT_MS":{{"percentile":3001}}}}}}' else '{{}}' end,
  ',"lighthouseResult":{{"categories":{{"performance":{{"score":0.', substring(cast(100 + event_id * 13 % 100 as string), 2, 2), '}}}},"audits":{{', {_AUDITS}, '}}}}}}') end"""
_NAMES = tuple(pagespeed.LIMITS)


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategy = F.when(F.col("event_id") % 2 == 0, "mobile").otherwise("desktop")
    events = spread(_t(spark, sf_dir, "events").select("event_id", "user_id", "value"))
    return pagespeed.metrics(events.select("event_id", F.col("user_id").alias("site"), strategy.alias("strategy"), F.col("event_id").alias("place"), F.expr(PAYLOAD).alias("body")))


def pagespeed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures, classes and sources of a payload for every event."""
    rows = _payloads(spark, sf_dir)
    wide = [F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in _NAMES for c in ("value", "class", "source")]
    named = F.array_join(F.transform("opportunities", lambda x: F.concat_ws(":", x["id"], x["title"], x["savings_ms"].cast("string"))), ",")
    return rows.select("event_id", "error", "score", *wide, "field", "origin_fallback", "lcp_element", named.alias("opportunities"))


def pagespeed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the payloads of a user, as a site, tell the checks of a site."""
    return pagespeed.site_facts(_payloads(spark, sf_dir))


#: Robots files by the length of a host's name.
ROBOTS = (
    None, "User-agent: *\nDisallow: /private", "User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /\n\nUser-agent: *\nAllow: /", "Disallow: /\nUser-agent: CCBot # x\nDisallow:\nSitemap: x\nUser-agent: PerplexityBot\nDisallow: /\nAllow: /$",
    "user-agent: gptbot\nDisallow: /\nAllow: /*\nUser-agent: GPTBot\nDisallow: /x", "User-agent: *\nDisallow: /*\nCrawl-delay: 3\nUser-agent: Amazonbot\nSitemap: y\nuser-agent: OAI-SearchBot\nAllow: /", "no rules here",
)


def _words(d) -> str:
    text = d.sub("html", r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    return f"trim({d.sub(text, r'[ \n]+', ' ')})"


def page_facts(d) -> dict[str, str]:
    """Facts of a page by its markup and its number."""
    return {
        "page_id": "page_id", "url": "url", "is_html": "page_id % 12 <> 5", "status": "case when page_id % 10 = 9 then 404 else 200 end", "title": d.part("html", "(?s)<title>(.*?)</title>", 1), "h1": d.part("html", "(?s)<h1>(.*?)</h1>", 1),
        "description": "case when page_id % 3 = 0 then concat(' about page ', page_id) end", "word_count": f"cast(case when {_words(d)} = '' then 0 else {d.n(d.split(_words(d), ' '))} end as bigint)", "per_word": "page_id % 9", "page_rank": "(page_id * 31 % 97) / 97.0",
        "indexable": "page_id % 4 <> 2", "home": "page_id % 6 = 0",
    }


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "pages").where("html is not null").selectExpr(*(f"{e} as {n}" for n, e in page_facts(Spark()).items()))
    return rows.withColumn("host", host(F.col("url"))).withColumn("server_text_length", F.col("word_count") * F.col("per_word")).withColumn("page_rank", F.col("page_rank").cast("double"))


def _robots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sites = _t(spark, sf_dir, "pages").select(host(F.col("url")).alias("host")).distinct()
    text = F.get(F.array(*(F.lit(x).cast("string") for x in ROBOTS)), (F.length("host") % len(ROBOTS)).cast("int"))
    return sites, sites.select("host", text.alias("content")).where("content is not null")


def agent_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.agent_access(*_robots(spark, sf_dir))


def answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.answerability(_facts(spark, sf_dir)).select("host", "url", F.array_join("reasons", "; ").alias("reasons"))


def _ready(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sites, files = _robots(spark, sf_dir)
    facts = _facts(spark, sf_dir)
    own = sites.where(F.length("host") % 4 != 1).select("host", F.when(F.length("host") % 4 == 2, " \n".replace("\n", " ")).otherwise("# a file").alias("body"))
    grades = facts.where("page_id % 3 = 0 and length(host) % 5 <> 0").select("host", "url", (F.col("page_id") * 37 % 101).alias("overall"))
    access = answers.agent_access(sites, files)
    return answers.readiness(sites, access, facts, own, grades), access


def answer_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and score of every host."""
    ready = _ready(spark, sf_dir)[0]
    points = [F.round(p, 6).alias(p) for p in answers.POINTS]
    return ready.select("host", "score", *points, "blocked", "dependent", "ready", "html_pages", "grade", "weakest")


def answer_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.actions(*_ready(spark, sf_dir))


def own_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The llms.txt of every host."""
    return answers.own_file(_facts(spark, sf_dir))


#: A line of a list for each page, by its number; {} is the page's address.
_LINES = ('"{}",1', '{},https://t.example/a', '"{}","https://t.example/a,b"', '"{}""q",x,"http://z.example/"', ' {} , notes', 'see {}', '"",{}', '"{}', 'HTTPS://up.example,"a ""b"" c",https://t.example/"x"')
_HEADS = ("Linking page,Target page", "Source,Linked Page (x)", "a,b,Target", "https://first.example/,https://t.example/", "Top linking pages")


def link_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as lines of lists of linking pages, one list a host, each with a first line of one of five kinds."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "url", bare_host(F.col("url")).alias("file"))
    body = pages.select("file", F.col("page_id").alias("at"), F.replace(F.get(F.array(*map(F.lit, _LINES)), (F.col("page_id") % len(_LINES)).cast("int")), F.lit("{}"), F.col("url")).alias("line"))
    heads = pages.select("file").distinct().select("file", F.lit(-1).cast("long").alias("at"), F.get(F.array(*map(F.lit, _HEADS)), (F.length("file") % len(_HEADS)).cast("int")).alias("line"))
    return linkfiles.links(body.unionByName(heads))


QUERIES = {f.__name__: f for f in (pagespeed_metrics, pagespeed_facts, agent_access, answerability, answer_readiness, answer_actions, own_files, link_import)}


def _q(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_D = Duck()
_J = lambda path: f"json_extract_string(j, '$.{path}')"


def _metric_sql(name: str) -> str:
    good, poor = pagespeed.LIMITS[name]
    field, lab = pagespeed.FIELD.get(name), pagespeed.LAB.get(name)
    users = f"TRY_CAST(json_extract_string(f, '$.{field}.percentile') AS DOUBLE){' / 100' if name == 'cls' else ''}" if field else "CAST(NULL AS DOUBLE)"
    own = f"CASE json_extract_string(f, '$.{field}.category') WHEN 'FAST' THEN 'GOOD' WHEN 'AVERAGE' THEN 'NEEDS_IMPROVEMENT' WHEN 'SLOW' THEN 'POOR' END" if field else "CAST(NULL AS VARCHAR)"
    labs = f"""coalesce(TRY_CAST(json_extract_string(j, '$.lighthouseResult.audits."{lab}".numericValue') AS DOUBLE), 0)""" if lab else "CAST(NULL AS DOUBLE)"
    kind = f"CASE WHEN coalesce(u, l) <= {good} THEN 'GOOD' WHEN coalesce(u, l) <= {poor} THEN 'NEEDS_IMPROVEMENT' ELSE 'POOR' END"
    return f"(SELECT CASE WHEN error IS NULL AND coalesce(u, l) IS NOT NULL THEN {{'value': coalesce(u, l), 'class': CASE WHEN u IS NOT NULL AND o IS NOT NULL THEN o ELSE {kind} END, 'source': CASE WHEN u IS NOT NULL THEN 'field' ELSE 'lab' END}} END FROM (SELECT {users} AS u, {own} AS o, {labs} AS l))"


_SAVE = ", ".join(f"""{{'n': {n}, 'id': '{i}', 's': TRY_CAST(json_extract_string(j, '$.lighthouseResult.audits."{i}".details.overallSavingsMs') AS DOUBLE)}}""" for n, i in enumerate(pagespeed.SAVINGS))
_PSI = f"""
p0 AS (SELECT event_id, user_id, {PAYLOAD.replace('cast(value as string)', 'CAST(value AS VARCHAR)').replace(' as string)', ' AS VARCHAR)')} AS body FROM events),
p1 AS (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM p0),
p2 AS (SELECT *, CASE WHEN j IS NULL THEN 'no JSON' WHEN json_type(j, '$.error') IN ('OBJECT') THEN {_J('error.message')} END AS error, coalesce(json_type(j, '$.loadingExperience.metrics') = 'OBJECT', false) AS own, coalesce(json_type(j, '$.originLoadingExperience.metrics') = 'OBJECT', false) AS org FROM p1),
p3 AS MATERIALIZED (SELECT *, CASE WHEN own THEN json_extract(j, '$.loadingExperience.metrics') WHEN org THEN json_extract(j, '$.originLoadingExperience.metrics') END AS f FROM p2),
p4 AS MATERIALIZED (SELECT event_id, user_id, error, CASE WHEN error IS NULL THEN CAST(floor(coalesce(TRY_CAST({_J('lighthouseResult.categories.performance.score')} AS DOUBLE), 0) * 100 + 0.5) AS INTEGER) END AS score, {', '.join(f'{_metric_sql(n)} AS {n}' for n in _NAMES)}, error IS NULL AND f IS NOT NULL AS field,
  error IS NULL AND ((NOT own AND org) OR coalesce({_J('loadingExperience.origin_fallback')} = 'true', false)) AS origin_fallback, CASE WHEN error IS NULL THEN coalesce(json_extract_string(j, '$.lighthouseResult.audits."largest-contentful-paint-element".details.items[0].items[0].node.selector'), json_extract_string(j, '$.lighthouseResult.audits."largest-contentful-paint-element".details.items[0].items[0].node.snippet')) END AS lcp_element,
  CASE WHEN error IS NULL THEN (SELECT coalesce(string_agg(id || ':' || id || ':' || CAST(floor(s + 0.5) AS BIGINT), ',' ORDER BY r), '') FROM (SELECT *, row_number() OVER (ORDER BY floor(s + 0.5) DESC, n) AS r FROM (SELECT unnest([{_SAVE}], recursive := true)) WHERE s >= 100) WHERE r <= 5) END AS opportunities FROM p3)"""
_WIDE = ", ".join(f"{n}['{c}'] AS {n}_{c}" for n in _NAMES for c in ("value", "class", "source"))
_FACTS_SQL = f"fc AS MATERIALIZED (SELECT *, word_count * per_word AS server_text_length, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in page_facts(_D).items())} FROM pages WHERE html IS NOT NULL))"
_LIVE = """lv AS MATERIALIZED (SELECT *, word_count > 50 AND least(1.0, floor(server_text_length / 5.5 + 0.5) / word_count) < 0.6 AS dependent, list_filter([CASE WHEN coalesce(title, '') = '' THEN 'no title' END, CASE WHEN coalesce(description, '') = '' THEN 'no summary' END, CASE WHEN coalesce(h1, '') = '' THEN 'no main heading' END,
  CASE WHEN word_count < 300 THEN 'thin content (' || word_count || ' words)' END], lambda x: x IS NOT NULL) AS why FROM fc WHERE is_html AND status = 200)"""
_ACCESS = f"""
hs AS MATERIALIZED (SELECT DISTINCT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages),
rb AS (SELECT host, unnest(string_split(r, chr(10))) AS raw, unnest(range(len(string_split(r, chr(10))))) AS no FROM (SELECT host, [{', '.join('NULL' if x is None else ' || chr(10) || '.join(_q(y) for y in x.split(chr(10))) for x in ROBOTS)}][length(host) % {len(ROBOTS)} + 1] AS r FROM hs) WHERE r IS NOT NULL),
rl AS (SELECT host, no, lower(trim(string_split(l, ':')[1])) AS field, trim(substring(l, instr(l, ':') + 1)) AS v FROM (SELECT host, no, trim(regexp_replace(raw, '#.*$', '')) AS l FROM rb) WHERE contains(l, ':')),
rk AS (SELECT *, (SELECT count(*) FROM rl a WHERE a.host = rl.host AND a.no <= rl.no AND a.field = 'user-agent' AND coalesce((SELECT arg_max(b.field, b.no) FROM rl b WHERE b.host = a.host AND b.no < a.no AND b.field IN ('user-agent', 'allow', 'disallow')), '') <> 'user-agent') AS grp FROM rl WHERE field IN ('user-agent', 'allow', 'disallow')),
ga AS (SELECT host, grp, lower(v) AS agent FROM rk WHERE field = 'user-agent' UNION SELECT host, grp, '*' FROM rk WHERE grp = 0),
ag AS (SELECT host, unnest([{', '.join(map(_q, answers.AGENTS))}]) AS agent FROM hs),
us AS MATERIALIZED (SELECT host, agent, CASE WHEN EXISTS (SELECT 1 FROM ga WHERE ga.host = ag.host AND ga.agent = lower(ag.agent)) THEN 'explicit' WHEN EXISTS (SELECT 1 FROM ga WHERE ga.host = ag.host AND ga.agent = '*') THEN 'wildcard' ELSE 'default' END AS source FROM ag),
ac AS MATERIALIZED (SELECT host, agent, agent IN ({', '.join(map(_q, answers.CRITICAL))}) AS critical, source, coalesce((SELECT arg_max(field = 'allow', (length(v), field = 'allow')) FROM rk WHERE rk.host = us.host AND field <> 'user-agent' AND v IN ('/', '/*', '/$') AND grp IN (SELECT grp FROM ga WHERE ga.host = us.host AND ga.agent = CASE us.source WHEN 'explicit' THEN lower(us.agent) ELSE '*' END)), true) AS allowed FROM us)"""
_READY = f"""{_ACCESS}, {_FACTS_SQL}, {_LIVE},
c AS (SELECT host, count(*) AS html_pages, count(*) FILTER (WHERE dependent) AS dependent, count(*) FILTER (WHERE len(why) = 0) AS ready FROM lv GROUP BY host),
o AS (SELECT host, count(*) FILTER (WHERE critical AND NOT allowed) AS blocked FROM ac GROUP BY host),
g AS (SELECT host, CAST(floor(avg(page_id * 37 % 101) + 0.5) AS INTEGER) AS grade, arg_min(url, (page_id * 37 % 101, url)) AS weakest, min(page_id * 37 % 101) AS least FROM fc WHERE page_id % 3 = 0 AND length(host) % 5 <> 0 GROUP BY host),
x AS (SELECT h.host, coalesce(html_pages, 0) AS html_pages, coalesce(dependent, 0) AS dependent, coalesce(ready, 0) AS ready, blocked, grade, weakest, least, length(h.host) % 4 IN (0, 3) AS has_file, (6 - blocked) / 6 * 30 AS reach, CASE WHEN html_pages > 0 THEN (html_pages - dependent) / html_pages * 25 END AS read,
  CASE WHEN length(h.host) % 4 IN (0, 3) THEN 7 ELSE 0 END + CASE WHEN html_pages > 0 THEN ready / html_pages * 8 ELSE 8.0 END AS understand, grade / 100 * 30 AS quote FROM hs h JOIN o ON o.host = h.host LEFT JOIN c ON c.host = h.host LEFT JOIN g ON g.host = h.host),
y AS MATERIALIZED (SELECT *, CAST(floor((reach + coalesce(read, 0) + understand + coalesce(quote, 0)) / (45 + CASE WHEN read IS NULL THEN 0 ELSE 25 END + CASE WHEN quote IS NULL THEN 0 ELSE 30 END) * 100 + 0.5) AS INTEGER) AS score FROM x)"""
_ACTIONS = f"""n AS (SELECT host, 0 AS r, list_position([{', '.join(map(_q, answers.AGENTS))}], agent) AS no, 'reach' AS pillar, 'unblock ' || agent AS action FROM ac WHERE critical AND NOT allowed
  UNION ALL SELECT host, CASE WHEN dependent > html_pages / 4 THEN 0 ELSE 1 END, 100, 'read', 'serve without scripts: ' || dependent FROM y WHERE dependent > 0 UNION ALL SELECT host, 1, 101, 'quote', 'improve ' || weakest FROM y WHERE least < 60 UNION ALL SELECT host, 2, 102, 'quote', 'grade the content' FROM y WHERE grade IS NULL
  UNION ALL SELECT host, 2, 103, 'understand', 'publish llms.txt' FROM y WHERE NOT has_file UNION ALL SELECT host, 2, 104, 'understand', 'complete the basics: ' || (html_pages - ready) FROM y WHERE html_pages > ready)"""
_TEXT = "nullif(trim(coalesce({}, '')), '')"
#: The cells of a line, a character at a time: cells before, this cell, whether within quotes, whether a quote was just ended.
_CELLS = """list_transform(list_append(z.done, z.cur), lambda c: trim(c))"""
_STEP = """list_reduce(list_prepend({'done': CAST([] AS VARCHAR[]), 'cur': '', 'q': false, 'was': false, 'c': ''}, list_transform(string_split(line, ''), lambda ch: {'done': CAST([] AS VARCHAR[]), 'cur': '', 'q': false, 'was': false, 'c': ch})), lambda s, x:
  CASE WHEN x.c = '"' AND s.q THEN {'done': s.done, 'cur': s.cur, 'q': false, 'was': true, 'c': ''} WHEN x.c = '"' AND s.was THEN {'done': s.done, 'cur': s.cur || '"', 'q': true, 'was': false, 'c': ''} WHEN x.c = '"' THEN {'done': s.done, 'cur': s.cur, 'q': true, 'was': false, 'c': ''}
  WHEN x.c = ',' AND NOT s.q THEN {'done': list_append(s.done, s.cur), 'cur': '', 'q': false, 'was': false, 'c': ''} ELSE {'done': s.done, 'cur': s.cur || x.c, 'q': s.q, 'was': false, 'c': ''} END)"""
ORACLES = {
    "pagespeed_metrics": f"WITH {_PSI} SELECT event_id, error, score, {_WIDE}, field, origin_fallback, lcp_element, opportunities FROM p4",
    "pagespeed_facts": f"WITH {_PSI} SELECT user_id AS site, " + ", ".join(f"arg_min({n}['class'], event_id) FILTER (WHERE error IS NULL AND event_id % 2 = 0 AND {n} IS NOT NULL) AS {n}" for n in ("lcp", "cls", "tbt")) + ", arg_min_null(inp['class'], event_id) FILTER (WHERE error IS NULL AND event_id % 2 = 0) AS inp, arg_min(score, event_id) FILTER (WHERE error IS NULL AND event_id % 2 = 0) AS mobile_score, arg_min(score, event_id) FILTER (WHERE error IS NULL AND event_id % 2 = 1) AS desktop_score, arg_min(score, event_id) FILTER (WHERE error IS NULL) AS first_score, bool_or(error IS NULL) AS pagespeed FROM p4 GROUP BY user_id",
    "agent_access": f"WITH {_ACCESS} SELECT host, agent, critical, allowed, source FROM ac",
    "answerability": f"WITH {_FACTS_SQL}, {_LIVE} SELECT host, url, array_to_string(why, '; ') AS reasons FROM lv",
    "answer_readiness": f"WITH {_READY} SELECT host, score, round(reach, 6) AS reach, round(read, 6) AS read, round(understand, 6) AS understand, round(quote, 6) AS quote, blocked, dependent, ready, html_pages, grade, weakest FROM y",
    "answer_actions": f"WITH {_READY}, {_ACTIONS} SELECT host, CAST(row_number() OVER (PARTITION BY host ORDER BY r, no) AS INTEGER) AS place, ['critical', 'warning', 'opportunity'][r + 1] AS severity, pillar, action FROM n",
    "own_files": f"""WITH {_FACTS_SQL}, h AS (SELECT host, arg_min({{'t': title, 'd': description}}, url) FILTER (WHERE home) AS x FROM fc GROUP BY host), t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_rank DESC, url) AS n FROM fc WHERE is_html AND status = 200 AND indexable),
l AS (SELECT host, string_agg('- [' || coalesce({_TEXT.format('title')}, url) || '](' || url || ')' || coalesce(': ' || {_TEXT.format('description')}, ''), chr(10) ORDER BY n) AS lines FROM t WHERE n <= 25 GROUP BY host)
SELECT h.host, '# ' || coalesce(nullif(trim(string_split_regex(x.t, '[|·—-]')[1]), ''), h.host) || chr(10) || chr(10) || '> ' || coalesce({_TEXT.format('x.d')}, 'Pages published on ' || h.host || '.') || chr(10) || chr(10) || '## Pages' || chr(10) || chr(10) || coalesce(lines || chr(10), '') AS body FROM h LEFT JOIN l ON l.host = h.host""",
    "link_import": f"""WITH ps AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS file FROM pages),
li AS (SELECT file, page_id AS p, replace([{', '.join(map(_q, _LINES))}][page_id % {len(_LINES)} + 1], '{{}}', url) AS line FROM ps UNION ALL SELECT DISTINCT file, -1, [{', '.join(map(_q, _HEADS))}][length(file) % {len(_HEADS)} + 1] FROM ps),
ce AS MATERIALIZED (SELECT file, p, {_CELLS} AS c FROM (SELECT file, p, {_STEP} AS z FROM li)),
hd AS (SELECT file, len(list_filter(c, lambda x: regexp_matches(lower(x), '{linkfiles.HEADER}'))) > 0 AS header, list_filter(range(1, len(c) + 1), lambda i: regexp_matches(lower(c[i]), '{linkfiles.TARGET}'))[1] AS spot FROM ce WHERE p = -1)
SELECT ce.file, ce.p AS "at", c[1] AS source, CASE WHEN spot > 1 AND regexp_matches(c[spot], '(?i)^https?://') THEN c[spot] END AS target FROM ce JOIN hd ON hd.file = ce.file WHERE NOT (header AND ce.p = -1) AND regexp_matches(c[1], '(?i)^https?://')""",
}
