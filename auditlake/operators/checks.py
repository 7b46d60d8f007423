"""The registry of page checks: each is an identifier, a category, a severity, a scope and a Column that is true where it fails."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.dialect import Spark
from auditlake.operators import predicates
from auditlake.operators.facts import prepared

#: Penalty of a failed check.
SEVERITY = {"blocker": 120.0, "critical": 25.0, "warning": 7.0, "opportunity": 2.0, "notice": 0.5}
#: Categories in the order of a report.
CATEGORIES = (
    "nextjs", "links", "indexability", "content-relevance", "duplicate-content", "security", "internal", "page-speed", "redirects", "social-media", "code-validation", "search-traffic", "mobile-friendly", "xml-sitemaps", "localization",
)
#: Fixed value: pages named for a check at most; the count beside them is whole.
MOST_NAMED = 500


@dataclass(frozen=True)
class Check:
    id: str
    category: str
    severity: str
    fails: Column
    scope: str = "true"
    selector: tuple[tuple[str, ...], bool] | None = None


def units(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.octet_length(F.encode(c, "UTF-16LE")) / 2


def token(name: str) -> Column:
    """A robots directive is among the page's, as a whole token."""
    return F.expr(predicates.directive(Spark(), name, header=False))


@cache
def registry() -> list[Check]:
    """All checks on one page, in order; identifiers are unique."""
    found = [Check(i, c, s, F.expr(p), scope, predicates.SELECTORS.get(i)) for i, c, s, scope, p in predicates.page_checks(Spark())]
    assert len({c.id for c in found}) == len(found), "check ids must be unique"
    return found


def _some(*ids: str) -> list[Check]:
    by = {c.id: c for c in registry()}
    return [by[i] for i in ids]


def url_checks() -> list[Check]:
    """Checks on the address alone."""
    return _some(
        "long-urls", "url-uppercase", "url-underscores", "url-whitespace", "url-repetitive-elements", "double-slash-in-url", "more-than-three-parameters", "query-question-mark", "query-repetitive-parameters",
        "query-paginated-parameters", "query-search-filter-parameters", "http-urls",
    )


def markup_checks() -> list[Check]:
    """Checks on the raw markup alone, in the JVM."""
    tags = [f"{t}-{what}-missing" for t in ("html", "head", "body") for what in ("tag", "close")] + [f"multiple-{t}-tags" for t in ("html", "head", "body")]
    return _some(*tags, "page-code-under-500", "page-size-over-1-5mb", "page-size-over-2mb", "no-gtm-code", "multiple-gtm-codes", "http-link-w3-org", "http-link-schema-org")


def ready(pages: DataFrame) -> DataFrame:
    """pages with all that checks read, unless they have it already (rows with traffic have what the checks on traffic read)."""
    if not {"strategy", "_known"} & set(pages.columns):
        return prepared(pages)
    return pages if "crawl_order" in pages.columns else pages.withColumn("crawl_order", F.col("page_id").cast("long"))


def evaluate(pages: DataFrame, checks: list[Check], keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep, check_id, category, severity of every failed check in its scope, from one pass over the pages; unknown counts as passed."""
    rows = [F.struct(F.lit(c.id).alias("check_id"), F.lit(c.category).alias("category"), F.lit(c.severity).alias("severity"), F.coalesce(F.expr(c.scope) & c.fails, F.lit(False)).alias("failed")) for c in checks]
    # outer, as Spark would otherwise filter on the list's size below the derived names and repeat all their expressions there
    return ready(pages).select(*keep, F.inline_outer(F.filter(F.array(*rows), lambda x: x["failed"]))).where("check_id is not null").drop("failed")


def marks(pages: DataFrame, checks: list[Check]) -> DataFrame:
    """page_id, crawl_order, scopes and failed (places of scopes and checks in their lists) of every page: one pass, a few numbers a row."""
    return ready(pages).select("page_id", F.col("crawl_order").cast("long").alias("crawl_order"), *marked(checks))


def marked(checks: list[Check]) -> list[Column]:
    """scopes and failed of `marks`, from the columns of `ready`."""
    scopes = _scopes(checks)
    sure = lambda c: F.coalesce(c, F.lit(False))
    # not F.filter: what is beneath a function of functions is interpreted for every row, and nothing common to two checks is shared
    places = lambda conditions: F.array_remove(F.array(*(F.when(sure(c), F.lit(i)).otherwise(F.lit(-1)) for i, c in enumerate(conditions))), -1)
    return [places(F.expr(s) for s in scopes).alias("scopes"), places(F.expr(c.scope) & c.fails for c in checks).alias("failed")]


def _scopes(checks: list[Check]) -> list[str]:
    return sorted({c.scope for c in checks})


def outcomes(pages: DataFrame, checks: list[Check], ignored: tuple[str, ...] = (), platforms: tuple[str, ...] | None = None, next_site: bool | None = None, named: bool = True) -> DataFrame:
    """check_id, category, severity, verdict, reason, affected, applicable, pages: one row per check, in the order of the registry (column place).

    verdict: failed, passed or skipped; reason says why one was skipped: it was ignored, the site is known not to be
    of its framework (next_site false) or platform (platforms: names and kinds found on the site; None: not known), or
    no page is in its scope.  pages names the first MOST_NAMED affected ones in crawl order, or none if they are not to be
    named, which saves ordering them; affected counts all.
    pages: records, or rows of `marks`, which may be cut off with a checkpoint and used again.
    """
    rows, spark = pages if "failed" in pages.columns else marks(pages, checks), pages.sparkSession
    why, scopes = [], _scopes(checks)
    for c in checks:
        reason = "ignored" if c.id in ignored else "framework" if c.scope == predicates.NEXT and next_site is False else None
        if reason is None and c.selector and platforms is not None and c.selector[1] != bool(set(c.selector[0]) & set(platforms)):
            reason = "platform"
        why.append(reason)
    catalog = spark.createDataFrame([(n, c.id, c.category, c.severity, scopes.index(c.scope), r) for n, (c, r) in enumerate(zip(checks, why))], "place int, check_id string, category string, severity string, scope int, reason string")
    counts = rows.select(F.explode_outer("scopes").alias("scope")).groupBy("scope").agg(F.count("*").alias("applicable"))
    found = rows.select("page_id", "crawl_order", F.explode_outer("failed").alias("place")).where("place is not null")
    none = F.array().cast("array<long>")
    sums = found.groupBy("place").agg(F.count("*").alias("affected"))
    if named:
        first = Window.partitionBy("place").orderBy("crawl_order", "page_id")
        names = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= MOST_NAMED)  # limited before the shuffle
        sums = sums.join(names.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "page_id"))), lambda x: x["page_id"]).alias("pages")), "place")
    else:
        sums = sums.withColumn("pages", none)
    out = catalog.join(counts, "scope", "left").join(sums, "place", "left").na.fill(0, ["applicable", "affected"])
    reason = F.coalesce("reason", F.when(F.col("applicable") == 0, "no page in scope"))
    out = out.withColumn("reason", reason)
    run = F.col("reason").isNull()
    verdict = F.when(~run, "skipped").when(F.col("affected") > 0, "failed").otherwise("passed")
    return out.select("place", "check_id", "category", "severity", verdict.alias("verdict"), "reason", F.when(run, F.col("affected")).otherwise(0).cast("long").alias("affected"), F.col("applicable").cast("long"), F.coalesce(F.when(run, F.col("pages")), none).alias("pages"))


def capped(findings: DataFrame) -> DataFrame:
    """findings (page_id, crawl_order, check_id, ...) of the first MOST_NAMED pages of each check, those that a report's page scores are made of."""
    first = Window.partitionBy("check_id").orderBy("crawl_order", "page_id")
    return findings.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= MOST_NAMED).drop("_n")


def page_scores(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, penalty, score: score = 100 * exp(-penalty / 100) over the penalties of failed checks."""
    weight = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.col("severity")]
    sums = findings.groupBy("page_id").agg(F.sum(weight).alias("penalty"), F.count("*").alias("issues"))
    out = pages.select("page_id", "url").join(sums, "page_id", "left").na.fill(0, ["penalty", "issues"])
    return out.withColumn("score", F.round(100 * F.exp(-F.col("penalty") / 100), 6))


def scored(pages: DataFrame, checks: list[Check]) -> DataFrame:
    """page_id, url, penalty, issues, score of every page from its own failures, in one pass without a shuffle."""
    failed = [F.coalesce(F.expr(c.scope) & c.fails, F.lit(False)) for c in checks]
    own = F.filter(F.array(*(F.when(f, F.lit(SEVERITY[c.severity])) for f, c in zip(failed, checks))), lambda x: x.isNotNull())
    out = ready(pages).select("page_id", "url", own.alias("_own"))
    penalty = F.aggregate("_own", F.lit(0.0), lambda a, x: a + x)
    return out.select("page_id", "url", penalty.alias("penalty"), F.size("_own").cast("long").alias("issues"), F.round(100 * F.exp(-penalty / 100), 6).alias("score"))


def category_summary(pages: DataFrame, checks: list[Check]) -> DataFrame:
    """place, category, failed, passed, skipped, touched, share of every category with checks; touched pages count once, share is their part of all. pages: as of outcomes, used more than once."""
    marked = pages if "failed" in pages.columns else marks(pages, checks)
    order = F.create_map(*(F.lit(x) for i, c in enumerate(CATEGORIES) for x in (c, i)))
    of = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    rows = outcomes(marked, checks).groupBy("category").agg(of("failed"), of("passed"), of("skipped"))
    names = sorted({c.category for c in checks})
    own = F.array(*(F.lit(names.index(c.category)) for c in checks))
    touched = marked.select(F.explode_outer(F.array_distinct(F.transform("failed", lambda i: F.get(own, i)))).alias("c")).groupBy("c").agg(F.count("*").alias("touched"))
    touched = touched.select(F.get(F.array(*map(F.lit, names)), F.col("c")).alias("category"), "touched")
    out = rows.join(touched, "category", "left").na.fill(0, ["touched"]).join(F.broadcast(marked.agg(F.greatest(F.count("*"), F.lit(1)).alias("all"))))  # one row
    return out.select(order[F.col("category")].alias("place"), "category", "failed", "passed", "skipped", "touched", F.round(F.col("touched") / F.col("all"), 6).alias("share"))
