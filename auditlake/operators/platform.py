"""What a site is built with: evidence in markup and headers, weighed by page, then by site.

A rule has signals; a signal is a weight and some literals of which one must stand in a place.
All literals of all rules that are looked for in the markup go into one automaton, which reads a
page's lower-case markup once; those that are looked for as written are confirmed then.  What
the generator tag and the headers say, the sums, the ranking and the sites are Columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Platform | name | kind, and its signals: weight, place, literals of which one must be there.
#: Places: page (markup in lower case), source (markup as written), generator (the generator tag, in lower case),
#: header NAME (its value has one of them), sent (one of these headers has a value), sent-prefix (a header's name begins so).
RULES = """
wordpress | WordPress | cms
  0.95 page: /wp-content/
  0.9 page: /wp-includes/
  0.9 generator: wordpress
  0.5 header link: /wp-json/
  0.4 page: wp-emoji, wp-block-library
woocommerce | WooCommerce | ecommerce
  0.9 page: /plugins/woocommerce/, woocommerce-page
  0.5 header set-cookie: woocommerce_
shopify | Shopify | ecommerce
  0.95 page: cdn.shopify.com, cdn/shop/
  0.9 source: Shopify.theme, var Shopify =
  0.6 sent: x-shopid, x-shopify-stage
drupal | Drupal | cms
  0.9 generator: drupal
  0.85 source: drupalSettings; page: /sites/default/files/
  0.6 sent: x-drupal-cache, x-drupal-dynamic-cache
joomla | Joomla | cms
  0.9 generator: joomla
  0.7 page: /media/jui/, /media/system/js/
ghost | Ghost | cms
  0.9 generator: ghost
  0.6 page: ghost-sdk, /assets/built/
typo3 | TYPO3 | cms
  0.9 generator: typo3
  0.6 page: /typo3conf/, /typo3temp/
craft | Craft CMS | cms
  0.7 header set-cookie: craftsessionid
  0.6 page: /cpresources/
wix | Wix | site-builder
  0.95 page: wixstatic.com, wix.com
  0.8 generator: wix
  0.6 sent-prefix: x-wix-
squarespace | Squarespace | site-builder
  0.95 page: squarespace-cdn.com, static1.squarespace.com
  0.8 source: SQUARESPACE_CONTEXT
webflow | Webflow | site-builder
  0.9 generator: webflow
  0.85 page: data-wf-page, data-wf-site
weebly | Weebly | site-builder
  0.9 page: weebly.com, _wl_
framer | Framer | site-builder
  0.9 generator: framer
  0.7 page: framerusercontent.com
blogger | Blogger | site-builder
  0.9 generator: blogger
  0.7 page: blogblog.com, .blogspot.
magento | Magento | ecommerce
  0.85 page: /static/frontend/, mage/requirejs
  0.6 header set-cookie: mage-
prestashop | PrestaShop | ecommerce
  0.85 page: var prestashop; generator: prestashop
bigcommerce | BigCommerce | ecommerce
  0.9 page: bigcommerce.com/s-, cdn11.bigcommerce.com
salesforce-commerce | Salesforce Commerce Cloud | ecommerce
  0.85 page: demandware.static, /on/demandware.store/
nextjs | Next.js | framework
  0.9 page: /_next/static/
  0.9 source: __NEXT_DATA__
  0.85 source: self.__next_f
nuxt | Nuxt | framework
  0.95 source: __NUXT__, __nuxt
  0.6 page: /_nuxt/
astro | Astro | framework
  0.9 generator: astro
  0.7 page: astro-island, data-astro-
sveltekit | SvelteKit | framework
  0.9 source: __sveltekit; page: data-sveltekit
remix | Remix | framework
  0.9 source: __remixContext, __remixManifest
gatsby | Gatsby | framework
  0.9 source: ___gatsby
  0.5 generator: gatsby
docusaurus | Docusaurus | framework
  0.9 generator: docusaurus
  0.6 source: __docusaurus
angular | Angular | framework
  0.85 page: <app-root, ng-version=
vue | Vue | framework
  0.5 page: data-v-app, __vue__
react | React | framework
  0.45 source: data-reactroot, __REACT_DEVTOOLS
laravel | Laravel | server
  0.8 header set-cookie: laravel_session, xsrf-token
  0.5 page: livewire
django | Django | server
  0.8 header set-cookie: csrftoken
  0.5 page: /static/admin/
rails | Ruby on Rails | server
  0.8 page: name="csrf-param"
  0.5 header set-cookie: _session_id
aspnet | ASP.NET | server
  0.8 sent: x-aspnet-version, x-aspnetmvc-version
  0.7 source: __VIEWSTATE
hugo | Hugo | ssg
  0.9 generator: hugo
jekyll | Jekyll | ssg
  0.9 generator: jekyll
eleventy | Eleventy | ssg
  0.9 generator: eleventy, 11ty
"""
#: Platforms that lose to any other, and those that run PHP.
GENERIC = ("react", "vue")
PHP = ("wordpress", "woocommerce", "drupal", "joomla", "typo3", "craft", "laravel", "magento", "prestashop")
#: The generator tag with its attributes in either order; how sure a name without a rule is, and from where on a verdict gates checks.
GENERATOR = (r"""(?i)<meta[^>]+name=["']generator["'][^>]*content=["']([^"']*)["']""", r"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]*name=["']generator["']""")
UNRULED, SURE = 0.4, 0.5


def rules() -> list[tuple[str, str, str, list[tuple[float, list[tuple[str, str]]]]]]:
    """(platform, name, kind, signals); a signal is (weight, [(place, literal), ...])."""
    out: list = []
    for line in RULES.strip().splitlines():
        if line[0] != " ":
            out.append((*(x.strip() for x in line.split("|")), []))
            continue
        weight, said = line.split(None, 1)
        places = []
        for clause in said.split("; "):
            place, literals = clause.split(": ", 1)
            places += [(place, x) for x in literals.split(", ")]
        out[-1][3].append((float(weight), places))
    return out


def literals() -> list[tuple[str, bool]]:
    """Everything looked for in the markup, and whether as written."""
    return list(dict.fromkeys((x, place == "source") for *_, signals in rules() for _, places in signals for place, x in places if place in ("page", "source")))


def _hits(found: list[tuple[str, bool]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batch with column hits: numbers of the literals in each page's markup, from one reading of it."""
    import ahocorasick

    machine, by = ahocorasick.Automaton(), {}
    for n, (x, _) in enumerate(found):
        by.setdefault(x.lower(), []).append(n)
    for x, n in by.items():
        machine.add_word(x, n)
    machine.make_automaton()
    for batch in batches:
        rows = []
        for html in batch.column("html").to_pylist():
            seen = {n for _, ns in machine.iter(html.lower()) for n in ns} if html else ()
            rows.append([n for n in sorted(seen) if not found[n][1] or found[n][0] in html])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int32()))], [*batch.schema.names, "hits"])


def generator(html: Column) -> Column:
    """What the page's generator tag says, in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(html, GENERATOR[0], 1), F.lit("")), F.regexp_extract(html, GENERATOR[1], 1), F.lit("")))


def _signal(places: list[tuple[str, str]], number: dict) -> Column:
    """Whether one of a signal's literals is in its place."""
    own = [number[x, place == "source"] for place, x in places if place in ("page", "source")]
    tests = [F.arrays_overlap("hits", F.array(*map(F.lit, own)))] if own else []
    for place, x in places:
        if place == "generator":
            tests.append(F.contains("generator", F.lit(x)))
        elif place.startswith("header "):
            tests.append(F.contains(F.coalesce(F.try_element_at("headers", F.lit(place[7:])), F.lit("")), F.lit(x)))
        elif place == "sent":
            tests.append(F.coalesce(F.try_element_at("headers", F.lit(x)), F.lit("")) != "")
        elif place == "sent-prefix":
            tests.append(F.exists(F.map_keys("headers"), lambda k: F.startswith(k, F.lit(x))))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def said(places: list[tuple[str, str]]) -> str:
    """A signal in words, as evidence."""
    by: dict[str, list[str]] = {}
    for place, x in places:
        by.setdefault(place, []).append(x)
    return " or ".join(f"{place} has {' or '.join(xs)}" for place, xs in by.items())


def page_platforms(pages: DataFrame) -> DataFrame:
    """page_id, url, crawl_order and a page's verdict: platform, label, kind, confidence, evidence, matches (best first), generator.

    pages: page_id, url, crawl_order, html, headers (names in lower case), is_next (the framework's
    own fingerprint).  A page without markup, or that nothing speaks for, has platform `unknown`; one
    whose generator tag has no rule is `unknown` by that name.
    """
    found, table = literals(), rules()
    number = {x: n for n, x in enumerate(found)}
    kinds = pages.select("page_id", "url", "crawl_order", "html", "headers", "is_next")
    empty = F.create_map().cast("map<string,string>")
    kinds = kinds.withColumns({"headers": F.transform_keys(F.coalesce("headers", empty), lambda k, _: F.lower(k)), "html": F.nullif("html", F.lit(""))})
    out = kinds.mapInArrow(lambda b: _hits(found, b), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.schema) + ", hits array<int>")
    out = out.withColumn("generator", generator(F.col("html")))
    match = "struct<place:int,platform:string,label:string,kind:string,confidence:double,evidence:array<string>>"
    rows = []
    for n, (platform, label, kind, signals) in enumerate(table):
        spoke = F.filter(F.array(*(F.when(_signal(places, number), F.struct(F.lit(w).alias("w"), F.lit(said(places)).alias("why"))) for w, places in signals)), lambda x: x.isNotNull())
        one = F.aggregate(spoke, F.struct(F.lit(0.0).alias("w"), F.array().cast("array<string>").alias("why")), lambda a, x: F.struct((a["w"] + x["w"]).alias("w"), F.array_append(a["why"], x["why"]).alias("why")))
        sure, why, place = F.least(F.lit(1.0), one["w"]), one["why"], F.lit(n)
        if platform == "nextjs":  # its own fingerprint is sure, and comes after all others of that confidence
            own = F.coalesce("is_next", F.lit(False))
            sure, why, place = F.when(own, F.lit(1.0)).otherwise(sure), F.when(own, F.concat(F.array(F.lit("fingerprint of the framework")), why)).otherwise(why), F.when(own, F.lit(len(table))).otherwise(place)
        rows.append(F.when(sure > 0, F.struct(place.alias("place"), F.lit(platform).alias("platform"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), sure.alias("confidence"), why.alias("evidence")).cast(match)))
    matches = F.filter(F.array(*rows), lambda x: x.isNotNull() & F.col("html").isNotNull())
    out = out.withColumn("matches", F.array_sort(matches, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(a["place"] - b["place"])))
    specific = F.filter("matches", lambda m: ~m["platform"].isin(*GENERIC))
    first = F.coalesce(F.get(specific, F.lit(0)), F.get("matches", F.lit(0)))
    named = F.col("html").isNotNull() & (F.col("generator") != "")
    name = F.substring("generator", 1, 40)
    by_name = F.struct(F.lit(-1).alias("place"), F.lit("unknown").alias("platform"), F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 39)).alias("label"), F.lit("unknown").alias("kind"), F.lit(UNRULED).alias("confidence"), F.array(F.concat(F.lit("generator says "), F.substring("generator", 1, 60))).alias("evidence")).cast(match)
    nothing = F.struct(F.lit(-1).alias("place"), F.lit("unknown").alias("platform"), F.lit("Unknown").alias("label"), F.lit("unknown").alias("kind"), F.lit(0.0).alias("confidence"), F.array().alias("evidence")).cast(match)
    verdict = F.coalesce(first, F.when(named, by_name), nothing)
    out = out.withColumn("verdict", verdict)
    return out.select("page_id", "url", "crawl_order", *(F.col("verdict")[c].alias(c) for c in ("platform", "label", "kind", "confidence", "evidence")), "matches", "generator")


def site_platforms(verdicts: DataFrame, site: Column) -> DataFrame:
    """site, platform, label, kind, confidence, pages, present (names and kinds that gate checks), runs_php: one row a site with any evidence.

    The platform of most pages wins, then the one that a page is surest of, then the one seen first; what
    other pages matched is united.  present is null where the verdict is not sure enough to gate.
    """
    rows = verdicts.where("platform <> 'unknown' or size(evidence) > 0").withColumn("site", site)
    sureness = F.struct(F.col("confidence"), -F.col("crawl_order"), -F.col("page_id"))
    by = rows.groupBy("site", "platform").agg(F.count("*").alias("pages"), F.max("confidence").alias("confidence"), F.max_by(F.struct("label", "kind"), sureness).alias("best"), F.min(F.struct("crawl_order", "page_id")).alias("seen"))
    order = F.struct(F.col("pages"), F.col("confidence"), -F.col("seen.crawl_order"), -F.col("seen.page_id"))
    won = by.groupBy("site").agg(F.max_by(F.struct("platform", "best", "confidence", "pages"), order).alias("w"))
    stack = rows.select("site", F.inline_outer(F.transform("matches", lambda m: F.struct(m["platform"].alias("m"), m["kind"].alias("k"))))).groupBy("site").agg(F.collect_set("m").alias("ms"), F.collect_set("k").alias("ks"))  # at most one of each rule
    out = won.join(stack, "site").select("site", "w.platform", "w.best.label", "w.best.kind", "w.confidence", "w.pages", "ms", "ks")
    php = F.arrays_overlap("ms", F.array(*map(F.lit, PHP)))
    present = F.array_sort(F.array_distinct(F.concat(F.array("platform", "kind"), "ms", "ks", F.when(php, F.array(F.lit("php"))).otherwise(F.array().cast("array<string>")))))
    sure = (F.col("platform") != "unknown") & (F.col("confidence") >= SURE)
    return out.select("site", "platform", "label", "kind", "confidence", "pages", F.when(sure, present).alias("present"), php.alias("runs_php"))


def gates(sites: DataFrame, selectors: dict[str, tuple[tuple[str, ...], bool]]) -> DataFrame:
    """site, check_id, reason of the checks that do not apply to a site.  selectors: by check, (names or kinds, whether the check is for them or for all others)."""
    rows = [F.when(F.arrays_overlap("present", F.array(*map(F.lit, names))) != F.lit(only), F.struct(F.lit(i).alias("check_id"), F.concat(F.lit("does not apply to " if only else "normal on "), F.col("label")).alias("reason"))) for i, (names, only) in selectors.items()]
    return sites.where("present is not null").select("site", F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))
