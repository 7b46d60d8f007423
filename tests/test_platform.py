from pyspark.sql import functions as F

from auditlake.operators import platform, predicates

KIND = "page_id long, url string, crawl_order long, html string, headers map<string,string>, is_next boolean"


def verdicts(spark, rows):
    rows = [(i, f"https://{site}/p{i}", i, html, headers, is_next) for i, (site, html, headers, is_next) in enumerate(rows)]
    return platform.page_platforms(spark.createDataFrame(rows, KIND))


WP = '<script src="/wp-content/x.js"></script>'
ROWS = [
    ("a.com", WP + "<link href=/wp-includes/y>", {"Link": "</wp-json/>"}, False),
    ("a.com", WP + '<body class="WooCommerce-Page">', None, None),
    ("a.com", "<i>SHOPIFY.THEME drupalsettings</i>", {}, False),  # looked for as written
    ("a.com", "<div data-reactroot></div><i id=\"__nuxt\">", {}, False),
    ("b.com", "<div data-reactroot data-v-app></div>", {}, False),
    ("b.com", "<div data-reactroot></div>", {"x-powered-by": "Next.js"}, True),
    ("c.com", "<meta content='handmade THING' name='generator'>", {}, False),
    ("c.com", "", {"x-shopid": "1"}, False),
    ("c.com", None, {"x-shopid": "1"}, True),
    ("d.com", "<p>", {"x-wix-request-id": "", "X-Shopify-Stage": ""}, False),
    ("d.com", '<meta name="generator" content="Hugo 0.1"><META NAME="generator" content="Jekyll">', {}, False),
]


def test_rules():
    rules = platform.rules()
    assert len(rules) == 35 and len({r[0] for r in rules}) == 35 and sum(len(r[3]) for r in rules) == 65
    assert all(0 < w < 1 and places for *_, signals in rules for w, places in signals)


def test_pages(spark):
    rows = {r.page_id: r for r in verdicts(spark, ROWS).collect()}
    names = {i: [m.platform for m in r.matches] for i, r in rows.items()}
    assert names[0] == ["wordpress"] and rows[0].confidence == 1.0 and len(rows[0].evidence) == 3
    assert names[1] == ["wordpress", "woocommerce"] and rows[1].platform == "wordpress"
    assert names[2] == [] and rows[2].platform == "unknown" and rows[2].confidence == 0
    assert names[3] == ["nuxt", "react"] and names[4] == ["vue", "react"] and rows[4].platform == "vue"
    assert names[5] == ["nextjs", "react"] and rows[5].evidence == ["fingerprint of the framework"]
    assert (rows[6].platform, rows[6].label, rows[6].confidence) == ("unknown", "Handmade thing", 0.4)
    assert rows[7].platform == rows[8].platform == "unknown" and names[7] == names[8] == []
    assert names[9] == ["wix"] and names[10] == ["hugo"]


def test_sites_and_gates(spark):
    sites = platform.site_platforms(verdicts(spark, ROWS), F.regexp_extract("url", "//([^/]*)", 1))
    rows = {r.site: r for r in sites.collect()}
    assert rows["a.com"].platform == "wordpress" and rows["a.com"].pages == 2 and rows["a.com"].runs_php
    assert rows["a.com"].present == ["cms", "ecommerce", "framework", "nuxt", "php", "react", "woocommerce", "wordpress"]
    assert rows["b.com"].platform == "nextjs"  # one page each: the surer one
    assert rows["c.com"].platform == "unknown" and rows["c.com"].present is None  # a name without a rule gates nothing
    assert rows["d.com"].platform == "hugo" and not rows["d.com"].runs_php
    gone = {(r.site, r.check_id) for r in platform.gates(sites, predicates.SELECTORS).collect()}
    assert gone == {("b.com", "author-box-admin"), ("b.com", "php-fatal-error"), ("d.com", "author-box-admin"), ("d.com", "php-fatal-error"), ("d.com", "tags-with-style-attributes")}
