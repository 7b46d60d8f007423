"""A report holds pages to have one text only if all of it is equal, not by its beginning."""

import shutil

import pytest

from auditlake.operators import report
from auditlake.plans import reports
from auditlake.sources.html import extract_pages

CHECK = "duplicate-pages-without-canonical"
LONG = "The same words  here " * 200


def _tables(spark, folder, ends):
    """A folder of tables whose pages have one long beginning; the stand-ins of pages 49, 63, 98 and 112 are live and take their text from the markup."""
    rows = [(i, f"https://s.com/{i}", f"<html><body>{LONG}{end}</body></html>") for i, end in ends.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    shutil.copy("/root/testdata/sf0.001/customer.parquet", folder)
    return str(folder)


def _both(spark, folder, name):
    """A query's rows and those of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("pages", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if t == 'pages' else ''}'")
    return sorted(tuple(r) for r in reports.QUERIES[name](spark, folder).collect()), sorted(con.execute(reports.ORACLES[name]).fetchall())


def test_texts_are_compared_to_their_end(spark):
    pages = [(i, f"https://s.com/{i}", f"<html><body><p>{text}</p></body></html>") for i, text in enumerate([LONG + "one", LONG + "two", LONG.upper() + "\n TWO ", LONG[:3000], " \n" * 300, "\n " * 300])]
    rows = {r.check_id: r for r in report.cross_outcomes(extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()}
    assert (rows[CHECK].pages, rows[CHECK].affected) == ([1, 2], 2)


def test_full_report_compares_whole_texts(spark, tmp_path):
    ours, theirs = _both(spark, _tables(spark, tmp_path, {49: "one", 63: "two", 98: "two", 112: "three"}), "full_report")
    assert ours == theirs and [(r[4], r[6], r[8]) for r in ours if r[1] == CHECK] == [("failed", 2, "63,98")]


def test_severities_compare_whole_texts(spark, tmp_path):
    apart, one = ("apart", {49: "one", 63: "two"}), ("one", {49: "one", 63: "one"})
    failed = {}
    for name, ends in (apart, one):
        (tmp_path / name).mkdir()
        ours, theirs = _both(spark, _tables(spark, tmp_path / name, ends), "report_severities")
        assert ours == theirs
        failed[name] = {severity: n for _, severity, n in ours}
    assert failed["one"] == failed["apart"] | {"critical": failed["apart"]["critical"] + 1}
