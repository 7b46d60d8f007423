import random

import pytest
from pyspark.sql import functions as F

from auditlake.llm import op5_lines

from . import brute


def make_line(r, words=9):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(words))


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6])
def test_planted_passages_go_whole(spark, n):
    """A passage of a few lines in otherwise different texts goes whole, and nothing else does."""
    r, rows, want = random.Random(n), [], {}
    for k in range(30):
        passage = [make_line(r) for _ in range(n)]
        for c in range(3):
            a, b = ([make_line(r) for _ in range(r.randint(0, 6))] for _ in range(2))
            want[3 * k + c] = "\n".join(a + (passage if c == 0 else []) + b)
            rows.append((3 * k + c, "\n".join(a + passage + b)))
    got = {x.doc_id: x for x in op5_lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {d: x.text for d, x in got.items()} == want == brute.lines(rows)
    assert all((x._lines, x._chunks) == ((0, 0) if d % 3 == 0 else (n, 1)) for d, x in got.items())


def test_windows_defined_results(spark):
    """Blank lines between, single lines, repeats within a text, other texts of one doc_id, a null doc_id."""
    rows = [
        (1, "a b\n\nc d\n\ne f"), (2, "x\n\na b\nc d\n\ny"), (3, "a b\nz"), (4, "r\nr\nr\nr"), (5, "\na b\n\n\nc d\n"),
        (6, "p 1\np 2\np 3"), (6, "q 1\nq 2\nq 3"), (7, "q 2\nq 3\nown"), (8, "p 1\np 2\np 3"), (0, "zero 1\nzero 2"), (None, "zero 1\nzero 2"), (9, "zero 1\nzero 2"),
    ]
    got = op5_lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("no", F.lit(1))).collect()
    assert sorted(((-1 if x.doc_id is None else x.doc_id), x.text) for x in got) == sorted([
        (1, rows[0][1]), (2, "x\n\ny"), (3, "a b\nz"), (4, "r\nr"), (5, ""), (6, rows[5][1]), (6, rows[6][1]), (7, "own"), (8, ""), (0, rows[9][1]), (-1, rows[9][1]), (9, ""),
    ])
