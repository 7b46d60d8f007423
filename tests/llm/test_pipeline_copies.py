import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_exact_copies_leave_nothing(spark, tmp_path):
    """Of exact copies of texts of 1 to 20 lines, run() packs the first one alone, and whole."""
    r, rows, first = random.Random(7), [], {}
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    for lines in range(1, 21):
        text = "\n".join(" ".join(word() for _ in range(60 if lines == 1 else 30)) for _ in range(lines))
        text = text + "\n" * (lines % 3) if lines % 2 else text.replace("\n", "\n\n")
        first[lines] = len(text.split())
        rows += [(lines + 100 * c, text, "en", "web", len(text)) for c in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got} == set(first)
    longest = Counter()
    for x in got:
        longest[x.doc_id] = max(longest[x.doc_id], x.length)
    assert all(longest[d] >= n for d, n in first.items())
