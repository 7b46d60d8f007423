import re
from collections import Counter
from math import comb

from pyspark.sql import functions as F

from auditlake.llm import op1_quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(three)
    covered = {j for i, x in enumerate(three) if n[x] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_figures_equal_brute_force(spark, sf):
    odd = ["", None, " ", "a b c a b c", "x x x x x x", "a\tb\x0bc\rd\x0ce\nf", "é b é b c", "l\nl\n\n\nl", "a b c " * 3000, "😀 #$ <b> 😀"]
    rows = [(-i, t, None, "s", 0) for i, t in enumerate(odd, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"))
    found = q.features(docs).collect()
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert len(found) == docs.count()


def test_binomial_tail(spark):
    cases = [(10, 0), (100, 1), (500, 3), (2000, 5), (40, 0)]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", q.binomial_cdf(F.col("n"), F.col("k"), 0.01))
    for n, k, p in df.collect():
        assert abs(p - sum(comb(n, j) * 0.01**j * 0.99 ** (n - j) for j in range(k + 1))) < 1e-9


def test_cutoffs_keep_the_risk_per_stratum(spark):
    rows = [(i, "a" if i % 2 else "b", i % 10 > 0, 0 if i % 10 else 400 + i % 7, 1000) for i in range(20000)]
    base = spark.createDataFrame(rows, "doc_id long, stratum string, good boolean, n_symbols long, word_chars long")
    base = base.selectExpr("*", "0L n_dup_lines", "1L n_lines", "0L n_repeat_words", "100L n_words", "false base_failed")
    cuts = q.calibrate(base)
    got = q.verdict(base, cuts)
    assert got.where("good and not kept").count() == 0
    assert got.where("not good and kept").count() == 0
    few = base.where("doc_id < 320")  # 144 good ones in each of two strata: too few to be sure of anything
    assert q.verdict(few, q.calibrate(few)).where("not kept").count() == 0


def test_empty_and_filter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    none = q.quality_table(docs, labels.limit(0)).where("kept <> (not base_failed)")
    assert none.count() == 0
    assert q.quality_table(docs.limit(0), labels).count() == 0
    extra = docs.withColumn("stratum", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(None).cast("int"))
    kept = q.quality_filter(extra, labels)
    assert kept.columns == extra.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in q.quality_table(docs, labels).where("kept").collect()}


def path_by_hand(rows, risk, delta):
    """rows: (stratum, good, base_failed, figures by rule) -> cutoffs by stratum, a step at a time."""
    rows = [r for r in rows if r[1] is not None and not r[2]]
    sizes = Counter(s for s, good, *_ in rows if good)
    place = {s: sum(x >= n for x in sizes.values()) for s, n in sizes.items()}
    enough = {s: m for s, m in place.items() if (1 - risk) ** sizes[s] <= delta / m}
    out = {}
    for s in enough:
        own, cuts, best = [r for r in rows if r[0] == s], {}, (0, None)
        n = sum(r[1] for r in own)
        for rule, steps in q.PATH.items():
            for c in steps:
                cuts = cuts | {rule: c}
                hit = [r[1] for r in own if any(r[3][x] > y for x, y in cuts.items())]
                k, caught = sum(hit), len(hit) - sum(hit)
                tail = sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1))
                if k < n * risk and tail <= delta / max(enough.values()):
                    best = max(best, (caught - k, cuts), key=lambda x: x[0])
        if best[1]:
            out[s] = best[1]
    return out


def test_cutoffs_are_those_of_the_path(spark):
    import random

    r = random.Random(4)
    rows = []
    for i in range(1500):
        good, s = r.random() < 0.8, r.choice(["a", "a", "a", "b", None, "few"] if i > 40 else ["few"])
        worse = 0 if good else r.choice([0, 300, 600])
        rows.append((i, s, r.choice([good, good, good, None]), r.random() < 0.05, r.choice([0, 0, 0, worse, r.randint(0, 60)]), 1000, r.choice([0, 0, worse // 2]), 1000, r.choice([0] * 30 + [150, worse]), r.randint(60, 4000)))
    names = "doc_id long, stratum string, good boolean, base_failed boolean, n_symbols long, word_chars long, n_dup_lines long, n_lines long, n_repeat_words long, n_words long"
    df = spark.createDataFrame(rows, names)
    figures = lambda x: {"symbols": 1000 * x[4] // x[5], "dup_lines": 1000 * x[6] // x[7], "repeats": 1000 * x[8] // x[9], "short": 50_000 // x[9]}
    for risk in (0.02, 0.05):
        got = {x.stratum: {k: x[f"cut_{k}"] for k in q.RULES if x[f"cut_{k}"] is not None} for x in q.calibrate(df, risk=risk).collect()}
        assert got == path_by_hand([(x[1], x[2], x[3], figures(x)) for x in rows], risk, 0.05)
    assert got, "some stratum has cutoffs"


def test_given_labels_choose_cutoffs(spark):
    """On the smaller given tables the largest stratum has labels enough."""
    at = "/root/testdata/sf0.01"
    out = q.op1_quality(spark, at)
    cuts = {x.lang: x.cut_symbols for x in out.select("lang", "cut_symbols").distinct().collect()}
    assert cuts["en"] is not None and {k for k, v in cuts.items() if v is not None} == {"en"}
    labels = spark.read.parquet(f"{at}/labels.parquet").where("quality is not null")
    seen = out.where("not base_failed").join(labels, "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("gone")).collect()
    en = {x.quality: (x.n, x.gone) for x in seen if x.lang == "en"}
    assert en[1][1] <= 0.02 * en[1][0] and en[0][1] > 0.4 * en[0][0]


def test_risk_over_many_draws(spark):
    """Of many holdouts drawn from one population, few choose cutoffs that lose more than the risk of the good ones."""
    import random

    r = random.Random(11)
    share = lambda cut: max(0.0, 0.03 * (400 - cut) / 400)  # noqa: E731  of good documents above a cutoff of symbols
    draw = lambda: 0 if r.random() > 0.03 else r.randint(1, 400)
    rows = [(t * 1000 + i, str(t), i < 600, False, (draw() if i < 600 else 390), 1000, 0, 1, 0, 100_000) for t in range(60) for i in range(640)]
    df = spark.createDataFrame(rows, "doc_id long, stratum string, good boolean, base_failed boolean, n_symbols long, word_chars long, n_dup_lines long, n_lines long, n_repeat_words long, n_words long")
    single = [q.calibrate(df.where(F.col("stratum") == str(t))) for t in range(3)]
    assert all(x.cut_symbols is None or share(x.cut_symbols) <= 0.02 for c in single for x in c.collect())
    cuts = [x.cut_symbols for x in q.calibrate(df, delta=0.05 * 60).collect()]  # each stratum at 0.05, as if it were alone
    wrong = sum(share(c) > 0.02 for c in cuts if c is not None)
    assert len(cuts) > 30 and wrong <= 8  # 3 expected at most; more than 8 of 60 has probability 0.003
