"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a per-document figure in thousandths; a document is rejected when the
figure exceeds the cutoff of its stratum.  The cutoffs of all rules move along one path
that is fixed beforehand (PATH): from none, one rule after another is lowered step by step
to its floor, and each step rejects what the one before rejects and maybe more.  Labelled
holdout rows say how far a stratum may go: of n good documents that pass the base rules, k
are rejected at a step, and the step is admissible when the exact binomial tail
P(Bin(n, risk) <= k) is at most delta / m, which is the same as the one-sided
Clopper-Pearson upper bound at that level being at most risk.  As steps are tested in their
fixed order and a stratum stops at the first one that fails, no correction over rules or steps
is needed; the strata are corrected for by Bonferroni, over those that have labels enough to
pass at all: the m largest, for the largest m of which each has
log(delta / m) / log(1 - risk) good labels (149 for one stratum, 217 for four).  So with
probability 1 - delta no stratum's rules reject more than `risk` of the good documents that the
base rules let pass.
Among admissible steps the one with the largest surplus of bad over good rejections is
taken, the loosest on ties; with no surplus no rule is on in the stratum.

Nulls: a null text has no words; a null stratum is a stratum of its own; labels with a
null id or quality are passed over.  A text with no words has figures of 0 and fails the
base rule.  Repeated rows each get a row, a null doc_id too (it has no label); a doc_id with
several labels counts as good if one of them is.  Texts of any length are read whole.  Other
columns pass through quality_filter whatever their names; the other functions do not read
them.  Without labels no cutoff is set; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ID_ROWS, WORD_GAP, cut, small, table

#: Figures in thousandths; higher is worse.
RULES = {
    "symbols": lambda: F.expr("1000 * n_symbols div greatest(word_chars, 1)"),
    "dup_lines": lambda: F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
    "repeats": lambda: F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
    "short": lambda: F.expr("1000 * 50 div greatest(n_words, 1)"),
}
#: Cutoffs of the rules in the order of the path, from the loosest to the floor of each.
PATH = {"symbols": (*range(1000, 200, -50), *range(200, 49, -10)), "dup_lines": (*range(1000, 200, -50), *range(200, 99, -10)), "repeats": (*range(1000, 200, -50), *range(200, 99, -10)), "short": tuple(range(1000, 499, -50))}
NAMES = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row, whatever the optimizer does with aliases."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more.

    Windows become longs, 36 hash bits above 28 position bits, sorted as primitives;
    neighbours of equal hash are candidates, whose words are then compared.  So the work
    is n log n however long or repetitive the text is, and hash collisions do not count.
    """
    bits = 28
    keys = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
    )
    top = lambda x: F.shiftrightunsigned(x, bits)
    twin = lambda s, x, i, of: F.coalesce(of(F.get(s, i - 1)) == of(x), F.lit(False)) | F.coalesce(of(F.get(s, i + 1)) == of(x), F.lit(False))
    maybe = _let(F.sort_array(keys), lambda s: F.filter(s, lambda x, i: twin(s, x, i, top)))
    window = lambda x: _let(x.bitwiseAND((1 << bits) - 1).cast("int"), lambda p: F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("s"), p.alias("p")))
    same = _let(F.sort_array(F.transform(maybe, window)), lambda s: F.filter(s, lambda x, i: twin(s, x, i, lambda y: y["s"])))
    where = F.sort_array(F.transform(same, lambda x: x["p"]))
    covered = F.aggregate(
        where,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["to"])).alias("n"), (p + 3).alias("to")),
        lambda a: a["n"],
    )
    return F.when(F.size(w) > 3, covered).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, the figures of NAMES, n_lines and base_failed, from whole texts; docs has no columns of these names, _f or _l."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.array_remove(F.split(t, WORD_GAP), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long")
    out = docs.withColumns({"_f": found, "_l": line, "n_symbols": symbols})
    out = out.select("*", *(F.col(f"_f.{n}").alias(n) for n in ("n_words", "word_chars", "n_repeat_words")), *(F.col(f"_l.{n}").alias(n) for n in ("n_lines", "n_dup_lines"))).drop("_f", "_l")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k below n * p: the largest term in logarithms, the others by their ratios."""
    up = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.when(i <= k, F.log((n - k + i) / i)).otherwise(0.0))
    first = up + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    odds = (1 - p) / p
    rest = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(k - 1, F.lit(0))),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: _let(F.when(i < k, a["t"] * (k - i) / (n - k + i + 1) * odds).otherwise(0.0), lambda t: F.struct(t.alias("t"), (a["s"] + t).alias("s"))),
        lambda a: a["s"],
    )
    return F.exp(first) * rest


def first_step() -> Column:
    """The first step of the path (from 1) that rejects a row by its figures; null if none does."""
    out, at = [], 1
    for rule, cuts in PATH.items():
        steps = F.array(*(F.struct(F.lit(c).alias("cut"), F.lit(at + i).alias("step")) for i, c in enumerate(cuts)))
        out.append(F.get(F.filter(steps, lambda x: x["cut"] < RULES[rule]()), F.lit(0))["step"])
        at += len(cuts)
    return F.least(*out)


def cut_at(step: Column, rule: str) -> Column:
    """The cutoff of a rule at a step of the path; null where the path has not come to the rule."""
    at = sum(len(PATH[r]) for r in list(PATH)[: list(PATH).index(rule)])
    cuts = F.array(*map(F.lit, PATH[rule]))
    return F.when(step > at, F.element_at(cuts, F.least(step - at, F.lit(len(PATH[rule]))).cast("int")))


def calibrate(labelled: DataFrame, stratum: str = "stratum", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, cut_<rule>...) from rows with the figures, base_failed, good (boolean) and the stratum; see the module.

    A histogram of the step that rejects a row is all that is shuffled; it has as many rows as
    strata x steps.
    """
    steps = sum(map(len, PATH.values()))
    counts = labelled.where("good is not null and not base_failed").select(F.col(stratum).alias("stratum"), "good", F.coalesce(first_step(), F.lit(steps + 1)).alias("first"))
    counts = counts.groupBy("stratum", "first").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    curve = counts.groupBy("stratum").agg(F.sum("good").alias("n"), F.collect_list(F.struct("first", "good", "bad")).alias("h"))
    upto = lambda name: F.aggregate(F.filter("h", lambda x: x["first"] <= F.col("step")), F.lit(0).cast("long"), lambda a, x: a + x[name])
    tried = curve.select("stratum", "n", "h", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).withColumns({"k": upto("good"), "caught": upto("bad")}).drop("h")
    # whom labels are enough for is settled by their number alone, so it costs no error
    place = F.count("*").over(Window.orderBy(F.desc("n")).rangeBetween(Window.unboundedPreceding, 0))  # one row a stratum; equal ones share the last place
    enough = curve.select("n").withColumn("place", place).where(F.col("n") >= F.log(delta / F.col("place")) / F.log(F.lit(1 - risk))).agg(F.max("place").alias("m"), F.min("n").alias("least"))
    # k only rises along the path, so what is admissible is what the tests in order let pass
    tried = tried.where((F.col("k") < F.col("n") * risk) & (F.col("caught") > F.col("k"))).join(F.broadcast(enough)).where(F.col("n") >= F.col("least"))
    sure = tried.where(binomial_cdf(F.col("n"), F.col("k"), risk) <= delta / F.col("m"))
    best = sure.groupBy("stratum").agg(F.max_by("step", F.struct(F.col("caught") - F.col("k"), -F.col("step"))).alias("step"))
    return best.select("stratum", *(cut_at(F.col("step"), r).alias(f"cut_{r}") for r in RULES))


def verdict(rows: DataFrame, cuts: DataFrame, stratum: str = "stratum") -> DataFrame:
    """rows with the cutoffs of their stratum and kept.  cuts is broadcast if it is counted to be small."""
    c = small(cuts).withColumnRenamed("stratum", "_stratum")
    out = rows.join(c, rows[stratum].eqNullSafe(c["_stratum"]), "left").drop("_stratum")
    fails = [F.coalesce(rule() > F.col(f"cut_{r}"), F.lit(False)) for r, rule in RULES.items()]
    # one array, since conjuncts would be pushed below the join one by one, where the figures would be made again for them
    return out.withColumn("kept", F.forall(F.array("base_failed", *fails), lambda x: ~x))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return rows.join(known, "doc_id").withColumn("good", F.col("quality") == 1)


def quality_table(docs: DataFrame, labels: DataFrame, risk: float = 0.02) -> DataFrame:
    """doc_id, figures, base_failed, cutoffs and kept of every document; see the module.

    The texts are read once; their figures, a few dozen bytes a document, are
    checkpointed, for the calibration and the verdict.
    """
    rows = features(docs.select("doc_id", "text", F.col("lang").alias("stratum"))).drop("text")
    rows = cut(rows)
    return verdict(rows, cut(calibrate(_labelled(rows, labels), risk=risk)))


def quality_filter(docs: DataFrame, labels: DataFrame, risk: float = 0.02) -> DataFrame:
    """The documents that pass, all columns as they are.

    No kept text is shuffled: figures are made beside it.  The cutoffs need those of labelled
    rows only, so the labels' ids choose the texts that are read for them.
    """
    ids = small(cut(labels.where("doc_id is not null and quality is not null").select("doc_id").distinct()), ID_ROWS)
    marked = features(docs.select("doc_id", "text", F.col("lang").alias("stratum")).join(ids, "doc_id", "left_semi")).drop("text")
    cuts = cut(calibrate(_labelled(cut(marked), labels), risk=risk))
    # the document in one struct, so that no column of it can clash with a figure
    rows = features(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "text", F.col("lang").alias("stratum"))).drop("text")
    return verdict(rows, cuts).where("kept").select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", *NAMES, "base_failed", "kept", F.col("stratum").alias("lang"), *(f"cut_{r}" for r in RULES))
