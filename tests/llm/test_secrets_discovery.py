import math
import random

from auditlake.llm import op7_secrets as op7


def test_selection_is_benjamini_hochberg(spark):
    """Of all candidates of all texts, those are accepted that the step-up rule accepts on their binned p-values."""
    r = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = lambda n: "".join(r.choices(letters, k=n))
    wordy = lambda: r.choice(["configuration", "statement", "element"]) + r.choice(["Number", "Handler", "Reference"]) + str(r.randint(10, 9999)) + "version"
    texts = [" ".join([wordy() for _ in range(12)] + [token(r.choice([20, 24, 30, 44, 64]))] * (i % 3)) for i in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    known = op7.reference()
    found = [(i, s, e, min(op7.BINS, int(-math.log(max(p, 1e-300)) / op7.BIN_WIDTH))) for i, t in enumerate(texts) if t for s, e, p in op7.candidates(t, op7.base_spans(t), known)]
    accepted = set()
    for rate in (0.5, 0.01, 1e-6, 1e-300):
        upper = sorted(math.exp(-b * op7.BIN_WIDTH) for *_, b in found)  # the largest p-value of each bin
        most = max((k for k in range(1, len(upper) + 1) if upper[k - 1] <= rate * k / len(upper)), default=0)
        least = upper[most - 1] if most else -1.0
        want = sorted((i, s, e) for i, s, e, b in found if math.exp(-b * op7.BIN_WIDTH) <= least)
        got = sorted((x.doc_id, a.start, a.end) for x in op7.secret_spans(docs, rate).collect() for a in x.added)
        assert got == want, rate
        accepted.add(len(got))
    assert len(found) > 50 and len(accepted) > 2  # the rate decides
