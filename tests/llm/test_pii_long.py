import random

from auditlake.llm import bilstm, op3_pii

NAMED = ["christopher.montgomery-smith [at] example.org", "maria.gonzalez-fernandez @ example.com", "bob [at] department-of-chemistry.northern-university.org"]


def written(r, n):
    """An address of n characters with a spaced sign."""
    sign, end = r.choice([" @ ", " [at] ", " (at) "]), r.choice([".org", ".com", ".net"])
    left = n - len(sign) - len(end)
    a = left // 2 + r.randint(-6, 6)
    part = lambda k: "".join("etaoinshrdlucm"[r.randrange(14)] if (i + 1) % 9 or i + 1 == k else "." for i in range(k))
    return part(a) + sign + part(left - a) + end


def test_every_long_address_lies_in_a_window():
    r = random.Random(3)
    for address in NAMED + [written(r, n) for n in range(35, 61)]:
        for before in ("", "see 12 ", "in 2024 or 2025 write to ", "plain words only stand before it "):
            text = before + address + " or call later, on day 7 of the month"
            s, e = len(before), len(before) + len(address)
            assert any((a < s or a == 0) and e < a + bilstm.WINDOW for a in op3_pii.windows(text)), text


def test_cut_spans_are_united():
    cut = [(0, 10, 40, 2.0, False, True), (0, 30, 70, 3.0, True, False)]
    assert op3_pii.reconcile(cut, 1.0) == [(0, 10, 70)]
    assert op3_pii.reconcile([(0, 10, 40, 2.0, False, True), (0, 40, 50, 3.0, True, False)], 1.0) == [(0, 10, 50)]
    assert op3_pii.reconcile([(0, 10, 40, 2.0, False, True), (0, 30, 70, 3.0, True, True), (0, 62, 80, 2.0, True, False)], 1.0) == [(0, 10, 80)]
    assert op3_pii.reconcile(cut[:1], 1.0) == op3_pii.reconcile(cut[1:], 1.0) == []
    # what is joined but not plausible leaves the whole spans as they were
    assert op3_pii.reconcile([*cut, (0, 12, 35, 2.0, False, False)], 1.0, lambda k, s, e: False) == [(0, 12, 35)]


def test_long_addresses_are_found():
    r, model = random.Random(5), bilstm.trained()
    found = 0
    every = NAMED + [written(r, n) for n in range(35, 61) for _ in range(4)]
    texts = ["in 2024 or 2025 write to " + a + " or call later, on day 7 of the month" for a in every]
    for text, a, (base, more) in zip(texts, every, op3_pii.all_spans(texts, model)):
        found += (0, text.index(a), text.index(a) + len(a)) in more
    print(found, len(every))
    assert found > 0.9 * len(every)
