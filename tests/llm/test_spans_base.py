"""Base spans and digests of the two scans against the contracts' patterns, applied as they are written."""

import re
import time
from hashlib import sha256

import pytest

from auditlake.llm import op3_pii, op7_secrets
from auditlake.llm.common import table

EMAIL, IP, CARD, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGN, ACCESS, HEX = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+"


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def private(text):
    n = lambda s: len(re.sub("[^0-9]", "", s))
    out = [("email", m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", m.span()) for m in re.finditer(IP, text) if all(len(x) < 4000 and int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.span()) for m in re.finditer(CARD, text) if 13 <= n(m[0]) <= 19 and luhn(re.sub("[^0-9]", "", m[0])) % 10 == 0]
    return out + [("phone", m.span()) for m in re.finditer(PHONE, text) if 9 <= n(m[0]) <= 15]


def secret(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], (s, e)) for s, k, e in sorted(out)]


ODD = [
    None, "", "a@b", "@", "a@@b.c d@e.f@g.h x@y.z.co_m@n.o.p", "a.b@c.d-e.f.", "1.2.3.4.5.6.7.8.9.10.11.12 1.2.3 256.1.1.1.1.1.1 01.002.0003.00000000004", "1..2.3.4.5", "1.2.3.4a.5",
    "9" * 5000 + ".1.1.1 4111-1111 1111-1111", "+1 (2) 3-4.5 6789 + +12345678 +(1)2345678", "token=" + "A" * 12 + " SECRET : '" + "b" * 11 + "  Api_Key\"=\"c.d=e/f+g-h_i", "AKIA" + "Z" * 20 + "AKIA" + "f" * 20, "tokentoken= aaaaaaaaaaaa password=passwordpassword",
    "é😀 x@y.zz ü 10.0.0.1  deadbeefdeadbeef",
]


def digest(spans):
    return sha256(",".join(f"{k}:{s}:{e}" for k, (s, e) in spans).encode()).hexdigest()


@pytest.mark.parametrize("which", ["private", "secret"])
def test_base_of_whole_table(spark, sf, which):
    """Also: null, repeated ids, columns named like the operator's own, an empty table."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(None if i == 3 else 10**6 + i // 2, t) for i, t in enumerate(ODD)], "doc_id long, text string")).selectExpr("*", "1 spans", "2 base", "3 more", "4 n_hex", "5 level")
    brute, kinds = (private, ("email", "ip", "card", "phone")) if which == "private" else (secret, ("assign", "access", "hex"))
    want = sorted((r.doc_id or -1, digest(s := brute(r.text or "")), *(sum(k == x for x, _ in s) for k in kinds)) for r in docs.collect())
    if which == "private":
        got = [(r.doc_id or -1, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in op3_pii.personal_data(docs).collect()]
    else:
        got = [(r.doc_id or -1, r.base_sha256, *(sum(x.kind == k for x in r.base) for k in range(3))) for r in op7_secrets.secret_spans(docs).collect()]
    assert sorted(got) == want
    assert sum(map(sum, (x[2:] for x in want))) >= 15
    assert (op3_pii.personal_data if which == "private" else op7_secrets.secret_spans)(docs.limit(0)).count() == 0


def test_base_of_random_texts():
    import random

    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice("ab1290..@@--+ ()=:f'\"") for _ in range(r.randrange(60)))
        assert op3_pii.base_spans(t) == [(("email", "ip", "card", "phone").index(k), s, e) for k, (s, e) in private(t)], t
        t = "".join(r.choice(["token", "API_key", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "=", ":", " ", '"', "x", "-", "/q"]) for _ in range(r.randrange(12)))
        assert op7_secrets.base_spans(t) == [(s, ("assign", "access", "hex").index(k), e) for k, (s, e) in secret(t)], t


@pytest.mark.parametrize("text", ["a" * 10**6 + " @", "1" * 10**6 + ".x", "1." * 500_000, "a@" * 400_000, "+1" * 400_000, "10.0.0.1 a@b.cc " * 30_000])
def test_long_runs_take_linear_time(text):
    began = time.time()
    op3_pii.base_spans(text)
    op3_pii.windows(text)
    op7_secrets.candidates(text, op7_secrets.base_spans(text), op7_secrets.reference())
    assert time.time() - began < 20


def test_many_spans_beside_many_candidates():
    text = "token=abcdefghijkl1 k3fQzbM7mXa0TRr4hWpe " * 20_000
    began = time.time()
    base = op7_secrets.base_spans(text)
    found = op7_secrets.candidates(text, base, op7_secrets.reference())
    assert len(base) == 20_000 and len(found) == 20_000
    spans = op3_pii.Spans((s, e) for s, _, e in base)
    assert not any(spans.meets(s, e) for s, e, _ in found) and spans.meets(3, 4) and not spans.meets(19, 21)
    assert time.time() - began < 20


def test_ordinary_tokens_keep_their_level():
    """The p-value that false-discovery control judges holds its level on tokens of words, and falls with the length of random ones."""
    import random

    r, known = random.Random(8), op7_secrets.reference()
    for name in ("hex", "base32", "base64url"):
        p = [op7_secrets.p_ordinary(b[1], n, name, known) for n in (24, 48) for _ in range(400) if (b := op7_secrets.battery(op7_secrets.ordinary(n, r, name)))]
        assert sum(x < 0.01 for x in p) <= 0.03 * len(p), name
        middle = [sorted(op7_secrets.p_ordinary(op7_secrets.battery("".join(r.choice(op7_secrets.ALPHABETS[name]) for _ in range(n)))[1], n, name, known) for _ in range(101))[50] for n in (20, 40, 80)]
        assert middle[0] > 10 * middle[1] > 100 * middle[2], (name, middle)
