"""Secret scans: patterns, and a battery of randomness tests with false-discovery control.

Patterns give the base spans.  Beyond them, every token of 20 or more characters of
[A-Za-z0-9+/_-], with up to two '=' as trailing padding, that has letters and digits and meets
no base span is a candidate; so the value of NAME=VALUE or of a URL's parameter is a token of
its own.  Its encoding is inferred (hex, base32, base64 in either alphabet) and tested for
randomness:

* chi-squared uniformity of its symbols over the encoding's alphabet,
* a runs test on the classes of its characters (a capital and the small letters after it are one run),
* lag-1 serial correlation of the symbols' places in the alphabet;

the three p-values are combined by Fisher's method.  The combined figure is read twice.
Against random draws it screens: a candidate that is not consistent with them (under
`least`), or fits no alphabet, gives way to its parts of 20 or more characters between '/'
and '+', between '-' and '_', or between any of these, whichever has the strongest evidence a
character (of a part within another, the inner one if it has two thirds of its characters),
at three times the p-value for the choice; without such parts it is dropped.  Against ordinary
text it decides: the p-value is the probability that a token of that length and encoding made
of ordinary words is as close to random draws as this one, by the battery's figures of
tokens made of words, capitals, signs and numbers (`reference`); ordinary tokens depart the
more the longer they are, so the evidence grows with the length.  Benjamini-Hochberg at
`rate` over all candidates of all documents judges these p-values, from a histogram of them
(fixed bins, upper edges: conservative), so nothing is collected but its bins.

Defined results: null text is empty; no spans give an empty string and its digest; every
row gets a row, with a null doc_id or a repeated one too; equal p-values share a bin and its
verdict; a text of any length is read whole, in time that grows with its length; other
columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
PARTS = (re.compile(r"[A-Za-z0-9_=-]{20,}"), re.compile(r"[A-Za-z0-9+/=]{20,}"), re.compile(r"[A-Za-z0-9=]{20,}"))
BINS = 600  # of -ln p / BIN_WIDTH
BIN_WIDTH = 0.1
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern spans, by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out)


def encoding(token: str) -> str | None:
    own = set(token)
    return next((name for name, letters in ALPHABETS.items() if own <= set(letters)), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def _switches(letters: str) -> tuple[float, float]:
    """Mean and variance a neighbour of new runs in random draws from an alphabet."""
    share = [sum(_class(c) == k for c in letters) / len(letters) for k in range(4)]
    new = 1 - sum(x * x for x in share) - share[2] * share[1]
    # two neighbouring places share a symbol: both are new with the probability over triples
    go = [[float(a != b and (a, b) != (2, 1)) for b in range(4)] for a in range(4)]
    both = sum(share[a] * share[b] * share[c] * go[a][b] * go[b][c] for a in range(4) for b in range(4) for c in range(4))
    return new, max(new * (1 - new) + 2 * (both - new * new), 1e-9)


SWITCHES = {name: _switches(letters) for name, letters in ALPHABETS.items()}
PLACES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}


def battery(token: str) -> tuple[float, float, str] | None:
    """(p of the three tests under random draws, Fisher's combined figure, encoding); None where no encoding fits."""
    token = token.rstrip("=")
    name = encoding(token)
    n = len(token)
    if name is None or n < 8:
        return None
    at = PLACES[name]
    k = len(at)
    x = [at[c] for c in token]
    counts = [0] * k
    for i in x:
        counts[i] += 1
    chi = sum((c - n / k) ** 2 for c in counts) * k / n
    p_uniform = 0.5 * math.erfc((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n)) / math.sqrt(2))
    kind = [_class(c) for c in token]
    new = sum(u != v and (u, v) != (2, 1) for u, v in zip(kind, kind[1:]))
    mean, spread = SWITCHES[name]
    p_runs = _two_sided((new - mean * (n - 1)) / math.sqrt(spread * (n - 1)))
    m = sum(x) / n
    power = sum((i - m) ** 2 for i in x)
    p_serial = _two_sided(sum((u - m) * (v - m) for u, v in zip(x, x[1:])) / power * math.sqrt(n)) if power else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
    return math.exp(-half) * (1 + half + half * half / 2), 2 * half, name  # chi-squared with 6 degrees of freedom


#: Letters of ordinary words by their share in thousandths.
LETTERS = dict(e=127, t=91, a=82, o=75, i=70, n=67, s=63, h=61, r=60, d=43, l=40, c=28, u=28, m=24, w=24, f=22, g=20, y=20, p=19, b=15, v=10, k=8, j=2, x=2, q=1, z=1)
LENGTHS = (20, 26, 34, 44, 58, 76, 100, 140, 200)


def ordinary(n: int, r: random.Random, name: str) -> str:
    """A token of n characters made of ordinary words: joined by signs, by capitals or by nothing, with numbers among them."""
    letters, shares, out, style = list(LETTERS), list(LETTERS.values()), "", r.randrange(3)
    sign = {"base64": "/+", "base64url": "_-"}.get(name, "")
    while len(out) < n:
        word = str(r.choice((r.randrange(10), r.randrange(100), r.randrange(1990, 2030), r.randrange(10**6)))) if r.random() < 0.2 else "".join(r.choices(letters, shares, k=r.randint(2, 9)))
        out += (sign and style == 0 and out and r.choice(sign) or "") + (word.capitalize() if style == 1 else word)
    out = out[:n]
    if name == "base32":
        return out.upper().translate(str.maketrans("0189", "2345"))
    if name in ("hex", "HEX"):  # words of these letters alone
        out = "".join(c if c in "abcdef0123456789" else "aeaebcd"[ord(c) % 7] for c in out.lower())
    return out.upper() if name == "HEX" else out


def reference() -> dict[str, tuple[tuple[float, float], ...]]:
    """By encoding and LENGTHS: mean and deviation of the logarithm of the battery's figure over ordinary tokens; a few numbers, made once on the driver."""
    out = {}
    for name in ALPHABETS:
        r, rows = random.Random(20240611), []
        for n in LENGTHS:
            found = [math.log(max(b[1], 0.1)) for b in (battery(ordinary(n, r, name)) for _ in range(120)) if b]
            mean = sum(found) / len(found)
            rows.append((mean, math.sqrt(sum((x - mean) ** 2 for x in found) / (len(found) - 1))))
        out[name] = tuple(rows)
    return out


def p_ordinary(figure: float, n: int, name: str, known: dict) -> float:
    """Probability that an ordinary token of n characters comes as close to random draws; between LENGTHS by their logarithms."""
    n = min(max(n, LENGTHS[0]), LENGTHS[-1])
    i = max(1, bisect_left(LENGTHS, n))
    t = math.log(n / LENGTHS[i - 1]) / math.log(LENGTHS[i] / LENGTHS[i - 1])
    mean, spread = ((1 - t) * a + t * b for a, b in zip(known[name][i - 1], known[name][i]))
    return 0.5 * math.erfc((mean - math.log(max(figure, 0.1))) / spread / math.sqrt(2))


def _tested(token: str, at: int, least: float, known: dict) -> list[tuple[int, int, float]]:
    """(start, end, p) of the token that begins at `at`, or of the parts it gives way to."""
    if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
        return []
    found = battery(token)
    if found and found[0] >= least:
        return [(at, at + len(token), p_ordinary(found[1], len(token.rstrip("=")), found[2], known))]
    ways = []
    for part in PARTS:
        parts = [(m.start(), m.group()) for m in part.finditer(token) if m.group() != token]
        ways.append([x for s, t in parts for x in _tested(t, at + s, least, known)])
    top = [min(way, key=lambda x: math.log(max(x[2], 1e-300)) / (x[1] - x[0])) if way else None for way in ways]
    best = min(range(len(ways)), key=lambda i: math.log(max(top[i][2], 1e-300)) / (top[i][1] - top[i][0]) if top[i] else 1.0)
    for i, x in enumerate(top):  # ordinary neighbours of a long random part must not join it
        if x and x[2] <= 0.01 and top[best][0] <= x[0] and x[1] <= top[best][1] and 2 * (top[best][1] - top[best][0]) / 3 <= x[1] - x[0] < top[best][1] - top[best][0]:
            best = i
    return [(s, e, min(1.0, len(PARTS) * p)) for s, e, p in ways[best]]


def candidates(text: str, base: list[tuple[int, int, int]], known: dict, least: float = 0.001) -> list[tuple[int, int, float]]:
    """(start, end, p) of the tokens that meet no base span; base comes by start, so one look ahead in it does."""
    out, i, reached = [], 0, -1
    for m in TOKEN.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reached, i = max(reached, base[i][2]), i + 1
        if reached <= m.start():
            out += _tested(m.group(), m.start(), least, known)
    return out


def _scan(known: dict, batches):
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    more = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bin", pa.int32())])
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text) if text else []
            found = candidates(text, base, known) if text else []
            rows.append(([dict(start=s, kind=k, end=e) for s, k, e in base], [dict(start=s, end=e, bin=min(BINS, int(-math.log(max(p, 1e-300)) / BIN_WIDTH))) for s, e, p in found], sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()))
        a, b, c = zip(*rows) if rows else ((),) * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.list_(span)), pa.array(b, pa.list_(more)), pa.array(c, pa.string())], ["doc_id", "base", "more", "base_sha256"])


def secret_spans(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """doc_id, base (spans), added (spans accepted at the false-discovery rate), base_sha256; see the module."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_scan, reference()), "doc_id long, base array<struct<start:long,kind:int,end:long>>, more array<struct<start:long,end:long,bin:int>>, base_sha256 string")
    found = cut(found)
    bins = found.select(F.inline("more")).groupBy("bin").agg(F.count("*").alias("n"))
    by_p = Window.orderBy(F.desc("bin"))  # at most BINS + 1 rows
    # a bin's p-values are at most exp(-bin * width); the largest rejected set whose bound is under rate * found / all
    bins = bins.withColumns({"found": F.sum("n").over(by_p), "m": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    level = bins.where(F.exp(-F.col("bin") * BIN_WIDTH) <= rate * F.col("found") / F.col("m")).agg(F.min("bin").alias("level"))
    out = found.join(F.broadcast(level))  # one row
    added = F.transform(F.filter("more", lambda x: x["bin"] >= F.col("level")), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return out.select("doc_id", "base", F.when(F.col("level").isNull(), F.array().cast("array<struct<start:long,kind:int,end:long>>")).otherwise(added).alias("added"), "base_sha256")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    every = F.array_sort(F.concat("base", "added"))
    spans = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256", spans.alias("spans"), F.size("added").cast("long").alias("n_random"))
