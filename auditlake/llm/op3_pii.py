"""Personal data: patterns, and spans of a character-level BiLSTM-CRF beside them.

The patterns (email, ip, card, phone) give the base spans.  The tagger (`bilstm`), trained
in numpy on a bounded number of labelled windows, reads overlapping windows of 64 characters
at a stride of 32 over every stretch around a digit or an @ sign, and over the whole run of
address characters on both sides of an @ sign; spans of these kinds hold one or the other, so
no window elsewhere can add any.  An address that lies whole in none of these windows gets one
of its own, if it fits in one.  Windows are decoded one by one; then the spans of a text are
reconciled as a whole: a span of an address that is cut by a window's edge is read on to the
end of its run, spans of one kind that overlap, or touch where an edge cut them, are united,
what is still cut or not plausible gives way to the spans no edge cut, and conflicts go to the
larger mean lead.

A span of the tagger is added when it meets no base span, has the digits its kind needs and
its lead reaches `lead`; so it finds written variants (spaces around the signs, phones
without a plus) and leaves other numbers alone.

Defined results: null text is empty; documents without spans have an empty string; every
row gets a row, with a null doc_id or a repeated one too (rows do not look at each other, so
there are no ties between them); a text of any length is read whole, in time that grows with
its length; spans that begin alike go to the larger lead, then the smaller start; other
columns are not read, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bilstm import KINDS, WINDOW, Tagger, classes, trained
from .common import table

#: What may stand before an address's sign, and what must stand behind it.
LOCAL = ".%+-_" + "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123))))
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Whole runs of numbers between dots, four at least, so that no number is read anew from its second digit.
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")
SIGN = re.compile(r"@|[\[(]at[\])]")
BEFORE = re.compile(r"\s?[A-Za-z0-9._%+-]*")  # of the text reversed
AFTER = re.compile(r"\s?[A-Za-z0-9-]*(?:\s?\.\s?[A-Za-z0-9-]+)*")
LEFT, RIGHT = re.compile(r"[A-Za-z0-9._%+-]*"), re.compile(r"[A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*")
STRIDE, NEAR = 32, 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches of LOCAL+ @ DOMAIN, found from the signs, in one pass over the text.

    LOCAL has no sign, so a match ends its first part at a sign and begins where the run before it begins.
    """
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        run = text[free:at]
        start = free + len(run.rstrip(LOCAL))
        free = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def addresses_ip(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping groups of four numbers between dots, each at most 255."""
    out = []
    for m in DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                out.append((at, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern spans, by kind, then start; time and memory grow with the text, not with its square."""
    out = []
    if "@" in text:
        out += [(0, s, e) for s, e in emails(text)]
    if "." in text:
        out += [(1, s, e) for s, e in addresses_ip(text)]
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _plausible(kind: int, s: str) -> bool:
    d = _digits(s)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s?(@|\[at\]|\(at\))\s?[A-Za-z0-9-]+(\s?\.\s?[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", s))
    if kind == 1:
        p = re.fullmatch(r"([0-9]{1,3})\s?\.\s?([0-9]{1,3})\s?\.\s?([0-9]{1,3})\s?\.\s?([0-9]{1,3})", s)
        return bool(p) and all(int(x) <= 255 for x in p.groups())
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ .-]{0,3}[0-9])+", s)) and 13 <= len(d) <= 19 and luhn(d)
    return bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]+[0-9]", s)) and 10 <= len(d) <= 15 and not d == s


def addresses(text: str) -> dict[int, tuple[int, int]]:
    """Start of every sign between the parts of an address -> the run of address characters on both sides."""
    back = text[::-1] if SIGN.search(text) else ""
    return {m.start(): (m.start() - len(BEFORE.match(back, len(text) - m.start()).group()), AFTER.match(text, m.end()).end()) for m in SIGN.finditer(text)}


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows that cover every stretch around a trigger."""
    out, reached, runs = [], -1, addresses(text)
    for m in TRIGGER.finditer(text):
        s, e = runs.get(m.start(), m.span())
        a, b = max(0, min(s - 1, m.start() - NEAR)), min(len(text), max(e + 1, m.end() + NEAR))
        if b <= reached:
            continue
        at = a if not out or a > reached - STRIDE else out[-1] + STRIDE
        while True:
            out.append(at)
            reached = at + WINDOW
            if reached >= b:
                break
            at += STRIDE
    own = []
    for s, e in runs.values():
        # the last window that begins before the run holds the most of it
        i = bisect_left(out, max(s, 1)) - 1
        if e - s <= WINDOW - 2 and not (i >= 0 and e < out[i] + WINDOW):
            own.append(max(0, s - (WINDOW - (e - s)) // 2))
    return out + own


class Spans:
    """Disjoint intervals, to ask whether another one meets any: spans are merged as they come in order, or put between the others."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        i = bisect_left(self.starts, e) - 1
        return i >= 0 and self.ends[i] > s

    def add(self, s: int, e: int) -> None:
        """s, e meets none of the others."""
        i = bisect_left(self.starts, s)
        self.starts.insert(i, s)
        self.ends.insert(i, e)


def _read_on(text: str, start: int, end: int, left: bool, right: bool, known: list[tuple[int, int]]) -> tuple[int, int]:
    """start and end of an address moved to the ends of the runs that a window's edge cut; known: the text's last runs."""
    for side in (0, 1):
        at = (start, end)[side]
        if not (left, right)[side]:
            continue
        if not known[side][0] <= at <= known[side][1]:
            if side:
                known[1] = (at, RIGHT.match(text, at).end())
            else:
                stop = LEFT.match(text, at).end()
                at_first = at
                while at_first > 0 and LEFT.fullmatch(text, at_first - 1, at_first):
                    at_first -= 1
                known[0] = (at_first, stop)
        start, end = (start, known[1][1]) if side else (known[0][0], end)
    return start, end


def _united(found):
    """found: (kind, start, end, lead, cut on the left, cut on the right) -> the same of spans of one kind that overlap, or touch where an edge cut them."""
    out: list[list] = []
    for k, s, e, lead, left, right in sorted(found, key=lambda f: (f[0], f[1], f[4], -f[2])):
        u = out[-1] if out else None
        if u and u[0] == k and (s < u[2] or s == u[2] and (left or u[5])):
            u[5] = right if e > u[2] else u[5] and right if e == u[2] else u[5]
            u[2], u[3] = max(e, u[2]), max(lead, u[3])
        else:
            out.append([k, s, e, lead, left, right])
    return out


def reconcile(found: list[tuple[int, int, int, float, bool, bool]], least: float, fits=lambda k, s, e: True) -> list[tuple[int, int, int]]:
    """found: (kind, start, end, lead, cut on the left, cut on the right) of all windows -> the text's spans (kind, start, end)."""
    whole = [f for f in found if not (f[4] or f[5])]
    joined = [u for u in _united(found) if not (u[4] or u[5]) and fits(*u[:3])] if len(whole) < len(found) else []
    # spans no edge cut stand for themselves where nothing plausible was joined over them
    over = {k: Spans((j[1], j[2]) for j in joined if j[0] == k) for k in {j[0] for j in joined}}
    rest = [u for u in _united(whole) if u[0] not in over or not over[u[0]].meets(u[1], u[2])]
    out, taken = [], Spans()
    for k, s, e, lead, _, _ in sorted(joined + rest, key=lambda u: (-u[3], u[1], u[0])):
        if lead >= least and not taken.meets(s, e):
            taken.add(s, e)
            out.append((k, s, e))
    return out


def tag_texts(texts: list[str], model: Tagger, least: float = 1.0, at_once: int = 2048) -> list[list[tuple[int, int, int]]]:
    """The reconciled spans of the tagger in every text."""
    where = [(i, a) for i, t in enumerate(texts) for a in windows(t)]
    codes = {i: classes(texts[i]) for i in {i for i, _ in where}}
    found: dict[int, list] = {}
    known: dict[int, list] = {}
    for at in range(0, len(where), at_once):
        part = where[at : at + at_once]
        x = np.full((len(part), WINDOW), 5, np.uint8)
        for j, (i, a) in enumerate(part):
            c = codes[i][a : a + WINDOW]
            x[j, : len(c)] = c
        tags, lead = model.decode(x)
        for j in np.flatnonzero((tags > 0).any(axis=1)):
            i, a = part[j]
            row, n, s = tags[j], min(WINDOW, len(codes[i]) - a), 0
            while s < n:
                if row[s] == 0:
                    s += 1
                    continue
                k, e = (row[s] - 1) // 2, s + 1
                while e < n and row[e] == 2 + 2 * k:
                    e += 1
                left, right = s == 0 and a > 0, e == WINDOW and a + WINDOW < len(codes[i])
                b, c = a + s, a + e
                if k == 0 and (left or right) and SIGN.search(texts[i], b, c):
                    b, c = _read_on(texts[i], b, c, left, right, known.setdefault(i, [(0, -1), (0, -1)]))
                    left = right = False
                found.setdefault(i, []).append((int(k), b, c, float(lead[j, s:e].mean()), left, right))
                s = e
    return [reconcile(found.get(i, []), least, lambda k, s, e, t=t: _plausible(k, t[s:e])) for i, t in enumerate(texts)]


def all_spans(texts: list[str], model: Tagger) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, added spans) of every text, each (kind, start, end)."""
    out = []
    hits = [i for i, t in enumerate(texts) if t and TRIGGER.search(t)]
    tagged = dict(zip(hits, tag_texts([texts[i] for i in hits], model)))
    for i, t in enumerate(texts):
        base = base_spans(t) if i in tagged else []
        here = Spans((a, b) for _, a, b in base)
        more = [(k, s, e) for k, s, e in tagged.get(i, []) if _plausible(k, t[s:e]) and not here.meets(s, e)]
        out.append((base, sorted(more)))
    return out


def _named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _scan(model: Tagger):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = all_spans([t or "" for t in part.column(1).to_pylist()], model)
                counts = [[sum(k == kind for k, _, _ in base) for base, _ in rows] for kind in range(4)]
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([sha256(_named(b).encode()).hexdigest() for b, _ in rows]), pa.array([_named(sorted(b + m)) for b, m in rows]), pa.array([len(m) for _, m in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return run


def personal_data(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans and the number added; see the module.

    The model's few thousand numbers travel with the function; one pass, no shuffle.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan(model or trained()), schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
