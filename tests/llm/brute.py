"""Plain Python versions of what the operators of pairs must return."""

import re
from hashlib import sha256

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def components(rows):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (n_shingles, component, kept)}"""
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    index = {}
    for d, s in sorted(sets.items()):
        common = {}
        for g in s:
            for o in index.setdefault(g, []):
                common[o] = common.get(o, 0) + 1
            index[g].append(d)
        for o, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[o]) - c):
                a, b = sorted((find(d), find(o)))
                top[b] = a
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def substring(rows, width=13):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (n_words, n_removed, sha256)}"""
    words = {d: WORD.findall(t or "") for d, t in rows}
    least = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            least.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - width + 1) if least[tuple(w[i : i + width])] < d for j in range(i, i + width)}
        out[d] = (len(w), len(gone), sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def lines(rows):
    """rows: (doc_id, text) with distinct ids -> {doc_id: text without the lines of repeated pairs of lines with words}"""
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[d] = None
            continue
        every = t.split("\n")
        own = [i for i, x in enumerate(every) if WORD.search(x)]
        gone = set()
        for n, (i, j) in enumerate(zip(own, own[1:])):
            who, first = seen.setdefault((every[i], every[j]), (d, n))
            if (who, first) != (d, n):
                gone |= {n, n + 1} - ({first, first + 1} if who == d else set())
        of = [max(0, sum(k <= i for k in own) - 1) for i in range(len(every))] if len(every) < 2000 else _owner(own, len(every))
        out[d] = "\n".join(x for x, n in zip(every, of) if n not in gone)
    return out


def _owner(own, n):
    """The number of the line with words that each line goes with."""
    out, at = [], -1
    lines_with_words = set(own)
    for i in range(n):
        at += i in lines_with_words
        out.append(max(0, at))
    return out
