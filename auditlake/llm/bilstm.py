"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Characters fall into a few dozen classes.  Two LSTMs read a window from both ends; a linear
layer scores the tags of each character; a CRF with learnt transitions is trained on the
exact log-likelihood (forward-backward) with Adam, and decoded by Viterbi.  All steps work
on many windows at once.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WINDOW = 64
_MARKS = "@._%+-() /:=\"'#*$&|<>,;\n[]"
CLASSES = 6 + len(_MARKS)
_TABLE = np.full(0x250, 4, np.uint8)  # 4: other; 5: past the text's end
_TABLE[48:58], _TABLE[97:123], _TABLE[65:91] = 0, 1, 2
_TABLE[0xC0:0x250] = 3
for _i, _c in enumerate(_MARKS):
    _TABLE[ord(_c)] = 6 + _i


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x250, _TABLE[np.minimum(points, 0x24F)], 4).astype(np.uint8)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsum(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, hidden: int = 12, seed: int = 5):
        r = np.random.default_rng(seed)
        self.h = hidden
        g = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"out": g(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in ("f", "b"):
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p |= {d + "x": g(CLASSES, 4 * hidden) * 2, d + "h": g(hidden, 4 * hidden), d + "c": bias}

    def _read(self, x, d, keep=False):
        """Hidden states of one direction; x: classes [windows, time], already reversed for b."""
        n, t = x.shape
        h, c, out, tape = np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32), np.empty((t, n, self.h), np.float32), []
        wx, wh, k = self.p[d + "x"] + self.p[d + "c"], self.p[d + "h"], self.h
        for i in range(t):
            z = wx[x[:, i]] + h @ wh
            s = _sigmoid(z[:, : 3 * k])
            g = np.tanh(z[:, 3 * k :])
            before = (h, c)
            c = s[:, k : 2 * k] * c + s[:, :k] * g
            y = np.tanh(c)
            h = s[:, 2 * k :] * y
            out[i] = h
            if keep:
                tape.append((s, g, y, *before))
        return out, tape

    def scores(self, x: np.ndarray, keep=False):
        """Tag scores [time, windows, TAGS]."""
        f, tf = self._read(x, "f", keep)
        b, tb = self._read(x[:, ::-1], "b", keep)
        both = np.concatenate((f, b[::-1]), axis=2)
        e = both @ self.p["out"] + self.p["bias"]
        return (e, both, tf, tb) if keep else e

    def gradient(self, x, tags):
        """Mean negative log-likelihood and its gradient."""
        e, both, tf, tb = self.scores(x, keep=True)
        t, n, _ = e.shape
        trans, y = self.p["trans"], tags.T
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for i in range(1, t):
            alpha[i] = e[i] + _logsum(alpha[i - 1][:, :, None] + trans, 1)
        for i in range(t - 2, -1, -1):
            beta[i] = _logsum(trans + (e[i + 1] + beta[i + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        dtrans = np.zeros_like(trans)
        for i in range(1, t):
            dtrans += np.exp(alpha[i - 1][:, :, None] + trans + (e[i] + beta[i])[:, None, :] - z[:, None, None]).sum(0)
        np.subtract.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), 1)
        at, w = np.indices(y.shape)
        gold = e[at, w, y].sum() + trans[y[:-1], y[1:]].sum()
        de[at, w, y] -= 1
        de /= n
        grad = {"trans": dtrans / n, "bias": de.sum((0, 1)), "out": both.reshape(-1, 2 * self.h).T @ de.reshape(-1, TAGS)}
        dh = de @ self.p["out"].T
        k, hot = self.h, np.eye(CLASSES, dtype=np.float32)
        for d, tape, seq, own in (("f", tf, x, dh[:, :, :k]), ("b", tb, x[:, ::-1], dh[::-1, :, k:])):
            gx, gh = np.zeros_like(self.p[d + "x"]), np.zeros_like(self.p[d + "h"])
            h_next = c_next = np.zeros((n, k), np.float32)
            for i in range(t - 1, -1, -1):
                s, g, yy, h0, c0 = tape[i]
                h_all = own[i] + h_next
                dc = c_next + h_all * s[:, 2 * k :] * (1 - yy * yy)
                ds = np.concatenate((dc * g, dc * c0, h_all * yy), axis=1) * s * (1 - s)
                dz = np.concatenate((ds, dc * s[:, :k] * (1 - g * g)), axis=1)
                gx += hot[seq[:, i]].T @ dz
                gh += h0.T @ dz
                h_next, c_next = dz @ self.p[d + "h"].T, dc * s[:, k : 2 * k]
            grad |= {d + "x": gx, d + "h": gh, d + "c": gx.sum(0)}
        return float((z.sum() - gold) / n), grad

    def fit(self, x, tags, epochs=5, batch=50, rate=0.02, seed=9):
        r, m, v, step = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        total = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                _, grad = self.gradient(x[order[i : i + batch]], tags[order[i : i + batch]])
                step += 1
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (1 - step / (total + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags [windows, time] and each tag's lead over the best other tag there."""
        e, trans = self.scores(x), self.p["trans"]
        t, n, _ = e.shape
        best, back = e[0], np.empty((t, n, TAGS), np.int8)
        for i in range(1, t):
            s = best[:, :, None] + trans
            back[i] = s.argmax(1)
            best = s.max(1) + e[i]
        tags = np.empty((t, n), np.int64)
        tags[-1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            tags[i - 1] = back[i][np.arange(n), tags[i]]
        at, w = np.indices(tags.shape)
        own = e[at, w, tags]
        e[at, w, tags] = -np.inf
        return tags.T, (own - e.max(2)).T


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled windows: invented prose with marked spans (start, end, kind) and things that look alike but aren't."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"
    word = lambda: "".join(r.choice(letters if r.random() < 0.95 else "éñüßçèóöä") for _ in range(r.randint(1, 9)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def email():
        user = word() + r.choice(["", ".", "_", "-"]).join(["", r.choice([word(), digits(2)])])
        at = r.choice(["@"] * 7 + [" @ ", " [at] ", " (at) "])
        return user + at + ".".join([word() + r.choice(["", digits(1)]) for _ in range(r.randint(1, 2))] + [r.choice(["com", "org", "net", "io"])])

    def ip():
        return r.choice(["."] * 7 + [" . "]).join(str(r.randint(0, 255)) for _ in range(4))

    def card():
        return r.choice(["", "", " ", "-"]).join(digits(4) for _ in range(4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}"])

    def other():
        hexa = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 40])))
        return r.choice(
            [
                f"password={hexa}", f'token = "{hexa}"', hexa, f"AKIA{''.join(r.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))}",
                f"Version {digits(1)}.{digits(1)}", f"{r.randint(1900, 2099)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(2)}:{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}",
                digits(r.randint(1, 11)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"@{word()}", f"{digits(2)},{digits(3)},{digits(3)}", f"#{digits(6)}", f"{word()}{digits(2)}", f"ISBN {digits(13)}", f"{digits(24)}",
            ]
        )

    makers = (email, ip, card, phone)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += " ".join(word() + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(1, 5))) + r.choice([" ", " ", " ", "\n", ": "])
            if r.random() < 0.6:
                k = r.randrange(4)
                s = makers[k]()
                spans.append((len(text), len(text) + len(s), k))
                text += s + r.choice([" ", " ", ". ", ", ", "\n"])
            elif r.random() < 0.7:
                text += other() + " "
        at = r.randint(0, max(0, len(text) - WINDOW))
        out.append((text[at : at + WINDOW], [(max(0, s - at), min(WINDOW, e - at), k) for s, e, k in spans if s < at + WINDOW and e > at]))
    return out


def arrays(labelled) -> tuple[np.ndarray, np.ndarray]:
    x, tags = np.full((len(labelled), WINDOW), 5, np.uint8), np.zeros((len(labelled), WINDOW), np.int64)
    for i, (text, spans) in enumerate(labelled):
        c = classes(text)
        x[i, : len(c)] = c
        for s, e, k in spans:
            tags[i, s:e] = 2 + 2 * k
            tags[i, s] = 1 + 2 * k
    return x, tags


@lru_cache(maxsize=4)
def trained(n: int = 3000, seed: int = 11) -> Tagger:
    """The tagger fitted on n labelled windows (the documented bound of the training sample)."""
    return Tagger().fit(*arrays(examples(n, seed)), epochs=10, rate=0.03)
