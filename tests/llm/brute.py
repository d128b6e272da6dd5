"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


class Union:
    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def jaccard(rows, width, percent):
    """{doc_id: (n, component)}"""
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    u, ids = Union(), [i for i, s in sets.items() if s]
    holders: dict = {}
    for i in ids:
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    seen = set()
    for h in holders.values():
        for x in range(len(h)):
            for y in range(x):
                a, b = h[x], h[y]
                if (a, b) in seen or 100 * min(len(sets[a]), len(sets[b])) < percent * max(len(sets[a]), len(sets[b])):
                    continue
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    u.join(a, b)
    return {i: (len(s), u.root(i)) for i, s in sets.items()}


def repeats(rows, length):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}: bytes in strings of `length` that start twice."""
    at: dict = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i, b in texts.items():
        for k in range(len(b) - length + 1):
            at[b[k : k + length]] = at.get(b[k : k + length], 0) + 1
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if at[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(texts, n):
    """Each text without its words in strings of n words that start twice, and how many words go; a run
    of words goes with the white space behind it."""
    found = [[(m.start(), lower(m[0])) for m in re.finditer("[^\x20\x09-\x0d]+", t or "")] for t in texts]
    at: dict = {}
    for words in found:
        for k in range(len(words) - n + 1):
            w = tuple(x for _, x in words[k : k + n])
            at[w] = at.get(w, 0) + 1
    out = []
    for t, words in zip(texts, found, strict=True):
        gone = [False] * len(words)
        for k in range(len(words) - n + 1):
            if at[tuple(x for _, x in words[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        edges = [a for a, _ in words] + [len(t or "")]
        kept = (t or "")[: edges[0]] + "".join(t[edges[k] : edges[k + 1]] for k in range(len(words)) if not gone[k])
        out.append((kept if any(gone) else t, sum(gone)))
    return out


class Ftrl:
    """The learner of the quality classifier over dictionaries, in plain numbers."""

    M = (1 << 64) - 1
    PRIME = 0x9E3779B97F4A7C15

    def __init__(self, alpha=0.1, beta=1.0, l1=0.02, l2=0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = {}, {}

    @classmethod
    def mix(cls, x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & cls.M
        return x ^ x >> 31

    @classmethod
    def bits(cls, i, seed):
        return cls.mix(((i + 1) * cls.PRIME + seed) & cls.M)

    @classmethod
    def row(cls, text, size):
        """{cell: value} of a text; the bias is cell 2**size."""
        raw = (text or "").encode()
        tokens = [(m[0], m[0][0] >= 0x80 or chr(m[0][0]).isalnum()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+", raw)]
        hashed = [cls.mix(sum(cls.bits(b, 20_011) * pow(cls.PRIME, k, 1 << 64) for k, b in enumerate(t)) & cls.M) for t, _ in tokens]
        every = list(hashed)
        for k in range(len(tokens) - 1):
            same = tokens[k][0] == tokens[k + 1][0] and tokens[k][1]
            every.append(cls.bits(0, 20_023) if same else cls.mix((hashed[k] * cls.PRIME + hashed[k + 1]) & cls.M))
        every += [cls.bits(1, 20_023) for k in range(len(tokens) - 2) if tokens[k][0] == tokens[k + 2][0] and tokens[k][1]]
        out = {1 << size: 1.0}
        for h in every:
            out[h >> 64 - size] = out.get(h >> 64 - size, 0) + 1 / len(every) ** 0.5
        return out

    def weight(self, i):
        z, n = self.z.get(i, 0.0), self.n.get(i, 0.0)
        return 0.0 if abs(z) <= self.l1 else -(z - (self.l1 if z > 0 else -self.l1)) / ((self.beta + n**0.5) / self.alpha + self.l2)

    def score(self, x):
        return 1 / (1 + 2.718281828459045 ** -sum(self.weight(i) * v for i, v in x.items()))

    def learn(self, x, y):
        p, w = self.score(x), {i: self.weight(i) for i in x}
        for i, v in x.items():
            g, n = (p - y) * v, self.n.get(i, 0.0)
            self.z[i] = self.z.get(i, 0.0) + g - ((n + g * g) ** 0.5 - n**0.5) / self.alpha * w[i]
            self.n[i] = n + g * g
