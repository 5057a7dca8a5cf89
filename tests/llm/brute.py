"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import itertools
import re

import numpy as np
import xxhash


def suffix_dedup(docs, length=50):
    first = {}
    for d, t in sorted(docs):
        b = t.encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = {}
    for d, t in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def line_dedup(docs, least=10):
    blanks, count = b" \t\n\x0b\x0c\r", collections.Counter()
    key = lambda x: x.strip(blanks).lower()
    for _, t in docs:
        count.update({key(x) for x in t.encode().split(b"\n")})
    out = {}
    for d, t in docs:
        lines = t.encode().split(b"\n")
        stays = [not (key(x) and count[key(x)] >= least) for x in lines]
        kept = [x for x, k in zip(lines, stays) if k]
        runs = [(k, len(list(g))) for k, g in itertools.groupby(stays)]
        turns = ("" if runs[0][0] else "0,") + ",".join(str(n) for _, n in runs)
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest(), turns)
    return out


def simhash(docs, radius=4):
    prints = {}
    for d, t in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def language_model(rows, pieces, lang_steps=3, longest=24, words_kept=15_000, piece=6):
    """Unigrams of each language by expectation-maximisation over all segmentations, with dictionaries; rows: (text, lang)."""
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    index = {p: i for i, p in enumerate(pieces)}
    langs = sorted({x for _, x in rows})
    counts = {x: collections.Counter() for x in langs}
    for text, lang in rows:
        for w in re.split(r"\s+", text.lower()):
            w = w.strip(marks)
            counts[lang].update(w[i : i + longest] for i in range(0, len(w), longest))
    totals = collections.Counter()
    for x in langs:
        top = sorted(((-n, w) for w, n in counts[x].items() if w), key=lambda t: (t[0], t[1].encode()))[:words_kept]
        for n, w in top:
            if any(map(str.isalpha, w)):
                totals[x, w] -= n
    prior = {x: np.log(sum(1 for _, y in rows if y == x) / len(rows)) for x in langs}
    prob = {x: np.full(len(pieces), 1 / len(pieces)) for x in langs}

    def step(p, w, i, n):
        at = index.get(w[i : i + n])
        own = p[at] if at is not None else 0.0
        return max(own, 1e-9) if n == 1 else own

    def forward(p, w):
        alpha = [1.0]
        for i in range(1, len(w) + 1):
            alpha.append(sum(alpha[i - n] * step(p, w, i - n, n) for n in range(1, min(piece, i) + 1)))
        return alpha

    for _ in range(lang_steps):
        expected = {x: np.zeros(len(pieces)) for x in langs}
        for (x, w), weight in totals.items():
            p, alpha = prob[x], forward(prob[x], w)
            beta = [0.0] * len(w) + [1.0]
            for i in range(len(w) - 1, -1, -1):
                beta[i] = sum(step(p, w, i, n) * beta[i + n] for n in range(1, min(piece, len(w) - i) + 1))
            for i in range(len(w)):
                for n in range(1, min(piece, len(w) - i) + 1):
                    at = index.get(w[i : i + n])
                    if at is not None:
                        expected[x][at] += weight * alpha[i] * p[at] * beta[i + n] / alpha[-1]
        pooled = sum(expected.values())
        pooled = pooled / max(pooled.sum(), 1e-9) + 0.1 / len(pieces)
        for x in langs:
            own = expected[x] + 20 * pooled
            prob[x] = own / own.sum()

    def predict(text, evidence=12):
        if not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        words = text.lower().split()
        logs = dict.fromkeys(langs, 0.0)
        for w in words:
            w = w.strip(marks)
            if any(map(str.isalpha, w)):
                for x in langs:
                    logs[x] += sum(np.log(forward(prob[x], w[i : i + longest])[-1]) for i in range(0, len(w), longest))
        best = max(langs, key=lambda x: prior[x] + logs[x])
        soft = {x: prior[x] + logs[x] * min(1.0, evidence / len(words)) for x in langs}
        high = max(soft.values())
        return best, float(np.exp(soft[best] - high) / sum(np.exp(v - high) for v in soft.values()))

    return predict


def toxicity(rows, texts, bits=20, alpha=1.0, beta=1.0, l1=3.0, l2=1.0, passes=4):
    """FTRL-proximal with dictionaries; rows: (text, label) in the order of training; scores of ``texts``."""
    marks, mask, odd = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", (1 << 64) - 1, 0x9E3779B97F4A7C15

    def features(text):
        h = [xxhash.xxh64_intdigest(w.strip(marks).encode(), 11) for w in text.lower().split()]
        grams = [x * 3 for x in h] + [a * odd + b * 5 for a, b in zip(h, h[1:])] + [a * odd + b * 7 for a, b in zip(h, h[2:])]
        return sorted({(((g & mask) ^ ((g & mask) >> 29)) * odd & mask) >> (64 - bits) for g in grams})

    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)

    def chance(w):
        return 1 / (1 + np.exp(-np.clip(w, -35, 35)))

    for _ in range(passes):
        for text, label in rows:
            own = {i: weight(i) for i in [*features(text), -1]}
            g = chance(sum(own.values())) - label
            for i, w in own.items():
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
                n[i] += g * g
    return [float(chance(weight(-1) + sum(weight(i) for i in features(t)))) for t in texts]
