"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def jaccard_components(rows, width, percent):
    """rows: (id, text) with distinct ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    both = defaultdict(int)
    for ids in index.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                both[a, b] += 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    found = roots(list(sets), links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def substring_dedup(rows, width=35):
    """rows: (id, text); (id, n_words, n_removed, kept text) for each."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = defaultdict(int)
    for _, w in words:
        for k in range(len(w) - width + 1):
            seen[tuple(w[k : k + width])] += 1
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def near_vectors(rows, threshold=0.93):
    """rows: (id, vector, label); id -> (links, component)."""
    import numpy as np

    good = [(i, np.array(v, dtype=np.float64), lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for n, (i, v, lab) in enumerate(good):
        for j, u, other in good[:n]:
            if lab == other and len(u) == len(v) and v @ u / np.sqrt(v @ v) / np.sqrt(u @ u) >= threshold:
                pairs.append((i, j))
    found = roots([r[0] for r in rows], pairs)
    links = {r[0]: 0 for r in rows}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return {i: (links[i], found[i]) for i in found}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def personal_data(text):
    """Base spans (start, kind number, end) of one text, sorted."""
    text = text or ""

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    checks = (
        (EMAIL, lambda m: True),
        (IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        (CARD, lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(checks) for m in p.finditer(text) if ok(m.group()))


TERM = regex.compile(r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]+(?![\p{L}\p{N}])")


def owner(kind, said):
    digits = re.sub("[^0-9]", "", said)
    return {0: said.rpartition("@")[2], 1: ".".join(said.split(".")[:3]), 2: digits[:6], 3: digits[:-4]}[kind]


def term_spans(texts, unseen=1, least=0.9, met=2, near=1 / 3, sure=0.5, z=1.2816):
    """Of each text the (start, end) of the words that disclose a value or its owner, by smoothed PMI over the distinct texts."""
    whole = sorted({t or "" for t in texts})
    words, outside, values = {}, {}, {}
    for t in whole:
        spans = personal_data(t)
        words[t] = set(TERM.findall(t))
        if not spans:
            continue
        values[t] = {(k, re.sub("[^0-9]", "", t[a:b]) if k in (2, 3) else t[a:b].lower()) for a, k, b in spans}
        values[t] |= {(k, "owner", owner(k, t[a:b].lower())) for a, k, b in spans}
        at, left = 0, []
        for a, _, b in spans:
            left.append(t[at:a] if a > at else "")
            at = max(at, b)
        outside[t] = set(TERM.findall(" ".join([*left, t[at:]])))
    of_term = Counter(w for t in whole for w in words[t])
    holders = defaultdict(set)
    for t, vs in values.items():
        for v in vs:
            holders[v].add(t)
    anywhere, elsewhere = set(), set()
    for held in {frozenset(h) for h in holders.values()}:
        together = Counter(w for t in held for w in words[t])
        for w in set().union(*(outside[t] for t in held)):
            n, c, both, e = len(whole), of_term[w], together[w], len(held)
            ic, p = math.log2(n / e), both / c
            share = (p + z * z / (2 * c) - z * math.sqrt((p * (1 - p) + z * z / (4 * c)) / c)) / (1 + z * z / c)
            if both >= met and share >= near and ic > 0 and math.log2(n * both / ((c + unseen) * e)) / ic >= least:
                anywhere.add(w)
                if share >= sure:
                    elsewhere.add(w)
    return {t: [m.span() for m in TERM.finditer(t) if m.group() in (anywhere if t in values else elsewhere)] for t in whole}
