"""Plain Python versions that the operators are held against."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, k: int = 5) -> set:
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def components(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(rows, percent: int) -> dict:
    """{id: (n, component)} by comparing every pair that shares a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    links = set()
    for i, s in sets.items():
        count: dict = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    count[j] = count.get(j, 0) + 1
        links |= {(j, i) for j, c in count.items() if 100 * c >= percent * (len(s) + len(sets[j]) - c)}
    comp = components(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def fill(sizes, weights, share=1.5, most=2.0):
    """Targets by pouring a little at a time: binary search for the level at which all of ``share`` is spent."""
    goal = share * sum(sizes)
    lo, hi = 0.0, 4.0 * sum(sizes) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(most * n, mid * w) for n, w in zip(sizes, weights)) < goal:
            lo = mid
        else:
            hi = mid
    return [min(most * n, hi * w) for n, w in zip(sizes, weights)]


def walk(documents, slots, block):
    """(id, size, words taken) of documents (s, start, size, id, row) under slots (s, block, words), one word after the other."""
    held = {}
    for k, (s, start, size, _, _) in enumerate(documents):
        for w in range(start, start + size):
            held[s, w] = k
    taken = [0] * len(documents)
    for s, b, words in slots:
        for w in range(b * block, b * block + words):
            taken[held[s, w]] += 1
    return [(d[3], d[2], n) for d, n in zip(documents, taken)]
