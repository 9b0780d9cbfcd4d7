"""Components of near duplicates by an exact prefix-filter join, in plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def shingle_set(text: str | None, k: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[j:] for j in range(k)), strict=False))


def components(rows: list[tuple[int, str | None]], k: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """For each id the size of its set and the least id that links reach.

    Two sets that are similar enough share one of the first n - ceil(n * percent / 100) + 1
    shingles of either, in any order that all sets follow; rare ones come first.
    """
    nodes: dict[frozenset, list[int]] = defaultdict(list)
    sets = {doc: shingle_set(text, k) for doc, text in rows}
    for doc, held in sets.items():
        nodes[held].append(doc)
    distinct = sorted((s for s in nodes if s), key=len)
    often = Counter(x for s in distinct for x in s)
    order = {x: r for r, x in enumerate(sorted(often, key=lambda x: (often[x], x)))}
    parent = list(range(len(distinct)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index: dict[int, list[int]] = defaultdict(list)
    for i, held in enumerate(distinct):
        n = len(held)
        prefix = sorted(map(order.__getitem__, held))[: n - -(-n * percent // 100) + 1]
        seen = set()
        for x in prefix:
            for j in index[x]:
                if j in seen or 100 * len(distinct[j]) < percent * n or root(i) == root(j):
                    continue
                seen.add(j)
                common = len(held & distinct[j])
                if 100 * common >= percent * (n + len(distinct[j]) - common):
                    parent[root(i)] = root(j)
            index[x].append(i)
    least: dict[int, int] = {}
    for i, held in enumerate(distinct):
        least[root(i)] = min(least.get(root(i), min(nodes[held])), *nodes[held])
    out = {doc: (0, doc) for doc in nodes.get(frozenset(), [])}
    for i, held in enumerate(distinct):
        out |= {doc: (len(held), least[root(i)]) for doc in nodes[held]}
    return out
