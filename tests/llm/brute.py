"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import combinations


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, k, percent):
    """Least id that each (id, text) reaches, with the size of its set; ids are distinct."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def rule_counts(text):
    text = text or ""
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def boilerplate_thinned(rows, ratio, pages):
    """Text of each (id, text, host) without its host's boilerplate lines."""
    bare = lambda x: x.strip(" \t\n\x0b\x0c\r")
    seen, totals = defaultdict(int), defaultdict(int)
    for _, text, host in rows:
        totals[host] += 1
        for line in {bare(x) for x in (text or "").split("\n")} - {""}:
            seen[host, line] += 1
    bad = {k for k, n in seen.items() if n >= pages and n > ratio * totals[k[0]]}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (h, bare(x)) not in bad)) for i, t, h in rows]


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()
