"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict


def words_between_blanks(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def words_of_letters(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def shingles(text, n):
    words = words_between_blanks(text)
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def near_duplicates(rows, n, percent):
    """{id: (set size, smallest reachable id)} of (id, text) rows, by all pairs with a common shingle."""
    sets = {i: shingles(t, n) for i, t in rows}
    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    common = defaultdict(int)
    for ids in by_shingle.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common[a, b] += 1
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (a, b), both in common.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def contamination(text, items, window=10):
    """(words, hit words, item ids) by looking for every window at every place."""
    words = words_of_letters(text)
    hit, found = set(), set()
    for name, item in items:
        w = words_of_letters(item)
        size = min(window, len(w))
        for s in range(len(w) - size + 1) if size else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == w[s : s + size]:
                    hit.update(range(i, i + size))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)
