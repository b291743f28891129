"""Plain code that tests hold operators against."""

from collections import defaultdict


def shingle_set(text, n):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def components_by_brute_force(docs, n, percent):
    """id -> (set size, smallest linked id), all pairs that share a shingle compared."""
    sets = {i: shingle_set(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for j in holders[g]:
                shared[j] += 1
            holders[g].append(i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}
