"""Brute force that several tests compare with."""

from collections import Counter


def words(t):
    return (t or "").encode().lower().split()


def bag(w):
    """Multiset of 5-word shingles; fewer words are one."""
    return Counter(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def groups(rows, k):
    """``(id, smallest id reachable)`` of each row by sets of k-word shingles, all pairs compared."""
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for at, (a, x) in enumerate(sets):
        for b, y in sets[:at]:
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                u, v = root(a), root(b)
                parent[max(u, v)] = min(u, v)
    return [(i, root(i)) for i, _ in sets]


def contaminated(rows, items):
    """Ids of texts with a window like an item; shorter texts are one window."""
    out = set()
    bags = [(v := words(s), bag(v)) for _, s in items]
    grams = [set(b) for _, b in bags]
    for d, t in rows:
        w = words(t)
        own = set(bag(w)) | {tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1)}
        for (v, b), g in zip(bags, grams, strict=True):
            if not v or not w or not own & g:
                continue
            size = min(len(v), len(w))
            for k in range(len(w) - size + 1):
                a = bag(w[k : k + size])
                n = sum((a & b).values())
                if n >= 0.8 * (sum(a.values()) + sum(b.values()) - n):
                    out.add(d)
                    break
    return out


def jump(key, n):
    key, b, j = key & ((1 << 64) - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b
