"""Brute-force twins of the distributed algorithms, for small fixtures."""

from __future__ import annotations

import numpy as np


def pair_distances(x):
    x = np.asarray(x, float)
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


def core_distances(x, min_samples):
    d = np.sort(pair_distances(x), axis=1)  # column 0 is the point itself
    return d[:, min(min_samples, len(x) - 1)]


def mutual_reachability(x, min_samples):
    c = core_distances(x, min_samples)
    w = np.maximum(np.maximum(pair_distances(x), c[:, None]), c[None, :])
    np.fill_diagonal(w, np.inf)
    return w


def prim(w):
    """Edges (weight, i, j) of a minimum spanning tree."""
    n = len(w)
    inside, best, source = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    inside[0], out = True, []
    best, source = w[0].copy(), np.zeros(n, int)
    for _ in range(n - 1):
        j = int(np.argmin(np.where(inside, np.inf, best)))
        out.append((best[j], min(source[j], j), max(source[j], j)))
        inside[j] = True
        closer = w[j] < best
        best, source = np.where(closer, w[j], best), np.where(closer, j, source)
    return out


def hdbscan(x, min_cluster_size, min_samples, epsilon=0.0):
    """Labels by a recursive top-down reading of the definition; -1 is noise."""
    edges = sorted(prim(mutual_reachability(x, min_samples)))
    n = len(x)
    clusters = []  # dicts: members, birth, lam sums, children

    def parts(nodes, inner):
        """Components of ``nodes`` under edges ``inner``."""
        label = {v: v for v in nodes}

        def root(v):
            while label[v] != v:
                v = label[v]
            return v

        for _, a, b in inner:
            label[root(a)] = root(b)
        groups = {}
        for v in nodes:
            groups.setdefault(root(v), set()).add(v)
        return list(groups.values())

    def grow(nodes, inner, birth, parent):
        me = {"birth": birth, "mass": 0.0, "kids": [], "own": set(), "parent": parent}
        clusters.append(me)
        size0 = len(nodes)
        lam0 = 0.0 if birth == np.inf else 1 / max(birth, 1e-12)
        while True:
            if not inner:
                break
            w, a, b = inner[-1]
            inner = inner[:-1]
            lam = 1 / max(w, 1e-12)
            two = parts(nodes, inner)
            two = sorted(two, key=len, reverse=True)
            big = [p for p in two if len(p) >= min_cluster_size]
            if len(big) == 2:
                me["mass"] += lam * len(nodes)
                for p in big:
                    me["kids"].append(
                        grow(p, [e for e in inner if e[1] in p], w, me)
                    )
                nodes = set()
                break
            if len(big) == 0:
                me["mass"] += lam * len(nodes)
                me["own"] |= nodes
                nodes = set()
                break
            gone = nodes - big[0]
            me["mass"] += lam * len(gone)
            me["own"] |= gone
            nodes, inner = big[0], [e for e in inner if e[1] in big[0]]
        me["stability"] = me["mass"] - lam0 * size0
        return me

    root = grow(set(range(n)), edges, np.inf, None)

    def eom(c):
        below = sum(eom(k) for k in c["kids"])
        c["good"] = c is not root and c["stability"] >= below
        return max(c["stability"], below) if c is not root else below

    eom(root)
    chosen = []

    def pick(c):
        if c.get("good"):
            chosen.append(c)
        else:
            for k in c["kids"]:
                pick(k)

    pick(root)
    if epsilon > 0:
        lifted = []
        for c in chosen:
            while c["birth"] < epsilon and c["parent"] is not root:
                c = c["parent"]
                if c["birth"] > epsilon:
                    break
            if all(c is not x for x in lifted):
                lifted.append(c)
        chosen = lifted
    labels = np.full(n, -1)

    def paint(c, v):
        for i in c["own"]:
            labels[i] = v
        for k in c["kids"]:
            paint(k, v)

    for v, c in enumerate(chosen):
        paint(c, v)
    return labels


def same_partition(a, b):
    """Equal noise and equal grouping, whatever the names."""
    a, b = np.asarray(a), np.asarray(b)
    if not np.array_equal(a == -1, b == -1):
        return False
    pairs = {(x, y) for x, y in zip(a, b) if x != -1}
    return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
