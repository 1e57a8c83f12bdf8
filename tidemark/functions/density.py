"""Hierarchical density clustering of one block of points (Campello, Moulavi and Sander, 2013)."""

from __future__ import annotations

import heapq

import numpy as np


def _core_distances(x: np.ndarray, k: int) -> np.ndarray:
    """Distance to the k-th nearest point, the point itself being the first."""
    out = np.empty(len(x))
    size = (x * x).sum(axis=1)
    for a in range(0, len(x), 512):
        d = size[a : a + 512, None] + size[None, :] - 2 * (x[a : a + 512] @ x.T)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[a : a + 512] = np.sqrt(((x[a : a + 512, None, :] - x[near]) ** 2).sum(axis=2)).max(axis=1)
    return out


def _spanning_tree(x: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of the least spanning tree of mutual reachability, by distance. One row of distances is held at a time."""
    n = len(x)
    best, source, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        d = np.maximum(np.sqrt(((x - x[at]) ** 2).sum(axis=1)), np.maximum(core, core[at]))
        nearer = (d < best) & ~inside
        best[nearer], source[nearer] = d[nearer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((float(best[at]), int(source[at]), at))
    return sorted(edges)


def density_clusters(x: np.ndarray, least: int) -> np.ndarray:
    """A cluster number for each point, or -1 for noise.

    Points join along the spanning tree; reading it from the top, a split into two parts of at least ``least`` points
    makes two clusters, and smaller parts fall out of theirs. Of nested clusters those of the largest excess of mass
    count; the whole is no cluster. Fewer points than ``least`` are all noise.
    """
    n = len(x)
    if n < max(least, 2):
        return np.full(n, -1)
    return labels_of_tree(_spanning_tree(x, _core_distances(x, min(least, n))), n, least)


def least_edges(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of the edges of the least spanning tree of a matrix of distances."""
    n = len(d)
    best, source, outside = d[0].copy(), np.zeros(n, int), np.ones(n, bool)
    best[0], outside[0] = np.inf, False
    left = np.empty(n - 1, int)
    right = np.empty(n - 1, int)
    for k in range(n - 1):
        at = int(best.argmin())
        left[k], right[k] = source[at], at
        outside[at] = False
        nearer = (d[at] < best) & outside
        np.copyto(best, d[at], where=nearer)
        source[nearer] = at
        best[at] = np.inf
    return left, right


def least_of_edges(left: np.ndarray, right: np.ndarray, d: np.ndarray, n: int) -> list[tuple[float, int, int]]:
    """What :func:`_spanning_tree` gives for n points, from given edges among which are those of all least spanning trees."""
    order = np.argsort(d, kind="stable")
    left, right, d = left[order], right[order], d[order]
    root, near = list(range(n)), [[] for _ in range(n)]

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    bounds = [0, *(np.flatnonzero(d[1:] != d[:-1]) + 1).tolist(), len(d)]
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        kept = [(a, b) for a, b in zip(left[begin:end].tolist(), right[begin:end].tolist(), strict=True) if find(a) != find(b)]
        for a, b in kept:
            root[find(b)] = find(a)
            near[a].append((float(d[begin]), b))
            near[b].append((float(d[begin]), a))
    # The order in which points join, and from which one, decides between equal distances.
    waiting, inside, out, at, turn = [], [False] * n, [], 0, 0
    inside[0] = True
    for _ in range(n - 1):
        for x, b in near[at]:
            if not inside[b]:
                heapq.heappush(waiting, (x, b, turn, at))
        turn += 1
        x, b, _, a = heapq.heappop(waiting)
        while inside[b]:
            x, b, _, a = heapq.heappop(waiting)
        inside[b], at = True, b
        out.append((x, a, b))
    return sorted(out)


def labels_of_tree(edges: list[tuple[float, int, int]], n: int, least: int) -> np.ndarray:
    """:func:`density_clusters` of n points from the edges of their spanning tree, by distance."""
    labels = np.full(n, -1)
    parts: dict[int, tuple[int, int, float]] = {}
    size, top = dict.fromkeys(range(n), 1), list(range(n))
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for step, (d, a, b) in enumerate(edges):
        p, q = find(a), find(b)
        parts[n + step] = (top[p], top[q], 1.0 / max(d, 1e-12))
        size[n + step] = size[top[p]] + size[top[q]]
        root[q], top[p] = p, n + step

    # Points in the order of the tree: a node's are side by side, from ``begin`` on.
    begin = {n + len(edges) - 1: 0}
    for node in range(n + len(edges) - 1, n - 1, -1):
        a, b = parts[node][:2]
        begin[a] = begin[node]
        begin[b] = begin[node] + size[a]
    place = np.array([begin[k] for k in range(n)])

    def points(node: int) -> slice:
        return slice(begin[node], begin[node] + size[node])

    parent, born, mass, owner = [-1], [0.0], [0.0], np.zeros(n, int)
    todo = [(n + len(edges) - 1, 0)]
    while todo:
        node, cluster = todo.pop()
        left, right, density = parts[node]
        big = [k for k in (left, right) if size[k] >= least]
        if len(big) == 2:
            mass[cluster] += (density - born[cluster]) * size[node]
            for k in big:
                parent.append(cluster)
                born.append(density)
                mass.append(0.0)
                owner[points(k)] = len(parent) - 1
                if k >= n:
                    todo.append((k, len(parent) - 1))
            continue
        for k in (left, right):
            if k not in big:
                mass[cluster] += (density - born[cluster]) * size[k]
                owner[points(k)] = cluster
        for k in big:
            if k >= n:
                todo.append((k, cluster))
            else:
                mass[cluster] += density - born[cluster]
    below, chosen = np.zeros(len(parent)), np.zeros(len(parent), bool)
    for c in range(len(parent) - 1, 0, -1):
        chosen[c] = mass[c] >= below[c]
        below[parent[c]] += max(mass[c], below[c])
    above, best = [False] * len(parent), [-1] * len(parent)
    for c in range(1, len(parent)):  # parents come first
        above[c] = above[parent[c]] or bool(chosen[parent[c]])
        chosen[c] &= not above[c]
        best[c] = c if chosen[c] else best[parent[c]]
    labels[:] = np.array(best)[owner[place]]
    return labels
