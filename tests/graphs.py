"""Toy graphs and sequential versions of the algorithms, in plain Python."""

from __future__ import annotations

import random
from collections import deque

TOYS = {
    "empty_source": (5, [(0, 1), (1, 2)]),
    "path": (6, [(5, 4), (4, 3), (3, 2), (2, 1), (1, 0)]),
    "loops_dups": (4, [(3, 3), (3, 0), (3, 0), (0, 1)]),
    "two_triangles": (7, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)]),
    "directed_v": (4, [(0, 2), (1, 2)]),
    "clique6": (6, [(i, j) for i in range(6) for j in range(i + 1, 6)]),
    "star_out": (31, [(0, i) for i in range(1, 31)]),
}
FREEZE = (63, [(i, 35) for i in range(36, 63)] + [(35, 30), (30, 31), (31, 32), (32, 33), (33, 34)] + [(34, i) for i in range(30)])
DETOUR = (5, [(3, 0, 9), (3, 1, 2), (1, 2, 2), (2, 0, 2), (3, 4, 1)])


def random_graph(seed: int, n: int = 25, m: int = 45) -> tuple[int, list[tuple[int, int]]]:
    r = random.Random(seed)
    return n, [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def bfs(n, edges, s):
    level, queue = {s: 1}, deque([s])
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    while queue:
        a = queue.popleft()
        for b in out.get(a, []):
            if b not in level:
                level[b] = level[a] + 1
                queue.append(b)
    return level


def components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in range(n)}


def shortest(n, edges, s):
    dist = {s: 0}
    for _ in range(n):
        for a, b, w in edges:
            if a in dist and dist[a] + w < dist.get(b, 1 << 60):
                dist[b] = dist[a] + w
    pred = {}
    for a, b, w in edges:
        if a in dist and b in dist and dist[b] > 0 and dist[a] + w == dist[b]:
            pred[b] = min(a, pred.get(b, a))
    return dist, pred


def first_fit(n, edges, classes):
    near = {v: set() for v in range(n)}
    for a, b in edges:
        if a != b:
            near[max(a, b)].add(min(a, b))
    colour = {}
    for v in range(n):
        used, c = {colour[u] for u in near[v]}, 1
        while c in used:
            c += 1
        colour[v] = c
    return {v: min(classes, c) for v, c in colour.items()}


def jacobi(n, edges, rounds, tol, first):
    deg = {}
    for a, _ in edges:
        deg[a] = deg.get(a, 0) + 1
    rank, seen = {v: 0.15 for v in range(n)}, {v: first for v in range(n)}
    for _ in range(rounds):
        s = dict.fromkeys(range(n), 0.0)
        for a, b in edges:
            s[b] += rank[a] / deg[a]
        new = {v: 0.15 + 0.85 * s[v] for v in range(n)}
        move = max(abs(new[v] - seen[v]) for v in range(n))
        rank, seen = new, new
        if move <= tol:
            break
    return rank


def in_place(n, edges, rounds, tol, part, classes):
    deg, into = {}, {v: [] for v in range(n)}
    for a, b in edges:
        deg[a] = deg.get(a, 0) + 1
        into[b].append(a)
    rank, share, frozen = dict.fromkeys(range(n), 0.0), dict.fromkeys(range(n), 0.0), set()
    for k in range(rounds):
        moved = False
        for p in range(1, classes + 1):
            before = dict(share)
            for v in range(n):
                if part[v] != p or v in frozen:
                    continue
                new = 0.15 + 0.85 * sum(before[u] for u in into[v])
                d = abs(new - rank[v])
                moved |= d > tol
                if d < tol:
                    frozen.add(v)
                rank[v] = new
                if deg.get(v):
                    share[v] = new / deg[v]
        if not moved:
            break
    return rank, k + 1
