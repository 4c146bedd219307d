"""Plain-Python references used only by the tests."""

import heapq
import math


def brandes_edges(nodes, edges, sources=None):
    """Weighted edge betweenness (undirected), ordered-pair sums per source."""
    adj = {n: [] for n in nodes}
    for u, v, w in edges:
        if u == v:
            continue
        adj[u].append((v, w))
        adj[v].append((u, w))
    credit = {}
    for s in (sources if sources is not None else nodes):
        dist = {s: 0}
        sigma = {s: 1.0}
        preds = {s: []}
        order = []
        pq = [(0, s)]
        done = set()
        while pq:
            d, x = heapq.heappop(pq)
            if x in done:
                continue
            done.add(x)
            order.append(x)
            for y, w in adj[x]:
                nd = d + w
                if y not in dist or nd < dist[y]:
                    dist[y] = nd
                    sigma[y] = sigma[x]
                    preds[y] = [x]
                    heapq.heappush(pq, (nd, y))
                elif nd == dist[y]:
                    sigma[y] += sigma[x]
                    preds[y].append(x)
        delta = {x: 0.0 for x in order}
        for x in reversed(order):
            for p in preds[x]:
                c = sigma[p] / sigma[x] * (1 + delta[x])
                key = (min(p, x), max(p, x))
                credit[key] = credit.get(key, 0.0) + c
                delta[p] += c
    return credit


def seg_dist(px, py, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    if l2 == 0:
        return math.hypot(px - ax, py - ay)
    t = ((px - ax) * dx + (py - ay) * dy) / l2
    if t <= 0:
        return math.hypot(px - ax, py - ay)
    if t >= 1:
        return math.hypot(px - bx, py - by)
    return math.hypot(px - (ax + t * dx), py - (ay + t * dy))


def quantile_rank_ref(x, q):
    """The documented uniform quantile transform (two interpolations averaged,
    clamped within 1e-7 of the ends, low clamp last)."""
    import numpy as np
    q = np.asarray(q, dtype=float)
    ref = np.linspace(0, 1, len(q))
    x = np.asarray(x, dtype=float)
    out = 0.5 * (np.interp(x, q, ref) - np.interp(-x, -q[::-1], -ref[::-1]))
    out[x + 1e-7 > q[-1]] = 1.0
    out[x - 1e-7 < q[0]] = 0.0
    return out
