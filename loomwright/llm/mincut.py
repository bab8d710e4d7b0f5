"""Minimum cut of small graphs with two labels, exact.

Energy: each node pays |z| for going against the sign of z, and each edge its weight where
its ends differ. A node whose |z| is at least the sum of its open edges takes z's sign in
some minimum cut: such nodes are settled first and their edges folded into their
neighbours, over and over. What is left goes through maximum flow (Dinic).
"""

from __future__ import annotations

from collections import deque


def min_cut(z: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for each node on the side of positive z; nodes that may be on either side are False."""
    n = len(z)
    z = list(z)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(z[i]) >= sum(near[i].values()):
            label[i] = z[i] > 0
            for j, w in near[i].items():
                z[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        reached = _source_side(left, z, near)
        for i in left:
            label[i] = i in reached
    return [bool(x) for x in label]


def _source_side(left: list[int], z: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow."""
    s, t, eps = -1, -2, 1e-9
    cap: dict[int, dict[int, float]] = {s: {}, t: {}} | {i: dict(near[i]) for i in left}
    for i in left:
        cap[s][i], cap[i][s] = max(z[i], 0.0), 0.0
        cap[i][t], cap[t][i] = max(-z[i], 0.0), 0.0
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > eps and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if t not in level:
            level.pop(s)
            return set(level)
        open_ = {u: iter(list(cap[u])) for u in level}
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= flow
                    cap[b][a] += flow
                # Back to before the first edge that is full now.
                k = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] <= eps)
                path = path[: k + 1]
                continue
            for v in open_[u]:
                if cap[u][v] > eps and level.get(v, -1) == level[u] + 1:
                    # u's turn at v is not over until v runs dry: look at v again first.
                    path.append(v)
                    break
            else:
                level[u] = -1
                path.pop()
                if path:
                    continue
