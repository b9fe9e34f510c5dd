"""Links inside a tile pair: what leaves a task is a spanning forest, never all pairs."""

from __future__ import annotations

import numpy as np


def spanning_forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Indices of links ``u[i] - v[i]`` (vertices below ``n``) that join what all of them join.

    Every round each component picks its first link to another one (Boruvka), so dense links shrink in a few
    vectorised rounds.
    """
    label = np.arange(n)
    live = np.flatnonzero(u != v)
    chosen = []
    while True:
        a, b = label[u[live]], label[v[live]]
        apart = a != b
        live, a, b = live[apart], a[apart], b[apart]
        if not len(live):
            break
        first = np.full(n, len(live))
        rank = np.arange(len(live))
        np.minimum.at(first, a, rank)
        np.minimum.at(first, b, rank)
        picked = np.unique(first[first < len(live)])
        chosen.append(live[picked])
        parent = np.arange(n)

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(a[picked].tolist(), b[picked].tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
