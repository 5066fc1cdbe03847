"""A hierarchical navigable small-world graph in flat arrays, vectorised.

Vectors are searched by largest inner product; the graph works on Euclidean
distance after the usual reduction (one more component makes all norms equal).
A shard has few enough vectors that the near neighbours of all its nodes come
from exact blocked products, not from inserting nodes one by one; the links kept of them are the diverse ones (a neighbour
that is nearer to one already kept is left out), and links go both ways.
Searching walks down the layers and then widens a beam on the lowest, for all
queries at once, each until its own best nodes have settled.
"""

from __future__ import annotations

import numpy as np

LINKS, NEAR, SCALE = 32, 64, 16
#: Nodes opened in a round, and the rounds without a new node among a query's best after which its beam has settled.
OPEN, SETTLED = 8, 15
BLOCK = 512


class Graph:
    """``layers[l]``: (node numbers, neighbour array of places in that layer, -1 padded)."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, seed: int = 1):
        self.points = _points(vectors)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(len(vectors))) / np.log(SCALE)).astype(np.int64)
        if len(level):
            level[level.argmax()] = level.max()
        self.layers = []
        for at in range(int(level.max(initial=0)) + 1):
            nodes = np.flatnonzero(level >= at)
            self.layers.append((nodes, _linked(self.points[nodes], links * 2 if at == 0 else links)))

    @classmethod
    def of(cls, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> "Graph":
        """The graph that was built of ``vectors``, from its layers."""
        graph = cls.__new__(cls)
        graph.points, graph.layers = _points(vectors), layers
        return graph

    def search(self, queries: np.ndarray, beam: int, k: int) -> np.ndarray:
        """Up to ``beam`` nodes found near each query, -1 padded, not sorted exactly.
        A query is done when its beam is used up or its ``k`` best have settled."""
        q = np.concatenate([queries.astype(np.float32), np.zeros((len(queries), 1), np.float32)], axis=1)
        nodes, _ = self.layers[-1]
        at = np.zeros(len(q), np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            nodes, near = self.layers[layer]
            at = self._descend(q, nodes, near, at)
            below = self.layers[layer - 1][0]
            at = np.searchsorted(below, nodes[at])
        return self._beam(q, self.layers[0][1], at, beam, k)

    def _descend(self, q, nodes, near, at):
        best = np.einsum("ij,ij->i", q, self.points[nodes[at]])
        todo = np.arange(len(q))
        while len(todo):
            options = near[at[todo]]
            score = np.einsum("ij,ikj->ik", q[todo], self.points[nodes[options]])
            score[options < 0] = -np.inf
            pick = score.argmax(axis=1)
            top = score[np.arange(len(todo)), pick]
            better = top > best[todo]
            moved = todo[better]
            at[moved] = options[better, pick[better]]
            best[moved] = top[better]
            todo = moved
        return at

    def _beam(self, q, near, start, beam, k):
        n, rows = len(self.points), np.arange(len(q))
        beam = min(beam, n)
        k, wide = min(k, beam), min(OPEN, beam)
        ids = np.full((len(q), beam), -1, np.int64)
        score = np.full((len(q), beam), -np.inf, np.float32)
        opened = np.ones((len(q), beam), bool)
        seen = np.zeros((len(q), n), bool)
        ids[:, 0], opened[:, 0] = start, False
        score[:, 0] = np.einsum("ij,ij->i", q, self.points[start])
        seen[rows, start] = True
        kth, still = np.full(len(q), -np.inf, np.float32), np.zeros(len(q), np.int64)
        live = rows
        while len(live):
            waiting = np.where(opened[live], -np.inf, score[live])
            pick = np.argpartition(-waiting, wide - 1, axis=1)[:, :wide]  # the nearest not yet opened
            take = np.isfinite(np.take_along_axis(waiting, pick, 1))
            go = take.any(axis=1) & (still[live] < SETTLED)
            live, pick, take = live[go], pick[go], take[go]
            if not len(live):
                break
            opened[live[:, None], pick] = True
            options = near[ids[live[:, None], pick]]
            options[~take] = -1
            options = np.sort(options.reshape(len(live), -1), axis=1)
            options[:, 1:][options[:, 1:] == options[:, :-1]] = -1
            new = (options >= 0) & ~seen[live[:, None], options]
            r, c = np.nonzero(new)
            seen[live[r], options[r, c]] = True
            found = np.full(options.shape, -np.inf, np.float32)
            found[r, c] = np.einsum("ij,ij->i", q[live[r]], self.points[options[r, c]])
            every = np.concatenate([score[live], found], axis=1)
            keep = np.argpartition(-every, (k - 1, beam - 1), axis=1)[:, :beam]
            score[live] = np.take_along_axis(every, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(new, options, -1)], axis=1), keep, 1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], ~new], axis=1), keep, 1)
            now = score[live, k - 1]
            still[live] = np.where(np.isfinite(now) & (now <= kth[live]), still[live] + 1, 0)
            kth[live] = now
        return np.where(np.isfinite(score), ids, -1)


def _points(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float32)
    norm = np.einsum("ij,ij->i", v, v)
    extra = np.sqrt(np.maximum(norm.max() - norm, 0)) if len(v) else norm
    return np.concatenate([v, extra[:, None]], axis=1).astype(np.float32)


def _linked(points: np.ndarray, links: int) -> np.ndarray:
    n = len(points)
    k = min(NEAR, n - 1)
    if k <= 0:
        return np.full((n, 1), -1, np.int32)
    norm = np.einsum("ij,ij->i", points, points)
    near = np.empty((n, k), np.int64)
    dist = np.empty((n, k), np.float32)
    for a in range(0, n, BLOCK):
        d = norm[a:a + BLOCK, None] + norm[None, :] - 2 * (points[a:a + BLOCK] @ points.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near[a:a + BLOCK] = np.argpartition(d, k - 1, axis=1)[:, :k]
        dist[a:a + BLOCK] = np.take_along_axis(d, near[a:a + BLOCK], 1)
    order = np.argsort(dist, axis=1, kind="stable")
    near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
    half = max(1, links // 2)
    out = np.full((n, links), -1, np.int32)
    size = np.zeros(n, np.int64)
    for a in range(0, n, BLOCK):
        mine = near[a:a + BLOCK]
        p = points[mine]
        between = np.einsum("ijk,ijk->ij", p, p)
        between = between[:, :, None] + between[:, None, :] - 2 * np.einsum("ijk,ilk->ijl", p, p)
        kept = np.zeros(mine.shape, bool)
        for j in range(k):  # from the nearest on
            closer = (between[:, j, :] < dist[a:a + BLOCK, j:j + 1]) & kept
            kept[:, j] = ~closer.any(axis=1) & (kept.sum(axis=1) < half)
        for j in range(k):  # then the nearest of the rest
            kept[:, j] |= kept.sum(axis=1) < half
        r, c = np.nonzero(kept)
        slot = (np.cumsum(kept, axis=1) - 1)[r, c]
        out[a + r, slot] = mine[r, c]
        size[a:a + len(mine)] = kept.sum(axis=1)
    # Links back, for as long as a node has room.
    src = np.repeat(np.arange(n), size)
    dst = out[out >= 0].astype(np.int64)
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    first = np.searchsorted(dst, dst)
    slot = size[dst] + np.arange(len(dst)) - first
    ok = slot < links
    out[dst[ok], slot[ok]] = src[ok]
    # A ring through all nodes keeps the graph whole; it is a column of its own and costs no link.
    return np.concatenate([out, np.roll(np.arange(n, dtype=np.int32), -1)[:, None]], axis=1)
