"""A hierarchical navigable small-world graph over one shard, in flat neighbour arrays.

Levels are drawn geometrically from a hash-ordered sequence, so a shard's graph depends on its
rows alone.  A level is built in bulk: candidates of all its nodes by blocked products, then the
usual choice of diverse neighbours (a candidate nearer to a chosen neighbour than to the node is
taken last) and reverse links.  Searches run over all queries at once: descent through the upper
levels, then a beam on the base level; a vector that is itself a node begins at its own node.
"""

from __future__ import annotations

import numpy as np

M, CANDIDATES, BEAM, STEP = 16, 24, 16, 4


def _top(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest of each row, largest first."""
    if s.shape[1] > k:
        part = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable")
        return np.take_along_axis(part, order, 1)
    return np.argsort(-s, axis=1, kind="stable")


class Graph:
    def __init__(self, x: np.ndarray, m: int = M, candidates: int = CANDIDATES, seed: int = 11):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(m)).astype(int) if n else np.zeros(0, int)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # base first: (nodes, neighbours)
        for k in range(level.max() + 1 if n else 0):
            nodes = np.flatnonzero(level >= k)
            width = 2 * m if k == 0 else m
            self.levels.append((nodes, self._link(nodes, width, candidates if k == 0 else max(8, candidates // 2))))

    def _link(self, nodes: np.ndarray, width: int, candidates: int) -> np.ndarray:
        """Neighbour array of a level, padded with -1, in places within ``nodes``."""
        y, n = self.x[nodes], len(nodes)
        k = min(candidates, n - 1)
        out = np.full((n, width), -1, np.int32)
        if k < 1:
            return out
        near = np.empty((n, k), np.int32)
        sims = np.empty((n, k), np.float32)
        for lo in range(0, n, 1024):
            s = y[lo : lo + 1024] @ y.T
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -9
            near[lo : lo + 1024] = c = _top(s, k)
            sims[lo : lo + 1024] = np.take_along_axis(s, c, 1)
        half = width // 2
        rank = np.empty((n, k), np.int32)  # order in which candidates are taken
        for lo in range(0, n, 1024):
            g = y[near[lo : lo + 1024]]
            between = np.matmul(g, g.transpose(0, 2, 1))
            chosen = np.zeros((len(g), k), bool)
            for j in range(k):
                chosen[:, j] = ~((between[:, j, :j] > sims[lo : lo + 1024, j, None]) & chosen[:, :j]).any(axis=1)
            rank[lo : lo + 1024] = np.argsort(np.where(chosen, 0, k) + np.arange(k), axis=1, kind="stable")
        # near and diverse: the nearest few always, then the diverse ones
        first = np.concatenate([np.broadcast_to(np.arange(min(6, k)), (n, min(6, k))), rank], axis=1)
        seen = np.zeros((n, k), bool)
        filled = np.zeros(n, int)
        rows = np.arange(n)
        for j in range(first.shape[1]):
            c = first[:, j]
            ok = ~seen[rows, c] & (filled < half)
            seen[rows[ok], c[ok]] = True
            out[rows[ok], filled[ok]] = near[rows[ok], c[ok]]
            filled += ok
        # reverse links, nearest first, into the free half
        src = np.repeat(rows, half)
        dst = out[:, :half].reshape(-1)
        keep = dst >= 0
        src, dst = src[keep], dst[keep]
        s = np.einsum("ij,ij->i", y[src], y[dst])
        order = np.lexsort((-s, dst))
        src, dst = src[order], dst[order]
        place = np.arange(len(dst)) - np.searchsorted(dst, dst)
        fits = place < width - half
        out[dst[fits], half + place[fits]] = src[fits]
        return out

    def search(self, q: np.ndarray, k: int, start: np.ndarray | None = None, beam: int = BEAM, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the ``k`` best of each query, -1 where there are fewer.  ``start``
        gives the queries' own nodes, which are left out of their results."""
        ids = np.full((len(q), k), -1, np.int64)
        sims = np.full((len(q), k), -2, np.float32)
        for lo in range(0, len(q) if len(self.x) else 0, 2048):
            part = slice(lo, lo + 2048)
            a, b = self._search(q[part], max(beam, k + 1), step, None if start is None else start[part])
            if start is not None:
                b = np.where(a == start[part, None], -2, b)
            order = np.argsort(-b, axis=1, kind="stable")[:, :k]
            w = order.shape[1]
            sims[part, :w] = np.take_along_axis(b, order, 1)
            ids[part, :w] = np.where(sims[part, :w] > -2, np.take_along_axis(a, order, 1), -1)
        return ids, sims

    def _descend(self, q: np.ndarray) -> np.ndarray:
        """The nearest node found above the base, for each query."""
        nodes, _ = self.levels[-1]
        at = nodes[(q @ self.x[nodes[:512]].T).argmax(axis=1)]
        for nodes, links in self.levels[-1:0:-1]:
            place = np.searchsorted(nodes, at)
            best = np.einsum("ij,ij->i", q, self.x[at])
            live = np.arange(len(q))
            while len(live):
                near = links[place[live]]
                s = np.where(near >= 0, np.einsum("ij,ikj->ik", q[live], self.x[nodes[near]]), -2)
                j = s.argmax(axis=1)
                v = s[np.arange(len(live)), j]
                better = v > best[live]
                live, near, j, v = live[better], near[better], j[better], v[better]
                place[live], best[live] = near[np.arange(len(live)), j], v
            at = nodes[place]
        return at

    def _search(self, q: np.ndarray, beam: int, step: int, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        _, links = self.levels[0]
        n = len(q)
        first = self._descend(q) if start is None else start
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -2, np.float32)
        done = np.zeros((n, beam), bool)
        ids[:, 0], sims[:, 0] = first, np.einsum("ij,ij->i", q, self.x[first])
        live = np.arange(n)
        while len(live):
            a, b, d = ids[live], sims[live], done[live]
            # the best nodes of the beam that were not opened yet
            open_ = np.where(d | (a < 0), -3, b)
            pick = np.argpartition(-open_, min(step, beam - 1) - 1, axis=1)[:, :step]
            ok = np.take_along_axis(open_, pick, 1) > -3
            more = ok.any(axis=1)
            live, a, b, d, pick, ok = live[more], a[more], b[more], d[more], pick[more], ok[more]
            if not len(live):
                break
            np.put_along_axis(d, pick, True, 1)
            near = np.where(ok[:, :, None], links[np.take_along_axis(a, pick, 1)], -1).reshape(len(live), -1)
            s = np.matmul(self.x[near], q[live][:, :, None])[:, :, 0]
            s[near < 0] = -2
            all_ids = np.concatenate([a, near], axis=1)
            all_sims = np.concatenate([b, s], axis=1)
            all_done = np.concatenate([d, np.zeros_like(near, bool)], axis=1)
            # a node met again is dropped; those of the beam come first and stay
            order = np.argsort(all_ids, axis=1, kind="stable")
            sorted_ids = np.take_along_axis(all_ids, order, 1)
            again = np.zeros_like(all_done)
            np.put_along_axis(again, order[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
            all_sims[again] = -2
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live] = np.where(np.take_along_axis(all_sims, best, 1) > -2, np.take_along_axis(all_ids, best, 1), -1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1)
        return ids, sims
