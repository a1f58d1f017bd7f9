"""A linear-chain conditional random field over sparse binary features, trained by full-batch
gradient ascent on the regularised log likelihood; forward-backward runs over all sequences at
once, padded to the longest."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class CRF:
    def __init__(self, tags: Sequence[str]):
        self.tags = list(tags)
        self.feature: dict[str, int] = {}
        k = len(self.tags)
        self.weights, self.moves, self.first = np.zeros((0, k)), np.zeros((k, k)), np.zeros(k)

    def fit(self, sequences: Sequence[tuple[Sequence[Sequence[str]], Sequence[str]]], steps: int = 120, rate: float = 0.15, decay: float = 2e-4, least: int = 2) -> CRF:
        """``sequences``: (features of each position, tag of each position)."""
        sequences = sorted(sequences, key=lambda s: -len(s[0]))  # at each position the first ones go on
        k, n = len(self.tags), len(sequences)
        seen: dict[str, int] = {}
        for xs, _ in sequences:
            for x in xs:
                for f in x:
                    seen[f] = seen.get(f, 0) + 1
        self.feature = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= least))}
        longest = max(len(xs) for xs, _ in sequences)
        rows, cols, at, gold = [], [], [], []
        y = np.full((n, longest), -1)
        for s, (xs, ts) in enumerate(sequences):
            for p, (x, t) in enumerate(zip(xs, ts)):
                y[s, p] = self.tags.index(t)
                ids = {self.feature[f] for f in x if f in self.feature}
                rows += [len(at)] * len(ids)
                cols += ids
                at.append(s * longest + p)
        rows, cols, at = np.array(rows, int), np.array(cols, int), np.array(at)
        gold = y.reshape(-1)[at]
        mask = y >= 0
        live = [*mask.sum(axis=0).tolist(), 0]  # sequences that reach each position
        w, m, b = np.zeros((len(self.feature), k)), np.zeros((k, k)), np.zeros(k)
        state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, m, b)]
        hot = np.eye(k)
        move_gold = np.zeros((k, k))
        for p in range(1, longest):
            both = mask[:, p]
            np.add.at(move_gold, (y[both, p - 1], y[both, p]), 1)
        first_gold = np.bincount(y[:, 0], minlength=k)
        order = np.argsort(cols, kind="stable")
        r2, starts = rows[order], np.searchsorted(cols[order], np.arange(len(self.feature)))
        bounds = np.searchsorted(rows, np.arange(len(at)))
        for step in range(1, steps + 1):
            e = np.zeros((n * longest, k))
            if len(rows):
                e[at] = np.where((np.diff(np.append(bounds, len(rows))) > 0)[:, None], np.add.reduceat(w[cols], np.minimum(bounds, len(rows) - 1), axis=0), 0)
            e = e.reshape(n, longest, k)
            a = [b + e[:, 0]]
            for p in range(1, longest):
                q = live[p]
                a.append(_logsum(a[-1][:q, :, None] + m, 1) + e[:q, p])
            z = np.concatenate([_logsum(a[p][live[p + 1] :], 1) for p in range(longest - 1, -1, -1)])
            beta = np.zeros((live[longest - 1], k))
            marg = np.zeros((n, longest, k))
            move = np.zeros((k, k))
            for p in range(longest - 1, -1, -1):
                q = live[p]
                marg[:q, p] = np.exp(a[p] + beta - z[:q, None])
                if p:
                    inner = m[None] + (e[:q, p] + beta)[:, None, :]
                    move += np.exp(a[p - 1][:q, :, None] + inner - z[:q, None, None]).sum(axis=0)
                    beta = np.concatenate([_logsum(inner, 2), np.zeros((live[p - 1] - q, k))])
            err = hot[gold] - marg.reshape(-1, k)[at]
            grads = (np.add.reduceat(err[r2], starts, axis=0) / n - decay * w, (move_gold - move) / n - decay * m, (first_gold - marg[:, 0].sum(axis=0)) / n - decay * b)
            for v, g, (s1, s2) in zip((w, m, b), grads, state):
                s1 += 0.1 * (g - s1)
                s2 += 0.01 * (g * g - s2)
                v += rate * (s1 / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-8)
        self.weights, self.moves, self.first = w, m, b
        return self

    def emission(self, features: Sequence[str]) -> np.ndarray:
        """The score of each tag at a position, added up in the order of its features."""
        find = self.feature.get
        return self.weights[[i for f in features if (i := find(f)) is not None]].sum(axis=0)

    def tag(self, xs: Sequence[Sequence[str]], bias: np.ndarray | float = 0.0) -> list[str]:
        """The best tag sequence; ``bias`` is added to the score of each tag at each position."""
        return self.best([(self.emission(x) + bias).tolist() for x in xs])

    def best(self, emissions: Sequence[list[float]]) -> list[str]:
        """The best tag sequence, from the score of each tag at each position.  Few tags are
        compared faster in lists than in arrays."""
        into = self.moves.T.tolist()  # of each tag, from all tags
        best = [a + b for a, b in zip(self.first.tolist(), emissions[0])]
        back: list[list[int]] = []
        for e in emissions[1:]:
            now, at = [], []
            for to, x in zip(into, e):
                t = [a + b for a, b in zip(best, to)]
                m = max(t)
                at.append(t.index(m))
                now.append(m + x)
            best = now
            back.append(at)
        k = best.index(max(best))
        out = [k]
        for b in reversed(back):
            k = b[k]
            out.append(k)
        return [self.tags[i] for i in reversed(out)]

    def best_of(self, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``best`` of many sequences at once, as numbers of tags; they stand one after another in
        ``emissions`` and have ``sizes`` positions, at least one each."""
        order = np.argsort(-sizes, kind="stable")  # at each position the first ones go on
        first = (np.cumsum(sizes) - sizes)[order]
        live = np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left")  # longer than the position
        best = self.first + emissions[first]
        back = np.zeros(emissions.shape, np.int8)
        for p in range(1, len(live)):
            q = live[p]
            at = first[:q] + p
            t = best[:q, :, None] + self.moves
            back[at] = t.argmax(axis=1)
            best[:q] = t.max(axis=1) + emissions[at]
        out, k = np.zeros(len(emissions), np.int64), best.argmax(axis=1)
        for p in range(len(live) - 1, -1, -1):
            q = live[p]
            at = first[:q] + p
            out[at] = k[:q]
            if p:
                k[:q] = back[at, k[:q]]
        return out
