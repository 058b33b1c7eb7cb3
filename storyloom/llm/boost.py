"""Gradient-boosted trees on small integer features (logistic loss), in numpy; scores by a memo of feature tuples."""

from __future__ import annotations

import numpy as np

#: Values a feature may take: 0 .. VALUES - 1.
VALUES = 32
#: Of the thresholds whose F1 is within this of the best one, the one nearest to even odds is taken.
SLACK = 0.005


def _grow(x: np.ndarray, codes: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, lam: float, rate: float):
    """A tree on the rows; ``codes`` are the feature values in one range a feature, for one histogram of all."""
    gr, hr = g[rows], h[rows]
    total_g, total_h = gr.sum(), hr.sum()
    if depth and len(rows) >= 8:
        width = x.shape[1]
        flat = codes[rows].ravel()
        gl = np.cumsum(np.bincount(flat, np.repeat(gr, width), VALUES * width).reshape(width, VALUES), axis=1)[:, :-1]
        hl = np.cumsum(np.bincount(flat, np.repeat(hr, width), VALUES * width).reshape(width, VALUES), axis=1)[:, :-1]
        gain = gl * gl / (hl + lam) + (total_g - gl) ** 2 / (total_h - hl + lam) - total_g * total_g / (total_h + lam)
        gain[(hl < 0.5) | (total_h - hl < 0.5)] = 0
        f, k = divmod(int(gain.argmax()), VALUES - 1)
        if gain[f, k] > 1e-6:
            left = x[rows, f] <= k
            return (f, k, _grow(x, codes, g, h, rows[left], depth - 1, lam, rate), _grow(x, codes, g, h, rows[~left], depth - 1, lam, rate))
    return float(-rate * total_g / (total_h + lam))


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _values(tree, x: np.ndarray) -> np.ndarray:
    """Values of all rows at once."""
    out = np.empty(len(x))
    todo = [(tree, np.arange(len(x)))]
    while todo:
        t, rows = todo.pop()
        if isinstance(t, tuple):
            left = x[rows, t[0]] <= t[1]
            todo += [(t[2], rows[left]), (t[3], rows[~left])]
        else:
            out[rows] = t
    return out


class Boosted:
    """A fitted binary model: trees as nested tuples, and a threshold.

    Rows come in folds. Each fold, scored by trees fitted on the others, has a threshold of greatest F1 (each negative
    row counted ``negatives`` times, where real texts hold more of them); their median is taken, so that no odd frame
    decides, and the trees are fitted on all rows.
    """

    def __init__(self, rows: list[tuple], labels: list[int], folds: list[int] | None = None, negatives: float = 1.0, rounds: int = 100, depth: int = 4, rate: float = 0.25, lam: float = 1.0, seed: int = 0):
        x, y = np.clip(np.array(rows, dtype=np.int64), 0, VALUES - 1), np.array(labels, dtype=float)
        fold = np.random.default_rng(seed).integers(0, 4, len(y)) if folds is None else np.array(folds)
        # equal rows are one row of more weight
        both, self.weight = np.unique(np.column_stack([x, fold, y.astype(np.int64)]), axis=0, return_counts=True)
        x, fold, y = np.ascontiguousarray(both[:, :-2]), both[:, -2], both[:, -1].astype(float)
        self.memo: dict[tuple, float] = {}
        self.negatives = negatives
        out = np.zeros(len(y))
        for k in np.unique(fold):
            held = fold == k
            if not held.all():
                out[held] = self._fit(x, y, np.flatnonzero(~held), rounds, depth, rate, lam)[held]
        self.threshold = float(np.median([self._calibrate(out, y, self.weight * (fold == k)) for k in np.unique(fold)]))
        self.held_f1 = self._f1(out >= self.threshold, y)
        self._fit(x, y, np.arange(len(y)), rounds, depth, rate, lam)

    def _fit(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray, rounds: int, depth: int, rate: float, lam: float) -> np.ndarray:
        self.trees: list = []
        score = np.zeros(len(y))
        codes = (x + np.arange(x.shape[1]) * VALUES).astype(np.int32)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree = _grow(x, codes, self.weight * (p - y), self.weight * np.maximum(p * (1 - p), 1e-6), rows, depth, lam, rate)
            self.trees.append(tree)
            score += _values(tree, x)
        return score

    def _f1(self, p: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> float:
        w = self.weight if w is None else w
        hit = w[p & (y > 0)].sum()
        return float(2 * hit / max(1, hit + w[p & (y == 0)].sum() * self.negatives + w[y > 0].sum()))

    def _calibrate(self, score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
        cuts = sorted({0.0, *np.round(score[w > 0], 1)})
        f1 = {c: self._f1(score >= c, y, w) for c in cuts}
        best = max(f1.values())
        return min((c for c in cuts if f1[c] >= best - SLACK), key=abs)

    def __call__(self, row: tuple) -> float:
        """Margin over the threshold: positive selects."""
        s = self.memo.get(row)
        if s is None:
            s = self.memo[row] = sum(_value(t, row) for t in self.trees) - self.threshold
        return s
