"""Ordinal logistic regression: thresholds over one linear score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.maths import dot, ordinal_class, softplus_neg
from storyloom.operators.models import partition_sums


#: Classes a label may have.
MAX_CLASSES = 1000


def class_index(df: DataFrame, label: str) -> DataFrame:
    """``y``: rank of the label among its distinct values, from 0 (intended remapping).

    The distinct labels are ranked, a table of as many rows as there are classes; more than ``MAX_CLASSES`` of them
    are an error, as such a label is no class.
    """
    labels = df.where(F.col(label).isNotNull()).select(label).distinct()
    if len(labels.limit(MAX_CLASSES + 1).collect()) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} distinct labels")
    ranks = labels.withColumn("y", F.dense_rank().over(Window.orderBy(label)) - 1)
    return df.join(F.broadcast(ranks), label)


def observed_class_index(labels: list[float]) -> list[float]:
    """The observed remapping in place, value by value, by which labels below their rank collapse."""
    y = list(labels)
    for i, u in enumerate(sorted(set(y))):
        y = [i if v == u else v for v in y]
    return y


def objective_terms(xw: Column, y: Column, theta: list[float], observed: bool = True) -> Column:
    """Loss of one row given its linear score.

    ``-log s(a) - log(1 - s(b)) - log(1 - exp(lower - upper))`` with ``a = theta_y - xw``; ``b`` uses the same threshold
    (observed) or the one below (intended). Class 0 has only the first term, and in intended mode the top class only the second.
    """
    t = F.array(*[F.lit(float(x)) for x in theta])
    upper, lower = F.get(t, y), F.get(t, y - 1)
    b = upper - xw if observed else lower - xw
    gap = F.when(y > 0, -F.log(1 - F.exp(lower - upper))).otherwise(0.0)
    low = F.when(y > 0, softplus_neg(-b)).otherwise(0.0)
    if observed:
        return softplus_neg(upper - xw) + low + gap
    top = len(theta)  # thresholds 0 .. K-2; class K-1 lies above the last
    return F.when(y == top, softplus_neg(-(F.lit(float(theta[-1])) - xw))).otherwise(softplus_neg(upper - xw) + low + gap)


def objective(df: DataFrame, x: str, y: str, w: list[float], theta: list[float]) -> DataFrame:
    """One row ``objective`` as observed: sum of the losses and the barrier on the gaps; 1e10 for a negative gap."""
    gaps = [b - a for a, b in zip(theta, theta[1:], strict=False)]
    if any(g < 0 for g in gaps):
        return df.agg(F.lit(1e10).alias("objective"))
    barrier = -float(np.sum(np.log(gaps))) if gaps else 0.0
    return df.agg((F.sum(objective_terms(dot(F.col(x), w), F.col(y), theta)) + F.lit(barrier)).alias("objective"))


def _sig(t: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(t / 2))


def _softplus(t: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, t)


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Proportional-odds loss of rows and its gradient in (w, theta); ``theta`` has K - 1 thresholds."""
    k = len(theta)
    xw = x @ w
    has_up, has_low = y < k, y > 0
    up = np.where(has_up, theta[np.minimum(y, k - 1)], np.inf)
    low = np.where(has_low, theta[np.maximum(y - 1, 0)], -np.inf)
    a, b = up - xw, low - xw
    loss = np.where(has_up, _softplus(-a), 0) + np.where(has_low, _softplus(b), 0)
    both = has_up & has_low
    gap = np.where(both, up - low, 1.0)
    loss = loss + np.where(both, -np.log(-np.expm1(-gap)), 0)
    da = np.where(has_up, -_sig(-a), 0)
    db = np.where(has_low, _sig(b), 0)
    dg = np.where(both, -1 / np.expm1(gap), 0)
    g = np.zeros(len(w) + k)
    g[: len(w)] = -(da + db) @ x
    np.add.at(g, len(w) + np.minimum(y, k - 1), np.where(has_up, da + dg, 0))
    np.add.at(g, len(w) + np.maximum(y - 1, 0), np.where(has_low, db - dg, 0))
    return float(loss.sum()), g


class OrdinalLogistic:
    """Fitted weights and K - 1 thresholds."""

    def __init__(self, w: np.ndarray, theta: np.ndarray, loss: float, steps: int):
        self.w, self.theta, self.loss, self.steps = w, theta, loss, steps

    @staticmethod
    def fit(df: DataFrame, x: str, y: str, classes: int, max_iter: int = 60, tol: float = 1e-6) -> OrdinalLogistic:
        """Minimise the proportional-odds loss by L-BFGS from w = 0 and even thresholds.

        Thresholds go in as the first one and the logarithms of the gaps, so they stay in order. Every evaluation is one
        pass of partial sums (one row a partition). ``x`` is an array column, ``y`` the class index from 0.
        """
        data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y).cache()
        p, k = len(data.select(x).first()[0]), classes - 1
        n = data.count()

        def evaluate(z: np.ndarray) -> tuple[float, np.ndarray]:
            w, theta = z[:p], np.cumsum(np.concatenate([z[p : p + 1], np.exp(z[p + 1 :])]))

            def part(pdf: pd.DataFrame) -> np.ndarray:
                loss, g = loss_and_gradient(np.stack(pdf[x].to_numpy()), pdf[y].to_numpy().astype(int), w, theta)
                return np.concatenate([[loss], g])

            total = partition_sums(data, [x, y], part, 1 + p + k)
            g_theta = total[1 + p :]
            tail = np.cumsum(g_theta[::-1])[::-1]
            g = np.concatenate([total[1 : 1 + p], tail[:1], tail[1:] * np.exp(z[p + 1 :])])
            return total[0] / n, g / n

        z = np.concatenate([np.zeros(p), [-(k - 1) / 2], np.zeros(k - 1)])
        z, loss, steps = lbfgs(evaluate, z, max_iter, tol)
        data.unpersist()
        return OrdinalLogistic(z[:p], np.cumsum(np.concatenate([z[p : p + 1], np.exp(z[p + 1 :])])), loss * n, steps)

    def predict(self, x: str) -> Column:
        return ordinal_class(dot(F.col(x), self.w.tolist()), [*self.theta.tolist(), float("inf")])


def lbfgs(f, z: np.ndarray, max_iter: int, tol: float, memory: int = 8) -> tuple[np.ndarray, float, int]:
    """Limited-memory BFGS with backtracking (Armijo)."""
    value, g = f(z)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(max_iter):
        if np.abs(g).max() < tol:
            return z, value, step
        q, alphas = g.copy(), []
        for s, yv in reversed(pairs):
            a = s @ q / (yv @ s)
            alphas.append(a)
            q -= a * yv
        if pairs:
            s, yv = pairs[-1]
            q *= s @ yv / (yv @ yv)
        for (s, yv), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - yv @ q / (yv @ s))
        d, t = -q, 1.0 if pairs else 1.0 / max(1.0, float(np.abs(g).sum()))
        for _ in range(30):
            new = z + t * d
            v, gn = f(new)
            if np.isfinite(v) and v <= value + 1e-4 * t * (g @ d):
                break
            t /= 2
        else:
            return z, value, step
        s, yv = new - z, gn - g
        if s @ yv > 1e-12:
            pairs = [*pairs, (s, yv)][-memory:]
        done = value - v < tol * max(1.0, abs(value)) * 1e-3
        z, value, g = new, v, gn
        if done:
            return z, value, step + 1
    return z, value, max_iter
