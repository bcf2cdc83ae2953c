"""Quality classifier: a sparse rule ensemble.

Small trees are boosted on the statistics of labelled texts; every path from a root is a rule, the
conjunction of its thresholds. A logistic model with an L1 penalty weighs the rules, most of them with
zero. What is left is compiled into one Spark expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

from sparkboard.llm.rules import Condition, Rule, candidates, covered, every


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        z = np.full(n, self.bias)
        for rule, w in zip(self.rules, self.weights):
            z += w * covered(rule, x, n)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The probability of label 1, on a table of `statistics`."""
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            z = z + F.when(every(rule), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(x: dict[str, np.ndarray], target: np.ndarray, rows: np.ndarray, depth: int, path: Rule, out: list[tuple[Rule, np.ndarray, float]]) -> None:
    """A regression tree by least squares: adds (path, rows, mean) of every node but the root."""
    if path:
        out.append((path, rows, float(target[rows].mean())))
    if len(path) == depth or len(rows) < 20:
        return
    best, total, n = (1e-9, None), target[rows].sum(), len(rows)
    for name, values in x.items():
        v = values[rows]
        order = np.argsort(v, kind="stable")
        cuts = candidates(v)
        left = np.searchsorted(v[order], cuts, side="right")
        sums = np.concatenate([[0.0], np.cumsum(target[rows][order])])[left]
        ok = (left >= 5) & (left <= n - 5)
        if ok.any():
            gain = np.where(ok, sums**2 / np.maximum(left, 1) + (total - sums) ** 2 / np.maximum(n - left, 1) - total**2 / n, 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = gain[k], (name, float(cuts[k]))
    if best[1] is None:
        return
    name, cut = best[1]
    for above in (False, True):
        c = Condition(name, above, cut)
        _tree(x, target, rows[c.holds(x[name][rows])], depth, (*path, c), out)


def trained(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 30, depth: int = 3, shrinkage: float = 0.2, penalty: float = 5e-4, rounds: int = 500) -> Ensemble:
    """With one label only, or none, the score is that label's smoothed share."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    if n == 0 or y.min() == y.max():
        return Ensemble((), (), float(np.log(share / (1 - share))))
    rng, z, found = np.random.default_rng(5), np.full(n, np.log(share / (1 - share))), {}
    names = list(x)
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(n) < 0.5)
        some = {k: x[k] for k in rng.permutation(names)[: max(3, len(names) // 2)]}
        if not len(rows):
            continue
        nodes: list[tuple[Rule, np.ndarray, float]] = []
        _tree(some, residual, rows, depth, (), nodes)
        spread = float(np.mean((y - residual) * (1 - (y - residual)))) + 1e-6
        inner = {path[:-1] for path, _, _ in nodes}
        for path, _, mean in nodes:
            found.setdefault(frozenset(path), path)
            if path not in inner:
                z += shrinkage * mean / spread * covered(path, x, n)
    rules = list(found.values())
    return _lasso(rules, np.stack([covered(r, x, n) for r in rules], axis=1).astype(float) if rules else np.zeros((n, 0)), y, penalty, rounds)


def _largest(held: np.ndarray, rounds: int = 30) -> float:
    """About the largest eigenvalue of held' held."""
    v = np.ones(held.shape[1])
    size = 0.0
    for _ in range(rounds if held.size else 0):
        v = held.T @ (held @ (v / (np.linalg.norm(v) or 1.0)))
        size = float(np.linalg.norm(v))
    return size


def _lasso(rules: list[Rule], held: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> Ensemble:
    """Logistic regression with an L1 penalty, by accelerated proximal steps; the bias is free."""
    n, k = held.shape
    # Rows which the same rules hold for are one row with a weight.
    packed = np.packbits(held.astype(bool), axis=1)
    _, first, same = np.unique(packed, axis=0, return_index=True, return_inverse=True)
    held, many = held[first], np.bincount(same.ravel(), minlength=len(first)).astype(float)
    good = np.bincount(same.ravel(), weights=y, minlength=len(first))
    w, b = np.zeros(k), 0.0
    v, c, t = w, b, 1.0
    step = 4 * n / (1.05 * _largest(held * np.sqrt(many)[:, None]) + n)
    for _ in range(rounds):
        wrong = many / (1 + np.exp(-(held @ v + c))) - good
        new = v - step * (held.T @ wrong) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        bias = c - step * wrong.sum() / n
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new + (before - 1) / t * (new - w), bias + (before - 1) / t * (bias - b)
        w, b = new, bias
    kept = np.flatnonzero(w)
    return Ensemble(tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept), float(b))
