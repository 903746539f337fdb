"""A small random forest: fitted with numpy on a bounded sample, applied as a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    share: float


@dataclass(frozen=True)
class Split:
    feature: int
    at: float
    low: Leaf | Split
    high: Leaf | Split


def _impurity(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    share = ones / np.maximum(n, 1)
    return n * share * (1 - share)


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> Leaf | Split:
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return Leaf(round(share, 6))
    best = None
    for f in rng.permutation(x.shape[1])[: max(1, round(x.shape[1] ** 0.5))]:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        cost = _impurity(ones, n) + _impurity(ones[-1] - ones, len(y) - n)
        ok = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= least) & (len(y) - n[:-1] >= least))
        if len(ok):
            k = ok[cost[ok].argmin()]
            if best is None or cost[k] < best[0]:
                best = (cost[k], int(f), float((v[k] + v[k + 1]) / 2))
    if best is None:
        return Leaf(round(share, 6))
    low = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], _grow(x[low], y[low], rng, depth - 1, least), _grow(x[~low], y[~low], rng, depth - 1, least))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, least: int = 5, seed: int = 11) -> list[Leaf | Split]:
    """Bootstrap samples, a random square root of the features at every split, Gini impurity."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        of = rng.integers(0, len(y), len(y))
        out.append(_grow(x[of], y[of], rng, depth, least))
    return out


def predict(trees: list[Leaf | Split], x: np.ndarray) -> np.ndarray:
    def one(node: Leaf | Split, row: np.ndarray) -> float:
        while isinstance(node, Split):
            node = node.low if row[node.feature] <= node.at else node.high
        return node.share

    return np.array([sum(one(t, row) for t in trees) / len(trees) for row in x])


def column(trees: list[Leaf | Split], features: list[Column]) -> Column:
    """The forest's mean share as nested CASE expressions over the feature columns."""

    def one(node: Leaf | Split) -> Column:
        if isinstance(node, Leaf):
            return F.lit(node.share)
        return F.when(features[node.feature] <= node.at, one(node.low)).otherwise(one(node.high))

    total = one(trees[0])
    for tree in trees[1:]:
        total = total + one(tree)
    return total / len(trees)
