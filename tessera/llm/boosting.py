"""Gradient-boosted trees on small bounded samples, and their evaluation as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A split (rows with feature <= cut go left) or, without sides, a leaf."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int) -> Node:
    score = lambda a, b: a * a / (b + 1.0)
    leaf = Node(value=float(g.sum() / (h.sum() + 1.0)))
    if depth == 0 or len(g) < 2 * least:
        return leaf
    best, where = 1e-6, None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        ends = np.flatnonzero(values[1:] != values[:-1])
        ends = ends[(ends + 1 >= least) & (len(g) - ends - 1 >= least)]
        if len(ends):
            gain = score(gs[ends], hs[ends]) + score(gs[-1] - gs[ends], hs[-1] - hs[ends]) - score(gs[-1], hs[-1])
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, where = float(gain[k]), (f, float((values[ends[k]] + values[ends[k] + 1]) / 2))
    if where is None:
        return leaf
    f, cut = where
    low = x[:, f] <= cut
    return Node(feature=f, cut=cut, left=_grow(x[low], g[low], h[low], depth - 1, least), right=_grow(x[~low], g[~low], h[~low], depth - 1, least))


def _value(node: Node, x: np.ndarray) -> np.ndarray:
    if node.left is None or node.right is None:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _value(node.left, x), _value(node.right, x))


@dataclass(frozen=True)
class Boosted:
    """Sum of trees; the logistic function of it is a probability."""

    base: float
    rate: float
    trees: tuple[Node, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((_value(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def column(self, feature: Callable[[int], Column]) -> Column:
        """The margin as an expression over feature columns."""

        def of(node: Node) -> Column:
            if node.left is None or node.right is None:
                return F.lit(node.value)
            return F.when(feature(node.feature) <= node.cut, of(node.left)).otherwise(of(node.right))

        out = F.lit(self.base)
        for t in self.trees:
            out = out + self.rate * of(t)
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4, least: int = 8) -> Boosted:
    """Logistic boosting with second-order leaf values."""
    share = min(max(float(y.mean()), 0.01), 0.99)
    base, grown = float(np.log(share / (1 - share))), []
    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), depth, least)
        grown.append(tree)
        margin += rate * _value(tree, x)
    return Boosted(base, rate, tuple(grown))


def least_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability from which on the share of true cases is at least ``precision``; 1 beyond all if none."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.append(p[order][1:] != p[order][:-1], True)
    good = np.flatnonzero(ends & (hits >= precision))
    return float(p[order][good[-1]]) if len(good) else 1.01
