"""A small CART classifier in numpy, for tables of a few hundred labelled rows."""

from __future__ import annotations

import numpy as np


def train(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> list:
    """[feature, threshold, left, right] or a share of ones; rows go left where feature <= threshold. Ties: first split."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = (2 * share * (1 - share) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
        impurity = (n * 2 * a * (1 - a) + (len(y) - n) * 2 * b * (1 - b)) / len(y)
        impurity[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = 9
        k = int(impurity.argmin())
        if impurity[k] < best[0]:
            best = (float(impurity[k]), f, float((v[k] + v[k + 1]) / 2))
    if best[1] is None:
        return share
    left = x[:, best[1]] <= best[2]
    return [best[1], best[2], train(x[left], y[left], depth - 1, least), train(x[~left], y[~left], depth - 1, least)]


def predict(tree, row) -> float:
    while isinstance(tree, list):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree
