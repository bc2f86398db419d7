"""Gradient boosted trees for all rows of a table, and their scores.

Trees split between bins, so rows with the same bins and label count as one row with a
weight. These are stored; each level of a tree needs their sums by bin, a table of fixed
size that the tasks add up. While few different rows are left, one process does the same.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import settled, sigmoid

BINS = 64
#: Different binned rows that one process takes; more stay in their tasks, with the same sums.
LOCAL_ROWS = 1 << 16


class Trees:
    """Full trees of equal depth as flat arrays: split feature, threshold and the leaves' values."""

    def __init__(self, depth: int, start: float):
        self.depth, self.start = depth, start
        self.features: list[np.ndarray] = []
        self.thresholds: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for features, thresholds, leaves in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, features[at]] > thresholds[at])
            total += leaves[at - len(features)]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margins(x))


def _edges(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Candidate thresholds of a feature from its sorted values and their counts: between values if they are few, else quantiles."""
    if len(values) <= BINS:
        return (values[:-1] + values[1:]) / 2
    last = np.cumsum(counts)
    at = np.linspace(0, 1, BINS + 1)[1:-1] * (last[-1] - 1)
    low, high = (values[np.searchsorted(last, f(at), "right")] for f in (np.floor, np.ceil))
    return np.unique(low + (high - low) * (at - np.floor(at)))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)]).astype(np.uint8)


class _Rows:
    """Binned rows with labels and weights, and where the trees so far put them."""

    def __init__(self, binned: np.ndarray, y: np.ndarray, weight: np.ndarray, widths: np.ndarray, start: float):
        self.binned, self.y, self.weight = binned, y, weight
        self.bins = int(widths.sum())
        self.flat = binned + (np.cumsum(widths) - widths)
        self.rows = np.arange(len(y))
        self.margin, self.at = np.full(len(y), start), np.zeros(len(y), np.int64)

    def down(self, features: np.ndarray, cuts: np.ndarray) -> None:
        self.at = 2 * self.at + 1 + (self.binned[self.rows, features[self.at]] > cuts[self.at])

    def add(self, leaves: np.ndarray) -> None:
        self.margin += leaves[self.at - (len(leaves) - 1)]
        self.at[:] = 0

    def _slopes(self) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(self.margin)
        return (p - self.y) * self.weight, np.maximum(p * (1 - p), 1e-6) * self.weight

    def sums(self, level: int) -> np.ndarray:
        """Slopes and curvatures by node and bin."""
        place = ((self.at - (1 << level) + 1)[:, None] * self.bins + self.flat).ravel()
        size = (1 << level) * self.bins
        return np.array([np.bincount(place, np.repeat(v, self.binned.shape[1]), size) for v in self._slopes()])

    def leaf_sums(self, depth: int) -> np.ndarray:
        return np.array([np.bincount(self.at - (1 << depth) + 1, v, 1 << depth) for v in self._slopes()])


class _Here:
    """All rows in this process."""

    def __init__(self, rows: _Rows):
        self.rows = rows
        self.down, self.add, self.sums, self.leaf_sums = rows.down, rows.add, rows.sums, rows.leaf_sums


class _Spread:
    """Rows that stay in their tasks, which retrace the trees so far for each sum."""

    def __init__(self, table: DataFrame, make: Callable[[pd.DataFrame], _Rows]):
        self.table, self.make = table, make
        self.done: list[tuple] = []

    def down(self, features: np.ndarray, cuts: np.ndarray) -> None:
        self.done.append(("down", features.copy(), cuts.copy()))

    def add(self, leaves: np.ndarray) -> None:
        self.done.append(("add", leaves))

    def _sum(self, what: str, level: int) -> np.ndarray:
        make = self.make
        done = self.table.sparkSession.sparkContext.broadcast(self.done)

        def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = 0.0
            for frame in frames:
                rows = make(frame)
                for step, *values in done.value:
                    getattr(rows, step)(*values)
                total = total + getattr(rows, what)(level)
            if np.ndim(total):
                yield pd.DataFrame({"at": np.arange(total.shape[1]), "g": total[0], "h": total[1]})

        got = self.table.mapInPandas(summed, "at long, g double, h double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        done.unpersist()
        order = np.argsort(got["at"].to_numpy())
        return np.array([got[c].to_numpy()[order] for c in ("g", "h")])

    def sums(self, level: int) -> np.ndarray:
        return self._sum("sums", level)

    def leaf_sums(self, depth: int) -> np.ndarray:
        return self._sum("leaf_sums", depth)


def _grown(trees: Trees, rows: _Here | _Spread, edges: list[np.ndarray], rounds: int, rate: float, ridge: float, least: float) -> Trees:
    widths = np.array([len(e) + 1 for e in edges])
    shifts = np.concatenate([[0], np.cumsum(widths)])
    bins, depth = int(shifts[-1]), trees.depth
    # A bin's own feature, and whether a split may follow it.
    feature_of = np.repeat(np.arange(len(widths)), widths)
    splits = np.ones(bins, bool)
    splits[shifts[1:] - 1] = False
    inner = (1 << depth) - 1
    for _ in range(rounds):
        features, thresholds, cuts = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            sums = rows.sums(level).reshape(2, count, bins)
            gain = np.full((count, bins), -np.inf)
            for f in range(len(edges)):
                lo, hi = shifts[f], shifts[f + 1]
                g, h = (np.cumsum(s[:, lo:hi], axis=1) for s in sums)
                all_g, all_h = g[:, -1:], h[:, -1:]
                own = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain[:, lo:hi] = np.where((h >= least) & (all_h - h >= least), own, -np.inf)
            gain[:, ~splits] = -np.inf
            best = gain.argmax(axis=1)
            for node in range(count):
                if gain[node, best[node]] > 1e-9:
                    f = feature_of[best[node]]
                    features[first + node], cuts[first + node] = f, best[node] - shifts[f]
                    thresholds[first + node] = edges[f][cuts[first + node]]
            rows.down(features, cuts)
        g, h = rows.leaf_sums(depth)
        values = -rate * g / (h + ridge)
        rows.add(values)
        trees.features.append(features)
        trees.thresholds.append(thresholds)
        trees.leaves.append(values)
    return trees


def _started(positives: float, rows: float, depth: int) -> Trees:
    share = (positives + 0.5) / (rows + 1.0)
    return Trees(depth, float(np.log(share / (1 - share))))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Trees that lower the logistic loss step by step (second-order gains on histograms).

    A split needs ``least`` total curvature on both sides. Rows of one class, or none,
    give no trees but the constant.
    """
    trees = _started(y.sum(), len(y), depth)
    if len(y) == 0 or y.min() == y.max():
        return trees
    edges = [_edges(*np.unique(column, return_counts=True)) for column in x.T]
    widths = np.array([len(e) + 1 for e in edges])
    rows = _Here(_Rows(_binned(x, edges), y, np.ones(len(y)), widths, trees.start))
    return _grown(trees, rows, edges, rounds, rate, ridge, least)


def fit_table(
    rows: DataFrame, features: int, rounds: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: float = 2.0
) -> Trees:
    """``fit`` for every row of (x: ``features`` 32-bit floats as binary, y: 0 or 1, n: how often it stands there).

    The features must have a bounded number of different values, as counts up to a bound
    have: these are counted on the driver.
    """

    def unpacked(x: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(x), np.float32).reshape(-1, features).astype(float)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, n = unpacked(frame["x"]), frame["n"].to_numpy()
            for f, column in enumerate(x.T):
                values, which = np.unique(column, return_inverse=True)
                yield pd.DataFrame({"f": f, "value": values, "n": np.bincount(which, n).astype(np.int64)})

    totals = rows.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("y")).first()
    trees = _started(totals["y"] or 0, totals["n"] or 0, depth)
    if not totals["y"] or totals["y"] == totals["n"]:
        return trees
    held = rows.mapInPandas(counted, "f int, value double, n long").groupBy("f", "value").agg(F.sum("n").alias("n")).orderBy("f", "value").toPandas()
    edges = [_edges(own["value"].to_numpy(), own["n"].to_numpy()) for _, own in held.groupby("f")]
    widths = np.array([len(e) + 1 for e in edges])

    @F.pandas_udf("binary")
    def placed(x: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in _binned(unpacked(x), edges)], dtype=object)

    table = settled(rows.groupBy(placed("x").alias("b"), "y").agg(F.sum("n").alias("n")))

    def made(frame: pd.DataFrame) -> _Rows:
        binned = np.frombuffer(b"".join(frame["b"]), np.uint8).reshape(-1, features)
        return _Rows(binned, frame["y"].to_numpy(float), frame["n"].to_numpy(float), widths, trees.start)

    few = table.limit(LOCAL_ROWS + 1).count() <= LOCAL_ROWS
    return _grown(trees, _Here(made(table.orderBy("b", "y").toPandas())) if few else _Spread(table, made), edges, rounds, rate, ridge, least)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
