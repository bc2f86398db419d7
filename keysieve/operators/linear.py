"""A linear model as a plain column expression, and its fit by Newton steps.

The fitted objective is the sum of class-weighted logistic losses plus half the squared
norm of the coefficients of standardised features. A Newton step needs the gradient and
the Gram matrix at the current coefficients: tasks form both over their rows, Spark adds
them up entry by entry, and the driver solves a system as large as the number of
features. The table is read once per step, about ten times in all, and nothing that
grows with it leaves the tasks.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fit ends when no coefficient moves further than this.
TOLERANCE = 1e-10
MOST_STEPS = 50


@dataclass(frozen=True)
class LinearModel:
    """Logistic model on standardised features; a feature without spread has scale 0 and no part."""

    feature_order: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def weights(self) -> tuple[list[float], float]:
        """Coefficients and intercept for features as they are: the scaling is folded in."""
        own = [c / s if s else 0.0 for c, s in zip(self.coefficients, self.scale)]
        return own, self.intercept - sum(w * m for w, m in zip(own, self.mean))

    def margin(self, columns: dict[str, Column]) -> Column:
        weights, start = self.weights()
        terms = (F.lit(w) * columns[n] for n, w in zip(self.feature_order, weights) if w)
        return reduce(lambda a, b: a + b, terms, F.lit(start))

    def probability(self, columns: dict[str, Column]) -> Column:
        """Probability of the positive class; ``columns`` are the encoded features by name."""
        return 1.0 / (1.0 + F.exp(-self.margin(columns)))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> LinearModel:
        own = json.loads(text)
        return cls(*(tuple(own[k]) for k in ("feature_order", "mean", "scale", "coefficients")), own["intercept"])


def _entries(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(size)


def _sums(rows: DataFrame, features: Sequence[str], mean: np.ndarray, scale: np.ndarray, weight: tuple[float, float], beta: np.ndarray):
    """Loss, gradient and Gram matrix over all rows, without the penalty; the intercept is the last entry."""
    size = len(features) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + size + size * (size + 1) // 2)
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(size - 1)] + [np.ones(len(batch))])
            x[:, :-1] = (x[:, :-1] - mean) * np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
            y = batch.column(0).to_numpy(zero_copy_only=False)
            w = np.where(y == 1, weight[1], weight[0])
            z = x @ beta
            p = 0.5 * (1 + np.tanh(z / 2))
            total[0] += (w * (np.logaddexp(0, z) - y * z)).sum()
            total[1 : 1 + size] += x.T @ (w * (p - y))
            total[1 + size :] += ((x * (w * p * (1 - p))[:, None]).T @ x)[_entries(size)]
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total)), pa.int32()), "value": pa.array(total)})

    parts = rows.select("y", *(F.col(f"`{f}`") for f in features)).mapInArrow(partial, "at int, value double")
    summed = parts.groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(1 + size + size * (size + 1) // 2)
    total[summed["at"].to_numpy()] = summed["value"].to_numpy()
    gram = np.zeros((size, size))
    gram[_entries(size)] = total[1 + size :]
    return total[0], total[1 : 1 + size], gram + np.triu(gram, 1).T


def fit_linear(rows: DataFrame, features: Sequence[str]) -> LinearModel:
    """Fit on a stored table of ``y`` (0 or 1) and one double column per feature; both classes must occur."""
    moments = rows.agg(
        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"),
        F.array(*(F.avg(f"`{f}`") for f in features)).alias("mean"), F.array(*(F.stddev_pop(f"`{f}`") for f in features)).alias("scale"),
    ).first()
    if not moments["n0"] or not moments["n1"]:
        raise ValueError("Training data must contain at least one positive and one negative example.")
    mean, scale = np.array(moments["mean"]), np.array(moments["scale"])
    n = moments["n0"] + moments["n1"]
    weight = (n / (2 * moments["n0"]), n / (2 * moments["n1"]))
    ridge = np.append(np.ones(len(features)), 0.0)
    beta, step, best = np.zeros(len(features) + 1), np.zeros(len(features) + 1), np.inf
    for _ in range(MOST_STEPS):
        loss, slope, gram = _sums(rows, features, mean, scale, weight, beta)
        loss += 0.5 * (ridge * beta**2).sum()
        if loss > best + 1e-9 * abs(best):
            # Too far: half the way back.
            step = step / 2
            beta = beta + step
            continue
        best = loss
        step = np.linalg.solve(gram + np.diag(ridge), slope + ridge * beta)
        beta = beta - step
        if np.abs(step).max() < TOLERANCE:
            break
    held = [float(b) if s else 0.0 for b, s in zip(beta, scale)]
    return LinearModel(tuple(features), tuple(mean.tolist()), tuple(scale.tolist()), tuple(held), float(beta[-1]))


# Functions travel to the executors whole, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
