"""Training of the two linear heads (normal or not, drowsy or sleepy) by distributed Newton steps.

A step is one aggregation: tasks add up gradient and curvature of their batches in numpy,
Spark adds up the tasks, and the driver solves a system of the features' number. The rows
never leave their tasks, and each step reads them once. Weights of classes and label smoothing are those
of the two-stage loss; a ridge keeps the steps defined where classes are separable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fit:
    weights: np.ndarray
    bias: float
    steps: int
    loss: float


def step_sums(x: np.ndarray, y: np.ndarray, theta: np.ndarray, class_weights: tuple[float, float], smoothing: float) -> np.ndarray:
    """(loss, weight, gradient, curvature) of rows as one flat array; features come with a last column of ones."""
    one = np.hstack([x, np.ones((len(x), 1))])
    z = one @ theta
    p = 1.0 / (1.0 + np.exp(-z))
    w = np.where(y == 1, class_weights[1], class_weights[0])
    target = y * (1.0 - smoothing) + smoothing / 2.0
    loss = (w * (np.logaddexp(0.0, z) - target * z)).sum()
    gradient, curvature = one.T @ (w * (p - target)), (one * (w * p * (1.0 - p))[:, None]).T @ one
    return np.concatenate([[loss, w.sum()], gradient, curvature.ravel()])


def fit_head(rows: DataFrame, x: str, y: str, class_weights: tuple[float, float] = (1.0, 1.0), smoothing: float = 0.0, ridge: float = 1e-3, steps: int = 25, tolerance: float = 1e-10) -> Fit:
    """Weighted logistic regression of labels 0 and 1 on arrays of equal length.

    Rows with a null label or array are left out; missing and infinite values count as 0. No
    rows or only one class raise. Steps end when none of the weights moves by more than ``tolerance``.
    """
    used = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))
    seen = used.agg(F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi"), F.count_if(F.col("y") == 1).alias("ones"), F.count_if(F.col("y") == 0).alias("zeros"), F.count(F.lit(1)).alias("n")).first()
    if not seen.ones or not seen.zeros or seen.ones + seen.zeros < seen.n or seen.lo != seen.hi:
        raise ValueError(f"two classes, 0 and 1, of arrays of one length are needed: {seen.asDict()}")
    d = seen.lo

    def sums(theta: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + (d + 1) + (d + 1) ** 2)
            for b in batches:
                values = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
                total += step_sums(np.nan_to_num(values, posinf=0.0, neginf=0.0), b.column(1).to_numpy(), theta, class_weights, smoothing)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

        told = used.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(len(told))
        for r in told:
            out[r.i] = r.v
        return out

    theta, penalty = np.zeros(d + 1), np.r_[np.full(d, ridge), 0.0]
    for step in range(1, steps + 1):
        t = sums(theta)
        gradient = t[2 : d + 3] / t[1] + penalty * theta
        curvature = t[d + 3 :].reshape(d + 1, d + 1) / t[1] + np.diag(penalty)
        move = np.linalg.solve(curvature, gradient)
        theta = theta - move
        if np.abs(move).max() <= tolerance:
            break
    return Fit(theta[:d], float(theta[d]), step, float(t[0] / t[1] + (penalty * theta * theta).sum() / 2))


def fit_heads(rows: DataFrame, x: str, label: str, abnormal_weights: tuple[float, float] = (1.0, 1.0), stage_weights: tuple[float, float] = (1.0, 1.0), smoothing: float = 0.0, ridge: float = 1e-3) -> tuple[Fit, Fit]:
    """The head that tells normal from abnormal (labels 1 and 2), and the one that tells 1 from 2 among the abnormal."""
    abnormal = fit_head(rows.withColumn("__y", (F.col(label) > 0).cast("double")), x, "__y", abnormal_weights, smoothing, ridge)
    stage = fit_head(rows.where(F.col(label) > 0).withColumn("__y", (F.col(label) == 2).cast("double")), x, "__y", stage_weights, smoothing, ridge)
    return abnormal, stage
