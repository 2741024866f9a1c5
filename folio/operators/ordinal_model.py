"""An ordinal head over embeddings: k - 1 thresholds that share one direction, fitted by all rows and applied in batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType


@dataclass(frozen=True)
class OrdinalHead:
    """P(y > j) = logistic(x . weights + biases[j])."""

    weights: np.ndarray
    biases: np.ndarray

    def passed(self, x: np.ndarray) -> np.ndarray:
        """A row of k - 1 probabilities for each row of x."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] + self.biases, -40, 40)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float)


def _loss_and_gradient(head: OrdinalHead, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    p = head.passed(x)
    above = (y[:, None] > np.arange(1, len(head.biases) + 1)).astype(float)
    miss = p - above
    loss = -(above * np.log(np.maximum(p, 1e-12)) + (1 - above) * np.log(np.maximum(1 - p, 1e-12))).sum()
    hess = (p * (1 - p)).sum(axis=1)
    wide = np.column_stack([x, np.zeros((len(x), len(head.biases)))])
    grad = np.concatenate([x.T @ miss.sum(axis=1), miss.sum(axis=0)])
    d = x.shape[1]
    h = np.zeros((wide.shape[1], wide.shape[1]))
    h[:d, :d] = (x * hess[:, None]).T @ x
    h[:d, d:] = x.T @ (p * (1 - p))
    h[d:, :d] = h[:d, d:].T
    h[d:, d:] = np.diag((p * (1 - p)).sum(axis=0))
    return loss, grad, h


def fit_ordinal(rows: DataFrame, features: str, label: str, k: int = 5, ridge: float = 1.0, steps: int = 20, tol: float = 1e-8) -> OrdinalHead:
    """The head of greatest penalised likelihood for labels 1 to k, by Newton steps.

    Each step is one pass: a task sums loss, gradient and curvature of its rows, (d + k - 1) ** 2 numbers; the driver adds one
    such row a task. Rows without a label or features don't count; no rows are an error."""
    data = rows.where(F.col(label).between(1, k) & F.col(features).isNotNull()).select(F.col(features).alias("x"), F.col(label).cast("int").alias("y"))
    one = data.first()
    if one is None:
        raise ValueError("no labelled rows")
    d, m = len(one["x"]), k - 1
    theta = np.zeros(d + m)
    penalty = np.concatenate([np.full(d, ridge), np.full(m, 1e-6)])
    size, schema = d + m, "n long, loss double, gradient array<double>, curvature array<double>"

    def sums(head: OrdinalHead):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, loss, g, h = 0, 0.0, np.zeros(size), np.zeros((size, size))
            for batch in batches:
                if batch.num_rows:
                    a, b, c = _loss_and_gradient(head, _matrix(batch.column("x")), batch.column("y").to_numpy())
                    n, loss, g, h = n + batch.num_rows, loss + a, g + b, h + c
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([g.tolist()]), pa.array([h.ravel().tolist()])], names=["n", "loss", "gradient", "curvature"])

        found = data.mapInArrow(run, schema).collect()
        total = lambda i: np.sum([np.array(r[i], float) for r in found], axis=0)
        return float(total(1)), total(2), total(3).reshape(size, size)

    before = np.inf
    for _ in range(steps):
        loss, g, h = sums(OrdinalHead(theta[:d], theta[d:]))
        loss += 0.5 * float(penalty @ (theta * theta))
        if before - loss < tol * max(1.0, abs(loss)):
            break
        before = loss
        theta = theta - np.linalg.solve(h + np.diag(penalty), g + penalty * theta)
    return OrdinalHead(theta[:d], theta[d:])


def ordinal_scores(rows: DataFrame, head: OrdinalHead, features: str, probabilities: str = "passed", level: str = "level", mean: str = "mean") -> DataFrame:
    """rows with the probability of passing each threshold, the level that is decided and the mean; null features give nulls."""
    sent = rows.sparkSession.sparkContext.broadcast(head)  # as many numbers as an embedding has
    schema = StructType([*rows.schema.fields, StructField(probabilities, ArrayType(DoubleType())), StructField(level, IntegerType()), StructField(mean, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [i for i, x in enumerate(batch.column(features).to_pylist()) if x is not None]
            p: list = [None] * batch.num_rows
            if known:
                for i, row in zip(known, sent.value.passed(_matrix(batch.column(features).take(pa.array(known)))), strict=True):
                    p[i] = row
            columns = [pa.array([None if x is None else x.tolist() for x in p], pa.list_(pa.float64())), pa.array([None if x is None else int((x > 0.5).sum()) + 1 for x in p], pa.int32()), pa.array([None if x is None else float(1 + x.sum()) for x in p], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def filter_report(scored: DataFrame, score: str, label: str, threshold: float, keys: list[str] = ()) -> DataFrame:
    """By key: positives, how many a filter at the threshold keeps, its sensitivity with the lower bound of 95 % (Clopper-Pearson), and
    the share that it discards."""
    from ..functions.numeric import proportion_lower

    keep = F.col(score) >= threshold
    out = scored.groupBy(*keys).agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if((F.col(label) == 1) & keep).alias("kept"), F.avg((~keep).cast("int")).alias("discarded"))

    @F.pandas_udf(DoubleType())
    def lower(kept: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([proportion_lower(int(a), int(b)) if b else None for a, b in zip(kept, n, strict=True)], dtype="float64")

    return out.withColumns({"sensitivity": F.try_divide("kept", "positives"), "lower": lower(F.col("kept"), F.col("positives"))})
