"""What the trained operators share: bounded labelled samples and logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(labels: DataFrame, label: str, train, most: int, doc: str = "doc_id") -> tuple[DataFrame, dict[int, float]]:
    """doc_id, label: at most ``most`` labelled rows of each class (0 and 1), the first by a hash of the id; and how many rows each stands for.

    ``train``: a condition on doc_id; rows for which it is not true are never used.
    A document that is labelled more than once counts as 1 if any label is 1.
    """
    spark = labels.sparkSession
    every = (
        labels.select(F.col(doc).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .where(train)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    counts = dict(every.groupBy("label").count().collect())
    rows = [r for c in (0, 1) for r in every.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    stands = {c: counts.get(c, 0) / max(1, min(most, counts.get(c, 0))) for c in (0, 1)}
    return spark.createDataFrame(rows, every.schema), stands


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Logistic:
    """Logistic regression with a ridge, on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30) -> None:
        weight = np.ones(len(y)) if weight is None else weight
        self.mean, self.scale, self.ridge = x.mean(axis=0), x.std(axis=0) + 1e-9, ridge
        self.beta = np.zeros(x.shape[1] + 1)
        for _ in range(steps):
            if self.step(*self.sums(x, y, weight)) < 1e-6:
                break

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the weighted log-likelihood."""
        z = self.standard(x)
        p = sigmoid(z @ self.beta)
        return z.T @ (weight * (y - p)), (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z

    def step(self, gradient: np.ndarray, curve: np.ndarray) -> float:
        """A Newton step with the ridge; gives its greatest move."""
        penalty = np.full(len(self.beta), self.ridge)
        penalty[-1] = 1e-6
        move = np.linalg.solve(curve + np.diag(penalty), gradient - penalty * self.beta)
        self.beta = self.beta + np.clip(move, -4, 4)
        return float(np.abs(move).max())

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.beta[:-1] + self.beta[-1]
