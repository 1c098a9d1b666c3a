"""What the trained operators share: a bounded sample of labelled rows, and a logistic fit on few features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from statelake.llm.common import named, whole_text


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id is the empty text."""
    return F.crc32(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, limits: dict[str, dict[int, int]], id_col: str,
    text_col: str,
) -> tuple[DataFrame, dict[int, int]]:
    """Texts with their label and a role, at most `limits[role][label]` of each, and the usable rows by label.

    Roles share no id: a hash of the id deals two thirds to the first role and the rest to the second. Among the rows of a
    role those with the least hash are taken, so the sample is spread over all ids and is the same in every run. Ids with
    two labels count as 1; null ids and labels other than 0 and 1 are left out. Repeated ids bring one text.
    """
    number = F.xxhash64(F.lit(11), F.col("id"))
    given = labels.select(named(id_col).cast("long").alias("id"), named(label).cast("int").alias("label"), usable.alias("ok"))
    given = given.filter("ok and id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, second = limits
    given = given.withColumn("role", F.when(F.pmod(number, F.lit(3)) < 2, F.lit(first)).otherwise(F.lit(second)))
    sample = None
    for role, by_label in limits.items():
        for value, most in by_label.items():
            part = given.filter((F.col("role") == role) & (F.col("label") == value)).orderBy(
                F.xxhash64(F.lit(12), F.col("id")), "id"
            ).limit(most)
            sample = part if sample is None else sample.unionAll(part)
    # the sample is bounded by `limits`, so the documents are not shuffled for it
    texts = docs.select(named(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).join(
        F.broadcast(sample), "id"
    )
    return texts.groupBy("id", "label", "role").agg(F.min("text").alias("text")), counts


class Logistic:
    """Logistic regression by Newton steps, with standardised features and a weak ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
        x = np.asarray(x, float)
        self.mean = x.mean(0) if len(y) else np.zeros(x.shape[1])
        self.scale = x.std(0) + 1e-9 if len(y) else np.ones(x.shape[1])
        self.beta = np.zeros(x.shape[1] + 1)
        if not len(y):
            return
        # both classes get half a row more, so that a sample of one class has a fit as well
        z = np.vstack([self._design(x), np.eye(1, x.shape[1] + 1), np.eye(1, x.shape[1] + 1)])
        y, weight = np.append(y, [0, 1]).astype(float), np.append(weight, [0.5, 0.5])
        penalty = ridge * np.eye(z.shape[1])
        penalty[0, 0] = 1e-6
        for _ in range(60):
            p = self._sigmoid(z @ self.beta)
            grad = z.T @ (weight * (y - p)) - penalty @ self.beta
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, grad)
            self.beta += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / np.where(self.scale > 1e-8, self.scale, np.inf), -8, 8)
        return np.hstack([np.ones((len(x), 1)), z])

    @staticmethod
    def _sigmoid(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -35, 35)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._design(np.asarray(x, float).reshape(-1, len(self.mean))) @ self.beta)
