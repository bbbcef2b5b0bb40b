"""A fitted cell as one text: reducer, model, calibration.  It scores batches and streams alike."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventclock.operators import learners, models


@dataclass
class Bundle:
    """columns: features in order; steps: sorted scores and their probabilities, between which lie straight lines."""

    columns: list[str]
    projection: models.Projection
    model: object
    steps: tuple[np.ndarray, np.ndarray]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Rows of features to calibrated probabilities."""
        p = self.projection
        score = self.model.score((x - p.mean) / p.scale @ p.matrix)
        return np.interp(score, *self.steps) if len(self.steps[0]) else score

    def to_json(self) -> str:
        p = self.projection
        return json.dumps({"columns": self.columns, "mean": p.mean.tolist(), "scale": p.scale.tolist(), "matrix": p.matrix.tolist(), "model": learners.to_json(self.model), "scores": list(self.steps[0]), "probabilities": list(self.steps[1])})

    @classmethod
    def from_json(cls, text: str) -> Bundle:
        d = json.loads(text)
        projection = models.Projection(np.array(d["mean"]), np.array(d["scale"]), np.array(d["matrix"]))
        return cls(d["columns"], projection, learners.from_json(d["model"]), (np.array(d["scores"]), np.array(d["probabilities"])))

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows, of a batch or a stream, with ``p``; null where a feature is unknown."""

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            known = x.notna()
            out = pd.Series(np.nan, index=x.index)
            if known.any():
                m = np.array(x[known].tolist(), float)
                whole = np.isfinite(m).all(axis=1)
                p = np.full(len(m), np.nan)
                if whole.any():
                    p[whole] = self.probability(m[whole])
                out[known] = p
            return out

        p = probability(F.array(*[F.col(c).cast("double") for c in self.columns]))
        return rows.withColumn("p", F.when(~F.isnan(p), p))


def fit(rows: DataFrame, columns: list[str], reduce: str = "correlation", n: int = 20, model: str = "xgb", depth: int = 3) -> Bundle:
    """A bundle from masked rows (``models.masks``) with the columns as features; isotonic steps on VAL."""
    whole = models.assembled(rows, columns)
    projection = models.projection(whole.where("fits"), reduce, n)
    reduced = projection.apply(whole)
    fitted = models.fit(reduced, model, depth)
    if fitted is None:
        raise ValueError("TRAIN has one kind of label: nothing to fit")
    scored = models.scored(reduced, fitted).where("judges").groupBy("score").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("y").cast("double")).alias("y"))
    held = scored.orderBy("score").toPandas()  # a row for each different score of VAL
    steps = models.pool_adjacent(held["score"].to_numpy(), held["y"].to_numpy(), held["n"].to_numpy()) if len(held) else (np.empty(0), np.empty(0))
    return Bundle(list(columns), projection, fitted, steps)

