"""Clusters, neighbours, naive Bayes and Gaussian processes."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Training rows that are sent to every task at once; more are taken in blocks of this size.
BLOCK_ROWS = 50_000
#: Rows of a Gaussian process, whose cost grows with their third power.
PROCESS_ROWS = 2_000


def kmeans(df: DataFrame, features: list[str], k: int, max_iter: int = 20, n_init: int = 1, init: str = "k-means||", seed: int = 0) -> list[list[float]]:
    """The centres of the best of ``n_init`` runs."""
    rows = VectorAssembler(inputCols=features, outputCol="_features").transform(df.select(*features)).select("_features").persist()
    best = None
    for i in range(n_init):
        m = KMeans(k=k, maxIter=max_iter, initMode=init, seed=seed + i, featuresCol="_features").fit(rows)
        if best is None or m.summary.trainingCost < best[0]:
            best = (m.summary.trainingCost, [c.tolist() for c in m.clusterCenters()])
    rows.unpersist()
    return best[1]


def nearest_centre(features: list[str], centres: list[list[float]]) -> Column:
    """The number of the nearest centre, the first on ties."""
    distances = [sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(features, centre)), F.lit(0.0)) for centre in centres]
    return (F.array_position(F.array(*distances), F.array_min(F.array(*distances))) - 1).cast("int")


def knn(queries: DataFrame, train: DataFrame, features: list[str], label: str, key: str, k: int = 5, weights: str = "uniform") -> DataFrame:
    """(key, prediction): the vote of the k nearest training rows, by distance or all alike; smaller labels win ties.

    The training rows are dealt into blocks of about BLOCK_ROWS by a hash. Each task compares its
    queries with one block after another and keeps k candidates, so nothing grows with both sides.
    """
    n = train.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    schema = f"{key} {queries.schema[key].dataType.simpleString()}, label {train.schema[label].dataType.simpleString()}, distance double"
    number = F.pmod(F.xxhash64(*features, label), F.lit(blocks))
    near = None
    for b in range(blocks):
        part = (train if blocks == 1 else train.filter(number == b)).select(*features, label).toPandas()
        sent = queries.sparkSession.sparkContext.broadcast((part[features].to_numpy(float), part[label].to_numpy()))

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            x, y = sent.value
            squares = (x * x).sum(1)
            for frame in frames:
                for at in range(0, len(frame), 256):
                    some = frame.iloc[at : at + 256]
                    q = some[features].to_numpy(float)
                    d = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + squares, 0))
                    take = np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k] if d.shape[1] else np.zeros((len(q), 0), int)
                    yield pd.DataFrame({key: np.repeat(some[key].to_numpy(), take.shape[1]), "label": y[take].ravel(), "distance": np.take_along_axis(d, take, 1).ravel()})

        found = queries.select(key, *features).mapInPandas(run, schema)
        near = found if near is None else near.unionAll(found)
    if blocks > 1:
        near = near.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("distance", "label"))).filter(F.col("_r") <= k)
    weight = F.lit(1.0) if weights == "uniform" else F.when(F.col("distance") > 0, 1 / F.when(F.col("distance") > 0, F.col("distance"))).otherwise(F.lit(1e12))
    votes = near.groupBy(key, "label").agg(F.sum(weight).alias("v"))
    return votes.groupBy(key).agg(F.min_by("label", F.struct(-F.col("v"), F.col("label"))).alias("prediction"))


class NaiveBayes:
    """Gaussian: mean and population variance by class, plus ``smoothing`` times the largest variance."""

    def __init__(self, features: list[str], classes: list, priors: list[float], means: list, variances: list):
        self.features, self.classes, self.priors, self.means, self.variances = features, classes, priors, means, variances

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], label: str, smoothing: float = 1e-9) -> NaiveBayes:
        rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *(F.avg(c).alias(f"m_{c}") for c in features), *(F.var_pop(c).alias(f"v_{c}") for c in features)).orderBy(label).collect()
        extra = smoothing * max(df.agg(*(F.var_pop(c) for c in features)).first())
        n = sum(r["_n"] for r in rows)
        return cls(list(features), [r[label] for r in rows], [r["_n"] / n for r in rows], [[r[f"m_{c}"] for c in features] for r in rows], [[r[f"v_{c}"] + extra for c in features] for r in rows])

    def scores(self) -> list[Column]:
        out = []
        for prior, means, variances in zip(self.priors, self.means, self.variances):
            s = F.lit(math.log(prior))
            for c, m, v in zip(self.features, means, variances):
                s = s - 0.5 * math.log(2 * math.pi * v) - (F.col(c) - m) * (F.col(c) - m) / (2 * v)
            out.append(s)
        return out

    def predict(self) -> Column:
        s = F.array(*self.scores())
        return F.element_at(F.array(*(F.lit(c) for c in self.classes)), F.array_position(s, F.array_max(s)).cast("int"))

    def to_json(self) -> str:
        return json.dumps(vars(self))


class GaussianProcess:
    """One against the rest by Laplace's approximation, with a radial kernel of length 1; at most PROCESS_ROWS training rows."""

    def __init__(self, x: np.ndarray, classes: list, pulls: list[np.ndarray]):
        self.x, self.classes, self.pulls = x, classes, pulls

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], label: str, max_iter: int = 20) -> GaussianProcess:
        rows = df.select(*features, label).limit(PROCESS_ROWS + 1).toPandas()
        if len(rows) > PROCESS_ROWS:
            raise ValueError(f"over {PROCESS_ROWS} rows")
        x, y = rows[features].to_numpy(float), rows[label].to_numpy()
        kernel = cls._kernel(x, x)
        pulls = []
        for c in sorted(set(y.tolist())):
            t, f = (y == c).astype(float), np.zeros(len(x))
            for _ in range(max_iter):
                p = 1 / (1 + np.exp(-f))
                w = p * (1 - p)
                root = np.sqrt(w)
                inner = np.eye(len(x)) + root[:, None] * kernel * root
                b = w * f + t - p
                a = b - root * np.linalg.solve(inner, root * (kernel @ b))
                step = kernel @ a - f
                f = f + step
                if np.abs(step).max() < 1e-8:
                    break
            pulls.append(t - 1 / (1 + np.exp(-f)))
        return cls(x, sorted(set(y.tolist())), pulls)

    @staticmethod
    def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-0.5 * np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0))

    def predict(self, df: DataFrame, features: list[str], name: str = "prediction") -> DataFrame:
        x, classes, pulls, kernel = self.x, self.classes, np.array(self.pulls), self._kernel

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(**{name: np.array(classes)[(pulls @ kernel(x, f[features].to_numpy(float))).argmax(0)]})

        kind = "long" if all(isinstance(c, int) for c in classes) else "double" if all(isinstance(c, (int, float)) for c in classes) else "string"
        return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"{name} {kind}"]))
