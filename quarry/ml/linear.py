"""Linear models: least squares, logistic and generalised regression, mini-batch descent, p-values."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of polynomial approximations of the logistic function.
SERIES = {1: 1 / 4, 3: -1 / 48, 5: 1 / 480}
FITTED = (5.00052959e-01, 2.35176260e-01, -3.97212202e-05, -1.23407424e-02, 4.04588962e-06, 3.94330487e-04, -9.74060972e-08, -4.74674505e-06)


def sigmoid(x: Column, kind: str = "real") -> Column:
    """The logistic function: real, t1, t3, t5 (series, kept within 0 and 1), seg3, df, sr or mix."""
    if kind in ("t1", "t3", "t5"):
        value = F.lit(0.5)
        for k, c in SERIES.items():
            if k <= int(kind[1]):
                value = value + c * F.pow(x, F.lit(float(k)))
        return F.when(value < 0, 0.0).when(value > 1, 1.0).otherwise(value)
    root = 0.5 * (x / F.sqrt(1 + x * x)) + 0.5
    if kind == "mix":
        fitted = F.lit(0.0)
        for c in reversed(FITTED):
            fitted = fitted * x + c
        return F.when(F.abs(x) > 4, root).otherwise(fitted)
    return {"real": lambda: 1 / (1 + F.exp(-x)), "seg3": lambda: F.when(x < -4, 0.0).when(x > 4, 1.0).otherwise(0.5 + x * 0.125), "df": lambda: 0.5 * (x / (1 + F.abs(x))) + 0.5, "sr": lambda: root}[kind]()


class Linear:
    """Weights, intercept and inverse link; ``predict`` is a column expression."""

    def __init__(self, features: list[str], weights: list[float], intercept: float, link: str = "identity", sig: str = "real", offset: str | None = None):
        self.features, self.weights, self.intercept, self.link, self.sig, self.offset = list(features), list(map(float, weights)), float(intercept), link, sig, offset

    def score(self) -> Column:
        out = F.lit(self.intercept) if self.offset is None else self.intercept + F.col(self.offset)
        for c, w in zip(self.features, self.weights):
            out = out + w * F.col(c)
        return out

    def predict(self) -> Column:
        z = self.score()
        return {"identity": lambda: z, "logit": lambda: sigmoid(z, self.sig), "log": lambda: F.exp(z), "inverse": lambda: 1 / z}[self.link]()

    def to_json(self) -> str:
        return json.dumps(vars(self))

    @staticmethod
    def from_json(text: str) -> Linear:
        return Linear(**json.loads(text))


def normal_equations(df: DataFrame, features: list[str], label: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X and X'y with a column of ones at the end, and the number of rows: one pass of sums."""
    w = F.lit(1.0) if weight is None else weight
    columns = [F.col(c).cast("double") for c in features] + [F.lit(1.0)]
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*(F.sum(columns[i] * columns[j] * w).alias(f"a{i}_{j}") for i, j in pairs), *(F.sum(c * F.col(label) * w).alias(f"b{i}") for i, c in enumerate(columns)), F.count(F.lit(1)).alias("n")).first()
    a = np.zeros((k, k))
    for i, j in pairs:
        a[i, j] = a[j, i] = row[f"a{i}_{j}"]
    return a, np.array([row[f"b{i}"] for i in range(k)], float), row["n"]


def least_squares(df: DataFrame, features: list[str], label: str, l2: float = 0.0) -> Linear:
    a, b, n = normal_equations(df, features, label)
    w = np.linalg.pinv(a + l2 * np.diag([1.0] * len(features) + [0.0])) @ b
    return Linear(features, w[:-1], w[-1])


def descent(df: DataFrame, features: list[str], label: str, kind: str = "logistic", epochs: int = 20, learning_rate: float = 0.1, batches: int = 1, l2: float = 0.0, sig: str = "real", decay: float = 1.0, eps: float = 0.0, seed: int = 0) -> Linear:
    """Mini-batch gradient descent: each step is one aggregate over the rows whose hash falls in its batch.

    It stops early if all weights move by at most ``eps`` in an epoch; the rate falls by ``decay`` each epoch.
    """
    model = Linear(features, [0.0] * len(features), 0.0, "logit" if kind == "logistic" else "identity", sig)
    rows = df.select(*features, label).withColumn("_batch", F.floor(F.rand(seed) * batches)).persist()
    for epoch in range(epochs):
        before = np.array([*model.weights, model.intercept])
        for b in range(batches):
            e = model.predict() - F.col(label)
            part = rows.filter(F.col("_batch") == b) if batches > 1 else rows
            g = part.agg(F.count(F.lit(1)).alias("n"), *(F.avg(e * F.col(c)) for c in features), F.avg(e)).first()
            if g["n"]:
                rate = learning_rate * decay**epoch
                model.weights = [w - rate * (d + l2 * w) for w, d in zip(model.weights, g[1:-1])]
                model.intercept -= rate * g[-1]
        if np.abs(before - np.array([*model.weights, model.intercept])).max() <= eps:
            break
    rows.unpersist()
    return model


def glm(df: DataFrame, features: list[str], label: str, family: str = "binomial", link: str | None = None, weight: str | None = None, offset: str | None = None, power: float = 1.5, l2: float = 0.0, max_iter: int = 25) -> Linear:
    """Iterated reweighted least squares for binomial, poisson, gamma, gaussian or tweedie labels."""
    rows = VectorAssembler(inputCols=features, outputCol="_features").transform(df)
    tool = GeneralizedLinearRegression(featuresCol="_features", labelCol=label, family=family, regParam=l2, maxIter=max_iter)
    if family == "tweedie":
        tool = tool.setVariancePower(power).setLinkPower({"identity": 1.0, "inverse": -1.0}.get(link or "log", 0.0))
    elif link:
        tool = tool.setLink(link)
    tool = tool.setWeightCol(weight) if weight else tool
    tool = tool.setOffsetCol(offset) if offset else tool
    m = tool.fit(rows)
    name = link or {"binomial": "logit", "poisson": "log", "gamma": "inverse", "gaussian": "identity", "tweedie": "log"}[family]
    return Linear(features, m.coefficients.toArray(), m.intercept, name, offset=offset)



def logistic(df: DataFrame, features: list[str], label: str, l2: float = 0.0, max_iter: int = 25, tol: float = 1e-9) -> Linear:
    """Newton's method; each step is one aggregate of the gradient and the k x k Hessian."""
    model = Linear(features, [0.0] * len(features), 0.0, "logit")
    for _ in range(max_iter):
        p = model.predict()
        a, _, n = normal_equations(df, features, label, p * (1 - p))
        e = F.col(label) - p
        g = np.array(df.agg(*(F.sum(e * F.col(c)) for c in features), F.sum(e)).first(), float)
        ridge = l2 * n * np.diag([1.0] * len(features) + [0.0])
        w = np.array([*model.weights, model.intercept])
        step = np.linalg.pinv(a + ridge) @ (g - ridge @ w)
        w = w + step
        model.weights, model.intercept = w[:-1].tolist(), float(w[-1])
        if np.abs(step).max() < tol:
            break
    return model


def deviance(df: DataFrame, label: str, prediction: Column, family: str, power: float = 1.5, weight: Column | None = None) -> Column:
    """The aggregate that sums up the family's deviance."""
    y, m, w = F.col(label).cast("double"), prediction, F.lit(1.0) if weight is None else weight
    safe = lambda v: F.ln(F.when(v > 0, v).otherwise(F.lit(1.0)))
    one = {
        "gaussian": lambda: (y - m) * (y - m), "poisson": lambda: 2 * (y * (safe(y) - safe(m)) - (y - m)), "gamma": lambda: 2 * (-(safe(y) - safe(m)) + (y - m) / m),
        "binomial": lambda: -2 * (y * safe(m) + (1 - y) * safe(1 - m)),
        "tweedie": lambda: 2 * (F.pow(y, F.lit(2 - power)) / ((1 - power) * (2 - power)) - y * F.pow(m, F.lit(1 - power)) / (1 - power) + F.pow(m, F.lit(2 - power)) / (2 - power)),
    }
    return F.sum(w * one[family]())


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + top * d), 1 + top / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_tail(t: float, df: float) -> float:
    """Probability that Student's t is further from 0 than t."""
    return _beta_tail(df / 2, 0.5, df / (df + t * t))


def t_test(df: DataFrame, features: list[str], label: str, model: Linear) -> list[float]:
    """p-values of the weights and the intercept of a linear model; variance by n - k + 1 and the t of n - k - 1, k with the intercept."""
    a, _, n = normal_equations(df, features, label)
    k = len(features) + 1
    if n <= k + 1:
        raise ValueError("too few rows")
    e = model.predict() - F.col(label)
    sigma = df.agg(F.sum(e * e)).first()[0] / (n - k + 1)
    spread = np.diag(np.linalg.pinv(a)) * sigma
    return [t_tail(math.sqrt(max(0.0, w * w / s)), n - k - 1) for w, s in zip([*model.weights, model.intercept], spread)]


def wald_test(df: DataFrame, features: list[str], label: str, model: Linear, family: str = "binomial", power: float = 1.5, weight: Column | None = None) -> list[float]:
    """p-values of a generalised model by the normal distribution, from the Hessian at its weights."""
    m = model.predict()
    variance: dict[str, Callable[[], Column]] = {"binomial": lambda: m * (1 - m), "poisson": lambda: m, "gamma": lambda: m * m, "gaussian": lambda: F.lit(1.0), "tweedie": lambda: F.pow(m, F.lit(power))}
    slope = {"logit": lambda: 1 / (m * (1 - m)), "log": lambda: 1 / m, "inverse": lambda: -1 / (m * m), "identity": lambda: F.lit(1.0)}[model.link]()
    v, scale, k = variance[family](), 1.0, len(features) + 1
    if family in ("gamma", "tweedie"):
        e = F.col(label) - m
        rss, n = df.agg(F.sum(e * e / v), F.count(F.lit(1))).first()
        scale = rss / (n - k - 1)
    w = 1 / (scale * v * slope * slope)
    h, _, n = normal_equations(df, features, label, w if weight is None else w * weight)
    if n <= k + 1:
        raise ValueError("too few rows")
    spread = np.diag(np.linalg.pinv(h))
    return [math.erfc(math.sqrt(max(0.0, x * x / s) / 2)) for x, s in zip([*model.weights, model.intercept], spread)]
