"""Second-order boosted trees over histograms.

Each level of a tree is one aggregate: gradients summed by node, feature and bucket. What reaches the
driver is at most nodes x features x buckets rows. Trees become column expressions.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut
from ..plans.quantiles import quantiles

# Names, ranges and options of the parameters.
RANGES = {
    "rounds": (1, 1024), "max_depth": (1, 16), "learning_rate": (0.0, 1.0), "reg_lambda": (0.0, 10000.0), "gamma": (0.0, 10000.0), "row_sample": (0.0, 1.0), "column_sample": (0.0, 1.0),
    "sketch_eps": (0.0, 1.0), "top_rate": (0.0, 1.0), "bottom_rate": (0.0, 1.0), "max_leaf": (1, 2**15), "tweedie_power": (1.0, 2.0), "stopping_rounds": (1, 1024),
}
OBJECTIVES = ("linear", "logistic", "tweedie")


def gradients(y: Column, score: Column, objective: str, power: float) -> tuple[Column, Column]:
    if objective == "linear":
        return score - y, F.lit(1.0)
    if objective == "logistic":
        p = 1 / (1 + F.exp(-score))
        return p - y, p * (1 - p)
    a, b = F.exp((1 - power) * score), F.exp((2 - power) * score)
    return -y * a + b, -y * (1 - power) * a + (2 - power) * b


class Boosted:
    """Trees as nested lists: [feature, split, left, right] or a leaf's weight; x <= split goes left, null and NaN go right."""

    def __init__(self, base: float, trees: list, objective: str, gains: dict[str, list] | None = None, history: list | None = None):
        self.base, self.trees, self.objective, self.gains, self.history = base, trees, objective, gains or {}, history or []

    def score(self) -> Column:
        out = F.lit(float(self.base))
        for t in self.trees:
            out = out + self.tree(t)
        return out

    def predict(self) -> Column:
        z = self.score()
        return {"linear": z, "logistic": 1 / (1 + F.exp(-z)), "tweedie": F.exp(z)}[self.objective]

    def tree(self, t) -> Column:
        if not isinstance(t, list):
            return F.lit(float(t))
        x = F.col(t[0]).cast("double")
        return F.when((x <= t[1]) & ~F.isnan(x), self.tree(t[2])).otherwise(self.tree(t[3]))

    def importances(self) -> dict[str, dict[str, float]]:
        """Splits, total gain and mean gain of each feature."""
        return {f: {"weight": len(g), "total_gain": sum(g), "gain": sum(g) / len(g)} for f, g in self.gains.items()}

    def to_json(self) -> str:
        return json.dumps(vars(self))

    @staticmethod
    def from_json(text: str) -> Boosted:
        return Boosted(**json.loads(text))


def _check(params: dict) -> None:
    for k, v in params.items():
        low, high = RANGES[k]
        if not low <= v <= high:
            raise ValueError(f"{k} must be within {low} and {high}")


def train(
    df: DataFrame, features: list[str], label: str, objective: str = "logistic", rounds: int = 10, max_depth: int = 5, learning_rate: float = 0.3, reg_lambda: float = 0.1, gamma: float = 0.0, row_sample: float = 1.0,
    column_sample: float = 1.0, sketch_eps: float = 0.1, base_score: float = 0.0, seed: int = 42, goss: bool = False, top_rate: float = 0.3, bottom_rate: float = 0.5, grow: str = "level", max_leaf: int = 15,
    tweedie_power: float = 1.5, validation: float = 0.0, stopping_rounds: int = 1, stopping_tolerance: float = 0.0, start: Boosted | None = None,
) -> Boosted:
    """Gain GL^2 / (HL + l) + GR^2 / (HR + l) - G^2 / (H + l), split if above ``gamma``; leaf -rate G / (H + l), 0 if H is 0.

    ``grow``: by level to ``max_depth``, or the best leaf first to ``max_leaf`` leaves. ``goss`` keeps
    the top_rate share of largest gradients and draws bottom_rate of the others, weighted up.
    ``validation`` holds rows out and stops when their loss has not fallen for ``stopping_rounds``.
    ``start`` goes on from a stored model.
    """
    _check({"rounds": rounds, "max_depth": max_depth, "learning_rate": learning_rate, "reg_lambda": reg_lambda, "gamma": gamma, "row_sample": row_sample, "column_sample": column_sample, "sketch_eps": sketch_eps, "top_rate": top_rate, "bottom_rate": bottom_rate, "max_leaf": max_leaf, "tweedie_power": tweedie_power, "stopping_rounds": stopping_rounds})
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective {objective}")
    buckets = max(2, math.ceil(1 / sketch_eps))
    model = start or Boosted(base_score, [], objective)
    clean = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    found = quantiles(df, {f: clean(f) for f in features}, [i / buckets for i in range(1, buckets)])
    splits = {f: sorted({x for x in found[f] if x is not None}) for f in features}

    def bucket(f: str) -> Column:
        x = clean(f)
        out = F.lit(len(splits[f]))
        for i, v in reversed(list(enumerate(splits[f]))):
            out = F.when(x <= v, F.lit(i)).otherwise(out)
        return out.cast("short")

    rows = df.select(F.col(label).cast("double").alias("_y"), model.score().alias("_s"), F.rand(seed).alias("_v"), *(bucket(f).alias(f"_b{i}") for i, f in enumerate(features)))
    rows = cut(rows.filter("_y IS NOT NULL"), "boost")
    rng, best, since = np.random.default_rng(seed), math.inf, 0
    for round_ in range(rounds):
        chosen = sorted(rng.choice(len(features), max(1, math.ceil(len(features) * column_sample)), replace=False))
        g, h = gradients(F.col("_y"), F.col("_s"), objective, tweedie_power)
        data = rows.filter(F.col("_v") >= validation).select(g.alias("_g"), h.alias("_h"), *(f"_b{i}" for i in chosen))
        if row_sample < 1:
            data = data.filter(F.rand(seed + round_ + 1) < row_sample)
        if goss:
            limit = data.agg(F.percentile_approx(F.abs("_g"), 1 - top_rate, 10000)).first()[0]
            large = F.abs("_g") >= limit
            up = F.when(large, 1.0).otherwise((1 - top_rate) / max(bottom_rate, 1e-9))
            data = data.filter(large | (F.rand(seed - round_ - 1) < bottom_rate)).withColumns({"_g": F.col("_g") * up, "_h": F.col("_h") * up})
        data = data.persist()
        tree = _grow(data, features, chosen, splits, learning_rate, reg_lambda, gamma, max_depth, max_leaf if grow == "leaf" else None, model.gains)
        data.unpersist()
        model.trees.append(tree)
        rows = rows.withColumn("_s", F.col("_s") + _bucketed(tree, features, splits))
        if (round_ + 1) % 8 == 0:
            rows = cut(rows, "boost")
        if validation:
            y, s = F.col("_y"), F.col("_s")
            p = 1 / (1 + F.exp(-s))
            loss = {"linear": (y - s) * (y - s), "logistic": -(y * F.ln(F.greatest(p, F.lit(1e-15))) + (1 - y) * F.ln(F.greatest(1 - p, F.lit(1e-15)))), "tweedie": -y * F.exp((1 - tweedie_power) * s) / (1 - tweedie_power) + F.exp((2 - tweedie_power) * s) / (2 - tweedie_power)}[objective]
            now = rows.filter(F.col("_v") < validation).agg(F.avg(loss)).first()[0]
            model.history.append(now)
            best, since = (now, 0) if now < best - stopping_tolerance else (best, since + 1)
            if since >= stopping_rounds:
                del model.trees[len(model.trees) - since :]
                break
    return model


def _grow(data: DataFrame, features: list[str], chosen: list, splits: dict, rate: float, reg: float, gamma: float, depth: int, max_leaf: int | None, gains: dict):
    def weight(g: float, h: float) -> float:
        return 0.0 if h == 0 else -rate * g / (h + reg)

    def part(g: float, h: float) -> float:
        return 0.0 if h + reg == 0 else g * g / (h + reg)

    def best_splits(nodes: list[list]) -> list[tuple | None]:
        """For each node (its path of (feature number, bucket, left)) its sums and best split."""
        number = F.lit(None).cast("int")
        for k, path in enumerate(nodes):
            hit = F.lit(True)
            for i, b, left in path:
                hit = hit & ((F.col(f"_b{i}") <= b) if left else (F.col(f"_b{i}") > b))
            number = F.when(hit, F.lit(k)).otherwise(number)
        cells = F.explode(F.array(*(F.struct(F.lit(int(i)).alias("f"), F.col(f"_b{i}").alias("b")) for i in chosen)))
        sums = data.select(number.alias("node"), "_g", "_h", cells.alias("c")).filter("node IS NOT NULL").groupBy("node", "c.f", "c.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect()
        grid = {(k, int(i)): np.zeros((2, len(splits[features[i]]) + 1)) for k in range(len(nodes)) for i in chosen}
        for r in sums:
            grid[r["node"], r["f"]][:, r["b"]] += (r["g"], r["h"])
        out = []
        for k in range(len(nodes)):
            total = grid[k, int(chosen[0])].sum(1)
            best = None
            for i in chosen:
                left = np.cumsum(grid[k, int(i)], 1)[:, :-1]
                for b in range(left.shape[1]):
                    gl, hl = left[:, b]
                    if hl <= 0 or total[1] - hl <= 0:
                        continue
                    gain = part(gl, hl) + part(total[0] - gl, total[1] - hl) - part(*total)
                    if gain > gamma and (best is None or gain > best[0]):
                        best = (gain, int(i), b)
            out.append((total, best))
        return out

    root: dict = {"path": []}
    open_ = [root]
    root["total"], root["best"] = best_splits([[]])[0]
    leaves = 1
    while open_:
        ready = [n for n in open_ if n["best"] and len(n["path"]) < depth]
        if max_leaf is not None:
            ready = sorted(ready, key=lambda n: -n["best"][0])[:1] if leaves < max_leaf else []
        if not ready:
            break
        fresh = []
        for n in ready:
            gain, i, b = n["best"]
            gains.setdefault(features[i], []).append(float(gain))
            n["kids"] = [{"path": [*n["path"], (i, b, side)]} for side in (True, False)]
            fresh += n["kids"]
            leaves += 1
        for kid, (total, best) in zip(fresh, best_splits([k["path"] for k in fresh])):
            kid["total"], kid["best"] = total, best
        open_ = [n for n in open_ if n not in ready] + fresh

    def build(n: dict):
        if "kids" not in n:
            return weight(*map(float, n["total"]))
        _, i, b = n["best"]
        return [features[i], float(splits[features[i]][b]), build(n["kids"][0]), build(n["kids"][1])]

    return build(root)


def _bucketed(tree, features: list[str], splits: dict) -> Column:
    """A tree's weight from the bucket columns."""
    if not isinstance(tree, list):
        return F.lit(float(tree))
    i = features.index(tree[0])
    return F.when(F.col(f"_b{i}") <= splits[tree[0]].index(tree[1]), _bucketed(tree[2], features, splits)).otherwise(_bucketed(tree[3], features, splits))
