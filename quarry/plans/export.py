"""A stored inference: rules, a model and what follows it, as one JSON text that any table is run through."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ml.boost import Boosted
from ..ml.linear import Linear
from ..rules.base import Rule
from ..schema import columns_of, require

MODELS = {"linear": Linear, "boosted": Boosted}


def export(rules: list[Rule], model: Linear | Boosted, after: list[Rule] | None = None, prediction: str = "prediction", name: str = "model", description: str = "") -> str:
    """``rules`` come before the model, ``after`` (such as a score card on ``prediction``) follow it."""
    kind = next(k for k, c in MODELS.items() if isinstance(model, c))
    return json.dumps({"name": name, "description": description, "rules": [r.to_json() for r in rules], "kind": kind, "model": model.to_json(), "prediction": prediction, "after": [r.to_json() for r in after or []]})


def infer(df: DataFrame, text: str) -> DataFrame:
    """``df`` after the stored rules, with the prediction and what follows it: one projection, as Catalyst joins them."""
    held = json.loads(text)
    for r in held["rules"]:
        df = Rule.from_json(r).apply(df)
    df = df.withColumn(held["prediction"], MODELS[held["kind"]].from_json(held["model"]).predict())
    for r in held["after"]:
        df = Rule.from_json(r).apply(df)
    return df


def prediction_table(df: DataFrame, prediction: Column, name: str = "prediction", ids: bool = True, labels: bool = False, features: list[str] | None = None, check_null: bool = True) -> DataFrame:
    """The prediction with the id columns, and on demand the label columns and some features. Null predictions raise."""
    kept = [*(columns_of(df, kind="id") if ids else []), *(columns_of(df, kind="label") if labels else []), *(features or [])]
    require(df, *kept)
    value = F.coalesce(prediction, F.raise_error("a prediction is null").cast("double")) if check_null else prediction
    return df.select(value.alias(name), *kept)
