"""Rules: fitted on one table, stored as JSON, applied to others as plain column expressions."""

from __future__ import annotations

import json
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import require

VERSION = 1


class Rule:
    """``params`` hold all that ``expressions`` needs; both are JSON.

    ``apply`` replaces columns in place, adds new ones at the end, and drops what ``removed`` names.
    """

    name: ClassVar[str]
    REGISTRY: ClassVar[dict[str, type[Rule]]] = {}

    def __init_subclass__(cls) -> None:
        cls.REGISTRY[cls.name] = cls

    def __init__(self, **params):
        self.params = params

    def inputs(self) -> list[str]:
        return list(self.params.get("columns", []))

    def removed(self) -> list[str]:
        return []

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        require(df, *self.inputs())
        new, gone = self.expressions(df), set(self.removed())
        kept = [new[c].alias(c, metadata=df.schema[c].metadata or {}) if c in new else F.col(f"`{c}`") for c in df.columns if c not in gone]
        return df.select(*kept, *(e.alias(c) for c, e in new.items() if c not in df.columns))

    def to_json(self) -> str:
        return json.dumps({"version": VERSION, "rule": self.name, "params": self.params}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Rule:
        held = json.loads(text)
        if held["version"] != VERSION:
            raise ValueError(f"version {held['version']} of a rule is not read")
        return Rule.REGISTRY[held["rule"]](**held["params"])


class Chain(Rule):
    """Several rules one after another, as one rule: what is exported with a model."""

    name = "chain"

    def __init__(self, rules: list):
        super().__init__(rules=[r if isinstance(r, str) else r.to_json() for r in rules])

    def apply(self, df: DataFrame) -> DataFrame:
        for text in self.params["rules"]:
            df = Rule.from_json(text).apply(df)
        return df


def substitution(df: DataFrame, rule: str | Rule) -> DataFrame:
    """Apply any stored rule."""
    return (Rule.from_json(rule) if isinstance(rule, str) else rule).apply(df)
