"""Components by name, and plug-ins that add to them."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points
from typing import Any

GROUP = "quarry.components"


class Registry:
    """Functions by ``domain/name``. ``run`` evaluates a node {"component", "params"} with its inputs."""

    def __init__(self) -> None:
        self.held: dict[str, Callable] = {}

    def add(self, name: str) -> Callable:
        if "/" not in name:
            raise ValueError("a component is named domain/name")

        def register(f: Callable) -> Callable:
            if name in self.held:
                raise ValueError(f"{name} stands already")
            self.held[name] = f
            return f

        return register

    def run(self, node: dict, *inputs: Any) -> Any:
        if node["component"] not in self.held:
            raise KeyError(node["component"])
        return self.held[node["component"]](*inputs, **node.get("params", {}))

    def load_plugins(self) -> list[str]:
        """Call every entry point of the group with this registry."""
        found = []
        for e in entry_points(group=GROUP):
            e.load()(self)
            found.append(e.name)
        return found


def standard() -> Registry:
    """The components of this library."""
    from ..ml import boost, linear, neighbours
    from ..operators import filters, groupby, joins, sampling
    from ..rules import base, binning, columns
    from ..sources import tables
    from ..stats import evaluation, statistics
    from . import export
    from .sql_processor import SqlRule

    r = Registry()
    fit = lambda cls: lambda df, **p: (lambda rule: (rule.apply(df), rule))(cls.fit(df, **p) if hasattr(cls, "fit") else cls(**p))
    for name, f in {
        "data_filter/condition_filter": filters.condition_filter, "data_filter/expr_condition_filter": filters.expr_filter, "data_filter/feature_filter": filters.feature_filter, "data_filter/sample": sampling.sample,
        "data_prep/train_test_split": sampling.train_test_split, "data_prep/union": joins.union, "data_prep/psi": joins.psi, "data_prep/psi_tp": joins.psi3, "data_prep/unbalance_psi": joins.unbalanced_psi,
        "preprocessing/substitution": base.substitution, "preprocessing/binary_op": fit(columns.BinaryOp), "preprocessing/case_when": fit(columns.CaseWhen), "preprocessing/cast": fit(columns.Cast),
        "preprocessing/feature_calculate": fit(columns.FeatureCalculate), "preprocessing/fillna": fit(columns.FillNA), "preprocessing/onehot_encode": fit(columns.OneHot), "preprocessing/vert_binning": fit(binning.Bins),
        "preprocessing/vert_woe_binning": fit(binning.WoeBins), "preprocessing/sql_processor": fit(SqlRule), "postprocessing/score_card_transformer": fit(columns.ScoreCard),
        "stats/table_statistics": statistics.table_statistics, "stats/groupby_statistics": groupby.group_statistics, "stats/ss_pearsonr": statistics.pearson_table, "stats/ss_vif": statistics.vif, "stats/stats_psi": statistics.population_stability,
        "io/data_source": tables.data_source, "io/data_sink": tables.data_sink, "io/identity": lambda x: x, "io/read_data": tables.read_rule, "io/write_data": tables.write_rule, "data_prep/unbalance_psi_cache": joins.cache_keys,
        "ml.train/ss_sgd_train": linear.descent, "ml.train/ss_glm_train": linear.glm, "ml.train/sgb_train": boost.train, "ml.train/ss_xgb_train": boost.train, "ml.train/kmeans_train": neighbours.kmeans, "ml.train/knn_train": neighbours.knn,
        "ml.train/gnb_train": neighbours.NaiveBayes.fit, "ml.train/gpc_train": neighbours.GaussianProcess.fit, "ml.predict/predict": export.prediction_table, "model/model_export": export.export, "model/serving_model_inferencer": export.infer,
        "ml.eval/ss_pvalue": linear.t_test, "ml.eval/biclassification_eval": evaluation.auc_ks, "ml.eval/regression_eval": evaluation.regression, "ml.eval/prediction_bias_eval": evaluation.prediction_bias,
    }.items():
        r.add(name)(f)
    return r
