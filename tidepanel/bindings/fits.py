"""Model queries over the region panel. Fits have no SQL oracle; their parts do, or are unit-tested.

Every family runs with its full settings (the operators' defaults) on all feature sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.bindings.base import Tables
from tidepanel.bindings.features import BAND, FEATURES, ZSCORES, frame
from tidepanel.bindings.joins import panel
from tidepanel.operators import features as fx
from tidepanel.operators import models
from tidepanel.operators.metrics import class_metrics, confusion, leaderboard, rank_by_size
from tidepanel.operators.split import date_split, walk_forward
from tidepanel.session import durable

PRICE = ["return_1d", "return_5d", "return_20d", "rolling_volatility_20d"]
NEWS = ["tone_z", "articles_z"]
SETS = {
    "Model A - price": PRICE,
    "Model B - price + volume": [*PRICE, "volume_z"],
    "Model C - price + volume + news": [*PRICE, "volume_z", *NEWS],
    "Model D - price + volume + news + forum": [*PRICE, "volume_z", *NEWS, "robust_z"],
    "Model E - all": FEATURES,
    "Model X1 - price + news": [*PRICE, *NEWS],
    "Model X2 - price + forum": [*PRICE, "robust_z"],
}
# A grid of 48 settings of the network.
GRID = {"hidden": [(4,), (8,), (16,), (32,), (8, 4), (16, 8)], "max_iter": [200, 400, 700, 1000], "tol": [1e-4, 1e-6]}


def rows(t: Tables) -> DataFrame:
    return date_split(durable(fx.labelled(frame(t))), refuse=False)


def rounded(table: DataFrame) -> DataFrame:
    return table.select(
        *[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in table.dtypes]
    )


def logit_benchmark(t):
    return rounded(leaderboard(models.benchmark(rows(t), "logit", SETS).results))


def logit_coefficients(t):
    done = models.benchmark(rows(t), "logit", SETS, stages=["test"])
    table = done.per_feature.withColumnRenamed("value", "coefficient")
    ranked = rank_by_size(table.withColumn("abs_coefficient", F.abs("coefficient")), "coefficient")
    return rounded(ranked)


def forest_benchmark(t):
    done = models.benchmark(rows(t), "forest", SETS)
    return rounded(leaderboard(done.results))


def forest_importances(t):
    done = models.benchmark(rows(t), "forest", SETS, stages=["test"])
    table = done.per_feature.withColumnRenamed("value", "importance")
    return rounded(rank_by_size(table, "importance", absolute=False))


def rff_svm_benchmark(t):
    done = models.benchmark(rows(t), "rff_svm", SETS)
    return rounded(leaderboard(models.with_diagnostics(done, ["n_support_vectors"])))


def mlp_benchmark(t):
    done = models.benchmark(rows(t), "mlp", SETS)
    return rounded(leaderboard(models.with_diagnostics(done, ["iterations_used", "loss_final"])))


def boosted_benchmark(t):
    done = models.benchmark(rows(t), "boosted", SETS)
    return rounded(leaderboard(done.results))


def source_ablation(t):
    sets = models.ablation_sets(PRICE, {"volume": ["volume_z"], "news": NEWS, "forum": ["robust_z"]})
    return rounded(leaderboard(models.benchmark(rows(t), "logit", sets).results))


def key_models(t):
    labelled = rows(t).filter("split <> 'test'").withColumn("label", F.col("target"))
    return rounded(models.fit_per_key(labelled, FEATURES))


def tuned_thresholds(t):
    return rounded(models.tuned_threshold(models.benchmark(rows(t), "logit", SETS).predictions))


def backward_selection(t):
    return rounded(models.backward_selection(rows(t), FEATURES))


def stacking(t):
    labelled = durable(fx.labelled(frame(t)))
    folds = durable(walk_forward(labelled, 3))
    bases = {family: (family, FEATURES, {}) for family in models.FAMILIES}
    oof = models.out_of_fold(labelled, folds, 3, bases)
    stacked = models.stack(oof, list(bases), 2).withColumn("model", F.lit("stacked"))
    columns = ["model", "label", "pred"]
    both = oof.filter("fold = 2").select(*columns).unionByName(stacked.select(*columns))
    return rounded(class_metrics(confusion(both, ["model"]), ["model"]))


def lag_grid(t):
    lagged = fx.with_lags(fx.with_lags(panel(t), "tone", [1, 5]), "articles", [1, 5])
    labelled = date_split(durable(fx.labelled(fx.feature_frame(lagged, BAND, ZSCORES, ["sparse"]))), refuse=False)
    sets = models.lag_grid_sets(PRICE, "tone", "articles", [0, 1, 5])
    done = models.benchmark(labelled, "logit", sets, stages=["validation"])
    return rounded(leaderboard(done.results))


def grid_search(t):
    return rounded(models.grid_search(rows(t), FEATURES, "mlp", GRID))


QUERIES = {
    "logit_benchmark": logit_benchmark,
    "logit_coefficients": logit_coefficients,
    "forest_benchmark": forest_benchmark,
    "forest_importances": forest_importances,
    "rff_svm_benchmark": rff_svm_benchmark,
    "mlp_benchmark": mlp_benchmark,
    "boosted_benchmark": boosted_benchmark,
    "source_ablation": source_ablation,
    "key_models": key_models,
    "tuned_thresholds": tuned_thresholds,
    "backward_selection": backward_selection,
    "stacking": stacking,
    "lag_grid": lag_grid,
    "grid_search": grid_search,
}
ORACLE: dict[str, str] = {}
