"""Model families on Spark ML and the nested feature-set benchmark around them.

A family is a function ``(fit_frame, features, settings) -> Fitted``. Frames hold the imputed
feature columns, ``label`` and ``weight``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.contract import FEATURE_SETS, NESTED_FEATURE_SETS
from tidepanel.operators.metrics import all_metrics, best_threshold, threshold_curve, thresholds
from tidepanel.operators.stats import impute, medians, moments, standardize, with_class_weights
from tidepanel.session import durable

SEED = 42


@dataclass
class Fitted:
    """A fitted model: how to score a frame, its per-feature values, its diagnostics."""

    score: Callable[[DataFrame], DataFrame]
    per_feature: dict[str, float] = field(default_factory=dict)
    diagnostics: dict[str, float] = field(default_factory=dict)


Family = Callable[[DataFrame, list[str], dict], Fitted]


def _assemble(frame: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=output).transform(frame)


def _scored(model, frame: DataFrame, drop: list[str], column: str = "probability") -> DataFrame:
    out = model.transform(frame).withColumns(
        {
            "score": vector_to_array(column)[1],
            "pred": F.col("prediction").cast("int"),
        }
    )
    return out.drop("rawPrediction", "probability", "prediction", *drop)


def fit_logit(frame: DataFrame, features: list[str], settings: dict) -> Fitted:
    """L2 logistic regression with inverse strength C and balanced weights.

    Spark divides the loss by the weight sum, so the penalty is 1 / (C * sum of weights). Features
    that are constant on the fit rows cannot be told from the intercept: they get coefficient 0 and
    stay out of the solver.
    """
    parts = [F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("label")).alias("up")]
    for k, f in enumerate(features):
        parts += [F.min(f).alias(f"a{k}"), F.max(f).alias(f"b{k}")]
    seen = frame.agg(*parts).first()
    used = [f for k, f in enumerate(features) if seen[f"a{k}"] != seen[f"b{k}"]]
    zeros = dict.fromkeys(features, 0.0)
    if not used:
        share = seen["up"] / seen["w"]
        return Fitted(
            lambda rows: rows.withColumns({"score": F.lit(share), "pred": F.lit(int(share > 0.5))}),
            zeros, {"iterations_used": 0, "intercept": math.log(share / (1 - share)) if 0 < share < 1 else math.inf},
        )
    model = LogisticRegression(
        regParam=1.0 / (settings.get("C", 1.0) * seen["w"]), elasticNetParam=0.0, standardization=False,
        weightCol="weight", maxIter=settings.get("max_iter", 5000), tol=settings.get("tol", 1e-6),
    ).fit(_assemble(frame, used))
    return Fitted(
        lambda rows: _scored(model, _assemble(rows, used), ["features"]),
        zeros | dict(zip(used, (float(x) for x in model.coefficients.toArray()))),
        {"iterations_used": model.summary.totalIterations, "intercept": float(model.intercept)},
    )


def fit_forest(frame: DataFrame, features: list[str], settings: dict) -> Fitted:
    """Random forest with balanced weights. Splits are binned; like, not equal to, exact splits."""
    model = RandomForestClassifier(
        numTrees=settings.get("trees", 500), maxDepth=settings.get("depth", 10),
        minInstancesPerNode=settings.get("leaf", 10), maxMemoryInMB=settings.get("memory_mb", 1024),
        featureSubsetStrategy=str(settings.get("share", 0.5)), weightCol="weight",
        seed=settings.get("seed", SEED),
    ).fit(_assemble(frame, features))
    return Fitted(
        lambda rows: _scored(model, _assemble(rows, features), ["features"]),
        dict(zip(features, (float(x) for x in model.featureImportances.toArray()))),
        {"trees": model.getNumTrees},
    )


def fit_boosted(frame: DataFrame, features: list[str], settings: dict) -> Fitted:
    """Gradient-boosted trees."""
    model = GBTClassifier(
        maxIter=settings.get("rounds", 50), maxDepth=settings.get("depth", 3),
        stepSize=settings.get("step", 0.1), weightCol="weight", seed=settings.get("seed", SEED),
    ).fit(_assemble(frame, features))
    return Fitted(
        lambda rows: _scored(model, _assemble(rows, features), ["features"]),
        dict(zip(features, (float(x) for x in model.featureImportances.toArray()))),
    )


def fit_mlp(frame: DataFrame, features: list[str], settings: dict) -> Fitted:
    """One hidden layer. Spark's network has sigmoid units and no L2 term: an approximation."""
    model = MultilayerPerceptronClassifier(
        layers=[len(features), *settings.get("hidden", (8,)), 2], solver="l-bfgs",
        maxIter=settings.get("max_iter", 1000), blockSize=settings.get("batch", 128),
        tol=settings.get("tol", 1e-6), seed=settings.get("seed", SEED),
    ).fit(_assemble(frame, features))
    summary = model.summary()
    return Fitted(
        lambda rows: _scored(model, _assemble(rows, features), ["features"]),
        {},
        {"iterations_used": summary.totalIterations, "loss_final": float(summary.objectiveHistory[-1])},
    )


def fourier_map(features: list[str], gamma: float, size: int, seed: int) -> Callable[[DataFrame], DataFrame]:
    """Random Fourier features of an RBF kernel (Rahimi and Recht 2007) as a vectorised column."""
    draw = np.random.default_rng(seed)
    weights = draw.normal(0.0, np.sqrt(2.0 * gamma), (len(features), size))
    shifts = draw.uniform(0.0, 2.0 * np.pi, size)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(columns: pd.DataFrame) -> pd.Series:
        z = np.sqrt(2.0 / size) * np.cos(columns.to_numpy(dtype=float) @ weights + shifts)
        return pd.Series(list(z))

    return lambda frame: frame.withColumn(
        "features", array_to_vector(project(F.struct(*features)))
    )


def fit_rff_svm(frame: DataFrame, features: list[str], settings: dict) -> Fitted:
    """RBF support vector machine, approximated by Fourier features and a linear SVM.

    gamma is 1 / (features * variance of all feature values). Rows are ranked by margin; the count
    of rows with margin at most 1 stands for the support vectors.
    """
    total = frame.agg(F.sum("weight")).first()[0]
    stats = moments(frame, features)
    means = np.array([stats[c][0] for c in features])
    spreads = np.array([stats[c][1] for c in features])
    variance = float(np.mean(spreads**2 + means**2) - np.mean(means) ** 2) or 1.0
    mapped = fourier_map(
        features, 1.0 / (len(features) * variance), settings.get("size", 200), settings.get("seed", SEED)
    )
    model = LinearSVC(
        regParam=1.0 / (settings.get("C", 1.0) * total), standardization=False,
        weightCol="weight", maxIter=settings.get("max_iter", 100),
    ).fit(mapped(frame))

    def score(rows: DataFrame) -> DataFrame:
        return _scored(model, mapped(rows), ["features"], "rawPrediction")

    sign = 2 * F.col("label") - 1
    inside = score(frame).agg(F.count_if(sign * F.col("score") <= 1)).first()[0]
    return Fitted(score, {}, {"n_support_vectors": inside})


FAMILIES: dict[str, Family] = {
    "logit": fit_logit, "forest": fit_forest, "rff_svm": fit_rff_svm, "mlp": fit_mlp,
    "boosted": fit_boosted,
}
SCALED = {"logit", "rff_svm", "mlp"}


def fit(family: str, frame: DataFrame, features: list[str], settings: dict, classes: list[int]) -> Fitted:
    """The family's model on rows of both classes; ``classes`` are those among the rows, see ``classes_of``.

    Rows of one class give a model that always answers it, without weight on any feature. Without rows there is
    no model: it scores no row.
    """
    if len(classes) > 1:
        return FAMILIES[family](frame, features, settings)
    answer = classes[0] if classes else None
    columns = {"score": F.lit(answer).cast("double"), "pred": F.lit(answer).cast("int")}
    return Fitted(
        lambda rows: rows.filter(F.lit(bool(classes))).withColumns(columns), dict.fromkeys(features, 0.0) if classes else {}
    )


def classes_of(frame: DataFrame) -> list[int]:
    """The labels that occur: one or two numbers, on the driver."""
    return sorted(row[0] for row in frame.select("label").distinct().collect())
DEFAULT_SETS = {
    "logit": FEATURE_SETS, "mlp": FEATURE_SETS, "forest": NESTED_FEATURE_SETS,
    "rff_svm": NESTED_FEATURE_SETS, "boosted": NESTED_FEATURE_SETS,
}


def prepare(frame: DataFrame, fit_where: Column, features: list[str], scale: bool) -> DataFrame:
    """Impute by training medians, scale by training moments if asked, add class weights.

    Medians and moments of all features come out of one job each; they are a few numbers.
    """
    fit_rows = frame.filter(fit_where)
    filled = impute(frame, medians(fit_rows, features))
    if scale:
        filled = standardize(filled, moments(filled.filter(fit_where), features))
    return filled


#: Rows of a partition of prepared fit rows; an iterative fit runs a task per partition in every pass.
ROWS_PER_PARTITION = 100_000


def stored_small(frame: DataFrame) -> DataFrame:
    """The prepared rows, stored once for many fits and in no more partitions than their number needs.

    Every pass of a solver, and every level of trees, runs a task per partition: thousands of rows in many
    partitions would be all overhead. Large frames keep their partitions.
    """
    kept = durable(frame)
    wanted = max(1, -(-kept.count() // ROWS_PER_PARTITION))
    return kept.coalesce(wanted) if wanted < kept.rdd.getNumPartitions() else kept


def _in_parallel(spark: SparkSession, jobs: list[Callable], parallelism: int) -> list:
    """Run independent Spark jobs from a few driver threads."""
    if parallelism <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        return pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs)


@dataclass
class Benchmark:
    results: DataFrame
    predictions: DataFrame
    per_feature: DataFrame
    diagnostics: DataFrame


STAGES = {"validation": ["train"], "test": ["train", "validation"]}


def benchmark(
    frame: DataFrame,
    family: str = "logit",
    feature_sets: dict[str, list[str]] | None = None,
    settings: dict | None = None,
    keys: list[str] = ("ticker", "date"),
    label: str = "target",
    parallelism: int = 4,
    stages: list[str] = ("validation", "test"),
) -> Benchmark:
    """Fit every feature set on train and score validation; refit on both and score test.

    ``frame`` holds the keys, the label, the features and ``split``. Each fit and each scoring is a
    distributed job; only the loop over sets runs on the driver. Predictions of all sets go into
    one frame, and all their metrics come out of one grouped pass over it.
    """
    sets = feature_sets or DEFAULT_SETS[family]
    settings = settings or {}
    features = sorted({f for names in sets.values() for f in names})
    spark = frame.sparkSession
    base = durable(
        frame.select(*keys, F.col(label).cast("int").alias("label"), "split",
                     *[F.col(f).cast("double").alias(f) for f in features])
    )

    def one(name: str, stage: str, prepared: DataFrame):
        fitted = fit(family, weighted[stage], sets[name], settings, classes[stage])
        rows = prepared.filter(F.col("split") == stage).select(*keys, "label", *sets[name])
        scored = fitted.score(rows).select(
            F.lit(name).alias("model"), F.lit(stage).alias("stage"), *keys, "label", "pred", "score"
        )
        return name, stage, fitted, scored

    jobs, weighted, classes = [], {}, {}
    for stage in stages:
        prepared = stored_small(prepare(base, F.col("split").isin(STAGES[stage]), features, family in SCALED))
        weighted[stage] = stored_small(with_class_weights(prepared.filter(F.col("split").isin(STAGES[stage]))))
        classes[stage] = classes_of(weighted[stage])
        jobs += [lambda n=name, s=stage, p=prepared: one(n, s, p) for name in sets]
    done = _in_parallel(frame.sparkSession, jobs, parallelism)

    predictions = durable(reduce(DataFrame.unionByName, [scored for *_, scored in done]))
    per_feature = [
        (name, feature, value)
        for name, stage, fitted, _ in done if stage == stages[-1]
        for feature, value in fitted.per_feature.items()
    ]
    diagnostics = [
        (name, key, float(value))
        for name, stage, fitted, _ in done if stage == stages[-1]
        for key, value in fitted.diagnostics.items()
    ]
    return Benchmark(
        wide_results(predictions, base, {n: len(f) for n, f in sets.items()}, list(stages), family == "mlp"),
        predictions,
        spark.createDataFrame(per_feature, "model string, feature string, value double"),
        spark.createDataFrame(diagnostics, "model string, name string, value double"),
    )


def wide_results(
    predictions: DataFrame, base: DataFrame, sizes: dict[str, int], stages: list[str],
    with_dummy: bool = False,
) -> DataFrame:
    """One row per model: row counts and the four metrics of each stage.

    ``base`` holds ``split`` and ``label``; with ``with_dummy`` the majority baseline is added.
    """
    metrics = all_metrics(predictions, ["model", "stage"])
    columns = []
    for stage in stages:
        for m in ("accuracy", "balanced_accuracy", "auc", "positive_rate"):
            columns.append(F.max(F.when(F.col("stage") == stage, F.col(m))).alias(f"{stage}_{m}"))
    # Rows per split and label: a handful of counts.
    counts = {(r["split"], r["label"]): r["count"] for r in base.groupBy("split", "label").count().collect()}

    def rows(*splits: str) -> Column:
        return F.lit(sum(n for (s, _), n in counts.items() if s in splits)).cast("bigint")

    sized = [
        F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("model")].alias("n_features"),
        rows("train").alias("train_rows"),
        rows("validation").alias("validation_rows"),
        rows("train", "validation").alias("train_plus_validation_rows"),
        rows("test").alias("test_rows"),
    ]
    if with_dummy:
        # The majority label of train (the smaller one on a tie), scored on validation.
        top = min(
            ((-n, label) for (s, label), n in counts.items() if s == "train"), default=(0, None)
        )[1]
        found = sum(n for (s, _), n in counts.items() if s == "validation")
        hits = counts.get(("validation", top), 0)
        sized.append(F.lit(hits / found if found else None).cast("double").alias("dummy_validation_accuracy"))
    return metrics.groupBy("model").agg(*columns).select(
        "model", *sized,
        *[f"{s}_{m}" for s in stages for m in ("accuracy", "balanced_accuracy", "auc", "positive_rate")],
    )


def with_diagnostics(done: Benchmark, names: list[str]) -> DataFrame:
    """Results with fit diagnostics as further columns; both sides hold one row per model."""
    wide = done.diagnostics.groupBy("model").pivot("name", names).agg(F.first("value"))
    return done.results.join(wide, "model", "left")


# --- documented variants: loops over the benchmark --------------------------------------------


def ablation_sets(base: list[str], sources: dict[str, list[str]]) -> dict[str, list[str]]:
    """The base alone, with every single source, and with all of them."""
    sets = {"base": base} | {f"base + {name}": base + extra for name, extra in sources.items()}
    return sets | {"base + all": base + [f for extra in sources.values() for f in extra]}


def backward_selection(
    frame: DataFrame, features: list[str], family: str = "logit", settings: dict | None = None,
    metric: str = "validation_balanced_accuracy", least: int = 1, keys: list[str] = ("ticker", "date"),
) -> DataFrame:
    """Drop one feature at a time, the one whose loss costs validation least.

    Every step scores all its candidate sets in one benchmark call. Returns one row per step:
    (step, dropped, features, metric).
    """
    left, trail = list(features), []
    while len(left) > least:
        sets = {f: [g for g in left if g != f] for f in left}
        results = benchmark(frame, family, sets, settings, keys, stages=["validation"]).results
        best = results.orderBy(F.desc_nulls_last(metric), "model").select("model", metric).first()
        # Without validation rows all sets are equal: the first by name, as on any tie.
        dropped, reached = best or (min(sets), None)
        left = sets[dropped]
        trail.append((len(trail) + 1, dropped, ", ".join(left), reached))
    return frame.sparkSession.createDataFrame(
        trail, "step int, dropped string, features string, validation_balanced_accuracy double"
    )


def grid_search(
    frame: DataFrame, features: list[str], family: str, grid: dict[str, list],
    keys: list[str] = ("ticker", "date"), parallelism: int = 8,
) -> DataFrame:
    """Every combination of settings, chosen on validation only: (settings, metrics), best first."""
    names = list(grid)
    prepared = stored_small(prepare(
        durable(frame), F.col("split") == "train", features, family in SCALED
    ).withColumn("label", F.col("target").cast("int")))
    fit_rows = stored_small(with_class_weights(prepared.filter("split = 'train'")))
    classes = classes_of(fit_rows)
    rows = prepared.filter("split = 'validation'").select(*keys, "label", *features)

    def one(values: tuple):
        settings = dict(zip(names, values))
        text = ", ".join(f"{n}={v}" for n, v in settings.items())
        scored = fit(family, fit_rows, features, settings, classes).score(rows)
        return scored.select(F.lit(text).alias("settings"), "label", "pred", "score")

    jobs = [lambda v=values: one(v) for values in itertools.product(*grid.values())]
    scored = durable(reduce(DataFrame.unionByName, _in_parallel(frame.sparkSession, jobs, parallelism)))
    return all_metrics(scored, ["settings"]).orderBy(
        F.desc_nulls_last("balanced_accuracy"), F.desc_nulls_last("accuracy"), "settings"
    )


def tuned_threshold(benchmark_predictions: DataFrame, cuts: list[float] | None = None) -> DataFrame:
    """Per model the threshold that is best on validation."""
    rows = benchmark_predictions.filter("stage = 'validation'")
    return best_threshold(threshold_curve(rows, ["model"], cuts or thresholds()), ["model"])


def out_of_fold(
    frame: DataFrame, folds: DataFrame, n_folds: int, sets: dict[str, tuple[str, list[str], dict]],
    keys: list[str] = ("ticker", "date"), label: str = "target", parallelism: int = 4,
) -> DataFrame:
    """Out-of-fold scores of several base models, long: (keys, label, fold, model, score, pred).

    ``sets`` maps a model name to (family, features, settings). Folds without training rows have no scores.
    """
    features = sorted({f for _, names, _ in sets.values() for f in names})
    base = durable(
        frame.select(*keys, F.col(label).cast("int").alias("label"),
                     *[F.col(f).cast("double").alias(f) for f in features])
        .join(F.broadcast(folds), "date")
    )

    def one(fold: int, name: str, prepared: DataFrame, classes: list[int]):
        family, names, settings = sets[name]
        fitted = fit(family, with_class_weights(prepared.filter("role = 'train'")), names, settings, classes)
        rows = prepared.filter("role = 'test'").select(*keys, "label", *names)
        return fitted.score(rows).select(
            *keys, "label", F.lit(fold).alias("fold"), F.lit(name).alias("model"), "score", "pred"
        )

    jobs = []
    for fold in range(n_folds):
        rows = base.filter(F.col("fold") == fold).drop("fold")
        prepared = prepare(rows, F.col("role") == "train", features, True)
        classes = classes_of(rows.filter("role = 'train'"))
        jobs += [lambda k=fold, n=name, p=prepared, c=classes: one(k, n, p, c) for name in sets]
    return durable(reduce(DataFrame.unionByName, _in_parallel(frame.sparkSession, jobs, parallelism)))


def stack(
    oof: DataFrame, models: list[str], last_fold: int, keys: list[str] = ("ticker", "date")
) -> DataFrame:
    """A second logistic regression over the base scores, fitted before the last fold and scored on it."""
    wide = oof.groupBy(*keys, "fold").agg(
        F.first("label").alias("label"),
        *[F.max(F.when(F.col("model") == m, F.col("score"))).alias(f"s{k}") for k, m in enumerate(models)],
    )
    names = [f"s{k}" for k in range(len(models))]
    # Scores may hardly vary; the solver needs them on one scale.
    scaled = prepare(wide, F.col("fold") < last_fold, names, True)
    known = scaled.filter(F.col("fold") < last_fold)
    fitted = fit("logit", with_class_weights(known), names, {}, classes_of(known))
    return fitted.score(scaled.filter(F.col("fold") == last_fold)).select(*keys, "label", "score", "pred")


def lag_grid_sets(base: list[str], first: str, second: str, lags: list[int]) -> dict[str, list[str]]:
    """Base plus one lag of each of two sources, for every pair of lags; lag 0 is the value itself."""

    def name(column: str, k: int) -> str:
        return f"{column}_lag_{k}" if k else column

    return {
        f"{first}_lag_{a}__{second}_lag_{b}": base + [name(first, a), name(second, b)]
        for a in lags for b in lags
    }


def fit_per_key(
    frame: DataFrame, features: list[str], key: str = "ticker", label: str = "label",
    C: float = 1.0, keys: list | None = None, parallelism: int = 4,
) -> DataFrame:
    """One balanced L2 logistic regression per key: (key, n, intercept, coefficients).

    Every key of ``keys`` (by default, all keys of ``frame``) is a distributed fit on its own rows, imputed
    and scaled by them; only the loop over keys runs on the driver. A key with one class gets NULLs.
    """
    kept = frame.select(key, F.col(label).cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in features])
    kept = durable(kept.filter(F.col("label").isNotNull()))
    counts: dict = {}
    for row in kept.groupBy(key, "label").count().collect():
        counts.setdefault(row[key], {})[row["label"]] = row["count"]
    wanted = [k for k in (list(counts) if keys is None else keys) if k in counts]
    schema = frame.select(key).schema.add("n", T.LongType()).add("intercept", T.DoubleType())
    for f in features:
        schema = schema.add(f, T.DoubleType())

    def one(value) -> tuple:
        n = sum(counts[value].values())
        if len(counts[value]) < 2:
            return (value, n, None, *[None] * len(features))
        own = kept.filter(F.col(key).eqNullSafe(F.lit(value)))
        middle = {f: m or 0.0 for f, m in medians(own, features).items()}
        filled = impute(own, middle)
        scaled = standardize(filled, moments(filled, features))
        fitted = fit_logit(with_class_weights(scaled), features, {"C": C, "tol": 1e-12})
        return (value, n, fitted.diagnostics["intercept"], *[fitted.per_feature[f] for f in features])

    done = _in_parallel(frame.sparkSession, [lambda v=value: one(v) for value in wanted], parallelism)
    return frame.sparkSession.createDataFrame(done, schema)
