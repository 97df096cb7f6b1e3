"""Choosing features and settings: selection paths from one matrix of moments, nested windows, three classes."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators import models
from tidepanel.operators.metrics import class_metrics, confusion, one_vs_rest_auc, threshold_curve, thresholds
from tidepanel.operators.stats import with_class_weights
from tidepanel.session import durable

# --- feature counts -------------------------------------------------------------------------------


def covariances(frame: DataFrame, sources: dict[str, list[str]], label: str, by: list[str] = ()) -> DataFrame:
    """(by, source, n, i, j, covariance) for every pair of a source's features and the label.

    One aggregate, merged on the map side, serves all sources and groups. A source's entries rest on the rows that have
    all of its features and the label; a source without such rows in a group is left out.
    """
    parts, entries = [], []
    for s, names in enumerate(sources.values()):
        axis = [*names, label]
        whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in axis])
        pairs = list(itertools.combinations_with_replacement(axis, 2))
        parts.append(F.count_if(whole).alias(f"n{s}"))
        parts += [F.covar_pop(F.when(whole, F.col(a)), F.when(whole, F.col(b))).alias(f"c{s}_{k}") for k, (a, b) in enumerate(pairs)]
        entries += [
            F.struct(F.lit(list(sources)[s]).alias("source"), F.col(f"n{s}").alias("n"), F.lit(a).alias("i"), F.lit(b).alias("j"),
                     F.col(f"c{s}_{k}").alias("covariance")) for k, (a, b) in enumerate(pairs)
        ]
    return frame.groupBy(*by).agg(*parts).select(*by, F.inline(F.array(*entries))).filter("n > 0")


def selection_path(matrix: np.ndarray, features: list[str]) -> list[tuple[str, float]]:
    """Forward selection of a least-squares fit from covariances alone: (feature, R squared) in order.

    ``matrix`` has the label last. Each step takes the feature that explains most of what is left (the
    first by name on a tie) and sweeps it out of the matrix. Features without variance left come last with no gain.
    """
    left = matrix.astype(float).copy()
    total, open_features, path = left[-1, -1], sorted(features), []
    at = {f: k for k, f in enumerate(features)}

    def gain(f: str) -> float:
        k = at[f]
        return left[k, -1] ** 2 / left[k, k] if left[k, k] > 1e-12 * matrix[k, k] else 0.0

    while open_features:
        best = max(open_features, key=lambda f: round(gain(f) / total, 12) if total else 0.0)
        open_features.remove(best)
        k = at[best]
        if gain(best):
            left -= np.outer(left[:, k], left[k]) / left[k, k]
        path.append((best, 1.0 - left[-1, -1] / total if total else 0.0))
    return path


def feature_paths(
    frame: DataFrame, sources: dict[str, list[str]], label: str = "target", by: list[str] = ("split",)
) -> DataFrame:
    """(by, source, step, feature, r2): every source's features in order of selection, for every group of ``by``.

    One aggregate over the rows serves all sources; the paths come from matrices of one number per pair of columns.
    """
    found: dict[tuple, dict] = {}
    for row in covariances(frame, sources, label, list(by)).collect():
        entries = found.setdefault((*(row[c] for c in by), row.source), {})
        entries[row.i, row.j] = entries[row.j, row.i] = row.covariance
    rows = []
    for key, entries in found.items():
        names = sources[key[-1]]
        axis = [*names, label]
        matrix = np.array([[entries[a, b] for b in axis] for a in axis])
        rows += [(*key, k, f, float(r2)) for k, (f, r2) in enumerate(selection_path(matrix, names), 1)]
    kinds = ", ".join(f"{c} {dict(frame.dtypes)[c]}" for c in by)
    return frame.sparkSession.createDataFrame(rows, f"{kinds}, source string, step int, feature string, r2 double")


def count_sets(paths: DataFrame) -> dict[str, list[str]]:
    """The first k features of every source, for every k: sets named ``source: k``. ``paths`` has one group."""
    order: dict[str, list[str]] = {}
    for row in paths.orderBy("source", "step").collect():
        order.setdefault(row.source, []).append(row.feature)
    return {f"{source}: {k}": names[:k] for source, names in order.items() for k in range(1, len(names) + 1)}


def count_sweep(
    frame: DataFrame, sources: dict[str, list[str]], family: str = "logit", settings: dict | None = None,
    keys: list[str] = ("ticker", "date"), label: str = "target",
) -> DataFrame:
    """One fit per source and number of features: (source, n_features, features, metrics of validation and test).

    The order of features is selected on the training rows only.
    """
    paths = feature_paths(frame.filter("split = 'train'"), sources, label)
    # Without any training row that has all features of a source there is no path, and nothing to fit.
    sets = count_sets(paths) or {"": [f for names in sources.values() for f in names]}
    results = models.benchmark(frame, family, sets, settings, keys, label).results.filter("model <> ''")
    named = F.create_map(*[F.lit(x) for name, names in sets.items() for x in (name, ", ".join(names))])
    return results.withColumns({"source": F.split("model", ": ")[0], "features": named[F.col("model")]}).select(
        "source", "n_features", "features", *[c for c in results.columns if c not in ("model", "n_features")]
    )


# --- nested windows -------------------------------------------------------------------------------


def choose(scored: DataFrame, cuts: list[float] | None = None, by: list[str] = ("outer",)) -> DataFrame:
    """(by, settings, threshold, validation_balanced_accuracy): the best on average over the inner folds.

    ``scored`` is (by, inner, settings, label, score). Of equal means the smaller threshold is taken, then the
    first settings by name. The choice runs over one row per settings and threshold.
    """
    curve = threshold_curve(scored, [*by, "inner", "settings"], cuts or thresholds())
    mean = curve.groupBy(*by, "settings", "threshold").agg(F.round(F.avg("balanced_accuracy"), 12).alias("validation_balanced_accuracy"))
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("validation_balanced_accuracy"), "threshold", "settings")
    return mean.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def outer_scores(chosen: DataFrame, tested: DataFrame, by: list[str] = ("outer",)) -> DataFrame:
    """What was chosen with its result on the outer test rows, at its threshold and at 0.5.

    ``tested`` is (by, settings, label, score); rows of other settings are passed over.
    """
    met = tested.join(F.broadcast(chosen.select(*by, "settings", "threshold")), [*by, "settings"])  # one row per window
    cuts = F.array(
        F.struct(F.lit("tuned").alias("cut"), (F.col("score") >= F.col("threshold")).cast("int").alias("pred")),
        F.struct(F.lit("default").alias("cut"), (F.col("score") >= 0.5).cast("int").alias("pred")),
    )
    long = met.select(*by, "label", F.inline(cuts))
    made = class_metrics(confusion(long, [*by, "cut"]), [*by, "cut"])
    pick = lambda cut, name: F.max(F.when(F.col("cut") == cut, F.col(name)))
    wide = made.groupBy(*by).agg(
        F.max("n").alias("test_rows"), pick("tuned", "balanced_accuracy").alias("tuned_balanced_accuracy"),
        pick("default", "balanced_accuracy").alias("default_balanced_accuracy"), pick("tuned", "accuracy").alias("tuned_accuracy"),
    )
    return chosen.join(wide, list(by), "left")


def single_feature_scores(
    frame: DataFrame, folds: DataFrame, features: list[str], keys: list[str] = ("ticker", "date"), label: str = "target",
) -> DataFrame:
    """Scores of one feature alone, upward and downward, in every fold: the simplest family for nested windows.

    The score is the logistic function of the feature, scaled by the fold's training rows (a missing value scores 0.5).
    Returns (outer, inner, role, keys, settings, label, score) for the rows that are not trained on. ``folds`` is
    (date, outer, inner, role), bounded by the calendar; moments of all features and folds come from one aggregate.
    """
    rows = frame.select(*keys, F.col(label).cast("int").alias("label"), *features).join(F.broadcast(folds), "date")
    fit = rows.filter("role = 'train'").groupBy("outer", "inner").agg(*[
        part for k, f in enumerate(features) for part in (F.avg(f).alias(f"_m{k}"), F.stddev_pop(f).alias(f"_s{k}"))
    ])
    asked = rows.filter("role <> 'train'").join(F.broadcast(fit), ["outer", "inner"])
    made = []
    for k, f in enumerate(features):
        z = F.coalesce((F.col(f) - F.col(f"_m{k}")) / F.nullif(F.col(f"_s{k}"), F.lit(0.0)), F.lit(0.0))
        for name, way in ((f"{f} up", z), (f"{f} down", -z)):
            made.append(F.struct(F.lit(name).alias("settings"), (1.0 / (1.0 + F.exp(-way))).alias("score")))
    return asked.select("outer", "inner", "role", *keys, "label", F.inline(F.array(*made)))


def nested_benchmark(
    frame: DataFrame, folds: DataFrame, features: list[str], family: str, grid: dict[str, list],
    keys: list[str] = ("ticker", "date"), label: str = "target", cuts: list[float] | None = None, parallelism: int = 4,
) -> DataFrame:
    """Settings and threshold chosen inside every outer window, then fitted to its training rows and scored on its test rows.

    ``folds`` is that of ``split.nested_folds``. Every setting is fitted in every inner fold; imputation, scaling and class
    weights are those of the rows fitted on. One row per outer window: what was chosen, its mean inner balanced
    accuracy, row counts and the test results at the chosen threshold and at 0.5. A fold without training rows scores
    nothing; a window without inner scores is left out.
    """
    names = list(grid)
    told = {", ".join(f"{n}={v}" for n, v in zip(names, values, strict=True)): dict(zip(names, values, strict=True))
            for values in itertools.product(*grid.values())}
    base = durable(
        frame.select(*keys, F.col(label).cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in features])
        .join(F.broadcast(folds), "date")
    )
    cells = [(r.outer, r.inner) for r in base.select("outer", "inner").distinct().orderBy("outer", "inner").collect()]

    def prepared(outer: int, inner: int) -> tuple[DataFrame, list[int], DataFrame]:
        rows = base.filter((F.col("outer") == outer) & (F.col("inner") == inner))
        made = models.stored_small(models.prepare(rows, F.col("role") == "train", features, family in models.SCALED))
        fit = made.filter("role = 'train'")
        return with_class_weights(fit), models.classes_of(fit), made.filter("role <> 'train'").select("label", *features)

    def score(outer: int, inner: int, settings: str, fit: DataFrame, classes: list[int], rows: DataFrame) -> DataFrame:
        scored = models.fit(family, fit, features, told[settings], classes).score(rows)
        return scored.select(
            F.lit(outer).alias("outer"), F.lit(inner).alias("inner"), F.lit(settings).alias("settings"), "label", "score"
        )

    jobs = []
    for outer, inner in cells:
        if inner >= 0:
            parts = prepared(outer, inner)
            jobs += [lambda o=outer, i=inner, s=s, p=parts: score(o, i, s, *p) for s in told]
    none = frame.sparkSession.createDataFrame([], "outer int, inner int, settings string, label int, score double")
    inner_scores = durable(reduce(DataFrame.unionByName, models._in_parallel(frame.sparkSession, jobs, parallelism), none))
    chosen = durable(choose(inner_scores, cuts))
    tested = [score(r.outer, -1, r.settings, *prepared(r.outer, -1)) for r in chosen.collect()]  # a row per window
    counts = base.filter("inner = -1 and role = 'train'").groupBy("outer").agg(F.count(F.lit(1)).alias("train_rows"))
    result = outer_scores(chosen, durable(reduce(DataFrame.unionByName, tested, none)).drop("inner"))
    return result.join(counts, "outer", "left")


# --- three classes --------------------------------------------------------------------------------


def fit_multinomial(frame: DataFrame, features: list[str], settings: dict):
    """Multinomial logistic regression with balanced weights: a function that adds ``scores`` and ``pred`` to rows.

    ``label`` counts classes from 0. The penalty is as in ``models.fit_logit``.
    """
    total = frame.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(
        family="multinomial", regParam=1.0 / (settings.get("C", 1.0) * total), elasticNetParam=0.0, standardization=False,
        weightCol="weight", maxIter=settings.get("max_iter", 1000), tol=settings.get("tol", 1e-6),
    ).fit(models._assemble(frame, features))

    def score(rows: DataFrame) -> DataFrame:
        out = model.transform(models._assemble(rows, features))
        return out.withColumns({"scores": vector_to_array("probability"), "pred": F.col("prediction").cast("int")}).drop(
            "rawPrediction", "probability", "prediction", "features"
        )

    return score


def three_class_benchmark(
    frame: DataFrame, feature_sets: dict[str, list[str]], settings: dict | None = None, label: str = "class",
    keys: list[str] = ("ticker", "date"), classes: int = 3, parallelism: int = 4,
) -> DataFrame:
    """(model, stage, n, accuracy, balanced_accuracy, macro_f1, auc): multinomial fits of nested feature sets.

    Fitted on train and scored on validation, refitted on both and scored on test. The AUC is the mean over the classes, each
    against the others.
    """
    features = sorted({f for names in feature_sets.values() for f in names})
    base = durable(
        frame.filter(F.col(label).isNotNull())
        .select(*keys, F.col(label).cast("int").alias("label"), "split", *[F.col(f).cast("double").alias(f) for f in features])
    )

    def one(name: str, stage: str, prepared: DataFrame) -> DataFrame:
        fit = with_class_weights(prepared.filter(F.col("split").isin(models.STAGES[stage])))
        score = fit_multinomial(fit, feature_sets[name], settings or {})
        return score(prepared.filter(F.col("split") == stage)).select(
            F.lit(name).alias("model"), F.lit(stage).alias("stage"), "label", "pred", "scores"
        )

    jobs = []
    for stage, fitted in models.STAGES.items():
        prepared = models.stored_small(models.prepare(base, F.col("split").isin(fitted), features, True))
        jobs += [lambda n=name, s=stage, p=prepared: one(n, s, p) for name in feature_sets]
    scored = durable(reduce(DataFrame.unionByName, models._in_parallel(frame.sparkSession, jobs, parallelism)))
    by = ["model", "stage"]
    areas = one_vs_rest_auc(scored, by, classes).groupBy(*by).agg(F.avg("auc").alias("auc"))
    return class_metrics(confusion(scored, by), by).drop("positive_rate").join(areas, by, "left")
