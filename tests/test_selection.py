"""Nested folds, selection paths, three classes and bootstrap of AUC against plain versions."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import metrics, selection
from tidepanel.operators.split import nested_folds, walk_forward
from tidepanel.session import durable


def dates(spark, n):
    return spark.sql(f"SELECT date_add(DATE '2024-01-01', CAST(id AS INT)) AS date FROM range({n})")


@pytest.mark.parametrize("gap", [1, 3])
def test_nested_folds_never_see_outer_rows(spark, gap):
    frame = dates(spark, 120)
    rows = [tuple(r) for r in nested_folds(frame, 3, 2, gap=gap).collect()]
    own = {(d, o, r) for d, o, i, r in rows if i == -1}
    assert own == {(r.date, r.fold, r.role) for r in walk_forward(frame, 3, gap=gap).collect()}
    for o in range(3):
        known = {d for d, k, r in own if k == o and r == "train"}
        for i in range(2):
            fit = {d for d, k, j, r in rows if (k, j, r) == (o, i, "train")}
            held = {d for d, k, j, r in rows if (k, j, r) == (o, i, "validation")}
            assert fit and held and fit | held <= known and (min(held) - max(fit)).days == gap + 1
        assert max(known) == max(d for d, k, j, r in rows if (k, j, r) == (o, 1, "validation"))


def test_selection_path_is_forward_selection():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(200, 4))
    x[:, 3] = x[:, 0]  # a copy explains nothing once the other is in
    y = 2 * x[:, 0] + x[:, 1] + 0.3 * draw.normal(size=200)
    names = ["a", "b", "c", "d"]
    got = selection.selection_path(np.cov(np.column_stack([x, y]).T, bias=True), names)

    def r2(columns):
        z = x[:, columns] - x[:, columns].mean(axis=0)
        rest = (y - y.mean()) - z @ np.linalg.lstsq(z, y - y.mean(), rcond=None)[0]
        return 1 - rest.var() / y.var()

    chosen: list[int] = []
    for feature, value in got:
        best = max(round(r2([*chosen, k]), 9) for k in range(4) if k not in chosen)
        chosen.append(names.index(feature))
        assert value == pytest.approx(r2(chosen)) and round(r2(chosen), 9) == best
    assert [f for f, _ in got][:2] == ["a", "b"] and got[-1][0] == "d"
    assert selection.selection_path(np.zeros((3, 3)), ["b", "a"]) == [("a", 0.0), ("b", 0.0)]


def panel(spark, n=160, keys=4):
    draw = np.random.default_rng(8)
    rows = []
    for day, key in itertools.product(range(n), range(keys)):
        a, b, c = draw.normal(size=3)
        target = int(a + 0.5 * draw.normal() > 0)
        rows.append((f"k{key}", day, float(a), float(b) if day % 9 else None, float(c), target, int(a > 0.5) + int(a > -0.5)))
    frame = spark.createDataFrame(rows, "ticker string, day int, a double, b double, c double, target int, class int")
    return durable(frame.withColumn("date", F.expr("date_add(DATE '2024-01-01', day)")).drop("day"))


def test_paths_and_sweep(spark):
    frame = panel(spark).withColumn("split", F.expr("CASE WHEN date < '2024-04-01' THEN 'train' WHEN date < '2024-05-01' THEN 'validation' ELSE 'test' END"))
    paths = selection.feature_paths(frame, {"one": ["a", "b"], "two": ["c"]}).filter("split = 'train'")
    assert [(r.source, r.step, r.feature) for r in paths.orderBy("source", "step").collect()] == [("one", 1, "a"), ("one", 2, "b"), ("two", 1, "c")]
    sweep = {(r.source, r.n_features): r for r in selection.count_sweep(frame, {"one": ["b", "a"], "two": ["c"]}).collect()}
    assert set(sweep) == {("one", 1), ("one", 2), ("two", 1)} and sweep["one", 2].features == "a, b"
    assert sweep["one", 1].test_balanced_accuracy > 0.75 > sweep["two", 1].test_balanced_accuracy


def test_nested_choice(spark):
    frame = panel(spark)
    folds = durable(nested_folds(frame, 3, 2))
    scored = durable(selection.single_feature_scores(frame, folds, ["a", "b", "c"]))
    made = selection.outer_scores(selection.choose(scored.filter("inner >= 0")), scored.filter("inner = -1")).collect()
    assert len(made) == 3 and all(r.settings == "a up" and r.tuned_balanced_accuracy > 0.75 for r in made)
    assert sum(r.test_rows for r in made) == folds.filter("inner = -1 and role = 'test'").count() * 4
    fitted = selection.nested_benchmark(frame, folds, ["a", "b"], "logit", {"C": [1e-6, 1.0]}).orderBy("outer").collect()
    assert [r.outer for r in fitted] == [0, 1, 2] and all(r.tuned_balanced_accuracy > 0.75 and r.train_rows > 0 for r in fitted)


def test_three_classes(spark):
    frame = panel(spark).withColumn("split", F.expr("CASE WHEN date < '2024-04-01' THEN 'train' WHEN date < '2024-05-01' THEN 'validation' ELSE 'test' END"))
    made = {(r.model, r.stage): r for r in selection.three_class_benchmark(frame, {"good": ["a", "b"], "bad": ["c"]}).collect()}
    assert set(made) == set(itertools.product(["good", "bad"], ["validation", "test"]))
    assert made["good", "test"].accuracy > 0.85 and made["good", "test"].auc > 0.9 and made["bad", "test"].balanced_accuracy < 0.6


def plain_auc(rows, replicate):
    up, down = [], []
    for key, label, score in rows:
        digest = hashlib.md5(f"{key}#{replicate // 8}".encode()).hexdigest()
        draw = int(digest[4 * (replicate % 8) : 4 * (replicate % 8) + 4], 16)
        (up if label else down).append((score, sum(draw >= s for s in metrics.POISSON_STEPS)))
    won = sum(w * v * ((s > t) + (s == t) / 2) for s, w in up for t, v in down)
    pairs = sum(w for _, w in up) * sum(v for _, v in down)
    return won / pairs if pairs else None


@pytest.mark.parametrize("partitions", [1, 7])
def test_bootstrap_auc_equals_plain(spark, partitions):
    draw = np.random.default_rng(6)
    rows = [(f"r{i}", int(draw.random() < 0.4), float(draw.integers(0, 5)) if i % 2 else float(draw.random())) for i in range(300)]
    rows += [(f"h{i}", i % 2, 2.0) for i in range(150)]  # a score that a third of the rows share
    frame = spark.createDataFrame([("m", *r) for r in rows] + [("one", "x", 1, 0.5), ("one", "y", 1, 0.5), ("m", "z", 1, None), ("m", None, 1, 0.1), (None, "q", 0, 0.1)],
                                  "model string, id string, label int, score double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {(r.model, r.replicate): r.auc for r in metrics.bootstrap_auc(frame, ["model"], F.col("id"), 11).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert len(got) == 33 and {v for (m, _), v in got.items() if m != "m"} == {None}
    for k in range(11):
        assert got["m", k] == pytest.approx(plain_auc(rows, k), abs=1e-12)


def test_bootstrap_difference(spark):
    rows = [(m, f"r{i}", i % 2, (i % 2 if m == "good" else 0) + (i * 7 % 13) / 13) for i in range(200) for m in ("good", "bad")]
    frame = spark.createDataFrame(rows, "model string, id string, label int, score double")
    row = metrics.bootstrap_auc_difference(frame, [], F.col("id"), "good", "bad", 40).first()
    assert row.share_above == 1.0 and 0 < row.low <= row["mean"] <= row.high
    assert metrics.bootstrap_auc(frame.limit(0), ["model"], F.col("id"), 3).count() == 0


def test_few_rows_of_one_class_go_through(spark):
    import datetime as dt

    from tidepanel.operators import models
    from tidepanel.operators.split import date_split

    frame = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1, 0.5, None), ("A", dt.date(2024, 1, 2), 1, 0.7, None)],
                                  "ticker string, date date, target int, x double, y double")
    rows = date_split(frame, refuse=False)
    done = models.benchmark(rows, "forest", {"x": ["x"], "x + y": ["x", "y"]})
    assert {(r.model, r.stage, r.pred, r.score) for r in done.predictions.collect()} == {("x", "test", 1, 1.0), ("x + y", "test", 1, 1.0)}
    assert {r.value for r in done.per_feature.collect()} == {0.0}
    assert [r.dropped for r in models.backward_selection(rows, ["x", "y"]).collect()] == ["x"]
    none = date_split(frame.filter("target = 0"), refuse=False)
    assert selection.count_sweep(none, {"a": ["x"]}).count() == 0
    folds = durable(nested_folds(frame))
    assert selection.nested_benchmark(frame, folds, ["x", "y"], "logit", {"C": [1.0]}).count() == 0
    walks = durable(walk_forward(frame))
    oof = models.out_of_fold(frame, walks, 3, {"logit": ("logit", ["x"], {})})
    assert oof.count() == 0 and models.stack(oof, ["logit"], 2).count() == 0
