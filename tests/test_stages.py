"""Landed series to leaderboard; model families against known solutions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel import contract
from tidepanel.operators import models
from tidepanel.operators.split import walk_forward
from tidepanel.plans import stages

D = dt.date


def business_days(n):
    day, found = D(2023, 1, 2), []
    while len(found) < n:
        if day.weekday() < 5:
            found.append(day)
        day += dt.timedelta(1)
    return found


@pytest.fixture(scope="module")
def rows(spark):
    """Two keys, two hundred sessions, a feature that leads the next return."""
    rng = np.random.default_rng(7)
    made = []
    for key in ("A", "B"):
        signal = rng.normal(size=200)
        noise = rng.normal(size=200)
        for i, day in enumerate(business_days(200)):
            y = int(signal[i] + 0.5 * noise[i] > 0.2)
            split = "train" if i < 120 else "validation" if 121 <= i < 160 else "test" if i >= 161 else None
            if split:
                x2 = None if i % 17 == 0 else float(rng.normal())
                made.append((key, day, y, split, float(signal[i]), x2))
    frame = spark.createDataFrame(
        made, "ticker string, date date, target int, split string, x1 double, x2 double"
    )
    return frame.checkpoint()


def test_logit_matches_newton(spark, rows):
    train = rows.filter("split = 'train'").select("target", "x1").toPandas()
    x = ((train.x1 - train.x1.mean()) / train.x1.std(ddof=0)).to_numpy()
    y = train.target.to_numpy(dtype=float)
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    design, beta = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag([0.0, 1.0])
        beta += np.linalg.solve(curve, design.T @ (w * (y - p)) - np.array([0.0, beta[1]]))
    done = models.benchmark(rows.filter("split <> 'test'"), "logit", {"m": ["x1"]}, stages=["validation"])
    assert done.per_feature.first().value == pytest.approx(beta[1], rel=1e-4)
    per_key = models.fit_per_key(
        rows.filter("split = 'train'").withColumn("ticker", F.lit("all")).withColumn("label", F.col("target")), ["x1"]
    ).first()
    assert (per_key.intercept, per_key.x1) == (pytest.approx(beta[0]), pytest.approx(beta[1]))


@pytest.mark.parametrize(
    "family, settings",
    [("logit", {}), ("forest", {"trees": 10}), ("rff_svm", {"size": 64, "max_iter": 20}), ("mlp", {"max_iter": 50}), ("boosted", {"rounds": 5})],
)
def test_families_learn(rows, family, settings):
    board, done = stages.run_benchmark(
        rows, family, feature_sets={"one": ["x1"], "two": ["x1", "x2"]}, settings=settings
    )
    got = board.collect()
    assert {r.model for r in got} == {"one", "two"} and got[0].validation_balanced_accuracy >= got[1].validation_balanced_accuracy
    for r in got:
        assert r.validation_auc > 0.75 and r.test_auc > 0.75
        assert (r.train_rows, r.validation_rows, r.train_plus_validation_rows, r.test_rows) == (240, 78, 318, 78)
    assert done.predictions.count() == 2 * (78 + 78)
    if family == "mlp":
        extra = models.with_diagnostics(done, ["iterations_used", "loss_final"]).first()
        assert extra.iterations_used > 0 and 0 < got[0].dummy_validation_accuracy < 1


def test_searches(rows):
    steps = models.backward_selection(rows, ["x1", "x2"]).collect()
    assert [(r.step, r.dropped) for r in steps] == [(1, "x2")]
    grid = models.grid_search(rows, ["x1"], "logit", {"C": [0.1, 1.0]}).collect()
    assert len(grid) == 2 and {r.settings for r in grid} == {"C=0.1", "C=1.0"}
    assert models.ablation_sets(["a"], {"s": ["b"], "t": ["c"]}) == {
        "base": ["a"], "base + s": ["a", "b"], "base + t": ["a", "c"], "base + all": ["a", "b", "c"]
    }


def test_constant_features_get_no_weight(rows):
    flat = rows.withColumns({"c": F.lit(2.0), "n": F.lit(None).cast("double")})
    done = models.benchmark(flat, "logit", {"some": ["x1", "c"], "none": ["c", "n"]})
    values = {(r.model, r.feature): r.value for r in done.per_feature.collect()}
    assert values["some", "c"] == values["none", "c"] == values["none", "n"] == 0.0 != values["some", "x1"]
    got = {r.model: r.test_auc for r in done.results.collect()}
    assert got["none"] == 0.5 < got["some"]


def test_stacking_uses_only_earlier_folds(rows):
    folds = walk_forward(rows, 3)
    oof = models.out_of_fold(rows, folds, 3, {"a": ("logit", ["x1"], {}), "b": ("logit", ["x2"], {})})
    assert oof.groupBy("ticker", "date", "model").count().filter("count > 1").count() == 0
    stacked = models.stack(oof, ["a", "b"], 2)
    assert stacked.count() == oof.filter("fold = 2 and model = 'a'").count()
    assert stacked.agg(F.avg((F.col("label") == F.col("pred")).cast("double"))).first()[0] > 0.6


def test_panel_to_leaderboard(spark):
    rng = np.random.default_rng(11)
    days = business_days(260)
    prices, search, news, posts = [], [], [], []
    for key in ("AAA", "BBB"):
        price = 100.0
        for day in days:
            price *= 1 + float(rng.normal(0, 0.02))
            prices.append((key, day, price, float(rng.integers(1000, 9000))))
        for i in range((days[-1] - days[0]).days + 1):
            day = days[0] + dt.timedelta(i)
            search.append((key, day, D(2023, 1, 1), float(rng.integers(0, 100))))
            news.append((key, day, D(2023, 1, 1), float(rng.integers(0, 50)), float(rng.normal())))
            for kind in ("subm", "comm"):
                posts.append((key, kind, day, int(rng.integers(0, 9)), float(rng.normal())))
    prices = spark.createDataFrame(prices, "ticker string, date date, stock_price double, stock_volume double")
    companies = spark.createDataFrame([("AAA", "Aaa Inc"), ("BBB", "Bbb Inc")], "ticker string, company_name string")
    windows = spark.createDataFrame(news, "ticker string, date date, window_start date, articles double, tone double")
    daily = spark.createDataFrame(posts, "ticker string, kind string, date date, reddit_posts bigint, reddit_vader_mean double")
    daily = daily.withColumns(
        {m: F.lit(0.0) for m in contract.POST_METRICS if m not in ("reddit_posts", "reddit_vader_mean")}
    )
    panel = stages.build_panel(
        prices, companies, daily,
        stages.import_search(spark.createDataFrame(search, "ticker string, date date, window_start date, trends_score double")),
        stages.import_news(windows.drop("tone"), windows.drop("articles")),
    )
    assert panel.columns == contract.PANEL_COLUMNS and panel.count() == 520
    monday = panel.filter(F.weekday("date") == 0).orderBy("ticker", "date").collect()[1]
    weekend = [n for n in news if n[0] == "AAA" and monday.date - dt.timedelta(2) <= n[1] <= monday.date]
    assert monday.gdelt_articles == sum(n[3] for n in weekend)
    assert monday.gdelt_sentiment_score == pytest.approx(np.mean([n[4] for n in weekend]))
    rows = stages.modelled_rows(panel, "logit", excluded=["BBB"])
    assert [r.ticker for r in rows.select("ticker").distinct().collect()] == ["AAA"]
    board, _ = stages.run_benchmark(rows, "logit", feature_sets={"all": contract.ALL_FEATURES})
    assert board.first().n_features == 10


def test_fits_run_whole(monkeypatch):
    """The registered queries ask for all feature sets, all features and the operators' own settings."""
    from tidepanel.bindings import fits

    asked = {}

    class Stop(Exception):
        pass

    def held(name):
        def call(frame, *args, **named):
            asked[name] = (args, named)
            raise Stop

        return call

    monkeypatch.setattr(fits, "rows", lambda t: None)
    for name in ("benchmark", "backward_selection", "grid_search"):
        monkeypatch.setattr(models, name, held(name))
    for query in ("forest_benchmark", "forest_importances", "rff_svm_benchmark", "mlp_benchmark", "boosted_benchmark"):
        with pytest.raises(Stop):
            fits.QUERIES[query](None)
        args, named = asked["benchmark"]
        assert args[1] == fits.SETS and not args[2:] and "settings" not in named
    for query in ("backward_selection", "grid_search"):
        with pytest.raises(Stop):
            fits.QUERIES[query](None)
    assert asked["backward_selection"] == ((fits.FEATURES,), {})
    assert np.prod([len(v) for v in asked["grid_search"][0][2].values()]) == 48


def test_stacking_uses_every_family(monkeypatch):
    from tidepanel.bindings import fits

    seen = {}

    class Stop(Exception):
        pass

    def held(frame, folds, n, bases):
        seen.update(bases)
        raise Stop

    for name in ("durable", "walk_forward", "frame"):
        monkeypatch.setattr(fits, name, lambda *a: None)
    monkeypatch.setattr(fits.fx, "labelled", lambda f: None)
    monkeypatch.setattr(models, "out_of_fold", held)
    with pytest.raises(Stop):
        fits.QUERIES["stacking"](None)
    assert seen == {f: (f, fits.FEATURES, {}) for f in models.FAMILIES}


def test_models_of_given_keys(rows):
    frame = rows.filter("split = 'train'").withColumn("label", F.when(F.col("ticker") == "B", 1).otherwise(F.col("target")))
    got = {r.ticker: r for r in models.fit_per_key(frame, ["x1", "x2"]).collect()}
    assert got["A"].n == got["B"].n == 120 and got["A"].x1 > 0.5 and got["B"].x1 is None
    assert [r.ticker for r in models.fit_per_key(frame, ["x1"], keys=["A", "none"]).collect()] == ["A"]
