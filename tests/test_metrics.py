"""Ranks, quantiles, scaling and metrics against numpy and pair counting."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepanel.operators import metrics, ranks, stats

scored = st.lists(
    st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=40
)


def frame(spark, rows):
    return spark.createDataFrame(
        [("m", i, y, float(s)) for i, (y, s) in enumerate(rows)],
        "model string, id bigint, label int, score double",
    )


def pair_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@settings(max_examples=8, deadline=None)
@given(scored)
def test_auc_counts_pairs(spark, rows):
    got = metrics.auc(frame(spark, rows), ["model"]).first().auc
    wanted = pair_auc(rows)
    assert got == (None if wanted is None else pytest.approx(wanted))


def test_cumulative_is_exact_for_any_cuts(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[int(g)], float(v)) for g, v in zip(rng.integers(0, 2, 5000), np.round(rng.normal(size=5000), 2))]
    counts = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("m"))
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = ranks.cumulative(counts, ["g"], "v", ["m"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for r in got[::50]:
        mine = [v for g, v in rows if g == r.g]
        assert r.m_below == sum(v < r.v for v in mine) and r.m_all == len(mine)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_exact_quantiles_match_numpy(spark, xs):
    data = spark.createDataFrame([(x, None) for x in xs] + [(None, 2.0)], "x double, y double")
    got = {(r.feature, r.probability): r.quantile for r in ranks.exact_quantiles(data, ["x", "y"], [0.25, 0.5]).collect()}
    for p in (0.25, 0.5):
        assert got["x", p] == pytest.approx(np.quantile(xs, p), rel=1e-9, abs=1e-6)
        assert got["y", p] == 2.0


def test_robust_scaling(spark):
    data = spark.createDataFrame(
        [("A", x) for x in (1.0, 2.0, 4.0, 10.0)] + [("B", 5.0), ("B", 5.0)], "ticker string, x double"
    )
    for approximate in (False, True):
        got = stats.robust_scale(data, "x", "y", approximate=approximate)
        b = [r.y for r in got.filter("ticker = 'B'").collect()]
        assert b == [0.0, 0.0]
    a = sorted(r.y for r in stats.robust_scale(data, "x", "y").filter("ticker = 'A'").collect())
    assert a == pytest.approx([(x - 3.0) / 3.75 for x in (1, 2, 4, 10)])


def test_standardisation_uses_population_std(spark):
    data = spark.createDataFrame([(1.0, 1.0, 1), (3.0, 1.0, 1), (9.0, 5.0, 0)], "x double, c double, fit int")
    lazy = stats.standardize_lazily(data, ["x", "c"], F.col("fit") == 1).orderBy("x").collect()
    eager = stats.standardize(data, stats.moments(data.filter("fit = 1"), ["x", "c"])).orderBy("x").collect()
    assert [r.x for r in lazy] == [-1.0, 1.0, 7.0] == [r.x for r in eager]
    assert [r.c for r in lazy] == [0.0, 0.0, 4.0] == [r.c for r in eager]


def test_class_weights_and_shares(spark):
    data = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    got = {r.label: r.weight for r in stats.with_class_weights(data).distinct().collect()}
    assert got == {0: pytest.approx(4 / 6), 1: pytest.approx(2.0)}
    shares = stats.share_of_total(data.groupBy("label").count(), "count", "share")
    assert {r.label: r.share for r in shares.collect()} == {0: 0.75, 1: 0.25}


def test_class_metrics_by_hand(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 2 + [(0, 1)] * 4
    data = spark.createDataFrame([("m", y, p) for y, p in rows], "model string, label int, pred int")
    r = metrics.class_metrics(metrics.confusion(data, ["model"]), ["model"]).first()
    assert (r.n, r.accuracy, r.positive_rate) == (10, 0.5, 0.7)
    assert r.balanced_accuracy == pytest.approx((3 / 4 + 2 / 6) / 2)
    assert r.macro_f1 == pytest.approx((6 / 11 + 4 / 9) / 2)


def test_one_class_and_never_predicted(spark):
    one = spark.createDataFrame([("m", 1, 1), ("m", 1, 0)], "model string, label int, pred int")
    r = metrics.class_metrics(metrics.confusion(one, ["model"]), ["model"]).first()
    assert r.balanced_accuracy == 0.5
    never = spark.createDataFrame([("m", 1, 0), ("m", 0, 0)], "model string, label int, pred int")
    r = metrics.class_metrics(metrics.confusion(never, ["model"]), ["model"]).first()
    assert r.balanced_accuracy == 0.5 and r.macro_f1 == pytest.approx((2 / 3) / 2)


def test_majority_tie_takes_smaller_label(spark):
    train = spark.createDataFrame([(1,), (0,)], "label int")
    assert metrics.majority_baseline(train, train).select("pred").distinct().collect()[0].pred == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=4, max_size=40))
def test_threshold_curve(spark, rows):
    if len({y for y, _ in rows}) < 2:
        return
    data = frame(spark, [(y, s / 20) for y, s in rows])
    cuts = [0.25, 0.5, 0.75]
    curve = metrics.threshold_curve(data, ["model"], cuts)
    got = {r.threshold: r.balanced_accuracy for r in curve.collect()}
    for c in cuts:
        tpr = np.mean([s / 20 >= c for y, s in rows if y == 1])
        tnr = np.mean([s / 20 < c for y, s in rows if y == 0])
        assert got[c] == pytest.approx((tpr + tnr) / 2)
    best = metrics.best_threshold(curve, ["model"]).first()
    assert best.balanced_accuracy == max(got.values())
    assert best.threshold == min(c for c, v in got.items() if v == best.balanced_accuracy)


def test_delong_against_direct_formula(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 60)
    a, b = np.round(rng.normal(size=60) + y, 1), np.round(rng.normal(size=60) + 0.5 * y, 1)
    data = spark.createDataFrame(
        [("g", int(u), float(v), float(w)) for u, v, w in zip(y, a, b)], "g string, label int, a double, b double"
    )
    r = metrics.delong(data, ["g"], "a", "b").first()

    def components(s):
        p, n = s[y == 1], s[y == 0]
        wins = (p[:, None] > n) + 0.5 * (p[:, None] == n)
        return wins.mean(1), wins.mean(0), wins.mean()

    (va, na, auc_a), (vb, nb, auc_b) = components(a), components(b)
    variance = np.var(va - vb, ddof=1) / len(va) + np.var(na - nb, ddof=1) / len(na)
    z = (auc_a - auc_b) / math.sqrt(variance)
    assert (r.auc_a, r.auc_b) == (pytest.approx(auc_a), pytest.approx(auc_b))
    assert r.variance == pytest.approx(variance) and r.z == pytest.approx(z)
    assert r.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_bootstrap_is_repeatable_and_centred(spark):
    rng = np.random.default_rng(5)
    data = spark.createDataFrame(
        [("m", i, int(y), int(p)) for i, (y, p) in enumerate(rng.integers(0, 2, (400, 2)))],
        "model string, id bigint, label int, pred int",
    )
    first = metrics.bootstrap_interval(data, ["model"], F.col("id"), replicates=100).first()
    again = metrics.bootstrap_interval(data.repartition(7), ["model"], F.col("id"), replicates=100).first()
    assert tuple(first)[1:] == pytest.approx(tuple(again)[1:], rel=1e-12)
    point = metrics.class_metrics(metrics.confusion(data, ["model"]), ["model"]).first().balanced_accuracy
    assert first.low < point < first.high and first.mean == pytest.approx(point, abs=0.02)
    assert metrics.bootstrap_metrics(data, ["model"], F.col("id"), 11).count() == 11


def test_leaderboard_order(spark):
    rows = [("b", 0.5, 0.5, None), ("a", 0.5, 0.5, None), ("c", 0.5, 0.5, 0.1), ("d", None, 0.9, 0.9), ("e", 0.6, 0.1, 0.1)]
    table = spark.createDataFrame(
        rows, "model string, validation_balanced_accuracy double, validation_accuracy double, validation_auc double"
    )
    assert [r.model for r in metrics.leaderboard(table).collect()] == ["e", "c", "a", "b", "d"]


def test_ensemble(spark):
    rows = [("x", 1, 1, 0.9), ("y", 1, 1, 0.3), ("x", 2, 0, 0.2), ("y", 2, 0, 0.4)]
    data = spark.createDataFrame(rows, "model string, id int, label int, score double")
    got = {r.id: (round(r.score, 9), r.pred) for r in metrics.ensemble_mean(data, ["id"]).collect()}
    assert got == {1: (0.6, 1), 2: (0.3, 0)}


def test_three_classes_and_missing_scores(spark):
    cells = [("m", 0, 0, 2), ("m", 1, 1, 2), ("m", 2, 0, 1), ("m", 2, 1, 1)]
    r = metrics.class_metrics(spark.createDataFrame(cells, "model string, label int, pred int, n bigint"), ["model"]).first()
    assert r.n == 6 and r.balanced_accuracy == pytest.approx(2 / 3) and r.macro_f1 == pytest.approx((0.8 + 0.8 + 0) / 3)
    rows = [("m", 1, 0.1), ("m", 0, None), ("m", 0, 0.2), ("k", 1, 0.3), ("k", 1, None), ("k", 0, 0.2)]
    data = spark.createDataFrame(rows, "model string, label int, score double")
    assert {x.model: x.auc for x in metrics.auc(data, ["model"]).collect()} == {"m": 0.0, "k": 1.0}


def test_hashes_side_by_side_are_md5():
    keys = [f"{i}-{i % 7}".encode() for i in range(50)] + [b"", b"a\x00", b"a"] + [b"x" * n for n in range(48, 70)]
    tails = [b"#0", b"#17"]
    want = [[hashlib.md5(key + tail).digest() for tail in tails] for key in keys]
    got = metrics.md5_digests(keys, tails, rows=16)
    assert [[bytes(got[i, k]) for k in range(2)] for i in range(len(keys))] == want


def test_rows_of_one_key_are_hashed_once(monkeypatch):
    asked = []
    plain = metrics.md5_digests
    monkeypatch.setattr(metrics, "md5_digests", lambda keys, tails: asked.extend(keys) or plain(keys, tails))
    made = metrics.replicate_weights(["a", "b", "a", "a\x00"], 11, metrics.poisson_table())
    assert asked == [b"a", b"b", b"a\x00"] and (made[0] == made[2]).all()


def test_correlation_with_a_constant_is_no_error(spark):
    data = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 2.0), (1, 4.0, None)], "target int, x double, y double")
    found = {r.feature: r.correlation for r in metrics.feature_correlations(data, ["x", "y"], "target").collect()}
    assert math.isnan(found["x"]) and math.isnan(found["y"])
    up = spark.createDataFrame([(0, 1.0), (1, 3.0), (1, None), (None, 9.0)], "target int, x double")
    assert metrics.feature_correlations(up, ["x"], "target").first().correlation == pytest.approx(1.0)


def test_no_values_have_no_quantiles(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert ranks.exact_quantiles(none, ["x"], [0.5]).count() == 0
    assert stats.medians(none, ["x"]) == {"x": 0.0} and stats.medians(none, ["x"], unknown=None) == {"x": None}
    assert stats.impute(none, {"x": None}).first().x is None


def test_bootstrap_auc_pieces_join_ties():
    """Pieces of three rows, with ties inside and across them, give what one pass over all pairs gives."""
    draw = np.random.default_rng(3)
    scores = np.sort(draw.integers(0, 6, 40).astype(float))
    labels, weights = draw.integers(0, 2, 40) == 1, draw.integers(0, 9, (40, 5))
    curve = metrics._Curve(5)
    for cut in range(0, 40, 3):
        part, up = scores[cut : cut + 3], labels[cut : cut + 3, None]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        piece = weights[cut : cut + 3].astype(np.int32)
        curve.add(part[starts], *(np.add.reduceat(piece * side, starts, axis=0) for side in (up, ~up)))
    pieces = list(curve.pieces())
    assert all(values.dtype == np.int64 for piece in pieces for values in piece[2:4])
    middle = (scores > scores[0]) & (scores < scores[-1])
    p, n = weights * (labels & middle)[:, None], weights * (~labels & middle)[:, None]
    won = sum(p[i] * n[j] * (2 * (scores[j] < scores[i]) + (scores[j] == scores[i])) for i in range(40) for j in range(40))
    assert (pieces[1][2] == p.sum(axis=0)).all() and (pieces[1][3] == n.sum(axis=0)).all() and (pieces[1][4] == won).all()
    for piece, at in ((pieces[0], scores == scores[0]), (pieces[2], scores == scores[-1])):
        assert (piece[2] == weights[at & labels].sum(axis=0)).all() and (piece[3] == weights[at & ~labels].sum(axis=0)).all()


def test_hashes_of_tails_of_any_order_and_length():
    keys, tails = [b"", b"a-1", b"x" * 50, b"y" * 60], [b"#7", b"#123", b"#8"]
    got = metrics.md5_digests(keys, tails)
    assert [[bytes(d) for d in row] for row in got] == [[hashlib.md5(k + t).digest() for t in tails] for k in keys]


def test_tails_of_a_key_share_the_rounds_over_its_own_words(monkeypatch):
    work, plain = [], metrics._md5_rounds

    def counted(first, last, state, words):
        work.append((last - first) * state[0].size)
        return plain(first, last, state, words)

    monkeypatch.setattr(metrics, "_md5_rounds", counted)
    keys, tails = [f"{i}-1-{i % 13}-{i % 7}".encode() for i in range(100000, 100300)], [b"#%d" % b for b in range(25)]
    got = metrics.md5_digests(keys, tails)
    assert [[bytes(d) for d in row] for row in got] == [[hashlib.md5(k + t).digest() for t in tails] for k in keys]
    # Rounds a message: 64, less those over whole words of the key. All tails go through them in one call for each length in words.
    assert sum(work) < 62.5 * len(keys) * len(tails) and len(work) <= 4


def test_bootstrap_auc_keeps_its_ranges_and_groups_of_equal_numbers(spark, monkeypatch):
    """The tasks of the hashing are not merged, and groups whose numbers are the same stay apart."""
    draw = np.random.default_rng(4)
    rows = [(m, k, f"r{i}", int(draw.random() < 0.5), float(draw.integers(0, 9))) for i in range(120) for m, k in (("a", 1), ("b", None), (None, 1))]
    frame = spark.createDataFrame(rows, "model string, k int, id string, label int, score double")
    want = {(r.model, r.k, r.replicate): r.auc for r in metrics.bootstrap_auc(frame, ["model", "k"], F.col("id"), 9).collect()}
    monkeypatch.setattr(metrics.F, "xxhash64", lambda *columns: F.lit(7).cast("bigint"))
    made = metrics.bootstrap_auc(frame, ["model", "k"], F.col("id"), 9)
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().toString()
    got = {(r.model, r.k, r.replicate): r.auc for r in made.collect()}
    assert len(got) == 27 and got == want
