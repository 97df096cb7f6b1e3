"""Metric queries: predictions made from the line items, labels joined with documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.bindings.base import Tables
from tidepanel.operators.metrics import (
    all_metrics,
    auc,
    best_threshold,
    bootstrap_interval,
    bootstrap_metrics,
    class_metrics,
    confusion,
    delong,
    ensemble_mean,
    leaderboard,
    majority_baseline,
    threshold_curve,
    thresholds,
)
from tidepanel.operators.models import wide_results
from tidepanel.operators.stats import class_weights, with_class_weights
from tidepanel.session import durable, spread

D = 10
REPLICATES = 200


def predictions(t: Tables, layout: Callable[[DataFrame], DataFrame] = lambda table: table) -> DataFrame:
    """Two scores for every line item against its return flag: one near-continuous, one with ties."""
    models = F.array(
        F.struct(F.lit("price").alias("model"), (F.col("l_extendedprice") / 131072.0).alias("score")),
        F.struct(F.lit("discount").alias("model"), (F.col("l_discount") * 9.0).alias("score")),
    )
    lines = layout(t.lineitem).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.when(F.pmod("l_orderkey", F.lit(3)) == 0, "test").otherwise("validation").alias("stage"),
        F.inline(models),
    )
    return lines.withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def text_scores(t: Tables) -> DataFrame:
    """Labelled documents with two scores, long by model."""
    size = F.col("n_chars").cast("double")
    letters = size - F.length(F.regexp_replace("text", "e", ""))
    models = F.array(
        F.struct(F.lit("a").alias("model"), (size / (size + 1500.0)).alias("score")),
        F.struct(F.lit("b").alias("model"), (letters * 4.0 / size).alias("score")),
    )
    return t.labels.join(t.documents, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.inline(models)
    )


def _metric(*names: str):
    def query(t: Tables) -> DataFrame:
        made = class_metrics(confusion(predictions(t), ["model"]), ["model"])
        return made.select("model", *[F.round(n, D).alias(n) if n != "n" else F.col(n) for n in names])

    return query


def auc_query(t: Tables) -> DataFrame:
    return auc(predictions(t), ["model"]).select("model", F.round("auc", D).alias("auc"))


def majority(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"), "l_linestatus"
    )
    rows = majority_baseline(lines.filter("l_linestatus = 'F'"), lines.filter("l_linestatus = 'O'"))
    return class_metrics(confusion(rows, ["l_linestatus"]), ["l_linestatus"]).select(
        "n", F.round("accuracy", D).alias("accuracy"),
        F.round("balanced_accuracy", D).alias("balanced_accuracy"),
    )


def three_class_metrics(t: Tables) -> DataFrame:
    """Lines whose return flag stands for one of three classes, predicted from the line's number."""
    label = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(0)
    rows = t.lineitem.select(
        F.col("l_linestatus").alias("model"), label.alias("label"), F.pmod("l_linenumber", F.lit(3)).cast("int").alias("pred")
    )
    names = ["accuracy", "balanced_accuracy", "positive_rate", "macro_f1"]
    made = class_metrics(confusion(rows, ["model"]), ["model"])
    return made.select("model", "n", *[F.round(c, D).alias(c) for c in names])


def weights(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_returnflag").alias("label"), F.pmod("l_orderkey", F.lit(10)).alias("k"))
    skewed = lines.withColumn("label", F.when(F.col("k") < 4, "N").otherwise(F.col("label")))
    per_row = with_class_weights(skewed).groupBy("label").agg(
        F.max("weight").alias("row_weight"), F.count(F.lit(1)).alias("rows")
    )
    return class_weights(skewed).join(per_row, "label").select(
        "label", "n", "rows", F.round("weight", D).alias("weight"), F.round("row_weight", D).alias("row_weight")
    )


def threshold_tune(t: Tables) -> DataFrame:
    best = best_threshold(threshold_curve(predictions(t), ["model"], thresholds()), ["model"])
    return best.select(
        "model", "threshold", F.round("balanced_accuracy", D).alias("balanced_accuracy")
    )


def threshold_curves(t: Tables) -> DataFrame:
    return threshold_curve(predictions(t), ["model"], thresholds()).select(
        "model", "threshold", F.round("balanced_accuracy", D).alias("balanced_accuracy")
    )


def _row_key():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def bootstrap(t: Tables) -> DataFrame:
    made = bootstrap_metrics(predictions(t, spread), ["model"], _row_key(), REPLICATES)
    return made.select(
        "model", "replicate", F.col("n").cast("bigint").alias("n"),
        F.round("accuracy", D).alias("accuracy"), F.round("balanced_accuracy", D).alias("balanced_accuracy"),
    )


def bootstrap_ci(t: Tables) -> DataFrame:
    made = bootstrap_interval(predictions(t, spread), ["model"], _row_key(), replicates=REPLICATES)
    return made.select("model", *[F.round(c, D).alias(c) for c in ("mean", "low", "high")])


def delong_query(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_extendedprice") / 131072.0).alias("a"),
        (F.col("l_discount") * 9.0).alias("b"),
    )
    made = delong(rows, ["l_linestatus"], "a", "b")
    return made.select(
        "l_linestatus", F.round("auc_a", D).alias("auc_a"), F.round("auc_b", D).alias("auc_b"),
        F.round(F.col("variance") * 1e6, 6).alias("variance_millionths"),
        F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value"),
    )


def ensemble(t: Tables) -> DataFrame:
    return ensemble_mean(text_scores(t), ["doc_id"]).select(
        "doc_id", "label", F.round("score", D).alias("score"), "pred"
    )


def leaderboard_query(t: Tables) -> DataFrame:
    third = F.pmod("l_orderkey", F.lit(3))
    split = F.when(third == 0, "test").when(third == 1, "train").otherwise("validation")
    lines = durable(predictions(t).withColumn("split", split))
    base, rows = lines.filter("model = 'price'").select("split", "label"), lines.filter("split <> 'train'")
    wide = leaderboard(wide_results(rows, base, {"price": 1, "discount": 1}, ["validation", "test"]))
    kinds = dict(wide.dtypes)
    return wide.select(
        *[F.round(c, D).alias(c) if kinds[c] == "double" else F.col(c) for c in wide.columns]
    )


def text_metrics(t: Tables) -> DataFrame:
    rows = durable(text_scores(t).withColumn("pred", (F.col("score") >= 0.5).cast("int")))
    made = all_metrics(rows, ["model"])
    return made.select(
        "model", "n", *[F.round(c, D).alias(c) for c in made.columns if c not in ("model", "n")]
    )


QUERIES = {
    "accuracy": _metric("n", "accuracy"),
    "balanced_accuracy": _metric("balanced_accuracy"),
    "positive_rate": _metric("positive_rate"),
    "macro_f1": _metric("macro_f1"),
    "auc": auc_query,
    "three_class_metrics": three_class_metrics,
    "text_metrics": text_metrics,
    "majority_baseline": majority,
    "class_weights": weights,
    "threshold_tune": threshold_tune,
    "threshold_curve": threshold_curves,
    "bootstrap_metrics": bootstrap,
    "bootstrap_ci": bootstrap_ci,
    "delong": delong_query,
    "ensemble_mean": ensemble,
    "leaderboard": leaderboard_query,
}

PREDICTIONS_SQL = """
WITH base AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_returnflag = 'R' AS INTEGER) AS label,
    CASE WHEN l_orderkey % 3 = 0 THEN 'test' ELSE 'validation' END AS stage,
    l_extendedprice / CAST(131072 AS DOUBLE) AS a, l_discount * CAST(9 AS DOUBLE) AS b FROM lineitem),
p AS (
  SELECT *, CAST(score >= CAST(0.5 AS DOUBLE) AS INTEGER) AS pred FROM (
    SELECT *, 'price' AS model, a AS score FROM base UNION ALL SELECT *, 'discount', b FROM base))"""
TEXT_SQL = """
WITH base AS (
  SELECT doc_id, quality AS label, CAST(n_chars AS DOUBLE) AS n,
         CAST(n_chars AS DOUBLE) - length(replace(text, 'e', '')) AS e FROM labels JOIN documents USING (doc_id)),
p AS (
  SELECT *, CAST(score >= CAST(0.5 AS DOUBLE) AS INTEGER) AS pred FROM (
    SELECT doc_id, label, 'a' AS model, n / (n + CAST(1500 AS DOUBLE)) AS score FROM base
    UNION ALL SELECT doc_id, label, 'b', e * CAST(4 AS DOUBLE) / n FROM base))"""


def recall_sql(w: str = "1") -> str:
    return (
        f"(SUM({w}) FILTER (label = 1 AND pred = 1) / CAST(SUM({w}) FILTER (label = 1) AS DOUBLE) + "
        f"SUM({w}) FILTER (label = 0 AND pred = 0) / CAST(SUM({w}) FILTER (label = 0) AS DOUBLE)) / 2"
    )


F1_SQL = " + ".join(
    f"2 * COUNT(*) FILTER (label = {c} AND pred = {c}) / "
    f"CAST(COUNT(*) FILTER (label = {c}) + COUNT(*) FILTER (pred = {c}) AS DOUBLE)" for c in (0, 1)
)
ACC = "AVG(CAST(label = pred AS INTEGER))"


def auc_sql(by: str) -> str:
    """Rank-sum with mid-ranks."""
    return f"""
  SELECT {by}, (SUM(mid) FILTER (label = 1) - np * (np + 1) / 2) / (np * nn) AS auc FROM (
    SELECT {by}, label, RANK() OVER (PARTITION BY {by} ORDER BY score)
        + (COUNT(*) OVER (PARTITION BY {by}, score) - 1) / CAST(2 AS DOUBLE) AS mid,
      CAST(SUM(label) OVER (PARTITION BY {by}) AS DOUBLE) AS np,
      CAST(SUM(1 - label) OVER (PARTITION BY {by}) AS DOUBLE) AS nn FROM p)
  GROUP BY {by}, np, nn"""


CURVE_SQL = PREDICTIONS_SQL + f""", t AS (
  SELECT CAST(unnest([{', '.join(str(c) for c in thresholds())}]) AS DOUBLE) AS threshold),
g AS (SELECT model, label, score, COUNT(*) AS n FROM p GROUP BY 1, 2, 3),
c AS (
  SELECT model, threshold, ROUND((
      SUM(n) FILTER (label = 1 AND score >= threshold) / CAST(SUM(n) FILTER (label = 1) AS DOUBLE)
    + 1 - COALESCE(SUM(n) FILTER (label = 0 AND score >= threshold), 0) / CAST(SUM(n) FILTER (label = 0) AS DOUBLE)) / 2, 10)
      AS balanced_accuracy
  FROM g, t GROUP BY 1, 2)"""
# cumulative Poisson(1) probabilities times 65536
POISSON_SQL = "(" + " + ".join(
    f"CAST(u >= {s} AS INTEGER)" for s in (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535)
) + ")"
BOOT_SQL = PREDICTIONS_SQL + f""", k AS (
  SELECT model, label, pred, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
         unnest(range({REPLICATES})) AS replicate FROM p),
h AS (SELECT model, label, pred, replicate,
        CAST('0x' || substr(md5(id || '#' || replicate // 8), CAST(4 * (replicate % 8) + 1 AS BIGINT), 4) AS INTEGER) AS u FROM k),
w AS (SELECT model, label, pred, replicate, {POISSON_SQL} AS w FROM h),
b AS (
  SELECT model, CAST(replicate AS INTEGER) AS replicate, CAST(SUM(w) AS BIGINT) AS n,
    SUM(w) FILTER (label = pred) / CAST(SUM(w) AS DOUBLE) AS accuracy, {recall_sql('w')} AS balanced_accuracy
  FROM w GROUP BY 1, 2)"""

ORACLE = {
    "three_class_metrics": """
WITH r AS (
  SELECT l_linestatus AS model, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS label, l_linenumber % 3 AS pred
  FROM lineitem),
k AS (SELECT model, c, COUNT(*) FILTER (label = c) AS lab, COUNT(*) FILTER (pred = c) AS pre, COUNT(*) FILTER (label = c AND pred = c) AS hit
  FROM r, (VALUES (0), (1), (2)) v(c) GROUP BY 1, 2)
SELECT model, CAST(SUM(lab) AS BIGINT) AS n, ROUND(CAST(SUM(hit) AS DOUBLE) / SUM(lab), 10) AS accuracy,
  ROUND(AVG(CASE WHEN lab > 0 THEN CAST(hit AS DOUBLE) / lab END), 10) AS balanced_accuracy,
  ROUND(CAST(SUM(pre) FILTER (c = 1) AS DOUBLE) / SUM(lab), 10) AS positive_rate,
  ROUND(AVG(CASE WHEN lab + pre > 0 THEN CAST(2 * hit AS DOUBLE) / (lab + pre) END), 10) AS macro_f1
FROM k GROUP BY 1""",
    "accuracy": PREDICTIONS_SQL + f" SELECT model, COUNT(*) AS n, ROUND({ACC}, 10) AS accuracy FROM p GROUP BY 1",
    "balanced_accuracy": PREDICTIONS_SQL
    + f" SELECT model, ROUND({recall_sql()}, 10) AS balanced_accuracy FROM p GROUP BY 1",
    "positive_rate": PREDICTIONS_SQL + " SELECT model, ROUND(AVG(pred), 10) AS positive_rate FROM p GROUP BY 1",
    "macro_f1": PREDICTIONS_SQL + f" SELECT model, ROUND(({F1_SQL}) / 2, 10) AS macro_f1 FROM p GROUP BY 1",
    "auc": PREDICTIONS_SQL + f" SELECT model, ROUND(auc, 10) AS auc FROM ({auc_sql('model')})",
    "text_metrics": TEXT_SQL + f""", m AS (
  SELECT model, COUNT(*) AS n, ROUND({ACC}, 10) AS accuracy, ROUND({recall_sql()}, 10) AS balanced_accuracy,
    ROUND(AVG(pred), 10) AS positive_rate, ROUND(({F1_SQL}) / 2, 10) AS macro_f1 FROM p GROUP BY 1)
SELECT m.*, ROUND(auc, 10) AS auc FROM m JOIN ({auc_sql('model')}) USING (model)""",
    "majority_baseline": """
WITH l AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, l_linestatus FROM lineitem),
m AS (SELECT label AS pred FROM l WHERE l_linestatus = 'F' GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)
SELECT COUNT(*) AS n, ROUND(AVG(CAST(label = pred AS INTEGER)), 10) AS accuracy, CAST(0.5 AS DOUBLE) AS balanced_accuracy
FROM l, m WHERE l_linestatus = 'O'""",
    "class_weights": """
WITH c AS (
  SELECT CASE WHEN l_orderkey % 10 < 4 THEN 'N' ELSE l_returnflag END AS label, COUNT(*) AS n FROM lineitem GROUP BY 1)
SELECT label, n, n AS rows, ROUND(SUM(n) OVER () / CAST(COUNT(*) OVER () * n AS DOUBLE), 10) AS weight,
       ROUND(SUM(n) OVER () / CAST(COUNT(*) OVER () * n AS DOUBLE), 10) AS row_weight FROM c""",
    "threshold_tune": CURVE_SQL + """
SELECT model, threshold, balanced_accuracy FROM c
QUALIFY ROW_NUMBER() OVER (PARTITION BY model ORDER BY balanced_accuracy DESC, threshold) = 1""",
    "threshold_curve": CURVE_SQL + " SELECT model, threshold, balanced_accuracy FROM c",
    "bootstrap_metrics": BOOT_SQL + """
SELECT model, replicate, n, ROUND(accuracy, 10) AS accuracy, ROUND(balanced_accuracy, 10) AS balanced_accuracy FROM b""",
    "bootstrap_ci": BOOT_SQL + """
SELECT model, ROUND(AVG(balanced_accuracy), 10) AS mean,
  ROUND(quantile_cont(balanced_accuracy, CAST(0.025 AS DOUBLE)), 10) AS low,
  ROUND(quantile_cont(balanced_accuracy, CAST(0.975 AS DOUBLE)), 10) AS high FROM b GROUP BY 1""",
    "delong": """
WITH l AS (
  SELECT l_linestatus AS g, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_extendedprice / CAST(131072 AS DOUBLE) AS a,
         l_discount * CAST(9 AS DOUBLE) AS b FROM lineitem),
v AS (SELECT g, y, """ + ", ".join(
        f"""((RANK() OVER (PARTITION BY g ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY g, {x}) - 1) / CAST(2 AS DOUBLE))
  - (RANK() OVER (PARTITION BY g, y ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY g, y, {x}) - 1) / CAST(2 AS DOUBLE)))
  / (COUNT(*) OVER (PARTITION BY g) - COUNT(*) OVER (PARTITION BY g, y)) AS v{x}""" for x in "ab"
    ) + """ FROM l),
w AS (SELECT g, y, CASE WHEN y = 1 THEN va ELSE 1 - va END AS va, CASE WHEN y = 1 THEN vb ELSE 1 - vb END AS vb FROM v),
s AS (
  SELECT g, AVG(va) FILTER (y = 1) AS auc_a, AVG(vb) FILTER (y = 1) AS auc_b,
    VAR_SAMP(va - vb) FILTER (y = 1) / COUNT(*) FILTER (y = 1) + VAR_SAMP(va - vb) FILTER (y = 0) / COUNT(*) FILTER (y = 0) AS var
  FROM w GROUP BY 1),
z AS (SELECT *, (auc_a - auc_b) / sqrt(var) AS z FROM s)
SELECT g AS l_linestatus, ROUND(auc_a, 10) AS auc_a, ROUND(auc_b, 10) AS auc_b,
  ROUND(var * CAST(1000000 AS DOUBLE), 6) AS variance_millionths, ROUND(z, 6) AS z,
  ROUND(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60),
    lambda k: pow(-1, k) * pow(abs(z) / sqrt(2), 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))), 6) AS p_value
FROM z""",
    "ensemble_mean": TEXT_SQL + """
SELECT doc_id, label, ROUND(AVG(score), 10) AS score, CAST(AVG(score) >= 0.5 AS INTEGER) AS pred FROM p GROUP BY 1, 2""",
    "leaderboard": PREDICTIONS_SQL.replace("WITH base", "WITH whole").replace("FROM lineitem)", """FROM lineitem),
base AS (SELECT * FROM whole WHERE l_orderkey % 3 <> 1)""") + f""", m AS (
  SELECT model, stage, COUNT(*) AS n, ROUND({ACC}, 10) AS acc, ROUND({recall_sql()}, 10) AS ba,
         ROUND(AVG(pred), 10) AS pos FROM p GROUP BY 1, 2),
k AS (SELECT COUNT(*) AS n FROM lineitem WHERE l_orderkey % 3 = 1),
s AS (SELECT model, stage, m.n, acc, ba, pos, ROUND(auc, 10) AS auc FROM m JOIN ({auc_sql('model, stage')}) USING (model, stage))
SELECT v.model, 1 AS n_features, k.n AS train_rows, v.n AS validation_rows, k.n + v.n AS train_plus_validation_rows,
  t.n AS test_rows, v.acc AS validation_accuracy, v.ba AS validation_balanced_accuracy, v.auc AS validation_auc,
  v.pos AS validation_positive_rate, t.acc AS test_accuracy, t.ba AS test_balanced_accuracy, t.auc AS test_auc,
  t.pos AS test_positive_rate
FROM s v JOIN s t USING (model), k WHERE v.stage = 'validation' AND t.stage = 'test'""",
}
