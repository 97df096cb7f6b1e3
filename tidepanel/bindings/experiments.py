"""Experiments over the region panel and the line items: nested windows, feature counts, three classes, bootstrap of AUC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.bindings.base import Tables, with_ctes
from tidepanel.bindings.features import BAND, FEATURED_SQL, FEATURES, LABELLED_SQL, SPLIT_SQL, frame
from tidepanel.bindings.fits import SETS, rounded, rows
from tidepanel.bindings.scores import D, POISSON_SQL, PREDICTIONS_SQL, REPLICATES, _row_key, predictions
from tidepanel.operators import features as fx
from tidepanel.operators import selection
from tidepanel.operators.metrics import (
    bootstrap_auc, bootstrap_auc_difference, bootstrap_auc_interval, one_vs_rest_auc, thresholds,
)
from tidepanel.operators.split import date_split, nested_folds
from tidepanel.session import durable, spread

SOURCES = {
    "price": ["return_1d", "return_5d", "return_20d", "rolling_volatility_20d"], "volume": ["volume_z"],
    "news": ["tone_z", "articles_z"], "forum": ["robust_z"], "search": ["interest_z"],
}
#: Fixed value: inverse strengths tried inside the outer windows.
STRENGTHS = {"C": [0.01, 0.1, 1.0, 10.0]}


def labelled_frame(t: Tables) -> DataFrame:
    return durable(fx.labelled(frame(t)))


def folds(t: Tables) -> DataFrame:
    return nested_folds(labelled_frame(t))


def nested_selection(t: Tables) -> DataFrame:
    labelled = labelled_frame(t)
    scored = durable(selection.single_feature_scores(labelled, durable(nested_folds(labelled)), FEATURES))
    chosen = selection.choose(scored.filter("inner >= 0"))
    return rounded(selection.outer_scores(chosen, scored.filter("inner = -1")))


def nested_windows(t: Tables) -> DataFrame:
    labelled = labelled_frame(t)
    return rounded(selection.nested_benchmark(labelled, durable(nested_folds(labelled)), FEATURES, "logit", STRENGTHS))


def feature_paths(t: Tables) -> DataFrame:
    made = selection.feature_paths(rows(t), SOURCES)
    return made.select("split", "source", "step", "feature", F.round("r2", 8).alias("r2"))


def count_sweep(t: Tables) -> DataFrame:
    return rounded(selection.count_sweep(rows(t), SOURCES))


def three_class_benchmark(t: Tables) -> DataFrame:
    classed = frame(t).withColumn("class", fx.three_class(F.col("future_return_1d"), BAND))
    return rounded(selection.three_class_benchmark(date_split(durable(classed.filter("class is not null")), refuse=False), SETS))


def class_auc(t: Tables) -> DataFrame:
    """Lines of three return flags with a score for each of them."""
    label = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(0)
    scores = F.array(F.col("l_discount"), F.col("l_extendedprice") / 131072.0, F.col("l_quantity") * F.col("l_tax"))
    lines = t.lineitem.select(F.col("l_linestatus").alias("model"), label.alias("label"), scores.alias("scores"))
    return one_vs_rest_auc(lines, ["model"], 3).select("model", "class", F.round("auc", D).alias("auc"))


def auc_replicates(t: Tables) -> DataFrame:
    made = bootstrap_auc(predictions(t, spread), ["model"], _row_key(), REPLICATES)
    return made.select("model", "replicate", F.round("auc", D).alias("auc"))


def auc_ci(t: Tables) -> DataFrame:
    made = bootstrap_auc_interval(predictions(t, spread), ["model"], _row_key(), REPLICATES)
    return made.select("model", *[F.round(c, D).alias(c) for c in ("mean", "low", "high")])


def auc_difference(t: Tables) -> DataFrame:
    made = bootstrap_auc_difference(predictions(t, spread), ["stage"], _row_key(), "price", "discount", REPLICATES)
    return made.select("stage", *[F.round(c, D).alias(c) for c in ("mean", "low", "high", "share_above")])


QUERIES = {
    "nested_folds": folds,
    "nested_selection": nested_selection,
    "nested_windows": nested_windows,
    "feature_paths": feature_paths,
    "count_sweep": count_sweep,
    "three_class_benchmark": three_class_benchmark,
    "one_vs_rest_auc": class_auc,
    "bootstrap_auc": auc_replicates,
    "bootstrap_auc_ci": auc_ci,
    "bootstrap_auc_difference": auc_difference,
}

# --- oracle ---------------------------------------------------------------------------------------

FOLDS_SQL = """, alldates AS (
  SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT date FROM lab)),
o1 AS (SELECT *, CAST(FLOOR(n * CAST(0.4 AS DOUBLE)) AS BIGINT) AS base, unnest([0, 1, 2]) AS outer_k FROM alldates),
o2 AS (SELECT *, base + outer_k * ((n - base) // 3) AS start, CASE WHEN outer_k = 2 THEN n ELSE base + (outer_k + 1) * ((n - base) // 3) END AS stop FROM o1),
o3 AS (SELECT *, GREATEST(start - 1, 0) AS known, unnest([-1, 0, 1, 2]) AS inner_k FROM o2),
o4 AS (SELECT *, CAST(FLOOR(known * CAST(0.4 AS DOUBLE)) AS BIGINT) AS ib FROM o3),
o5 AS (SELECT *, ib + inner_k * ((known - ib) // 3) AS istart, CASE WHEN inner_k = 2 THEN known ELSE ib + (inner_k + 1) * ((known - ib) // 3) END AS istop FROM o4),
folds AS (SELECT * FROM (
  SELECT date, outer_k, inner_k, CASE
    WHEN inner_k = -1 AND i < known THEN 'train' WHEN inner_k = -1 AND i >= start AND i < stop THEN 'test'
    WHEN inner_k >= 0 AND i < istart - 1 THEN 'train' WHEN inner_k >= 0 AND i >= istart AND i < istop THEN 'validation' END AS role
  FROM o5) WHERE role IS NOT NULL)"""


def _balanced(cut: str) -> str:
    return (
        f"(SUM(n) FILTER (label = 1 AND {cut}) / CAST(SUM(n) FILTER (label = 1) AS DOUBLE) + 1"
        f" - COALESCE(SUM(n) FILTER (label = 0 AND {cut}), 0) / CAST(SUM(n) FILTER (label = 0) AS DOUBLE)) / 2"
    )


_SINGLE = " UNION ALL ".join(
    f"""SELECT outer_k, inner_k, role, label, '{f} {way}' AS settings,
  1 / (1 + EXP({sign} * COALESCE(({f} - m{k}) / NULLIF(s{k}, 0), 0))) AS score FROM asked""".replace("1 / (1", "CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE)")
    for k, f in enumerate(FEATURES) for way, sign in (("up", "-1"), ("down", "1"))
)
NESTED_SQL = FEATURED_SQL + FOLDS_SQL + f""", x2 AS (SELECT lab.*, CAST(target AS INTEGER) AS label, outer_k, inner_k, role FROM lab JOIN folds USING (date)),
fit AS (SELECT outer_k, inner_k, {", ".join(f"AVG({f}) AS m{k}, STDDEV_POP({f}) AS s{k}" for k, f in enumerate(FEATURES))}
  FROM x2 WHERE role = 'train' GROUP BY 1, 2),
asked AS (SELECT * FROM x2 JOIN fit USING (outer_k, inner_k) WHERE role <> 'train'),
scored AS ({_SINGLE}),
cuts AS (SELECT CAST(unnest([{', '.join(str(c) for c in thresholds())}]) AS DOUBLE) AS threshold),
sums AS (SELECT outer_k, inner_k, settings, label, score, COUNT(*) AS n FROM scored WHERE inner_k >= 0 GROUP BY 1, 2, 3, 4, 5),
curve AS (SELECT outer_k, inner_k, settings, threshold, COALESCE({_balanced('score >= threshold')}, NULL) AS ba FROM sums, cuts GROUP BY 1, 2, 3, 4),
means AS (SELECT outer_k, settings, threshold, ROUND(AVG(ba), 12) AS ba FROM curve GROUP BY 1, 2, 3),
chosen AS (SELECT * FROM means QUALIFY ROW_NUMBER() OVER (PARTITION BY outer_k ORDER BY ba DESC NULLS LAST, threshold, settings) = 1),
tested AS (SELECT s.outer_k, s.settings, label, score, threshold, ba, 1 AS n FROM scored s JOIN chosen c ON s.outer_k = c.outer_k AND s.settings = c.settings
  WHERE inner_k = -1)
SELECT outer_k AS "outer", settings, threshold, ROUND(ba, 6) AS validation_balanced_accuracy, COUNT(*) AS test_rows,
  ROUND({_balanced('score >= threshold')}, 6) AS tuned_balanced_accuracy,
  ROUND({_balanced('score >= CAST(0.5 AS DOUBLE)')}, 6) AS default_balanced_accuracy,
  ROUND(AVG(CAST((score >= threshold) = (label = 1) AS INTEGER)), 6) AS tuned_accuracy
FROM tested GROUP BY outer_k, settings, threshold, ba"""


def _paths_sql() -> str:
    """Sweeps written out step by step over a table of covariances (split, source, i, j, c)."""
    whole = {s: " AND ".join(f"{f} IS NOT NULL" for f in [*names, "target"]) for s, names in SOURCES.items()}
    axes = [(s, a, b) for s, names in SOURCES.items() for a in [*names, "target"] for b in [*names, "target"]]
    entries = ", ".join(f"COVAR_POP({a}, {b}) FILTER ({whole[s]}) AS c{k}" for k, (s, a, b) in enumerate(axes))
    told = ", ".join(f"{{'source': '{s}', 'i': '{a}', 'j': '{b}', 'c': c{k}}}" for k, (s, a, b) in enumerate(axes))
    sql = f""", g AS (SELECT split, {entries} FROM rows GROUP BY 1),
u AS (SELECT split, unnest([{told}]) AS e FROM g),
t0 AS MATERIALIZED (SELECT split, e.source AS source, e.i AS i, e.j AS j, e.c AS c FROM u WHERE e.c IS NOT NULL)"""
    found = []
    for k in range(1, max(map(len, SOURCES.values())) + 1):
        p = f"t{k - 1}"
        sql += f""",
w{k} AS (SELECT y.split, y.source, y.i, ROUND(y.c * y.c / s.c / v.c, 12) AS gain FROM {p} y JOIN {p} s ON s.split = y.split AND s.source = y.source AND s.i = y.i AND s.j = y.i
  JOIN t0 v ON v.split = y.split AND v.source = y.source AND v.i = 'target' AND v.j = 'target' WHERE y.j = 'target' AND y.i <> 'target'),
best{k} AS (SELECT * FROM w{k} QUALIFY ROW_NUMBER() OVER (PARTITION BY split, source ORDER BY gain DESC, i) = 1),
t{k} AS MATERIALIZED (SELECT a.split, a.source, a.i, a.j, a.c - p.c * q.c / s.c AS c FROM {p} a JOIN best{k} b ON a.split = b.split AND a.source = b.source
  JOIN {p} p ON p.split = a.split AND p.source = a.source AND p.i = a.i AND p.j = b.i
  JOIN {p} q ON q.split = a.split AND q.source = a.source AND q.i = b.i AND q.j = a.j
  JOIN {p} s ON s.split = a.split AND s.source = a.source AND s.i = b.i AND s.j = b.i WHERE a.i <> b.i AND a.j <> b.i)"""
        found.append(
            f"SELECT b.split, b.source, {k} AS step, b.i AS feature, ROUND(1 - r.c / v.c, 8) AS r2 FROM best{k} b JOIN t{k} r ON r.split = b.split AND r.source = b.source "
            "AND r.i = 'target' AND r.j = 'target' JOIN t0 v ON v.split = b.split AND v.source = b.source AND v.i = 'target' AND v.j = 'target'"
        )
    return sql + " " + " UNION ALL ".join(found)


AUC_BOOT_SQL = PREDICTIONS_SQL + f""", k AS (
  SELECT model, stage, label, score, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, unnest(range({REPLICATES})) AS replicate FROM p),
h AS (SELECT model, stage, label, score, replicate, CAST('0x' || substr(md5(id || '#' || replicate // 8), CAST(4 * (replicate % 8) + 1 AS BIGINT), 4) AS INTEGER) AS u FROM k),
w AS (SELECT {{group}} AS g, model, score, replicate, SUM(CASE WHEN label = 1 THEN {POISSON_SQL} ELSE 0 END) AS pos,
    SUM(CASE WHEN label = 0 THEN {POISSON_SQL} ELSE 0 END) AS neg FROM h GROUP BY 1, 2, 3, 4),
c AS (SELECT *, SUM(neg) OVER (PARTITION BY g, model, replicate ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS below FROM w),
b AS (SELECT g, model, CAST(replicate AS INTEGER) AS replicate,
    SUM(CAST(pos AS DOUBLE) * (2 * below + neg)) / 2 / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)) AS auc FROM c GROUP BY 1, 2, 3)"""
ONE_GROUP = AUC_BOOT_SQL.format(group="''")
Q = "quantile_cont({x}, CAST({q} AS DOUBLE))"

ORACLE = {
    "nested_folds": with_ctes(
        ["panel"], LABELLED_SQL + FOLDS_SQL + ' SELECT date, outer_k AS "outer", inner_k AS "inner", role FROM folds'
    ),
    "nested_selection": with_ctes(["panel"], NESTED_SQL),
    "feature_paths": with_ctes(["panel"], FEATURED_SQL + SPLIT_SQL + _paths_sql()),
    "one_vs_rest_auc": """
WITH l AS (
  SELECT l_linestatus AS model, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS label,
    [l_discount, l_extendedprice / CAST(131072 AS DOUBLE), l_quantity * l_tax] AS s FROM lineitem),
p AS (SELECT model, c AS class, CAST(label = c AS INTEGER) AS y, s[c + 1] AS score FROM l, (VALUES (0), (1), (2)) v(c)),
m AS (SELECT *, RANK() OVER (PARTITION BY model, class ORDER BY score) + (COUNT(*) OVER (PARTITION BY model, class, score) - 1) / CAST(2 AS DOUBLE) AS mid FROM p)
SELECT model, class, ROUND((SUM(mid) FILTER (y = 1) - SUM(y) * (SUM(y) + 1) / CAST(2 AS DOUBLE)) / (CAST(SUM(y) AS DOUBLE) * SUM(1 - y)), 10) AS auc
FROM m GROUP BY 1, 2""",
    "bootstrap_auc": ONE_GROUP + " SELECT model, replicate, ROUND(auc, 10) AS auc FROM b",
    "bootstrap_auc_ci": ONE_GROUP + f""" SELECT model, ROUND(AVG(auc), 10) AS mean, ROUND({Q.format(x='auc', q=0.025)}, 10) AS low,
  ROUND({Q.format(x='auc', q=0.975)}, 10) AS high FROM b GROUP BY 1""",
    "bootstrap_auc_difference": AUC_BOOT_SQL.format(group="stage") + f""",
d AS (SELECT x.g AS stage, x.auc - y.auc AS d FROM b x JOIN b y ON x.g = y.g AND x.replicate = y.replicate WHERE x.model = 'price' AND y.model = 'discount')
SELECT stage, ROUND(AVG(d), 10) AS mean, ROUND({Q.format(x='d', q=0.025)}, 10) AS low, ROUND({Q.format(x='d', q=0.975)}, 10) AS high,
  ROUND(AVG(CAST(d > 0 AS INTEGER)), 10) AS share_above FROM d GROUP BY 1""",
}
