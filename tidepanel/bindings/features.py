"""Window, target, split and scaling queries over the region price panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.bindings.base import Tables, with_ctes
from tidepanel.bindings.joins import panel
from tidepanel.operators import features as fx
from tidepanel.operators.audit import split_summary
from tidepanel.operators.metrics import correlation, feature_correlations, rank_by_size, top_features
from tidepanel.operators.split import date_split, only_split, split_map, walk_forward
from tidepanel.operators.stats import (
    impute,
    medians,
    robust_scale,
    share_of_total,
    standardize_lazily,
)
from tidepanel.session import durable

KEYS = ["ticker", "date"]
DIGITS = 6
BAND = 0.05
ZSCORES = {
    "volume_z": ("stock_volume", 20), "tone_z": ("tone", 30), "articles_z": ("articles", 30),
    "robust_z": ("robust", 30), "interest_z": ("interest", 90),
}


def out(frame: DataFrame, *columns: str) -> DataFrame:
    """Keys and columns, doubles rounded for comparison."""
    kinds = dict(frame.dtypes)
    return frame.select(
        *KEYS, *[F.round(c, DIGITS).alias(c) if kinds[c] == "double" else F.col(c) for c in columns]
    )


def frame(t: Tables) -> DataFrame:
    """The feature frame on the panel's own column names."""
    return fx.feature_frame(panel(t), BAND, ZSCORES, ["sparse"])


FEATURES = ["return_1d", "return_5d", "return_20d", "rolling_volatility_20d", *ZSCORES]


def pct_change(t):
    return out(fx.with_returns(panel(t)), "return_1d", "return_5d", "return_20d")


def trailing_vol(t):
    w = fx.over()
    return out(
        fx.with_returns(panel(t), [1]).withColumn("vol", fx.trailing_std(F.col("return_1d"), 20, w)), "vol"
    )


def trailing_zscore(t):
    return out(fx.with_zscores(panel(t), {"z": ("sparse", 5)}), "z")


def feature_frame(t):
    return out(frame(t), *FEATURES)


def next_return(t):
    return out(
        panel(t).withColumn("r", fx.next_return(F.col("stock_price"), 1, fx.over())), "r"
    )


def banded_target(t):
    return fx.labelled(fx.with_target(panel(t), BAND)).select(*KEYS, "target")


def target_flags(t):
    return fx.with_target(panel(t), BAND).select(*KEYS, "target", "target_available", "is_neutral")


def zero_fill(t):
    return out(fx.zero_fill(panel(t), ["sparse", "tone"]), "sparse", "tone")


def labelled_rows(t) -> DataFrame:
    return durable(fx.labelled(fx.with_target(panel(t), BAND)).select(*KEYS, "target", "stock_volume", "sparse", "tone"))


def split_rows(t) -> DataFrame:
    rows = labelled_rows(t)
    return date_split(rows, refuse=False)


def date_splits(t):
    return split_rows(t).select(*KEYS, "split")


def split_semi(t):
    rows = labelled_rows(t)
    return only_split(rows, split_map(rows, refuse=False), ["train", "validation"]).select(*KEYS, "target")


def split_summaries(t):
    return split_summary(split_rows(t))


def walk_forward_folds(t):
    return walk_forward(labelled_rows(t))


def robust(t):
    return out(robust_scale(panel(t), "articles", "scaled"), "scaled")


def median_impute(t):
    rows = durable(split_rows(t))
    values = medians(rows.filter("split = 'train'"), ["sparse", "stock_volume"], unknown=None)
    return out(impute(rows, values), "sparse", "stock_volume")


def standardize(t):
    rows = durable(split_rows(t))
    return out(
        standardize_lazily(rows, ["sparse", "stock_volume"], F.col("split") == "train"),
        "sparse", "stock_volume",
    )


def share(t):
    days = panel(t).groupBy(F.year("date").alias("year"), "ticker").agg(
        F.sum("stock_volume").alias("volume")
    )
    both = share_of_total(
        share_of_total(durable(days), "volume", "share"), "volume", "share_of_year", ["year"]
    )
    return both.select(
        "year", "ticker", F.round("share", 10).alias("share"),
        F.round("share_of_year", 10).alias("share_of_year"),
    )


def lags(t):
    return out(fx.with_lags(panel(t), "tone", [1, 2, 5]), *[f"tone_lag_{k}" for k in (1, 2, 5)])


def rolling_mean(t):
    return out(
        fx.with_lag_means(panel(t), "sparse", [2, 3, 5]), *[f"sparse_mean_lag_1_{k}" for k in (2, 3, 5)]
    )


def surprise(t):
    return out(fx.with_gap_and_surprise(panel(t), "tone", 20), "tone_gap_20", "tone_surprise_20")


def delta_sign(t):
    return out(fx.with_delta(panel(t), "articles"), "articles_delta_1", "articles_direction_1")


def three_class(t):
    rows = fx.with_target(panel(t), BAND)
    return rows.withColumn("class", fx.three_class(F.col("future_return_1d"), BAND)).select(*KEYS, "class")


def horizon_5(t):
    rows = fx.with_target(panel(t), BAND, 5)
    return out(rows, "future_return_5d", "target")


def band_sweep(t):
    return fx.band_sweep(fx.with_target(panel(t), BAND), [0.01, 0.02, 0.05, 0.1, 0.2])


def presence_flags(t):
    return fx.with_presence(panel(t), "sparse").select(
        *KEYS, "sparse_present", "sparse_missing", "sparse_present_lag_1", "sparse_present_lag_2"
    )


def sentiment_class(t):
    return panel(t).select(*KEYS, fx.sentiment_class(F.col("sparse") / 100.0).alias("class"))


def prior_filled(t):
    return out(
        panel(t).withColumn("filled", fx.prior_filled(F.col("sparse"), fx.over())), "filled"
    )


def date_rank(t):
    ranked = fx.rank_within_date(fx.rank_within_date(panel(t), "stock_volume"), "sparse")
    return out(ranked, "stock_volume_rank", "sparse_rank")


def topk_features(t):
    rows = fx.labelled(durable(frame(t)))
    groups = {f: "price" if "return" in f or "vol" in f.split("_") else "other" for f in FEATURES}
    top = top_features(feature_correlations(rows, FEATURES, "target"), groups, 2)
    return top.select("source", "feature", "position", F.round("correlation", 8).alias("correlation"))


def rank_abs(t):
    rows = durable(fx.labelled(frame(t)))
    table = rows.groupBy(F.col("ticker").alias("model")).agg(
        F.array(
            *[
                F.struct(F.lit(f).alias("feature"), correlation(f, "target").alias("coefficient"))
                for f in FEATURES
            ]
        ).alias("r")
    ).select("model", F.inline("r"))
    return rank_by_size(table, "coefficient").select(
        "model", "feature", F.round("coefficient", 8).alias("coefficient"), "position"
    )


QUERIES = {
    "pct_change": pct_change,
    "trailing_vol": trailing_vol,
    "trailing_zscore": trailing_zscore,
    "feature_frame": feature_frame,
    "next_return": next_return,
    "banded_target": banded_target,
    "target_flags": target_flags,
    "zero_fill": zero_fill,
    "date_split": date_splits,
    "split_semi": split_semi,
    "split_summary": split_summaries,
    "walk_forward": walk_forward_folds,
    "robust_scale": robust,
    "median_impute": median_impute,
    "standardize": standardize,
    "share_of_total": share,
    "lags": lags,
    "rolling_mean": rolling_mean,
    "surprise": surprise,
    "delta_sign": delta_sign,
    "three_class": three_class,
    "horizon_5": horizon_5,
    "band_sweep": band_sweep,
    "presence_flags": presence_flags,
    "sentiment_class": sentiment_class,
    "prior_filled": prior_filled,
    "date_rank": date_rank,
    "topk_features": topk_features,
    "rank_abs": rank_abs,
}

W = "OVER (PARTITION BY ticker ORDER BY date)"


def before(rows: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"


def zscore_sql(x: str, rows: int) -> str:
    f = before(rows)
    return (
        f"CASE WHEN COUNT({x}) {f} = {rows} THEN ({x} - AVG({x}) {f}) "
        f"/ NULLIF(STDDEV_SAMP({x}) {f}, 0) END"
    )


def change_sql(n: int) -> str:
    return f"stock_price / LAG(stock_price, {n}) {W} - 1"


def mean_sql(x: str, rows: int) -> str:
    return f"CASE WHEN COUNT({x}) {before(rows)} = {rows} THEN AVG({x}) {before(rows)} END"


def over_panel(columns: str, tail: str = "") -> str:
    return with_ctes(["panel"], f"SELECT ticker, date, {columns} FROM panel {tail}")


RETURNS_SQL = f""", r AS (
  SELECT *, {change_sql(1)} AS return_1d, {change_sql(5)} AS return_5d, {change_sql(20)} AS return_20d,
         LEAD(stock_price, 1) {W} / stock_price - 1 AS future
  FROM panel)"""
VOL_SQL = (
    f"CASE WHEN COUNT(return_1d) {before(20)} = 20 THEN STDDEV_SAMP(return_1d) {before(20)} END"
)
FEATURE_SQL = ", ".join(
    ["return_1d", "return_5d", "return_20d", f"{VOL_SQL} AS rolling_volatility_20d"]
    + [f"{zscore_sql(x, rows)} AS {name}" for name, (x, rows) in ZSCORES.items()]
)
TARGET_SQL = f"CASE WHEN future < -{BAND}::DOUBLE THEN 0 WHEN future > {BAND}::DOUBLE THEN 1 END"
LABELLED_SQL = (
    RETURNS_SQL
    + f", x AS (SELECT *, {TARGET_SQL} AS target FROM r), lab AS (SELECT * FROM x WHERE target IS NOT NULL)"
)
FEATURED_SQL = (
    RETURNS_SQL
    + f", f AS (SELECT ticker, date, {FEATURE_SQL}, {TARGET_SQL} AS target FROM r), "
    + "lab AS (SELECT * FROM f WHERE target IS NOT NULL)"
)
SPLIT_SQL = """, dates AS (
  SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n
  FROM (SELECT DISTINCT date FROM lab)),
b1 AS (SELECT *, LEAST(GREATEST(CAST(FLOOR(n * CAST(0.8 AS DOUBLE)) AS BIGINT), 2), n - 1) AS t FROM dates),
b2 AS (SELECT *, GREATEST(t - 1, 1) AS p FROM b1),
b3 AS (SELECT *, p - LEAST(GREATEST(20, CAST(FLOOR(p * CAST(0.2 AS DOUBLE)) AS BIGINT), 1), p - 1) AS vs FROM b2),
splits AS (
  SELECT date, CASE WHEN i < GREATEST(vs - 1, 1) THEN 'train' WHEN i >= vs AND i < p THEN 'validation'
                    WHEN i >= t THEN 'test' END AS split FROM b3),
rows AS (SELECT lab.*, split FROM lab JOIN splits USING (date) WHERE split IS NOT NULL)
"""


def r(expression: str, name: str) -> str:
    return f"ROUND({expression}, {DIGITS}) AS {name}"


CORR_ROWS = " UNION ALL ".join(
    f"SELECT {{key}} '{f}' AS feature, CORR({f}, target) AS c FROM lab {{group}}" for f in FEATURES
)
GROUPS_SQL = "CASE WHEN feature LIKE '%return%' OR feature LIKE 'rolling%' OR feature = 'volume_z_' THEN 'price' ELSE 'other' END"

ORACLE = {
    "pct_change": with_ctes(
        ["panel"],
        RETURNS_SQL + f" SELECT ticker, date, {r('return_1d', 'return_1d')}, {r('return_5d', 'return_5d')}, "
        f"{r('return_20d', 'return_20d')} FROM r",
    ),
    "trailing_vol": with_ctes(["panel"], RETURNS_SQL + f" SELECT ticker, date, {r(VOL_SQL, 'vol')} FROM r"),
    "trailing_zscore": over_panel(r(zscore_sql("sparse", 5), "z")),
    "feature_frame": with_ctes(
        ["panel"],
        RETURNS_SQL + f", f AS (SELECT ticker, date, {FEATURE_SQL} FROM r) SELECT ticker, date, "
        + ", ".join(r(f, f) for f in FEATURES) + " FROM f",
    ),
    "next_return": with_ctes(["panel"], RETURNS_SQL + f" SELECT ticker, date, {r('future', 'r')} FROM r"),
    "banded_target": with_ctes(["panel"], LABELLED_SQL + " SELECT ticker, date, target FROM lab"),
    "target_flags": with_ctes(
        ["panel"],
        LABELLED_SQL + f""" SELECT ticker, date, target, future IS NOT NULL AS target_available,
       COALESCE(ABS(future) <= {BAND}::DOUBLE, FALSE) AS is_neutral FROM x""",
    ),
    "zero_fill": over_panel(f"{r('COALESCE(sparse, 0)', 'sparse')}, {r('COALESCE(tone, 0)', 'tone')}"),
    "date_split": with_ctes(["panel"], LABELLED_SQL + SPLIT_SQL + "SELECT ticker, date, split FROM rows"),
    "split_semi": with_ctes(
        ["panel"],
        LABELLED_SQL + SPLIT_SQL + "SELECT ticker, date, target FROM rows WHERE split <> 'test'",
    ),
    "split_summary": with_ctes(
        ["panel"],
        LABELLED_SQL + SPLIT_SQL + """SELECT split, COUNT(*) AS n_rows, COUNT(DISTINCT date) AS n_dates,
       MIN(date) AS date_min, MAX(date) AS date_max FROM rows GROUP BY 1""",
    ),
    "walk_forward": with_ctes(
        ["panel"],
        LABELLED_SQL + SPLIT_SQL + """, k AS (
  SELECT date, i, n, CAST(FLOOR(n * CAST(0.4 AS DOUBLE)) AS BIGINT) AS base, unnest([0, 1, 2]) AS fold FROM dates),
s AS (SELECT *, (n - base) // 3 AS size, base + fold * ((n - base) // 3) AS start FROM k),
e AS (SELECT *, CASE WHEN fold = 2 THEN n ELSE start + size END AS stop FROM s)
SELECT date, fold, CASE WHEN i < start - 1 THEN 'train' ELSE 'test' END AS role FROM e
WHERE i < start - 1 OR (i >= start AND i < stop)""",
    ),
    "robust_scale": with_ctes(
        ["panel"],
        f""", q AS (
  SELECT ticker, quantile_cont(articles, CAST(0.25 AS DOUBLE)) AS a, quantile_cont(articles, CAST(0.5 AS DOUBLE)) AS m,
         quantile_cont(articles, CAST(0.75 AS DOUBLE)) AS b FROM panel GROUP BY 1)
SELECT p.ticker, p.date, {r('(articles - m) / CASE WHEN b - a = 0 THEN 1 ELSE b - a END', 'scaled')}
FROM panel p JOIN q USING (ticker)""",
    ),
    "median_impute": with_ctes(
        ["panel"],
        LABELLED_SQL + SPLIT_SQL + f""", m AS (
  SELECT quantile_cont(sparse, CAST(0.5 AS DOUBLE)) AS a, quantile_cont(stock_volume, CAST(0.5 AS DOUBLE)) AS b
  FROM rows WHERE split = 'train')
SELECT ticker, date, {r('COALESCE(sparse, a)', 'sparse')}, {r('COALESCE(stock_volume, b)', 'stock_volume')}
FROM rows, m""",
    ),
    "standardize": with_ctes(
        ["panel"],
        LABELLED_SQL + SPLIT_SQL + f""", m AS (
  SELECT AVG(sparse) AS a, STDDEV_POP(sparse) AS sa, AVG(stock_volume) AS b, STDDEV_POP(stock_volume) AS sb
  FROM rows WHERE split = 'train')
SELECT ticker, date, {r('(sparse - a) / sa', 'sparse')}, {r('(stock_volume - b) / sb', 'stock_volume')}
FROM rows, m""",
    ),
    "share_of_total": with_ctes(
        ["panel"],
        """, v AS (SELECT CAST(year(date) AS INTEGER) AS year, ticker, SUM(stock_volume) AS volume FROM panel GROUP BY 1, 2)
SELECT year, ticker, ROUND(volume / SUM(volume) OVER (), 10) AS share,
       ROUND(volume / SUM(volume) OVER (PARTITION BY year), 10) AS share_of_year FROM v""",
    ),
    "lags": over_panel(", ".join(r(f"LAG(tone, {k}) {W}", f"tone_lag_{k}") for k in (1, 2, 5))),
    "rolling_mean": over_panel(
        ", ".join(r(mean_sql("sparse", k), f"sparse_mean_lag_1_{k}") for k in (2, 3, 5))
    ),
    "surprise": over_panel(
        r(f"tone - {mean_sql('tone', 20)}", "tone_gap_20") + ", " + r(zscore_sql("tone", 20), "tone_surprise_20")
    ),
    "delta_sign": over_panel(
        r(f"articles - LAG(articles) {W}", "articles_delta_1")
        + f", CAST(SIGN(articles - LAG(articles) {W}) AS INTEGER) AS articles_direction_1"
    ),
    "three_class": with_ctes(
        ["panel"],
        RETURNS_SQL + f""" SELECT ticker, date, CASE WHEN future < -{BAND}::DOUBLE THEN 0
       WHEN future > {BAND}::DOUBLE THEN 2 WHEN future IS NOT NULL THEN 1 END AS class FROM r""",
    ),
    "horizon_5": with_ctes(
        ["panel"],
        f""", r AS (SELECT ticker, date, LEAD(stock_price, 5) {W} / stock_price - 1 AS future FROM panel)
SELECT ticker, date, {r('future', 'future_return_5d')}, {TARGET_SQL} AS target FROM r""",
    ),
    "band_sweep": with_ctes(
        ["panel"],
        RETURNS_SQL + """, b AS (SELECT CAST(unnest([0.01, 0.02, 0.05, 0.1, 0.2]) AS DOUBLE) AS band)
SELECT band, COUNT(*) FILTER (future < -band) AS n_down, COUNT(*) FILTER (ABS(future) <= band) AS n_neutral,
       COUNT(*) FILTER (future > band) AS n_up FROM r, b GROUP BY band""",
    ),
    "presence_flags": with_ctes(
        ["panel"],
        f""", q AS (SELECT *, CAST(COALESCE(sparse > 0, FALSE) AS INTEGER) AS p FROM panel)
SELECT ticker, date, p AS sparse_present, CAST(sparse IS NULL AS INTEGER) AS sparse_missing,
       LAG(p, 1) {W} AS sparse_present_lag_1, LAG(p, 2) {W} AS sparse_present_lag_2 FROM q""",
    ),
    "sentiment_class": over_panel(
        """CASE WHEN sparse / CAST(100 AS DOUBLE) >= CAST(0.05 AS DOUBLE) THEN 'positive'
  WHEN sparse / CAST(100 AS DOUBLE) <= CAST(-0.05 AS DOUBLE) THEN 'negative'
  WHEN sparse IS NOT NULL THEN 'neutral' END AS class"""
    ),
    "prior_filled": over_panel(
        r(
            "COALESCE(sparse, AVG(sparse) OVER (PARTITION BY ticker ORDER BY date "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)", "filled",
        )
    ),
    "date_rank": over_panel(
        r("PERCENT_RANK() OVER (PARTITION BY date ORDER BY stock_volume)", "stock_volume_rank") + ", "
        + r("CASE WHEN sparse IS NOT NULL THEN PERCENT_RANK() OVER (PARTITION BY date, sparse IS NULL ORDER BY sparse) END", "sparse_rank")
    ),
    "topk_features": with_ctes(
        ["panel"],
        FEATURED_SQL + ", c AS (" + CORR_ROWS.format(key="", group="") + f"""),
g AS (SELECT *, {GROUPS_SQL} AS source FROM c),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY ABS(c) DESC, feature) AS position FROM g)
SELECT source, feature, CAST(position AS INTEGER) AS position, ROUND(c, 8) AS correlation FROM k WHERE position <= 2""",
    ),
    "rank_abs": with_ctes(
        ["panel"],
        FEATURED_SQL + ", c AS (" + CORR_ROWS.format(key="ticker AS model,", group="GROUP BY ticker") + """)
SELECT model, feature, ROUND(c, 8) AS coefficient,
       CAST(ROW_NUMBER() OVER (PARTITION BY model ORDER BY ABS(c) DESC, feature) AS INTEGER) AS position FROM c""",
    ),
}
