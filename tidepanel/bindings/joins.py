"""Calendar, join and roll-up queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.bindings.base import (
    Tables,
    day_rows,
    event_posts,
    fill_bounds,
    prices,
    sessions,
    with_ctes,
)
from tidepanel.operators.calendar import align_posts, fill_calendar, map_to_next_session, sessions_of
from tidepanel.operators.panel import (
    dedupe_dates,
    join_volume_tone,
    mean_duplicates,
    session_rollup,
)
from tidepanel.operators.posts import daily_metrics, fill_daily, weighted_mean
from tidepanel.session import durable
from tidepanel.sources.landing import without_keys


def panel(t: Tables) -> DataFrame:
    """Prices with the session roll-up of the calendar-day series, one row per (region, session).

    Prices feed the sessions and the panel, so this small result of the big join is kept.
    """
    p = durable(prices(t))
    rolled = session_rollup(
        day_rows(t), sessions_of(p), means=["interest", "robust", "tone"], sums=["articles"]
    )
    return p.join(rolled, ["ticker", "date"], "left").withColumn(
        "sparse", F.when(F.dayofmonth("date") % 7 != 0, F.col("tone"))
    )


def asof_forward(t: Tables) -> DataFrame:
    mapped = map_to_next_session(
        day_rows(t), sessions_of(durable(prices(t))), row_level=True
    )
    return mapped.select("l_orderkey", "l_linenumber", "ticker", "date", "session_date")


def cutoff_align(t: Tables) -> DataFrame:
    aligned = align_posts(event_posts(t), sessions(t), key=None)
    return aligned.select("id", "created_utc", "aligned_date")


def aligned_posts(t: Tables) -> DataFrame:
    from tidepanel.operators.posts import add_weights

    aligned = align_posts(event_posts(t), sessions(t), key=None)
    return add_weights(aligned)


def panel_join(t: Tables) -> DataFrame:
    return panel(t).select(
        "date", "ticker", "stock_price", "stock_volume", "interest", "articles", "robust", "tone"
    )


#: Weeks between the events and the middle of the order dates: posts keep their weekday.
SHIFT_DAYS = 10_500


def panel_contract(t: Tables) -> DataFrame:
    """The 39-column panel by the stage that builds it: both kinds of post, search, news, all regions."""
    from tidepanel.operators.posts import add_weights
    from tidepanel.plans.stages import build_panel

    regions = t.region.select("r_regionkey", F.col("r_name").alias("ticker"))
    posts = event_posts(t).drop("ticker").join(
        regions, F.pmod("event_id", F.lit(5)) == F.col("r_regionkey")
    )
    aligned = align_posts(posts, sessions(t), key=None)
    daily_posts = daily_metrics(add_weights(aligned)).withColumn("date", F.date_sub("date", SHIFT_DAYS))
    days = day_rows(t)
    search = days.select("ticker", "date", F.col("interest").alias("trends_score"))
    news = days.select(
        "ticker", "date", F.col("articles").alias("gdelt_articles"), F.col("robust").alias("gdelt_robust"),
        F.col("tone").alias("gdelt_sentiment_score"),
    )
    companies = regions.select("ticker", F.concat(F.lit("Region "), F.col("ticker")).alias("company_name"))
    made = build_panel(prices(t), companies, daily_posts, search, news)
    return made.select(
        *[F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in made.schema]
    )


def _volume_tone(t: Tables) -> tuple[DataFrame, DataFrame]:
    days = day_rows(t).groupBy("ticker", "date").agg(
        F.coalesce(F.sum("articles"), F.lit(0.0)).alias("articles"),
        F.sum("robust").alias("robust"), F.avg("tone").alias("tone"),
    )
    volume = days.filter((F.col("ticker") != "ASIA") & (F.dayofweek("date") != 4)).drop("tone")
    tone = days.filter(F.dayofmonth("date") % 7 != 0).select("ticker", "date", "tone")
    return volume, tone


def volume_tone_join(t: Tables) -> DataFrame:
    return join_volume_tone(*_volume_tone(t))


def calendar_fill(t: Tables) -> DataFrame:
    daily = daily_metrics(aligned_posts(t)).select(
        "ticker", "kind", "date", "reddit_posts", "reddit_score_sum", "reddit_vader_mean"
    )
    keys = event_posts(t).select("ticker", "kind").distinct()
    dense = fill_calendar(daily, keys, *fill_bounds(t), ["ticker", "kind"])
    return dense.select(
        "ticker", "kind", "date",
        F.coalesce("reddit_posts", F.lit(0).cast("bigint")).alias("reddit_posts"),
        F.round(F.coalesce("reddit_score_sum", F.lit(0.0)), 4).alias("reddit_score_sum"),
        F.round("reddit_vader_mean", 10).alias("reddit_vader_mean"),
    )


def anti_exclude(t: Tables) -> DataFrame:
    excluded = t.region.filter(F.col("r_regionkey") % 3 == 1).select(F.col("r_name").alias("ticker"))
    return without_keys(day_rows(t), excluded).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.sum("robust").alias("robust")
    )


METRIC_DIGITS = 8


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.select(
        *[
            F.round(c, METRIC_DIGITS).alias(c) if kind == "double" else F.col(c)
            for c, kind in frame.dtypes
        ]
    )


def daily(t: Tables) -> DataFrame:
    return _rounded(daily_metrics(aligned_posts(t)))


def daily_filled(t: Tables) -> DataFrame:
    keys = event_posts(t).select("ticker", "kind").distinct()
    return _rounded(fill_daily(daily_metrics(aligned_posts(t)), keys, *fill_bounds(t)))


def weighted(t: Tables) -> DataFrame:
    return aligned_posts(t).groupBy("ticker").agg(
        F.round(weighted_mean(F.col("vader_sentiment"), F.col("engagement_weight")), 10).alias("first"),
        F.round(weighted_mean(F.col("finbert_sentiment"), F.col("engagement_weight")), 10).alias("second"),
    )


def session_mean(t: Tables) -> DataFrame:
    return session_rollup(day_rows(t), sessions_of(durable(prices(t))), means=["interest"])


def session_rollups(t: Tables) -> DataFrame:
    return session_rollup(
        day_rows(t), sessions_of(durable(prices(t))), means=["robust", "tone"], sums=["articles"]
    )


def dup_mean(t: Tables) -> DataFrame:
    return mean_duplicates(day_rows(t), ["interest", "articles", "tone"])


def _windows(t: Tables) -> DataFrame:
    """Daily rows as if stitched from windows: the same date once per order priority."""
    return (
        t.orders.groupBy(
            F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("window_start")
        ).agg(
            F.count(F.lit(1)).alias("orders"),
            F.min("o_orderkey").alias("first_order"),
        )
        .withColumn("ticker", F.date_format("date", "yyyy"))
    )


def dedupe(keep: str):
    def query(t: Tables) -> DataFrame:
        return dedupe_dates(_windows(t), "window_start", keep)

    return query


QUERIES = {
    "asof_forward": asof_forward,
    "cutoff_align": cutoff_align,
    "panel_join": panel_join,
    "panel_contract": panel_contract,
    "volume_tone_join": volume_tone_join,
    "calendar_fill": calendar_fill,
    "anti_exclude": anti_exclude,
    "daily_metrics": daily,
    "daily_filled": daily_filled,
    "weighted_mean": weighted,
    "session_mean": session_mean,
    "session_rollup": session_rollups,
    "dup_mean": dup_mean,
    "dedupe_first": dedupe("first"),
    "dedupe_last": dedupe("last"),
}

DAILY_SQL = """
SELECT ticker, kind, aligned_date AS date, COUNT(id) AS reddit_posts,
  ROUND(SUM(w), 8) AS reddit_weight_sum, ROUND(COALESCE(SUM(score), 0), 8) AS reddit_score_sum,
  ROUND(COALESCE(SUM(num_comments), 0), 8) AS reddit_comments_sum,
  ROUND(AVG(vader_sentiment), 8) AS reddit_vader_mean,
  ROUND(COALESCE(SUM(vader_sentiment), 0), 8) AS reddit_vader_sum,
  ROUND(STDDEV_SAMP(vader_sentiment), 8) AS reddit_vader_std,
  ROUND(AVG(finbert_sentiment), 8) AS reddit_finbert_mean,
  ROUND(COALESCE(SUM(finbert_sentiment), 0), 8) AS reddit_finbert_sum,
  ROUND(STDDEV_SAMP(finbert_sentiment), 8) AS reddit_finbert_std,
  ROUND(SUM(vader_sentiment * w) / SUM(w), 8) AS reddit_vader_weighted_mean,
  ROUND(SUM(finbert_sentiment * w) / SUM(w), 8) AS reddit_finbert_weighted_mean,
  ROUND(AVG(vader_sentiment), 8) AS reddit_sent_mean,
  ROUND(COALESCE(SUM(vader_sentiment), 0), 8) AS reddit_sent_sum,
  ROUND(STDDEV_SAMP(vader_sentiment), 8) AS reddit_sent_std
FROM weighted GROUP BY 1, 2, 3"""

GRID_SQL = """
grid AS (
  SELECT k.ticker, k.kind, CAST(d AS DATE) AS date
  FROM (SELECT DISTINCT ticker, kind FROM posts) k,
       (SELECT unnest(generate_series(MIN(CAST(ts AS DATE)) - 12, MAX(CAST(ts AS DATE)) + 15, INTERVAL 1 DAY)) AS d
        FROM events))"""

DEDUPE_SQL = """
WITH w AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS window_start, COUNT(*) AS orders,
         MIN(o_orderkey) AS first_order, strftime(o_orderdate, '%Y') AS ticker
  FROM orders GROUP BY 1, 2, 5)
SELECT ticker, date, window_start, orders, first_order FROM w
QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, date ORDER BY window_start {dir}) = 1"""

POST_SQL = {
    "reddit_posts": "COUNT(id)", "reddit_weight_sum": "COALESCE(SUM(w), 0)", "reddit_score_sum": "COALESCE(SUM(score), 0)",
    "reddit_comments_sum": "COALESCE(SUM(num_comments), 0)",
} | {
    f"reddit_{name}_{part}": sql.format(column)
    for name, column in (("vader", "vader_sentiment"), ("finbert", "finbert_sentiment"), ("sent", "vader_sentiment"))
    for part, sql in (("mean", "AVG({})"), ("sum", "COALESCE(SUM({}), 0)"), ("std", "STDDEV_SAMP({})"))
} | {
    f"reddit_{name}_weighted_mean": f"SUM({name}_sentiment * w) / SUM(w)" for name in ("vader", "finbert")
}
PANEL_SQL = (
    ", g AS (SELECT r_name AS ticker, kind, aligned_date - " + str(SHIFT_DAYS) + " AS date, "
    + ", ".join(f"{sql} AS {name}" for name, sql in POST_SQL.items())
    + """ FROM weighted w JOIN region ON event_id % 5 = r_regionkey GROUP BY 1, 2, 3),
once AS (SELECT ticker, date, AVG(articles) AS a, AVG(robust) AS b, AVG(tone) AS c FROM days GROUP BY 1, 2),
news AS (SELECT o.ticker, s.session_date AS date, COALESCE(SUM(a), 0) AS a, AVG(b) AS b, AVG(c) AS c
  FROM once o ASOF JOIN sessions s ON o.ticker = s.ticker AND o.date <= s.session_date GROUP BY 1, 2)
SELECT p.date, p.ticker, 'Region ' || p.ticker AS company_name, ROUND(p.stock_price, 6) AS stock_price, ROUND(p.stock_volume, 6) AS stock_volume, """
    + ", ".join(
        (f"{k}.{m} AS {k}_{m}" if m == "reddit_posts" else f"ROUND({k}.{m}, 6) AS {k}_{m}")
        for k in ("subm", "comm") for m in POST_SQL
    )
    + """, ROUND(r.interest, 6) AS google_trends_score, ROUND(n.a, 6) AS gdelt_articles, ROUND(n.b, 6) AS gdelt_robust,
  ROUND(n.c, 6) AS gdelt_sentiment_score
FROM prices p LEFT JOIN g subm ON subm.kind = 'subm' AND subm.ticker = p.ticker AND subm.date = p.date
  LEFT JOIN g comm ON comm.kind = 'comm' AND comm.ticker = p.ticker AND comm.date = p.date
  LEFT JOIN rolled r ON r.ticker = p.ticker AND r.date = p.date LEFT JOIN news n ON n.ticker = p.ticker AND n.date = p.date"""
)

ORACLE = {
    "panel_contract": with_ctes(["prices", "rolled", "weighted"], PANEL_SQL),
    "asof_forward": with_ctes(
        ["mapped"], "SELECT l_orderkey, l_linenumber, ticker, date, session_date FROM mapped"
    ),
    "cutoff_align": with_ctes(["aligned"], "SELECT id, created_utc, aligned_date FROM aligned"),
    "panel_join": with_ctes(
        ["panel"],
        "SELECT date, ticker, stock_price, stock_volume, interest, articles, robust, tone FROM panel",
    ),
    "volume_tone_join": with_ctes(
        ["days"],
        """, d AS (
  SELECT ticker, date, COALESCE(SUM(articles), 0) AS articles, SUM(robust) AS robust,
         AVG(tone) AS tone FROM days GROUP BY 1, 2),
v AS (SELECT * FROM d WHERE ticker <> 'ASIA' AND isodow(date) <> 3),
s AS (SELECT ticker, date, tone FROM d WHERE day(date) % 7 <> 0)
SELECT v.ticker, v.date, v.articles, v.robust, s.tone
FROM v LEFT JOIN s ON v.ticker = s.ticker AND v.date = s.date
UNION ALL
SELECT ticker, date, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), tone FROM s
WHERE ticker NOT IN (SELECT ticker FROM v)""",
    ),
    "calendar_fill": with_ctes(
        ["weighted"],
        "," + GRID_SQL + """, m AS (
  SELECT ticker, kind, aligned_date AS date, COUNT(id) AS n, SUM(score) AS s, AVG(vader_sentiment) AS v
  FROM weighted GROUP BY 1, 2, 3)
SELECT g.ticker, g.kind, g.date, COALESCE(n, 0) AS reddit_posts,
       ROUND(COALESCE(s, 0), 4) AS reddit_score_sum, ROUND(v, 10) AS reddit_vader_mean
FROM grid g LEFT JOIN m USING (ticker, kind, date)""",
    ),
    "anti_exclude": with_ctes(
        ["days"],
        """SELECT ticker, COUNT(*) AS n, SUM(robust) AS robust FROM days
WHERE ticker NOT IN (SELECT r_name FROM region WHERE r_regionkey % 3 = 1) GROUP BY 1""",
    ),
    "daily_metrics": with_ctes(["weighted"], DAILY_SQL),
    "daily_filled": with_ctes(
        ["weighted"],
        "," + GRID_SQL + ", m AS (" + DAILY_SQL + """)
SELECT * REPLACE (
  COALESCE(reddit_posts, 0) AS reddit_posts,
  COALESCE(reddit_weight_sum, 0) AS reddit_weight_sum,
  COALESCE(reddit_score_sum, 0) AS reddit_score_sum,
  COALESCE(reddit_comments_sum, 0) AS reddit_comments_sum,
  COALESCE(reddit_vader_sum, 0) AS reddit_vader_sum,
  COALESCE(reddit_finbert_sum, 0) AS reddit_finbert_sum,
  COALESCE(reddit_sent_sum, 0) AS reddit_sent_sum)
FROM grid LEFT JOIN m USING (ticker, kind, date)""",
    ),
    "weighted_mean": with_ctes(
        ["weighted"],
        """SELECT ticker, ROUND(SUM(vader_sentiment * w) / SUM(w), 10) AS first,
       ROUND(SUM(finbert_sentiment * w) / SUM(w), 10) AS second FROM weighted GROUP BY 1""",
    ),
    "session_mean": with_ctes(["rolled"], "SELECT ticker, date, interest FROM rolled"),
    "session_rollup": with_ctes(["rolled"], "SELECT ticker, date, robust, tone, articles FROM rolled"),
    "dup_mean": with_ctes(
        ["days"],
        """SELECT ticker, date, AVG(interest) AS interest, AVG(articles) AS articles, AVG(tone) AS tone
FROM days GROUP BY 1, 2""",
    ),
    "dedupe_first": DEDUPE_SQL.format(dir="ASC"),
    "dedupe_last": DEDUPE_SQL.format(dir="DESC"),
}
