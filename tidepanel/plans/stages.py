"""The stages from landed files to a leaderboard, each one plan over all keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.contract import NEUTRAL_BAND, PANEL_COLUMNS, VALIDATION_FRACTION, ZSCORES
from tidepanel.operators import models
from tidepanel.operators.calendar import sessions_of
from tidepanel.operators.features import feature_frame, labelled
from tidepanel.operators.metrics import leaderboard
from tidepanel.operators.panel import (
    dedupe_dates,
    join_panel,
    join_volume_tone,
    mean_duplicates,
    prefix_metrics,
    session_rollup,
)
from tidepanel.operators.posts import (
    daily_metrics,
    enrich_posts,
    fill_daily,
    in_window,
    match_keywords,
    union_kinds,
)
from tidepanel.operators.split import date_split
from tidepanel.operators.stats import robust_scale


def import_posts(
    subm: DataFrame,
    comm: DataFrame,
    keywords: dict[str, list[str]],
    sessions: DataFrame,
    lexicon: DataFrame,
    start,
    end,
    factory: Callable | None = None,
    required: bool = False,
    session_key: str | None = "ticker",
) -> tuple[DataFrame, DataFrame]:
    """Matched, enriched posts and their dense daily metrics, all keys in one pass over the dump.

    ``subm`` and ``comm`` are unified posts. Returns (posts, daily).
    """
    spark = subm.sparkSession
    posts = in_window(union_kinds(subm, comm), start, end)
    enriched = enrich_posts(match_keywords(posts, keywords), sessions, lexicon, factory, required, session_key)
    wanted = spark.createDataFrame(
        [(key, kind) for key in keywords for kind in ("subm", "comm")], "ticker string, kind string"
    )
    return enriched, fill_daily(daily_metrics(enriched), wanted, start, end)


def import_news(volume: DataFrame, tone: DataFrame, order: str = "window_start") -> DataFrame:
    """Stitched news windows to a daily series: keep-last dedupe, robust score, tone joined on."""
    articles = dedupe_dates(volume, order, "last").select("ticker", "date", "articles")
    scaled = robust_scale(articles, "articles", "robust")
    tones = dedupe_dates(tone, order, "last").select("ticker", "date", "tone")
    return join_volume_tone(scaled, tones).withColumnsRenamed(
        {"articles": "gdelt_articles", "robust": "gdelt_robust", "tone": "gdelt_sentiment_score"}
    )


def import_search(windows: DataFrame, order: str = "window_start") -> DataFrame:
    """Stitched search-interest windows to a daily series: keep-first dedupe."""
    return dedupe_dates(windows, order, "first").select("ticker", "date", "trends_score")


def build_panel(
    prices: DataFrame, companies: DataFrame, daily_posts: DataFrame, search: DataFrame, news: DataFrame
) -> DataFrame:
    """The 39-column panel. ``daily_posts`` has a ``kind``; search and news are calendar-day series."""
    sessions = sessions_of(prices)
    named = prices.join(companies.select("ticker", "company_name"), "ticker", "left")
    kinds = {
        kind: prefix_metrics(daily_posts.filter(F.col("kind") == kind).drop("kind"), kind)
        for kind in ("subm", "comm")
    }
    interest = session_rollup(
        search.withColumnRenamed("trends_score", "google_trends_score"), sessions,
        means=["google_trends_score"],
    )
    once = mean_duplicates(news, ["gdelt_articles", "gdelt_robust", "gdelt_sentiment_score"])
    tone = session_rollup(
        once, sessions, means=["gdelt_robust", "gdelt_sentiment_score"], sums=["gdelt_articles"]
    )
    return join_panel(named, kinds["subm"], kinds["comm"], interest, tone, order=PANEL_COLUMNS)


def modelled_rows(
    panel: DataFrame,
    family: str = "logit",
    excluded: list[str] = (),
    band: float = NEUTRAL_BAND,
    zscores: dict = ZSCORES,
    **split_settings,
) -> DataFrame:
    """Features over whole histories, then only labelled rows, then the date split on those."""
    kept = panel.filter(~F.col("ticker").isin(list(excluded))) if excluded else panel
    rows = labelled(feature_frame(kept, band, zscores))
    fraction = split_settings.pop("validation_fraction", VALIDATION_FRACTION[family])
    return date_split(rows, validation_fraction=fraction, **split_settings)


def run_benchmark(rows: DataFrame, family: str = "logit", **options) -> tuple[DataFrame, models.Benchmark]:
    """Leaderboard and the benchmark behind it."""
    done = models.benchmark(rows, family, **options)
    return leaderboard(done.results), done
