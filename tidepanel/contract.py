"""Column contracts and defaults of the panel. Names and numbers users rely on."""

from __future__ import annotations

# --- fixed values: columns of a unified post -------------------------------------------------
POST_COLUMNS = [
    "id", "date_utc", "created_utc", "subreddit", "title", "selftext",
    "score", "num_comments", "permalink", "url",
]

# --- fixed values: the 15 daily post metrics, in file order ----------------------------------
POST_METRICS = [
    "reddit_posts", "reddit_weight_sum", "reddit_score_sum", "reddit_comments_sum",
    "reddit_vader_mean", "reddit_vader_sum", "reddit_vader_std",
    "reddit_finbert_mean", "reddit_finbert_sum", "reddit_finbert_std",
    "reddit_vader_weighted_mean", "reddit_finbert_weighted_mean",
    "reddit_sent_mean", "reddit_sent_sum", "reddit_sent_std",
]

# --- fixed values: the panel -------------------------------------------------------------------
POST_KINDS = ["subm", "comm"]
NEWS_METRICS = ["gdelt_articles", "gdelt_robust", "gdelt_sentiment_score"]
PANEL_COLUMNS = (
    ["date", "ticker", "company_name", "stock_price", "stock_volume"]
    + [f"{kind}_{metric}" for kind in POST_KINDS for metric in POST_METRICS]
    + ["google_trends_score"]
    + NEWS_METRICS
)
ALIGNMENT_POLICY = "calendar-day alternative data mapped to same or next trading session"

# --- fixed values: exchange clock and window lengths of the landed sources -------------------
EXCHANGE_ZONE = "America/New_York"
EXCHANGE_OPEN = "09:30:00"
POST_LOOKBACK_DAYS = 7
SEARCH_WINDOW_DAYS = 200
NEWS_WINDOW_DAYS = 30
SCORER_BATCH = 32

# --- fixed values: features -------------------------------------------------------------------
PRICE_FEATURES = ["return_1d", "return_5d", "return_20d", "rolling_volatility_20d"]
VOLUME_FEATURES = ["volume_zscore_20d"]
NEWS_FEATURES = ["gdelt_sentiment_zscore_30d", "gdelt_article_count_zscore_30d"]
FORUM_FEATURES = ["reddit_sentiment_zscore_30d", "reddit_comment_count_zscore_30d"]
SEARCH_FEATURES = ["google_trends_zscore_90d"]
ALL_FEATURES = PRICE_FEATURES + VOLUME_FEATURES + NEWS_FEATURES + FORUM_FEATURES + SEARCH_FEATURES

# output column -> (source column, rows before the current one)
ZSCORES = {
    "volume_zscore_20d": ("stock_volume", 20),
    "gdelt_sentiment_zscore_30d": ("gdelt_sentiment_score", 30),
    "gdelt_article_count_zscore_30d": ("gdelt_articles", 30),
    "reddit_sentiment_zscore_30d": ("comm_reddit_vader_mean", 30),
    "reddit_comment_count_zscore_30d": ("comm_reddit_posts", 30),
    "google_trends_zscore_90d": ("google_trends_score", 90),
}

NESTED_FEATURE_SETS = {
    "Model A - price only": PRICE_FEATURES,
    "Model B - price + volume": PRICE_FEATURES + VOLUME_FEATURES,
    "Model C - price + volume + GDELT": PRICE_FEATURES + VOLUME_FEATURES + NEWS_FEATURES,
    "Model D - price + volume + GDELT + Reddit":
        PRICE_FEATURES + VOLUME_FEATURES + NEWS_FEATURES + FORUM_FEATURES,
    "Model E - price + volume + all alternative data": ALL_FEATURES,
}
# The linear and the neural benchmark look at two more sets than the forest and the SVM.
FEATURE_SETS = NESTED_FEATURE_SETS | {
    "Model Extra - price + gdelt": PRICE_FEATURES + NEWS_FEATURES,
    "Model Extra 2 - price + reddit": PRICE_FEATURES + FORUM_FEATURES,
}

# --- fixed values: benchmark settings ----------------------------------------------------------
NEUTRAL_BAND = 0.005
TEST_SIZE = 0.20
VALIDATION_FRACTION = {"logit": 0.20, "mlp": 0.20, "forest": 0.15, "rff_svm": 0.15, "boosted": 0.20}
MIN_VALIDATION_DATES = 20
GAP_DATES = 1

# --- fixed values: ticker group and profiles ----------------------------------------------------
TICKER_GROUPS = {
    "big_tech_10": [
        "NVDA", "MSFT", "AAPL", "AMD", "TSLA", "NFLX", "AMZN", "GOOGL", "META", "AVGO",
    ],
}
# ticker, company name, search query, news query
TICKER_PROFILES = [
    ("AAPL", "Apple", "Apple stock", '("Apple Inc" OR AAPL)'),
    ("AMZN", "Amazon", "Amazon stock", '("Amazon.com" OR AMZN)'),
    ("AMD", "AMD", "AMD stock", '"Advanced Micro Devices"'),
    ("AVGO", "Broadcom", "Broadcom stock", '("Broadcom" OR AVGO)'),
    ("GOOGL", "Google", "Google stock", '("Google" OR "Alphabet" OR GOOGL)'),
    ("META", "Meta", "Meta stock", '("Meta Platforms" OR META OR Facebook)'),
    ("MSFT", "Microsoft", "Microsoft stock", '("Microsoft" OR MSFT)'),
    ("NFLX", "Netflix", "Netflix stock", '("Netflix" OR NFLX)'),
    ("NVDA", "NVIDIA", "NVIDIA stock", '("NVIDIA" OR NVDA)'),
    ("TSLA", "Tesla", "Tesla stock", '("Tesla" OR TSLA)'),
]
DEFAULT_TICKER, DEFAULT_COMPANY = "TSLA", "Tesla"
