"""Posts: projection, window, keyword match, sentiment, weights, daily metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.contract import POST_COLUMNS, POST_LOOKBACK_DAYS, POST_METRICS, SCORER_BATCH
from tidepanel.functions.clock import epoch_seconds, iso, utc_date
from tidepanel.functions.numeric import as_number, engagement_weight, known, ratio
from tidepanel.functions.text import (
    keyword_hits,
    or_empty,
    run_grams,
    runs,
    title_and_body,
    tokens,
)
from tidepanel.operators.calendar import align_posts, fill_calendar
from tidepanel.session import checked_broadcast


def submissions(raw: DataFrame) -> DataFrame:
    """Raw submission fields (text) as unified posts."""
    epoch = epoch_seconds(F.col("created_utc"))
    return raw.select(
        "id",
        iso(utc_date(epoch)).alias("date_utc"),
        epoch.alias("created_utc"),
        "subreddit",
        or_empty(F.col("title")).alias("title"),
        or_empty(F.col("selftext")).alias("selftext"),
        as_number(F.col("score")).alias("score"),
        as_number(F.col("num_comments")).alias("num_comments"),
        "permalink",
        "url",
    )


def comments(raw: DataFrame) -> DataFrame:
    """Raw comment fields as unified posts: no title, no reply count, no url."""
    epoch = epoch_seconds(F.col("created_utc"))
    return raw.select(
        "id",
        iso(utc_date(epoch)).alias("date_utc"),
        epoch.alias("created_utc"),
        "subreddit",
        F.lit("").alias("title"),
        or_empty(F.col("body").cast("string")).alias("selftext"),
        as_number(F.col("score")).alias("score"),
        F.lit(0.0).alias("num_comments"),
        "permalink",
        F.lit(None).cast("string").alias("url"),
    )


def union_kinds(subm: DataFrame, comm: DataFrame) -> DataFrame:
    """Both kinds of post in one frame with a ``kind`` column."""
    return subm.select(F.lit("subm").alias("kind"), *POST_COLUMNS).unionByName(
        comm.select(F.lit("comm").alias("kind"), *POST_COLUMNS)
    )


def in_window(
    posts: DataFrame, start, end, lookback: int = POST_LOOKBACK_DAYS, epoch: str = "created_utc"
) -> DataFrame:
    """Posts of ``[start - lookback, end]`` by UTC date; posts without a time are dropped.

    The test is on the epoch itself, which reaches a Parquet scan as a range filter.
    """
    day = 86400
    first = F.unix_date(F.date_sub(F.lit(start).cast("date"), lookback)).cast("bigint") * day
    stop = F.unix_date(F.date_add(F.lit(end).cast("date"), 1)).cast("bigint") * day
    return posts.filter(
        F.col(epoch).isNotNull() & (F.col(epoch) >= first) & (F.col(epoch) < stop)
    )


def match_keywords(
    posts: DataFrame, keywords: dict[str, list[str]], text: Column | None = None, key: str = "ticker"
) -> DataFrame:
    """Posts that name a key, once per key: whole-word, case-insensitive, ticker or company.

    All keys are found inside one projection, however many there are: no join, no shuffle. Terms are part
    of the plan; for more than some ten thousand ``match_keyword_table`` takes them as a table.
    """
    text = title_and_body(F.col("title"), F.col("selftext")) if text is None else text
    # An inner explode would have the plan test the matches for emptiness first, and so find them twice.
    return posts.withColumn(key, F.explode_outer(keyword_hits(text, keywords))).filter(F.col(key).isNotNull())


def match_keyword_table(
    posts: DataFrame, keywords: DataFrame, id_columns: list[str], text: Column | None = None
) -> DataFrame:
    """The same match with the keys in a table of (ticker, term) rows.

    Text and terms are cut into runs of word and other characters. A term of n runs matches where
    n runs of the text, joined again, equal it in lower case: an equi-join on short strings that is
    exact, boundaries included, and never carries the text along. The keyword side is broadcast if
    its counted size allows, else the join is shuffled and adaptive execution splits hot words.
    Matches are made unique per (id, text hash, key) before they join back, so copies of an id keep
    their own rows.
    """
    text = title_and_body(F.col("title"), F.col("selftext")) if text is None else text
    on = [*id_columns, "_hash"]
    hashed = posts.withColumn("_hash", F.xxhash64(text))
    terms = keywords.select(
        "ticker", F.lower("term").alias("_gram"), F.size(runs(F.col("term"))).alias("_length")
    ).filter("_length > 0")
    # One number per distinct term length.
    lengths = sorted(row[0] for row in terms.select("_length").distinct().collect())
    if not lengths:
        return posts.withColumn("ticker", F.lit(None).cast("string")).filter(F.lit(False))
    grams = F.flatten(F.array(*[run_grams(F.col("_runs"), n) for n in lengths]))
    found = (
        hashed.select(*on, runs(text).alias("_runs"))
        .select(*on, F.explode(F.array_distinct(grams)).alias("_gram"))
        .join(checked_broadcast(terms.select("ticker", "_gram").distinct(), row_bytes=256), "_gram")
        .select(*on, "ticker")
        .distinct()
    )
    return hashed.join(found, on).drop("_hash")


def lexicon_scores(
    posts: DataFrame, lexicon: DataFrame, id_columns: list[str], text: str = "text",
    output: str = "vader_sentiment", alpha: float = 15.0,
) -> DataFrame:
    """Lexicon sentiment of each whole text in (-1, 1): s / sqrt(s^2 + alpha), s the valence sum.

    Texts are split to words, counted per text and word, and joined with a caller-given
    (token, valence) table. Everything before the join stays inside one task per input split and
    the sums combine before their only shuffle, which carries ids and numbers, not texts.
    Columns out: the ids, ``_hash`` of the text, and the score; texts without a hit score 0.
    """
    words = posts.select(
        *id_columns,
        F.xxhash64(text).alias("_hash"),
        F.posexplode_outer(tokens(F.col(text))).alias("_at", "token"),
    )
    sided = words.join(checked_broadcast(lexicon.select("token", "valence")), "token", "left")
    # A repeated (id, text) doubles sum and copies alike; the ratio is the score of one copy.
    copies = F.count_if(F.coalesce(F.col("_at"), F.lit(0)) == 0)
    total = F.coalesce(F.sum("valence"), F.lit(0.0)) / copies
    return (
        sided.groupBy(*id_columns, "_hash")
        .agg(total.alias("_s"))
        .select(
            *id_columns, "_hash",
            (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + alpha)).alias(output),
        )
    )


def score_texts(posts: DataFrame, score: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """Posts with the columns that ``score`` finds for their texts; every distinct text is scored once.

    ``score`` gets (``_key``, ``text``), a row per distinct text, and returns ``_key`` with its columns.
    Copies are reduced on the map side and take their score by the hash of the text, whatever number of
    posts carries it. A NULL text counts as an empty one.
    """
    keyed = posts.withColumn("_key", F.sha2(or_empty(F.col(text)), 256))
    distinct = keyed.select("_key", or_empty(F.col(text)).alias("text")).distinct()
    return keyed.join(score(distinct), "_key", "left").drop("_key")


def add_lexicon_score(
    posts: DataFrame, lexicon: DataFrame, text: str = "text", output: str = "vader_sentiment",
) -> DataFrame:
    """Posts with the lexicon score of their text."""
    return score_texts(posts, lambda d: lexicon_scores(d, lexicon, ["_key"], output=output).drop("_hash"), text)


Scorer = Callable[[list[str]], "list[tuple[float, float]]"]


def classifier_scores(
    posts: DataFrame,
    factory: Callable[[], Scorer],
    keep: list[str],
    text: str = "text",
    output: str = "finbert_sentiment",
    batch: int = SCORER_BATCH,
) -> DataFrame:
    """Score texts with any classifier: ``(p_pos, p_neg, p_pos - p_neg)`` per text.

    ``factory`` loads the model once per task and returns a function from a list of texts to a
    list of (positive, negative) probabilities. Texts travel in Arrow batches and reach the model
    ``batch`` at a time; it sees them whole and truncates as its own contract says.
    """
    schema = posts.select(*keep).schema
    for name in ("p_pos", "p_neg", output):
        schema = schema.add(name, T.DoubleType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            scored = [
                pair for i in range(0, len(texts), batch) for pair in scorer(texts[i : i + batch])
            ]
            made = pd.DataFrame(scored, columns=["p_pos", "p_neg"], index=frame.index, dtype=float)
            yield frame[keep].assign(
                p_pos=made["p_pos"], p_neg=made["p_neg"], **{output: made["p_pos"] - made["p_neg"]}
            )

    names = [*keep, text] if text not in keep else keep
    return posts.select(*names).mapInPandas(run, schema)


def loadable(factory: Callable[[], Scorer] | None, required: bool = False) -> bool:
    """Whether the classifier can be loaded; tried once on the driver, an error only where it is required."""
    try:
        if factory is None:
            raise RuntimeError("no classifier given")
        factory()
    except Exception:
        if required:
            raise
        return False
    return True


def optional_score(
    posts: DataFrame,
    factory: Callable[[], Scorer] | None,
    required: bool = False,
    text: str = "text",
    output: str = "finbert_sentiment",
) -> DataFrame:
    """The classifier's score, or a NULL column when it cannot be loaded and is not required."""
    if not loadable(factory, required):
        return posts.withColumn(output, F.lit(None).cast("double"))
    return score_texts(posts, lambda d: classifier_scores(d, factory, ["_key"], output=output).select("_key", output), text)


def add_scores(
    posts: DataFrame, lexicon: DataFrame, factory: Callable[[], Scorer] | None, required: bool = False, text: str = "text",
) -> DataFrame:
    """Both scores of the texts, found on the same frame of distinct texts."""
    if not loadable(factory, required):
        return add_lexicon_score(posts, lexicon, text).withColumn("finbert_sentiment", F.lit(None).cast("double"))

    def score(distinct: DataFrame) -> DataFrame:
        first = lexicon_scores(distinct, lexicon, ["_key"]).drop("_hash")
        return first.join(classifier_scores(distinct, factory, ["_key"]).select("_key", "finbert_sentiment"), "_key")

    return score_texts(posts, score, text)


def add_weights(posts: DataFrame, sentiments: list[str] = ("vader", "finbert")) -> DataFrame:
    """Engagement weight and weighted sentiments."""
    weighted = posts.withColumn(
        "engagement_weight", engagement_weight(F.col("score"), F.col("num_comments"))
    )
    return weighted.withColumns(
        {
            f"{s}_weighted_sentiment": F.col(f"{s}_sentiment") * F.col("engagement_weight")
            for s in sentiments
        }
    )


def enrich_posts(
    posts: DataFrame,
    sessions: DataFrame,
    lexicon: DataFrame,
    factory: Callable[[], Scorer] | None = None,
    required: bool = False,
    key: str | None = "ticker",
) -> DataFrame:
    """Build the text, score it twice, align to sessions, weigh it. Empty in, empty out.

    Posts may come once per key that they name: scores hang on the text, which is scored once.
    """
    texts = posts.withColumn("text", title_and_body(F.col("title"), F.col("selftext")))
    scored = add_scores(texts, lexicon, factory, required)
    return add_weights(align_posts(scored, sessions, key=key))


def daily_metrics(posts: DataFrame, by: list[str] = ("ticker", "kind"), date: str = "aligned_date") -> DataFrame:
    """The 15 post metrics per session. One map-side-combined aggregate; no sort, no window."""
    first, second = known(F.col("vader_sentiment")), known(F.col("finbert_sentiment"))
    weight = F.col("engagement_weight")

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x), F.lit(0.0))

    return posts.groupBy(*by, F.col(date).alias("date")).agg(
        F.count("id").alias("reddit_posts"),
        total(weight).alias("reddit_weight_sum"),
        total(F.col("score")).alias("reddit_score_sum"),
        total(F.col("num_comments")).alias("reddit_comments_sum"),
        F.avg(first).alias("reddit_vader_mean"),
        total(first).alias("reddit_vader_sum"),
        F.stddev_samp(first).alias("reddit_vader_std"),
        F.avg(second).alias("reddit_finbert_mean"),
        total(second).alias("reddit_finbert_sum"),
        F.stddev_samp(second).alias("reddit_finbert_std"),
        weighted_mean(first, weight).alias("reddit_vader_weighted_mean"),
        weighted_mean(second, weight).alias("reddit_finbert_weighted_mean"),
        F.avg(first).alias("reddit_sent_mean"),
        total(first).alias("reddit_sent_sum"),
        F.stddev_samp(first).alias("reddit_sent_std"),
    )


def weighted_mean(x: Column, weight: Column) -> Column:
    """Aggregate: sum(x w) / sum(w); NULL without any known x."""
    return ratio(F.sum(x * weight), F.sum(weight))


ZERO_FILLED = [m for m in POST_METRICS if m == "reddit_posts" or m.endswith("_sum")]


def fill_daily(
    daily: DataFrame, keys: DataFrame, start, end, by: list[str] = ("ticker", "kind"),
    end_exclusive: bool = True,
) -> DataFrame:
    """Dense days for every key: counts and sums become 0, means and deviations stay NULL."""
    dense = fill_calendar(daily, keys, start, end, list(by), end_exclusive)
    return dense.withColumns(
        {m: F.coalesce(F.col(m), F.lit(0).cast(daily.schema[m].dataType)) for m in ZERO_FILLED}
    )
