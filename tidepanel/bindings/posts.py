"""Post and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.bindings.base import (
    Tables,
    event_posts,
    raw_comments,
    raw_submissions,
    sessions,
    with_ctes,
)
from tidepanel.bindings.joins import METRIC_DIGITS, aligned_posts
from tidepanel.functions.clock import local_date, local_second_of_day, seconds_of, utc_date
from tidepanel.functions.numeric import count_or_zero, engagement_weight
from tidepanel.functions.text import WORD, run_grams, runs
from tidepanel.operators.posts import (
    classifier_scores,
    comments,
    daily_metrics,
    enrich_posts,
    in_window,
    lexicon_scores,
    match_keyword_table,
    match_keywords,
    score_texts,
    submissions,
    union_kinds,
)

# Caller-given in real use: (token, valence).
LEXICON = [
    ("the", 0.5), ("of", -0.5), ("and", 1.0), ("to", -1.0), ("in", 0.25), ("de", -0.25),
    ("la", 1.5), ("der", -1.5), ("und", 2.0), ("von", -2.0), ("el", 0.75), ("que", -0.75),
]
KEYWORDS = {"ERE": ["ere", "tion des"], "UND": ["und", "that the"], "ST": ["st", "of the"]}


def unified(t: Tables) -> DataFrame:
    return union_kinds(submissions(raw_submissions(t)), comments(raw_comments(t)))


def post_union(t: Tables) -> DataFrame:
    return unified(t).select(
        "kind", "id", "date_utc", "created_utc", "subreddit", "title",
        F.md5("selftext").alias("selftext_md5"), "score", "num_comments", "permalink", "url",
    )


def keyword_match(t: Tables) -> DataFrame:
    return match_keywords(unified(t), KEYWORDS).select("ticker", "kind", "id")


#: Sixty keys; a third of the terms begin or end with other characters than a word's.
MANY = {
    f"K{i}": [term]
    for i, term in enumerate(
        [a + b for a in ("er", "on", "th", "st") for b in ("", "en", "er", "es", "in", "ing", "on", "re", "st", "the")]
        + [f". {w}" for w in ("The", "Er", "Die", "La", "Le", "In", "On", "De", "Que", "Of")]
        + [f"{w}, th" for w in ("er", "on", "the", "and", "st", "in", "of", "en", "es", "re")]
    )
}
PASSAGE_RUNS = 9  # five words and what stands between them


def keyword_match_many(t: Tables) -> DataFrame:
    return match_keywords(unified(t), MANY).select("ticker", "kind", "id")


def keyword_match_table(t: Tables) -> DataFrame:
    """Every five consecutive words of every whole benchmark text, found in the posts."""
    passages = run_grams(runs(F.col("text")), PASSAGE_RUNS)
    terms = (
        t.benchmark.select(F.concat(F.lit("B"), F.col("item_id")).alias("ticker"), F.explode(passages).alias("term"))
        .filter(F.col("term").rlike(f"^{WORD}"))
    )
    return match_keyword_table(unified(t), terms, ["kind", "id"]).select("ticker", "kind", "id")


def lookback_filter(t: Tables) -> DataFrame:
    posts = event_posts(t).withColumn(
        "created_utc", F.when(F.pmod("event_id", F.lit(7)) != 0, F.col("created_utc"))
    )
    return in_window(posts, "2024-01-12", "2024-01-20").select("id", "created_utc")


def lexicon(t: Tables) -> DataFrame:
    return t._spark.createDataFrame(LEXICON, "token string, valence double")


def lexicon_sentiment(t: Tables) -> DataFrame:
    return lexicon_scores(t.documents, lexicon(t), ["doc_id"]).select(
        "doc_id", F.round("vader_sentiment", 10).alias("score")
    )


def letter_classifier():
    """A stand-in for a sentiment model: softmax over per-text shares of three letters."""
    import numpy as np

    def score(texts: list[str]) -> list[tuple[float, float]]:
        sizes = np.array([max(len(x), 1) for x in texts], dtype=float)
        logits = np.array([[x.count("a"), x.count("e"), x.count("o")] for x in texts]) * 10.0
        e = np.exp(logits / sizes[:, None])
        p = e / e.sum(axis=1, keepdims=True)
        return list(zip(p[:, 0].tolist(), p[:, 1].tolist()))

    return score


def scored_posts(t: Tables) -> DataFrame:
    """A text goes through the classifier once, however many documents carry it."""
    scored = score_texts(t.documents.select("doc_id", "text"), lambda d: classifier_scores(d, letter_classifier, ["_key"]))
    return scored.select(
        "doc_id", *[F.round(c, 8).alias(c) for c in ("p_pos", "p_neg", "finbert_sentiment")]
    )


def enriched_daily(t: Tables) -> DataFrame:
    """Match, score twice, align, weigh, aggregate: the whole chain over both kinds of text post."""
    named = match_keywords(unified(t), KEYWORDS)
    daily = daily_metrics(enrich_posts(named, sessions(t), lexicon(t), letter_classifier, required=True, key=None))
    return daily.select(
        "ticker", "kind", "date", "reddit_posts",
        *[
            F.round(c, METRIC_DIGITS).alias(c)
            for c in ("reddit_weight_sum", "reddit_vader_mean", "reddit_vader_std",
                      "reddit_vader_weighted_mean", "reddit_finbert_mean", "reddit_finbert_sum")
        ],
    )


def combined_kinds(t: Tables) -> DataFrame:
    """Posts of both kinds in one signal: the same aggregate without the kind."""
    daily = daily_metrics(aligned_posts(t), by=["ticker"])
    return daily.select(
        "ticker", "date", "reddit_posts",
        F.round("reddit_vader_mean", METRIC_DIGITS).alias("reddit_vader_mean"),
        F.round("reddit_finbert_weighted_mean", METRIC_DIGITS).alias("reddit_finbert_weighted_mean"),
    )


def epoch_dates(t: Tables) -> DataFrame:
    e, zone = F.col("created_utc"), "America/New_York"
    return event_posts(t).select(
        "id",
        utc_date(e).alias("utc_date"),
        local_date(e, zone).alias("local_date"),
        local_second_of_day(e, zone).alias("local_second"),
        (local_second_of_day(e, zone) < seconds_of("09:30:00")).alias("before_open"),
    )


def engagement(t: Tables) -> DataFrame:
    return event_posts(t).select(
        "id",
        count_or_zero(F.col("score")).alias("score"),
        F.round(engagement_weight(F.col("score"), F.col("num_comments")), 10).alias("weight"),
    )


QUERIES = {
    "post_union": post_union,
    "keyword_match": keyword_match,
    "keyword_match_many": keyword_match_many,
    "keyword_match_table": keyword_match_table,
    "lookback_filter": lookback_filter,
    "lexicon_sentiment": lexicon_sentiment,
    "scored_posts": scored_posts,
    "enriched_daily": enriched_daily,
    "combined_kinds": combined_kinds,
    "epoch_dates": epoch_dates,
    "engagement": engagement,
}

EDGE = r"[^\p{L}\p{N}_]"


def matches_sql(text: str, term: str, before: str = f"(^|{EDGE})", after: str = f"($|{EDGE})") -> str:
    return f"regexp_matches({text}, '{before}({term}){after}', 'i')"


KEYWORDS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS ticker, u.* FROM unified u WHERE "
    + matches_sql("title || chr(10) || selftext", "|".join(terms))
    for name, terms in KEYWORDS.items()
)
MANY_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS ticker, kind, id FROM texts WHERE "
    + (matches_sql("t", "[.] " + terms[0][2:], before=r"[\p{L}\p{N}_]") if terms[0][0] == "." else matches_sql("t", terms[0]))
    for name, terms in MANY.items()
)
LEXICON_SQL = "lexicon(token, valence) AS (VALUES " + ", ".join(
    f"('{token}', CAST({valence} AS DOUBLE))" for token, valence in LEXICON
) + ")"
TOKENS = r"unnest(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"


def letter(x: str, text: str = "text") -> str:
    return f"exp(10 * CAST(length({text}) - length(replace({text}, '{x}', '')) AS DOUBLE) / greatest(length({text}), 1))"


def letter_difference(text: str) -> str:
    a, e, o = (letter(x, text) for x in "aeo")
    return f"({a} - {e}) / ({a} + {e} + {o})"


ORACLE = {
    "post_union": with_ctes(
        ["unified"],
        """SELECT kind, id, strftime(to_timestamp(created_utc) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date_utc,
       created_utc, subreddit, title, md5(selftext) AS selftext_md5, score, num_comments, permalink, url
FROM unified""",
    ),
    "keyword_match": with_ctes(["unified"], f"SELECT ticker, kind, id FROM ({KEYWORDS_SQL})"),
    "keyword_match_many": with_ctes(
        ["unified"], ", texts AS (SELECT kind, id, title || chr(10) || selftext AS t FROM unified) " + MANY_SQL
    ),
    "keyword_match_table": with_ctes(
        ["unified"],
        r""", r AS (
  SELECT 'B' || item_id AS ticker, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS runs FROM benchmark),
k AS (
  SELECT DISTINCT ticker, array_to_string(list_slice(runs, i, i + 8), '') AS term
  FROM (SELECT ticker, runs, unnest(generate_series(1, len(runs) - 8)) AS i FROM r)
  WHERE regexp_matches(runs[i], '^[\p{L}\p{N}_]')),
x AS (SELECT kind, id, lower(title || chr(10) || selftext) AS t FROM unified),
c AS MATERIALIZED (SELECT ticker, kind, id, t, term FROM x, k WHERE contains(t, term))
SELECT DISTINCT ticker, kind, id FROM c
WHERE regexp_matches(t, '(^|[^\p{L}\p{N}_])' || regexp_replace(term, '([^\p{L}\p{N}_])', '[\1]', 'g') || '($|[^\p{L}\p{N}_])')""",
    ),
    "lookback_filter": with_ctes(
        ["posts"],
        """SELECT id, created_utc FROM posts WHERE event_id % 7 <> 0
AND CAST(to_timestamp(created_utc) AT TIME ZONE 'UTC' AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
    ),
    "lexicon_sentiment": "WITH " + LEXICON_SQL + ", w AS (SELECT doc_id, " + TOKENS.format("text")
    + """ AS token FROM documents),
s AS (SELECT doc_id, SUM(valence) AS s FROM w JOIN lexicon USING (token) GROUP BY 1)
SELECT doc_id, ROUND(COALESCE(s / sqrt(s * s + 15), 0), 10) AS score FROM documents LEFT JOIN s USING (doc_id)""",
    "scored_posts": f"""
WITH e AS (SELECT doc_id, {letter('a')} AS a, {letter('e')} AS b, {letter('o')} AS c FROM documents)
SELECT doc_id, ROUND(a / (a + b + c), 8) AS p_pos, ROUND(b / (a + b + c), 8) AS p_neg,
       ROUND(a / (a + b + c) - b / (a + b + c), 8) AS finbert_sentiment FROM e""",
    "enriched_daily": with_ctes(
        ["unified", "calendar"],
        ", " + LEXICON_SQL + f", m AS ({KEYWORDS_SQL})," + """
p AS (SELECT *, timezone('America/New_York', to_timestamp(created_utc)) AS local_ts,
        CAST(local_ts AS DATE) + CASE WHEN CAST(local_ts AS TIME) < TIME '09:30:00' THEN 0 ELSE 1 END AS probe FROM m),
al AS (SELECT p.*, s.session_date FROM p ASOF JOIN calendar s ON p.probe <= s.session_date),
w AS (SELECT kind, id, """ + TOKENS.format("title || chr(10) || selftext") + """ AS token FROM unified),
sc AS (SELECT kind, id, SUM(valence) AS s FROM w JOIN lexicon USING (token) GROUP BY 1, 2),
f AS (SELECT al.*, """ + letter_difference("(title || chr(10) || selftext)") + """ AS fb, COALESCE(s / sqrt(s * s + 15), 0) AS v,
        CAST(1 AS DOUBLE) + ln(1 + greatest(coalesce(score, 0), 0)) + ln(1 + greatest(coalesce(num_comments, 0), 0)) AS w
      FROM al LEFT JOIN sc USING (kind, id))
SELECT ticker, kind, session_date AS date, COUNT(id) AS reddit_posts, ROUND(SUM(w), 8) AS reddit_weight_sum,
  ROUND(AVG(v), 8) AS reddit_vader_mean, ROUND(STDDEV_SAMP(v), 8) AS reddit_vader_std,
  ROUND(SUM(v * w) / SUM(w), 8) AS reddit_vader_weighted_mean,
  ROUND(AVG(fb), 8) AS reddit_finbert_mean, ROUND(SUM(fb), 8) AS reddit_finbert_sum
FROM f GROUP BY 1, 2, 3""",
    ),
    "combined_kinds": with_ctes(
        ["weighted"],
        """SELECT ticker, aligned_date AS date, COUNT(id) AS reddit_posts, ROUND(AVG(vader_sentiment), 8) AS reddit_vader_mean,
  ROUND(SUM(finbert_sentiment * w) / SUM(w), 8) AS reddit_finbert_weighted_mean
FROM weighted GROUP BY 1, 2""",
    ),
    "epoch_dates": with_ctes(
        ["probed"],
        """SELECT id, CAST(to_timestamp(created_utc) AT TIME ZONE 'UTC' AS DATE) AS utc_date,
  CAST(local_ts AS DATE) AS local_date,
  CAST(hour(local_ts) * 3600 + minute(local_ts) * 60 + second(local_ts) AS INTEGER) AS local_second,
  CAST(local_ts AS TIME) < TIME '09:30:00' AS before_open FROM probed""",
    ),
    "engagement": with_ctes(
        ["posts"],
        """SELECT id, greatest(coalesce(score, 0), 0) AS score,
  ROUND(CAST(1 AS DOUBLE) + ln(1 + greatest(coalesce(score, 0), 0)) + ln(1 + greatest(coalesce(num_comments, 0), 0)), 10) AS weight
FROM posts""",
    ),
}
