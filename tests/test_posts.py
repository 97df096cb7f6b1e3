"""Post projection, matching, sentiment, enrichment, daily metrics."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidepanel.contract import POST_COLUMNS, POST_METRICS
from tidepanel.functions.text import keyword_hits
from tidepanel.operators import posts as px
from tidepanel.plans.stages import import_posts

D = dt.date
RAW_S = "id string, created_utc string, subreddit string, title string, selftext string, score string, num_comments string, permalink string, url string"
RAW_C = "id string, created_utc string, subreddit string, body string, score string, permalink string"


def subm(spark, rows):
    return px.submissions(spark.createDataFrame(rows, RAW_S))


def text_posts(spark, texts):
    return spark.createDataFrame([(str(i), t, "") for i, t in enumerate(texts)], "id string, title string, selftext string")


CASES = {
    "Buy TSLA now": True, "$tsla!": True, "TSLAQ is no ticker": False, "my_TSLA_x": False,
    "I like teSLA": True, "Teslas": False, "étesla": False, "(Tesla)": True, "": False, "tsla": True,
}


def test_keywords_inline(spark):
    got = px.match_keywords(text_posts(spark, CASES), {"TSLA": ["TSLA", "Tesla"]}).collect()
    assert {r.title for r in got} == {t for t, hit in CASES.items() if hit}


def test_keyword_table_agrees_with_inline(spark):
    texts = [*CASES, "Advanced Micro Devices and tesla", "advanced  micro devices", "Amazon.com AMD", "amazon,com", "AMD", "amd"]
    data = text_posts(spark, texts).unionByName(text_posts(spark, texts[:3]))
    words = {"TSLA": ["TSLA", "Tesla"], "AMD": ["AMD", "Advanced Micro Devices"], "AMZN": ["Amazon.com"]}
    table = spark.createDataFrame([(k, t) for k, ts in words.items() for t in ts], "ticker string, term string")
    inline = sorted((r.id, r.title, r.ticker) for r in px.match_keywords(data, words).collect())
    joined = sorted((r.id, r.title, r.ticker) for r in px.match_keyword_table(data, table, ["id"]).collect())
    assert inline == joined and len(inline) > 10
    many = words | {f"K{i}": [f"k{i}"] for i in range(5)}
    assert sorted((r.id, r.title, r.ticker) for r in px.match_keywords(data, many).collect()) == inline


def test_terms_with_outer_symbols_need_a_word_next_to_them(spark):
    got = px.match_keywords(text_posts(spark, ["C++ x", "C++x", "c"]), {"C": ["C++"]}).collect()
    assert [r.title for r in got] == ["C++x"]


def test_number_of_keys_does_not_matter(spark):
    texts = ["x$TSLA now", "$TSLA now", "x$TSLA", "a k7 b", "C++x", "C++ x", "K48. Then", "k48.Then"]
    data = text_posts(spark, texts)
    words = {f"K{i}": [f"k{i}"] for i in range(60)} | {"T": ["$TSLA"], "C": ["C++"], "D": ["k48. then"]}
    seen = []
    for n in (46, 47, 60):  # with the three others 49, 50 and 63 keys
        own = {k: v for k, v in words.items() if not k[1:].isdigit() or int(k[1:]) < n}
        table = spark.createDataFrame([(k, t) for k, ts in own.items() for t in ts], "ticker string, term string")
        inline = sorted((r.title, r.ticker) for r in px.match_keywords(data, own).collect())
        assert inline == sorted((r.title, r.ticker) for r in px.match_keyword_table(data, table, ["id"]).collect())
        seen.append([x for x in inline if x[1] in ("T", "C", "D", "K7")])
    assert seen[0] == seen[1] == seen[2] == [
        ("C++x", "C"), ("K48. Then", "D"), ("a k7 b", "K7"), ("x$TSLA", "T"), ("x$TSLA now", "T")
    ]


def test_projection_and_window(spark):
    day = 86400
    start = 1704067200  # 2024-01-01
    rows = [
        ("a", str(start - 7 * day), "s", None, None, "3", "2", "p", "u"),
        ("b", str(start - 7 * day - 1), "s", "t", "x", "3", "2", "p", "u"),
        ("c", f"{start + 2 * day - 1}.0", "s", "t", "x", "-3", None, "p", "u"),
        ("d", str(start + 2 * day), "s", "t", "x", "bad", "nan", "p", "u"),
        ("e", None, "s", "t", "x", "3", "2", "p", "u"),
    ]
    posts = subm(spark, rows)
    assert posts.columns == POST_COLUMNS
    kept = px.in_window(posts, "2024-01-01", "2024-01-02").orderBy("id").collect()
    assert [r.id for r in kept] == ["a", "c"]
    assert kept[0].title == "" and kept[0].date_utc == "2023-12-25" and kept[1].score == -3.0
    assert kept[1].num_comments is None and kept[1].created_utc == start + 2 * day - 1
    comm = px.comments(spark.createDataFrame([("z", str(start), "s", None, "1", "p")], RAW_C))
    both = px.union_kinds(posts, comm).filter("kind = 'comm'").first()
    assert (both.title, both.selftext, both.num_comments, both.url) == ("", "", 0.0, None)


LEXICON = [("good", 2.0), ("bad", -3.0)]


def test_lexicon_scores(spark):
    rows = [("1", "Good good BAD day"), ("2", "nothing"), ("3", ""), ("4", None), ("1", "Good good BAD day"), ("1", "good")]
    data = spark.createDataFrame(rows, "id string, text string")
    lexicon = spark.createDataFrame(LEXICON, "token string, valence double")
    got = sorted((r.id, r.text, round(r.vader_sentiment, 9) if r.vader_sentiment is not None else None)
                 for r in px.add_lexicon_score(data, lexicon).filter("text is not null").collect())
    one, two = 1 / math.sqrt(16), 2 / math.sqrt(19)
    assert got == sorted([
        ("1", "Good good BAD day", round(one, 9)), ("1", "Good good BAD day", round(one, 9)),
        ("1", "good", round(two, 9)), ("2", "nothing", 0.0), ("3", "", 0.0),
    ])


def test_classifier_batches_and_contract(spark):
    sizes = spark.sparkContext.accumulator(0)

    def factory():
        def score(texts):
            assert len(texts) <= 4
            sizes.add(len(texts))
            return [(0.75, 0.25) for _ in texts]

        return score

    data = spark.range(19).select("id", F.lit("x").alias("text"))
    got = px.classifier_scores(data, factory, ["id"], batch=4).collect()
    assert len(got) == 19 and {r.finbert_sentiment for r in got} == {0.5} and sizes.value == 19


def test_optional_classifier(spark):
    data = spark.createDataFrame([("a good one",)], "text string")

    def broken():
        raise OSError("no model")

    assert px.optional_score(data, broken).first().finbert_sentiment is None
    with pytest.raises(OSError):
        px.optional_score(data, broken, required=True)


def enriched(spark, rows):
    return spark.createDataFrame(
        rows,
        "ticker string, kind string, aligned_date date, id string, engagement_weight double, score double, "
        "num_comments double, vader_sentiment double, finbert_sentiment double",
    )


def test_daily_metrics_and_fill(spark):
    day = D(2024, 1, 2)
    rows = [
        ("A", "subm", day, "1", 1.0, -4.0, 1.0, 0.5, None), ("A", "subm", day, "2", 3.0, None, 2.0, -0.5, None),
        ("A", "comm", day, "3", 2.0, 1.0, 0.0, 0.25, 0.1),
    ]
    daily = px.daily_metrics(enriched(spark, rows))
    got = {r.kind: r for r in daily.collect()}
    s, c = got["subm"], got["comm"]
    assert (s.reddit_posts, s.reddit_weight_sum, s.reddit_score_sum, s.reddit_comments_sum) == (2, 4.0, -4.0, 3.0)
    assert s.reddit_vader_mean == 0.0 and s.reddit_vader_std == pytest.approx(math.sqrt(0.5))
    assert s.reddit_vader_weighted_mean == pytest.approx(-0.25)
    assert s.reddit_finbert_mean is None and s.reddit_finbert_sum == 0.0 and s.reddit_finbert_weighted_mean is None
    assert c.reddit_vader_std is None and c.reddit_sent_mean == 0.25
    keys = spark.createDataFrame([("A", "subm"), ("A", "comm")], "ticker string, kind string")
    filled = px.fill_daily(daily, keys, "2024-01-01", "2024-01-03")
    assert set(filled.columns) == {"ticker", "kind", "date", *POST_METRICS}
    empty = filled.filter("date = '2024-01-01' and kind = 'subm'").first()
    assert empty.reddit_posts == 0 and empty.reddit_finbert_sum == 0.0 and empty.reddit_sent_mean is None
    assert filled.count() == 4 and dict(filled.dtypes)["reddit_posts"] == "bigint"


def test_empty_posts_fill_the_same_columns(spark):
    keys = spark.createDataFrame([("A", "subm")], "ticker string, kind string")
    filled = px.fill_daily(px.daily_metrics(enriched(spark, [])), keys, "2024-01-01", "2024-01-04")
    assert filled.count() == 3 and filled.agg(F.sum("reddit_posts")).first()[0] == 0


def test_whole_import(spark):
    def good_factory():
        def score(texts):
            return [(0.75, 0.25) if "good" in t.lower() else (0.25, 0.5) for t in texts]

        return score

    noon = int(dt.datetime(2024, 1, 5, 12, tzinfo=dt.timezone.utc).timestamp())  # 07:00 in New York
    raw = [
        ("a", str(noon), "s", "Tesla good", "and AMD", "1", "0", "p", "u"),
        ("b", str(noon + 6 * 3600), "s", "tsla bad", None, "0", "0", "p", "u"),
        ("c", str(noon), "s", "nothing here", None, "0", "0", "p", "u"),
    ]
    comm = px.comments(spark.createDataFrame([("a", str(noon), "s", "good good tsla", "5", "p")], RAW_C))
    sessions = spark.createDataFrame(
        [(k, d) for k in ("TSLA", "AMD") for d in (D(2024, 1, 5), D(2024, 1, 8))], "ticker string, session_date date"
    )
    posts, daily = import_posts(
        subm(spark, raw), comm, {"TSLA": ["TSLA", "Tesla"], "AMD": ["AMD"]}, sessions,
        spark.createDataFrame(LEXICON, "token string, valence double"), "2024-01-01", "2024-01-10", good_factory,
    )
    got = sorted((r.ticker, r.kind, r.id, r.aligned_date.day, round(r.vader_sentiment, 6), r.finbert_sentiment) for r in posts.collect())
    two, three, four = 2 / math.sqrt(19), 3 / math.sqrt(24), 4 / math.sqrt(31)
    assert got == [
        ("AMD", "subm", "a", 5, round(two, 6), 0.5), ("TSLA", "comm", "a", 5, round(four, 6), 0.5),
        ("TSLA", "subm", "a", 5, round(two, 6), 0.5), ("TSLA", "subm", "b", 8, round(-three, 6), -0.25),
    ]
    assert daily.count() == 4 * 9 and daily.agg(F.sum("reddit_posts")).first()[0] == 4


def test_keywords_equal_runs_compared_one_by_one(spark):
    """Random texts and terms over few characters, so that terms overlap, begin and contain each other."""
    draw = random.Random(5)
    alphabet = ["a", "b", "A", "é", "_", "1", " ", ".", "-", "\n", "\U00010400"]
    texts = ["".join(draw.choices(alphabet, k=draw.randrange(0, 30))) for _ in range(400)]
    terms = {"".join(draw.choices(alphabet, k=draw.randrange(1, 6))) for _ in range(150)}
    keywords = {f"k{i}": [term] for i, term in enumerate(sorted(terms))}

    def cut(text):
        return re.findall(r"[^\W]+|[\W]+", text.lower())

    def named(text):
        pieces, found = cut(text), set()
        for key, (term,) in keywords.items():
            run = cut(term)
            for i in range(len(pieces) - len(run) + 1):
                if pieces[i : i + len(run)] == run:
                    open_start = i == 0 and not re.match(r"\w", run[0])
                    open_end = i + len(run) == len(pieces) and not re.match(r"\w", run[-1])
                    if not open_start and not open_end:
                        found.add(key)
        return found

    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn(
        "hits", keyword_hits(F.col("t"), keywords)
    ).collect()
    assert len(rows) == len(texts) and any(len(r.hits) > 3 for r in rows)
    for row in rows:
        assert set(row.hits) == named(row.t) and len(row.hits) == len(set(row.hits)), row.t


def test_a_copied_text_is_scored_once(spark):
    texts = [(i, f"text {i % 7}") for i in range(70)] + [(70, None), (71, ""), (72, None)]
    data = spark.createDataFrame(texts, "id long, text string").repartition(5)
    lexicon = spark.createDataFrame([("text", 1.0)], "token string, valence double")

    def factory():
        # Another value at every call: equal scores can only come from one call.
        return lambda texts: [(random.SystemRandom().random(), 0.0) for _ in texts]

    rows = px.add_scores(data, lexicon, factory, required=True).collect()
    assert sorted(r.id for r in rows) == list(range(73))
    scores = {}
    for row in rows:
        scores.setdefault(row.text or "", set()).add((row.vader_sentiment, row.finbert_sentiment))
    assert len(scores) == 8 and all(len(found) == 1 for found in scores.values())
    assert {v for text, found in scores.items() for v, _ in found if text} == {0.25}
