"""The driver's tables in the roles of prices, calendar-day series and posts.

Every role exists twice: as a Spark frame and as a common table expression for the oracle. Prices
are summed in whole cents and scores are whole numbers, so both sides add exactly the same numbers
whatever the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import checked_broadcast, spread


class Tables:
    """Lazy access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        # The long texts are the heavy rows; a folder of many files is left as it is.
        return spread(table) if name == "documents" else table


def with_ctes(names: list[str], body: str) -> str:
    """The query with the named expressions, and those they need, in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered) + "\n" + body


def whole(x: Column) -> Column:
    """A two-digit decimal held in a double as whole hundredths."""
    return F.round(x * 100).cast("bigint")


# --- prices: one row per (region, weekday order date) --------------------------------------------


def customer_regions(t: Tables) -> DataFrame:
    """Region of every customer, broadcast while the counted customers allow it.

    The planner multiplies the sizes of joined tables and would not broadcast it by itself.
    """
    return checked_broadcast(
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("r_name").alias("ticker"))
    )


def prices(t: Tables) -> DataFrame:
    """Lines are summed per order on the join key before the join, so one shuffle serves both.

    Orders of a weekend count on the Monday after it.
    """
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.sum(whole(F.col("l_extendedprice"))).alias("cents"),
        F.sum("l_quantity").alias("quantity"),
        F.count(F.lit(1)).alias("lines"),
    )
    day = F.to_date("o_orderdate")
    orders = t.orders.select(
        "o_orderkey", "o_custkey", F.date_add(day, F.when(F.weekday(day) < 5, 0).otherwise(7 - F.weekday(day))).alias("date")
    )
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customer_regions(t), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("ticker", "date")
        .agg(
            (F.sum("cents").cast("double") / 100.0 / F.sum("lines").cast("double")).alias("stock_price"),
            F.sum("quantity").alias("stock_volume"),
        )
    )


def day_rows(t: Tables) -> DataFrame:
    """Calendar-day rows of several sources, many per (region, ship date), with missing values."""
    suppliers = checked_broadcast(
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("ticker"))
    )
    return t.lineitem.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        "ticker",
        F.to_date("l_shipdate").alias("date"),
        F.nullif(whole(F.col("l_discount")), F.lit(3)).cast("double").alias("interest"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("articles"),
        whole(F.col("l_tax")).cast("double").alias("robust"),
        (F.pmod(whole(F.col("l_extendedprice")), F.lit(201)) - 100).cast("double").alias("tone"),
    )


# --- posts: events, and texts that share an id with an event --------------------------------------


def event_epoch() -> Column:
    return F.unix_seconds(F.col("ts").cast("timestamp"))


def event_posts(t: Tables) -> DataFrame:
    e = F.col("event_id")
    posts = t.events.select(
        F.col("event_type").alias("ticker"),
        F.when(F.pmod(e, F.lit(2)) == 0, "subm").otherwise("comm").alias("kind"),
        e.cast("string").alias("id"),
        e.alias("event_id"),
        event_epoch().alias("created_utc"),
        F.round(F.col("value") - 20.0, 2).alias("score"),
        F.get_json_object("props", "$.k").try_cast("double").alias("num_comments"),
        ((F.pmod(F.col("user_id") * 7, F.lit(21)) - 10).cast("double") / 10.0).alias("vader_sentiment"),
        F.when(
            F.pmod(e, F.lit(5)) != 0, (F.pmod(e, F.lit(11)) - 5).cast("double") / 5.0
        ).alias("finbert_sentiment"),
    )
    return posts


def raw_submissions(t: Tables) -> DataFrame:
    return t.documents.join(t.events, F.col("doc_id") == F.col("event_id"), "left").select(
        F.col("doc_id").cast("string").alias("id"),
        event_epoch().cast("string").alias("created_utc"),
        F.col("source").alias("subreddit"),
        F.col("lang").alias("title"),
        F.col("text").alias("selftext"),
        F.col("value").cast("string").alias("score"),
        F.get_json_object("props", "$.k").alias("num_comments"),
        F.concat(F.lit("/p/"), F.col("doc_id")).alias("permalink"),
        F.concat(F.lit("/u/"), F.col("user_id")).alias("url"),
    )


def raw_comments(t: Tables) -> DataFrame:
    return t.conversations.join(
        t.events, F.col("conv_id") * 10 + F.col("turn") == F.col("event_id"), "left"
    ).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        event_epoch().cast("string").alias("created_utc"),
        F.col("role").alias("subreddit"),
        F.col("text").alias("body"),
        F.col("value").cast("string").alias("score"),
        F.concat(F.lit("/c/"), F.col("conv_id")).alias("permalink"),
    )


def event_days(t: Tables, before: int, after: int) -> DataFrame:
    """One row: the first and the last UTC day of the events, with so many days of margin."""
    day = F.to_date(F.col("ts").cast("timestamp"))
    return t.events.agg(F.min(day).alias("first"), F.max(day).alias("last")).select(
        F.date_sub("first", before).alias("first"), F.date_add("last", after).alias("last")
    )


def sessions(t: Tables) -> DataFrame:
    """A shared session calendar around the events: the weekdays, less the third Monday of January."""
    day = F.col("session_date")
    holiday = (F.month(day) == 1) & (F.weekday(day) == 0) & F.dayofmonth(day).between(15, 21)
    return (
        event_days(t, 10, 10).select(F.explode(F.sequence("first", "last")).alias("session_date"))
        .filter((F.weekday(day) < 5) & ~holiday)
    )


def fill_bounds(t: Tables) -> tuple[Column, Column]:
    """First day and the day after the last one of the dense grids around the events."""
    days = event_days(t, 12, 16)
    return days.select("first").scalar(), days.select("last").scalar()


CTES = {
    "prices": """
  SELECT r_name AS ticker,
         CAST(o_orderdate AS DATE) + CASE isodow(o_orderdate) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS date,
         CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE)
           / CAST(100 AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS stock_price,
         SUM(l_quantity) AS stock_volume
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2""",
    "days": """
  SELECT l_orderkey, l_linenumber, l_partkey, r_name AS ticker, CAST(l_shipdate AS DATE) AS date,
         CAST(NULLIF(CAST(ROUND(l_discount * 100) AS BIGINT), 3) AS DOUBLE) AS interest,
         CASE WHEN l_linenumber <> 7 THEN l_quantity END AS articles,
         CAST(ROUND(l_tax * 100) AS DOUBLE) AS robust,
         CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) % 201 - 100 AS DOUBLE) AS tone
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "sessions": "SELECT DISTINCT ticker, date AS session_date FROM prices",
    "mapped": """
  SELECT d.*, s.session_date FROM days d ASOF JOIN sessions s
    ON d.ticker = s.ticker AND d.date <= s.session_date""",
    "rolled": """
  SELECT ticker, session_date AS date, AVG(interest) AS interest, AVG(robust) AS robust,
         AVG(tone) AS tone, COALESCE(SUM(articles), 0) AS articles
  FROM mapped GROUP BY 1, 2""",
    "panel": """
  SELECT p.*, r.interest, r.robust, r.tone, r.articles,
         CASE WHEN day(p.date) % 7 <> 0 THEN r.tone END AS sparse
  FROM prices p LEFT JOIN rolled r ON p.ticker = r.ticker AND p.date = r.date""",
    "posts": """
  SELECT event_type AS ticker, CASE WHEN event_id % 2 = 0 THEN 'subm' ELSE 'comm' END AS kind,
         CAST(event_id AS VARCHAR) AS id, event_id,
         CAST(FLOOR(epoch_us(ts) / CAST(1000000 AS DOUBLE)) AS BIGINT) AS created_utc,
         ROUND(value - CAST(20 AS DOUBLE), 2) AS score,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS num_comments,
         CAST((user_id * 7) % 21 - 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS vader_sentiment,
         CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 11 - 5 AS DOUBLE) / CAST(5 AS DOUBLE) END
           AS finbert_sentiment
  FROM events""",
    "calendar": """
  SELECT CAST(d AS DATE) AS session_date
  FROM (SELECT unnest(generate_series(MIN(CAST(ts AS DATE)) - 10, MAX(CAST(ts AS DATE)) + 10, INTERVAL 1 DAY)) AS d
        FROM events)
  WHERE isodow(d) < 6 AND NOT (month(d) = 1 AND isodow(d) = 1 AND day(d) BETWEEN 15 AND 21)""",
    "probed": """
  SELECT p.*, timezone('America/New_York', to_timestamp(created_utc)) AS local_ts,
         CAST(local_ts AS DATE)
           + CASE WHEN CAST(local_ts AS TIME) < TIME '09:30:00' THEN 0 ELSE 1 END AS probe
  FROM posts p""",
    "aligned": """
  SELECT p.*, s.session_date AS aligned_date
  FROM probed p ASOF JOIN calendar s ON p.probe <= s.session_date""",
    "weighted": """
  SELECT *, CAST(1 AS DOUBLE) + ln(1 + greatest(coalesce(score, 0), 0))
              + ln(1 + greatest(coalesce(num_comments, 0), 0)) AS w FROM aligned""",
    "unified": """
  SELECT 'subm' AS kind, CAST(doc_id AS VARCHAR) AS id,
         CAST(FLOOR(epoch_us(ts) / CAST(1000000 AS DOUBLE)) AS BIGINT) AS created_utc,
         source AS subreddit, lang AS title, text AS selftext, value AS score,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS num_comments,
         '/p/' || doc_id AS permalink, '/u/' || user_id AS url, event_type
  FROM documents LEFT JOIN events ON doc_id = event_id
  UNION ALL
  SELECT 'comm', conv_id || '-' || turn,
         CAST(FLOOR(epoch_us(ts) / CAST(1000000 AS DOUBLE)) AS BIGINT),
         role, '', text, value, CAST(0 AS DOUBLE), '/c/' || conv_id, NULL, event_type
  FROM conversations LEFT JOIN events ON conv_id * 10 + turn = event_id""",
}
NEEDS = {
    "sessions": ["prices"],
    "mapped": ["days", "sessions"],
    "rolled": ["mapped"],
    "panel": ["prices", "rolled"],
    "probed": ["posts"],
    "aligned": ["probed", "calendar"],
    "weighted": ["aligned"],
}
