"""Landing plans, keys, profiles, coercions and audits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.bindings.base import (
    Tables,
    customer_regions,
    day_rows,
    event_posts,
    fill_bounds,
    prices,
    with_ctes,
)
from tidepanel.bindings.joins import GRID_SQL, DAILY_SQL, aligned_posts, panel
from tidepanel.functions.text import slug
from tidepanel.contract import ALIGNMENT_POLICY
from tidepanel.operators.audit import coverage_audit, metadata_document, panel_summary, source_audit
from tidepanel.operators.posts import daily_metrics, fill_daily
from tidepanel.session import durable, shared_folder
from tidepanel.sources.landed import choose_sources, coerce_numbers, parse_json_lines
from tidepanel.sources.landing import (
    missing_windows,
    placeholder_days,
    plan_windows,
    resolve_profiles,
    split_keys,
)
from tidepanel.sources.sinks import read_ordered, write_ordered


def expand_keys(t: Tables) -> DataFrame:
    lists = t.part.select(
        F.col("p_partkey").alias("source"),
        F.concat(
            F.lit(" "), F.regexp_replace("p_name", " ", ", "), F.lit(",,  "), F.col("p_brand"),
            F.lit(" x"), F.pmod("p_partkey", F.lit(97)),
        ).alias("text"),
    )
    return split_keys(lists, "text", "source")


def resolve_profile(t: Tables) -> DataFrame:
    profiles = t.nation.select(
        F.upper("n_name").alias("ticker"),
        F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name"))
        .otherwise(F.concat(F.lower("n_name"), F.lit(" plc"))).alias("company_name"),
        F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.col("n_name"), F.lit(" stock")))
        .alias("trends_query"),
        F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("("), F.col("n_name"), F.lit(")")))
        .alias("gdelt_query"),
    )
    k = F.col("c_custkey")
    requests = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("request"),
        F.when(k % 11 == 0, F.concat(F.lit("x"), k))
        .otherwise(F.concat(F.lit("  "), F.lower("n_name"))).alias("ticker"),
        F.when(k % 6 == 0, F.concat(F.col("c_name"), F.lit(" "))).alias("company_name"),
        F.when(k % 7 == 0, F.lit("  ")).when(k % 7 == 1, F.col("c_mktsegment")).alias("trends_query"),
        F.when(k % 13 == 0, F.lit("")).alias("gdelt_query"),
    )
    return resolve_profiles(requests, profiles)


def _spans(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end")
    )


def window_plan(t: Tables) -> DataFrame:
    return plan_windows(_spans(t), 200)


def _cells(t: Tables) -> DataFrame:
    """Orders by (nation, segment), a key of some hundred series."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("cell"),
        F.to_date("o_orderdate").alias("date"),
    )


def _planned_and_missing(t: Tables) -> tuple[DataFrame, DataFrame]:
    days = durable(_cells(t).distinct())
    spans = days.groupBy("cell").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    # The window of a day follows from its distance to the start: no range join.
    landed = days.join(spans, "cell").select(
        "cell",
        F.expr("date_add(start, cast(floor(datediff(date, start) / 31) * 31 as int))").alias("window_start"),
    )
    planned = plan_windows(spans, 30)
    return planned, missing_windows(planned, landed, ["cell", "window_start"])


def backfill_plan(t: Tables) -> DataFrame:
    return _planned_and_missing(t)[1]


def placeholders(t: Tables) -> DataFrame:
    return placeholder_days(_planned_and_missing(t)[1], "trends_score")


def numeric_coerce(t: Tables) -> DataFrame:
    value, e = F.col("value").cast("string"), F.col("event_id") % 8
    text = (
        F.when(e == 0, F.concat(F.lit(" "), value, F.lit(" "))).when(e == 1, "n/a").when(e == 2, "")
        .when(e == 3, "1e3").when(e == 4, "NaN").when(e == 5, F.concat(value, F.lit("d")))
        .when(e == 6, F.concat(F.lit("-"), value)).otherwise(value)
    )
    frame = t.events.select("event_id", text.alias("value"))
    return coerce_numbers(frame, ["value", "absent"])


def json_fields(t: Tables) -> DataFrame:
    e = F.col("event_id")
    line = (
        F.when(e % 7 == 0, F.expr("substring(props, 1, length(props) - 1)"))
        .when(e % 11 == 0, "[1]").when(e % 13 == 0, "  ").when(e % 17 == 0, '{"j": {"a":1}, "k": null}')
        .otherwise(F.col("props"))
    )
    return parse_json_lines(t.events.select("event_id", line.alias("line")), "line", ["k", "j"], ["event_id"])


def slugs(t: Tables) -> DataFrame:
    tag = (
        F.when(F.col("p_partkey") % 5 == 0, F.lit("##"))
        .when(F.col("p_partkey") % 5 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("  "), F.initcap("p_name"), F.lit("/"), F.col("p_type"), F.lit("_#")))
    )
    return t.part.select("p_partkey", slug(tag, F.col("p_brand")).alias("tag"))


def _audit(t: Tables) -> DataFrame:
    sources = F.explode(F.array(*[F.struct(F.lit(n).alias("source_name"), F.lit(k).alias("k")) for k, n in enumerate(["stock", "news", "forum"])]))
    manifest = (
        t.region.select("r_name", "r_regionkey", sources.alias("s"))
        .select("r_name", "r_regionkey", "s.*", F.explode(F.array(F.lit(0), F.lit(1))).alias("priority"))
        .filter((F.col("source_name") != "forum") | (F.col("priority") == 0))
        .select(
            F.col("r_name").alias("ticker"), "source_name", "priority",
            F.concat_ws("_", F.lower("r_name"), "source_name", "priority").alias("path"),
            (F.pmod(F.col("r_regionkey") + F.col("priority") + F.col("k"), F.lit(3)) != 0).alias("there"),
        )
    )
    present = manifest.filter("there").select("path")
    rows = prices(t).select("ticker", F.lit("stock").alias("source_name"), "date").unionByName(
        day_rows(t).select("ticker", F.lit("news").alias("source_name"), "date")
    )
    return source_audit(choose_sources(manifest, present), rows)


def source_audits(t: Tables) -> DataFrame:
    return _audit(t)


def _coverage(t: Tables) -> DataFrame:
    keys = event_posts(t).select("ticker", "kind").distinct()
    daily = fill_daily(daily_metrics(aligned_posts(t)), keys, *fill_bounds(t))
    # A mean of zero is only exact up to the order of addition.
    rounded = daily.withColumn("reddit_finbert_mean", F.round("reddit_finbert_mean", 8))
    return coverage_audit(rounded, ["subm", "comm"])


def coverage(t: Tables) -> DataFrame:
    audit = _coverage(t)
    return audit.select(
        *[F.round(c, 10).alias(c) if kind == "double" else F.col(c) for c, kind in audit.dtypes]
    )


def summary(t: Tables) -> DataFrame:
    return panel_summary(panel(t), {"sparse_null_rate": "sparse", "interest_null_rate": "interest"})


def metadata(t: Tables) -> DataFrame:
    """The document's own fields beside each of its nested source records."""
    document = metadata_document(panel(t), durable(_audit(t)), durable(_coverage(t)), notes=["n1", "n2"])
    return document.select(
        "alignment_policy", F.col("rows").alias("panel_rows"), F.array_join("tickers_included", ",").alias("tickers"),
        F.array_join("notes", ",").alias("notes"), F.size("coverage_rows").alias("coverage_records"),
        F.inline("raw_source_rows"),
    )


def exchange_share(t: Tables) -> DataFrame:
    """Turnover by segment in millions, and its share of the total."""
    from tidepanel.bindings.base import whole
    from tidepanel.operators.stats import in_units, share_of_total

    turnover = t.orders.join(customer_regions(t), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "ticker", F.col("o_orderstatus").alias("kind")
    ).agg((F.sum(whole(F.col("o_totalprice"))).cast("double") / 100.0).alias("turnover"))
    shared = share_of_total(durable(turnover), "turnover", "share")
    return shared.select(
        "ticker", "kind", F.round(in_units(F.col("turnover"), 1e6), 8).alias("millions"),
        F.round("share", 10).alias("share"),
    )


ROW_ORDER = ["ticker", "date", "l_orderkey", "l_linenumber"]


def ordered_sink(t: Tables) -> DataFrame:
    """All calendar-day rows, written in panel order and read back with their positions in the files."""
    path = f"{shared_folder(t._spark)}/ordered-{uuid.uuid4().hex}"
    write_ordered(day_rows(t).select(*ROW_ORDER), path, ROW_ORDER)
    return read_ordered(t._spark, path)


QUERIES = {
    "ordered_sink": ordered_sink,
    "expand_keys": expand_keys,
    "resolve_profile": resolve_profile,
    "window_plan": window_plan,
    "backfill_plan": backfill_plan,
    "placeholder_days": placeholders,
    "numeric_coerce": numeric_coerce,
    "json_fields": json_fields,
    "slug": slugs,
    "source_audit": source_audits,
    "coverage_audit": coverage,
    "panel_summary": summary,
    "metadata_doc": metadata,
    "exchange_share": exchange_share,
}

WINDOWS_SQL = """
WITH d AS (
  SELECT DISTINCT c_nationkey || '/' || c_mktsegment AS cell, CAST(o_orderdate AS DATE) AS date
  FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT cell, MIN(date) AS a, MAX(date) AS b FROM d GROUP BY 1),
p AS (SELECT cell, b, CAST(unnest(generate_series(a, b, INTERVAL 31 DAY)) AS DATE) AS window_start FROM s),
w AS (SELECT cell, window_start, LEAST(window_start + 30, b) AS window_end FROM p),
missing AS (
  SELECT * FROM w WHERE NOT EXISTS (
    SELECT 1 FROM d WHERE d.cell = w.cell AND d.date BETWEEN w.window_start AND w.window_end))
"""

ORACLE = {
    "expand_keys": r"""
WITH l AS (
  SELECT p_partkey AS source, regexp_split_to_array(
    upper(trim(' ' || replace(p_name, ' ', ', ') || ',,  ' || p_brand || ' x' || p_partkey % 97)), '[\s,]+') AS parts
  FROM part),
e AS (SELECT source, unnest(parts) AS ticker, unnest(range(len(parts))) AS position FROM l)
SELECT ticker, source, CAST(position AS INTEGER) AS position FROM e WHERE length(ticker) > 0
QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY source, position) = 1""",
    "resolve_profile": """
WITH p AS (
  SELECT upper(n_name) AS ticker, CASE WHEN n_nationkey % 4 = 0 THEN n_name ELSE lower(n_name) || ' plc' END AS company,
    CASE WHEN n_nationkey % 3 <> 0 THEN n_name || ' stock' END AS trends,
    CASE WHEN n_nationkey % 5 = 0 THEN '(' || n_name || ')' END AS news FROM nation),
q AS (
  SELECT c_custkey AS request, CASE WHEN c_custkey % 11 = 0 THEN 'X' || c_custkey ELSE upper(n_name) END AS ticker,
    CASE WHEN c_custkey % 6 = 0 THEN c_name END AS company,
    CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN c_mktsegment END AS trends,
    CASE WHEN c_custkey % 13 = 0 THEN '' END AS news
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
j AS (
  SELECT q.request, q.ticker, COALESCE(q.company, p.company, q.ticker) AS company_name,
    COALESCE(q.trends, p.trends, '') AS trends, COALESCE(q.news, p.news, '') AS news
  FROM q LEFT JOIN p USING (ticker))
SELECT request, ticker, company_name,
  CASE WHEN trends <> '' THEN trends ELSE company_name END AS trends_query,
  CASE WHEN news <> '' THEN news WHEN upper(company_name) = ticker THEN '(' || ticker || ')'
       ELSE '(' || company_name || ' OR ' || ticker || ')' END AS gdelt_query
FROM j""",
    "window_plan": """
WITH s AS (
  SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS a, CAST(MAX(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1),
w AS (SELECT o_custkey, b, CAST(unnest(generate_series(a, b, INTERVAL 201 DAY)) AS DATE) AS window_start FROM s)
SELECT o_custkey, window_start, LEAST(window_start + 200, b) AS window_end FROM w""",
    "backfill_plan": WINDOWS_SQL + "SELECT cell, window_start, window_end FROM missing",
    "placeholder_days": WINDOWS_SQL + """
SELECT cell, CAST(unnest(generate_series(window_start, window_end, INTERVAL 1 DAY)) AS DATE) AS date,
       CAST(NULL AS DOUBLE) AS trends_score FROM missing""",
    "numeric_coerce": """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN value WHEN 3 THEN CAST(1000 AS DOUBLE) WHEN 6 THEN -value
                 WHEN 7 THEN value END AS value, CAST(NULL AS DOUBLE) AS absent FROM events""",
    "json_fields": """
SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN json_extract_string(props, '$.k') END AS k,
       CASE WHEN event_id % 17 = 0 THEN '{"a":1}' END AS j
FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0""",
    "slug": r"""
WITH s AS (
  SELECT p_partkey, lower(p_brand) AS fallback, CASE WHEN p_partkey % 5 = 0 THEN '##'
      WHEN p_partkey % 5 = 1 THEN lower(p_brand) ELSE lower(p_name || '/' || p_type || '_#') END AS raw FROM part),
c AS (SELECT p_partkey, fallback, trim(regexp_replace(raw, '[^a-z0-9_-]+', '-', 'g'), '-') AS tag FROM s)
SELECT p_partkey, CASE WHEN tag <> '' THEN tag ELSE fallback END AS tag FROM c""",
    "source_audit": with_ctes(
        ["prices", "days"],
        """, m AS (
  SELECT r_name AS ticker, s.name AS source_name, priority, lower(r_name) || '_' || s.name || '_' || priority AS path,
         (r_regionkey + priority + s.k) % 3 <> 0 AS there
  FROM region, (VALUES ('stock', 0), ('news', 1), ('forum', 2)) s(name, k), (VALUES (0), (1)) p(priority)
  WHERE s.name <> 'forum' OR priority = 0),
c AS (
  SELECT ticker, source_name, MIN(priority) FILTER (there) AS best, arg_min(path, priority) FILTER (there) AS selected_file
  FROM m GROUP BY 1, 2),
r AS (SELECT ticker, 'stock' AS source_name, date FROM prices UNION ALL SELECT ticker, 'news', date FROM days)
SELECT c.ticker, c.source_name, selected_file, COALESCE(best > 0, FALSE) AS used_fallback, COUNT(r.date) AS rows,
       CAST(MIN(r.date) AS VARCHAR) AS date_min, CAST(MAX(r.date) AS VARCHAR) AS date_max
FROM c LEFT JOIN r ON c.ticker = r.ticker AND c.source_name = r.source_name GROUP BY 1, 2, 3, 4""",
    ),
    "coverage_audit": with_ctes(
        ["weighted"],
        "," + GRID_SQL + ", m AS (" + DAILY_SQL + """),
f AS (SELECT * FROM grid LEFT JOIN m USING (ticker, kind, date))
SELECT ticker, """ + ", ".join(
            f"""COUNT(*) FILTER (kind = '{k}') AS {k}_days,
  COUNT(*) FILTER (kind = '{k}' AND reddit_posts > 0) AS {k}_days_with_posts,
  ROUND(AVG(CAST(COALESCE(reddit_posts, 0) > 0 AS INTEGER)) FILTER (kind = '{k}'), 10) AS {k}_post_coverage,
  COUNT(*) FILTER (kind = '{k}' AND reddit_finbert_mean IS NULL) AS {k}_finbert_null_days,
  COUNT(*) FILTER (kind = '{k}' AND reddit_finbert_mean = 0) AS {k}_finbert_zero_days"""
            for k in ("subm", "comm")
        ) + " FROM f GROUP BY 1",
    ),
    "panel_summary": with_ctes(
        ["panel"],
        """, a AS (
  SELECT CAST(COUNT(*) AS VARCHAR) AS rows, CAST(COUNT(DISTINCT ticker) AS VARCHAR) AS tickers,
    CAST(MIN(date) AS VARCHAR) AS date_min, CAST(MAX(date) AS VARCHAR) AS date_max,
    CAST(ROUND(AVG(CAST(sparse IS NULL AS INTEGER)), 6) AS VARCHAR) AS sparse_null_rate,
    CAST(ROUND(AVG(CAST(interest IS NULL AS INTEGER)), 6) AS VARCHAR) AS interest_null_rate FROM panel)
UNPIVOT a ON rows, tickers, date_min, date_max, sparse_null_rate, interest_null_rate INTO NAME metric VALUE value""",
    ),
    "exchange_share": """
WITH v AS (
  SELECT r_name AS ticker, o_orderstatus AS kind,
    CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) AS turnover
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT ticker, kind, ROUND(turnover / CAST(1000000 AS DOUBLE), 8) AS millions,
       ROUND(turnover / SUM(turnover) OVER (), 10) AS share FROM v""",
}

ORACLE["ordered_sink"] = with_ctes(
    ["days"], f"SELECT {', '.join(ROW_ORDER)}, ROW_NUMBER() OVER (ORDER BY {', '.join(ROW_ORDER)}) AS position FROM days"
)
ORACLE["metadata_doc"] = (
    f"WITH a AS ({ORACLE['source_audit']}), q AS (" + with_ctes(["panel"], "SELECT ticker FROM panel") + f""")
SELECT '{ALIGNMENT_POLICY}' AS alignment_policy, (SELECT COUNT(*) FROM q) AS panel_rows,
  (SELECT string_agg(DISTINCT ticker, ',' ORDER BY ticker) FROM q) AS tickers, 'n1,n2' AS notes,
  (SELECT CAST(COUNT(DISTINCT event_type) AS INTEGER) FROM events) AS coverage_records, a.* FROM a"""
)
