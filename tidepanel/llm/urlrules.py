"""URL filters by association rules.

A list of rules (host and path) decides the urls that it fits. The urls it decides are the labelled
examples from which Spark's FP-growth mines combinations of url tokens: host labels, words of the path and of
the query. Rules "tokens -> verdict" of enough support and confidence, and without a more general rule
that is as sure, judge the urls that the list leaves open. Rules are found by an inverted index: each is filed under its
rarest token, so a url only meets rules whose rarest token it has.

Tokens that occur in exactly the same labelled urls are one item while mining (any of them stands for
it when matching), so tokens that always go together do not multiply the combinations.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import shared
from tidepanel.session import checked_broadcast

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, path) of the query.
RULES = [
    (ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
]
#: A mined rule holds in so many labelled urls at least (a share of them, and a number), and so often among those it fits.
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.001, 5, 0.9
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct sorted tokens of a url: ``h:`` host words, ``p:`` path words, ``q:`` query words, A-Z lower-cased."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))

    def words(part: Column, kind: str) -> Column:
        found = F.regexp_extract_all(F.translate(part, UPPER, LOWER), F.lit(f"({WORDS})"))
        return F.transform(found, lambda w: F.concat(F.lit(kind), w))

    made = F.concat(words(host_of(url), "h:"), words(path_of(url), "p:"), words(query, "q:"))
    return F.array_sort(F.array_distinct(made))


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (length, rule, verdict); NULL where none does.

    The list is filed under its hosts; a url asks for its host and each suffix behind a dot. Of rules that
    are equally long the later by name wins.
    """
    filed: dict[str, list[dict[str, object]]] = {}
    for verdict, name, start in rules:
        filed.setdefault(name.lower(), []).append(
            {"length": len(name) + len(start), "rule": name + start, "start": start, "verdict": verdict}
        )
    kind = "map<string,array<struct<length:int,rule:string,start:string,verdict:string>>>"
    index = F.from_json(F.lit(json.dumps(filed)), kind)
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    none = F.array().cast("array<struct<length:int,rule:string,start:string,verdict:string>>")
    of_host = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(index, s), none)))
    return F.array_max(F.filter(of_host, lambda r: F.startswith(path, r["start"])))


def _items(labelled: DataFrame, least: int) -> DataFrame:
    """(token, item, n): frequent tokens of (row, tokens); tokens of exactly the same rows share an item.

    Rows are compared by their number and two 64-bit sums of hashes.
    """
    counted = (
        labelled.select("row", F.explode("tokens").alias("token")).groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), *(
            F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)
        )).filter(F.col("n") >= least)
    )
    first = counted.groupBy("n", "h1", "h2").agg(F.min("token").alias("item"))
    return shared.stored(counted.join(first, ["n", "h1", "h2"]).select("token", "item", "n"), "items")


def _in_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(row, items): the sorted distinct items of every row that has any."""
    exploded = rows.select("row", F.explode("tokens").alias("token"))
    return exploded.join(checked_broadcast(items.select("token", "item"), 128), "token").groupBy("row").agg(
        F.array_sort(F.collect_set("item")).alias("items")
    )


def matched(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule columns): the rules whose items all stand in the ``items`` of a row.

    ``rules`` has ``key``, one of its items; rows meet the rules of their items' keys only. A rule has one
    key, so no pair comes twice.
    """
    asked = rows.select("row", "items", F.explode("items").alias("key"))
    filed = rules.withColumnRenamed("items", "_needs")
    met = asked.join(checked_broadcast(filed, 256), "key")
    return met.filter(F.size(F.array_except("_needs", "items")) == 0).drop("items").withColumnRenamed("_needs", "needs")


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE,
) -> tuple[DataFrame, DataFrame]:
    """Tokens with their items, and pruned rules (items, key, verdict, n, confidence).

    ``labelled`` is (row, tokens, verdict), row unique. A rule is kept if it fits and is right in at least
    ``min_support`` of the rows and ``min_rows`` of them, is right in ``min_confidence`` of the rows it fits, and no
    rule on part of its items says the same with at least its confidence. No rows give no rules.
    """
    labelled = shared.stored(labelled, "labelled")
    total = labelled.count()
    least = max(min_rows, -int(-(total * min_support) // 1))
    items = _items(labelled, least)
    baskets = shared.stored(
        _in_items(labelled, items).join(labelled.select("row", "verdict"), "row")
        .select("row", F.concat("items", F.array(F.concat(F.lit("="), "verdict"))).alias("items")), "baskets",
    )
    n = baskets.count()
    kinds = "items array<string>, freq bigint"
    if n:
        # Half a row below the bound, so that rounding does not move it.
        grown = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n), minConfidence=0.0).fit(
            baskets.select("items")
        ).freqItemsets if least <= n else labelled.sparkSession.createDataFrame([], kinds)
    else:
        grown = labelled.sparkSession.createDataFrame([], kinds)
    sets = shared.stored(grown.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    marks = F.filter("items", lambda x: F.startswith(x, F.lit("=")))
    split = sets.select(
        F.filter("items", lambda x: ~F.startswith(x, F.lit("="))).alias("items"), "freq", F.try_element_at(marks, F.lit(1)).alias("mark"),
    ).filter(F.size("items") > 0)
    right = split.filter(F.col("mark").isNotNull()).withColumnRenamed("freq", "n")
    fits = split.filter(F.col("mark").isNull()).select("items", "freq")
    sure = right.join(fits, "items").select(
        "items", F.substring("mark", 2, 100).alias("verdict"), "n", (F.col("n") / F.col("freq")).alias("confidence")
    ).filter(F.col("confidence") >= min_confidence)
    counts = items.filter("token = item").select("item", F.col("n").alias("_n"))
    rarest = (
        sure.select("items", F.explode("items").alias("item")).distinct().join(checked_broadcast(counts, 128), "item")
        .groupBy("items").agg(F.min(F.struct("_n", "item")).alias("_least")).select("items", F.col("_least.item").alias("key"))
    )
    rules = shared.stored(sure.join(rarest, "items"), "rules")
    # Rules that a more general one makes needless, found by the same index.
    asking = rules.select(F.struct("items", "verdict", "confidence").alias("row"), "items")
    needless = matched(asking, rules).filter(
        (F.col("verdict") == F.col("row.verdict")) & (F.col("confidence") >= F.col("row.confidence"))
        & (F.size("needs") < F.size("row.items"))
    ).select(F.col("row.items").alias("items"), F.col("row.verdict").alias("verdict")).distinct()
    return items, shared.stored(rules.join(needless, ["items", "verdict"], "left_anti"), "pruned")


def judged(rows: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, verdict): block where the surest block rule is surer than the surest allow rule; other rows are left out."""
    met = matched(_in_items(rows, items), rules)
    sure = lambda name: F.coalesce(F.max(F.when(F.col("verdict") == name, F.col("confidence"))), F.lit(0.0))
    best = met.groupBy("row").agg(sure(BLOCK).alias("block"), sure(ALLOW).alias("allow"))
    return best.filter("block > allow").select("row", F.lit(BLOCK).alias("verdict"))


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, min_support: float = MIN_SUPPORT,
    min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    A rule of the list decides where one fits; else mined rules do, and what none of them blocks is allowed.
    A NULL url, an empty one and one without ``://`` have empty host and path, no rule and no tokens: allowed. Rows may
    repeat, ids may repeat or be NULL: every row comes out, equal urls with equal verdicts. Long urls are read whole. An empty
    table gives no rows; a list that decides nothing gives no mined rules. Other columns are passed over, whatever their names.
    """
    parts = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    found = parts.withColumn("found", listed(F.col("host"), F.col("path"), rules))
    numbered = shared.stored(
        found.select(
            F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", F.col("found.rule").alias("rule"),
            F.col("found.verdict").alias("listed"), tokens_of(F.col("url")).alias("tokens"),
        ), "urls",
    )
    items, mined = mine(
        numbered.filter("listed is not null").select("row", "tokens", F.col("listed").alias("verdict")),
        min_support, min_rows, min_confidence,
    )
    # Equal token sets are judged once.
    open_sets = numbered.filter("listed is null and size(tokens) > 0").groupBy("tokens").agg(F.min("row").alias("row"))
    open_sets = shared.stored(open_sets, "open")
    blocked = open_sets.join(judged(open_sets, items, mined), "row").select("tokens", "verdict")
    blocked = shared.stored(blocked, "blocked")
    return numbered.join(checked_broadcast(blocked, 512), "tokens", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("listed", "verdict", F.lit(ALLOW)).alias("verdict")
    )
