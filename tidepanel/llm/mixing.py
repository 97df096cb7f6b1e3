"""Mixing sources to target weights by pivotal rounding.

A source's target over its size is the number of times each of its documents is wanted: a whole part,
and a fraction that has to be rounded. Rounding is pivotal: of two documents one passes words to the
other until the fraction of one of the two is 0 or 1, in a random direction so that every document keeps
its expectation; the other goes on. A step moves as many words as it takes away, so a source's words
stay at its target, but for the last document, whose fraction is rounded to the nearer side.

The rounding is a reduction tree. Leaves hold some dozens of documents of one source and about one size;
a leaf leaves at most one document with a fraction, leaves of neighbouring keys meet in the next level,
and so on up to the source. Larger documents meet first, so that smaller ones are left to the end.
Everything is DataFrame functions, no group is larger than a leaf, and draws are hashes of the
documents' keys, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm import shared

# Weights in turn over the sources in order of their code points, share of all words, cap.
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
FAN_IN = 64
STEPS = 8  # size classes per doubling
UNIT = "struct<size:bigint,key:bigint,doc_id:bigint,n:int,p:double>"


def ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank`` from 0 in order of code points, NULL last, without one task for all.

    Sources are range-partitioned; a source's rank is its place in its partition plus the rows before it.
    """
    parts = max(1, sources.sparkSession.sparkContext.defaultParallelism)
    placed = shared.stored(
        sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "sources",
    )
    before, offsets = 0, []
    for row in placed.groupBy("part").count().orderBy("part").collect():  # a row per partition
        offsets.append((row["part"], before))
        before += row["count"]
    if not offsets:
        return placed.drop("part").withColumn("rank", F.lit(0).cast("bigint"))
    offset = F.create_map(*(F.lit(x) for pair in offsets for x in pair))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return placed.withColumn("rank", (own + F.element_at(offset, F.col("part"))).cast("bigint")).drop("part")


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """source, source_size, target from (source, size): weights in turn, capped, the excess shared anew.

    Sources are compared NULL-safe. Each round of sharing is one aggregate over the sources; a round
    only adds capped sources, and there is no further one when none is above its cap.
    """
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights)).cast("int"))
    held = shared.stored(
        ranked(sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))).withColumn("w", weight),
        "shares",
    )
    total = share * float(held.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    limit, capped_now = F.col("source_size") * F.lit(cap), -1
    per_weight = 0.0
    while True:
        above = F.lit(False) if capped_now < 0 else limit <= F.col("w") * F.lit(per_weight)
        facts = held.agg(
            F.sum(F.when(above, limit).otherwise(0.0)).alias("gone"), F.sum(F.when(~above, F.col("w")).otherwise(0.0)).alias("left"),
            F.count_if(above).alias("capped"),
        ).first()
        if not facts.left or facts.capped == capped_now:
            break
        capped_now, per_weight = facts.capped, (total - facts.gone) / facts.left
    return held.select(
        "source", "source_size", F.least(limit, F.col("w") * F.lit(per_weight)).cast("double").alias("target")
    )


def uniform(*keys: Column, seed: int) -> Column:
    """A number from 0 to below 1 that depends on the keys and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) * F.lit(2.0**-53)


def _pivot(units: Column, seed: int) -> Column:
    """(open: the unit still with a fraction, closed: units with p of 0 or 1) of a sorted array of units."""
    begin = F.struct(
        F.lit(None).cast(UNIT).alias("open"), F.array().cast(f"array<{UNIT}>").alias("closed")
    )

    def unit(x: Column, p: Column) -> Column:
        return F.struct(*(x[f].alias(f) for f in ("size", "key", "doc_id", "n")), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        one, two = acc["open"]["size"], x["size"]
        # Words that each of the two can lose and gain.
        lose_one, lose_two = acc["open"]["p"] * one, x["p"] * two
        gain_one, gain_two = one - lose_one, two - lose_two
        up, down = F.least(gain_one, lose_two), F.least(lose_one, gain_two)
        rises = uniform(acc["open"]["key"], x["key"], seed=seed) * (up + down) < down
        first_ends = F.when(rises, gain_one <= lose_two).otherwise(lose_one <= gain_two)
        rest = (
            F.when(rises & first_ends, (lose_two - gain_one) / two).when(rises, (lose_one + lose_two) / one)
            .when(first_ends, (lose_one + lose_two) / two).otherwise((lose_one - gain_two) / one)
        )
        rest = F.least(F.greatest(rest, F.lit(0.0)), F.lit(1.0))
        ended = F.when(rises == first_ends, F.lit(1.0)).otherwise(F.lit(0.0))
        go_on = F.when(first_ends, unit(x, rest)).otherwise(unit(acc["open"], rest))
        stop = F.when(first_ends, unit(acc["open"], ended)).otherwise(unit(x, ended))
        met = F.struct(go_on.alias("open"), F.concat(acc["closed"], F.array(stop)).alias("closed"))
        return F.when(acc["open"].isNull(), F.struct(x.alias("open"), acc["closed"].alias("closed"))).otherwise(met)

    return F.aggregate(units, begin, step)


def pivotal(units: DataFrame, fan_in: int = FAN_IN, seed: int = 0) -> DataFrame:
    """doc_id, n, source, size, chosen (0 or 1) for every unit (source, size, key, doc_id, n, p), size above 0.

    ``key`` must be unique for the draws to be independent.
    """
    spread = shared.stored(
        units.withColumn("band", F.floor(F.log2(F.col("size") + 1) * STEPS).cast("int")), "units"
    )
    counted = spread.groupBy("source", "band").count()
    most = counted.agg(F.max("count")).first()[0] or 0
    splits = F.ceil(F.col("_count") / fan_in).cast("bigint")
    named = counted.select(F.col("source").alias("_source"), F.col("band").alias("_band"), F.col("count").alias("_count"))
    level = spread.join(named, F.col("source").eqNullSafe(F.col("_source")) & (F.col("band") == F.col("_band"))).select(
        "source", "band", F.pmod(F.xxhash64("key"), splits).alias("leaf"),
        F.struct("size", "key", "doc_id", "n", "p").cast(UNIT).alias("unit"),
    )
    groups, leaves = [["source", "band", "leaf"]], -(-most // fan_in)
    while leaves > 1:
        groups.append(["source", "band", "leaf"])
        leaves = -(-leaves // fan_in)
    groups.append(["source"])
    closed = []
    for depth, keys in enumerate(groups):
        if depth:
            level = level.withColumn("leaf", F.floor(F.col("leaf") / fan_in).cast("bigint"))
        met = (
            level.groupBy(*keys).agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
            .withColumn("met", _pivot(F.col("units"), seed + depth)).drop("units")
        )
        if "band" not in keys:
            met = met.withColumns({"band": F.lit(0), "leaf": F.lit(0).cast("bigint")})
        met = shared.stored(met, "pivots")
        closed.append(met.select("source", F.explode("met.closed").alias("unit")))
        level = met.select("source", "band", "leaf", F.col("met.open").alias("unit"))
    last = F.col("unit.p") >= 0.5  # one unit a source is left
    out = level.select("source", "unit", last.cast("int").alias("chosen"))
    for part in closed:
        out = out.union(part.select("source", "unit", F.col("unit.p").cast("int").alias("chosen")))
    return out.select("unit.doc_id", "unit.n", "source", "unit.size", "chosen")


def plan(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP,
    fan_in: int = FAN_IN, seed: int = 0,
) -> DataFrame:
    """doc_id, n, source, size, source_size, target, copies: how often the mix takes every document.

    ``sizes`` is (doc_id, source, size). Rows that repeat in all three are documents of their own and are
    numbered by ``n`` from 1. A NULL source is a source, the last one; a NULL doc_id is an id like others; a
    document of size 0 gets the whole part only. Copies are the source's whole number or one more, so none
    exceeds the cap where that is whole. Without any words all targets and copies are 0.
    """
    same = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0))
    rows = shared.stored(
        sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.col("size").cast("bigint").alias("size"))
        .withColumn("n", F.row_number().over(same)), "sizes",
    )
    wanted = shared.stored(targets(rows, weights, share, cap), "targets")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    facts = wanted.select(
        F.col("source").alias("_source"), "source_size", "target", F.floor(rate).cast("int").alias("whole"),
        (rate - F.floor(rate)).alias("p"),
    )
    met = rows.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    chosen = pivotal(
        met.filter("p > 0 and size > 0").select("source", "size", F.xxhash64("doc_id", "source", "size", "n").alias("key"), "doc_id", "n", "p"),
        fan_in, seed,
    )
    exact = met.filter("p = 0 or size = 0").select("doc_id", "n", "source", "size", F.lit(0).alias("chosen"))
    every = chosen.unionByName(exact)
    return every.join(facts, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "n", "source", "size", "source_size", "target", (F.col("whole") + F.col("chosen")).alias("copies")
    )


def document_sizes(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "source", shared.digest_words(F.col("text")).alias("size"))


def mix_documents(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: its size, its source's size and target, and the words taken."""
    return plan(document_sizes(documents)).select(
        "doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), "target",
        (F.col("size") * F.col("copies")).cast("bigint").alias("taken"),
    )


def mixed(documents: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them; columns stay, whatever their names.

    Documents of one id, source and size are numbered by the hash of their text, so a rerun takes the same ones; of equal
    texts it does not matter which is taken. NULL ids, sources and texts count as values; no documents give no rows.
    """
    own = shared.free_prefix(documents.columns)
    planned = plan(document_sizes(documents)).filter("copies > 0").select(
        *(F.col(c).alias(f"{own}{c}") for c in ("doc_id", "source", "size", "n", "copies"))
    )
    same = Window.partitionBy("doc_id", "source", f"{own}words").orderBy(F.xxhash64("text"))
    rows = documents.withColumn(f"{own}words", shared.digest_words(F.col("text"))).withColumn(
        f"{own}row", F.row_number().over(same)
    )
    wanted = (
        F.col("doc_id").eqNullSafe(F.col(f"{own}doc_id")) & F.col("source").eqNullSafe(F.col(f"{own}source"))
        & (F.col(f"{own}words") == F.col(f"{own}size")) & (F.col(f"{own}row") == F.col(f"{own}n"))
    )
    return (
        rows.join(planned, wanted).withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}copies"))))
        .select(*documents.columns)
    )
