"""Secrets in texts: fixed patterns, and two character Markov models compared by log-likelihood ratio.

All work on rows is DataFrame functions. A pattern's places come from two passes that cut alike: the
matches, and the pieces between them, whose lengths add up to the matches' starts.

The models are first-order chains over printable ASCII, fitted to labelled samples: random strings
(label 1) and ordinary identifiers (label 0). A candidate is a run of characters that keys are made of, of
8 or more if it holds a digit or a capital after a small letter, else of 20 or more. What base spans
leave of it is cut at separators, and the pieces are scored by the log-likelihood ratio of the two models.
Pieces in favour of the random model join across pieces that hardly speak against it; a joined stretch
of ``MINIMUM_LENGTH`` characters is a secret if its ratio passes ``MINIMUM_RATIO`` in total and
``MINIMUM_MEAN`` per character. So a random tail of a path is found without the path, and a random rest
beside a base span is found too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import shared

# Kinds in their order, their patterns, and the least length where a match may fail.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MINIMUM = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run of 16 or more; shorter ones fail whole
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "model")

RUN = "[A-Za-z0-9+/_=-]"
# Only tried where a run begins, and only if it has eight characters.
CANDIDATE = f"(?<!{RUN})(?={RUN}{{8}})(?:(?=[A-Za-z+/_=-]*+[0-9]|[A-Za-z+/_=-]*?[a-z][A-Z]){RUN}{{8,}}|{RUN}{{20,}})"
PIECE = r"[A-Za-z0-9+]+"
MINIMUM_RATIO, MINIMUM_MEAN, MINIMUM_LENGTH = 14.0, 0.5, 8
AGAINST = -2.0  # a piece below this ends a stretch
SAMPLE_DOCUMENTS = 2000
FIRST, SYMBOLS = 32, 95
LEAN = 10.0
BLOCK = 256
SPAN = "struct<start:int,rank:int,end:int>"


def located(text: Column, pattern: str, matches: Column) -> Column:
    """Start, end (exclusive, code points) and value of each match, in order.

    Matches are walked in blocks of ``BLOCK``, so that a long text costs no square of its matches.
    """
    kind = "array<struct<start:int,end:int,value:string>>"
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    paired = F.zip_with(pieces, matches, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))

    def moved(span: Column, by: Column) -> Column:
        return F.struct((span["start"] + by).alias("start"), (span["end"] + by).alias("end"), span["value"].alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def walked(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step)

    def after(acc: Column, block: Column) -> Column:
        shifted = F.transform(block["out"], lambda span: moved(span, acc["at"]))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(shifted)).alias("out"))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")),
        lambda k: walked(F.slice(paired, k * BLOCK + 1, F.least(F.lit(BLOCK), F.size(matches) - k * BLOCK))),
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    every = F.flatten(F.aggregate(blocks, begin, after, lambda acc: acc["out"]))
    return F.when(F.size(matches) > 0, every).otherwise(F.array().cast(kind))


def _ranked(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"))
    )


def base_spans(documents: DataFrame, text: str = "text", own: str = "_") -> DataFrame:
    """Add ``base``, sorted spans (start, rank of the kind, end) of the fixed patterns, and ``candidates``.

    ``own`` goes in front of the names of added columns.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidates": CANDIDATE}
    col = {k: f"{own}{k}" for k in patterns}
    made = documents.withColumns({col[k]: F.regexp_extract_all(body, F.lit(p), F.lit(0)) for k, p in patterns.items()})
    made = made.withColumns({col[k]: located(body, p, F.col(col[k])) for k, p in patterns.items()})
    long_enough = F.filter(
        col["assign"], lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_MINIMUM
    )
    base = F.concat(
        _ranked(long_enough, "assign"), _ranked(F.col(col["access"]), "access"), _ranked(F.col(col["hex"]), "hex")
    )
    return made.withColumn(f"{own}base", F.array_sort(base)).drop(col["assign"], col["access"], col["hex"])


# --- the models -----------------------------------------------------------------------------------


def sample_texts(documents: DataFrame, rows: int = SAMPLE_DOCUMENTS, text: str = "text") -> DataFrame:
    """The ``rows`` documents with the smallest hash of their id: the same ones on every run."""
    ids = documents.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return documents.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(
        F.broadcast(ids), "doc_id", "left_semi"
    )


def labelled_samples(texts: DataFrame) -> DataFrame:
    """(value, label) from a bounded sample of texts (doc_id, text).

    Label 1: values that the fixed patterns find, and random strings in the usual alphabets, made from
    digests of the ids. Label 0: words, numbers among them, and words joined as identifiers are. Words
    that mix digits and letters over 15 characters have no label.
    """
    value = "text"
    found = F.concat(
        F.regexp_extract_all(value, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(value, F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all(value, F.lit(HEX), F.lit(0)),
    )
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    made = F.array(
        F.substring(digest, 1, 40), coded, F.regexp_replace(coded, "[+/=]", ""),
        F.translate(F.upper(coded), "+/=", ""), F.translate(coded, "+/=", "-_"),
    )
    random = texts.select(F.explode(F.concat(found, made)).alias("value")).filter(F.char_length("value") >= 8).withColumn("label", F.lit(1))
    words = texts.select(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{2,}"), F.lit(0)).alias("w"))
    mixed = (F.char_length("value") > 15) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    single = words.select(F.explode("w").alias("value")).filter(~mixed)
    joined = words.filter("size(w) > 2").select(
        F.explode(
            F.array(
                F.concat_ws("_", F.slice("w", 1, 3)), F.concat_ws("-", F.slice("w", 1, 3)), F.concat_ws("/", F.slice("w", 1, 3)),
                F.array_join(F.transform(F.slice("w", 1, 3), F.initcap), ""),
            )
        ).alias("value")
    ).filter(~F.col("value").rlike("[0-9]"))
    ordinary = single.union(joined).withColumn("label", F.lit(0))
    return random.union(ordinary)


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of every character pair, as a table of ``SYMBOLS`` squared numbers.

    ``samples`` is (value, label). Pair counts are summed by Spark; what reaches the driver is at most one
    count per label and pair. A pair's probability leans on that of its second character with ``LEAN``
    pseudo-counts, and a character counts half once more than seen; without samples of a label its model is
    uniform.
    """
    codes, size = F.transform(F.split("value", ""), lambda c: F.ascii(c)), F.char_length("value") - 1
    both = F.zip_with(
        F.slice(codes, F.lit(1), size), F.slice(codes, F.lit(2), size), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    pairs = (
        samples.filter(F.char_length("value") > 1).select("label", F.explode(both).alias("p")).select("label", "p.a", "p.b")
        .filter(F.col("a").between(FIRST, FIRST + SYMBOLS - 1) & F.col("b").between(FIRST, FIRST + SYMBOLS - 1))
        .groupBy("label", "a", "b").count()
    )
    counts = [[[0.0] * SYMBOLS for _ in range(SYMBOLS)] for _ in range(2)]
    for row in pairs.collect():
        counts[int(row.label == 1)][row.a - FIRST][row.b - FIRST] += row["count"]
    logs = []
    for table in counts:
        single = [sum(row[b] for row in table) + 0.5 for b in range(SYMBOLS)]
        whole = sum(single)
        logs.append([
            math.log((row[b] + LEAN * single[b] / whole) / (sum(row) + LEAN)) for row in table for b in range(SYMBOLS)
        ])
    return [random - ordinary for ordinary, random in zip(*logs, strict=True)]


def ratio(value: Column, table: list[float]) -> Column:
    """Sum of the pairs' log-likelihood ratios over a string of printable ASCII, not empty."""
    held = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    codes, pairs = F.transform(F.split(value, ""), lambda c: F.ascii(c) - FIRST), F.char_length(value) - 1
    places = F.zip_with(F.slice(codes, F.lit(1), pairs), F.slice(codes, F.lit(2), pairs), lambda a, b: a * SYMBOLS + b)
    return F.aggregate(places, F.lit(0.0), lambda acc, place: acc + F.get(held, place))


def uncovered(candidate: Column, base: Column) -> Column:
    """(start, end) of the parts of a candidate that no base span covers."""
    begin = F.struct(candidate["start"].alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(acc: Column, upto: Column) -> Column:
        part = F.array(F.struct(acc["at"].alias("start"), upto.alias("end")))
        return F.when(upto > acc["at"], F.concat(acc["out"], part)).otherwise(acc["out"])

    touching = F.filter(base, lambda b: (b["start"] < candidate["end"]) & (candidate["start"] < b["end"]))
    return F.aggregate(
        touching, begin,
        lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), add(acc, b["start"]).alias("out")),
        lambda acc: add(acc, candidate["end"]),
    )


def scored_pieces(candidate: Column, part: Column, table: list[float]) -> Column:
    """(start, end, score) of the pieces between separators of a part of a candidate."""
    value = F.substr(candidate["value"], part["start"] - candidate["start"] + 1, part["end"] - part["start"])
    return F.transform(
        located(value, PIECE, F.regexp_extract_all(value, F.lit(PIECE), F.lit(0))),
        lambda p: F.struct(
            (part["start"] + p["start"]).alias("start"), (part["start"] + p["end"]).alias("end"),
            ratio(p["value"], table).alias("score"),
        ),
    )


def stretches(pieces: Column) -> Column:
    """(start, end, score, size) of joined pieces: from one in favour to the last one in favour.

    ``late`` and ``more`` are score and size of the pieces since the last one in favour.
    """
    kind = "array<struct<start:int,end:int,score:double,size:int,late:double,more:int>>"
    begin = F.struct(F.lit(False).alias("open"), F.array().cast(kind).alias("out"))

    def stretch(start: Column, end: Column, score: Column, size: Column, late: Column, more: Column) -> Column:
        names = ("start", "end", "score", "size", "late", "more")
        return F.array(F.struct(*[c.alias(n) for c, n in zip((start, end, score, size, late, more), names)]))

    def step(acc: Column, p: Column) -> Column:
        size, none, zero = p["end"] - p["start"], F.lit(0.0), F.lit(0)
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        before = F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))
        grown = stretch(
            last["start"], p["end"], last["score"] + last["late"] + p["score"], last["size"] + last["more"] + size, none, zero
        )
        waiting = stretch(last["start"], last["end"], last["score"], last["size"], last["late"] + p["score"], last["more"] + size)
        fresh = stretch(p["start"], p["end"], p["score"], size, none, zero)
        favour, neutral = p["score"] > 0, p["score"] >= AGAINST
        out = (
            F.when(favour & acc["open"], F.concat(before, grown)).when(favour, F.concat(acc["out"], fresh))
            .when(neutral & acc["open"], F.concat(before, waiting)).otherwise(acc["out"])
        )
        return F.struct((favour | (neutral & acc["open"])).alias("open"), out.alias("out"))

    return F.aggregate(pieces, begin, step, lambda acc: acc["out"])


def scan(
    documents: DataFrame, table: list[float], text: str = "text", own: str = "",
    minimum_ratio: float = MINIMUM_RATIO, minimum_mean: float = MINIMUM_MEAN,
) -> DataFrame:
    """Add ``base`` and ``spans``: sorted arrays of (start, rank, end); ``KINDS`` names the ranks.

    NULL text counts as empty. Spans of different kinds may overlap, as each kind is matched by itself.
    Columns stay; ``own`` goes in front of the two names.
    """
    made = base_spans(documents, text, own)
    pieces = F.transform(
        F.col(f"{own}candidates"),
        lambda c: F.flatten(F.transform(uncovered(c, F.col(f"{own}base")), lambda part: stretches(scored_pieces(c, part, table)))),
    )
    likely = F.filter(
        F.flatten(pieces),
        lambda s: (s["score"] >= minimum_ratio) & (s["score"] >= minimum_mean * s["size"])
        & (s["end"] - s["start"] >= MINIMUM_LENGTH),
    )
    return made.withColumn(f"{own}spans", F.array_sort(F.concat(f"{own}base", _ranked(likely, "model")))).drop(
        f"{own}candidates"
    )


def named(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch of touching spans replaced by the mark; unchanged without spans."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        before = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(new, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    whole = F.aggregate(
        spans, begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.char_length(text)))
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def trained(documents: DataFrame, text: str = "text", rows: int = SAMPLE_DOCUMENTS) -> list[float]:
    """The table fitted to a bounded sample of the documents."""
    return fit(labelled_samples(sample_texts(documents, rows, text)))


def find_secrets(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): counts of the base kinds, their digest, all spans."""
    shared.prepare(documents.sparkSession)
    rows = documents.select("doc_id", "text")
    made = scan(rows, trained(rows))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("bigint")
    return made.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"),
    )
