"""Language-model scores: prediction by partial matching over bytes, and a word unigram base.

The model is a trie of byte contexts up to ``ORDER``, pretrained on all training texts. Symbols are the
256 bytes and one mark that ends a text; the same mark pads the context of its first bytes. A symbol
is coded in the longest context of its position that the training texts hold: seen there with count c,
at c / (n + d), with n the context's total and d its distinct symbols; else an escape of d / (n + d)
leads one order down, where the symbols of the context just left are excluded from n and d. Below
order 0 the symbols left are equally likely. So a text's probabilities sum to one over all symbols.

Counts come from one shuffled sum over all training texts. The exclusion depends on the context left
alone, so it is worked out once per context when the trie is laid out, and scoring is table look-up.
The trie goes to the workers in shards of bounded size: all contexts that end in the same two symbols
lie in one shard, every shard scores the positions that it owns, and a document's score is their sum.
A trie of up to ``SHARD_ROWS`` rows is one shard and one pass.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm import shared
from tidepanel.llm.neardup import mix

ORDER = 4
BITS, MARK = 9, 256
SYMBOLS = 257
SHARD_ROWS = 4_000_000
SLICE_BYTES = 2 * 1024 * 1024
HELD_ROWS = 1_000_000
#: Words of at least one token in so many are broadcast: there cannot be more of them than this.
FREQUENT = 131_072


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text leaves 2 by 7."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every position's context and symbol, nine bits each, and the number per text."""
    pad = bytes(order)
    joined = np.frombuffer(b"".join(part for text in texts for part in (pad, text, b"\0")), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes + order)
    symbols = joined.astype(np.uint64)
    symbols[ends - 1] = MARK
    for i in range(order):
        symbols[ends - sizes - order + i] = MARK
    code = symbols[: len(symbols) - order].copy()
    for i in range(1, order + 1):
        code <<= np.uint64(BITS)
        code |= symbols[i : len(symbols) - order + i]
    # A window that starts in one text and ends in the next predicts nothing.
    starts = np.zeros(len(code) + 1, np.int8)
    np.add.at(starts, ends - sizes - order, 1)
    np.add.at(starts, np.minimum(ends - order, len(code)), -1)
    return code[np.cumsum(starts[:-1]).astype(bool)], sizes


def slices(values: Iterator[str | None], limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """UTF-8 texts in consecutive lists of about ``limit`` bytes; NULL is an empty text."""
    held, size = [], 0
    for value in values:
        held.append((value or "").encode())
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with their counts added."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, n) over all whole texts, summed per task before the shuffle."""

    def batch_of(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        codes, counts = summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts)], names=["code", "n"])

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for part in slices(shared.texts_of(batch, "text")):
                found, counts = np.unique(grams(part, order)[0], return_counts=True)
                held.append((found, counts.astype(np.int64)))
                rows += len(found)
                if rows > HELD_ROWS:
                    codes, counts = summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held, rows = [(codes, counts)], len(codes)
                    if 2 * rows > HELD_ROWS:
                        yield batch_of(held)
                        held, rows = [], 0
        if held:
            yield batch_of(held)

    return texts.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the lower-cased words of all whole texts, summed per slice before the shuffle."""
    schema = {"word": pa.binary(), "n": pa.int64()}

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return shared.arrow_of(schema, {"word": list(counts), "n": list(counts.values())})

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in shared.texts_of(batch, "text"):
                counts.update(shared.lowered_words(value))
                if len(counts) > HELD_ROWS // 4:
                    yield batch_of(counts)
                    counts = Counter()
        if counts:
            yield batch_of(counts)

    return texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Lookup:
    """Positions of 64-bit codes in a table, by open addressing; -1 if absent."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(2.5 * max(1, len(codes))))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.codes = codes
        at, left = self._slot(codes), np.arange(len(codes))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slots[at[left]] < 0
            self.slots[at[left[free]]] = left[free]  # of several for one slot the last stays
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (((codes ^ (codes >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), -1, np.int64)
        if not len(self.codes):
            return out
        at, left = self._slot(codes), None
        for _ in range(self.probes):
            row = self.slots[at]
            asked = codes if left is None else codes[left]
            hit = (row >= 0) & (self.codes[row] == asked)
            if left is None:
                out[hit] = row[hit]
                left = np.flatnonzero(~hit & (row >= 0))
                at = (at[left] + 1) & ((1 << self.bits) - 1)
            else:
                out[left[hit]] = row[hit]
                go_on = ~hit & (row >= 0)
                left, at = left[go_on], (at[go_on] + 1) & ((1 << self.bits) - 1)
            if not len(left):
                break
        return out


class Trie:
    """A shard of the trie laid out for look-up: per order, counts of symbols and facts of contexts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int = ORDER):
        """``codes`` of full order; ``low`` the order-1 codes and counts of all shards together."""
        self.order = order
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for j in range(order + 1):
            mask = np.uint64((1 << (BITS * (j + 1))) - 1)
            pairs.append(summed(low[0] & mask, low[1]) if j < 2 else summed(codes & mask, counts))
        self.pair, self.log_count, self.context = [], [], []
        self.log_all, self.escape_top, self.log_left, self.escape_low = [], [], [], []
        before = None
        for j, (code, count) in enumerate(pairs):
            context, first = np.unique(code >> np.uint64(BITS), return_index=True)
            n = np.add.reduceat(count, first) if len(first) else count
            d = np.diff(np.append(first, len(code)))
            self.pair.append(Lookup(code))
            self.context.append(Lookup(context))
            self.log_count.append(np.log10(count.astype(np.float64)))
            self.log_all.append(np.log10((n + d).astype(np.float64)))
            self.escape_top.append(np.log10(d.astype(np.float64)) - self.log_all[-1])
            if before is None:
                self.log_left.append(np.zeros(len(context)))
                self.escape_low.append(np.zeros(len(context)))
            else:
                shorter, total, distinct = before
                shorter_pair = self.pair[j - 1].of(code & np.uint64((1 << (BITS * j)) - 1))
                gone = np.add.reduceat(shorter[shorter_pair], first) if len(first) else shorter[:0]
                parent = self.context[j - 1].of(context & np.uint64((1 << (BITS * (j - 1))) - 1))
                new = (distinct[parent] - d).astype(np.float64)
                left = total[parent] - gone + new
                with np.errstate(divide="ignore", invalid="ignore"):
                    self.log_left.append(np.where(left > 0, np.log10(left), 0.0))
                    self.escape_low.append(np.where(new > 0, np.log10(new) - np.log10(left), 0.0))
            before = count, n, d
        self.unseen = SYMBOLS - len(pairs[0][0])
        top = self.context[order].of(self.pair[order].codes >> np.uint64(BITS))
        self.top = self.log_count[order] - self.log_all[order][top]

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Log10 probability of the symbol of every full-order code."""
        row = self.pair[self.order].of(codes)
        out = self.top[row] if len(self.top) else np.zeros(len(codes))
        rest = np.flatnonzero(row < 0)
        if len(rest):
            out[rest] = self._escaping(codes[rest])
        return out

    def _escaping(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        open_, left = np.arange(len(codes)), np.full(len(codes), -1, np.int64)
        for j in range(self.order, -1, -1):
            code = codes[open_] & np.uint64((1 << (BITS * (j + 1))) - 1)
            context = self.context[j].of(code >> np.uint64(BITS))
            pair = self.pair[j].of(code)
            came = left[open_] >= 0
            found = pair >= 0
            gain = np.zeros(len(open_))
            if len(self.log_count[j]):
                gain[found] = self.log_count[j][pair[found]]
            if j < self.order and came.any():
                prior = left[open_[came]]
                hit = found[came]
                gain[came] += np.where(hit, -self.log_left[j + 1][prior], self.escape_low[j + 1][prior])
            new = ~came & (context >= 0)
            if new.any():
                gain[new] += np.where(found[new], -self.log_all[j][context[new]], self.escape_top[j][context[new]])
            out[open_] += gain
            left[open_] = context
            open_ = open_[~found]
            if not len(open_):
                break
        out[open_] -= np.log10(self.unseen)
        return out


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """Shard that owns a position: by the last two symbols of its context."""
    pair = (codes >> np.uint64(BITS)) & np.uint64((1 << (2 * BITS)) - 1)
    return (mix(pair) % np.uint64(shards)).astype(np.int64)


def _arrays(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = frame.select("code", "n").toArrow()
    return table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy().copy()


def tries(counted: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> tuple[int, Iterator[Trie]]:
    """Number of shards, and the shards one after the other; ``counted`` is a stored (code, n)."""
    rows = counted.count()
    number = max(1, math.ceil(rows / shard_rows))
    # At most 257 * 257 rows: symbol and the one before it.
    low = _arrays(
        counted.groupBy(F.col("code").bitwiseAND((1 << (2 * BITS)) - 1).alias("code")).agg(F.sum("n").alias("n"))
    )

    def made() -> Iterator[Trie]:
        for shard in range(number):
            def own(batches: Iterator[pa.RecordBatch], shard: int = shard) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    codes = batch.column("code").to_numpy().view(np.uint64)
                    yield batch.filter(pa.array(shard_of(codes, number) == shard))

            part = counted if number == 1 else counted.mapInArrow(own, "code bigint, n bigint")
            codes, counts = _arrays(part)
            yield Trie(codes, counts, low, order)

    return number, made()


def text_scores(trie: Trie, texts: list[bytes], shard: int = 0, shards: int = 1) -> np.ndarray:
    """Log10 probabilities of whole texts, over the positions that the shard owns."""
    codes, sizes = grams(texts, trie.order)
    logs = np.zeros(len(codes))
    if shards == 1:
        logs = trie.log10(codes)
    else:
        own = np.flatnonzero(shard_of(codes, shards) == shard)
        logs[own] = trie.log10(codes[own])
    return np.add.reduceat(logs, np.concatenate(([0], np.cumsum(sizes)[:-1])))


def _scored(texts: DataFrame, trie: Trie, shard: int, number: int) -> DataFrame:
    """Add ``score``, the sum over the positions that the shard owns."""
    model = texts.sparkSession.sparkContext.broadcast(trie)

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [text_scores(model.value, part, shard, number) for part in slices(shared.texts_of(batch, "text"))]
            score = pa.array(np.concatenate(scores) if scores else np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "score"])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("score", T.DoubleType())]))


IDENTITY = ["doc_id", "_hash", "_size"]


def ppm_scores(
    documents: DataFrame, counted: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Documents (doc_id, text) with ``score``, and what further shards add to it, if there are any.

    The second table has a row per distinct (doc_id, hash and size of the text): equal texts have equal
    scores. ``added`` joins it on.
    """
    number, made = tries(counted, order, shard_rows)
    named = documents.select(
        "doc_id", "text", F.xxhash64("text").alias("_hash"), F.octet_length(F.coalesce("text", F.lit(""))).alias("_size")
    )
    first = _scored(named, next(made), 0, number)
    parts = [_scored(named, trie, shard, number) for shard, trie in enumerate(made, 1)]
    if not parts:
        return first, None
    more = None
    for part in parts:
        part = part.groupBy(*IDENTITY).agg(F.first("score").alias("_more"))
        more = part if more is None else more.union(part)
    return first, more.groupBy(*IDENTITY).agg(F.sum("_more").alias("_more"))


def added(scored: DataFrame, more: DataFrame | None) -> DataFrame:
    """The scores of all shards together."""
    if more is None:
        return scored
    right = more.select(*(F.col(c).alias(f"_r{c}") for c in IDENTITY), "_more")
    same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in IDENTITY]
    return scored.join(right, same, "left").withColumn("score", F.col("score") + F.coalesce("_more", F.lit(0.0))).drop(
        "_more", *(f"_r{c}" for c in IDENTITY)
    )


def base_scores(documents: DataFrame, counts: DataFrame, tokens: int, distinct: int, ends: int) -> DataFrame:
    """Replace ``text`` by n_tokens, n_known and base_score; other columns stay.

    Frequent words meet a broadcast table that cannot have more than ``FREQUENT`` rows. The others are
    joined by word; none of them has more than a small share of the rows.
    """
    kept = [c for c in documents.columns if c != "text"]
    frequent = {
        bytes(r.word): r.n for r in counts.filter(F.col("n") * FREQUENT >= tokens).toLocalIterator()
    }
    known = documents.sparkSession.sparkContext.broadcast(frequent)
    below = math.log10(tokens + distinct + 1)
    end_score, end_known = math.log10(ends + 1) - below, int(ends > 0)
    names = ["n_tokens", "n_known", "base_score"]

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = {word: math.log10(n + 1) - below for word, n in known.value.items()}
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            words_out, counts_out, offsets = [], [], [0]
            for value in shared.texts_of(batch, "text"):
                words = Counter(shared.lowered_words(value))
                n_tokens, n_known, score = 1, end_known, end_score
                for word, n in words.items():
                    n_tokens += n
                    log = logs.get(word)
                    if log is None:
                        words_out.append(word)
                        counts_out.append(n)
                    else:
                        n_known += n
                        score += n * log
                offsets.append(len(words_out))
                out.append((n_tokens, n_known, score))
            rare = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays([pa.array(words_out, pa.binary()), pa.array(counts_out, pa.int64())], ["word", "n"]),
            )
            kinds = (pa.int64(), pa.int64(), pa.float64())
            made = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *made, rare], names=[*kept, *names, "rare"]
            )

    fields = T.StructType([*(documents.schema[c] for c in kept)])
    for name, kind in zip(names, ("long", "long", "double"), strict=True):
        fields = fields.add(name, kind)
    fields = fields.add("rare", T.ArrayType(T.StructType().add("word", "binary").add("n", "long")))
    first = shared.stored(
        documents.mapInArrow(run, fields).withColumn("_row", F.monotonically_increasing_id()), "base"
    )
    rare = first.select("_row", F.explode("rare").alias("w")).select(
        "_row", F.col("w.word").alias("word"), F.col("w.n").alias("times")
    )
    logs = F.log10(F.coalesce("n", F.lit(0)) + 1) - F.lit(below)
    more = (
        rare.join(counts, "word", "left").groupBy("_row")
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_known"),
            F.sum(F.col("times") * logs).alias("_score"),
        )
    )
    return first.drop("rare").join(more, "_row", "left").select(
        *kept, "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("_score", F.lit(0.0))).alias("base_score"),
    )


def score_documents(documents: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): tokens, unigram base and PPM score.

    Both models learn from the documents that are not held out; a NULL doc_id counts as an empty text
    for that rule. NULL and empty texts have the end mark alone. Without training documents the base
    score is 0 and the model is uniform over its symbols. Other columns are passed over.
    """
    spark = documents.sparkSession
    shared.prepare(spark)
    rows = documents.select("doc_id", "text")
    train = rows.filter(~held_out(F.col("doc_id")))
    counts = shared.stored(word_counts(train), "words")
    counted = shared.stored(gram_counts(train, order), "grams")
    ends = train.count()
    facts = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = (facts.n or 0) + ends, facts.v + int(ends > 0)
    scored, more = ppm_scores(rows, counted, order, shard_rows)
    based = base_scores(scored, counts, tokens, distinct, ends)
    return added(based, more).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
