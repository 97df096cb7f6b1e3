"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = sigmoid(w.x - threshold_k): one set of weights for all grades, and ordered thresholds.
The output is the expected severity, the sum of these probabilities, and the most likely grade.

The model is fitted to a bounded sample of labelled documents, at most ``FIT_ROWS``; every document is
scored, whole. Features are words and beginnings of words, so that inflected forms count together, from
a vocabulary chosen by how surely a feature's share of toxic documents differs from the average; its
value grows slowly with its share of the text, from a constant for any occurrence, so that a long text
counts as well. Copies and near copies in the
sample count once, else the words of an often copied document would pass for signs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm import shared

FIT_ROWS = 20_000
SKETCHES, SKETCH_WORDS = 4, 4
PREFIXES = (4, 5, 6, 7)
VOCABULARY = 4096
#: Least documents of a word, and least log-likelihood ratio: by itself and as a part of the strongest word's.
LEAST_DOCUMENTS, LEAST_RATIO, LEAST_PART = 5, 12.0, 0.05
#: A toxic text's grade rises where it has more than so many different words that are typical of toxic texts.
GRADE_WORDS = (3, 6)
PENALTY = 1e-4
LETTERS = re.compile(rb"[a-z\x80-\xff]+")


def letter_words(text: str | None) -> list[bytes]:
    """Runs of letters, A-Z lower-cased; other scripts are runs as well."""
    return [] if text is None else LETTERS.findall(text.encode().translate(shared.LOWER))


def features_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings of ``PREFIXES`` bytes with a mark in front."""
    return [word, *(b"^" + word[:k] for k in PREFIXES if len(word) > k)]


def value(count: int, total: int) -> float:
    """Feature value of a word that occurs ``count`` times in a text of ``total`` words."""
    return 1.0 + 0.25 * math.log1p(200.0 * count / total)


# --- the sample -----------------------------------------------------------------------------------


def cut(batch: pa.RecordBatch, rows: int = 128) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of a few rows, as features take many times a text's memory."""
    return (batch.slice(start, rows) for start in range(0, batch.num_rows, rows))


def labelled(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, toxic, words, counts, features, total) of at most ``rows`` labelled documents.

    They are those with the smallest hash of their id. Of several labels for an id the largest counts;
    NULL ids and labels are passed over. A document that shares one of its ``SKETCHES`` smallest hashed
    runs of words (under as many hash functions) with one of a smaller id is passed over: that is so for
    copies and nearly all near copies, and for hardly any others.
    """
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    schema = {
        "doc_id": pa.int64(), "toxic": pa.int32(), "sketch": pa.list_(pa.int64()), "words": pa.list_(pa.binary()),
        "counts": pa.list_(pa.int32()), "features": pa.list_(pa.binary()), "total": pa.int64(),
    }

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in cut(whole)):
            made: dict[str, list] = {n: [] for n in ("sketch", "words", "counts", "features", "total")}
            for text in shared.texts_of(batch, "text"):
                words = letter_words(text)
                counted = Counter(words)
                runs = [b" ".join(words[i : i + SKETCH_WORDS]) for i in range(max(1, len(words) - SKETCH_WORDS + 1))]
                made["sketch"].append([
                    min(xxhash.xxh3_64_intdigest(r, seed) for r in runs) - (1 << 63) for seed in range(SKETCHES)
                ])
                made["words"].append(list(counted))
                made["features"].append(list({f for w in counted for f in features_of(w)}))
                made["counts"].append(list(counted.values()))
                made["total"].append(len(words))
            yield shared.arrow_of(schema, {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), **made})

    made_rows = shared.stored(
        texts.select("doc_id", "toxic", "text").mapInArrow(
            run, "doc_id bigint, toxic int, sketch array<bigint>, words array<binary>, counts array<int>, "
            "features array<binary>, total bigint",
        ), "sketched",
    )
    sketched = made_rows.select("doc_id", F.posexplode("sketch"))
    leaders = sketched.groupBy("pos", "col").agg(F.min("doc_id").alias("leader"))
    copies = sketched.join(leaders, ["pos", "col"]).filter("leader < doc_id").select("doc_id").distinct()
    return shared.stored(made_rows.drop("sketch").join(copies, "doc_id", "left_anti"), "labelled")


def vocabulary(sample: DataFrame, size: int = VOCABULARY) -> dict[bytes, float]:
    """Log-likelihood ratios of the words that tell most, negative for words of clean documents.

    The ratio compares one share of toxic documents for the word with the share among all.
    """
    rows, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == rows:
        return {}
    share = toxic / rows
    t, n = F.col("toxic"), F.col("n")

    def term(count: Column, part: float) -> Column:
        return F.when(count > 0, count * F.log(count / (n * part))).otherwise(0.0)

    counted = (
        sample.select("toxic", F.explode("features").alias("word")).groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).filter(n >= LEAST_DOCUMENTS)
        .withColumn("ratio", 2 * (term(t, share) + term(n - t, 1 - share)))
        .select("word", "ratio", F.signum(t - n * share).alias("side"))
    )
    top = counted.filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "word").limit(size).collect()
    least = LEAST_PART * max((r.ratio for r in top), default=0.0)
    return {bytes(r.word): r.side * r.ratio for r in top if r.ratio >= least}  # at most ``size`` words


def graded(sample: DataFrame, words: dict[bytes, float], steps: tuple[int, ...] = GRADE_WORDS) -> DataFrame:
    """(grade, at, x): sparse features, and grade 0 for clean documents, else 1 and up by typical words.

    Labels only say toxic or not; a toxic document's grade is 1, and one more for every one of ``steps``
    that the number of its different typical words passes.
    """
    place = {word: i for i, word in enumerate(words)}
    schema = {"grade": pa.int32(), "at": pa.list_(pa.int32()), "x": pa.list_(pa.float64())}

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in cut(whole)):
            grades, ats, xs = [], [], []
            for toxic, found, counts, total in zip(*(batch.column(n).to_pylist() for n in ("toxic", "words", "counts", "total"))):
                times: Counter = Counter()
                typical = 0
                for word, n in zip(found, counts):
                    known = [f for f in features_of(word) if f in place]
                    times.update(dict.fromkeys(known, n))
                    typical += any(words[f] > 0 for f in known)
                grades.append(0 if toxic <= 0 else 1 + sum(typical > s for s in steps))
                ats.append([place[f] for f in times])
                xs.append([value(n, total) for n in times.values()])
            yield shared.arrow_of(schema, {"grade": grades, "at": ats, "x": xs})

    return shared.stored(sample.mapInArrow(run, "grade int, at array<int>, x array<double>"), "graded")


# --- the fit --------------------------------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def thresholds_of(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first as it is, every further one above it by an exponential."""
    return np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])


def loss_and_gradient(
    grade: np.ndarray, at: list[np.ndarray], x: list[np.ndarray], weights: np.ndarray, free: np.ndarray
) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of rows, and its gradient by weights and free thresholds."""
    theta = thresholds_of(free)
    rows = np.repeat(np.arange(len(grade)), [len(a) for a in at])
    where = np.concatenate(at).astype(np.int64) if len(at) else np.empty(0, np.int64)
    values = np.concatenate(x) if len(x) else np.empty(0)
    score = np.bincount(rows, weights[where] * values, len(grade))
    edges = np.concatenate([[-np.inf], theta, [np.inf]])
    upper, lower = _sigmoid(edges[grade + 1] - score), _sigmoid(edges[grade] - score)
    p = np.maximum(upper - lower, 1e-300)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_theta = np.bincount(grade, -du, len(theta) + 1)[: len(theta)] + np.bincount(grade, dl, len(theta) + 1)[1:]
    tail = np.cumsum(by_theta[::-1])[::-1]
    by_free = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
    by_weight = np.bincount(where, (du - dl)[rows] * values, len(weights))
    return float(-np.log(p).sum()), np.concatenate([by_weight, by_free])


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 40, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving."""
    x, pairs = start, []
    loss, gradient = f(x)
    for _ in range(rounds):
        if np.abs(gradient).max() < 1e-5:
            break
        direction, stack = gradient.copy(), []
        for s, y in reversed(pairs):
            a = (s @ direction) / (y @ s)
            stack.append(a)
            direction -= a * y
        if pairs:
            s, y = pairs[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(1.0, np.linalg.norm(direction))
        for (s, y), a in zip(pairs, reversed(stack)):
            direction += (a - (y @ direction) / (y @ s)) * s
        step, slope = 1.0, gradient @ direction
        while True:
            new = x - step * direction
            new_loss, new_gradient = f(new)
            if new_loss <= loss - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = new - x, new_gradient - gradient
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(loss - new_loss) < 1e-7 * max(1.0, abs(loss))
        x, loss, gradient = new, new_loss, new_gradient
        if done:
            break
    return x


class Known(dict):
    """Features with a weight of every word met, at most ``limit`` words at a time."""

    def __init__(self, weights: dict[bytes, float], limit: int = 100_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        if len(self) >= self.limit:
            self.clear()
        made = self[word] = tuple(f for f in features_of(word) if f in self.weights)
        return made


class Model:
    """Weights of features and ordered thresholds."""

    def __init__(self, weights: dict[bytes, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def exceed(self, text: str | None, known: Known) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        words = letter_words(text)
        times: Counter = Counter()
        for found in filter(None, map(known.__getitem__, words)):
            times.update(found)
        score = sum(self.weights[f] * value(n, len(words)) for f, n in sorted(times.items()))
        return _sigmoid(score - self.thresholds)


def fit(rows: DataFrame, words: list[bytes], penalty: float = PENALTY) -> Model:
    """The model of (grade, at, x) rows; each evaluation is a distributed sum of losses and gradients.

    What reaches the driver is a vector per task. Without rows, words or two grades no text is toxic.
    """
    counts = {r.grade: r["count"] for r in rows.groupBy("grade").count().collect()}
    number, top = sum(counts.values()), max(counts, default=0)
    if len(counts) < 2 or not words:
        return Model({}, np.array([50.0]))
    size = len(words)
    schema = {"loss": pa.float64(), "gradient": pa.list_(pa.float64())}

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, free = x[:size], x[size:]

        @shared.tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, gradient = 0.0, np.zeros(len(weights) + len(free))
            for batch in batches:
                at, xs = (batch.column(n).to_pylist() for n in ("at", "x"))
                more = loss_and_gradient(
                    batch.column("grade").to_numpy(), [np.array(a, np.int64) for a in at], [np.array(v, float) for v in xs], weights, free
                )
                loss, gradient = loss + more[0], gradient + more[1]
            yield shared.arrow_of(schema, {"loss": [loss], "gradient": [gradient.tolist()]})

        loss, gradient = 0.0, np.zeros(len(x))
        for row in rows.mapInArrow(run, "loss double, gradient array<double>").collect():
            loss, gradient = loss + row.loss, gradient + np.array(row.gradient)
        gradient = gradient / number
        gradient[:size] += penalty * weights
        return loss / number + penalty / 2 * float(weights @ weights), gradient

    reached = np.array([sum(n for g, n in counts.items() if g >= k) for k in range(1, top + 1)], float) / number
    theta = np.log((1 - reached) / np.maximum(reached, 1e-9))
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    best = minimise(evaluate, np.concatenate([np.zeros(size), free]))
    return Model(dict(zip(words, best[:size].tolist())), thresholds_of(best[size:]))


def trained(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model of a bounded sample of the labelled documents."""
    shared.prepare(documents.sparkSession)
    sample = labelled(documents, labels, rows=rows)
    words = vocabulary(sample)
    return fit(graded(sample, words), list(words))


OUT = {"severity": pa.float64(), "grade": pa.int32(), "p_toxic": pa.float64(), "toxic": pa.bool_()}


def score(documents: DataFrame, model: Model, text: str = "text", least: float = 0.5, own: str = "") -> DataFrame:
    """Add expected severity, most likely grade, P(grade >= 1), and whether that is ``least`` or more.

    NULL and empty texts are scored as texts without words. Columns stay; ``own`` goes in front of the
    four new names, which must be free.
    """
    names = [f"{own}{name}" for name in OUT]
    shared.prepare(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        known = Known(own.weights)
        for batch in batches:
            exceed = np.array([own.exceed(t, known) for t in shared.texts_of(batch, text)]).reshape(batch.num_rows, -1)
            each = -np.diff(np.concatenate([np.ones((len(exceed), 1)), exceed, np.zeros((len(exceed), 1))], axis=1), axis=1)
            made = shared.arrow_of(OUT, {
                "severity": exceed.sum(axis=1), "grade": each.argmax(axis=1).astype(np.int32),
                "p_toxic": exceed[:, 0], "toxic": exceed[:, 0] >= least,
            })
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.columns], names=[*batch.schema.names, *names])

    kinds = (T.DoubleType(), T.IntegerType(), T.DoubleType(), T.BooleanType())
    fields = [T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)]
    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, *fields]))


def grade_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, grade, p_toxic, toxic: one row per row of ``documents``."""
    rows = documents.select("doc_id", "text")
    return score(rows, trained(rows, labels)).drop("text")
