"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to whole numbers. Per block of rows and component, the index holds one bitmap
per bit of the value above the block's minimum. A query's scores for a whole block are a sum of shifted
bitmaps: a positive weight adds the slices, a negative one their complements and a constant; carry-save
adders turn three bitmaps of one weight into a sum and a carry bitmap until one slice per weight is
left. Rows are then selected from the most significant slice of the sum downward: rows surely among the
top, rows still tied. What is tied after the last slice has equal scores, and as bits stand in the
order of ids, its first rows are the ones to take. So nothing is approximate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm import shared

BLOCK_ROWS, BATCH_QUERIES = 32_768, 128
#: Queries at once times words of a bitmap, so that the adders' arrays stay in cache.
WORDS_AT_ONCE = 2048
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) per component, x as double; values beyond a long stop at its limits."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)))


def usable(vector: Column) -> Column:
    """Not NULL, and without NULL or non-finite components."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Whole-number vectors of up to ``width`` components; shorter ones are filled with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : min(width, len(row))] = row[:width]
    return out


INDEX = "block int, dim int, low bigint, bits int, data binary"


def _slice_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps of a block: a row of ids (dim -1), and a row per component with its slices."""
    rows = rows.sort_values("vec_id", kind="stable")
    block, n = int(rows["block"].iloc[0]), len(rows)
    width = max(map(len, rows["v"]))
    values = _matrix(rows["v"], width)
    padded = -n % 64
    made = [(block, -1, n, 0, rows["vec_id"].to_numpy(np.int64).tobytes())]
    for dim in range(width):
        column = values[:, dim]
        low = int(column.min())
        above = column.astype(np.uint64) - np.uint64(low % (1 << 64))
        bits = int(above.max()).bit_length()
        planes = np.zeros((bits, n + padded), np.uint8)
        for b in range(bits):
            planes[b, :n] = (above >> np.uint64(b)) & np.uint64(1)
        made.append((block, dim, low, bits, np.packbits(planes, axis=1, bitorder="little").tobytes()))
    return pd.DataFrame(made, columns=["block", "dim", "low", "bits", "data"])


class Block:
    """A block of the index in memory."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("dim")
        self.ids = np.frombuffer(rows["data"].iloc[0], np.int64)
        n = len(self.ids)
        self.words = (n + 63) // 64
        dims = rows.iloc[1:]
        self.low = [int(x) for x in dims["low"]]
        self.bits = dims["bits"].to_numpy(np.int64)
        planes = [np.frombuffer(d, np.uint64).reshape(b, self.words) for d, b in zip(dims["data"], self.bits, strict=True)]
        plain = np.concatenate(planes) if planes else np.empty((0, self.words), np.uint64)
        # Slices, their complements, and an empty one last.
        self.slices = np.concatenate([plain, ~plain, np.zeros((1, self.words), np.uint64)])
        self.dim_of = np.repeat(np.arange(len(dims)), self.bits)
        self.bit_of = np.concatenate([np.arange(b) for b in self.bits]) if len(dims) else np.empty(0, np.int64)

    def sums(self, queries: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        """Slices (query, word) of all rows' scores above a constant per query, least significant first."""
        width = min(queries.shape[1], len(self.low))
        weights = np.zeros((len(queries), len(self.low)), object)
        weights[:, :width] = queries[:, :width].astype(object)
        full = np.array([(1 << int(b)) - 1 for b in self.bits], object)
        low = np.array(self.low, object)
        constants = [int(sum(w * low + np.where(w < 0, w, 0) * full)) if len(low) else 0 for w in weights]
        size = np.abs(weights).astype(np.uint64)[:, self.dim_of]
        row = np.arange(len(self.dim_of)) + np.where((weights < 0)[:, self.dim_of], len(self.dim_of), 0)
        blank = len(self.slices) - 1
        terms: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max(initial=0)).bit_length()):
            on = (size >> np.uint64(j)) & np.uint64(1) == 1
            for b in np.unique(self.bit_of):
                here = self.bit_of == b
                if on[:, here].any():
                    terms.setdefault(j + int(b), []).append(np.where(on[:, here], row[:, here], blank))
        carries: dict[int, list[np.ndarray]] = {}
        out, p = [], 0
        while p <= max([-1, *terms, *carries]):
            stack = []
            if p in terms:
                # Blank terms to the end, and no more columns than the fullest query needs.
                index = np.sort(np.concatenate(terms.pop(p), axis=1), axis=1)
                stack = [self.slices[index[:, : int((index < blank).sum(axis=1).max())]]]
            stack += carries.pop(p, [])
            rows = np.concatenate(stack, axis=1) if stack else np.zeros((len(queries), 1, self.words), np.uint64)
            while rows.shape[1] > 1:
                rows, carry = _carry_save(rows)
                carries.setdefault(p + 1, []).append(carry)
            out.append(rows[:, 0])
            p += 1
        return out, constants

    def top(self, queries: np.ndarray, own_ids: list[int], k: int) -> list[list[tuple[int, int]]]:
        """(vec_id, score) of the k best rows but those of the query's own id, ties to smaller ids."""
        slices, constants = self.sums(queries)
        tied = np.stack([self._without(own) for own in own_ids])
        sure = np.zeros_like(tied)
        for plane in reversed(slices):
            more = sure | (tied & plane)
            over = (np.bitwise_count(more).sum(axis=1) > k)[:, None]
            tied, sure = np.where(over, tied & plane, tied & ~plane), np.where(over, sure, more)
        found = []
        for q, constant in enumerate(constants):
            rows = _positions(sure[q])
            rows = np.concatenate([rows, _positions(tied[q])[: k - len(rows)]])
            scores = [constant] * len(rows)
            for p, plane in enumerate(slices):
                bit = (plane[q][rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
                scores = [s + (int(b) << p) for s, b in zip(scores, bit, strict=True)]
            found.append([
                (int(self.ids[r]), max(LONG_MIN, min(LONG_MAX, s))) for r, s in zip(rows, scores, strict=True)
            ])
        return found

    def _without(self, own_id: int) -> np.ndarray:
        bits = np.zeros(64 * self.words, bool)
        bits[: len(self.ids)] = self.ids != own_id
        return np.packbits(bits, bitorder="little").view(np.uint64)


def _carry_save(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A layer of adders: of three bitmaps each (or of the last two) a sum and a carry."""
    n = rows.shape[1]
    if n == 2:
        return rows[:, :1] ^ rows[:, 1:], rows[:, :1] & rows[:, 1:]
    k = n // 3
    a, b, c = rows[:, :k], rows[:, k : 2 * k], rows[:, 2 * k : 3 * k]
    half = a ^ b
    return np.concatenate([half ^ c, rows[:, 3 * k :]], axis=1), (a & b) | (half & c)


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, batch_queries: int = BATCH_QUERIES
) -> DataFrame:
    """query_id, rank, vec_id, score: per query its k best candidates by inner product.

    Both sides are (vec_id, v) with whole-number vectors. Candidates with the query's own id take no part
    for it, nor do NULL ids and vectors on either side. Shorter vectors count as filled with zeros. Ties
    go to the smaller vec_id. Queries that repeat with the same vector come out once; repeated candidate
    rows each take a place. Scores beyond a long stop at its limits. Work is a grid of row blocks by query
    batches, each of fixed size.
    """
    spark = queries.sparkSession
    shared.prepare(spark)
    known = "vec_id is not null and v is not null"
    rows = shared.stored(
        candidates.select(F.col("vec_id").cast("bigint").alias("vec_id"), "v").filter(known)
        .withColumn("at", F.monotonically_increasing_id()), "rows",
    )
    asked = shared.stored(
        queries.select(F.col("vec_id").cast("bigint").alias("query_id"), "v").filter("query_id is not null and v is not null")
        .dropDuplicates(["query_id", "v"]).withColumn("query", F.monotonically_increasing_id()), "queries",
    )
    blocks = max(1, -(-rows.count() // block_rows))
    batches = max(1, -(-asked.count() // batch_queries))
    index = shared.stored(
        rows.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int"))
        .groupBy("block").applyInPandas(_slice_block, INDEX), "index",
    )
    spread_index = index.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    spread_queries = asked.withColumn("batch", F.pmod(F.xxhash64("query"), F.lit(batches)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )

    def search(sliced: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int, int]] = []
        if len(sliced) and len(asking):
            block = Block(sliced)
            width = max(map(len, asking["v"]))
            step = max(1, WORDS_AT_ONCE // block.words)
            for cut in range(0, len(asking), step):
                part = asking.iloc[cut : cut + step]
                best = block.top(_matrix(part["v"], width), part["query_id"].tolist(), k)
                for query, name, rows in zip(part["query"], part["query_id"], best, strict=True):
                    found += [(query, name, vec, score) for vec, score in rows]
        return pd.DataFrame(found, columns=["query", "query_id", "vec_id", "score"]).astype("int64")

    found = (
        spread_index.groupBy("block", "batch").cogroup(spread_queries.groupBy("block", "batch"))
        .applyInPandas(search, "query bigint, query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def neighbours(embeddings: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """Top k of every row whose vec_id is divisible by ``every``, against all rows."""
    rows = embeddings.filter(usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding"), scale).alias("v"))
    return top_k(rows.filter(F.col("vec_id") % every == 0), rows, k)
