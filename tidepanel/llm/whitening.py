"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Components are rounded to whole numbers, so the scatter of the distinct vectors, times their number, is
a matrix of whole numbers: A = n * sum(y y') - S S' = n^2 V, with y = x - shift. Spark sums its parts exactly.

1. A prime per row: A is reduced to Hessenberg form modulo the prime, whose polynomial follows by a
   recurrence. Chinese remaindering puts the coefficients together; Maclaurin's inequality bounds them, as all roots are at
   least zero, and so says how many primes suffice.
2. All roots are real, so the number of roots above a is the number of sign changes of the polynomial's
   coefficients after a shift by a (Descartes' rule is exact here, repeated roots counted). Bisection by this count isolates
   every root, and goes on until the bounds agree to ``ROOT_BITS`` bits. Roots not apart by then count as one repeated root.
3. A root minus A is as good as singular; solving with it a few times from any start (inverse iteration) gives
   its null space, in fixed-point numbers of ``FIXED_BITS`` bits. A repeated root gives as many orthonormal vectors.

Primes and roots are rows that Spark deals to tasks; what they need of the data is one square matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import shared
from tidepanel.llm.bitslice import usable

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16
#: Bits of a root, and of the numbers that its null space is solved in beside the size of the matrix.
ROOT_BITS, FIXED_BITS = 160, 480
LIMB = 40
#: Vectors whose sums of products a task adds up at once; with components below SMALL the sums are exact in doubles.
ROWS, SMALL = 4096, 1 << 20
PRIMES_PER_TASK = 8


def quantised(embeddings: DataFrame, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and the whole-number vector y = x - shift of every usable row: floor(scale * c), at a long's limits at most."""
    y = F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(scale)))
    return embeddings.filter(usable(F.col("embedding"))).select("vec_id", y.alias("y"))


def _rows(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """Vectors as a matrix, shorter ones filled up with zeros."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy()
    size = np.diff(lists.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _limbs(value: int) -> Iterator[int]:
    """Signed digits of a whole number, base 2 ** LIMB, least first."""
    sign, value = (-1, -value) if value < 0 else (1, value)
    while value:
        yield sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB


def _exact_products(y: np.ndarray) -> np.ndarray:
    """Sums over rows of y_i and of y_i y_j, exact: row 0 has the sums, the rest the products."""
    d = y.shape[1]
    total = np.zeros((d + 1, d), object)
    for start in range(0, len(y), ROWS):
        part = y[start : start + ROWS]
        if not part.size:
            continue
        if max(int(part.max()), -int(part.min())) < SMALL:
            real = part.astype(np.float64)
            total[0] += part.sum(axis=0).astype(object)
            total[1:] += (real.T @ real).astype(np.int64).astype(object)
        else:
            wide = part.astype(object)
            total[0] += wide.sum(axis=0)
            total[1:] += wide.T @ wide
    return total


@dataclass
class Scatter:
    """n, the sums S of y, and A = n * sum(y y') - S S'."""

    n: int
    sums: list[int]
    matrix: np.ndarray

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def trace(self) -> int:
        return sum(int(self.matrix[i, i]) for i in range(self.width))


def scatter(fit: DataFrame, width: int) -> Scatter:
    """Exact sums over the vectors of ``fit`` (y): tasks add up batches, Spark adds up the digits of their sums."""

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((width + 1, width), object), 0
        for batch in batches:
            total += _exact_products(_rows(batch, "y", width))
            n += batch.num_rows
        places, limbs, values = [-1], [0], [n]
        for place, value in enumerate(total.ravel().tolist()):
            for limb, digit in enumerate(_limbs(int(value))):
                places.append(place)
                limbs.append(limb)
                values.append(digit)
        yield pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int32()), pa.array(limbs, pa.int32()), pa.array(values, pa.int64())], names=["place", "limb", "digit"]
        )

    digits = fit.select("y").mapInArrow(run, "place int, limb int, digit bigint")
    rows = digits.groupBy("place", "limb").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit")).collect()
    n, total = 0, [0] * ((width + 1) * width)
    for row in rows:
        if row.place < 0:
            n = int(row.digit)
        else:
            total[row.place] += int(row.digit) << (LIMB * row.limb)
    made = np.array(total, object).reshape(width + 1, width)
    return Scatter(n, made[0].tolist(), n * made[1:] - np.outer(made[0], made[0]))


# --- the polynomial -------------------------------------------------------------------------------


def primes_below(start: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``start`` (at most 2 ** 31)."""
    small = [p for p in range(2, 46_341) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    found: list[int] = []
    high = start
    while len(found) < count:
        low = max(2, high - (1 << 16))
        free = np.ones(high - low, bool)
        for p in small:
            if p * p >= high:
                break
            free[max(p * p, -(-low // p) * p) - low :: p] = False
        found += (low + np.flatnonzero(free)[::-1]).tolist()
        high = low
    return found[:count]


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - A) modulo a prime below 2 ** 31, lowest first, by Hessenberg reduction."""
    h = matrix.astype(np.int64) % p
    d = len(h)
    for j in range(d - 2):
        below = np.flatnonzero(h[j + 1 :, j])
        if not len(below):
            continue
        k = j + 1 + int(below[0])
        if k != j + 1:
            h[[j + 1, k]] = h[[k, j + 1]]
            h[:, [j + 1, k]] = h[:, [k, j + 1]]
        u = h[j + 2 :, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2 :] = (h[j + 2 :] - u[:, None] * h[j + 1] % p) % p
        # Column j + 1 gets all the eliminated columns, each product reduced before the sum.
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2 :] * u % p).sum(axis=1)) % p
    made = np.zeros((d + 1, d + 1), np.int64)
    made[0, 0] = 1
    for m in range(1, d + 1):
        made[m, 1:] = made[m - 1, :-1]
        made[m] = (made[m] - h[m - 1, m - 1] * made[m - 1] % p) % p
        product = 1
        for i in range(m - 1, 0, -1):
            product = product * int(h[i, i - 1]) % p
            if not product:
                break
            made[m] = (made[m] - int(h[i - 1, m - 1]) * product % p * made[i - 1] % p) % p
    return made[d]


def coefficient_bits(trace: int, width: int) -> int:
    """Bits that no coefficient exceeds: the k-th symmetric sum of roots >= 0 is at most C(d, k) (trace / d) ** k."""
    most = Fraction(max(trace, 1), max(width, 1))
    return max(
        (math.comb(width, k) * (most ** k).__ceil__()).bit_length() for k in range(width + 1)
    )


def _residues(matrix: np.ndarray, p: int) -> np.ndarray:
    return np.array([[int(x) % p for x in row] for row in matrix], np.int64)


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray, trace: int) -> list[int]:
    """Coefficients of det(x - A), lowest first, for a symmetric whole-number matrix without negative roots.

    Tasks reduce the matrix modulo their primes; the residues (a row per prime) come back for the remaindering.
    """
    width = len(matrix)
    needed = coefficient_bits(trace, width) + 2
    primes = primes_below(1 << 31, -(-needed // 30) + 1)
    held = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [polynomial_mod(_residues(held.value, p), p).tolist() for p in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(made, pa.list_(pa.int64()))], names=["p", "c"])

    tasks = max(1, -(-len(primes) // PRIMES_PER_TASK))
    asked = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(tasks)
    rows = asked.mapInArrow(run, "p bigint, c array<bigint>").collect()
    product = math.prod(r.p for r in rows)
    out = [0] * (width + 1)
    for row in rows:
        rest = product // row.p
        unit = rest * pow(rest, -1, row.p)
        for k, c in enumerate(row.c):
            out[k] += unit * c
    return [x - product if (x := v % product) > product // 2 else x for v in out]


# --- roots ----------------------------------------------------------------------------------------


def scaled_at(coefficients: list[int], bits: int) -> list[int]:
    """The polynomial in x / 2 ** bits with whole coefficients."""
    d = len(coefficients) - 1
    return [c << (bits * (d - k)) for k, c in enumerate(coefficients)]


def roots_above(coefficients: list[int], at: int) -> int:
    """How many roots of a real-rooted polynomial are above a whole number, repeated ones counted.

    The sign changes of the coefficients of p(x + at): exact where all roots are real.
    """
    shifted = coefficients[::-1]
    for end in range(len(shifted) - 1, 0, -1):
        carry = shifted[0]
        for i in range(1, end + 1):
            carry = shifted[i] = shifted[i] + carry * at
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def isolate(coefficients: list[int], number: int, high: int, bits: int = ROOT_BITS) -> tuple[Fraction, int, int]:
    """The ``number``-th largest root as (its middle, which number is the first in its bounds, how many are in them).

    Bounds are halved until they agree to ``bits`` bits. ``high`` is a whole number that is above all roots.
    """
    low, depth, over = -1, 0, 0
    under = roots_above(coefficients, low)
    scaled = coefficients
    while (high - low) << bits > max(high, 1):
        if high - low == 1:  # finer steps
            more = 32
            depth += more
            low, high = low << more, high << more
            scaled = scaled_at(coefficients, depth)
        middle = (low + high) // 2
        above = roots_above(scaled, middle)
        if above >= number:
            low, under = middle, above
        else:
            high, over = middle, above
    return Fraction(low + high, 2 << depth), over + 1, under - over


# --- null spaces ----------------------------------------------------------------------------------


def _fixed_lu(matrix: list[list[int]], bits: int) -> tuple[np.ndarray, list[int]]:
    """LU factors with row exchanges, entries times 2 ** bits; a pivot of zero counts as the smallest number."""
    a = np.array(matrix, object)
    d = len(a)
    order = list(range(d))
    for k in range(d):
        best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
            order[k], order[best] = order[best], order[k]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            a[k + 1 :, k] = (a[k + 1 :, k] << bits) // a[k, k]
            a[k + 1 :, k + 1 :] -= (np.outer(a[k + 1 :, k], a[k, k + 1 :])) >> bits
    return a, order


def _fixed_solve(lu: np.ndarray, order: list[int], right: np.ndarray, bits: int) -> np.ndarray:
    x = right[order].copy()
    d = len(x)
    for k in range(1, d):
        x[k] -= int(np.dot(lu[k, :k], x[:k])) >> bits
    for k in range(d - 1, -1, -1):
        rest = (int(np.dot(lu[k, k + 1 :], x[k + 1 :])) >> bits) if k + 1 < d else 0
        x[k] = ((x[k] - rest) << bits) // lu[k, k]
    return x


def _unit(x: np.ndarray, bits: int) -> np.ndarray:
    length = math.isqrt(int(np.dot(x, x)))
    return (x << bits) // max(length, 1)


def null_vectors(matrix: np.ndarray, root: Fraction, count: int, bits: int = FIXED_BITS) -> list[list[float]]:
    """``count`` orthonormal vectors of the null space of A - root, by inverse iteration in fixed-point numbers."""
    d = len(matrix)
    size = max(1, max(abs(int(x)) for x in matrix.ravel())).bit_length()
    bits += size
    # The matrix over 2 ** size, so that its entries are below one.
    shifted = [[(int(x) << bits) >> size for x in row] for row in matrix]
    middle = int(root * (1 << bits)) >> size
    for i in range(d):
        shifted[i][i] -= middle
    lu, order = _fixed_lu(shifted, bits)
    found: list[np.ndarray] = []
    draw = np.random.default_rng(1)
    for _ in range(count):
        x = _unit(np.array([int(v) for v in draw.integers(1, 1 << 30, d)], object), bits)
        for _ in range(4):
            x = _unit(_fixed_solve(lu, order, x, bits), bits)
            for _ in range(2):
                for other in found:
                    x = x - ((other * (int(np.dot(other, x)) >> bits)) >> bits)
            x = _unit(x, bits)
        found.append(x)
    return [[float(Fraction(int(v), 1 << bits)) for v in x] for x in found]


@dataclass
class Components:
    """Roots of V and their unit vectors, largest first, with their share of the trace."""

    roots: list[float]
    vectors: np.ndarray
    explained: list[float]


def principal(spark: SparkSession, made: Scatter, count: int = COMPONENTS) -> Components:
    """The ``count`` largest roots above zero, each isolated in a task of its own, and their vectors."""
    none = Components([], np.zeros((made.width, 0)), [])
    if not made.n or not made.trace:
        return none
    poly = characteristic_polynomial(spark, made.matrix, made.trace)
    zeros = next(k for k, c in enumerate(poly) if c)  # roots at zero are known exactly
    count = min(count, made.width - zeros)
    reduced = poly[zeros:]
    held = spark.sparkContext.broadcast((reduced, made.matrix, made.trace + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficients, matrix, high = held.value
        for batch in batches:
            for number in batch.column("number").to_pylist():
                root, first, many = isolate(coefficients, number, high)
                # A repeated root's vectors depend on each other, so each task makes them all and returns its own.
                vector = null_vectors(matrix, root, number - first + 1)[-1]
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([str(root.numerator)]), pa.array([str(root.denominator)]),
                    pa.array([vector], pa.list_(pa.float64())),
                ], names=["number", "numerator", "denominator", "vector"])

    asked = spark.createDataFrame([(k,) for k in range(1, count + 1)], "number bigint").repartition(count, "number")
    rows = asked.mapInArrow(run, "number bigint, numerator string, denominator string, vector array<double>").collect()
    rows.sort(key=lambda r: r.number)
    exact = [Fraction(int(r.numerator), int(r.denominator)) for r in rows]
    return Components(
        [float(e / made.n ** 2) for e in exact], np.array([r.vector for r in rows]).T, [float(e / made.trace) for e in exact]
    )


# --- whitening ------------------------------------------------------------------------------------


def _centred(y: np.ndarray, made: Scatter) -> np.ndarray:
    """y - S / n in doubles, each rounded once where the numbers are small."""
    whole = [s // made.n for s in made.sums]
    part = np.array([float(Fraction(s - w * made.n, made.n)) for s, w in zip(made.sums, whole, strict=True)])
    if y.size and max(int(y.max()), -int(y.min()), *map(abs, whole)) < 1 << 52:
        return (y - np.array(whole, np.int64)) - part
    return (y.astype(object) - np.array(whole, object)).astype(np.float64) - part


def _deviations(y: np.ndarray, made: Scatter) -> list[int | None]:
    """Sums of (n y - S) ** 2, exact; NULL where a long is too short."""
    most = made.n * max(int(y.max(initial=0)), -int(y.min(initial=0)), 1) + max(map(abs, made.sums), default=0)
    if most * most * max(1, made.width) < 1 << 63:
        apart = made.n * y - np.array(made.sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = made.n * y.astype(object) - np.array(made.sums, object)
    return [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(axis=1)]


def _projected(y: np.ndarray, made: Scatter, found: Components) -> np.ndarray:
    return _centred(y, made) @ (found.vectors / np.sqrt(found.roots))


def _moments(fit: DataFrame, made: Scatter, found: Components, means: np.ndarray) -> np.ndarray:
    """Sums over the fit list of the whitened values less ``means``, and of their products."""
    k = len(found.roots)

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            y = _rows(batch, "y", made.width)
            for start in range(0, len(y), ROWS):
                white = _projected(y[start : start + ROWS], made, found) - means
                total[0] += white.sum(axis=0)
                total[1:] += white.T @ white
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "v"])

    rows = fit.select("y").mapInArrow(run, "place bigint, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((k + 1) * k)
    for row in rows:
        out[row.place] = row.v
    return out.reshape(k + 1, k)


def identity_error(fit: DataFrame, made: Scatter, found: Components) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity; means come first."""
    k = len(found.roots)
    means = _moments(fit, made, found, np.zeros(k))[0] / made.n
    sums = _moments(fit, made, found, means)
    covariance = sums[1:] / made.n - np.outer(sums[0], sums[0]) / made.n ** 2
    return float(np.abs(covariance - np.eye(k)).max())


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, count: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of (vec_id, embedding).

    Rows whose vector is NULL or holds NULL or non-finite entries are dropped; a NULL or repeated vec_id is not. Each entry
    becomes x = floor(scale * c) + shift; equal vectors count once in what is fitted (n of them), and every row comes
    out. Shorter vectors count as filled up with c = 0, so an empty vector is all zeros. Components are the roots above zero of the
    covariance, ``count`` at most: without any (an empty table, one distinct vector) there are no rows. Repeated roots have any
    orthonormal vectors of their space, the same for all rows. ``deviation`` is NULL beyond a long's limits. The shift cancels out and is
    never added. Other columns are passed over, whatever their names.
    """
    spark = embeddings.sparkSession
    shared.prepare(spark)
    rows = shared.stored(quantised(embeddings.select("vec_id", "embedding"), scale, shift), "vectors")
    width = rows.agg(F.max(F.size("y"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], OUT)
    padded = F.when(F.size("y") < width, F.concat("y", F.array_repeat(F.lit(0).cast("bigint"), width - F.size("y")))).otherwise(F.col("y"))
    fit = shared.stored(rows.select(padded.alias("y")).distinct(), "fit")
    made = scatter(fit, width)
    found = principal(spark, made, count)
    k = len(found.roots)
    if not k:
        return spark.createDataFrame([], OUT)
    error = identity_error(fit, made, found)

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _rows(batch, "y", width)
            for start in range(0, len(y), ROWS):
                part = y[start : start + ROWS]
                m = len(part)
                deviations = pa.array(_deviations(part, made), pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").slice(start, m).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, made.n)), deviations.take(each), pa.array(_projected(part, made, found).ravel()),
                    pa.array(np.tile(found.explained, m)), pa.array(np.full(m * k, error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "y").mapInArrow(run, OUT)
