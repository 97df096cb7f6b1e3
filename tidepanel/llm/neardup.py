"""Near duplicates by min-hash signatures and a multi-index Hamming join.

A document is its set of distinct five-word shingles. Its signature has ``POSITIONS`` b-bit symbols,
the low bits of as many minima of hashed shingles; for two documents the share of differing positions
is close to one minus their Jaccard similarity.

The signature is cut into ``CHUNKS`` chunks. By the pigeonhole principle two signatures that differ in
at most ``CHUNKS * (ERRORS + 1) - 1`` positions have a chunk with at most ``ERRORS`` differing ones. So
every chunk is indexed under all ways to leave out ``ERRORS`` of its positions: all pairs within the
threshold meet in a bucket. With 72 positions, 18 chunks and one error the threshold is 35 positions;
at similarity 0.75, 18 differ on average with a deviation of 3.7, so a pair that should be linked
lies beyond it once in some hundred thousand times, and far more rarely at higher similarity.

Work per bucket stays small without leaving pairs out:

1. Documents with equal sets are one class; from here on classes are compared.
2. Every class meets the smallest class of one of its buckets, a leader. Pairs within the threshold are confirmed on the full
   sets, and links found are joined into components. Of the pairs with other leaders, those that lead from one
   component to another are asked in rounds: one pair for every two components, then some 64 and so on, until the two are
   joined or all are asked. So a group of near copies costs little more than one pair a class, and no bucket is left out.
3. In buckets with several components, every class outside the largest one meets the closest class of
   another component in its block of the bucket. Groups of near copies collapse here at the latest.
4. In buckets that still hold several components, every class outside the largest one meets all classes
   of other components, in blocks of bounded size; a longer signature screens the pairs, and those left
   are confirmed on the full sets.

Pairs inside one component need no comparison, as only reachability is asked for.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm import shared
from tidepanel.llm.components import components
from tidepanel.session import checked_broadcast

WORDS = 5
SIMILARITY = 75  # per cent
POSITIONS, CHUNKS, ERRORS = 72, 18, 1
THRESHOLD = CHUNKS * (ERRORS + 1) - 1
BLOCK = 1024
#: A longer signature of two-bit symbols, four in a byte, screens the pairs of the last step: at the similarity 384 of its
#: positions differ on average, with a deviation of 17.7.
LONG_POSITIONS, LONG_THRESHOLD = 2048, 478
SLICE = 1 << 18

_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(32))) * _MIX1
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


def _family(positions: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and offsets of the hash functions."""
    seeds = mix(np.arange(1, 2 * positions + 1, dtype=np.uint64) * _MIX2)
    return seeds[:positions] | np.uint64(1), seeds[positions:]


def shingle_set(words: list[bytes], hashes: shared.WordHash, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words make one shingle of all."""
    if not words:
        return np.empty(0, np.uint64)
    word = hashes.of(words)
    width = min(size, len(words))
    made = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        made = mix(made * _MIX1 + word[i : len(words) - width + 1 + i])
    return np.unique(made)


def signatures_of(sets: list[np.ndarray], positions: int = POSITIONS) -> np.ndarray:
    """One row of 16-bit symbols per non-empty set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(sets), positions), np.uint16)
    odd, offset = _family(positions)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    every = np.concatenate([sets[i] for i in full])
    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    least = np.empty((len(full), positions), np.uint64)
    for p in range(positions):
        # Minima per document, the text sliced so that intermediate arrays stay small.
        scrambled = (every ^ offset[p]) * odd[p]
        scrambled ^= scrambled >> np.uint64(31)
        scrambled *= _MIX2
        least[:, p] = np.minimum.reduceat(scrambled, starts)
    out[full] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


SIGNED = {
    "doc_id": pa.int64(), "text_hash": pa.int64(), "n_shingles": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "sig": pa.binary(),
}


def _set_hash(found: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit hashes of a set, as signed integers."""
    one = np.add.reduce(mix(found + _MIX1), dtype=np.uint64) if len(found) else np.uint64(0)
    two = np.bitwise_xor.reduce(mix(found ^ _MIX2)) if len(found) else np.uint64(0)
    return int(np.uint64(one).astype(np.int64)), int(np.uint64(two).astype(np.int64))


def _groups(
    batch: pa.RecordBatch, text: str, size: int, hashes: shared.WordHash
) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Shingle sets of consecutive rows, some hundred thousand shingles at a time."""
    first, sets, held = 0, [], 0
    for value in shared.texts_of(batch, text):
        sets.append(shingle_set(shared.lowered_words(value), hashes, size))
        held += len(sets[-1])
        if held > SLICE:
            yield first, sets
            first, sets, held = first + len(sets), [], 0
    if sets:
        yield first, sets


def signatures(documents: DataFrame, size: int = WORDS, positions: int = POSITIONS) -> DataFrame:
    """doc_id, hash of the text, set size, a 128-bit hash of the set and the signature of every whole text."""
    shared.prepare(documents.sparkSession)

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared.WordHash()
        for batch in batches:
            for first, sets in _groups(batch, "text", size, hashes):
                signed = signatures_of(sets, positions)
                keys = [_set_hash(s) for s in sets]
                yield shared.arrow_of(SIGNED, {
                    "doc_id": batch.column("doc_id").slice(first, len(sets)),
                    "text_hash": batch.column("text_hash").slice(first, len(sets)),
                    "n_shingles": [len(s) for s in sets], "h1": [k[0] for k in keys], "h2": [k[1] for k in keys],
                    "sig": [row.tobytes() for row in signed],
                })

    return documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    ).mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, h1 bigint, h2 bigint, sig binary")


def shingle_sets(documents: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, set hash and the full set of hashed shingles."""
    shared.prepare(documents.sparkSession)
    schema = {"doc_id": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "shingles": pa.list_(pa.int64())}

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared.WordHash()
        for batch in batches:
            for first, sets in _groups(batch, "text", size, hashes):
                keys = [_set_hash(s) for s in sets]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                values = np.concatenate(sets).view(np.int64)
                yield shared.arrow_of(schema, {
                    "doc_id": batch.column("doc_id").slice(first, len(sets)),
                    "h1": [k[0] for k in keys], "h2": [k[1] for k in keys],
                    "shingles": pa.ListArray.from_arrays(offsets, values),
                })

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, h1 bigint, h2 bigint, shingles array<bigint>"
    )


def left_out(positions: int = POSITIONS, chunks: int = CHUNKS, errors: int = ERRORS) -> list[list[int]]:
    """Positions that each bucket key holds: every chunk without each choice of ``errors`` positions."""
    bounds = [positions * i // chunks for i in range(chunks + 1)]
    return [
        [p for p in range(a, b) if p not in gone]
        for a, b in itertools.pairwise(bounds)
        for gone in map(set, itertools.combinations(range(a, b), errors))
    ]


def _key(signed: np.ndarray, number: int, kept: list[int]) -> np.ndarray:
    """Bucket keys of signatures under one choice of positions."""
    key = np.full(len(signed), number + 1, np.uint64)
    for p in kept:
        key = mix(key * _MIX1 + signed[:, p])
    return key


def first_keys(one: np.ndarray, two: np.ndarray, holds: list[list[int]]) -> np.ndarray:
    """The first bucket key that each pair of signatures shares; 0 where there is none."""
    same = one == two
    out = np.zeros(len(one), np.uint64)
    left = np.arange(len(one))
    for k, kept in enumerate(holds):
        hit = left[same[left][:, kept].all(axis=1)]
        out[hit] = _key(one[hit].astype(np.uint64), k, kept)
        left = left[~same[left][:, kept].all(axis=1)]
        if not len(left):
            break
    return out.view(np.int64)


def bucket_keys(
    classes: DataFrame, positions: int = POSITIONS, chunks: int = CHUNKS, errors: int = ERRORS
) -> DataFrame:
    """(key, class): the class under every bucket key of its signature."""
    holds = left_out(positions, chunks, errors)

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = symbols(batch.column("sig"), positions).astype(np.uint64)
            keys = np.empty((len(signed), len(holds)), np.uint64)
            for k, kept in enumerate(holds):
                keys[:, k] = _key(signed, k, kept)
            ids = np.repeat(batch.column("class").to_numpy(), len(holds))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "class"])

    return classes.select("class", "sig").mapInArrow(run, "key bigint, class bigint")


def symbols(column: pa.Array, positions: int) -> np.ndarray:
    """Signatures of a batch as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, positions)


def within(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    return (a != b).sum(axis=1) <= threshold


def packed(signed: np.ndarray) -> np.ndarray:
    """The two low bits of every symbol, four symbols in a byte."""
    two = (signed & 3).astype(np.uint8).reshape(len(signed), -1, 4)
    return two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6


def packed_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing symbols of packed signatures, row by row."""
    x = a ^ b
    return np.bitwise_count((x | x >> 1) & 0x55).sum(axis=1, dtype=np.int64)


def sizes_allow(a: np.ndarray, b: np.ndarray, similarity: int) -> np.ndarray:
    """Whether two set sizes can reach the similarity at all."""
    return 100 * np.minimum(a, b) >= similarity * np.maximum(a, b)


def _near_signatures(pairs: DataFrame, classes: DataFrame, threshold: int, similarity: int, positions: int) -> DataFrame:
    """Pairs (a, b) whose signatures are within the threshold."""
    one = classes.select(F.col("class").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
    two = classes.select(F.col("class").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))
    allowed = 100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb")

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = within(symbols(batch.column("sa"), positions), symbols(batch.column("sb"), positions), threshold)
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.join(one, "a").join(two, "b").filter(allowed).select("a", "b", "sa", "sb").mapInArrow(
        run, "a bigint, b bigint"
    )


def _sets_of(wanted: DataFrame, classes: DataFrame, documents: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(class, shingles): full sets of the wanted classes, built anew from the documents that stand for them.

    The list of these documents is broadcast only while its counted rows allow it. Beside the sets comes the stored
    table that they read.
    """
    named = shared.stored(wanted.join(classes.select("class", "doc_id", "h1", "h2"), "class"), "named")
    ids = checked_broadcast(named.select("doc_id").distinct(), 32)
    sets = shingle_sets(documents.select("doc_id", "text").join(ids, "doc_id", "left_semi"), size)
    return named.join(sets, ["doc_id", "h1", "h2"]).select("class", "shingles").dropDuplicates(["class"]), named


def _confirmed(near: DataFrame, classes: DataFrame, documents: DataFrame, similarity: int, size: int) -> DataFrame:
    """Pairs of classes whose full sets reach the similarity."""
    near = shared.stored(near, "near")
    if near.isEmpty():
        shared.discard(near)
        return near.sparkSession.createDataFrame([], near.schema)
    named = near.select(F.col("a").alias("class")).union(near.select("b")).distinct()
    sets, listed = _sets_of(named, classes, documents, size)
    sets = shared.stored(sets, "sets")
    common = F.size(F.array_intersect("sa", "sb"))
    links = shared.stored(
        near.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb")), "b")
        .filter(100 * common >= similarity * (F.size("sa") + F.size("sb") - common))
        .select("a", "b"), "links",
    )
    shared.discard(near, listed, sets)
    return links


Rows = dict[str, np.ndarray]


def _by_group(rows: DataFrame, group: list[str], columns: list[str], binary: dict[str, type], compare) -> DataFrame:
    """Pairs (a, b) that ``compare`` finds in the groups of ``rows``; a group must be of bounded size.

    Rows come sorted by group, and the last group of a batch is carried into the next. ``compare`` gets
    arrays of whole groups, with the number of the group as ``group``; ``binary`` names columns that hold
    symbols, with their type.
    """

    def arrays(table: pa.Table) -> Rows:
        made = {n: table.column(n).to_numpy() for n in [*group, *columns] if n not in binary}
        for name, kind in binary.items():
            made[name] = np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(table.num_rows, -1)
        ends = np.zeros(max(0, table.num_rows - 1), bool)
        for name in group:
            ends |= made[name][1:] != made[name][:-1]
        return made | {"group": np.concatenate(([0], np.cumsum(ends)))}

    def pairs(made: Rows) -> pa.RecordBatch:
        a, b = compare(made)
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if carried is not None:
                table = pa.concat_tables([carried, table])
            if not table.num_rows:
                continue
            made = arrays(table)
            last = int(np.searchsorted(made["group"], made["group"][-1]))
            carried = table.slice(last).combine_chunks()
            if last:
                yield pairs({n: v[:last] for n, v in made.items()})
        if carried is not None and carried.num_rows:
            yield pairs(arrays(carried))

    dealt = rows.select(*group, *columns).repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _shifted(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, i + d) within groups, for d from 1 on: every pair of a group once."""
    at, shift = np.arange(len(group)), 0
    while len(at):
        shift += 1
        at = at[at + shift < len(group)]
        at = at[group[at] == group[at + shift]]
        yield at, at + shift


def _parts(i: np.ndarray, j: np.ndarray, size: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for cut in range(0, len(i), size):
        yield i[cut : cut + size], j[cut : cut + size]


def _in_largest(group: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Whether each row is of the component that has most rows in its group."""
    order = np.lexsort((component, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (component[order][1:] != component[order][:-1])
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    owner = group[order][new]
    by_size = np.lexsort((-size, owner))
    first = np.ones(len(by_size), bool)
    first[1:] = owner[by_size][1:] != owner[by_size][:-1]
    largest = np.zeros(len(size), bool)
    largest[by_size[first]] = True
    out = np.empty(len(order), bool)
    out[order] = largest[run]
    return out


def _nearest(rows: DataFrame, threshold: int, similarity: int) -> DataFrame:
    """For every class outside the largest component of its (key, block) group the closest class of another
    component within the threshold."""

    def compare(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        best = np.full(len(rows["class"]), threshold + 1)
        to = np.full(len(best), -1)
        for i, j in _shifted(rows["group"]):
            keep = (rows["component"][i] != rows["component"][j]) & sizes_allow(
                rows["n_shingles"][i], rows["n_shingles"][j], similarity
            )
            for one, two in _parts(i[keep], j[keep]):
                apart = (rows["sig"][one] != rows["sig"][two]).sum(axis=1)
                for x, y in ((one, two), (two, one)):
                    closer = apart < best[x]
                    best[x[closer]], to[x[closer]] = apart[closer], y[closer]
        found = np.flatnonzero((to >= 0) & ~_in_largest(rows["group"], rows["component"]))
        return rows["class"][found], rows["class"][to[found]]

    return _by_group(
        rows, ["key", "block"], ["class", "component", "n_shingles", "sig"], {"sig": np.uint16}, compare
    )


def _across(rows: DataFrame, threshold: int, similarity: int, holds: list[list[int]]) -> DataFrame:
    """Pairs of an outlying class with one of another component in a (key, block, chunk) group.

    Both signatures have to be within their thresholds. A pair that meets under several keys is taken
    under the first of them only.
    """
    def compare(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        found_a, found_b = [rows["class"][:0]], [rows["class"][:0]]
        for i, j in _shifted(rows["group"]):
            swap = rows["outlying"][i] < rows["outlying"][j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)  # the outlying role first
            keep = (rows["role"][i] != rows["role"][j]) & (rows["component"][i] != rows["component"][j])
            keep &= sizes_allow(rows["n_shingles"][i], rows["n_shingles"][j], similarity)
            both = rows["outlying"][i] & rows["outlying"][j]
            first = np.where(rows["role"][i] == 0, rows["class"][i], rows["class"][j])
            second = np.where(rows["role"][i] == 0, rows["class"][j], rows["class"][i])
            keep &= ~both.astype(bool) | (first < second)
            for one, two in _parts(i[keep], j[keep]):
                near = (rows["sig"][one] != rows["sig"][two]).sum(axis=1) <= threshold
                one, two = one[near], two[near]
                near = packed_apart(rows["long"][one], rows["long"][two]) <= LONG_THRESHOLD
                one, two = one[near], two[near]
                near = first_keys(rows["sig"][one], rows["sig"][two], holds) == rows["key"][one]
                one, two = one[near], two[near]
                found_a.append(rows["class"][one])
                found_b.append(rows["class"][two])
        return np.concatenate(found_a), np.concatenate(found_b)

    return _by_group(
        rows, ["key", "block", "chunk"], ["role", "outlying", "class", "component", "n_shingles", "sig", "long"],
        {"sig": np.uint16, "long": np.uint8}, compare,
    )


def _placed(members: DataFrame, links: DataFrame) -> DataFrame:
    """Bucket members with the component that the links give them."""
    joined = shared.stored(components(links, "a", "b").withColumnRenamed("node", "class"), "joined")
    return members.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))


def _long_signatures(classes: DataFrame, wanted: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """(class, long): packed signatures of ``LONG_POSITIONS`` symbols for the wanted classes, stored."""
    sets, listed = _sets_of(wanted, classes, documents, size)

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [np.array(s.as_py(), np.int64).view(np.uint64) for s in part.column("shingles")]
                signed = packed(signatures_of(sets, LONG_POSITIONS))
                yield pa.RecordBatch.from_arrays(
                    [part.column("class"), pa.array([row.tobytes() for row in signed], pa.binary())], names=["class", "long"]
                )

    long = shared.stored(sets.mapInArrow(run, "class bigint, long binary"), "long")
    shared.discard(listed)
    return long


def _leader_links(
    members: DataFrame, classes: DataFrame, documents: DataFrame, threshold: int, similarity: int, size: int, positions: int
) -> DataFrame:
    """Confirmed links (a, b) of classes with the leaders of their buckets, asked in rounds.

    First every class is asked about its smallest leader. From then on a round asks, for every two components that
    pairs lead across, one pair, then some 64 and so on, until they are joined or no pair is left. So every
    (class, leader) is asked about, but for those that earlier rounds have put into one component.
    """
    pairs = shared.stored(
        members.filter("class <> leader").select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct(), "leaders"
    )
    # A class has a leader per bucket at most, so its rows are few.
    ranked = shared.stored(
        pairs.withColumn("asked", F.row_number().over(Window.partitionBy("b").orderBy("a")) == 1), "first-leaders"
    )
    shared.discard(pairs)
    links, width = None, 1
    while True:
        found = _confirmed(
            _near_signatures(ranked.filter("asked").select("a", "b"), classes, threshold, similarity, positions),
            classes, documents, similarity, size,
        )
        links = found if links is None else links.union(found)
        rest = ranked.filter("not asked").select("a", "b")
        if rest.isEmpty():
            return links
        reached = shared.stored(components(links, "a", "b"), "reached")
        for side in ("a", "b"):
            named = reached.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
            rest = rest.join(named, side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
        across = shared.stored(
            rest.filter("_a <> _b").select("a", "b", F.least("_a", "_b").alias("x"), F.greatest("_a", "_b").alias("y")), "across"
        )
        if across.isEmpty():
            return links
        between = shared.stored(
            across.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("b", "a")).alias("first")), "between"
        )
        share = F.pmod(F.xxhash64("a", "b"), F.ceil(F.col("n") / F.lit(width))) == 0
        before, ranked = ranked, shared.stored(
            across.join(between, ["x", "y"]).select("a", "b", (share | (F.struct("b", "a") == F.col("first"))).alias("asked")), "asked"
        )
        shared.discard(before, reached, across, between)
        width *= 64


def near_links(
    classes: DataFrame, documents: DataFrame, similarity: int = SIMILARITY, size: int = WORDS,
    positions: int = POSITIONS, chunks: int = CHUNKS, errors: int = ERRORS, block: int = BLOCK,
) -> DataFrame:
    """Confirmed links (a, b) between classes that suffice to join every component."""
    threshold = chunks * (errors + 1) - 1
    signed = classes.select("class", "n_shingles", "sig")
    keys = bucket_keys(classes, positions, chunks, errors)
    buckets = keys.groupBy("key").agg(F.min("class").alias("leader"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    members = shared.stored(keys.join(buckets, "key"), "members")

    links = _leader_links(members, classes, documents, threshold, similarity, size, positions)

    # Whoever is outside the largest component of its block of the bucket, with the closest class of another.
    many = members.filter("_n > 2").select("key", "class", "_n")
    placed = _placed(many, links)
    mixed = placed.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).filter("l < h").select("key")
    blocks = F.pmod(F.xxhash64("class"), F.ceil(F.col("_n") / block)).cast("int")
    close = _nearest(
        placed.join(mixed, "key").withColumn("block", blocks).join(signed, "class"), threshold, similarity
    )
    links = links.union(_confirmed(close, classes, documents, similarity, size))

    # Whoever is still outside its bucket's largest component, with everyone of another component.
    placed = shared.stored(_placed(many, links), "placed")
    shares = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = (
        shares.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("_all"))
        .withColumn("_out", F.col("_all") - F.col("most.n")).filter("_out > 0")
        .select("key", F.col("most.component").alias("_largest"), F.ceil(F.col("_all") / block).cast("int").alias("_blocks"),
                F.ceil(F.col("_out") / block).cast("int").alias("_chunks"))
    )
    rest = shared.stored(
        placed.select("key", "class", "component").join(largest, "key")
        .withColumn("outlying", (F.col("component") != F.col("_largest")).cast("int")), "rest",
    )
    long = _long_signatures(classes, rest.select("class").distinct(), documents, size)
    hashed = F.xxhash64("class")
    asking = rest.filter("outlying = 1").withColumns(
        {"role": F.lit(0), "chunk": F.pmod(hashed, F.col("_chunks")).cast("int"),
         "block": F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))}
    )
    asked = rest.withColumns(
        {"role": F.lit(1), "block": F.pmod(hashed, F.col("_blocks")).cast("int"),
         "chunk": F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))}
    )
    both = asking.unionByName(asked).join(signed, "class").join(long, "class")
    last = _confirmed(
        _across(both, threshold, similarity, left_out(positions, chunks, errors)), classes, documents, similarity, size
    )
    shared.discard(members, placed, rest, long)
    return links.union(last)


def resolved(
    documents: DataFrame, similarity: int = SIMILARITY, size: int = WORDS, positions: int = POSITIONS,
    chunks: int = CHUNKS, errors: int = ERRORS, block: int = BLOCK,
) -> DataFrame:
    """As ``near_duplicates``, with the hash of the text beside the id."""
    signed = shared.stored(
        signatures(documents, size, positions).withColumn("row", F.monotonically_increasing_id()), "signatures"
    )
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "h1", "h2"]
    classes = shared.stored(
        full.groupBy(*same).agg(F.min(F.struct("doc_id", "row", "sig")).alias("_first"))
        .select(*same, F.col("_first.doc_id").alias("doc_id"), F.col("_first.row").alias("class"), F.col("_first.sig").alias("sig")),
        "classes",
    )
    links = near_links(classes, documents, similarity, size, positions, chunks, errors, block)
    reached = components(links, "a", "b").withColumnRenamed("node", "class")
    linked = classes.select(*same, "class", "doc_id").join(reached, "class")
    names = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = shared.stored(linked.join(names, "component").select(*same, "component_id"), "named-classes")
    single = classes.select(*same, F.col("doc_id").alias("_own"))
    # Stored, so that the last join deals out both sides itself and can split a class of many copies.
    placed = shared.stored(
        single.join(named, same, "left").select(*same, F.coalesce("component_id", "_own").alias("component_id")), "placed-classes"
    )
    return (
        signed.select("doc_id", "text_hash", *same).join(placed, same, "left")
        .select(
            "doc_id", "text_hash", "n_shingles",
            F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
            .otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def near_duplicates(documents: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``documents`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable by links of ``similarity`` per cent or more of the
    shingle sets' union, the document's own included. Documents without words (NULL, empty, white space)
    have an empty set and stand alone. Rows that repeat an id count as documents of their own and share
    it as their name. A NULL doc_id links with nothing: its component is NULL, and it is kept. Other
    columns are passed over. Options are those of ``resolved``.
    """
    return resolved(documents, **options).drop("text_hash")


def deduplicated(documents: DataFrame, **options: int) -> DataFrame:
    """The documents without those that a near duplicate with a smaller id stands for; columns stay.

    Of rows that share the id which names a component one stays, that with the smallest hash of its text.
    Documents without words and those without an id all stay.
    """
    own = shared.free_prefix(documents.columns)
    found = shared.stored(resolved(documents, **options), "resolved")
    numbered = found.filter("n_shingles > 0 and doc_id is not null")
    gone = numbered.filter("not kept").select("doc_id", "text_hash")
    again = (
        numbered.filter("kept").groupBy("doc_id").agg(F.min("text_hash").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    twice = numbered.filter("kept").join(again, "doc_id")
    gone = gone.union(twice.filter("text_hash <> first").select("doc_id", "text_hash")).distinct()
    gone = shared.stored(gone.withColumn("repeats", F.lit(False)).union(
        twice.filter("text_hash = first").select("doc_id", "text_hash", F.lit(True).alias("repeats")).distinct()
    ).select(F.col("doc_id").alias(f"{own}id"), F.col("text_hash").alias(f"{own}hash"), F.col("repeats").alias(f"{own}repeats")), "gone")
    hashed = documents.withColumn(f"{own}text", F.xxhash64("text"))
    same = (F.col("doc_id") == F.col(f"{own}id")) & (F.col(f"{own}text") == F.col(f"{own}hash"))
    marked = hashed.join(checked_broadcast(gone, 32), same, "left")
    once = marked.filter(F.col(f"{own}repeats").isNull()).select(*documents.columns)
    if gone.filter(f"{own}repeats").isEmpty():
        return once
    repeats = marked.filter(f"{own}repeats").dropDuplicates(["doc_id"]).select(*documents.columns)
    return once.union(repeats)
