"""Alignment of two tokenizers' tokens over the same texts.

Vocabulary A is a byte-level BPE, vocabulary B a BPE of pieces with byte fallback. Both encode a space
and the text. Byte offsets where a token of either ends cut both sequences into groups; tokens of one group are linked. Over
the corpus, an id pair counts the documents that link it.

The work is Arrow tables from end to end. Per Arrow batch (a chunk), token lists are flattened with
their parent indices, byte lengths become ends by cumulative sums per segment, ends that both sides have are found by an Acero
hash join, groups are joined with groups for the links, and ``Table.group_by`` counts pairs per document and documents per pair.
A chunk becomes one stored row: figures of its documents, its distinct pairs with partial counts, and per document the
(compressed) places of its pairs among them. Spark sums the partial counts, joins the sums back to the chunks that asked
for them, and gives each chunk its own answers. So texts are encoded once, no pair table is broadcast, and what is shuffled is a
row per chunk and pair.

Long texts are cut into segments between an ASCII letter or digit and a space before another. Both sides have a token end
there: the pattern of A ends a match in front of the space, and B has no piece with a space mark behind another character (if
a model has one, texts stay whole). A group never spans such a place.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import shared

VOCABULARY_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a segment, and of the segments that are aligned at once.
SEGMENT_CHARS, SLAB_CHARS = 16_384, 262_144
SAFE = re.compile(r"(?<=[0-9A-Za-z])(?= [0-9A-Za-z])")
MARK = "▁"


def byte_of_character() -> dict[str, int]:
    """Byte-level alphabets: printable Latin-1 stands for itself, other bytes for characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Side:
    """One tokenizer: its encoder and the bytes of every id."""

    encode: object
    bytes_of: list[bytes]
    cuts: bool = True

    def __post_init__(self):
        self.table = pa.array(self.bytes_of, pa.large_binary())
        self.length = pa.array([len(b) for b in self.bytes_of], pa.int64())


@lru_cache(maxsize=2)
def side_a(vocabulary: bytes, pattern: str) -> Side:
    """The byte-level BPE of a tokenizer's JSON file.

    Where ids follow the order of the merges, they are ranks, and the encoder works from them; another
    file is read by the tokenizers library.
    """
    told = json.loads(vocabulary)
    names, merges = told["model"]["vocab"], told["model"]["merges"]
    alphabet = byte_of_character()
    added = {t["id"]: t["content"].encode() for t in told.get("added_tokens", [])}
    ids = {bytes(alphabet[c] for c in name): i for name, i in names.items() if i not in added}
    bytes_of = [b""] * (1 + max([*ids.values(), *added]))
    for raw, i in ids.items():
        bytes_of[i] = raw
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    if [names[m] for m in made] == list(range(256, 256 + len(made))):
        encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ids, special_tokens={})
        return Side(lambda texts: [encoding.encode_ordinary(t) for t in texts], bytes_of)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary.decode())
    tokenizer.encode_special_tokens = True
    return Side(lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)], bytes_of)


@lru_cache(maxsize=2)
def side_b(model: bytes) -> Side:
    """The piece BPE of a model file; it puts a space in front of what it encodes."""
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    bytes_of = [
        bytes([int(name[3:5], 16)]) if pieces.is_byte(i) else name.replace(MARK, " ").encode() for i, name in enumerate(names)
    ]
    cuts = not any(re.search(f"[^{MARK}]{MARK}", name) for name in names)
    return Side(lambda texts: pieces.encode(texts, num_threads=1), bytes_of, cuts)


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters; the space at each cut is left out."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start() + 1
    yield text[start:]


def _tokens(ids: list[list[int]]) -> tuple[pa.Array, np.ndarray]:
    """Flat ids and the segment of each."""
    lists = pa.array(ids, pa.list_(pa.int32()))
    return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int64)


def _data(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a large binary array, one after the other, and its offsets."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not len(values):
        return memoryview(b""), np.zeros(1, np.int64)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return memoryview(values.buffers()[2]).cast("B")[offsets[0] : offsets[-1]], offsets - offsets[0]


def _whole(flat: pa.Array, parent: np.ndarray, raw: list[bytes], side: Side) -> np.ndarray:
    """Per segment whether its tokens' bytes, joined, are its own."""
    joined, offsets = _data(pc.take(side.table, flat))
    upto = np.searchsorted(parent, np.arange(len(raw) + 1))
    ends = offsets[upto]
    if (np.diff(ends) == [len(r) for r in raw]).all() and joined == b"".join(raw):
        return np.ones(len(raw), bool)
    return np.array([joined[s:e] == r for r, s, e in zip(raw, ends[:-1].tolist(), ends[1:].tolist(), strict=True)], bool)


def _counted(group: np.ndarray, ids: pa.Array, name: str) -> pa.Table:
    """Distinct (group, id) with how often it occurs; group and id are one key."""
    keys = pa.table({"key": (group.astype(np.int64) << 32) | ids.to_numpy(), "one": np.ones(len(group), np.int32)})
    found = keys.group_by("key", use_threads=False).aggregate([("one", "sum")])
    key = found.column("key").to_numpy()
    return pa.table({"group": key >> 32, name: key & 0xFFFFFFFF, f"n_{name}": found.column("one_sum")})


def _summed(doc: np.ndarray, pair: np.ndarray, times: object) -> pa.Table:
    """(key, m) of distinct documents' pairs: the document above 40 bits of the pair."""
    keys = pa.table({"key": (doc.astype(np.int64) << 40) | pair, "m": times})
    return keys.group_by("key", use_threads=False).aggregate([("m", "sum")]).rename_columns(["key", "m"])


#: Decimal ids with each of the four signs that may follow, and none at all.
SIGNS = [b",", b"|", b";"]


@lru_cache(maxsize=2)
def _decimals(size: int) -> pa.Array:
    return pa.array([b"%d%s" % (i, s) for i in range(size) for s in SIGNS], pa.large_binary())


def _texts(a: tuple[pa.Array, np.ndarray], b: tuple[pa.Array, np.ndarray], size: int) -> tuple[memoryview, np.ndarray]:
    """The groups as ``a1,a2|b1;...;`` and the end of each group in it."""
    (ids_a, group_a), (ids_b, group_b) = a, b
    many = int(group_a[-1]) + 1
    upto_a, upto_b = (np.cumsum(np.bincount(g, minlength=many)) for g in (group_a, group_b))
    before_b = upto_b - np.bincount(group_b, minlength=many)
    place_a = np.arange(len(group_a)) + before_b[group_a]
    place_b = np.arange(len(group_b)) + upto_a[group_b]
    last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
    code = np.empty(len(place_a) + len(place_b), np.int64)
    code[place_a] = ids_a.to_numpy().astype(np.int64) * 3 + last_a
    code[place_b] = ids_b.to_numpy().astype(np.int64) * 3 + 2 * last_b
    data, offsets = _data(pc.take(_decimals(size), pa.array(code)))
    return data, offsets[upto_a + upto_b]


@dataclass
class Slab:
    """Figures of some segments: per segment its counts, and per group of segments (a document) its pairs."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    text: memoryview
    ends: np.ndarray
    pairs: pa.Table


def align_segments(parts: list[str], owner: np.ndarray, a: Side, b: Side) -> Slab:
    """Links within segments; ``owner`` numbers the document of each. Parts begin with a space that is not given."""
    raw = [b" " + p.encode() for p in parts]
    ids_a, seg_a = _tokens(a.encode([" " + p for p in parts]))
    ids_b, seg_b = _tokens(b.encode(parts))
    good = _whole(ids_a, seg_a, raw, a) & _whole(ids_b, seg_b, raw, b)
    if not good.all():
        keep_a, keep_b = good[seg_a], good[seg_b]
        ids_a, seg_a, ids_b, seg_b = ids_a.filter(pa.array(keep_a)), seg_a[keep_a], ids_b.filter(pa.array(keep_b)), seg_b[keep_b]
    many = len(parts)
    n_a, n_b = np.bincount(seg_a, minlength=many), np.bincount(seg_b, minlength=many)
    if not len(seg_a):
        zero = np.zeros(many, np.int64)
        return Slab(good, n_a, n_b, zero, zero, memoryview(b""), zero, _summed(zero[:0], zero[:0], zero[:0]))
    # Ends counted over all segments, which are as long on both sides: a key of document and end in one.
    end_a, end_b = (pc.cumulative_sum(pc.take(s.length, i)) for s, i in ((a, ids_a), (b, ids_b)))
    both = pa.table({"end": end_a, "segment": seg_a}).join(pa.table({"end": end_b}), "end", join_type="inner", use_threads=False)
    both = both.sort_by("end")
    cut, of = both.column("end").to_numpy(), both.column("segment").to_numpy()
    group_a, group_b = (np.searchsorted(cut, e.to_numpy()) for e in (end_a, end_b))
    links = np.bincount(group_a, minlength=len(cut)) * np.bincount(group_b, minlength=len(cut))
    n_groups = np.bincount(of, minlength=many)
    n_links = np.bincount(of, weights=links, minlength=many).astype(np.int64)
    text, ends = _texts((ids_a, group_a), (ids_b, group_b), max(len(a.bytes_of), len(b.bytes_of)))
    met = _counted(group_a, ids_a, "a").join(_counted(group_b, ids_b, "b"), "group", join_type="inner", use_threads=False)
    pair = met.column("a").to_numpy() * len(b.bytes_of) + met.column("b").to_numpy()
    pairs = _summed(owner[of[met.column("group").to_numpy()]], pair, pc.multiply(met.column("n_a"), met.column("n_b")))
    upto = np.cumsum(n_groups)
    return Slab(good, n_a, n_b, n_groups, n_links, text, np.concatenate(([0], ends))[upto], pairs)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<i8").ravel()


CHUNK = {
    "chunk": pa.int64(), "doc_id": pa.list_(pa.int64()), "n_a": pa.list_(pa.int64()), "n_b": pa.list_(pa.int64()),
    "n_groups": pa.list_(pa.int64()), "n_links": pa.list_(pa.int64()), "groups": pa.list_(pa.string()),
    "sizes": pa.list_(pa.int64()), "places": pa.binary(), "times": pa.binary(), "pairs": pa.list_(pa.int64()),
    "seen": pa.list_(pa.int64()),
}
CHUNK_DDL = (
    "chunk bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups array<string>, sizes array<bigint>, places binary, times binary, pairs array<bigint>, seen array<bigint>"
)


def align_texts(texts: list[str | None], a: Side, b: Side, digest: bool = True, slab_chars: int = SLAB_CHARS,
                segment_chars: int = SEGMENT_CHARS) -> dict[str, object]:
    """All columns of a chunk but its number and ids, for its texts."""
    many = len(texts)
    totals = {name: np.zeros(many, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    good, begun = np.ones(many, bool), np.zeros(many, bool)
    hashes = [hashlib.sha256() if digest else bytearray() for _ in texts]
    tables: list[pa.Table] = []
    size = segment_chars if a.cuts and b.cuts else 1 << 62

    def run(parts: list[str], owner: list[int]) -> None:
        of = np.array(owner)
        slab = align_segments(parts, of, a, b)
        for name, total in totals.items():
            np.add.at(total, of, getattr(slab, name))
        np.logical_and.at(good, of, slab.good)
        start = 0
        for doc, end in zip(owner, slab.ends.tolist(), strict=True):
            if end > start:
                # Each segment ends with a semicolon, which stands in front of the next one instead.
                piece = bytes(slab.text[start : end - 1])
                add = hashes[doc].update if digest else hashes[doc].extend
                add((b";" if begun[doc] else b"") + piece)
                begun[doc], start = True, end
        tables.append(slab.pairs)

    parts: list[str] = []
    owner: list[int] = []
    held, crossed = 0, False
    for doc, text in enumerate(texts):
        if parts and held + len(text or "") > slab_chars:
            run(parts, owner)
            parts, owner, held = [], [], 0
        for part in segments(text, size) if text else ():
            if held >= slab_chars:
                run(parts, owner)
                parts, owner, held, crossed = [], [], 0, True
            parts.append(part)
            owner.append(doc)
            held += len(part)
    if parts:
        run(parts, owner)
    table = pa.concat_tables(tables) if tables else _summed(totals["n_a"][:0], totals["n_a"][:0], totals["n_a"][:0])
    if crossed:  # a document in several slabs
        table = table.group_by("key", use_threads=False).aggregate([("m", "sum")]).rename_columns(["key", "m"])
    table = table.filter(pa.array(good[table.column("key").to_numpy() >> 40])).sort_by("key")
    key, times = table.column("key").to_numpy(), table.column("m").to_numpy()
    doc, pair = key >> 40, key & ((1 << 40) - 1)
    # How many of the chunk's documents hold each pair: partial counts, merged by Spark.
    seen = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
    pairs = seen.column("pair").to_numpy()
    places = np.searchsorted(pairs, pair)
    sizes = np.bincount(doc, minlength=many)
    # Places as differences within a document, so that they are small numbers.
    steps = np.diff(places, prepend=0)
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[firsts] = places[firsts]
    full = good & begun
    if digest:
        told = [h.hexdigest() if f else "" for h, f in zip(hashes, full, strict=True)]
    else:
        told = [h.decode() if f else "" for h, f in zip(hashes, full, strict=True)]
    return {name: np.where(full, total, 0) for name, total in totals.items()} | {
        "groups": told, "sizes": sizes, "places": _packed(steps), "times": _packed(times), "pairs": pairs,
        "seen": seen.column("count_all").to_numpy(),
    }


def chunks(
    documents: DataFrame, vocabulary: str | None = None, model: str | None = None, pattern: str = public_tokenizers.PATTERN,
    digest: bool = True, slab_chars: int = SLAB_CHARS, segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """One stored row per Arrow batch of ``documents`` (doc_id, text), as the head of this module describes."""
    spark = documents.sparkSession
    shared.prepare(spark)
    with open(vocabulary or public_tokenizers.path(VOCABULARY_A), "rb") as one, open(model or public_tokenizers.path(MODEL_B), "rb") as two:
        sides = spark.sparkContext.broadcast((one.read(), two.read()))

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side_a(sides.value[0], pattern), side_b(sides.value[1])
        for number, batch in enumerate(batches):
            made = align_texts(batch.column("text").to_pylist(), a, b, digest, slab_chars, segment_chars)
            row = {"chunk": (TaskContext.get().partitionId() << 32) + number, "doc_id": batch.column("doc_id")} | made
            arrays = []
            for name, kind in CHUNK.items():
                if pa.types.is_list(kind):
                    values = pa.array(row[name], kind.value_type) if not isinstance(row[name], pa.Array) else row[name]
                    arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(kind))
                else:
                    arrays.append(pa.array([row[name]], kind))
            yield pa.RecordBatch.from_arrays(arrays, names=list(CHUNK))

    return shared.stored(
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, CHUNK_DDL), "chunks"
    )


def _partial(made: DataFrame) -> DataFrame:
    """(chunk, place, pair, n): every chunk's distinct pairs with the number of its documents that hold them."""

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                pairs = pc.list_flatten(row.column("pairs"))
                if len(pairs):
                    owner = pc.take(row.column("chunk"), pc.list_parent_indices(row.column("pairs")))
                    yield pa.RecordBatch.from_arrays(
                        [owner, pa.array(np.arange(len(pairs), dtype=np.int32)), pairs, pc.list_flatten(row.column("seen"))],
                        names=["chunk", "place", "pair", "n"],
                    )

    return made.select("chunk", "pairs", "seen").mapInArrow(run, "chunk bigint, place int, pair bigint, n bigint")


def pair_counts(partial: DataFrame, width: int) -> DataFrame:
    """(pair, count, best): documents corpus-wide that link the pair, and whether no pair of its A id has more."""
    counts = shared.stored(partial.groupBy("pair").agg(F.sum("n").alias("count")), "counts")
    named = counts.withColumn("a", F.floor(F.col("pair") / width))
    most = named.groupBy("a").agg(F.max("count").alias("most"))
    return named.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def vocabulary_map(documents: DataFrame, **options: object) -> DataFrame:
    """a_id, b_id, n_documents, best: every id pair that a document links, with its count.

    ``best`` marks the pairs no other pair of their A id exceeds. Options are those of ``chunks``.
    """
    width = len(side_b(_model(options)).bytes_of)
    counted = pair_counts(_partial(chunks(documents, **options)), width)
    return counted.select(
        F.floor(F.col("pair") / width).cast("int").alias("a_id"), (F.col("pair") % width).cast("int").alias("b_id"),
        F.col("count").alias("n_documents"), "best",
    )


def _model(options: dict[str, object]) -> bytes:
    with open(options.get("model") or public_tokenizers.path(MODEL_B), "rb") as file:
        return file.read()


OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def aligned(documents: DataFrame, **options: object) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``n_links`` counts linked token occurrences, ``n_best`` those whose pair is the A id's most frequent in the corpus (by
    documents, ties included), ``count_sum`` adds up their pairs' counts. ``groups`` is the SHA-256 of the ids per group, or
    with ``digest=False`` the ids themselves, as ``a1,a2|b1;a3|b2,b3``. Texts that are NULL or empty, or that a side does not
    give back byte for byte (such as those with U+2581), have zeros and an empty string, and count for no pair. Rows that repeat, text or
    id, each count as a document; NULL ids stay NULL. An empty table gives no rows. Long texts are taken whole, segment by
    segment. Other columns are passed over, whatever their names. Options are those of ``chunks``.
    """
    width = len(side_b(_model(options)).bytes_of)
    made = chunks(documents, **options)
    partial = shared.stored(_partial(made), "partial")
    answers = partial.join(pair_counts(partial, width), "pair").select("chunk", "place", "count", "best")

    def merge(stored: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("place")
        count = answers.column("count").to_numpy()
        best = answers.column("best").to_numpy(zero_copy_only=False)
        outs = []
        for i in range(stored.num_rows):
            row = stored.slice(i, 1)
            lists = {n: row.column(n).combine_chunks().flatten() for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")}
            sizes = row.column("sizes").combine_chunks().flatten().to_numpy()
            upto = np.cumsum(sizes)
            steps, times = (_unpacked(row.column(n)[0].as_py()) for n in ("places", "times"))
            sums = np.concatenate(([0], np.cumsum(steps)))
            # Each document's places start anew.
            places = sums[1:] - np.repeat(sums[upto - sizes], sizes)
            for name, each in (("n_best", times * best[places]), ("count_sum", times * count[places])):
                total = np.concatenate(([0], np.cumsum(each)))
                lists[name] = pa.array(total[upto] - total[upto - sizes], pa.int64())
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
            outs.append(pa.table([lists[n] for n in names], names=names))
        if outs:
            return pa.concat_tables(outs)
        return pa.table({n: pa.array([], pa.string() if n == "groups" else pa.int64()) for n in (
            "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")})

    return (
        made.drop("pairs", "seen").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(merge, OUT)
    )


def align_documents(documents: DataFrame, **options: object) -> DataFrame:
    """As ``aligned``, with the digest of the groups as ``groups_sha256``."""
    return aligned(documents, **options).withColumnRenamed("groups", "groups_sha256")
