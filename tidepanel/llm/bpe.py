"""Byte-level BPE encoding and decoding with a local rank file.

The rank file (a line per token: base64 bytes, rank) is read once on the driver and sent to the
workers; it is a vocabulary, so its size is bounded by the tokenizer, not by the data. Workers build
one ``tiktoken`` encoding each and keep it.

Long texts are cut before a space or line feed that follows an ASCII letter or digit. No alternative
of the pattern spans such a place: a match holds white space only in front, or is white space only.
So the pieces encode to the same ids as the whole text. A stretch without such a place stays whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm import shared

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE_CHARS = 32_768
SAFE = re.compile(r"(?<=[0-9A-Za-z])(?=[ \n])")


@lru_cache(maxsize=2)
def _encoding(rank_lines: bytes, pattern: str) -> tiktoken.Encoding:
    pairs = (line.split() for line in rank_lines.splitlines() if line)
    ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Consecutive pieces of about ``size`` characters, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(encoding: tiktoken.Encoding, text: str | None, size: int = PIECE_CHARS) -> bytes:
    """Token ids as little-endian unsigned 32-bit integers; a NULL text encodes as an empty one."""
    if not text:
        return b""
    return b"".join(np.asarray(encoding.encode_ordinary(p), "<u4").tobytes() for p in pieces(text, size))


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _map(frame: DataFrame, column: str, out: str, made) -> DataFrame:
    """Replace ``column`` by the binary column ``out``, batch by batch; the others stay."""
    kept = [c for c in frame.columns if c != column]
    if out in kept:
        raise ValueError(f"column {out} is there already")
    shared.prepare(frame.sparkSession)

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = made()
        for batch in batches:
            arrays = [batch.column(c) for c in kept]
            values = pa.array([convert(v.as_py()) for v in batch.column(column)], pa.binary())
            yield pa.RecordBatch.from_arrays([*arrays, values], names=[*kept, out])

    schema = T.StructType([*(frame.schema[c] for c in kept), T.StructField(out, T.BinaryType())])
    return frame.select(*kept, column).mapInArrow(run, schema)


def encode(
    frame: DataFrame, text: str = "text", out: str = "ids", ranks_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN, piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """Token ids of every whole text, packed as little-endian unsigned 32-bit integers.

    ``text`` is replaced by ``out``; other columns stay, and may have any names but ``out``. NULL and
    empty texts give an empty binary. Special tokens in a text are ordinary text. ``ranks_path`` is
    read on the driver.
    """
    lines = frame.sparkSession.sparkContext.broadcast(
        read_ranks(ranks_path or public_tokenizers.path(DEFAULT_RANKS))
    )

    def made():
        return partial(encode_text, _encoding(lines.value, pattern), size=piece_chars)

    return _map(frame, text, out, made)


def decode(
    frame: DataFrame, ids: str = "ids", out: str = "bytes", ranks_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """The raw bytes behind packed ids; they need not be valid UTF-8. NULL ids give NULL."""
    lines = frame.sparkSession.sparkContext.broadcast(
        read_ranks(ranks_path or public_tokenizers.path(DEFAULT_RANKS))
    )

    def made():
        encoding = _encoding(lines.value, pattern)
        return lambda packed: None if packed is None else encoding.decode_bytes(
            np.frombuffer(packed, "<u4").tolist()
        )

    return _map(frame, ids, out, made)


def digests(documents: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """One row per document: token count, digest of the packed ids, digest of the decoded bytes."""
    packed = encode(documents.select("doc_id", "text"), "text", "ids", ranks_path)
    counted = packed.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), "ids",
    )
    return decode(counted, "ids", "bytes", ranks_path).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256")
    )
