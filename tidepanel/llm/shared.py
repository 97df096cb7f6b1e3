"""Helpers that several operators use: scratch tables, Arrow batches, words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 * 1024 * 1024
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only a local master gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tidepanel-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go with the query that wrote them, not only when the driver's garbage collector finds them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, name: str = "table") -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: lineage is cut."""
    spark = frame.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    made = spark.read.schema(frame.schema).parquet(path)
    made.stored_at = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned and that nothing reads any more; other frames are left alone."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path is not None:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def free_prefix(columns: list[str], start: str = "_own_") -> str:
    """A prefix that no column has, upper and lower case alike, for helper columns beside given ones."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(start) for c in taken):
        start = "_" + start
    return start


def digest_words(text: Column) -> Column:
    """Words of a text by the contracts: runs without space, tab, line feed to carriage return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def lowered_words(text: str | None) -> list[bytes]:
    """UTF-8 words of the text with A-Z lower-cased; bytes.split() splits at the same six characters."""
    return [] if text is None else text.encode().translate(LOWER).split()


class WordHash(dict):
    """64-bit hashes of words, kept while there are at most ``limit`` of them."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """The same task function; at its end the worker, which Spark keeps, gives unused memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def arrow_of(schema: dict[str, pa.DataType], columns: dict[str, object]) -> pa.RecordBatch:
    """A record batch with exactly these columns and types."""
    arrays = [
        columns[name] if isinstance(columns[name], pa.Array) and columns[name].type == kind
        else pa.array(columns[name], kind)
        for name, kind in schema.items()
    ]
    return pa.RecordBatch.from_arrays(arrays, names=list(schema))


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[str | None]:
    """The strings of a column one by one, without a list of all of them."""
    for value in batch.column(column):
        yield value.as_py()
