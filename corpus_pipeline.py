"""A corpus pipeline over ``documents``: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each result as Parquet to the
shared folder and reads it again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import bpe, mixing, neardup, secrets, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject; it is fitted to the labels among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.trained(docs, labels)
    own = shared.free_prefix(docs.columns)
    return toxicity.score(docs, model, own=own).filter(~F.col(f"{own}toxic")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return neardup.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets in its text give way to a mark, and n_chars follows the text."""
    own = shared.free_prefix(docs.columns)
    spans = F.col(f"{own}spans")
    changed = secrets.scan(docs, secrets.trained(docs), own=own).withColumn("text", secrets.redacted(F.col("text"), spans))
    length = F.char_length("text").cast("bigint")
    changed = changed.withColumn("n_chars", F.when(F.size(spans) > 0, length).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed as unsigned 32-bit integers) in place of the texts, and whether they decode to them."""
    own = shared.free_prefix(docs.columns)
    col = {name: f"{own}{name}" for name in ("digest", "ids", "kept", "bytes")}
    named = docs.withColumn(col["digest"], F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    encoded = bpe.encode(named, "text", col["ids"]).withColumn(col["kept"], F.col(col["ids"]))
    decoded = bpe.decode(encoded, col["ids"], col["bytes"])
    ids = F.col(col["kept"])
    return decoded.select(
        "doc_id", "lang", "source", "n_chars", ids.alias("token_ids"), (F.octet_length(ids) / 4).cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), (F.sha2(col["bytes"], 256) == F.col(col["digest"])).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

#: SQL can express neither the fitted models nor the rounding and the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
