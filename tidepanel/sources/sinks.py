"""Writers of posts, daily series, panels, audits and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.text import slug
from tidepanel.sources.landing import is_default_profile


def write_posts(posts: DataFrame, path: str, key: str = "ticker", mode: str = "overwrite") -> None:
    """Matched posts as Parquet, one folder per key.

    The rebalance hint merges small keys and splits a hot one over several tasks and files.
    """
    posts.hint("rebalance", F.col(key)).write.mode(mode).partitionBy(key).parquet(path)


def write_csv(frame: DataFrame, path: str, order: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV with a header; ``order`` sorts by range, so that the parts are ordered among themselves."""
    ordered = frame.orderBy(*order) if order else frame
    ordered.write.mode(mode).option("header", True).csv(path)


def write_panel(panel: DataFrame, path: str, key: str = "ticker", mode: str = "overwrite") -> None:
    """The panel as Parquet, partitioned by key, dates sorted inside the files."""
    (
        panel.hint("rebalance", F.col(key)).sortWithinPartitions(key, "date")
        .write.mode(mode).partitionBy(key).parquet(path)
    )


def write_ordered(frame: DataFrame, path: str, order: list[str], mode: str = "overwrite") -> None:
    """Parquet whose files, in order of their names, hold the rows in order: cut by range, sorted inside.

    Rows of one value of ``order`` may follow each other in any order.
    """
    frame.orderBy(*order).write.mode(mode).parquet(path)


def read_ordered(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """Rows of an ordered table with their position, from 1.

    A file's first position is the number of rows in the files before it, summed over a row per file;
    inside a file rows are counted by the reader. No row of the table is shuffled or sorted again.
    """
    rows = spark.read.parquet(path)
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    found = placed.join(files, "_file").withColumn(position, F.col("_before") + F.col("_row") + 1)
    return found.select(*rows.columns, position)


def write_json(document: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row."""
    document.write.mode(mode).json(path)


def keys_to_build(wanted: DataFrame, present: DataFrame, key: str = "ticker") -> DataFrame:
    """Wanted keys whose output is not there yet; the job then writes only these, appending."""
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def output_stem(
    stem: str, bare: str, ticker: Column, company: Column, tag: Column
) -> Column:
    """Output name: the bare name for the default profile, else ``stem_tag``."""
    tagged = F.concat(F.lit(f"{stem}_"), slug(tag, ticker))
    return F.when(is_default_profile(ticker, company, tag), F.lit(bare)).otherwise(tagged)
