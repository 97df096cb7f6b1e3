"""Readers of landed files: daily CSVs, metric payloads, window files, post dumps, prices."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.contract import PANEL_COLUMNS
from tidepanel.functions.clock import parse_date
from tidepanel.functions.numeric import as_number, missing

DATE_NAMES = ("date", "Date")


def standard_date(frame: DataFrame, formats: tuple[str, ...] = ()) -> DataFrame:
    """Name the first of ``date``/``Date`` that is present ``date``; drop rows it cannot parse."""
    name = next((c for c in DATE_NAMES if c in frame.columns), None)
    if name is None:
        raise KeyError(f"no date column among {frame.columns}")
    rest = [F.col(c) for c in frame.columns if c != name]
    return frame.select(parse_date(F.col(name), formats).alias("date"), *rest).filter(
        F.col("date").isNotNull()
    )


def coerce_numbers(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Add absent columns as NULL and cast the others to double, unreadable values to NULL."""
    made = {
        c: as_number(F.col(c)) if c in frame.columns else missing() for c in columns
    }
    return frame.withColumns(made)


def csv_by_header(spark: SparkSession, path: str | list[str], shape) -> DataFrame:
    """CSV files of any headers: one scan per header, ``shape`` on each, united by name.

    Columns are read as text under the names of the file's own header. First lines come from one scan
    of the lines; what reaches the driver is a name and a first line per file. A file without lines
    gives no rows.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value",
        F.monotonically_increasing_id().alias("n"),
    )
    groups: dict[str, list[str]] = {}
    first = lines.filter("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("header"))
    for row in first.toLocalIterator():
        groups.setdefault(row.header, []).append(unquote(row.file))
    if not groups:
        raise KeyError(f"no header among {path}")
    frames = [shape(spark.read.csv(sorted(files), header=True, inferSchema=False)) for _, files in sorted(groups.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_daily_csv(
    spark: SparkSession,
    path: str | list[str],
    numbers: list[str] | None = None,
    key_pattern: str | None = None,
    key: str = "ticker",
) -> DataFrame:
    """Daily CSV files, many keys at once, each read by its own header.

    Every column is read as text and coerced afterwards, so a bad cell costs only itself. With
    ``key_pattern`` the key is the first group matched in the file name.
    """

    def shape(frame: DataFrame) -> DataFrame:
        if key_pattern is not None:
            name = F.col("_metadata.file_name")
            frame = frame.withColumn(key, F.upper(F.regexp_extract(name, key_pattern, 1)))
        return standard_date(frame)

    frame = csv_by_header(spark, path, shape)
    return frame if numbers is None else coerce_numbers(frame, numbers)


def parse_json_lines(
    lines: DataFrame, column: str, fields: list[str], keep: list[str] = ()
) -> DataFrame:
    """Fields of JSON objects held one per row, all as text.

    Blank lines, malformed lines and lines that are no object are skipped; bytes that are no UTF-8
    are dropped from the line. A field of another JSON type keeps its raw text.
    """
    line = F.col(column)
    clean = F.trim(
        F.when(F.is_valid_utf8(line), line).otherwise(
            F.regexp_replace(F.make_valid_utf8(line), "\ufffd", "")
        )
    )
    schema = T.StructType(
        [T.StructField(name, T.StringType()) for name in fields]
        + [T.StructField("_malformed", T.StringType())]
    )
    parsed = F.from_json(
        "_line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}
    )
    return (
        lines.select(*keep, clean.alias("_line"))
        .filter(F.startswith(F.col("_line"), F.lit("{")))
        .select(*keep, parsed.alias("_o"))
        .filter(F.col("_o").isNotNull() & F.col("_o._malformed").isNull())
        .select(*keep, *[F.col("_o")[name].alias(name) for name in fields])
    )


def read_ndjson(spark: SparkSession, path: str | list[str], fields: list[str]) -> DataFrame:
    """A newline-delimited JSON dump; splittable, one task per block of lines."""
    return parse_json_lines(spark.read.text(path), "value", fields)


def read_metric_payloads(
    spark: SparkSession, path: str | list[str], value_name: str
) -> DataFrame:
    """Metric payloads, one request window per file: ``Date``, perhaps ``Series``, ``Value``.

    A ``sep=`` first line and a byte-order mark are dropped, ``Value`` is renamed (added as NULL if
    absent), ``Series`` is left out, rows with a bad date are dropped. An empty payload and one
    without ``Date`` fail the job; one with nothing but a header gives no rows. A file holds one
    window of days, so reading it whole is bounded by the window.
    """

    def fields(line: Column) -> Column:
        """Cells of a line, quoted ones without their quotes. With a comma in front every cell has one."""
        cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
        bare = lambda x: F.regexp_replace(F.regexp_extract(x, r'(?s)^"(.*)"$', 1), '""', '"')
        return F.transform(cells, lambda x: F.trim(F.when(x.startswith('"'), bare(x)).otherwise(x)))

    body = F.regexp_replace(F.col("value"), "^\ufeff?(sep=[^\r\n]*\r?\n?)?\ufeff?", "")
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), lines.alias("lines")
    )
    header = fields(F.get("lines", F.lit(0)))
    # Both checks sit in expressions every row depends on, so they cannot be pruned away.
    data = F.when(
        F.size("lines") == 0,
        F.raise_error(F.concat(F.lit("empty metric payload: "), F.col("file_name"))).cast("array<string>"),
    ).otherwise(F.slice("lines", F.lit(2), F.size("lines")))
    date_at = F.when(F.array_position("header", "Date") > 0, F.array_position("header", "Date")).otherwise(
        F.raise_error(F.concat(F.lit("metric payload without Date: "), F.col("file_name"))).cast("bigint")
    )
    rows = files.select("file_name", header.alias("header"), F.explode(data).alias("line"))
    value_at = F.array_position("header", "Value")

    def cell(at: Column) -> Column:
        return F.get(fields(F.col("line")), at.cast("int") - 1)

    return rows.select(
        parse_date(cell(date_at)).alias("date"),
        F.when(value_at > 0, as_number(cell(value_at))).alias(value_name),
        "file_name",
    ).filter(F.col("date").isNotNull())


def read_window_files(
    spark: SparkSession, path: str | list[str], numbers: list[str], with_mode: bool = False
) -> DataFrame:
    """Window files named ``[mode_]start_end.csv``, with the bounds as columns.

    Columns go by the names in each file's header; overlapping windows are resolved by ``dedupe_dates``.
    """
    day = r"(\d{4}-\d{2}-\d{2})"
    name = F.col("_metadata.file_name")
    bounds = {
        "window_start": F.regexp_extract(name, rf"{day}_{day}\.csv$", 1).cast("date"),
        "window_end": F.regexp_extract(name, rf"{day}_{day}\.csv$", 2).cast("date"),
    }
    if with_mode:
        bounds["mode"] = F.regexp_extract(name, rf"^(.+)_{day}_{day}\.csv$", 1)
    frame = csv_by_header(spark, path, lambda part: standard_date(part.withColumns(bounds)))
    return coerce_numbers(frame, numbers)


def price_columns(
    frame: DataFrame, start, end, close: str = "Close", volume: str = "Volume", key: str = "ticker"
) -> DataFrame:
    """Close and volume under the panel's names, both date bounds included.

    Fails when a column or every row is missing.
    """
    absent = [c for c in (close, volume) if c not in frame.columns]
    if absent:
        raise RuntimeError(f"price source lacks {absent}")
    keys = [key] if key in frame.columns else []
    prices = frame.select(
        "date", *keys,
        F.col(close).cast("double").alias("stock_price"),
        F.col(volume).cast("double").alias("stock_volume"),
    ).filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if prices.isEmpty():
        raise RuntimeError("price source is empty")
    return prices


def panel_schema() -> T.StructType:
    kinds = {"date": T.DateType(), "ticker": T.StringType(), "company_name": T.StringType()}
    return T.StructType(
        [T.StructField(c, kinds.get(c, T.DoubleType())) for c in PANEL_COLUMNS]
    )


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """The panel under its contract: Parquet if the path says so, else CSV by the names in the header."""
    schema = panel_schema()
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    text = csv_by_header(spark, path, lambda part: part)
    return text.select(
        *[(F.col(f.name) if f.name in text.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema]
    )


def present_files(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """Files that exist, as paths below the folder, listed by Spark; the content column is never read."""
    inside = re.escape(re.sub(r"^[A-Za-z][\w+.-]*:/*", "/", folder).rstrip("/"))
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(folder)
        .select(F.regexp_replace("path", rf"^.*?{inside}/", "").alias("path"), "length")
    )


def choose_sources(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """For every (ticker, source) the candidate of lowest priority number whose file exists.

    ``manifest`` is (ticker, source_name, priority, path). Pairs without any file keep a row with
    NULL. The choice is an aggregate, not a window, so it combines on the map side.
    """
    hits = manifest.join(present.select("path").distinct().withColumn("_hit", F.lit(True)), "path", "left")
    return hits.groupBy("ticker", "source_name").agg(
        F.min_by(F.when(F.col("_hit"), F.col("path")), F.when(F.col("_hit"), F.col("priority")))
        .alias("selected_file"),
        F.coalesce(
            F.min(F.when(F.col("_hit"), F.col("priority"))) > F.min("priority"), F.lit(False)
        ).alias("used_fallback"),
    )

