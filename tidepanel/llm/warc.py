"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Writing is a plain Spark text write: a record is a header, a blank line and a block, and the writer's
line separator is the record terminator CR LF CR LF. Files are cut by record count, so an archive
fits a task.

Reading takes whole archives (Spark's ``binaryFile``) and walks their members. A record must pass its
checks: version line, header syntax, length inside the archive, terminator, block digest, payload
digest. After a failed check the reader searches for the next version line (or gzip member) that
starts a record passing all of them, whichever is nearer, goes on from there, and logs the bytes in
between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import shared
from tidepanel.session import checked_broadcast

END = "\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
GZIP = b"\x1f\x8b\x08"
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)")
#: Bytes of an archive file, and of the records in the first size class.
FILE_BYTES, SMALL_RECORD = 64 << 20, 64 << 10
HEADER_BYTES = 65_536
INFLATE_BYTES = 65_536


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column: eight groups of five hex digits, four letters each."""
    groups = [
        F.lpad(F.conv(F.substring(F.sha1(data), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    # Digits of base 32 by number, letters of RFC 4648.
    return F.translate(
        F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def mark_revisits(digested: DataFrame, key: str, minimum_bytes: int = 0) -> DataFrame:
    """Add ``refers_to``: for a record that revisits another, the largest key with equal payload.

    Needs ``payload_digest`` and ``payload_bytes``. Only digests that occur twice or more are joined.
    A payload below ``minimum_bytes`` never revisits. NULL keys revisit the largest known key; rows
    that repeat the largest key are responses as well.
    """
    repeated = (
        digested.filter(F.col("payload_bytes") >= minimum_bytes)
        .groupBy("payload_digest").agg(F.max(key).alias("_response"), F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") > 1) & F.col("_response").isNotNull())
        .select(F.col("payload_digest").alias("_digest"), "_response")
    )
    joined = digested.join(
        checked_broadcast(repeated, 96),
        (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= minimum_bytes), "left",
    )
    differs = F.col("_response").isNotNull() & ~F.col("_response").eqNullSafe(F.col(key))
    return joined.withColumn("refers_to", F.when(differs, F.col("_response"))).drop("_digest", "_response")


def record_text(key: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """Header and block of a record; a revisit's block has the HTTP header only."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit(END),
    )
    block = F.when(refers_to.isNull(), F.concat(http, payload)).otherwise(http)
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    lines = [
        F.lit("WARC/1.1"),
        F.when(refers_to.isNull(), F.lit("WARC-Type: response")).otherwise(F.lit("WARC-Type: revisit")),
        F.concat(F.lit("WARC-Record-ID: <urn:record:"), name, F.lit(">")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), base32_sha1(block.cast("binary"))),
        F.when(
            refers_to.isNotNull(),
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                F.lit("WARC-Refers-To: <urn:record:"), refers_to.cast("string"), F.lit(">"),
            ),
        ),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archive(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
    minimum_bytes: int = 0, file_bytes: int = FILE_BYTES, small_record: int = SMALL_RECORD,
) -> None:
    """Write a record per row under ``path``, in files of ``file_bytes`` at most; NULL html is an empty payload.

    Rows are written by size class, each twice as large as the one before, a folder and a bound of records per file for
    each class that occurs; a file of a larger record holds that alone. Equal payloads are found on their digests; texts
    are not shuffled while the repeated digests fit a broadcast of checked size. Rows and keys may repeat or be NULL.
    """
    rows = pages.select(
        F.col(key).alias("_key"), F.col(url).alias("_url"),
        F.coalesce(F.col(html), F.lit("")).alias("_payload"),
    ).withColumns(
        {"payload_digest": base32_sha1(F.col("_payload").cast("binary")),
         "payload_bytes": F.octet_length("_payload").cast("bigint")}
    )
    # Header fields besides the url stay below 2 KiB; a url may grow threefold when it is cleaned.
    most = F.col("payload_bytes") + 3 * F.coalesce(F.octet_length("_url"), F.lit(0)) + 2048
    sized = mark_revisits(rows, "_key", minimum_bytes).withColumn(
        "_class", F.greatest(F.lit(0), F.ceil(F.log2(most / F.lit(float(small_record))))).cast("int")
    )
    plain = pages.select(
        F.col(url).alias("_url"), F.coalesce(F.octet_length(html), F.lit(0)).cast("bigint").alias("payload_bytes")
    ).select(F.greatest(F.lit(0), F.ceil(F.log2(most / F.lit(float(small_record))))).cast("int").alias("_class"))
    for row in plain.distinct().orderBy("_class").collect():  # a class per power of two
        records = max(1, file_bytes // (small_record << row["_class"]))
        (
            sized.filter(F.col("_class") == row["_class"])
            .select(
                record_text(
                    F.col("_key"), F.col("_url"), F.col("_payload"), F.col("payload_digest"), F.col("refers_to")
                ).alias("value")
            )
            .write.option("lineSep", END).option("maxRecordsPerFile", records).text(f"{path}/size-{row['_class']}")
        )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The archive files below a folder as binary rows; a folder that no class was written to has none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true")
    return found.load(path)


# --- reading --------------------------------------------------------------------------------------


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _payload(fields: dict[str, str], block: bytes) -> bytes:
    """The entity body of an HTTP message, else the whole block."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def parse_record(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and end of the record at ``start``; ValueError names the failed check."""
    version = VERSION.match(data, start)
    if version is None:
        raise ValueError("version line")
    head_end = data.find(b"\r\n\r\n", version.end() - 2, version.end() + HEADER_BYTES)
    if head_end < 0:  # a long header ends before the next version line
        following = VERSION.search(data, version.end())
        head_end = data.find(b"\r\n\r\n", version.end() - 2, following.start() if following else len(data))
    if head_end < 0:
        raise ValueError("header end")
    fields: dict[str, str] = {}
    for line in data[version.end() : head_end].split(b"\r\n"):
        field = FIELD.fullmatch(line)
        if field is None:
            raise ValueError("header syntax")
        fields[field[1].decode().lower()] = field[2].decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit():
        raise ValueError("content length")
    begin = head_end + 4
    end = begin + int(fields["content-length"])
    if end > len(data):
        raise ValueError("truncated block")
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("terminator")
    block = data[begin:end]
    if (told := fields.get("warc-block-digest", "")).startswith("sha1:") and told[5:] != _sha1(block):
        raise ValueError("block digest")
    told = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") == "response" and told.startswith("sha1:") and told[5:] != _sha1(_payload(fields, block)):
        raise ValueError("payload digest")
    return fields, block, end + 4


def salvage_plain(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, (fields, block)) and ("gap", start, end, reason), in order of offsets."""
    at = 0
    while at < len(data):
        try:
            fields, block, end = parse_record(data, at)
        except ValueError as fault:
            found = None
            for candidate in VERSION.finditer(data, at + 1):
                try:
                    parse_record(data, candidate.start())
                except ValueError:
                    continue
                found = candidate.start()
                break
            stop = len(data) if found is None else found
            yield "gap", at, stop, str(fault)
            at = stop
        else:
            yield "record", at, end, (fields, block)
            at = end


def _inflate(data: bytes, start: int) -> tuple[bytes, int]:
    """A gzip member's content and end; ValueError if the member is damaged or cut off."""
    unzip, parts, at = zlib.decompressobj(31), [], start
    try:
        while at < len(data) and not unzip.eof:
            parts.append(unzip.decompress(data[at : at + INFLATE_BYTES]))
            at += INFLATE_BYTES
    except zlib.error:
        raise ValueError("gzip member") from None
    if not unzip.eof:
        raise ValueError("truncated gzip member")
    return b"".join(parts), min(at, len(data)) - len(unzip.unused_data)


def _member(data: bytes, start: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``start``; ValueError if it holds no valid record."""
    content, end = _inflate(data, start)
    if not any(kind == "record" for kind, *_ in salvage_plain(content)):
        raise ValueError("no record in gzip member")
    return content, end


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """As ``salvage_plain`` over archives of plain records, gzip members, or both; offsets are the archive's.

    After a failed check the next valid start of either kind is searched for. Inside a member that inflates,
    records are salvaged as in a plain archive and carry the member's offsets.
    """
    at = 0
    while at < len(data):
        try:
            if data.startswith(GZIP, at):
                content, end = _inflate(data, at)
            else:
                fields, block, end = parse_record(data, at)
                content = None
        except ValueError as fault:
            stop = _next_start(data, at + 1)
            yield "gap", at, stop, str(fault)
            at = stop
            continue
        if content is None:
            yield "record", at, end, (fields, block)
        else:
            for kind, _, _, rest in salvage_plain(content):
                yield kind, at, end, rest
        at = end


def _next_start(data: bytes, at: int) -> int:
    """The first version line or gzip member from ``at`` on that starts a valid record; else the data's end."""
    for candidate in START.finditer(data, at):
        begin = candidate.start()
        try:
            (_member if data.startswith(GZIP, begin) else parse_record)(data, begin)
        except ValueError:
            continue
        return begin
    return len(data)


ROW = {
    "kind": pa.string(), "file": pa.string(), "start": pa.int64(), "end": pa.int64(), "reason": pa.string(),
    "record_type": pa.string(), "record_id": pa.string(), "refers_to_id": pa.string(), "target_uri": pa.string(),
    "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary(),
}
SCHEMA = (
    "kind string, file string, start bigint, end bigint, reason string, record_type string, record_id string, "
    "refers_to_id string, target_uri string, payload_digest string, payload_bytes bigint, payload binary"
)


def _rows(file: str, data: bytes, keep_payload: bool) -> Iterator[dict]:
    for kind, start, end, rest in salvage(data):
        row = dict.fromkeys(ROW) | {"kind": kind, "file": file, "start": start, "end": end}
        if kind == "gap":
            yield row | {"reason": rest}
            continue
        fields, block = rest
        response = fields.get("warc-type") != "revisit"
        payload = _payload(fields, block) if response else None
        yield row | {
            "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id", "").strip("<>"),
            "refers_to_id": fields.get("warc-refers-to", "").strip("<>") or None,
            "target_uri": fields.get("warc-target-uri"),
            "payload_digest": _sha1(payload) if response else fields.get("warc-payload-digest", "").removeprefix("sha1:"),
            "payload_bytes": len(payload) if response else None,
            "payload": payload if keep_payload else None,
        }


def read_archive(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records and gaps of archives given as ``binaryFile`` rows (path, content).

    One row per record (``kind`` record) and per quarantined byte range (``kind`` gap, with the failed
    check as ``reason``). A revisit has no payload of its own: digest from its header, NULL length. An
    empty archive or NULL content gives no rows.
    """
    shared.prepare(archives.sparkSession)

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held = [], 0
                for row in _rows(file.as_py(), content.as_py() or b"", keep_payload):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held > shared.BATCH_BYTES:
                        yield arrow_rows(rows)
                        rows, held = [], 0
                if rows:
                    yield arrow_rows(rows)

    return archives.select("path", "content").mapInArrow(run, SCHEMA)


def arrow_rows(rows: list[dict]) -> pa.RecordBatch:
    return shared.arrow_of(ROW, {name: [row[name] for row in rows] for name in ROW})


def page_records(records: DataFrame) -> DataFrame:
    """One row per page record: a revisit takes length and digest from the response it refers to.

    The response is found by digest and, of equal ids, one row; the lengths of responses that revisits
    need are narrow columns, joined by payload digest.
    """
    rows = records.filter(F.col("kind") == "record").select(
        _page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        _page_id(F.col("refers_to_id")).alias("refers_to"),
    )
    lengths = (
        rows.filter(F.col("record_type") == "response").groupBy("payload_digest")
        .agg(F.max("payload_bytes").alias("_bytes"))
    )
    revisits = rows.filter(F.col("record_type") == "revisit").join(lengths, "payload_digest", "left").select(
        "page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
    return rows.filter(F.col("record_type") != "revisit").unionByName(revisits)


def _page_id(name: Column) -> Column:
    return F.regexp_extract(name, r"urn:record:(-?\d+)", 1).try_cast("bigint")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the pages as archives to the shared folder, salvage them, and describe every record.

    One row per row of ``pages`` (page_id, url, html), repeated ones and those with a NULL id included; a NULL html is an
    empty payload. Pages may be of any length. No pages give no rows. Other columns are passed over, whatever their names.
    """
    spark = pages.sparkSession
    path = shared.fresh_path(spark, "warc")
    write_archive(pages, path)
    if pages.isEmpty():
        archives = spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    else:
        archives = read_files(spark, path)
    records = shared.stored(read_archive(archives, keep_payload=False), "warc-records")
    return page_records(records)
