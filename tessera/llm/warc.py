"""WARC archives: a writer that stores equal payloads once and a reader that salvages.

The writer turns pages into WARC/1.1 records, response or revisit, and writes them through
Spark's text writer, so any file system that Spark writes to holds archives. Each record is a
gzip member of its own; the writer's line separator is an empty member, or in plain archives the
blank line that ends a record. The reader checks each record (version line,
headers, length, closing blank line, payload digest). After a failed check it searches for the
next gzip member or version line, goes on from there, and logs the bytes between as a gap.

Defined results: a null html is an empty payload, a null url an empty one; rows that share the
smallest page_id of a payload are all responses; a null page_id counts as smallest; extra
columns play no part; an empty table gives no files and no records. A payload of any length that a
string holds is one record; a file longer than ``file_bytes`` holds one such record last.
"""

from __future__ import annotations

import gzip
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, keep, real_id, scratch_path, with_ids

LOG = logging.getLogger(__name__)
END = "\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
#: A gzip member without content.
NOTHING = gzip.compress(b"", mtime=0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, archive string, start long, end long, gap boolean, reason string"


def with_records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = with_ids(pages, F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"), key="page_id")
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    large = F.col("payload_bytes") >= min_bytes
    firsts = rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    joined = rows.join(firsts.drop("copies"), "payload_digest", "left")
    again = large & (F.col("page_id") > F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _archives(zipped: bool, file_bytes: int):
    """The records of a task joined to the contents of files: ``file_bytes`` or a record more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        rows = (r.as_buffer().to_pybytes() for batch in batches for r in batch["value"])
        for row in rows:
            held.append(gzip.compress(row + END.encode(), 6, mtime=0) if zipped else row)
            size += len(held[-1])
            if size >= file_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([(b"" if zipped else END.encode()).join(held)], pa.binary())], names=["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([(b"" if zipped else END.encode()).join(held)], pa.binary())], names=["value"])

    return run


def write_warc(records: DataFrame, path: str, file_bytes: int = 32 << 20, compression: str = "gzip") -> None:
    """Write the rows of :func:`with_records` as archives that end with the record that takes them to
    ``file_bytes``. Each record is one gzip member, or plain with ``compression="none"``."""
    crlf = F.lit("\r\n")
    # nothing in a header may end its line
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string") if not isinstance(value, str) else F.lit(value), crlf)
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    revisit = F.col("record_type") == "revisit"
    length = F.when(revisit, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Date", DATE),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes")),
        F.when(revisit, F.concat(line("WARC-Profile", PROFILE), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", length),
        crlf,
    )
    block = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    rows = records.select(F.concat(head.cast("binary"), http.cast("binary"), block).alias("value"))
    rows = rows.mapInArrow(_archives(compression == "gzip", file_bytes), "value binary")
    separator = NOTHING.decode("latin-1") if compression == "gzip" else END
    # a row holds a whole file by now
    writer = rows.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none")
    writer.option("encoding", "ISO-8859-1").option("lineSep", separator).text(path)  # the encoding is the separator's alone


def _headers(data: bytes) -> dict[str, str]:
    rows = (x.partition(":") for x in data.decode("utf-8", "replace").split("\r\n") if ":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in rows}


def _record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at ``at``, where it ends, and what is wrong with it."""
    version = VERSION_LINE.match(data, at)
    if not version:
        return None, at, "no version line"
    head = data.find(b"\r\n\r\n", version.end())
    if head < 0:
        return None, at, "headers don't end"
    fields = _headers(data[version.end() : head])
    if not fields.get("content-length", "").isdigit():
        return None, at, "no content length"
    stop = head + 4 + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, at, "wrong length"
    block = data[head + 4 : stop]
    split = block.find(b"\r\n\r\n")
    http = fields.get("content-type", "").startswith("application/http")
    payload = block[split + 4 :] if http and split >= 0 else block
    digest, size = fields.get("warc-payload-digest", "").removeprefix("sha256:"), fields.get("warc-payload-length", "")
    if fields.get("warc-type") != "revisit":
        own = hashlib.sha256(payload).hexdigest()
        if digest and own != digest:
            return None, at, "wrong digest"
        digest, size = own, str(len(payload))
    # a revisit's payload is elsewhere: its headers tell digest and length
    return fields | {"payload": payload, "digest": digest, "size": int(size) if size.isdigit() else None}, stop + 4, ""


def salvage_plain(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(start, end, record, reason) in order; record is None for a quarantined gap."""
    at, bad, why = 0, None, ""
    while at < len(data):
        record, end, reason = _record(data, at)
        if record is not None:
            if bad is not None:
                yield bad, at, None, why
                bad = None
            yield at, end, record, ""
            at = end
        else:
            bad, why = (at, reason) if bad is None else (bad, why)
            following = VERSION_LINE.search(data, at + 1)
            at = following.start() if following else len(data)
    if bad is not None:
        yield bad, len(data), None, why


def _before_error(data: bytes, start: int, part: int) -> bytes:
    """What the 64 KB from ``part`` on of the member at ``start`` give before they can't be inflated."""
    unzip, out = zlib.decompressobj(31), []
    for at in range(start, part, 65536):
        unzip.decompress(data[at : min(at + 65536, part)])
    try:
        for at in range(part, min(part + 65536, len(data))):
            out.append(unzip.decompress(data[at : at + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _is_gzip(data: bytes, path: str) -> bool:
    """By name or by what comes first in the file, so that a damaged start does not hide the members."""
    member, version = data.find(MEMBER), VERSION_LINE.search(data)
    return path.endswith(".gz") or data[:2] == MEMBER[:2] or member >= 0 and not (version and version.start() < member)


def salvage_gzip(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """As :func:`salvage_plain` for gzip archives; places are those of members in the file."""
    at, bad, why = 0, None, ""
    while at < len(data):
        unzip, parts, end, reason = zlib.decompressobj(31), [], at, ""
        try:
            while not unzip.eof and end < len(data):
                parts.append(unzip.decompress(data[end : end + 65536]))
                end = min(end + 65536, len(data))
            reason = "" if unzip.eof else "member doesn't end"
        except zlib.error as e:
            reason = f"member: {e}"
            parts.append(_before_error(data, at, end))
        if reason:
            text = b"".join(parts)
            stop = max((e for _, e, r, _ in salvage_plain(text) if r is not None), default=0)
            for _, _, record, wrong in salvage_plain(text[:stop]):  # whole records before the damage
                if bad is not None:
                    yield bad, at, None, why
                    bad = None
                yield at, at, record, wrong
            bad, why = (at, reason) if bad is None else (bad, why)
            following = data.find(MEMBER, at + 1)
            at = following if following >= 0 else len(data)
            continue
        if bad is not None:
            yield bad, at, None, why
            bad = None
        end -= len(unzip.unused_data)
        for _, _, record, wrong in salvage_plain(b"".join(parts)):
            yield at, end, record, wrong
        at = end
    if bad is not None:
        yield bad, len(data), None, why


def _id(text: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=names)

    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            data, rows = content.as_buffer().to_pybytes(), []
            salvage = salvage_gzip if _is_gzip(data, path) else salvage_plain
            for start, end, r, reason in salvage(data):
                if r is None:
                    rows.append((None, None, None, None, None, None, None, path, start, end, True, reason))
                else:
                    rows.append((_id(r.get("warc-record-id")), r["size"], r["digest"], r.get("warc-type"), _id(r.get("warc-refers-to")), r.get("warc-target-uri"), r["payload"], path, start, end, False, None))
                if len(rows) >= 2000:
                    yield table(rows)
                    rows = []
            yield table(rows)


def read_warc(spark, path: str) -> DataFrame:
    """Records and gaps of all archives under ``path``; gap rows carry archive, start, end, reason."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_parse, RECORD)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(with_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    found = keep(read_warc(spark, path).drop("payload", "url"), "warc-records")
    for row in found.where("gap").groupBy("reason").agg(F.count("*").alias("gaps"), F.sum(F.col("end") - F.col("start")).alias("size")).limit(100).collect():
        LOG.warning("%d gaps, %d bytes quarantined: %s", row["gaps"], row["size"], row["reason"])
    records = found.where("NOT gap")
    refers = F.when(F.col("refers_to") != NULL_ID, F.col("refers_to")).alias("refers_to")
    return records.select(real_id("page_id"), "payload_bytes", "payload_digest", "record_type", refers)


ORACLE_SQL = """
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM rows)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM firsts
"""
