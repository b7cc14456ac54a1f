"""Line dedup: hashes of lines are range-partitioned and sorted by document, streamed, and
turned into one compressed keep bitmap per document.

Defined results: a null or empty text is one empty line. Rows of one doc_id are one document,
a null doc_id is a document smaller than all others; equal rows get equal bitmaps. Columns
other than doc_id and text play no part. Texts of any length are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, real_id, with_ids

STRIP = b" \t\n\x0b\x0c\r"
KEYS = "k1 long, k2 long, doc_id long, text_hash long, n_lines int, lines binary"


def line_key(line: bytes) -> bytes:
    """Stripped at both ends, A-Z in lower case."""
    return line.strip(STRIP).lower()


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"k": [], "doc_id": [], "text_hash": [], "n_lines": [], "lines": []}
            for doc, seen, text in zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), batch["text"], strict=True):
                lines = text.as_buffer().to_pybytes().split(b"\n") if text.is_valid else [b""]
                found: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars and (key.isascii() or _code_points(key) >= min_chars):
                        found.setdefault(key, []).append(i)
                rows["k"] += [xxhash.xxh3_128_digest(k) for k in found]
                rows["lines"] += [np.array(x, "<i4").tobytes() for x in found.values()]
                for name, value in (("doc_id", doc), ("text_hash", seen), ("n_lines", len(lines))):
                    rows[name] += [value] * len(found)
            k = np.frombuffer(b"".join(rows["k"]), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(rows["doc_id"], pa.int64()), pa.array(rows["text_hash"], pa.int64()), pa.array(rows["n_lines"], pa.int32()), pa.array(rows["lines"], pa.binary())],
                names=["k1", "k2", "doc_id", "text_hash", "n_lines", "lines"],
            )

    return run


DROP, OPEN, STATS = 0, 1, 2
KINDS = {"kind": pa.int32(), "k1": pa.int64(), "k2": pa.int64(), "doc_id": pa.int64(), "text_hash": pa.int64(), "n_lines": pa.int32(), "lines": pa.binary(), "docs": pa.int64()}


def _stream(min_docs: int):
    """Rows come sorted by hash and falling doc_id; all rows of a hash and document share a
    partition. The first document of a hash keeps its lines, the others' are dropped once
    ``min_docs`` documents are seen; until then at most ``min_docs`` documents are held back.
    The first hash of a partition may have begun before it and the last may go on after it:
    rows that this leaves undecided are passed on as open, with counts of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = key = top = last = None
        docs, held = 0, []

        def close(final: bool) -> list[tuple]:
            if key is None:
                return []
            stats = [(STATS, *key, top, 0, 0, b"", docs)] if key == first or final else []
            return stats + [(OPEN, *row, 0) for row in held] if stats else []

        for batch in batches:
            rows = []
            for row in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "doc_id", "text_hash", "n_lines", "lines")), strict=True):
                if row[:2] != key:
                    rows += close(False)
                    key, top, last, docs, held = row[:2], row[2], row[2], 1, []
                    first = first or key
                elif row[2] != last:
                    docs, last = docs + 1, row[2]
                if key == first:
                    rows.append((OPEN, *row, 0))
                elif docs >= min_docs:
                    rows += [(DROP, *r, 0) for r in held if r[2] != top]
                    rows.append((DROP, *row, 0))
                    held = []
                else:
                    held.append(row)
            yield _table(rows)
        yield _table(close(True))

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS.values(), strict=True)], names=list(KINDS))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, dropped, maps = batch["n_lines"].to_pylist(), [], []
        for n, lines in zip(n_lines, batch["lines"].to_pylist(), strict=True):
            bits = np.ones(n, bool)
            bits[np.frombuffer(b"".join(lines), "<i4")] = False
            dropped.append(int(n - bits.sum()))
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], batch["n_lines"], pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "bitmap"])


def _identified(docs: DataFrame) -> DataFrame:
    return with_ids(docs, F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, bitmap) of each document that loses lines. A
    key is a line stripped and lower-cased; keys of ``min_chars`` code points or more that
    ``min_docs`` documents hold stay in the largest doc_id that holds them. bitmap: zlib over
    one bit a line, set where the line stays."""
    keys = keep(_identified(docs).mapInArrow(_keys(min_chars), KEYS), "line-keys")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("k1"), F.col("k2"), F.col("doc_id").desc()]
    schema = "kind int, k1 long, k2 long, doc_id long, text_hash long, n_lines int, lines binary, docs long"
    streamed = keep(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), schema), "line-stream")
    # two hashes of each range partition at most: small enough to broadcast whatever the input
    stats = streamed.where(f"kind = {STATS}").groupBy("k1", "k2").agg(F.max("doc_id").alias("top"), F.sum("docs").alias("all_docs"))
    columns = ["doc_id", "text_hash", "n_lines", "lines"]
    opened = streamed.where(f"kind = {OPEN}").join(F.broadcast(stats), ["k1", "k2"]).where((F.col("all_docs") >= min_docs) & (F.col("doc_id") < F.col("top")))
    drops = streamed.where(f"kind = {DROP}").select(*columns).union(opened.select(*columns))
    grouped = drops.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("lines").alias("lines"))
    return grouped.mapInArrow(_bitmaps, "doc_id long, text_hash long, n_lines int, n_dropped int, bitmap binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, dropped, kept = [], [], []
        for text, bitmap in zip(batch["text"], batch["bitmap"].to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            n = data.count(b"\n") + 1
            if bitmap is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n)
                data = b"\n".join(line for line, bit in zip(data.split(b"\n"), bits.tolist(), strict=True) if bit)
            counts.append(n)
            dropped.append(int(n - bits.sum()) if bitmap is not None else 0)
            kept.append(data.decode("utf-8", "replace"))
        index = [i for i, name in enumerate(batch.schema.names) if name not in ("text", "bitmap")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in index), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
            names=[*(batch.schema.names[i] for i in index), "text", "n_lines", "n_dropped"],
        )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keep_columns: tuple[str, ...] = (), counts: bool = True) -> DataFrame:
    """Each row of ``docs``: doc_id, ``keep_columns``, its text without the dropped lines, and
    the long columns n_lines (before) and n_dropped, unless ``counts`` is off."""
    named = with_ids(docs, F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep_columns)))
    maps = keep_bitmaps(docs, min_chars, min_docs).select("doc_id", "text_hash", "bitmap")
    joined = named.withColumn("text_hash", F.xxhash64("text")).join(maps, ["doc_id", "text_hash"], "left").drop("text_hash")
    extra = [f for f in joined.schema.fields if f.name.startswith("keep_")]
    schema = ", ".join(["doc_id long", *(f"{f.name} {f.dataType.simpleString()}" for f in extra), "text string, n_lines long, n_dropped long"])
    out = joined.select("doc_id", *(f.name for f in extra), "text", "bitmap").mapInArrow(_apply, schema)
    return out.select(real_id(), *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep_columns)), "text", *(("n_lines", "n_dropped") if counts else ()))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, i, line, c.top IS NOT NULL AND doc_id <> c.top AS dropped
  FROM keyed LEFT JOIN common c USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(dropped::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
