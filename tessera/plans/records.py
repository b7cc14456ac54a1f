"""Queries of text and time functions, answer values, file sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import evaluation as E
from tessera.plans.base import query
from tessera.sources import files, sinks
from tessera.sources.scratch import shared_path


@query("fn4_normalize_path", r"SELECT doc_id, 'pages/' || lower(source) || ' x/' || doc_id || '.md' AS path FROM documents")
def fn4(t):
    return t.documents.select("doc_id", X.normalize_path(F.concat(F.lit(" Pages\\"), "source", F.lit("  \t X\\"), "doc_id", F.lit(".MD "))).alias("path"))


@query("fn6_fnv1a", """SELECT doc_id, lower(lpad(to_hex(list_reduce(list_prepend(2166136261, list_transform(string_split(lang || ':' || doc_id, ''), lambda c: CAST(ascii(c) AS BIGINT))),
lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0')) AS hash FROM documents""")
def fn6(t):
    return t.documents.select("doc_id", X.fnv1a(F.concat_ws(":", "lang", "doc_id")).alias("hash"))


@query("fn12_loose_json", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events")
def fn12(t):
    case = F.col("event_id") % 4
    answer = F.when(case == 0, F.concat(F.lit(" "), "props", F.lit("\n"))).when(case == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\n"))).when(case == 2, F.concat(F.lit("I think "), "props", F.lit(" fits"))).otherwise("no {json")
    return t.events.select("event_id", F.get_json_object(X.loose_json(answer), "$.k").cast("int").alias("k"))


@query("fn18_time_forms", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, strftime(ts, '%Y%m%d%H%M%S') AS compact,
strftime(ts + INTERVAL 8 HOURS, '%Y.%m.%d') AS day, strftime(date_trunc('day', ts + INTERVAL 8 HOURS) - INTERVAL 8 HOURS, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS day_start FROM events""")
def fn18(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", X.iso_time(ts).alias("iso"), X.compact_time(ts).alias("compact"), X.local_day(ts).alias("day"), X.iso_time(X.local_day_start(ts)).alias("day_start"))


@query("fn19_stale_audit", """WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id, CASE event_id % 3 WHEN 0 THEN now - ts > INTERVAL 7 DAYS ELSE true END AS stale FROM events, n""")
def fn19(t):
    ts = F.col("ts").cast("timestamp")
    now = t.events.agg(F.max(ts).alias("now"))
    at = F.when(F.col("event_id") % 3 == 0, ts.cast("string")).when(F.col("event_id") % 3 == 1, "soon")
    # one row
    return t.events.crossJoin(F.broadcast(now)).select("event_id", X.is_stale(at, F.col("now"), 7).alias("stale"))


@query("fn20_answer_values", """SELECT conv_id, turn, [CAST(turn AS DOUBLE), 8e0, -10e0, 8e0, 10e0] AS numbers, CASE WHEN turn % 3 = 0 THEN ['EM009'] ELSE ['EM009', 'M04' || turn % 3] END AS unknown FROM conversations""")
def fn20(t):
    text = F.concat(F.lit("level "), "turn", F.lit(" costs 8-10, see MARK and XM001, EMX"))
    named = F.concat(F.lit("EM001 EM009 M039 EM009 "), F.when(F.col("turn") % 3 == 0, "M001").otherwise(F.concat(F.lit("M04"), F.col("turn") % 3)))
    return t.conversations.select("conv_id", "turn", F.filter(E.answer_numbers(F.regexp_replace(text, "XM001", "")), lambda x: x.isNotNull()).alias("numbers"), E.unknown_ids(named, {"M": (1, 40), "EM": (1, 8)}).alias("unknown"))


LINES = "replace(coalesce(text, ''), ' ', chr(10))"


@query("src7_text_preview", f"""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 <> 0 THEN array_to_string(string_split({LINES}, chr(10))[1:60], chr(10)) END AS preview,
doc_id % 7 <> 0 AND len(string_split({LINES}, chr(10))) > 60 AS truncated, CASE WHEN doc_id % 7 = 0 THEN 'binary' END AS notice FROM documents""")
def src7(t):
    text = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("\n")), F.when(F.col("doc_id") % 7 == 0, "\0").otherwise(""))
    return files.text_preview(t.documents.select(F.col("doc_id").cast("string").alias("path"), text.alias("text")))


@query("src14_csv_problems", """SELECT n_nationkey + 1 AS row_idx, 'column_count' AS problem, 2 AS columns, 3 AS expected FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 0, 'byte_order_mark', NULL, NULL""")
def src14(t):
    path = shared_path(t.spark, "csv")
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(',"a, ""b"""'), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(",z"))
    head = t.spark.range(1).select(F.lit(-1).alias("n_nationkey"), F.lit("﻿key,name,note").alias("value"))
    # the 25 nations are one file
    head.union(t.nation.select("n_nationkey", line)).coalesce(1).sortWithinPartitions("n_nationkey").select("value").write.text(path)
    return files.csv_problems(t.spark, path, "*.txt").select("row_idx", "problem", "columns", "expected")


@query("src4_first_sheet", """SELECT 'b' || s_nationkey AS path, s_suppkey AS row_idx, s_name AS value FROM supplier WHERE s_suppkey % 3 = (SELECT min(x.s_suppkey % 3) FROM supplier x WHERE x.s_nationkey = supplier.s_nationkey)""")
def src4(t):
    cells = t.supplier.select(F.concat(F.lit("b"), "s_nationkey").alias("path"), (F.col("s_suppkey") % 3).alias("sheet_idx"), F.col("s_suppkey").alias("row_idx"), F.col("s_name").alias("value"))
    return files.first_sheet(cells).select("path", "row_idx", "value")


@query("snk1_blobs", "SELECT substr(sha256(lang || source), 1, 2) AS shard, count(DISTINCT sha256(lang || source)) AS n FROM documents GROUP BY ALL")
def snk1(t):
    path = shared_path(t.spark, "blobs")
    blobs = t.documents.select(F.encode(F.concat("lang", "source"), "utf-8").alias("content"))
    sinks.write_blobs(blobs, path)
    sinks.write_blobs(blobs, path)
    return t.spark.read.parquet(path).groupBy(F.substring("hash", 1, 2).alias("shard")).agg(F.count("*").alias("n"))


@query("snk7_daily_log", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def snk7(t):
    path = shared_path(t.spark, "log")
    sinks.write_log(t.events.select(F.col("ts").cast("timestamp").alias("created_at"), "event_type"), path)
    return t.spark.read.schema("created_at string, event_type string, day string").json(path).groupBy("day").agg(F.count("*").alias("n"))


@query("snk9_manifest_hash", """SELECT sha256('{"documents":' || count(*) || ',"release":"r1"}') AS hash FROM documents""")
def snk9(t):
    return t.spark.createDataFrame([(sinks.manifest_hash({"release": "r1", "documents": t.documents.count()}),)], "hash string")
