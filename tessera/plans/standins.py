"""Stand-ins: the governed tables that operators expect, made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.base import Tables

PAGES_SQL = """pages_ AS (
  SELECT CAST(doc_id AS VARCHAR) AS component_id, substr(text, 1, 40) AS title,
         'pages/' || source || '/' || doc_id || '.md' AS path, lang AS type, source AS kind, text AS body FROM documents)"""
QUERIES_SQL = """queries_ AS (SELECT item_id AS query_id, text AS query FROM benchmark)"""
POSTS_SQL = (
    PAGES_SQL
    + """,
fields_ AS (
  SELECT component_id, 'title' AS field, 8 AS weight, title AS t FROM pages_
  UNION ALL SELECT component_id, 'path', 5, path FROM pages_
  UNION ALL SELECT component_id, 'type', 3, type FROM pages_
  UNION ALL SELECT component_id, 'body', 1, body FROM pages_),
posts AS (
  SELECT DISTINCT component_id, field, weight, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS term FROM fields_)"""
)
TERMS_SQL = QUERIES_SQL + ", terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM queries_)"
AUDIT_SQL = """audit AS (
  SELECT event_id AS audit_id, CAST(user_id AS VARCHAR) AS session_id, event_type,
         CASE event_type WHEN 'view' THEN 'kb_search' WHEN 'click' THEN 'kb_get_page' ELSE 'kb_query_table' END AS tool_name,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
         CAST(json_extract(props, '$.k') AS VARCHAR) AS component_id, value, ts AS created_at FROM events)"""
COMPONENTS_SQL = """components AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS component_id, 'artifact-' || d.doc_id AS artifact_id, d.source AS package_id,
         CASE WHEN d.doc_id % 5 = 0 THEN 'table_schema_json' WHEN d.doc_id % 7 = 0 THEN 'graph_snapshot' ELSE 'wiki_page' END AS kind,
         CASE WHEN d.lang = 'en' THEN 'pages/activities/' WHEN d.lang = 'de' THEN 'pages/systems/' WHEN d.lang = 'fr' THEN 'pages/concepts/' ELSE 'pages/other/' END || d.doc_id AS path,
         d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, md5(d.text) AS content_hash
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def pages(t: Tables) -> DataFrame:
    """Documents as search pages."""
    return t.documents.select(
        F.col("doc_id").cast("string").alias("component_id"), F.substring("text", 1, 40).alias("title"),
        F.concat(F.lit("pages/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"),
        F.col("lang").alias("type"), F.col("source").alias("kind"), F.col("text").alias("body"),
    )


def page_fields() -> dict:
    return {"title": F.col("title"), "path": F.col("path"), "type": F.col("type"), "body": F.col("body")}


def queries(t: Tables) -> DataFrame:
    """Benchmark items as queries."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def audit(t: Tables) -> DataFrame:
    """Events as an audit log of tool calls."""
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("audit_id"), F.col("user_id").cast("string").alias("session_id"), "event_type",
        F.when(kind == "view", "kb_search").when(kind == "click", "kb_get_page").otherwise("kb_query_table").alias("tool_name"),
        F.when(kind == "error", "error").otherwise("ok").alias("status"),
        F.get_json_object("props", "$.k").alias("component_id"), "value", F.col("ts").cast("timestamp").alias("created_at"),
    )


def components(t: Tables) -> DataFrame:
    """Documents and labels as governed components."""
    d = t.documents.join(t.labels, "doc_id", "left")
    kind = F.when(F.col("doc_id") % 5 == 0, "table_schema_json").when(F.col("doc_id") % 7 == 0, "graph_snapshot").otherwise("wiki_page")
    place = F.when(F.col("lang") == "en", "pages/activities/").when(F.col("lang") == "de", "pages/systems/").when(F.col("lang") == "fr", "pages/concepts/").otherwise("pages/other/")
    return d.select(
        F.col("doc_id").cast("string").alias("component_id"), F.concat(F.lit("artifact-"), "doc_id").alias("artifact_id"), F.col("source").alias("package_id"),
        kind.alias("kind"), F.concat(place, "doc_id").alias("path"), "doc_id", "lang", "source", "n_chars", "quality", "toxic", F.md5("text").alias("content_hash"),
    )
