"""Queries of page, source, sink, evaluation and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import documents as D
from tessera.operators import evaluation as E
from tessera.plans import standins as S
from tessera.plans.base import query
from tessera.sources import sinks
from tessera.streaming import feedback as ST

#: Documents as markdown pages with two citations and a dependency.
PAGES = """md AS (SELECT CAST(doc_id AS VARCHAR) AS component_id, doc_id, lang, source, n_chars, text AS words FROM documents)"""


def _pages(t):
    words = F.col("text")
    parts = [
        F.concat(F.lit("---\ntitle: Doc "), "doc_id", F.lit("\ntype: "), "lang", F.lit("\n---\n# Overview\n")), words,
        F.concat(F.lit("\n## Data Dependencies\n- "), "source", F.lit("\n- 无\n## Notes\nSee [home](pages/"), "doc_id", F.lit(".md) and [[Other]]\n# Citations\n1. First quote (ev-"), "doc_id", F.lit("; source s1; confidence 0.9)\n2. Second quote")),
    ]
    return t.documents.select(F.col("doc_id").cast("string").alias("component_id"), "source", words.alias("words"), D.frontmatter(F.concat(*parts)).alias("p")).select("component_id", "source", "words", "p.*")


@query("doc1_frontmatter", f"WITH {PAGES} SELECT component_id, 'Doc ' || doc_id AS title, lang AS type, false AS unclosed FROM md")
def doc1(t):
    return _pages(t).select("component_id", X.yaml_scalar(F.col("front"), "title").alias("title"), X.yaml_scalar(F.col("front"), "type").alias("type"), "unclosed")


@query("doc3_sections", f"""WITH {PAGES} SELECT component_id, s AS section, CAST([1, 2, 2, 1][s] AS INT) AS level, ['Overview', 'Data Dependencies', 'Notes', 'Citations'][s] AS heading FROM md, (SELECT unnest(range(1, 5)) AS s)""")
def doc3(t):
    return D.sections(_pages(t)).select("component_id", "section", "level", "heading")


@query("doc4_section_text", f"WITH {PAGES} SELECT component_id, md5(trim(trim(words, chr(10) || chr(13) || chr(9) || ' ') || chr(10) || '## Data Dependencies' || chr(10) || '- ' || source || chr(10) || '- 无' || chr(10) || '## Notes' || chr(10) || 'See [home](pages/' || doc_id || '.md) and [[Other]]')) AS text FROM md")
def doc4(t):
    return D.section_text(D.sections(_pages(t)), "overview").select("component_id", F.md5("text").alias("text"))


@query("doc5_strip_utility", f"WITH {PAGES} SELECT component_id, false AS has_citations FROM md")
def doc5(t):
    return _pages(t).select("component_id", F.contains(D.strip_utility(F.col("body")), F.lit("First quote")).alias("has_citations"))


@query("doc6_citations", f"""WITH {PAGES} SELECT component_id, 1 AS n, 'First quote' AS quote, 'ev-' || doc_id AS evidence_id, 's1' AS source, 0.9 AS confidence FROM md
UNION ALL SELECT component_id, 2, 'Second quote', 'okf:' || component_id || ':2', '', NULL FROM md""")
def doc6(t):
    return D.citations(D.sections(_pages(t)))


@query("doc7_dependency_hints", f"WITH {PAGES} SELECT component_id, source AS hint FROM md")
def doc7(t):
    return D.dependency_hints(D.sections(_pages(t)))


@query("doc8_dependency_resolution", f"WITH {PAGES} SELECT component_id, source AS hint, source AS \"table\", 1 AS step FROM md WHERE source <> 'src1' UNION ALL SELECT component_id, source, 'Table/One', 2 FROM md WHERE source = 'src1'")
def doc8(t):
    tables = t.documents.select(F.col("source").alias("table")).distinct().where("table <> 'src1'")
    aliases = t.spark.createDataFrame([("Table/One", "SRC 1")], "table string, alias string")
    return D.resolve_hints(D.dependency_hints(D.sections(_pages(t))), tables, aliases).where("step < 3")


@query("doc11_links", f"WITH {PAGES} SELECT component_id, unnest(['pages/' || doc_id || '.md', 'Other']) AS link FROM md")
def doc11(t):
    return _pages(t).select("component_id", F.explode(D.links(F.col("body"))).alias("link"))


@query("doc12_description", f"WITH {PAGES} SELECT component_id, substr(list_filter(string_split(words, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*(#|\\||[-*+]\\s|---|>)'))[1], 1, 60) AS description FROM md WHERE trim(words, chr(10) || ' ') <> ''")
def doc12(t):
    return _pages(t).where(F.trim("words", F.lit("\n ")) != "").select("component_id", D.description(F.col("body")).alias("description"))


@query("doc14_overrides", "SELECT CAST(doc_id AS VARCHAR) AS component_id, CASE WHEN lang = 'fr' THEN 'Edited' ELSE substr(text, 1, 40) END AS title, lang AS type FROM documents")
def doc14(t):
    p = S.pages(t).select("component_id", "title", "type", "body")
    none = F.lit(None).cast("string")
    edits = t.documents.where("lang = 'fr'").select(F.col("doc_id").cast("string").alias("component_id"), F.lit("Edited").alias("title"), none.alias("type"), none.alias("body"))
    return D.override(p, edits).select("component_id", "title", "type")


@query("doc19_rewrite_validation", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'unknown_citation' ELSE 'unknown_number' END AS problems FROM documents""")
def doc19(t):
    text = F.when(F.col("doc_id") % 3 == 0, "fine [ev-1]").when(F.col("doc_id") % 3 == 1, "bad [ev-9]").otherwise("has 77")
    return t.documents.select("doc_id", F.array_join(D.rewrite_problems(text, F.array(F.lit("ev-1")), F.lit("numbers 1 and 9")), ",").alias("problems"))


@query("doc21_slugs", "WITH s AS (SELECT doc_id, trim(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS r FROM s) SELECT doc_id, CASE WHEN r = 1 THEN slug ELSE slug || '-' || r END AS slug FROM n")
def doc21(t):
    from tessera.operators.relational import dedup_suffix

    return dedup_suffix(t.documents.select("doc_id", X.page_slug(F.concat_ws(" ", "source", "lang")).alias("slug")), "slug", ["doc_id"])


@query("doc24_type_from_path", f"WITH {S.COMPONENTS_SQL} SELECT component_id, CASE WHEN contains(path, 'activities/') THEN 'activity_template' WHEN contains(path, 'systems/') THEN 'system_rule' WHEN contains(path, 'concepts/') THEN 'concept' ELSE 'wiki_page' END AS type FROM components")
def doc24(t):
    return S.components(t).select("component_id", D.okf_type(F.col("path")).alias("type"))


@query("qua1_spec_score", "SELECT source, floor((0.45 * len(list_filter(['en', 'de'], lambda x: list_contains(list(DISTINCT lang), x))) / 2 + 0.35 + 0.2) * 1000 + 0.5) / 1000 AS score FROM documents GROUP BY ALL")
def qua1(t):
    have = t.documents.groupBy("source").agg(F.collect_set("lang").alias("have"))
    none = F.array().cast("array<string>")
    score = D.spec_score(F.col("have"), F.array(F.lit("en"), F.lit("de")), none, none, F.lit("x"))
    return have.select("source", (F.floor(score * 1000 + 0.5) / 1000).alias("score"))


@query("snk3_page_render", "SELECT doc_id, md5('---' || chr(10) || 'title: T' || doc_id || chr(10) || 'type: ' || lang || chr(10) || 'component_id: ' || doc_id || chr(10) || '---' || chr(10) || text || chr(10) || '# Trust' || chr(10) || 'score: 0.5' || chr(10) || '# Citations' || chr(10) || '1. ' || source || chr(10) || '2. end') AS page FROM documents")
def snk3(t):
    page = D.render_page(F.concat(F.lit("T"), "doc_id"), F.col("lang"), F.col("doc_id").cast("string"), F.col("text"), F.lit(0.5), F.array(F.col("source"), F.lit("end")))
    return t.documents.select("doc_id", F.md5(page).alias("page"))


@query("snk4_directory_index", "SELECT source, doc_id // 1000 AS part, count(*) AS pages, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS listing FROM documents GROUP BY ALL")
def snk4(t):
    # a directory is listed in parts of a thousand numbers, so none is collected whole
    ids = F.array_sort(F.collect_list("doc_id"))
    part = F.floor(F.col("doc_id") / 1000).alias("part")
    return t.documents.groupBy("source", part).agg(F.count("*").alias("pages"), F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")).alias("listing"))


@query("snk8_bundle_hash", "SELECT sha256(string_agg(n_name || chr(0) || md5(n_name) || chr(0), '' ORDER BY n_name)) AS bundle_hash FROM nation")
def snk8(t):
    return sinks.bundle_hash(t.nation.select(F.col("n_name").alias("path"), F.md5("n_name").alias("hash")))


SHARDED = """SELECT {dir} AS dir, sha256(string_agg(name || chr(0) || h || chr(0), '' ORDER BY name)) AS h FROM (
  SELECT dir, substr(sha256(name), 1, 2) AS name, sha256(string_agg(name || chr(0) || h || chr(0), '' ORDER BY name)) AS h FROM {of} GROUP BY dir, substr(sha256(name), 1, 2)) GROUP BY dir"""


@query("snk8_tree_hash", f"""WITH f AS (SELECT 'pages/' || source AS dir, doc_id || '.md' AS name, sha256(text) AS h FROM documents),
d2 AS ({SHARDED.format(dir="dir", of="f")}),
e1 AS (SELECT 'pages' AS dir, split_part(dir, '/', 2) AS name, h FROM d2),
d1 AS ({SHARDED.format(dir="dir", of="e1")}),
e0 AS (SELECT '' AS dir, 'pages' AS name, h FROM d1),
d0 AS ({SHARDED.format(dir="dir", of="e0")})
SELECT dir AS path, h AS hash FROM d2 UNION ALL SELECT dir, h FROM d1 UNION ALL SELECT dir, h FROM d0""")
def snk8_tree(t):
    """All pages of a release as a tree of folders."""
    return sinks.tree_hash(t.documents.select(F.concat(F.lit("pages/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.sha2("text", 256).alias("hash")))


@query("snk13_classify", "SELECT doc_id, CASE lang WHEN 'en' THEN 'markdown' WHEN 'de' THEN 'table' WHEN 'fr' THEN 'document' ELSE 'other' END AS kind FROM documents")
def snk13(t):
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".xlsx").when(F.col("lang") == "fr", ".docx").otherwise(".bin")
    return t.documents.select("doc_id", X.file_type(F.concat(F.lit("a/b"), ext)).alias("kind"))


@query("fn5_slug", "SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def fn5(t):
    return t.part.select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@query("fn7_cluster_query", "SELECT c_custkey, lower(c_mktsegment) || ' x' AS q FROM customer")
def fn7(t):
    return t.customer.select("c_custkey", X.cluster_query(F.concat(F.lit("kb_search:"), "c_mktsegment", F.lit("   x"))).alias("q"))


@query("fn9_gap_key", "SELECT doc_id, coalesce(nullif(substr(regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g'), 1, 400), ''), 'empty') AS k FROM documents")
def fn9(t):
    return t.documents.select("doc_id", X.gap_query_key(F.col("text")).alias("k"))


@query("fn10_digests", "SELECT doc_id, sha256(text) AS s256, sha1(text) AS s1, md5(text) AS m FROM documents")
def fn10(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("s256"), F.sha1("text").alias("s1"), F.md5("text").alias("m"))


@query("fn14_alias_keys", "SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[\\s_\\-()\\[\\]:,./]+', '', 'g') AS q, regexp_replace(lower(trim(p_name)), '[\\s_/\\-]+', '', 'g') AS b FROM part")
def fn14(t):
    return t.part.select("p_partkey", X.alias_key_query(F.col("p_name")).alias("q"), X.alias_key_build(F.col("p_name")).alias("b"))


@query("fn18_local_dates", "SELECT event_id, strftime(ts + INTERVAL 8 HOURS, '%Y.%m.%d') AS day FROM events")
def fn18(t):
    return t.events.select("event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai"), "yyyy.MM.dd").alias("day"))


@query("eva1_answer_scores", "SELECT conv_id || '-' || turn AS case_id, (CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'tion') THEN 1 ELSE 0 END) / 2 AS score, CASE WHEN contains(text, 'the') AND contains(text, 'tion') THEN 'pass' WHEN contains(text, 'the') OR contains(text, 'tion') THEN 'partial' ELSE 'fail' END AS status FROM conversations")
def eva1(t):
    return E.score_answers(t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("case_id"), F.col("text").alias("answer"), F.array(F.lit("the"), F.lit("tion")).alias("key_facts")))


@query("str2_outbox_drain", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def str2(t):
    return ST.drain(ST.read_events(t.spark, t.sf_dir).select("event_id", "event_type"), "outbox").groupBy("event_type").agg(F.count("*").alias("n"))


@query("str4_streaming_escalation", """WITH f AS (SELECT event_id, ts, user_id || ':' || event_type AS q, CASE WHEN event_type = 'view' THEN 'miss' ELSE 'tool_error' END AS kind FROM events WHERE event_type IN ('view', 'error')),
n AS (SELECT *, row_number() OVER (PARTITION BY q, kind ORDER BY ts, event_id) AS r FROM f)
SELECT CASE WHEN kind = 'miss' AND r >= 3 THEN 'repeated_query' ELSE kind END AS stored_type, CASE WHEN r >= 3 THEN 'blocking' ELSE 'warning' END AS severity, count(*) AS n FROM n GROUP BY ALL""")
def str4s(t):
    e = ST.read_events(t.spark, t.sf_dir).where("event_type IN ('view', 'error')")
    rows = e.select("event_id", "ts", F.concat_ws(":", "user_id", "event_type").alias("query"), F.when(F.col("event_type") == "view", "miss").otherwise("tool_error").alias("feedback_type"))
    return ST.drain(ST.escalate(rows), "escalate").groupBy("stored_type", "severity").agg(F.count("*").alias("n"))


@query("win9_rate_limit", """WITH RECURSIVE calls AS (SELECT user_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS DOUBLE[]) AS times, CAST(NULL AS BOOLEAN) AS allowed FROM calls
  UNION ALL
  SELECT user_id, rn, CASE WHEN len(f) < 3 THEN list_append(f, s) ELSE f END, len(f) < 3 FROM (
    SELECT c.user_id, c.rn, c.s, list_filter(w.times, lambda x: c.s - x < 36000) AS f FROM walk w JOIN calls c ON c.user_id = w.user_id AND c.rn = w.rn + 1))
SELECT allowed, count(*) AS n FROM walk WHERE rn > 0 GROUP BY allowed""")
def win9(t):
    calls = ST.read_events(t.spark, t.sf_dir).select("event_id", "ts", "user_id")
    return ST.drain(ST.rate_limit(calls, most=3, seconds=36000), "rate").groupBy("allowed").agg(F.count("*").alias("n"))


@query("ext_tumbling_windows", """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, sum(value) AS total FROM events
WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def ext_tumbling(t):
    return ST.drain(ST.tumbling(ST.read_events(t.spark, t.sf_dir), "1 day", "1 hour"), "tumbling")
