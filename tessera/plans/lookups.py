"""Queries of lookups, conformance, path rules and record operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.rounding import half_up
from tessera.functions.text import normalize_text
from tessera.operators import lookups as L
from tessera.operators import retrieval as R
from tessera.plans import retrieval as P
from tessera.plans import standins as S
from tessera.plans.base import query
from tessera.sources import index as I
from tessera.sources.scratch import shared_path, stored

KEY = "json_extract_string(props, '$.k')"


# functions -------------------------------------------------------------------------------------
@query("fn8_feedback_query_key", f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'kb_search:a ' || {KEY} || ' b' WHEN 1 THEN 'kb_search:t' || {KEY} ELSE 'kb_search:{{"z":' || {KEY} || '}}' END AS key FROM events""")
def fn8(t):
    k = F.get_json_object("props", "$.k")
    payload = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"query":" A '), k, F.lit(' B ","table":"x"}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"table":"T'), k, F.lit('"}'))).otherwise(F.concat(F.lit('{"Z":'), k, F.lit("}")))
    return t.events.select("event_id", L.feedback_query_key(F.lit("kb_search"), payload).alias("key"))


@query("fn15_first_number", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN CAST(p_partkey AS DOUBLE) WHEN 2 THEN CAST(p_size AS DOUBLE) END AS number FROM part")
def fn15(t):
    case = F.col("p_partkey") % 4
    first = F.when(case == 0, F.concat(F.lit(" "), "p_size", F.lit(".5 "))).when(case == 1, "").when(case == 2, "NaN").otherwise("abc")
    second = F.when(case == 1, F.col("p_partkey").cast("string")).when(case == 2, F.col("p_size").cast("string")).otherwise(F.lit(None))
    return t.part.select("p_partkey", L.first_number(first, second).alias("number"))


@query("fn22_source_refs", "SELECT doc_id, doc_id % 4 < 2 AS is_source FROM documents")
def fn22(t):
    root = F.element_at(F.array(F.lit("gamedocs/"), F.lit("gamedata/"), F.lit("docs/gamedata/"), F.lit("gamedata")), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select("doc_id", L.is_source_ref(F.concat(root, "doc_id")).alias("is_source"))


@query("fn24_correction_fingerprint", """SELECT doc_id, '{"a":"' || lang || '","b":"' || doc_id || '"}' AS fingerprint FROM documents""")
def fn24(t):
    pairs = [F.lit("b"), F.col("doc_id").cast("string"), F.lit("confidence"), F.col("n_chars").cast("string"), F.lit("a"), F.col("lang"), F.lit("actor"), F.col("source")]
    return t.documents.select("doc_id", L.correction_fingerprint(F.create_map(*pairs)).alias("fingerprint"))


# paths and sources -------------------------------------------------------------------------------
LISTING = "listing AS (SELECT 'bundle/' || CASE WHEN doc_id % 2 = 0 THEN 'gamedata/' ELSE 'gamedocs/' END || source || '/' || doc_id || ['.xlsx', '.CSV', '.md', '.txt'][doc_id % 4 + 1] AS path, doc_id FROM documents)"


def _listing(t):
    ext = F.element_at(F.array(F.lit(".xlsx"), F.lit(".CSV"), F.lit(".md"), F.lit(".txt")), (F.col("doc_id") % 4 + 1).cast("int"))
    root = F.when(F.col("doc_id") % 2 == 0, "gamedata/").otherwise("gamedocs/")
    return t.documents.select("doc_id", F.concat(F.lit("bundle/"), root, "source", F.lit("/"), "doc_id", ext).alias("path"))


@query("src3_source_root", f"WITH {LISTING} SELECT min(string_split(path, '/')[1]) AS root FROM listing HAVING count(DISTINCT string_split(path, '/')[1]) = 1")
def src3(t):
    return L.source_root(_listing(t))


@query("src13_path_guard", "SELECT doc_id, doc_id % 5 IN (0, 4) AS inside FROM documents")
def src13(t):
    name = F.element_at(F.array(F.lit("a/"), F.lit("/a/"), F.lit("a/../../"), F.lit("C:\\a\\"), F.lit("a/..b/")), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.documents.select("doc_id", L.contained(F.concat(name, "doc_id")).alias("inside"))


@query("src22_table_names", """SELECT CAST(doc_id AS VARCHAR) AS "table" FROM documents WHERE doc_id % 4 = 0""")
def src22(t):
    return L.table_names(_listing(t).select(F.regexp_replace("path", "^bundle/", "").alias("path")))


@query("src11_json_asset", f"SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST({KEY} AS INT) END AS k FROM events")
def src11(t):
    asset = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props"))
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json(asset), "$.k", "int").alias("k"))


@query("src15_csv_dict", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, 'a \"b\", ' || n_regionkey AS note FROM nation")
def src15(t):
    path = shared_path(t.spark, "csv")
    rows = t.nation.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"), F.concat(F.lit('a "b", '), "n_regionkey").alias("note"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return t.spark.read.option("header", True).option("escape", '"').csv(path)


@query("src18_legacy_package", "SELECT 'draft-' || source AS package_id, source || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' ELSE '_schema.json' END AS path, CASE doc_id % 3 WHEN 0 THEN 'wiki_page' ELSE 'table_schema_json' END AS kind FROM documents WHERE doc_id % 3 <> 2")
def src18(t):
    ext = F.element_at(F.array(F.lit(".md"), F.lit("_schema.json"), F.lit(".png")), (F.col("doc_id") % 3 + 1).cast("int"))
    return L.legacy_package(t.documents.select(F.concat("source", F.lit("/"), "doc_id", ext).alias("path")))


@query("srt8_tree_order", f"""WITH {S.PAGES_SQL},
entries AS (SELECT '' AS parent, 'pages' AS name, 'folder' AS kind UNION SELECT 'pages', kind, 'folder' FROM pages_ UNION SELECT 'pages/' || kind, component_id || '.md', 'file' FROM pages_)
SELECT *, CAST(row_number() OVER (PARTITION BY parent ORDER BY kind DESC, name) AS INT) AS place FROM entries""")
def srt8(t):
    return L.tree_entries(S.pages(t).select("path"))


# knowledge behind sources ------------------------------------------------------------------------
def _sourced(t):
    ref = F.concat(F.lit("gamedocs/"), "source", F.lit("/"), "doc_id", F.lit(".docx"))
    return t.documents.select(F.col("doc_id").cast("string").alias("component_id"), F.concat(F.lit("pages/"), "lang", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("Title "), "source").alias("title"), F.array(ref).alias("source_refs"), "doc_id", "source")


@query("flt17_affected_knowledge", "SELECT CAST(doc_id AS VARCHAR) AS component_id FROM documents WHERE source = 'src2' OR (source = 'src1' AND doc_id % 10 = 3) OR contains(lower('pages/' || lang || '/' || doc_id || '.md'), 'es')")
def flt17(t):
    changed = t.documents.where("source = 'src1' AND doc_id % 10 = 3").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".docx")).alias("path"))
    # stems of numbers would be part of longer ones, so the changed files' own numbers are led by a letter
    named = t.spark.createDataFrame([("gamedocs/src2",), ("x/gamedocs/none/Es.txt",)], "path string")
    out = L.affected_knowledge(_sourced(t), named.where("path LIKE '%Es%'").union(named.where("path LIKE '%src2'")))
    exact = L.affected_knowledge(_sourced(t).withColumn("path", F.lit("p")).withColumn("title", F.lit("t")), changed)
    return out.union(exact).distinct()


@query("cor6_correction_debt", "SELECT CAST(doc_id AS VARCHAR) AS component_id, CAST(CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 1 END AS BIGINT) AS pending FROM documents WHERE doc_id % 3 = 0")
def cor6(t):
    d = t.documents
    pages = d.where("doc_id % 3 = 0").select(F.concat(F.lit("page-"), "doc_id").alias("correction_id"), F.concat(F.lit("processed/parsed/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("source_path"))
    files = d.where("doc_id % 6 = 0").select(F.concat(F.lit("file-"), "doc_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".docx")))
    return L.correction_debt(_sourced(t), pages.union(files))


@query("tru9_publish_recompute", "SELECT CAST(doc_id AS VARCHAR) AS component_id, quality * 0.5e0 AS before, (doc_id % 100) / 1e2 AS after, floor(((doc_id % 100) / 1e2 - quality * 0.5e0) * 1000 + 0.5) / 1000 AS delta FROM labels WHERE abs((doc_id % 100) / 1e2 - quality * 0.5e0) >= 0.05")
def tru9(t):
    name = F.col("doc_id").cast("string").alias("component_id")
    before, after = t.labels.select(name, (F.col("quality") * 0.5).alias("trust")), t.labels.select(name, ((F.col("doc_id") % 100) / 100.0).alias("trust"))
    return L.trust_changes(before.where("trust IS NOT NULL"), after)


# tables ----------------------------------------------------------------------------------------
@query("tab6_resolve_table", """SELECT p_partkey AS request_id, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_name END AS "table" FROM part WHERE p_partkey % 4 <> 3""")
def tab6(t):
    case = F.col("p_partkey") % 4
    asked = F.when(case == 0, F.upper("p_name")).when(case == 1, F.concat(F.lit("art-"), "p_partkey")).when(case == 2, F.concat(F.lit("Alias ("), "p_partkey", F.lit(")"))).otherwise(F.concat(F.lit("none "), "p_partkey"))
    wanted = t.part.select("p_partkey", asked.alias("request"))
    schemas = t.part.select(F.col("p_name").alias("table"), F.concat(F.lit("Title "), "p_partkey").alias("title"), F.concat(F.lit("art-"), "p_partkey").alias("artifact_id"))
    aliases = t.part.select(F.col("p_name").alias("table"), F.concat(F.lit("alias"), "p_partkey").alias("alias"))
    found = L.resolve_tables(wanted.select("request"), schemas, aliases)
    return wanted.join(found, "request").select(F.col("p_partkey").alias("request_id"), "table")


@query("tab12_quality_lookup", f"WITH {S.COMPONENTS_SQL} SELECT component_id, kind, quality FROM components")
def tab12(t):
    return S.components(t).select("component_id", "kind", "quality")


@query("snk11_schema_assets", """SELECT source AS "table", '{"table_name":"' || source || '","fields":["' || string_agg(doc_id || ':' || lang, '","' ORDER BY doc_id) || '"]}' AS schema FROM documents WHERE n_chars > 3000 GROUP BY source""")
def snk11(t):
    return L.schema_assets(t.documents.where("n_chars > 3000").select(F.col("source").alias("table"), F.col("doc_id").alias("place"), F.concat_ws(":", "doc_id", "lang").alias("field")))


@query("snk5_navigation_index", """WITH n AS (SELECT p_brand AS type, p_name AS label, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE NOT regexp_matches(p_name, '^[0-9 ]+$'))
SELECT type, string_agg(label, chr(10) ORDER BY label, id) AS listing, greatest(max(n) - 5, 0) AS omitted FROM n WHERE r <= 5 GROUP BY type""")
def snk5(t):
    nodes = t.part.select(F.col("p_brand").alias("type"), F.col("p_name").alias("label"), F.col("p_partkey").alias("id"))
    blank = t.part.select(F.col("p_brand").alias("type"), F.lit("12 / 34").alias("label"), F.col("p_partkey").alias("id"))
    return L.navigation_index(nodes.union(blank), 5)


# pages -----------------------------------------------------------------------------------------
MARKDOWN = """md AS (SELECT doc_id, '/pages/' || doc_id || '.md' AS path, CASE doc_id % 5
  WHEN 0 THEN '---' || chr(10) || 'type: system_rule' || chr(10) || 'description: d' || chr(10) || 'tags: t' || chr(10) || 'timestamp: s' || chr(10) || 'resource: r' || chr(10) || '---' || chr(10) || text || chr(10) || '# Citations' || chr(10)
  WHEN 1 THEN text WHEN 2 THEN '---' || chr(10) || text
  WHEN 3 THEN '---' || chr(10) || 'title: T' || chr(10) || '---' || chr(10) || text || ' [[Other]] [x](/pages/' || doc_id || '.md) [y](/pages/none.md)'
  ELSE '---' || chr(10) || 'type: ui_flow' || chr(10) || 'tags: t' || chr(10) || '---' || chr(10) || text END AS markdown FROM documents)"""


def _markdown(t):
    case, text = F.col("doc_id") % 5, F.col("text")
    lines = lambda *parts: F.concat_ws("\n", *parts)
    page = (
        F.when(case == 0, lines(F.lit("---\ntype: system_rule\ndescription: d\ntags: t\ntimestamp: s\nresource: r\n---"), text, F.lit("# Citations\n")))
        .when(case == 1, text)
        .when(case == 2, lines(F.lit("---"), text))
        .when(case == 3, F.concat(F.lit("---\ntitle: T\n---\n"), text, F.lit(" [[Other]] [x](/pages/"), "doc_id", F.lit(".md) [y](/pages/none.md)")))
        .otherwise(lines(F.lit("---\ntype: ui_flow\ntags: t\n---"), text))
    )
    return t.documents.select("doc_id", F.concat(F.lit("/pages/"), "doc_id", F.lit(".md")).alias("path"), page.alias("markdown"))


ISSUES = """issues AS (
  SELECT path, i AS issue, i IN ('missing_frontmatter', 'unparseable_yaml', 'missing_type') AS blocking FROM (
    SELECT '/pages/' || doc_id || '.md' AS path, unnest(CASE doc_id % 5 WHEN 1 THEN ['missing_frontmatter'] WHEN 2 THEN ['unparseable_yaml']
      WHEN 3 THEN ['missing_type', 'missing_description', 'missing_tags', 'missing_timestamp', 'missing_resource', 'obsidian_link', 'broken_link']
      WHEN 4 THEN ['missing_description', 'missing_timestamp', 'missing_resource', 'missing_citation'] ELSE [] END) AS i FROM documents))"""


@query("lin1_conformance", f"WITH {ISSUES} SELECT path, issue, blocking FROM issues")
def lin1(t):
    return L.conformance(_markdown(t))


@query("snk6_conformance_report", f"""WITH {ISSUES}, n AS (SELECT issue, blocking, count(*) AS n FROM issues GROUP BY ALL)
SELECT 1 AS line_no, '# Conformance' AS line UNION ALL
SELECT CAST(1 + row_number() OVER (ORDER BY blocking DESC, issue) AS INT), '- ' || CASE WHEN blocking THEN 'blocking' ELSE 'warning' END || ' ' || issue || ': ' || n FROM n""")
def snk6(t):
    return L.conformance_report(L.conformance(_markdown(t)))


@query("doc2_page_parse", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Doc ' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS title, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'knowledge_note' END AS type, 'pages/' || doc_id || '.md' AS artifact_id, 'Head ' || source AS heading FROM documents")
def doc2(t):
    front = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('title: "Doc '), "doc_id", F.lit('"\n'))).otherwise(""), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("type: "), "lang")).otherwise(""))
    page = L.parse_page(F.concat(F.lit("/pages/"), "doc_id", F.lit(".md")), front, F.concat("text", F.lit("\n## Head "), "source", F.lit(" \nmore")))
    return t.documents.select("doc_id", page.alias("p")).select("doc_id", "p.title", "p.type", "p.artifact_id", "p.heading")


@query("doc22_known_type", "SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'concept' END AS type, lang NOT IN ('en', 'de') AS coerced FROM documents")
def doc22(t):
    return t.documents.select("doc_id", L.known_type(F.col("lang"), ["en", "de"]).alias("k")).select("doc_id", "k.type", "k.coerced")


@query("doc15_canonical_names", "SELECT n_nationkey, 'Region ' || n_regionkey AS target, n_name AS source FROM nation")
def doc15(t):
    rows = t.nation.select("n_nationkey", F.concat(F.lit("reg-"), "n_regionkey").alias("target"), F.col("n_name").alias("source"))
    aliases = t.region.select(F.concat(F.lit("Region "), "r_regionkey").alias("table"), F.concat(F.lit("REG "), "r_regionkey").alias("alias"))
    return L.canonical_names(rows.withColumn("target", F.regexp_replace("target", "-", " ")), ["target", "source"], aliases)


@query("qua3_candidate_rules", "SELECT 'candidateRelationships' AS rule, 'blocking' AS severity, count(*) AS n, 1e0 AS penalty FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'tableRelationCandidates', 'warning', count(*), least(1e0, count(*) / 1e1) FROM region")
def qua3(t):
    edges = t.customer.select(F.when(F.col("c_custkey") % 7 == 0, "candidate").otherwise("semantic").alias("edge_kind"))
    return L.candidate_findings(edges, t.region)


# retrieval -------------------------------------------------------------------------------------
@query("ret6_intent_bonus", f"""WITH {P.POSTS}, {P.TERMS},
hit AS (SELECT DISTINCT query_id, component_id FROM posts JOIN terms USING (term)),
facts AS (SELECT component_id, kind <> 'src1' AS has_tables, type = 'en' AS activity FROM pages_),
bonus AS (SELECT query_id, component_id, CASE WHEN query_id % 3 = 0 AND has_tables THEN 4e0 WHEN query_id % 3 = 1 AND activity THEN 4e0 ELSE 0e0 END AS b FROM hit JOIN facts USING (component_id))
SELECT query_id, component_id, b AS bonus FROM bonus WHERE b > 0""")
def ret6(t):
    asked = S.queries(t).withColumn("query", F.concat("query", F.when(F.col("query_id") % 3 == 0, " 配置表").when(F.col("query_id") % 3 == 1, " 活动结构").otherwise("")))
    p = S.pages(t)
    facts = p.select("component_id", (F.col("kind") != "src1").alias("has_tables"), F.when(F.col("type") == "en", "activity_template").otherwise("concept").alias("type"))
    # the tables intent adds English terms too; no page of these tables holds one of both
    latin = R.intents_of(asked).where(~F.col("term").rlike("^[a-z_ ]+$"))
    return R.bonus_stored(P.index(t), R.query_terms(S.queries(t), han=False), latin, facts)


PLACED = """placed AS (
  SELECT query_id, term, min(i) AS place FROM (
    SELECT query_id, unnest(l) AS term, generate_subscripts(l, 1) AS i FROM (SELECT query_id, regexp_extract_all(lower(query), '[a-z0-9]+') AS l FROM queries_)) GROUP BY ALL)"""
NORMAL = r"trim(regexp_replace(regexp_replace(lower({}), '[`*_~#\[\]()>|]', ' ', 'g'), '\s+', ' ', 'g'))"
WHOLE = f"""whole AS (SELECT component_id, {NORMAL.format("title || chr(10) || path || chr(10) || type || chr(10) || body")} AS normal FROM pages_),
asked AS (SELECT query_id, {NORMAL.format("query")} AS phrase FROM queries_),
phrases AS (SELECT query_id, component_id FROM asked JOIN whole ON contains(normal, phrase))"""


def _texts(t):
    # as in SQL, a page that lacks one of these has no text
    parts = [x for c in ("title", "path", "type", "body") for x in (F.lit("\n"), F.col(c))]
    return S.pages(t).select("component_id", F.concat(*parts[1:]).alias("text"))


def _phrases(t, asked=None):
    return R.phrases_stored(P.index(t), _texts(t), S.queries(t) if asked is None else asked)


@query("ret5_exact_phrase", f"WITH {S.PAGES_SQL}, {S.QUERIES_SQL}, {WHOLE} SELECT query_id, component_id FROM phrases")
def ret5(t):
    return _phrases(t)


@query("ret3_intent_expansion", """WITH asked AS (SELECT item_id, item_id % 4 AS k FROM benchmark)
SELECT item_id AS query_id, intent, count(*) AS terms FROM asked JOIN (VALUES
(0, 'tables', '关联配置表'), (0, 'tables', '关联'), (0, 'tables', '联配'), (0, 'tables', '配置'), (0, 'tables', '置表'), (0, 'tables', '关联配'), (0, 'tables', '联配置'), (0, 'tables', '配置表'),
(0, 'tables', 'data'), (0, 'tables', 'dependencies'), (0, 'tables', 'table'), (0, 'tables', 'schema'), (0, 'tables', 'fields'), (0, 'tables', 'configured'), (0, 'tables', 'in'),
(1, 'evidence', '证据'), (1, 'evidence', 'citations'), (1, 'evidence', 'source'), (1, 'evidence', 'trust')) v(k, intent, term) USING (k) GROUP BY ALL""")
def ret3(t):
    """Every fourth query asks for a table, every fourth for evidence."""
    n = F.col("query_id") % 4
    asked = S.queries(t).withColumn("query", F.concat("query", F.when(n == 0, " 查表").when(n == 1, " 有什么依据").otherwise("")))
    return R.intents_of(asked).groupBy("query_id", "intent").agg(F.count("*").alias("terms"))


def _trust(t):
    return t.labels.select(F.col("doc_id").cast("string").alias("component_id"), F.col("quality").cast("double").alias("trust"))


@query("ret8_explanations", f"""WITH {P.LEXICAL}, {PLACED}, {WHOLE},
top3 AS (SELECT query_id, component_id FROM lexical_top WHERE rank <= 3),
hit AS (SELECT DISTINCT query_id, component_id, field, term, place FROM top3 JOIN posts USING (component_id) JOIN placed USING (query_id, term)),
long_ AS (SELECT * FROM placed WHERE length(term) >= 3),
norm AS (SELECT component_id, lower(title || chr(10) || path) AS top, lower(title || chr(10) || path || chr(10) || type || chr(10) || body) AS all_ FROM pages_),
held AS (SELECT query_id, component_id, term, place, contains(top, term) AS t FROM top3 JOIN long_ USING (query_id) JOIN norm USING (component_id) WHERE contains(all_, term)),
lines AS (
  SELECT query_id, component_id, 2 AS part, CASE field WHEN 'title' THEN 0 WHEN 'path' THEN 1 WHEN 'type' THEN 2 ELSE 4 END AS pos, field || ' 命中：' || array_to_string((list(term ORDER BY place))[1:5], ', ') AS line FROM hit GROUP BY query_id, component_id, field
  UNION ALL SELECT query_id, component_id, 1, 0, CASE WHEN bool_or(t) THEN '核心词命中标题/路径：' || array_to_string((list(term ORDER BY place) FILTER (t))[1:3], ', ') ELSE '核心词命中正文：' || array_to_string((list(term ORDER BY place))[1:3], ', ') END FROM held GROUP BY query_id, component_id
  UNION ALL SELECT query_id, component_id, 0, 0, '完整短语命中' FROM top3 JOIN phrases USING (query_id, component_id)
  UNION ALL SELECT query_id, component_id, 3, 0, '缺少核心词：' || array_to_string((list(term ORDER BY place))[1:3], ', ') FROM top3 JOIN long_ USING (query_id) WHERE (query_id, component_id) NOT IN (SELECT (query_id, component_id) FROM held) GROUP BY query_id, component_id
  UNION ALL SELECT query_id, component_id, 5, 0, '可信度 ' || CAST(CAST(quality AS DOUBLE) AS VARCHAR) FROM top3 JOIN labels ON component_id = CAST(doc_id AS VARCHAR) WHERE quality IS NOT NULL),
words AS (SELECT query_id, component_id, array_to_string(list_sort(list(DISTINCT term)), ' ') AS terms FROM (SELECT query_id, component_id, term FROM hit UNION SELECT query_id, component_id, term FROM held) GROUP BY ALL),
names AS (SELECT query_id, component_id, array_to_string(list_sort(list(DISTINCT field)), ' ') AS fields FROM (SELECT query_id, component_id, field FROM hit UNION SELECT query_id, component_id, 'body' FROM top3 JOIN phrases USING (query_id, component_id)) GROUP BY ALL),
why AS (SELECT query_id, component_id, array_to_string((list(line ORDER BY part, pos))[1:8], '; ') AS why FROM lines GROUP BY ALL)
SELECT query_id, component_id, terms, fields, why FROM words JOIN names USING (query_id, component_id) JOIN why USING (query_id, component_id)""")
def ret8(t):
    anchors, queries = R.anchors_of(S.queries(t)), S.queries(t)
    # only the terms and texts of the pages that are explained are looked at
    top = stored(P._lexical(t).where("rank <= 3").select("query_id", "component_id"), "top")
    posts = stored(P.index(t).held_by(top), "posts")
    hits = top.join(R.placed_terms(queries, han=False), "query_id").join(posts, ["component_id", "term"]).select("query_id", "component_id", "field", "term", "place")
    holding = top.join(anchors, "query_id").join(posts.where("field <> 'citations'"), "component_id").where(F.contains("term", F.col("anchor")))
    held = holding.groupBy("query_id", "component_id", "anchor").agg(F.max(F.col("field").isin("title", "path")).alias("top"))
    asked = top.join(queries.select("query_id", normalize_text(F.col("query")).alias("phrase")), "query_id").where("phrase <> ''")
    whole = asked.join(_texts(t), "component_id").where(F.contains(normalize_text(F.col("text")), F.col("phrase"))).select("query_id", "component_id")
    out = R.explanations(hits, held, anchors, whole, trust=_trust(t))
    return out.select("query_id", "component_id", F.array_join("terms", " ").alias("terms"), F.array_join("fields", " ").alias("fields"), F.array_join("why", "; ").alias("why"))


#: Queries of which every third asks for tables and every third for structure; pages of one source have no tables, those of one language are activities.
RANKED = f"""{P.LEXICAL}, {WHOLE},
expansions AS (
  SELECT query_id, unnest(['data', 'dependencies', 'table', 'schema', 'fields', 'configured', 'in']) AS term FROM queries_ WHERE query_id % 3 = 0
  UNION ALL SELECT query_id, unnest(['data', 'dependencies']) FROM queries_ WHERE query_id % 3 = 1),
wide AS (SELECT query_id, component_id, CAST(sum(weight) AS DOUBLE) AS score FROM posts JOIN (SELECT * FROM terms UNION SELECT * FROM expansions) USING (term) GROUP BY ALL),
meant AS (SELECT DISTINCT query_id, component_id, 3 AS more FROM posts JOIN expansions USING (term)),
long_ AS (SELECT * FROM terms WHERE length(term) >= 3),
counts AS (SELECT query_id, count(*) AS anchors FROM long_ GROUP BY ALL),
norm AS (SELECT component_id, kind, type, lower(title || chr(10) || path) AS top, lower(title || chr(10) || path || chr(10) || type || chr(10) || body) AS all_ FROM pages_),
matched AS (
  SELECT query_id, component_id, count(*) AS in_text, count(*) FILTER (contains(top, term)) AS in_title
  FROM long_ JOIN norm ON contains(all_, term) GROUP BY ALL),
raw AS (
  SELECT query_id, component_id, quality, CASE WHEN anchors IS NULL THEN coalesce(l.score, 0) WHEN coalesce(in_text, 0) > 0 THEN coalesce(l.score, 0) + in_title * 90 + (in_text - in_title) * 35 ELSE coalesce(l.score, 0) * 0.35 END
    + CASE WHEN p.component_id IS NOT NULL THEN 6 ELSE 0 END + coalesce(more, 0)
    + CASE WHEN query_id % 3 = 0 AND kind <> 'src1' THEN 4 WHEN query_id % 3 = 1 AND type = 'en' THEN 4 ELSE 0 END AS s
  FROM queries_ CROSS JOIN norm LEFT JOIN wide l USING (query_id, component_id) LEFT JOIN meant USING (query_id, component_id) LEFT JOIN matched USING (query_id, component_id) LEFT JOIN counts USING (query_id)
  LEFT JOIN (SELECT query_id, component_id FROM phrases WHERE query_id % 3 = 2) p USING (query_id, component_id) LEFT JOIN labels ON component_id = CAST(doc_id AS VARCHAR)),
full_ AS (SELECT query_id, component_id, floor(CASE WHEN quality IS NULL THEN s ELSE s * (0.9 + greatest(0, least(1, CAST(quality AS DOUBLE))) * 0.1) END * 1000 + 0.5) / 1000 AS score FROM raw),
full_top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, component_id) AS INT) AS rank FROM full_ WHERE score > 0) WHERE rank <= 20)"""


def _asked(t):
    n = F.col("query_id") % 3
    return S.queries(t).withColumn("query", F.concat("query", F.when(n == 0, " 配置表").when(n == 1, " 活动结构").otherwise("")))


def _full(t, k=20):
    """The whole lexical score: fields, anchors, phrase, intents, trust."""
    index, asked = P.index(t), _asked(t)
    kept = index.pages
    facts = kept.select("component_id", (F.col("kind") != "src1").alias("has_tables"), F.when(F.col("type") == "en", "activity_template").otherwise("concept").alias("type"))
    return R.rank_stored(index, asked, k, _phrases(t, asked), _trust(t), facts)


@query("ret6_ranked_with_intents", f"WITH {RANKED} SELECT query_id, component_id, score, rank FROM full_top")
def ret6_ranked(t):
    return _full(t)


SEARCH = f"""{RANKED}, {P.VECTORS},
ranks AS (SELECT query_id, component_id, rank FROM full_top UNION ALL SELECT query_id, component_id, rank FROM dense_top),
fused AS (SELECT query_id, component_id, floor(sum(1.0 / (60 + rank)) * 1e9 + 0.5) / 1e9 AS score FROM ranks GROUP BY ALL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, component_id) AS r FROM fused) WHERE r <= 20),
seen AS (
  SELECT query_id, component_id, score, r, kind, body FROM pool JOIN pages_ USING (component_id)
  WHERE query_id % 2 = 0 OR kind NOT IN ('src1', 'src2', 'src3')),
sized AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM seen),
close_ AS (SELECT query_id, component_id, count(DISTINCT term) / (SELECT count(*) FROM terms u WHERE u.query_id = sized.query_id) AS c FROM sized JOIN posts p USING (component_id) JOIN terms USING (query_id, term) GROUP BY query_id, component_id),
found AS (
  SELECT query_id, component_id, kind, CASE WHEN n <= 5 THEN score ELSE floor(coalesce(c, 0) * 1e9 + 0.5) / 1e9 END AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 5 THEN -r ELSE floor(coalesce(c, 0) * 1e9 + 0.5) / 1e9 END DESC, component_id) AS INT) AS rank
  FROM sized LEFT JOIN close_ USING (query_id, component_id) QUALIFY rank <= 5)"""


def _search(t):
    """As a user meets it: the whole lexical score fused with hashed vectors, roles, rerank by the share of query terms in a page, fallback."""
    kind, index = F.col("kind"), P.index(t)
    marked = index.pages.where(kind.isin("src1", "src2", "src3")).select("component_id", F.when(kind == "src3", "restricted").otherwise("internal").alias("visibility"))
    roles = S.queries(t).select("query_id", F.when(F.col("query_id") % 2 == 0, "admin").otherwise("guest").alias("role"))
    terms = R.query_terms(S.queries(t), han=False)

    def fallback(without):
        # bodies alone, which the index holds as a field
        return I.matches(index, I.as_terms(terms.join(without, "query_id", "left_semi")), {"body": 1}).select("query_id", "component_id", "score")

    def scorer(pool):
        pool = stored(pool, "pool")
        shares = R.pair_shares(index.held_by(pool), pool, terms)
        return pool.join(shares, ["query_id", "component_id"], "left").withColumn("score", half_up(F.coalesce("share", F.lit(0.0)), 9)).drop("share")

    return L.kb_search([_full(t), P._dense(t)], lambda hits: R.visible(hits, marked, roles), fallback, S.queries(t), 5, lambda pool, limit: R.rerank(pool, scorer, limit))


@query("ret16_kb_search", f"""WITH {SEARCH},
tokens AS (SELECT DISTINCT component_id, kind, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM pages_),
rest AS (
  SELECT query_id, component_id, CAST(count(*) AS DOUBLE) AS score FROM tokens JOIN terms USING (term)
  WHERE query_id NOT IN (SELECT query_id FROM found) AND (query_id % 2 = 0 OR kind NOT IN ('src1', 'src2', 'src3')) GROUP BY ALL),
every AS (SELECT query_id, component_id, score, rank, 'hybrid_rrf' AS mode FROM found
  UNION ALL SELECT query_id, component_id, score, rank, 'fallback' FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, component_id) AS INT) AS rank FROM rest) WHERE rank <= 5),
core AS (SELECT query_id, count(*) AS core FROM terms GROUP BY ALL),
met AS (SELECT e.query_id, e.component_id, count(DISTINCT p.term) AS m FROM every e JOIN posts p USING (component_id) JOIN terms USING (query_id, term) GROUP BY ALL)
SELECT query_id, component_id, floor(score * 1e9 + 0.5) / 1e9 AS score, rank, mode, CASE WHEN p.kind = 'src1' THEN '' ELSE p.kind END AS tables,
  CASE WHEN score <= 0 THEN 'near_miss' WHEN coalesce(core, 0) >= 4 AND coalesce(m, 0) / core < 0.35 THEN 'low_confidence_hit' ELSE 'hit' END AS match_class
FROM every JOIN pages_ p USING (component_id) LEFT JOIN core USING (query_id) LEFT JOIN met USING (query_id, component_id)""")
def ret16(t):
    index, terms = P.index(t), R.query_terms(S.queries(t), han=False)
    found = stored(_search(t), "found").withColumn("fields", F.array(F.lit("body"), F.lit("tables")))
    aligned = L.align_tables(found, index.pages.where("kind <> 'src1'").select("component_id", F.array("kind").alias("tables")))
    shares = R.pair_shares(index.held_by(found), found, terms)
    core = terms.groupBy("query_id").agg(F.count("*").alias("core"))
    joined = aligned.join(shares, ["query_id", "component_id"], "left").join(core, "query_id", "left")
    matched, n = F.round(F.coalesce("share", F.lit(0.0)) * F.coalesce("core", F.lit(0))), F.coalesce("core", F.lit(0))
    return joined.select("query_id", "component_id", half_up(F.col("score"), 9).alias("score"), "rank", "mode", F.array_join("tables", ",").alias("tables"), R.match_class(F.col("score"), matched, n).alias("match_class"))


@query("ret20_align_tables", f"""WITH {P.LEXICAL} SELECT query_id, component_id, CASE WHEN kind = 'src1' THEN 'body' ELSE 'body,tables' END AS fields, CASE WHEN kind = 'src1' THEN '' ELSE kind END AS tables FROM lexical_top JOIN pages_ USING (component_id)""")
def ret20(t):
    hits = P._lexical(t).select("query_id", "component_id", F.array(F.lit("body"), F.lit("tables")).alias("fields"))
    tables = S.pages(t).where("kind <> 'src1'").select("component_id", F.array("kind").alias("tables"))
    return L.align_tables(hits, tables).select("query_id", "component_id", F.array_join("fields", ",").alias("fields"), F.array_join("tables", ",").alias("tables"))


@query("eva3_live_probe", f"""WITH {P.LEXICAL},
facts AS (SELECT DISTINCT query_id, unnest(list_filter(string_split(query, ' '), lambda w: length(w) >= 8)) AS fact FROM queries_),
met AS (SELECT DISTINCT query_id, fact FROM facts JOIN lexical_top USING (query_id) JOIN pages_ USING (component_id) WHERE rank <= 5 AND contains(body, fact))
SELECT query_id, count(*) AS facts, count(m.fact) AS found FROM facts LEFT JOIN met m USING (query_id, fact) GROUP BY query_id""")
def eva3(t):
    facts = S.queries(t).select("query_id", F.explode(F.filter(F.split("query", " "), lambda w: F.char_length(w) >= 8)).alias("fact")).distinct()
    return L.fact_coverage(P._lexical(t).where("rank <= 5"), facts, S.pages(t).select("component_id", "body"))


# changes ---------------------------------------------------------------------------------------
@query("dml4_insert_latest", """SELECT c_custkey, -1e0 AS price FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT o_custkey, arg_max(CAST(o_totalprice AS DOUBLE), (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey""")
def dml4(t):
    have = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit(-1.0).alias("price"))
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").cast("double").alias("price"), "o_orderdate", "o_orderkey")
    return L.insert_latest(have, t.customer, orders, "c_custkey", ["o_orderdate", "o_orderkey"])
