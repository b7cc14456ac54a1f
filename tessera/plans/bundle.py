"""Queries of bundle pages, lookup, annotations, navigation, candidate rules and the diagnostic log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.rounding import half_up
from tessera.operators import bundle as B
from tessera.operators import retrieval as R
from tessera.plans import retrieval as P
from tessera.plans import standins as S
from tessera.plans.base import query
from tessera.sources import sinks
from tessera.sources.scratch import shared_path, stored

#: Every document as a page: every fifth a table's; labelled ones have trust, toxic ones citations.
PAGES = r"""src AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 5 = 0 THEN 'wiki/tables/' ELSE 'wiki/pages/' END || doc_id || '.md' AS artifact, 'Line ' || doc_id || chr(10) || text AS body, quality, toxic
  FROM documents LEFT JOIN labels USING (doc_id)),
page AS (SELECT *, '---' || chr(10) || 'type: "' || lang || '"' || chr(10) || 'title: "T ' || doc_id || '"' || chr(10) || 'description: "Line ' || doc_id || '"' || chr(10) || 'tags: ["' || source || '", "' || lang || '"]' || chr(10)
  || 'timestamp: "2024-01-01"' || chr(10) || 'resource: "kh://component/c' || doc_id || '"' || chr(10) || 'kh:' || chr(10) || '  componentId: "c' || doc_id || '"' || chr(10) || '  packageId: "' || source || '"' || chr(10)
  || '  artifactId: "' || artifact || '"' || chr(10) || '  legislationProfileHash: "h"' || chr(10)
  || CASE WHEN quality IS NULL THEN '' ELSE '  trust:' || chr(10) || '    version: "v2-lite"' || chr(10) || '    score: ' || CASE quality WHEN 1 THEN '0.75' ELSE '0.5' END || chr(10) || '    status: "usable"' || chr(10) || '    evidence: ' || quality || chr(10)
     || '    completeness: 0.5' || chr(10) || '    auditFreshness: 1' || chr(10) || '    consistency: 0.25' || chr(10) || '    lastTrustedAuditAt: ""' || chr(10) END
  || '---' || chr(10) || regexp_replace(body, '^\s+|\s+$', '', 'g') || chr(10)
  || CASE WHEN quality IS NULL THEN '' ELSE chr(10) || '# Trust' || chr(10) || chr(10) || '- score: ' || CASE quality WHEN 1 THEN '0.75' ELSE '0.5' END || chr(10) || '- status: usable' || chr(10) || '- evidence: ' || quality || chr(10)
     || '- completeness: 0.5' || chr(10) || '- auditFreshness: 1' || chr(10) || '- consistency: 0.25' || chr(10) || '- caps: ' || CASE quality WHEN 0 THEN 'low evidence; old' ELSE 'none' END || chr(10) END
  || CASE WHEN toxic = 1 THEN chr(10) || '# Citations' || chr(10) || chr(10) || '1. a quote of ' || source || ' (e' || doc_id || '; source v1; confidence 0.5; seen)' || chr(10) || '2. Evidence record (f' || doc_id || '; source v2; confidence 1)' || chr(10) ELSE chr(10) END AS markdown
  FROM src)"""


def _rendered(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    text = lambda x: F.lit(x)
    part = F.col("quality")
    trust = F.when(part.isNotNull(), F.struct(
        F.when(part == 1, 0.75).otherwise(0.5).alias("score"), text("usable").alias("status"), part.cast("double").alias("evidence"), F.lit(0.5).alias("completeness"), F.lit(1.0).alias("auditFreshness"), F.lit(0.25).alias("consistency"),
        F.lit(None).cast("string").alias("lastTrustedAuditAt"), F.when(part == 0, F.array(text("low evidence"), text("old"))).otherwise(F.array().cast("array<string>")).alias("caps")))
    cite = lambda quote, prefix, source, confidence, note: F.struct(quote.alias("quote"), F.concat(F.lit(prefix), "doc_id").alias("evidence_id"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), F.lit(note).cast("string").alias("note"))
    cited = F.when(F.col("toxic") == 1, F.array(cite(F.concat(F.lit(" a  quote\nof "), "source"), "e", "v1", 0.5, " seen "), cite(F.lit(" "), "f", "v2", 1.0, None)))
    artifact = F.concat(F.when(F.col("doc_id") % 5 == 0, "wiki/tables/").otherwise("wiki/pages/"), "doc_id", F.lit(".md"))
    page = {
        "type": F.col("lang"), "title": F.concat(F.lit("T "), "doc_id"), "body": F.concat(F.lit("Line "), "doc_id", F.lit("\n"), "text"), "published_at": F.lit("2024-01-01"), "component_id": F.concat(F.lit("c"), "doc_id"),
        "package_id": F.col("source"), "artifact_id": artifact, "profile_hash": F.lit("h"),
    }
    return d.select("doc_id", F.concat(F.lit("/"), artifact).alias("path"), B.render(page, F.array("source", "lang"), trust, cited).alias("markdown"))


@query("snk3_bundle_pages", f"WITH {PAGES} SELECT doc_id, md5(markdown) AS page FROM page")
def snk3(t):
    return _rendered(t).select("doc_id", F.md5("markdown").alias("page"))


@query("doc2_parsed_pages", f"""WITH {PAGES} SELECT 'c' || doc_id AS component_id, source AS package_id, artifact AS artifact_id, 'T ' || doc_id AS title, 'Line ' || doc_id AS description, lang AS type,
CASE WHEN doc_id % 5 = 0 THEN 'table_wiki_page' ELSE 'wiki_page' END AS kind, CASE quality WHEN 1 THEN 0.75e0 WHEN 0 THEN 0.5e0 END AS score, CAST(quality AS DOUBLE) AS evidence,
CASE WHEN toxic = 1 THEN '1|a quote of ' || source || '|e' || doc_id || '|v1|0.5;2|Evidence record|f' || doc_id || '|v2|1.0' ELSE '' END AS citations FROM page""")
def doc2(t):
    """Pages rendered and parsed again."""
    parsed = B.parse_pages(_rendered(t))
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws("|", c["n"].cast("string"), c["quote"], c["evidence_id"], c["source"], c["confidence"].cast("string"))), ";")
    return parsed.select("component_id", "package_id", "artifact_id", "title", "description", "type", "kind", F.col("trust.score").alias("score"), F.col("trust.evidence").alias("evidence"), cited.alias("citations"))


@query("doc23_found_pages", """SELECT 'r' || doc_id AS request_id, 'c' || doc_id AS component_id, CASE WHEN doc_id % 7 = 6 THEN 'search' ELSE 'key' END AS how FROM documents WHERE doc_id % 7 < 6 OR (doc_id % 7 = 6 AND doc_id % 3 > 0 AND doc_id % 2 = 0)""")
def doc23(t):
    """Requests in six spellings that are keys of a page, and one that only search can answer."""
    ids = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("n"))
    place = F.when(F.col("doc_id") % 5 == 0, "tables/").otherwise("pages/")
    forms = [F.concat(F.lit("C"), "n"), F.concat(F.lit("t  "), "n"), F.concat(F.lit("/WIKI/"), place, "n", F.lit(".md")), F.concat(F.lit("wiki\\"), place, "n"), F.concat(place, "n", F.lit(".md")), F.concat(F.lit("line "), "n"), F.concat(F.lit("where is "), "n")]
    request = F.element_at(F.array(*forms), (F.col("doc_id") % 7 + 1).cast("int"))
    asked = ids.select(request.alias("request"), "doc_id")
    hits = asked.select("request", F.concat(F.lit("c"), "doc_id").alias("component_id"), (F.col("doc_id") % 3).cast("double").alias("score"), (F.col("doc_id") % 2 == 1).alias("missed"))
    found = B.find_pages(B.parse_pages(_rendered(t)), asked, hits)
    return found.join(asked, "request").select(F.concat(F.lit("r"), "doc_id").alias("request_id"), "component_id", "how")


@query("doc14_annotations", """WITH b AS (SELECT doc_id, doc_id % 4 AS k, lang, source, '# A' || chr(10) || 'one' || chr(10) || '## B x' || chr(10) || md5(text) || chr(10) || '### C' || chr(10) || 'sub' || chr(10) || '## D' || chr(10) || 'end' AS body FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS component_id, CASE WHEN k = 1 THEN 'New' ELSE source END AS title, CASE k WHEN 0 THEN 'a=1,l=' || lang WHEN 1 THEN 'a=2,l=' || lang WHEN 2 THEN 'l=' || lang || ',z=9' ELSE 'a=1,l=' || lang END AS facts,
CASE k WHEN 1 THEN '# A' || chr(10) || 'one' || chr(10) || '## B x' || chr(10) || 'new' || chr(10) || '## D' || chr(10) || 'end' WHEN 2 THEN body || chr(10) || chr(10) || '## Other' || chr(10) || 'more' WHEN 3 THEN 'whole' ELSE body END AS body FROM b""")
def doc14(t):
    """Four kinds of annotations: none; title, a fact and a section; facts taken away and a section that is missing; the whole body."""
    k, none = F.col("doc_id") % 4, F.lit(None)
    body = F.concat(F.lit("# A\none\n## B x\n"), F.md5("text"), F.lit("\n### C\nsub\n## D\nend"))
    pages = t.documents.select(F.col("doc_id").cast("string").alias("component_id"), F.col("source").alias("title"), F.col("lang").alias("type"), F.create_map(F.lit("a"), F.lit("1"), F.lit("l"), F.col("lang")).alias("facts"), body.alias("body"))
    edits = t.documents.where(k > 0).select(
        F.col("doc_id").cast("string").alias("component_id"), F.when(k == 1, "New").alias("title"), none.cast("string").alias("type"),
        F.when(k == 1, F.create_map(F.lit("a"), F.lit("2"))).when(k == 2, F.create_map(F.lit("z"), F.lit("9"))).alias("set_facts"), F.when(k == 2, F.array(F.lit("a"), F.lit("q"))).alias("remove_facts"),
        F.when(k == 1, "b X").when(k == 2, "Other").alias("section"), F.when(k == 1, "new").when(k == 2, "more").alias("content"), F.when(k == 3, "whole").alias("body"),
    )
    out = B.annotate(pages, edits)
    facts = F.array_join(F.array_sort(F.transform(F.map_entries("facts"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return out.select("component_id", "title", facts.alias("facts"), "body")


@query("snk5_navigation_lines", """WITH n AS (SELECT 'customer' AS type, c_name AS label, 'c' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'wiki/c/' || c_custkey || '.md' END AS page FROM customer WHERE c_custkey % 10 <> 3
  UNION ALL SELECT 'nation', n_name, 'n' || n_nationkey, NULL FROM nation),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY label, id) AS place, count(*) OVER (PARTITION BY type) AS all_ FROM n),
e AS (SELECT 'c' || c_custkey AS s, 'lives_in' AS rel, 'n' || c_nationkey AS t FROM customer WHERE c_custkey % 4 <> 0),
q AS (SELECT *, row_number() OVER (ORDER BY s, rel, t) AS place, count(*) OVER () AS all_ FROM e)
SELECT type AS section, place, '- ' || CASE WHEN page IS NULL THEN label ELSE '[' || label || '](' || substr(page, 6) || ')' END AS line FROM r WHERE place <= 120
UNION ALL SELECT DISTINCT type, 121, '- ... ' || (all_ - 120) || ' more omitted; see graph.json for full node list.' FROM r WHERE all_ > 120
UNION ALL SELECT 'Relationships', place, '- ' || s || ' -' || rel || '-> ' || t FROM q WHERE place <= 200
UNION ALL SELECT DISTINCT 'Relationships', 201, '- ... ' || (all_ - 200) || ' more omitted; see graph.json for full relationship list.' FROM q WHERE all_ > 200""")
def snk5(t):
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 3, "12-34").otherwise(F.col("c_name")).alias("label"), F.lit("customer").alias("type"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("wiki/c/"), "c_custkey", F.lit(".md"))).alias("wiki_page"))
    n = t.nation.select(F.concat(F.lit("n"), "n_nationkey"), "n_name", F.lit("nation"), F.lit(None).cast("string"))
    fields = t.region.select(F.concat(F.lit("f"), "r_regionkey"), "r_name", F.lit("field"), F.lit(None).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("candidate", "semantic", "fk", "semantic"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    edges = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.lit("lives_in").alias("relation"), F.concat(F.lit("n"), "c_nationkey").alias("target"), kind.alias("edge_kind"))
    return B.navigation(c.union(n).union(fields), edges).select("section", F.col("place").cast("long").alias("place"), "line")


@query("qua3_candidate_findings", """WITH e AS (SELECT c_nationkey AS p, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL), r AS (SELECT s_nationkey AS p, count(*) AS n FROM supplier GROUP BY ALL)
SELECT p AS project_id, 'candidateRelationships' AS rule, 'wiki/graph.json' AS ref, CASE WHEN p % 4 = 1 THEN 'info' ELSE 'blocking' END AS severity, n, 1e0 AS penalty FROM e WHERE p % 5 <> 0
UNION ALL SELECT p, 'tableRelationCandidates', 'wiki/_tables/table_relation_candidates.json', 'warning', n, least(1e0, n / 10) FROM r WHERE p % 7 <> 2""")
def qua3(t):
    """Projects by nation: some have a rule off, some a severity of their own, some have dismissed a finding, and some a finding of another file."""
    n = t.nation.select(F.col("n_nationkey").alias("project_id"))
    edges = t.customer.select(F.col("c_nationkey").alias("project_id"), F.when(F.col("c_custkey") % 3 == 0, "candidate").otherwise("semantic").alias("edge_kind"))
    off = n.where("project_id % 5 = 0").select("project_id", F.lit("candidateRelationships").alias("rule"), F.lit(False).alias("enabled"), F.lit(None).cast("string").alias("severity"))
    own = n.where("project_id % 4 = 1 AND project_id % 5 <> 0").select("project_id", F.lit("candidateRelationships"), F.lit(None).cast("boolean"), F.lit("info"))
    gone = n.where("project_id % 7 = 2").select("project_id", F.lit("tableRelationCandidates").alias("rule"), F.lit("wiki/_tables/table_relation_candidates.json").alias("ref"))
    other = n.where("project_id % 7 = 3").select("project_id", F.lit("tableRelationCandidates"), F.lit("wiki/graph.json"))
    return B.candidate_findings(edges, t.supplier.select(F.col("s_nationkey").alias("project_id")), off.union(own), gone.union(other))


@query("snk7_diagnostic_log", """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) AS redacted, CAST(0 AS BIGINT) AS leaked FROM events WHERE event_type <> 'view' AND CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) FROM events) - 10 GROUP BY ALL""")
def snk7(t):
    """Calls with secrets in their payloads, of which the last ten days stay."""
    path = shared_path(t.spark, "diagnostics")
    payload = F.concat(F.lit('{"user":"'), "user_id", F.lit('","auth":{"apiKey":"sk-'), "event_id", F.lit('","Token":["sk-1"]},"list":[{"password":"sk-x"}]}'))
    level = F.when(F.col("event_type") == "view", "debug").when(F.col("event_type") == "error", "error").otherwise("info")
    rows = t.events.select(F.col("ts").cast("timestamp").alias("created_at"), level.alias("level"), payload.alias("request_payload_json"))
    sinks.write_diagnostics(rows, path, ["request_payload_json"])
    today = t.events.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]
    sinks.expire_days(t.spark, path, today, 10)
    back = t.spark.read.schema("created_at string, level string, request_payload_json string, day string").json(path)
    secret = F.contains("request_payload_json", F.lit("sk-"))
    return back.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.contains("request_payload_json", F.lit("[REDACTED]"))).alias("redacted"), F.count_if(secret).alias("leaked"))


@query("ret15_rerank_by_terms", f"""WITH {P.LEXICAL},
pool AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM lexical_top),
met AS (SELECT query_id, component_id, count(DISTINCT term) / (SELECT count(*) FROM terms u WHERE u.query_id = pool.query_id) AS share FROM pool JOIN posts USING (component_id) JOIN terms USING (query_id, term) GROUP BY query_id, component_id),
scored AS (SELECT query_id, component_id, n, rank AS before, floor(coalesce(share, 0) * 1e9 + 0.5) / 1e9 AS score FROM pool LEFT JOIN met USING (query_id, component_id))
SELECT query_id, component_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 5 THEN -before ELSE score END DESC, component_id) AS INT) AS rank FROM scored) WHERE rank <= 5""")
def ret15(t):
    """The pool ordered by a scorer of query and page: the share of the query's terms that the page holds."""
    pool = stored(P._lexical(t), "pool")
    shares = R.pair_shares(P.index(t).held_by(pool), pool, R.query_terms(S.queries(t), han=False))
    scorer = lambda pool: pool.join(shares, ["query_id", "component_id"], "left").withColumn("score", half_up(F.coalesce("share", F.lit(0.0)), 9)).drop("share")
    return R.rerank(pool, scorer, 5).select("query_id", "component_id", "score", "rank")
