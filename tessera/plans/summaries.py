"""Queries of quality rules, dashboards and page lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import dashboards as B
from tessera.operators import quality as Q
from tessera.plans import standins as S
from tessera.plans.base import query
from tessera.plans.governance import FEEDBACK, TRUST, _feedback, _trust
from tessera.plans.relational import V1, V2, _versions
from tessera.plans.retrieval import LEXICAL, _lexical

SPEC = "p AS (SELECT source AS component_id, list(DISTINCT lang) AS have, min(CASE WHEN doc_id % 9 = 0 THEN '' ELSE 's' END) AS src FROM documents GROUP BY ALL)"


def _spec_findings(t):
    p = t.documents.groupBy(F.col("source").alias("component_id")).agg(F.collect_set("lang").alias("headings"), F.min(F.when(F.col("doc_id") % 9 == 0, "").otherwise("s")).alias("source"))
    p = p.withColumns({"type": F.lit("system"), "facts": F.col("headings")})
    specs = t.spark.createDataFrame([("system", ["en", "es", "xx"], ["de"])], "type string, sections array<string>, fact_names array<string>")
    return Q.spec_findings(p, specs)


FOUND = f"""{SPEC}, found AS (
SELECT component_id, 'wikiSpecCompleteness' AS rule, list_filter(['en', 'es', 'xx'], lambda x: NOT list_contains(have, x)) AS missing FROM p
UNION ALL SELECT component_id, 'requiredFacts', list_filter(['de'], lambda x: NOT list_contains(have, x)) FROM p UNION ALL SELECT component_id, 'frontmatterSource', CASE WHEN src = '' THEN ['source'] ELSE [] END FROM p),
findings AS (SELECT * FROM found WHERE len(missing) > 0)"""


@query("qua2_spec_rules", f"WITH {FOUND} SELECT component_id, rule, array_to_string(list_sort(missing), ',') AS missing FROM findings")
def qua2(t):
    return _spec_findings(t).select("component_id", "rule", F.array_join(F.array_sort("missing"), ",").alias("missing"))


@query("qua4_dismissals", f"WITH {FOUND} SELECT component_id, rule FROM findings WHERE NOT (component_id = 'src1' AND rule = 'wikiSpecCompleteness')")
def qua4(t):
    gone = t.spark.createDataFrame([("src1", "wikiSpecCompleteness")], "component_id string, rule string")
    return Q.without_dismissed(_spec_findings(t), gone).select("component_id", "rule")


@query("qua5_known_sources", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def qua5(t):
    pages = t.documents.select("doc_id", F.concat(F.lit("parsed/Doc"), "doc_id", F.lit(".md")).alias("source"))
    known = t.labels.select(F.concat(F.lit("gamedocs/x/doc"), "doc_id", F.lit(".docx")).alias("path"))
    return Q.known_sources(pages, known).select("doc_id")


@query("qua6_overall", f"WITH {FOUND} SELECT (SELECT floor(avg(quality) * 1000 + 0.5) / 1000 FROM labels) AS score, (SELECT count(*) FROM labels) AS pages, (SELECT count(*) FROM findings) AS findings")
def qua6(t):
    out = Q.overall(t.labels.select(F.col("quality").cast("double").alias("score")), _spec_findings(t))
    return out.withColumn("score", F.floor(F.col("score") * 1000 + 0.5) / 1000)


@query("qua7_repairs", f"""WITH {FOUND}, e AS (SELECT component_id, rule, unnest(missing) AS item FROM findings)
SELECT component_id, CASE rule WHEN 'wikiSpecCompleteness' THEN 'append_section' WHEN 'requiredFacts' THEN 'placeholder_fact' ELSE 'dismiss' END AS action,
CASE rule WHEN 'wikiSpecCompleteness' THEN '## ' || item || chr(10) || chr(10) || 'TBD' || chr(10) WHEN 'requiredFacts' THEN item || ': TBD' ELSE '' END AS payload FROM e""")
def qua7(t):
    return Q.repairs(_spec_findings(t))


@query("lin2_lint_issues", f"""WITH {TRUST}, {FEEDBACK}, pg AS (SELECT CAST(doc_id AS VARCHAR) AS component_id, 'p/' || doc_id AS path, doc_id FROM documents)
SELECT component_id, 'links' AS domain, 'warning' AS severity, 'p/' || (doc_id + 3) AS message FROM pg WHERE doc_id + 3 NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT component_id, 'table_dependencies', 'warning', 'none' FROM pg WHERE doc_id % 20 = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'graph', 'blocking', 'gone' FROM documents WHERE doc_id % 50 = 7
UNION ALL SELECT component_id, 'evidence', 'warning', 'no evidence' FROM pg WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT component_id, 'trust', 'blocking', CAST(trust_score AS VARCHAR) FROM trust WHERE trust_score < 0.55
UNION ALL SELECT component_id, 'mcp_feedback', 'info', CAST(count(*) AS VARCHAR) FROM feedback GROUP BY component_id HAVING count(*) >= 2""")
def lin2(t):
    d, cid = t.documents, F.col("doc_id").cast("string").alias("component_id")
    path = lambda n: F.concat(F.lit("p/"), F.col("doc_id") + n)
    return Q.lint_issues(
        d.select(cid, path(0).alias("path")), d.select(cid, path(3).alias("target")), d.select(F.col("source").alias("table")).distinct(),
        d.select(cid, F.when(F.col("doc_id") % 20 == 0, "none").otherwise(F.col("source")).alias("table")), d.where("doc_id % 50 = 7").select(F.col("doc_id").cast("string").alias("source"), F.lit("gone").alias("target")),
        t.labels.select(cid), _trust(t), _feedback(t),
    )


@query("lin5_remediation_queue", """SELECT CASE WHEN doc_id % 4 = 0 THEN 'done' WHEN doc_id % 5 >= 3 THEN 'failed' WHEN (doc_id % 100) / 100.0 < 0.85 THEN 'needs_human' ELSE 'pending' END AS status, count(*) AS n FROM documents GROUP BY ALL""")
def lin5(t):
    status = Q.remediation_status(F.col("doc_id") % 5, F.col("doc_id") % 4 == 0, (F.col("doc_id") % 100) / 100.0)
    return t.documents.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("lin6_alias_fixes", "SELECT 'a' || doc_id AS alias, source AS canonical FROM documents WHERE (doc_id % 100) / 100.0 >= 0.85 AND source <> 'src1' AND lang <> 'en'")
def lin6(t):
    alias = F.concat(F.lit("a"), "doc_id")
    proposals = t.documents.select(alias.alias("alias"), F.col("source").alias("canonical"), ((F.col("doc_id") % 100) / 100.0).alias("confidence"))
    tables = t.documents.where("source <> 'src1'").select(F.col("source").alias("table")).distinct()
    return Q.valid_alias_fixes(proposals, tables, t.documents.where("lang = 'en'").select(alias.alias("alias"))).select("alias", "canonical")


@query("rel5_auto_fixed_blockers", "SELECT doc_id AS task_id FROM labels WHERE toxic = 1 AND NOT (quality = 1 AND doc_id % 2 = 0)")
def rel5(t):
    tasks = t.labels.where("toxic = 1").select(F.col("doc_id").alias("task_id"))
    fixed = t.labels.where("quality = 1").select(F.col("doc_id").alias("task_id"), F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.5).alias("confidence"))
    return Q.unrelaxed(tasks, fixed)


@query("rel9_patch_reuse", f"WITH {V1}, {V2} SELECT v2.doc_id AS artifact_id, v2.hash FROM v2")
def rel9(t):
    v1, v2 = (v.withColumnRenamed("doc_id", "artifact_id") for v in _versions(t))
    changed = v2.join(v1.select("artifact_id", F.col("hash").alias("h1")), "artifact_id", "left").where("h1 IS NULL OR h1 <> hash").drop("h1")
    return Q.patch_pages(v1, changed, v1.join(v2, "artifact_id", "left_anti"))


@query("agg17_convergence", """SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS succeeded, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed,
(SELECT count(DISTINCT user_id) FROM events) AS subjects, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'error') AS failing_subjects, (SELECT max(event_id) FROM events WHERE event_type = 'error') AS last_failure,
(SELECT count(*) FROM labels WHERE quality = 0) AS open_tasks, (SELECT count(*) FROM labels WHERE quality = 0 AND toxic = 1) AS blocking_tasks, (SELECT count(*) FROM orders) AS builds, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS failed_builds,
(SELECT count(*) FILTER (event_type = 'error') / count(*) FROM events) AS exception_rate""")
def agg17(t):
    outcome = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("skipped")
    e = t.events.select("event_id", outcome.alias("outcome"), F.col("user_id").alias("subject"))
    tasks = t.labels.select(F.when(F.col("quality") == 0, "open").otherwise("done").alias("status"), F.when(F.col("toxic") == 1, "blocking").otherwise("info").alias("severity"))
    return B.convergence(e, tasks, t.orders.select(F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("state")))


@query("hlt4_annotation_effect", f"""WITH {FEEDBACK}, a AS (SELECT n_nationkey AS annotation_id, CAST(n_nationkey AS VARCHAR) AS component_id, TIMESTAMP '2024-01-15' AS t0 FROM nation)
SELECT annotation_id, count(*) FILTER (f.created_at < t0) AS n_before, count(*) FILTER (f.created_at > t0) AS n_after, count(*) FILTER (f.created_at > t0) > 0 AS recurred FROM a LEFT JOIN feedback f USING (component_id) GROUP BY ALL""")
def hlt4(t):
    a = t.nation.select(F.col("n_nationkey").alias("annotation_id"), F.col("n_nationkey").cast("string").alias("component_id"), F.lit("2024-01-15").cast("timestamp").alias("created_at"))
    return B.annotation_effect(a, _feedback(t))


@query("hlt6_exceptions", """SELECT 'task' AS kind, 'task:' || doc_id AS dedup_key, 'blocking' AS severity FROM labels WHERE toxic = 1 AND doc_id % 2 = 1 UNION ALL SELECT 'annotation', 'annotation:' || doc_id, 'warning' FROM labels WHERE quality = 0""")
def hlt6(t):
    key = F.col("doc_id").alias("key")
    parts = {"task": t.labels.where("toxic = 1").select(key, F.lit("blocking").alias("severity")), "annotation": t.labels.where("quality = 0").select(key, F.lit("warning").alias("severity"))}
    return B.exceptions(parts, t.labels.where("doc_id % 2 = 0").select(F.concat(F.lit("task:"), "doc_id").alias("dedup_key")))


@query("hlt7_workbench", """WITH i AS (SELECT lang AS kind, doc_id AS key, n_chars AS weight FROM documents), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY weight DESC, key) AS INT) AS position FROM i WHERE kind IN ('de', 'en', 'fr'))
SELECT kind, key, position, kind = 'de' AND position = 1 AS priority FROM r WHERE position <= 4""")
def hlt7(t):
    return B.workbench(t.documents.select(F.col("lang").alias("kind"), F.col("doc_id").alias("key"), F.col("n_chars").alias("weight")), ["de", "en", "fr"])


@query("cor3_rebind", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE md5(text) END AS bound_source_hash, CASE WHEN doc_id % 3 = 0 THEN 'retired' ELSE 'active' END AS state FROM documents""")
def cor3(t):
    c = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("source_path"), F.lit("old").alias("bound_source_hash"), F.when(F.col("doc_id") % 3 == 0, "retired").otherwise("pending_review").alias("state"))
    return B.rebind(c, t.documents.select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("hash"))).select("doc_id", "bound_source_hash", "state")


@query("cor4_list_order", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END, doc_id) AS INT) AS position FROM documents")
def cor4(t):
    state = F.when(F.col("doc_id") % 3 == 0, "retired").when(F.col("doc_id") % 3 == 1, "pending_review").otherwise("active")
    return t.documents.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(B.correction_order(state), "doc_id")).alias("position"))


@query("cor5_lifecycle", "SELECT event_id FROM events WHERE user_id = 7 OR json_extract_string(props, '$.k') = '7'")
def cor5(t):
    e = t.events.select("event_id", F.col("user_id").cast("string").alias("entity_id"), F.to_json(F.struct(F.get_json_object("props", "$.k").alias("correctionId"))).alias("payload"), F.col("ts").alias("created_at"))
    return B.lifecycle(e, "7").select("event_id")


@query("ret19_result_cards", f"""WITH {LEXICAL}, tr AS (SELECT CAST(doc_id AS VARCHAR) AS component_id, CAST(quality AS DOUBLE) AS trust_score FROM labels)
SELECT query_id, l.component_id, rank, title, type, trust_score, CASE WHEN trust_score < 0.7 THEN 'check evidence' WHEN rank = 1 THEN 'read page' ELSE 'compare' END AS next_step
FROM lexical_top l JOIN pages_ p USING (component_id) LEFT JOIN tr USING (component_id) WHERE rank <= 5""")
def ret19(t):
    trust = t.labels.select(F.col("doc_id").cast("string").alias("component_id"), F.col("quality").cast("double").alias("trust_score"))
    return B.cards(_lexical(t).where("rank <= 5"), S.pages(t), trust)


@query("ret21_topic_resolution", "SELECT 'entity' AS kind, 'nation:' || n_nationkey AS key, 1 AS position FROM nation WHERE n_nationkey = 5")
def ret21(t):
    nodes = t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return B.topic(" Nation:5 ", t.documents.select(F.col("source").alias("table")).distinct(), nodes, S.pages(t))


@query("doc9_page_tables", """SELECT CAST(doc_id AS VARCHAR) AS component_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS "table" FROM documents WHERE doc_id % 3 <> 1""")
def doc9(t):
    cid = F.col("doc_id").cast("string").alias("component_id")
    explicit = t.documents.where("doc_id % 3 < 2").select(cid, F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("table"))
    return B.page_tables(t.documents.select(cid), explicit, t.documents.select(cid, F.col("lang").alias("table")))


@query("doc10_hint_kinds", "SELECT CASE doc_id % 5 WHEN 0 THEN 'link' WHEN 1 THEN 'file' WHEN 2 THEN 'table_name' WHEN 3 THEN 'description' ELSE 'other' END AS kind, count(*) AS n FROM documents GROUP BY ALL")
def doc10(t):
    n = F.col("doc_id") % 5
    hint = F.when(n == 0, "https://x").when(n == 1, "a b.xlsx").when(n == 2, "Combat/Skill").when(n == 3, "技能 x").otherwise("a b")
    return t.documents.groupBy(B.unresolved_kind(hint).alias("kind")).agg(F.count("*").alias("n"))


@query("doc17_frozen_pages", "SELECT doc_id AS artifact_id, coalesce(toxic = 1, false) AS frozen, md5(CASE WHEN toxic = 1 THEN text ELSE text || '!' END) AS body FROM documents LEFT JOIN labels USING (doc_id)")
def doc17(t):
    new = t.documents.select(F.col("doc_id").alias("artifact_id"), F.concat("text", F.lit("!")).alias("body"))
    released = t.documents.select(F.col("doc_id").alias("artifact_id"), F.col("text").alias("body"))
    return B.frozen_pages(new, released, t.labels.where("toxic = 1").select(F.col("doc_id").alias("artifact_id"))).select("artifact_id", "frozen", F.md5("body").alias("body"))


@query("doc18_extract_cache", f"WITH {V1}, {V2} SELECT v2.doc_id, v1.hash IS NOT NULL AND v1.hash = v2.hash AS reuse FROM v2 LEFT JOIN v1 USING (doc_id)")
def doc18(t):
    v1, v2 = _versions(t)
    return B.incremental(v2, v1, "doc_id", "hash").select("doc_id", "reuse")


@query("doc23_page_lookup", "SELECT CAST(doc_id AS VARCHAR) AS component_id FROM documents WHERE doc_id IN (5, 12, 33)")
def doc23(t):
    asked = t.spark.createDataFrame([("5",), ("12.md",), ("33",)], "key string")
    return B.page_keys(S.pages(t)).join(F.broadcast(asked), "key", "left_semi").select("component_id").distinct()


@query("str9_automation_router", "SELECT CASE event_type WHEN 'view' THEN 'feedback' WHEN 'click' THEN 'release' ELSE 'remediation' END AS route, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY ALL")
def str9(t):
    kind = F.when(F.col("event_type") == "view", "agent.feedback_recorded").when(F.col("event_type") == "click", "build.completed").when(F.col("event_type") == "error", "exception.raised").otherwise("other")
    routed = B.automations(t.events.select("event_id", kind.alias("event_type")))
    out = None
    for name, df in routed.items():
        part = df.select(F.lit(name).alias("route"))
        out = part if out is None else out.union(part)
    return out.groupBy("route").agg(F.count("*").alias("n"))


@query("str11_task_policy", "SELECT doc_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'dismissed' WHEN quality = 0 THEN 'open' ELSE 'done' END AS status FROM labels")
def str11(t):
    tasks = t.labels.select("doc_id", F.when(F.col("quality") == 0, "open").otherwise("done").alias("status"), F.when(F.col("toxic") == 1, "blocking").otherwise("info").alias("severity"))
    return B.dismiss_info_tasks(tasks).select("doc_id", "status")
