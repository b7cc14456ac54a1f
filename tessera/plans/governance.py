"""Queries of trust, releases, lint, feedback, health and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.rounding import half_up
from tessera.operators import governance as G
from tessera.operators import relational as R
from tessera.operators import trust as T
from tessera.plans import standins as S
from tessera.plans.base import query
from tessera.plans.relational import V1, V2, _versions

NOW = "2024-01-31 00:00:00"
STATS = f"""{S.AUDIT_SQL},
stats AS (
  SELECT component_id, count(*) FILTER (tool_name = 'kb_search') AS searches, count(*) FILTER (tool_name = 'kb_get_page') AS clicks,
         count(*) FILTER (status = 'error') AS negatives, count(*) FILTER (event_type = 'purchase') AS attributions FROM audit GROUP BY ALL)"""
TRUST = f"""{S.COMPONENTS_SQL}, {STATS},
facts AS (
  SELECT c.*, s.searches, s.clicks, s.negatives, s.attributions,
         kind = 'wiki_page' AND NOT contains(path, '/concepts/') AS required,
         (quality IS NOT NULL)::INT AS evidence_rows, (c.doc_id % 4 <> 0)::INT AS source_refs,
         CASE WHEN c.doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-31' - INTERVAL (c.doc_id % 400) DAYS END AS audited,
         (coalesce(toxic, 0) = 1)::INT AS blocking, (c.doc_id % 11 = 0)::INT AS warning,
         CASE WHEN s.component_id IS NOT NULL THEN greatest(0.0, least(1.0, 0.5 + CASE WHEN attributions > 0 THEN 0.5 ELSE 0 END
           + CASE WHEN searches > 0 AND clicks > 0 THEN 0.5 * least(1.0, 2.0 * clicks / searches) ELSE 0 END - 0.15 * least(3, negatives))) END AS consumption,
         CASE WHEN contains(path, '/activities/') THEN 120 WHEN contains(path, '/tables/') OR contains(path, '/fields/') OR contains(kind, 'table') THEN 90
              WHEN contains(path, '/numeric_rules/') THEN 90 WHEN contains(path, '/systems/') OR contains(path, '/ui_flows/') THEN 180
              WHEN contains(path, '/concepts/') THEN 365 WHEN kind = 'graph_snapshot' THEN 120 ELSE 180 END AS days
  FROM components c LEFT JOIN stats s USING (component_id)),
dims AS (
  SELECT *, CASE WHEN NOT required THEN 1.0 ELSE greatest(0.0, least(1.0, 0.35 * (evidence_rows > 0)::INT + 0.25 * (source_refs > 0)::INT
           + 0.25 * CASE WHEN evidence_rows = 0 THEN 0.0 WHEN n_chars > 500 THEN 1.0 ELSE 0.6 END + 0.15 * CASE WHEN evidence_rows > 0 THEN CAST(quality AS DOUBLE) ELSE 0.0 END)) END AS evidence,
         coalesce(CASE WHEN doc_id % 6 = 0 THEN (doc_id % 10) / 10.0 END, CASE WHEN kind IN ('table_schema_json', 'graph_snapshot') THEN 0.75 ELSE 0.55 END) AS completeness,
         CASE WHEN audited IS NULL THEN 0.45 ELSE least(1.0, exp(-ln(2) * greatest(0.0, CAST(date_diff('day', audited, TIMESTAMP '2024-01-31') AS DOUBLE)) / days)) END AS freshness,
         greatest(0.0, least(1.0, 1 - (0.45 * blocking + 0.18 * warning))) AS consistency FROM facts),
raw AS (
  SELECT *, floor((CASE WHEN consumption IS NOT NULL THEN evidence * 0.3 + completeness * 0.2 + freshness * 0.15 + consistency * 0.15 + consumption * 0.2
    ELSE evidence * 0.35 + completeness * 0.25 + freshness * 0.2 + consistency * 0.2 END) * 1000 + 0.5) / 1000 AS raw_score,
    CASE WHEN blocking > 0 THEN 0.5 WHEN warning > 0 THEN 0.85 END AS c1,
    CASE WHEN required AND evidence_rows = 0 THEN CASE WHEN source_refs = 0 THEN 0.55 ELSE 0.7 END END AS c2,
    CASE WHEN audited IS NULL THEN 0.7 END AS c3, CASE WHEN completeness < 0.35 THEN 0.55 WHEN completeness < 0.5 THEN 0.65 END AS c4,
    CASE WHEN consistency < 0.6 THEN 0.65 END AS c5 FROM dims),
trust AS (
  SELECT *, floor(least(raw_score, c1, c2, c3, c4, c5) * 1000 + 0.5) / 1000 AS trust_score,
    coalesce(c1, c2, c3, c4, c5) IS NOT NULL AS capped, CASE WHEN consumption IS NULL THEN 'v2-lite' ELSE 'v3-consumption' END AS trust_version FROM raw)"""


def _stats(t):
    a = S.audit(t)
    return G.consumption_stats(a, a.where("event_type = 'purchase'"), a.where("status = 'error'"))


def _trust(t):
    c = S.components(t).join(_stats(t).withColumn("seen", F.lit(True)), "component_id", "left")
    audited = F.when(F.col("doc_id") % 3 != 0, F.lit(NOW).cast("timestamp") - F.make_dt_interval(days=(F.col("doc_id") % 400).cast("int")))
    c = c.withColumns({
        "required": T.evidence_required(F.col("path"), F.col("kind")), "evidence_rows": F.col("quality").isNotNull().cast("int"),
        "source_refs": (F.col("doc_id") % 4 != 0).cast("int"), "audited": audited, "blocking": (F.coalesce("toxic", F.lit(0)) == 1).cast("int"),
        "warning": (F.col("doc_id") % 11 == 0).cast("int"),
        "consumption": F.when(F.col("seen"), T.consumption_score(F.col("attributions"), F.col("searches"), F.col("clicks"), F.col("negatives"))),
    })
    c = c.withColumns({
        "evidence": T.evidence_score(F.col("required"), F.col("evidence_rows"), F.col("source_refs"), F.col("n_chars") > 500, F.col("quality").cast("double")),
        "completeness": T.completeness_score(F.when(F.col("doc_id") % 6 == 0, (F.col("doc_id") % 10) / 10.0), F.col("kind")),
        "freshness": T.freshness_score(F.col("audited"), F.lit(NOW), T.half_life(F.col("path"), F.col("kind"))),
        "consistency": T.consistency_score(F.col("blocking"), F.col("warning"), F.lit(0)),
    })
    return T.trust(c)


@query("agg14_consumption_stats", f"WITH {STATS} SELECT component_id, searches, clicks, negatives, attributions FROM stats")
def agg14(t):
    return _stats(t)


@query("tru1_trust_score", f"""WITH {TRUST} SELECT component_id, trust_score, trust_version,
CASE WHEN blocking > 0 OR trust_score < 0.55 THEN 'blocked' WHEN trust_score < 0.7 THEN 'needs_review' WHEN trust_score < 0.85 OR capped THEN 'usable_with_risk' ELSE 'trusted' END AS trust_status FROM trust""")
def tru1(t):
    return _trust(t).select("component_id", "trust_score", "trust_version", "trust_status")


@query("tru8_consumption_score", f"WITH {TRUST} SELECT component_id, floor(consumption * 1000 + 0.5) / 1000 AS consumption FROM trust WHERE consumption IS NOT NULL")
def tru8(t):
    return _trust(t).where("consumption IS NOT NULL").select("component_id", half_up(F.col("consumption")).alias("consumption"))


@query("tru5_freshness", f"WITH {TRUST} SELECT component_id, days, floor(freshness * 1e6 + 0.5) / 1e6 AS freshness FROM trust")
def tru5(t):
    return _trust(t).select("component_id", T.half_life(F.col("path"), F.col("kind")).alias("days"), half_up(F.col("freshness"), 6).alias("freshness"))


@query("tru10_envelope_level", f"WITH {TRUST} SELECT package_id, CASE WHEN avg(trust_score) >= 0.8 THEN 'high' WHEN avg(trust_score) >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM trust GROUP BY ALL")
def tru10(t):
    return _trust(t).groupBy("package_id").agg(T.level(F.avg("trust_score")).alias("level"))


@query("tru11_quality_flags", f"WITH {TRUST} SELECT component_id, concat_ws(',', CASE WHEN trust_score < 0.7 THEN 'low_trust' END, CASE WHEN evidence_rows = 0 THEN 'evidence_missing' END) AS flags FROM trust")
def tru11(t):
    return _trust(t).select("component_id", F.array_join(T.quality_flags(F.col("trust_score"), F.col("evidence_rows")), ",").alias("flags"))


PLAN = f"""{V1}, {V2}, changes AS (SELECT doc_id, CASE WHEN v1.hash IS NULL THEN 'added' WHEN v2.hash IS NULL THEN 'removed' WHEN v1.hash <> v2.hash THEN 'modified' ELSE 'unchanged' END AS change FROM v1 FULL JOIN v2 USING (doc_id))"""


@query("snp2_build_plan", f"""WITH {PLAN}, n AS (SELECT count(*) FILTER (change IN ('added', 'modified')) AS targets, count(*) FILTER (change = 'removed') AS removed FROM changes)
SELECT CASE WHEN removed > 0 OR targets = 0 OR targets > 12 THEN 'full' ELSE 'incremental' END AS mode, targets, removed FROM n""")
def snp2(t):
    return G.build_plan(R.full_diff(*_versions(t), "doc_id", "hash"))


@query("snp1_correction_drift", f"WITH {V1}, {V2} SELECT v1.doc_id FROM v1 LEFT JOIN v2 USING (doc_id) JOIN documents d ON d.doc_id = v1.doc_id WHERE lang = 'en' AND v1.hash IS DISTINCT FROM v2.hash")
def snp1(t):
    v1, v2 = _versions(t)
    corrections = v1.join(t.documents.where("lang = 'en'").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("doc_id").cast("string").alias("source_path"), F.col("hash").alias("bound_source_hash"), F.lit("active").alias("state"))
    return G.drifted(corrections, v2.select(F.col("doc_id").cast("string").alias("path"), "hash")).select("doc_id")


RELEASES = f"""{V1}, {V2}, rdiff AS (SELECT 'artifact-' || doc_id AS artifact_id, CASE WHEN v1.hash IS NULL THEN 'added' WHEN v2.hash IS NULL THEN 'removed' WHEN v1.hash <> v2.hash THEN 'changed' ELSE 'unchanged' END AS change FROM v1 FULL JOIN v2 USING (doc_id))"""


def _releases(t):
    v1, v2 = _versions(t)
    name = lambda df: df.select(F.concat(F.lit("artifact-"), "doc_id").alias("artifact_id"), F.col("hash").alias("content_hash"), "doc_id")
    return name(v1), name(v2)


@query("rel1_release_diff", f"WITH {RELEASES} SELECT artifact_id, change FROM rdiff")
def rel1(t):
    return G.release_diff(*_releases(t))


@query("join13_release_diff_counts", f"WITH {RELEASES} SELECT change, count(*) AS n FROM rdiff GROUP BY ALL")
def join13(t):
    return G.release_diff(*_releases(t)).groupBy("change").agg(F.count("*").alias("n"))


DECLINES = """old AS (SELECT 'artifact-' || doc_id AS artifact_id, CASE WHEN doc_id % 13 <> 0 THEN (doc_id % 100) / 100.0 END AS previous FROM v1),
new AS (SELECT 'artifact-' || doc_id AS artifact_id, CASE WHEN doc_id % 17 <> 0 THEN ((doc_id * 7) % 100) / 100.0 END AS next FROM v2),
declines AS (SELECT n.artifact_id, previous, next FROM new n JOIN rdiff USING (artifact_id) LEFT JOIN old o USING (artifact_id)
WHERE change IN ('added', 'changed') AND (next IS NULL OR (o.artifact_id IS NOT NULL AND (previous IS NULL OR next + 0.0001 < previous))))"""


def _declines(t):
    a, b = _releases(t)
    old = a.select("artifact_id", F.when(F.col("doc_id") % 13 != 0, (F.col("doc_id") % 100) / 100.0).alias("score"))
    new = b.select("artifact_id", F.when(F.col("doc_id") % 17 != 0, ((F.col("doc_id") * 7) % 100) / 100.0).alias("score"))
    return G.trust_declines(old, new, G.release_diff(a, b).where("change IN ('added', 'changed')"))


@query("rel2_trust_declines", f"WITH {RELEASES}, {DECLINES} SELECT artifact_id, CAST(previous AS DOUBLE) AS previous, CAST(next AS DOUBLE) AS next FROM declines")
def rel2(t):
    return _declines(t)


@query("rel3_quality_regression", "SELECT (SELECT avg(quality) FROM labels WHERE doc_id % 2 = 1) + 0.005 < (SELECT avg(quality) FROM labels WHERE doc_id % 2 = 0) OR (SELECT count(*) FROM labels WHERE doc_id % 2 = 1 AND toxic = 1) > (SELECT count(*) FROM labels WHERE doc_id % 2 = 0 AND toxic = 1) AS regressed")
def rel3(t):
    frame = lambda odd: t.labels.where(F.col("doc_id") % 2 == odd).agg(F.avg("quality").alias("average"), F.count_if(F.col("toxic") == 1).alias("blocking"))
    return G.quality_regressed(frame(0), frame(1))


@query("rel4_publish_gate", f"""WITH {RELEASES}, {DECLINES}
SELECT 1 AS position, 'removed_components_present' AS reason WHERE (SELECT count(*) FROM rdiff WHERE change = 'removed') > 0
UNION ALL SELECT 2, 'no_component_changes' WHERE (SELECT count(*) FROM rdiff WHERE change IN ('added', 'changed')) = 0
UNION ALL SELECT 4, 'trust_score_declined_or_missing' WHERE (SELECT count(*) FROM declines) > 0
UNION ALL SELECT 9, 'retrieval_eval_regression' WHERE 0.8 + 1e-9 < 0.85""")
def rel4(t):
    a, b = _releases(t)
    diff = G.release_diff(a, b).agg(F.count_if(F.col("change") == "removed").alias("removed"), F.count_if(F.col("change").isin("added", "changed")).alias("changed"))
    facts = diff.join(F.broadcast(_declines(t).agg(F.count("*").alias("declines"))), F.lit(True))
    fixed = {"parent": F.lit("r1"), "block_on_deletes": F.lit(True), "blocking_tasks": F.lit(0), "block_on_trust_decline": F.lit(True), "block_on_corrections": F.lit(True), "pending_corrections": F.lit(0), "below_min_trust": F.lit(0), "block_on_regression": F.lit(True), "regressed": F.lit(False), "lint_unresolved": F.lit(0), "hit_at_k": F.lit(0.8), "min_hit_at_k": F.lit(0.85), "citation": F.lit(1.0), "min_citation": F.lit(0.0), "binding_ok": F.lit(True)}
    return G.gate_reasons(facts.withColumns(fixed))


@query("rel6_evidence_backfill", f"""WITH {S.COMPONENTS_SQL}, bare AS (SELECT component_id, unnest(['gamedocs/' || path, 'gamedata/' || source]) AS ref, generate_subscripts([1, 2], 1) - 1 AS p FROM components WHERE quality IS NULL)
SELECT component_id, ref, 0.7 AS confidence, sha1(component_id || ':' || ref || ':' || p) AS evidence_id FROM bare""")
def rel6(t):
    c = S.components(t)
    refs = c.withColumn("source_refs", F.array(F.concat(F.lit("gamedocs/"), "path"), F.concat(F.lit("gamedata/"), "source")))
    return G.evidence_backfill(refs, c.where("quality IS NOT NULL"))


@query("rel8_release_audit", f"WITH {TRUST} SELECT trust_status, count(*) AS n, floor(avg(trust_score) * 1000 + 0.5) / 1000 AS avg_score, min(trust_score) AS min_score FROM (SELECT *, CASE WHEN blocking > 0 OR trust_score < 0.55 THEN 'blocked' WHEN trust_score < 0.7 THEN 'needs_review' WHEN trust_score < 0.85 OR capped THEN 'usable_with_risk' ELSE 'trusted' END AS trust_status FROM trust) GROUP BY ALL")
def rel8(t):
    return _trust(t).groupBy("trust_status").agg(F.count("*").alias("n"), half_up(F.avg("trust_score")).alias("avg_score"), F.min("trust_score").alias("min_score"))


@query("rel10_component_id", f"WITH {S.COMPONENTS_SQL} SELECT component_id, 'cmp_' || package_id || '_' || regexp_replace(path, '[^A-Za-z0-9]+', '_', 'g') || '_' || substr(sha1(package_id || ':' || path), 1, 10) AS stable_id FROM components")
def rel10(t):
    return S.components(t).select("component_id", G.component_id(F.col("package_id"), F.col("path")).alias("stable_id"))


LINT = """issues AS (SELECT doc_id, ['links', 'table_dependencies', 'graph', 'evidence', 'trust', 'mcp_feedback'][doc_id % 6 + 1] AS domain,
['blocking', 'warning', 'info'][doc_id % 3 + 1] AS severity, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) END AS component_id, source FROM documents)"""


def _issues(t):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % n + 1).cast("int"))
    domains = ["links", "table_dependencies", "graph", "evidence", "trust", "mcp_feedback"]
    return t.documents.select("doc_id", "source", pick(domains, 6).alias("domain"), pick(["blocking", "warning", "info"], 3).alias("severity"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("component_id"))


@query("lin3_lint_score", f"WITH {LINT} SELECT doc_id, floor((1 - least(1e0, 2e-1 * count(*) FILTER (severity = 'blocking') + 3.5e-2 * count(*) FILTER (severity = 'warning') + 1e-2 * count(*) FILTER (severity = 'info'))) * 100 + 0.5) / 100 AS score FROM issues GROUP BY ALL")
def lin3(t):
    n = lambda s: F.count_if(F.col("severity") == s)
    return _issues(t).groupBy("doc_id").agg(G.lint_score(n("blocking"), n("warning"), n("info")).alias("score"))


@query("lin4_fallback_action", f"""WITH {LINT} SELECT doc_id, CASE WHEN domain = 'links' AND severity <> 'blocking' THEN 'auto_remediation' WHEN domain = 'table_dependencies' AND component_id IS NOT NULL THEN 'auto_remediation'
WHEN domain IN ('graph', 'evidence', 'trust') THEN 'rebuild' WHEN domain = 'mcp_feedback' THEN 'manual_review' WHEN severity = 'info' THEN 'monitor' ELSE 'manual_review' END AS action FROM issues""")
def lin4(t):
    return _issues(t).select("doc_id", G.fallback_action(F.col("domain"), F.col("severity"), F.col("component_id")).alias("action"))


FEEDBACK = """feedback AS (SELECT event_id, 'p1' AS project_id, CASE WHEN event_type = 'error' THEN 'tool_error' WHEN event_type = 'view' THEN 'miss' ELSE 'low_quality_hit' END AS feedback_type,
user_id || ':' || CAST(json_extract(props, '$.k') AS INT) % 10 AS query, CAST(json_extract(props, '$.k') AS VARCHAR) AS component_id, ts AS created_at FROM events WHERE event_type IN ('error', 'view', 'signup'))"""


def _feedback(t):
    k = F.get_json_object("props", "$.k")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "miss").otherwise("hit")
    kind = G.feedback_type(status, F.array(F.lit("low_quality:x")))
    return t.events.where("event_type IN ('error', 'view', 'signup')").select("event_id", F.lit("p1").alias("project_id"), kind.alias("feedback_type"), F.concat_ws(":", "user_id", (k.cast("int") % 10)).alias("query"), k.alias("component_id"), F.col("ts").cast("timestamp").alias("created_at"), F.lit("").alias("expected"))


@query("str3_feedback_rules", f"WITH {FEEDBACK} SELECT feedback_type, count(*) AS n FROM feedback GROUP BY ALL")
def str3(t):
    return _feedback(t).groupBy("feedback_type").agg(F.count("*").alias("n"))


@query("str4_repeat_escalation", f"""WITH {FEEDBACK}, n AS (SELECT *, row_number() OVER (PARTITION BY project_id, query, feedback_type ORDER BY created_at, event_id) AS r FROM feedback)
SELECT event_id, CASE WHEN feedback_type = 'miss' AND r >= 3 THEN 'repeated_query' ELSE feedback_type END AS stored_type, CASE WHEN r >= 3 THEN 'blocking' ELSE 'warning' END AS severity FROM n""")
def str4(t):
    return G.escalate(_feedback(t), ["project_id", "query"], ["created_at", "event_id"]).select("event_id", "stored_type", "severity")


@query("str5_cluster_keys", f"""WITH RECURSIVE {FEEDBACK}, size AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
asked AS (SELECT event_id, feedback_type, query, created_at, CAST(split_part(query, ':', 1) AS BIGINT) % 64 AS project, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
  row_number() OVER (PARTITION BY CAST(split_part(query, ':', 1) AS BIGINT) % 64, feedback_type ORDER BY created_at, event_id) AS rn
  FROM feedback CROSS JOIN size LEFT JOIN embeddings ON vec_id = CAST(split_part(query, ':', 1) AS BIGINT) % n),
near AS (
  SELECT a.event_id, b.event_id AS parent, CASE WHEN a.query = b.query THEN 1e9 ELSE coalesce(floor(list_inner_product(a.v, b.v) * 1e9 + 0.5), 0) END AS s, b.rn
  FROM asked a JOIN asked b ON a.project = b.project AND a.feedback_type = b.feedback_type AND b.rn BETWEEN a.rn - 50 AND a.rn - 1 AND a.created_at - b.created_at < INTERVAL 91 DAY),
links AS (SELECT event_id, parent FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, rn DESC) AS r FROM near WHERE s >= 850000000) WHERE r = 1),
steps AS (
  SELECT event_id, event_id AS at FROM asked
  UNION ALL SELECT s.event_id, l.parent FROM steps s JOIN links l ON l.event_id = s.at)
SELECT s.event_id, f.query AS cluster_key FROM steps s JOIN feedback f ON f.event_id = s.at WHERE s.at NOT IN (SELECT event_id FROM links)""")
def str5(t):
    # every user has one of all vectors, and is dealt to a project
    n = t.embeddings.agg((F.max("vec_id") + 1).alias("n"))
    vectors = t.embeddings.groupBy(F.col("vec_id").alias("slot")).agg(F.first(F.transform("embedding", lambda x: x.cast("double"))).alias("vector"))
    user = F.split("query", ":")[0].cast("long")
    asked = _feedback(t).join(F.broadcast(n), F.lit(True)).withColumn("slot", F.pmod(user, F.col("n"))).drop("n")
    project = F.concat(F.lit("p"), F.pmod(user, F.lit(64)))
    return G.cluster_keys(asked.withColumn("project_id", project).join(vectors, "slot", "left").drop("slot")).select("event_id", "cluster_key")


@query("str6_gap_candidates", f"""WITH {FEEDBACK} SELECT query AS query_key, count(*) AS event_count, CASE WHEN count(*) >= 3 THEN 'dismissed' ELSE 'open' END AS status FROM feedback WHERE feedback_type = 'miss' GROUP BY query""")
def str6(t):
    return G.gap_candidates(_feedback(t).where("feedback_type = 'miss'").withColumn("query_key", F.col("query"))).select("query_key", "event_count", "status")


@query("str7_rebuild_proposals", f"WITH {FEEDBACK} SELECT component_id, count(*) AS negatives FROM feedback WHERE component_id NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation) GROUP BY ALL HAVING count(*) >= 2")
def str7(t):
    return G.rebuild_proposals(_feedback(t), t.nation.select(F.col("n_nationkey").cast("string").alias("component_id")))


@query("agg15_feedback_clusters", f"WITH {FEEDBACK} SELECT feedback_type, query AS cluster_key, count(*) AS n, count(DISTINCT component_id) AS components FROM feedback GROUP BY ALL")
def agg15(t):
    return _feedback(t).groupBy("feedback_type", F.col("query").alias("cluster_key")).agg(F.count("*").alias("n"), F.count_distinct("component_id").alias("components"))


@query("str8_cluster_promotion", f"WITH {FEEDBACK} SELECT feedback_type, query, count(*) AS n FROM feedback GROUP BY ALL HAVING count(*) >= 4")
def str8(t):
    return _feedback(t).groupBy("feedback_type", "query").agg(F.count("*").alias("n")).where("n >= 4")


@query("str12_unsuperseded_skips", """WITH s AS (SELECT user_id, max(event_id) AS skipped FROM events WHERE event_type = 'error' GROUP BY ALL), ok AS (SELECT user_id, max(event_id) AS done FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT user_id, skipped FROM s LEFT JOIN ok USING (user_id) WHERE done IS NULL OR done < skipped""")
def str12(t):
    last = lambda kind, name: t.events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("event_id").alias(name))
    return last("error", "skipped").join(last("purchase", "done"), "user_id", "left").where("done IS NULL OR done < skipped").select("user_id", "skipped")


@query("str13_span_times", """WITH a AS (SELECT user_id AS span_id, min(ts) AS began FROM events WHERE event_type = 'view' GROUP BY ALL), b AS (SELECT user_id AS span_id, arg_min(event_type, ts) AS outcome, min(ts) AS ended FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL)
SELECT span_id, (epoch_us(ended) - epoch_us(began)) // 1000 AS ms, coalesce(outcome, 'running') AS outcome FROM a LEFT JOIN b USING (span_id) WHERE ended >= began""")
def str13(t):
    spans = t.events.where("event_type IN ('view', 'purchase', 'error')").select(F.col("user_id").alias("span_id"), F.when(F.col("event_type") == "view", "started").otherwise(F.col("event_type")).alias("phase"), "ts")
    return G.span_times(spans).where("ms >= 0")


@query("hlt1_health_check", f"""WITH {TRUST}
SELECT component_id, trust_score < 0.7 AS low_trust, coalesce(date_diff('day', audited, TIMESTAMP '2024-01-31') > 180, true) AS stale_audit,
coalesce(searches, 0) + coalesce(clicks, 0) + coalesce(attributions, 0) = 0 AND doc_id % 60 > 30 AS unused FROM trust""")
def hlt1(t):
    c = _trust(t).withColumn("published", F.lit(NOW).cast("timestamp") - F.make_dt_interval(days=(F.col("doc_id") % 60).cast("int")))
    return G.health(c.drop("searches", "clicks", "negatives", "attributions"), _stats(t), F.lit(NOW).cast("timestamp"))


@query("hlt2_zero_consumption", f"WITH {S.COMPONENTS_SQL}, {STATS} SELECT component_id FROM components WHERE component_id NOT IN (SELECT component_id FROM stats) AND toxic IS DISTINCT FROM 1")
def hlt2(t):
    c = S.components(t).select("component_id", "toxic")
    return c.join(_stats(t), "component_id", "left_anti").join(c.where("toxic = 1"), "component_id", "left_anti").select("component_id")


@query("hlt3_flywheel_state", """SELECT source, CASE WHEN min(doc_id) IS NULL THEN 'no_release' WHEN count(*) FILTER (n_chars > 60000) > 0 THEN 'build_failed' WHEN count(*) FILTER (toxic = 1) > 2 THEN 'blocked'
WHEN count(*) FILTER (quality = 0) > 3 THEN 'review' WHEN count(*) FILTER (quality IS NULL) > 40 THEN 'stale' ELSE 'healthy' END AS state FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def hlt3(t):
    n = F.count_if
    state = G.flywheel_state(F.min("doc_id"), n(F.col("n_chars") > 60000), F.greatest(n(F.col("toxic") == 1) - 2, F.lit(0)), F.greatest(n(F.col("quality") == 0) - 3, F.lit(0)), F.greatest(n(F.col("quality").isNull()) - 40, F.lit(0)))
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(state.alias("state"))


@query("att1_segment_class", """WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 1 ELSE 0 END AS e, CASE WHEN turn % 4 IN (0, 1) THEN 1 ELSE 0 END AS c, role <> 'user' AS claims FROM conversations),
k AS (SELECT *, CASE WHEN e > 0 THEN 'quoted' WHEN c > 0 THEN 'derived' WHEN NOT claims THEN 'undecided' ELSE 'invented' END AS class FROM s)
SELECT conv_id, turn, class, class IN ('invented', 'undecided') OR (class = 'derived' AND e = 0) AS writeback FROM k""")
def att1(t):
    none = F.array().cast("array<string>")
    c = t.conversations.select("conv_id", "turn", "role", F.when(F.col("turn") % 4 == 0, F.array(F.lit("e"))).otherwise(none).alias("e"), F.when((F.col("turn") % 4).isin(0, 1), F.array(F.lit("c"))).otherwise(none).alias("c"))
    kinds = c.withColumn("class", G.segment_class(F.col("e"), F.col("c"), F.col("role") != "user"))
    return kinds.select("conv_id", "turn", "class", G.needs_writeback(F.col("class"), F.col("e")).alias("writeback"))


@query("cor2_target_resolution", f"""WITH {S.COMPONENTS_SQL}, w AS (SELECT doc_id AS request, CASE doc_id % 3 WHEN 0 THEN component_id WHEN 1 THEN path ELSE upper(path) END AS target FROM components)
SELECT request, CAST(request AS VARCHAR) AS component_id, CAST(CASE request % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INT) AS step FROM w""")
def cor2(t):
    c = S.components(t)
    wanted = c.select(F.col("doc_id").alias("request"), F.when(F.col("doc_id") % 3 == 0, F.col("component_id")).when(F.col("doc_id") % 3 == 1, F.col("path")).otherwise(F.upper("path")).alias("target"))
    return G.resolve_target(c.select("component_id", "path"), wanted)


@query("cor1_submit_correction", """WITH old AS (SELECT doc_id AS correction_id, 'active' AS state FROM documents WHERE n_chars < 2000), fresh AS (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE NOT (n_chars < 2000 AND toxic = 0))
SELECT correction_id, CASE WHEN correction_id IN (SELECT doc_id FROM fresh) THEN 'retired' ELSE state END AS state FROM old UNION ALL SELECT doc_id + 1000000000, 'pending_review' FROM fresh""")
def cor1(t):
    row = lambda df, shift, mark: df.select((F.col("doc_id") + shift).alias("correction_id"), F.lit("p1").alias("project_id"), F.col("source").alias("source_path"), F.col("doc_id").cast("string").alias("rule_id"), F.lit("k").alias("fact_key"), mark.alias("fingerprint"), F.lit("active").alias("state"), F.lit(NOW).cast("timestamp").alias("created_at"))
    old = row(t.documents.where("n_chars < 2000"), 0, F.lit("a"))
    new = row(t.documents.join(t.labels, "doc_id"), 1000000000, F.when(F.col("toxic") == 0, "a").otherwise("b"))
    return G.submit_correction(old, new).select("correction_id", "state")
