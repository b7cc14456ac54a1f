"""Queries of publishing: trust scored anew, nested names, profiles and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import publishing as P
from tessera.plans import governance as GP
from tessera.plans import standins as S
from tessera.plans.base import query

NOW = GP.NOW


@query("tru9_publish_scores", f"""WITH {GP.TRUST},
fresh AS (
  SELECT component_id, floor((CASE WHEN consumption IS NOT NULL THEN evidence * 0.3 + completeness * 0.2 + 0.15 + consistency * 0.15 + consumption * 0.2
    ELSE evidence * 0.35 + completeness * 0.25 + 0.2 + consistency * 0.2 END) * 1000 + 0.5) / 1000 AS raw2, c1, c2, c4, c5, blocking FROM trust WHERE doc_id % 4 = 1),
scored AS (SELECT component_id, floor(least(raw2, c1, c2, c4, c5) * 1000 + 0.5) / 1000 AS after, coalesce(c1, c2, c4, c5) IS NOT NULL AS capped2, blocking FROM fresh)
SELECT t.component_id, t.trust_score AS before, coalesce(s.after, t.trust_score) AS trust_score,
  CASE WHEN t.blocking > 0 OR coalesce(s.after, t.trust_score) < 0.55 THEN 'blocked' WHEN coalesce(s.after, t.trust_score) < 0.7 THEN 'needs_review' WHEN coalesce(s.after, t.trust_score) < 0.85 OR coalesce(s.capped2, t.capped) THEN 'usable_with_risk' ELSE 'trusted' END AS trust_status,
  s.component_id IS NOT NULL AS recomputed, s.component_id IS NOT NULL AND abs(s.after - t.trust_score) >= 0.05 AS event, floor((coalesce(s.after, t.trust_score) - t.trust_score) * 1000 + 0.5) / 1000 AS delta
FROM trust t LEFT JOIN scored s USING (component_id)""")
def tru9_scores(t):
    """A quarter of the components is published; the rest keeps its stored trust."""
    inputs = GP._trust(t).drop("trust_score", "trust_status", "trust_version")
    changed = t.documents.where("doc_id % 4 = 1").select(F.col("doc_id").cast("string").alias("component_id"))
    return P.republish(inputs, GP._trust(t), changed, F.lit(NOW))


@query("doc15_nested_names", """WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS component_id, 'Page ' || doc_id AS title, CAST(substr(source, 4) AS INT) AS s, doc_id % 4 AS k, lang FROM documents),
t AS (SELECT *, 'Table/' || s AS own, 'Table/' || ((s + 1) % 20) AS next, 'Table/' || ((s + 2) % 20) AS dep FROM p),
m AS (SELECT *, list_sort(list_distinct(list_filter([CASE WHEN k = 0 THEN own END, CASE WHEN k <> 3 THEN next END, CASE WHEN k = 2 THEN dep END], lambda x: x IS NOT NULL))) AS tables FROM t)
SELECT component_id, array_to_string(tables, ', ') AS config_table,
  CASE WHEN k = 3 THEN lang || ':concept' ELSE next || ':config_table' END || CASE WHEN k = 0 THEN ';' || own || ':config_table' ELSE '' END || CASE WHEN k = 2 THEN ';' || dep || ':config_table' ELSE '' END AS entities,
  CASE WHEN k = 1 THEN title || ' configured_in ' || next ELSE lang || ' uses ' || CASE WHEN k = 3 THEN lang ELSE next END END
    || coalesce(';' || nullif(array_to_string(list_transform(CASE WHEN k = 1 THEN [] ELSE tables END, lambda x: title || ' configured_in ' || x), ';'), ''), '') AS relationships FROM m""")
def doc15_nested(t):
    """Names of tables in facts, entities, relationships and dependencies, written in many ways; pages of one kind mean none."""
    s = F.substring("source", 4, 9).cast("int")
    k = F.col("doc_id") % 4
    ref = lambda n, form: F.concat(F.lit(form), ((s + n) % 20).cast("string"))
    title = F.concat(F.lit("Page "), "doc_id")
    entity = F.when(k == 3, F.struct(F.col("lang").alias("name"), F.lit("concept").alias("type"))).otherwise(F.struct(ref(1, "TABLE ").alias("name"), F.lit("thing").alias("type")))
    relation = F.when(k == 1, F.struct(title.alias("source"), F.lit("configured_in").alias("relation"), ref(1, "alias-").alias("target"))).otherwise(F.struct(F.col("lang").alias("source"), F.lit("uses").alias("relation"), F.when(k == 3, F.col("lang")).otherwise(ref(1, "alias-")).alias("target")))
    pages = t.documents.select(
        F.col("doc_id").cast("string").alias("component_id"), title.alias("title"),
        F.when(k == 0, F.create_map(F.lit("config_table"), F.concat(ref(0, "alias "), F.lit("，nothing")))).otherwise(F.create_map(F.lit("unit"), F.lit("x"))).alias("facts"),
        F.array(entity).alias("entities"), F.array(relation).alias("relationships"), F.when(k == 2, F.array(ref(2, "table_"), F.lit("none"))).otherwise(F.array().cast("array<string>")).alias("dependencies"),
    )
    n = t.documents.select(s.alias("n")).distinct().select(F.explode(F.array(*((F.col("n") + i) % 20 for i in range(3)))).alias("n")).distinct()
    aliases = n.select(F.concat(F.lit("Table/"), "n").alias("table"), F.concat(F.lit("Alias "), "n").alias("alias"))
    out = P.normalise_pages(pages, aliases)
    return out.select(
        "component_id", F.coalesce(F.try_element_at("facts", F.lit("config_table")), F.lit("")).alias("config_table"),
        F.array_join(F.transform("entities", lambda e: F.concat(e["name"], F.lit(":"), e["type"])), ";").alias("entities"),
        F.array_join(F.transform("relationships", lambda r: F.concat_ws(" ", r["source"], r["relation"], r["target"])), ";").alias("relationships"),
    )


#: The fields of a governance profile, their types and bounds, and what holds without a project's own.
FIELDS = [
    P.Field("trust.minAutoPublishScore", "number", 0, 1), P.Field("trust.requireEvidence", "bool"), P.Field("trust.maxAuditAgeDays", "int", 1, 3650),
    P.Field("lint.autoGovernanceEnabled", "bool"), P.Field("lint.autoEligibleThreshold", "number", 0, 1),
    P.Field("release.autoPublishMode", "choice", values=("off", "guarded", "always")), P.Field("release.blockOnDeletes", "bool"),
    P.Field("feedback.highFrequencyThreshold", "int", 1, 100), P.Field("eval.goldPath", "text"), P.Field("eval.minHitAtK", "number", 0, 1),
]
DEFAULTS = '{"trust":{"minAutoPublishScore":0.7,"requireEvidence":true,"maxAuditAgeDays":90},"lint":{"autoGovernanceEnabled":true,"autoEligibleThreshold":0.85},"release":{"autoPublishMode":"guarded","blockOnDeletes":true},"feedback":{"highFrequencyThreshold":3},"eval":{"goldPath":"gold.json","minHitAtK":0.85}}'


@query("hlt5_profile_merge", """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer)
SELECT CAST(k AS VARCHAR) AS project_id, '{"eval":{"goldPath":"' || CASE WHEN k % 5 = 0 THEN 'p' || k ELSE 'gold.json' END || '","minHitAtK":0.85},"feedback":{"highFrequencyThreshold":' || CASE WHEN k % 2 = 0 THEN least(greatest(n * 10, 1), 100) ELSE 3 END
 || '},"lint":{"autoEligibleThreshold":' || CASE WHEN k % 3 = 0 THEN '1.0' ELSE '0.85' END || ',"autoGovernanceEnabled":true},"release":{"autoPublishMode":"' || CASE WHEN k % 7 = 1 AND k % 5 <> 0 THEN 'always' ELSE 'guarded' END || '","blockOnDeletes":' || CASE WHEN k % 3 = 1 THEN 'false' ELSE 'true' END
 || '},"trust":{"maxAuditAgeDays":' || CASE WHEN k % 5 = 0 AND k % 4 <> 3 THEN n + 1 ELSE 90 END || ',"minAutoPublishScore":0.7,"requireEvidence":true}}' AS config FROM c""")
def hlt5_merge(t):
    """Defaults, a project's own values and a patch: each sets some fields, some of the wrong type, out of bounds, unknown, or no record at all."""
    c = t.customer.select(F.col("c_custkey").cast("string").alias("project_id"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    own = F.concat(
        F.lit('{"feedback":{"highFrequencyThreshold":'), F.when(F.col("k") % 2 == 0, (F.col("n") * 10).cast("string")).otherwise('"5"'), F.lit('},"lint":'),
        F.when(F.col("k") % 3 == 0, '{"autoEligibleThreshold":7}').otherwise('"on"'), F.lit(',"release":{"blockOnDeletes":'), F.when(F.col("k") % 3 == 1, "false").otherwise("0"), F.lit(',"mode":{"x":1}}}'),
    )
    patch = F.when(F.col("k") % 5 == 0, F.concat(F.lit('{"trust":{"maxAuditAgeDays":'), F.when(F.col("k") % 4 == 3, '"x"').otherwise((F.col("n") + 0.6).cast("string")), F.lit('},"eval":{"goldPath":"p'), "k", F.lit('"}}')))
    patch = patch.when(F.col("k") % 7 == 1, '{"release":{"autoPublishMode":"always"}}').when(F.col("k") % 7 == 2, '{"release":{"autoPublishMode":"never"}}').otherwise("[1]")
    levels = F.array(F.struct(F.lit(0).alias("level"), F.lit(DEFAULTS).alias("config")), *(F.struct(F.lit(n).alias("level"), c.alias("config")) for n, c in ((1, own), (2, patch))))
    return P.nested(P.merge_profiles(c.select("project_id", F.inline(levels).alias("level", "config")), FIELDS), deepest=max(f.path.count(".") + 1 for f in FIELDS))


@query("qua8_profile_values", """SELECT path, level, count(*) AS n FROM (
SELECT 'trust.minAutoPublishScore' AS path, 0 AS level FROM customer UNION ALL SELECT 'release.blockOnDeletes', CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE 0 END FROM customer) GROUP BY ALL""")
def qua8(t):
    """Where each field's value comes from: the defaults or the project."""
    own = F.when(F.col("c_custkey") % 3 == 1, '{"release":{"blockOnDeletes":false}}').otherwise("{}")
    levels = F.array(F.struct(F.lit(0).alias("level"), F.lit(DEFAULTS).alias("config")), F.struct(F.lit(1).alias("level"), own.alias("config")))
    rows = t.customer.select(F.col("c_custkey").alias("project_id"), F.inline(levels).alias("level", "config"))
    return P.merge_profiles(rows, [FIELDS[0], FIELDS[6]]).groupBy("path", "level").agg(F.count("*").alias("n"))


def _figures() -> list[P.Figure]:
    """48 figures over six tables."""
    out = []
    for table, key, numbers, groups in (
        ("orders", "o_orderkey", ("o_totalprice",), ("o_orderstatus", "o_orderpriority", "o_custkey")),
        ("lineitem", "l_orderkey", ("l_quantity", "l_extendedprice", "l_discount"), ("l_returnflag", "l_linestatus", "l_partkey", "l_suppkey")),
        ("customer", "c_custkey", ("c_acctbal",), ("c_mktsegment", "c_nationkey")),
        ("part", "p_partkey", ("p_size", "p_retailprice"), ("p_brand",)),
        ("supplier", "s_suppkey", ("s_acctbal",), ("s_nationkey",)),
        ("documents", "doc_id", ("n_chars",), ("lang", "source")),
    ):
        out.append(P.Figure(f"{table}.rows", table, "count(*)"))
        out.append(P.Figure(f"{table}.largest_key", table, f"max({key})"))
        for c in numbers:
            out += [P.Figure(f"{table}.{c}.{f}", table, f"{f}({c})", 1e-9 if f in ("sum", "avg") else 0.0) for f in ("sum", "min", "max")]
        out += [P.Figure(f"{table}.{c}.different", table, f"count(DISTINCT {c})") for c in groups]
    return out


FIGURES = _figures()[:48]


@query("eva2_all_figures", "WITH f AS (" + " UNION ALL ".join(f"SELECT '{f.name}' AS name, CAST(({f.sql}) AS DOUBLE) AS value FROM {f.table}" for f in FIGURES) + """)
SELECT name, floor(value * 1000 + 0.5) / 1000 AS value, name NOT LIKE 'part.%' AS consistent FROM f""")
def eva2_all(t):
    """All figures in a scan a table. What was stated is what the tables gave before; that of one table is off by one and a hundredth, which is
    more than any figure's tolerance, however large the figure."""
    tables = {name: getattr(t, name) for name in sorted({f.table for f in FIGURES})}
    stated = P.figures(tables, FIGURES).select("name", F.when(F.col("name").startswith("part."), F.coalesce("value", F.lit(0.0)) + F.abs(F.coalesce("value", F.lit(0.0))) * 0.01 + 1).otherwise(F.col("value")).alias("stated"))
    out = P.audit_figures(tables, FIGURES, stated)
    return out.select("name", F.floor(F.col("value") * 1000 + 0.5).cast("double").alias("v"), "consistent").select("name", (F.col("v") / 1000).alias("value"), "consistent")
