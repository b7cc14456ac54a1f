"""Trust of components from evidence, completeness, audits, open tasks and consumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rounding import clamp01, half_up

#: Weights without and with consumption, caps, bands and half-lives in days.
WEIGHTS = {"evidence": 0.35, "completeness": 0.25, "freshness": 0.20, "consistency": 0.20}
WEIGHTS_CONSUMED = {"evidence": 0.30, "completeness": 0.20, "freshness": 0.15, "consistency": 0.15, "consumption": 0.20}
HALF_LIVES = [("/activities/", 120), ("/tables/", 90), ("/fields/", 90), ("/numeric_rules/", 90), ("/systems/", 180), ("/ui_flows/", 180), ("/concepts/", 365)]
CONSISTENCY_TASK = r"graph|relation|candidate|table|schema|source trace|frontmatter|alias|关系|图谱|候选|配置表|字段|别名|source"


def consumption_score(attributed: Column, searched: Column, clicked: Column, negative: Column) -> Column:
    """How agents receive a component: used in answers, clicked after searches, complained about."""
    rate = F.when((searched > 0) & (clicked > 0), 0.5 * F.least(F.lit(1.0), 2 * clicked / searched)).otherwise(0.0)
    return clamp01(0.5 + F.when(attributed > 0, 0.5).otherwise(0.0) + rate - 0.15 * F.least(F.lit(3), negative))


def half_life(path: Column, kind: Column) -> Column:
    first, *rest = HALF_LIVES
    days = F.when(F.contains(path, F.lit(first[0])), first[1])
    for part, n in rest[:2]:
        days = days.when(F.contains(path, F.lit(part)), n)
    days = days.when(F.contains(kind, F.lit("table")), 90)
    for part, n in rest[2:]:
        days = days.when(F.contains(path, F.lit(part)), n)
    return days.when(kind == "graph_snapshot", 120).otherwise(180)


def evidence_required(path: Column, kind: Column) -> Column:
    return (kind == "table_wiki_page") | ((kind == "wiki_page") & ~F.contains(path, F.lit("/concepts/")))


def quote_specificity(quote: Column) -> Column:
    text = F.trim(quote)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(text.rlike("^(Generated|Published) from source reference:"), 0.6).when(F.char_length(text) >= 12, 1.0).otherwise(0.7)


def evidence_score(required: Column, rows: Column, refs: Column, specific: Column, confidence: Column) -> Column:
    """rows: evidence rows; refs: source references; specific: whether a quote is specific."""
    specificity = F.when(rows == 0, 0.0).when(specific, 1.0).otherwise(0.6)
    some = 0.35 * (rows > 0).cast("double") + 0.25 * (refs > 0).cast("double") + 0.25 * specificity
    return F.when(~required, 1.0).otherwise(clamp01(some + 0.15 * F.when(rows > 0, F.coalesce(confidence, F.lit(0.0))).otherwise(0.0)))


def completeness_score(given: Column, kind: Column) -> Column:
    default = F.when(kind.isin("table_schema_json", "table_registry", "graph_snapshot"), 0.75).when(kind == "topic_index", 0.6).otherwise(0.55)
    return F.coalesce(clamp01(given), default)


def freshness_score(audited: Column, now: Column, days: Column) -> Column:
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(audited.cast("timestamp"))) / 86_400_000_000.0)
    return F.when(audited.isNull(), 0.45).otherwise(clamp01(F.exp(-F.log(F.lit(2.0)) * age / days)))


def consistency_score(blocking: Column, warning: Column, info: Column) -> Column:
    """Counts of open tasks about structure, relations or sources, by severity."""
    return clamp01(1 - (0.45 * blocking + 0.18 * warning + 0.08 * info))


def trust(df: DataFrame) -> DataFrame:
    """Adds trust_score, trust_status and trust_version. Needs evidence, completeness, freshness,
    consistency, consumption (null without data), required, evidence_rows, source_refs, audited,
    blocking and warning (open tasks)."""
    weighted = lambda w: sum((F.col(k) * v for k, v in w.items()), F.lit(0.0))
    consumed = F.col("consumption").isNotNull()
    raw = half_up(F.when(consumed, weighted(WEIGHTS_CONSUMED)).otherwise(weighted(WEIGHTS)))
    caps = [
        F.when(F.col("blocking") > 0, 0.5).when(F.col("warning") > 0, 0.85),
        F.when(F.col("required") & (F.col("evidence_rows") == 0), F.when(F.col("source_refs") == 0, 0.55).otherwise(0.7)),
        F.when(F.col("audited").isNull(), 0.7),
        F.when(F.col("completeness") < 0.35, 0.55).when(F.col("completeness") < 0.5, 0.65),
        F.when(F.col("consistency") < 0.6, 0.65),
    ]
    score = half_up(F.least(raw, *caps))  # least ignores caps that don't apply
    capped = F.coalesce(*caps).isNotNull()
    status = F.when((F.col("blocking") > 0) | (score < 0.55), "blocked").when(score < 0.7, "needs_review").when((score < 0.85) | capped, "usable_with_risk").otherwise("trusted")
    return df.withColumns({"trust_score": score, "trust_status": status, "trust_version": F.when(consumed, "v3-consumption").otherwise("v2-lite")})


def level(score: Column) -> Column:
    """Trust of an answer's envelope."""
    return F.when(score.isNull(), "unknown").when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def quality_flags(score: Column, evidence_rows: Column) -> Column:
    flags = F.array(F.when(score < 0.7, "low_trust"), F.when(evidence_rows == 0, "evidence_missing"))
    return F.filter(flags, lambda x: x.isNotNull())
