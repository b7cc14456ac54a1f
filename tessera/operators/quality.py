"""Quality rules, conformance, lint issues, repairs and rule profiles."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUTO_FIX_CONFIDENCE = 0.85
ISSUE = ["component_id", "domain", "severity", "message"]


def spec_findings(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """(component_id, rule, missing): required sections and facts that a page lacks, and pages without a source.
    ``pages``: component_id, type, headings, facts (arrays), source. ``specs``: type, sections, fact_names."""
    joined = pages.join(specs, "type", "left")
    none = F.array().cast("array<string>")
    lack = lambda need, have: F.array_except(F.coalesce(need, none), F.coalesce(have, none))
    each = F.array(
        F.struct(F.lit("wikiSpecCompleteness").alias("rule"), lack(F.col("sections"), F.col("headings")).alias("missing")),
        F.struct(F.lit("requiredFacts").alias("rule"), lack(F.col("fact_names"), F.col("facts")).alias("missing")),
        F.struct(F.lit("frontmatterSource").alias("rule"), F.when(F.coalesce("source", F.lit("")) == "", F.array(F.lit("source"))).otherwise(none).alias("missing")),
    )
    return joined.select("component_id", F.inline(each)).where(F.size("missing") > 0)


def without_dismissed(findings: DataFrame, dismissals: DataFrame) -> DataFrame:
    return findings.join(dismissals.select("component_id", "rule"), ["component_id", "rule"], "left_anti")


def known_sources(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Pages whose source's stem is the stem of no file."""
    stem = lambda c: F.lower(F.regexp_extract(c, r"([^/\\]+?)(?:\.[^./\\]+)?$", 1))
    return pages.withColumn("_s", stem("source")).join(files.select(stem("path").alias("_s")), "_s", "left_anti").drop("_s")


def overall(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """(score, pages, findings): the average page score and the counts."""
    s = scores.agg(F.avg("score").alias("score"), F.count("*").alias("pages"))
    return s.join(F.broadcast(findings.agg(F.count("*").alias("findings"))), F.lit(True))


def repairs(findings: DataFrame) -> DataFrame:
    """(component_id, action, payload): what can be appended without knowing more: empty sections and
    placeholders of facts; a missing source can only be dismissed."""
    each = findings.select("component_id", "rule", F.explode("missing").alias("item"))
    action = F.when(F.col("rule") == "wikiSpecCompleteness", "append_section").when(F.col("rule") == "requiredFacts", "placeholder_fact").otherwise("dismiss")
    payload = F.when(F.col("rule") == "wikiSpecCompleteness", F.concat(F.lit("## "), "item", F.lit("\n\nTBD\n"))).when(F.col("rule") == "requiredFacts", F.concat("item", F.lit(": TBD"))).otherwise("")
    return each.select("component_id", action.alias("action"), payload.alias("payload"))


def merge_profile(base: dict, override: dict) -> dict:
    """A rule profile with a project's overrides: nested records merge, all else is replaced."""
    out = dict(base)
    for k, v in override.items():
        out[k] = merge_profile(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def profile_hash(profile: dict) -> str:
    return hashlib.sha256(json.dumps(profile, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def clamp_profile(profile: dict, bounds: dict[str, tuple[float, float]]) -> dict:
    """Numbers of a governance profile within their bounds; what is no number falls back to the lower one."""
    return {k: min(max(float(v), bounds[k][0]), bounds[k][1]) if k in bounds and isinstance(v, (int, float)) else bounds[k][0] if k in bounds else v for k, v in profile.items()}


def lint_issues(pages: DataFrame, links: DataFrame, tables: DataFrame, dependencies: DataFrame, dangling: DataFrame, evidence: DataFrame, trust: DataFrame, feedback: DataFrame) -> DataFrame:
    """(component_id, domain, severity, message) of six domains. ``pages``, ``evidence``, ``trust``, ``feedback``
    carry component_id; ``links`` component_id and target; ``dependencies`` component_id and table."""
    issue = lambda df, domain, severity, message: df.select("component_id", F.lit(domain).alias("domain"), F.lit(severity).alias("severity"), message.cast("string").alias("message"))
    parts = [
        issue(links.join(pages.select(F.col("path").alias("target")), "target", "left_anti"), "links", "warning", F.col("target")),
        issue(dependencies.join(tables.select("table"), "table", "left_anti"), "table_dependencies", "warning", F.col("table")),
        issue(dangling.select(F.col("source").alias("component_id"), "target"), "graph", "blocking", F.col("target")),
        issue(pages.join(evidence.select("component_id"), "component_id", "left_anti"), "evidence", "warning", F.lit("no evidence")),
        issue(trust.where("trust_score < 0.55"), "trust", "blocking", F.col("trust_score")),
        issue(feedback.groupBy("component_id").agg(F.count("*").alias("n")).where("n >= 2"), "mcp_feedback", "info", F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def remediation_status(attempts: Column, applied: Column, confidence: Column) -> Column:
    return F.when(applied, "done").when(attempts >= 3, "failed").when(confidence < AUTO_FIX_CONFIDENCE, "needs_human").otherwise("pending")


def valid_alias_fixes(proposals: DataFrame, tables: DataFrame, aliases: DataFrame) -> DataFrame:
    """Proposals (alias, canonical, confidence) sure enough, for a table that exists, and not resolved yet."""
    sure = proposals.where(F.col("confidence") >= AUTO_FIX_CONFIDENCE).join(tables.select(F.col("table").alias("canonical")), "canonical", "left_semi")
    return sure.join(aliases.select("alias"), "alias", "left_anti")


def unrelaxed(blocking: DataFrame, fixed: DataFrame) -> DataFrame:
    """Blocking tasks that no automatic fix of enough confidence has taken away."""
    return blocking.join(fixed.where(F.col("confidence") >= AUTO_FIX_CONFIDENCE).select("task_id"), "task_id", "left_anti")


def patch_pages(parent: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """Pages of a patch release: the changed ones, and the parent's that are neither changed nor removed."""
    kept = parent.join(changed.select("artifact_id"), "artifact_id", "left_anti").join(removed.select("artifact_id"), "artifact_id", "left_anti")
    return changed.unionByName(kept)


def should_roll_back(hit_rate: float, least: float, tolerance: float = 1e-9) -> bool:
    """The decision after a publish, on an evaluation's one row."""
    return hit_rate + tolerance < least
