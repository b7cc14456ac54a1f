"""Snapshots, releases, gates, lint, feedback, gaps, corrections, health and attribution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rounding import half_up
from tessera.sources.scratch import shared_path

#: Tolerances of the gates.
QUALITY_TOLERANCE, TRUST_TOLERANCE, HIT_TOLERANCE = 0.005, 0.0001, 1e-9
MAX_INCREMENTAL_TARGETS = 12
REPEAT_LIMIT = GAP_DISMISS_LIMIT = 3
CLUSTER_SIMILARITY = 0.85


# snapshots -------------------------------------------------------------------------------------
def build_plan(changes: DataFrame) -> DataFrame:
    """(mode, targets, removed) for changes (key, change): full where something was removed, nothing
    changed, or more than twelve files did."""
    counts = changes.agg(F.count_if(F.col("change").isin("added", "modified")).alias("targets"), F.count_if(F.col("change") == "removed").alias("removed"))
    full = (F.col("removed") > 0) | (F.col("targets") == 0) | (F.col("targets") > MAX_INCREMENTAL_TARGETS)
    return counts.select(F.when(full, "full").otherwise("incremental").alias("mode"), "targets", "removed")


def sync_mode(base_release: Column, mode: Column, targets: Column) -> Column:
    return F.when(base_release.isNotNull() & (mode == "incremental") & (targets == 1), "incremental").otherwise("full")


def drifted(corrections: DataFrame, files: DataFrame) -> DataFrame:
    """Active corrections whose source file's hash is no longer the one they are bound to."""
    active = corrections.where("state = 'active'")
    return active.join(files.select(F.col("path").alias("source_path"), "hash"), "source_path", "left").where(~F.col("hash").eqNullSafe(F.col("bound_source_hash")))


# releases --------------------------------------------------------------------------------------
def release_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(artifact_id, change) by artifact and content fingerprint; component ids differ between builds
    and play no part."""
    a = old.select("artifact_id", F.col("content_hash").alias("a"))
    b = new.select("artifact_id", F.col("content_hash").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return a.join(b, "artifact_id", "full_outer").select("artifact_id", change.alias("change"))


def trust_declines(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """(artifact_id, previous, next) of changed artifacts that lost trust or whose trust is missing;
    artifacts that the parent lacks have nothing to decline from."""
    before = old.select("artifact_id", F.col("score").alias("previous"), F.lit(True).alias("known"))
    now = new.join(changed.select("artifact_id"), "artifact_id", "left_semi").select("artifact_id", F.col("score").alias("next"))
    joined = now.join(before, "artifact_id", "left")
    worse = F.col("next").isNull() | (F.coalesce("known", F.lit(False)) & (F.col("previous").isNull() | (F.col("next") + TRUST_TOLERANCE < F.col("previous"))))
    return joined.where(worse).select("artifact_id", "previous", "next")


def quality_regressed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row (regressed) from one-row frames (average, blocking)."""
    p = previous.select(F.col("average").alias("pa"), F.col("blocking").alias("pb"))
    score = F.col("pa").isNotNull() & (F.col("average").isNull() | (F.col("average") + QUALITY_TOLERANCE < F.col("pa")))
    none = F.col("pa").isNull() & (F.coalesce("pb", F.lit(0)) == 0)
    return current.join(F.broadcast(p), F.lit(True)).select((~none & (score | (F.col("blocking") > F.coalesce("pb", F.lit(0))))).alias("regressed"))


def gate_reasons(facts: DataFrame) -> DataFrame:
    """One row of facts to the reasons against publishing, in order; no rows mean eligible."""
    rules = [
        ("missing_parent_release", F.col("parent").isNull()),
        ("removed_components_present", F.col("block_on_deletes") & (F.col("removed") > 0)),
        ("no_component_changes", F.col("changed") == 0),
        ("changed_components_have_blocking_tasks", F.col("blocking_tasks") > 0),
        ("trust_score_declined_or_missing", F.col("block_on_trust_decline") & (F.col("declines") > 0)),
        ("has_pending_review_corrections", F.col("block_on_corrections") & (F.col("pending_corrections") > 0)),
        ("changed_components_below_min_trust_score", F.col("below_min_trust") > 0),
        ("quality_regressed", F.col("block_on_regression") & F.col("regressed")),
        ("knowledge_lint_remediation_unresolved", F.col("lint_unresolved") > 0),
        ("retrieval_eval_regression", (F.col("hit_at_k") + HIT_TOLERANCE < F.col("min_hit_at_k")) | ((F.col("min_citation") > 0) & (F.col("citation") + HIT_TOLERANCE < F.col("min_citation")))),
        ("retrieval_gold_binding_mismatch", ~F.col("binding_ok")),
    ]
    each = F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(i).alias("position"), F.lit(name).alias("reason"))) for i, (name, cond) in enumerate(rules)))
    return facts.select(F.inline(F.filter(each, lambda x: x.isNotNull())))


def evidence_backfill(components: DataFrame, evidence: DataFrame, most: int = 3) -> DataFrame:
    """Evidence rows for components without any, from their first source references."""
    bare = components.join(evidence.select("component_id"), "component_id", "left_anti")
    refs = bare.select("component_id", F.posexplode(F.slice("source_refs", 1, most)).alias("position", "ref"))
    return refs.select("component_id", "ref", F.lit(0.7).alias("confidence"), F.sha1(F.concat_ws(":", "component_id", "ref", "position")).alias("evidence_id"))


def component_id(package: Column, path: Column) -> Column:
    """A stable id of an artifact of a package."""
    return F.concat(F.lit("cmp_"), package, F.lit("_"), F.regexp_replace(path, r"[^A-Za-z0-9]+", "_"), F.lit("_"), F.substring(F.sha1(F.concat(package, F.lit(":"), path)), 1, 10))


# lint ------------------------------------------------------------------------------------------
def lint_score(blocking: Column, warning: Column, info: Column) -> Column:
    return half_up(1 - F.least(F.lit(1.0), 0.2 * blocking + 0.035 * warning + 0.01 * info), 2)


def fallback_action(domain: Column, severity: Column, component: Column) -> Column:
    return (
        F.when((domain == "links") & (severity != "blocking"), "auto_remediation")
        .when((domain == "table_dependencies") & component.isNotNull(), "auto_remediation")
        .when(domain.isin("graph", "evidence", "trust"), "rebuild")
        .when(domain == "mcp_feedback", "manual_review")
        .when(severity == "info", "monitor")
        .otherwise("manual_review")
    )


# feedback --------------------------------------------------------------------------------------
def feedback_type(status: Column, flags: Column) -> Column:
    """What kind of feedback an audited call is; null where it is none."""
    has = lambda *prefixes: F.exists(flags, lambda f: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(f, p)))
    return (
        F.when(status == "error", "tool_error").when(status == "miss", "miss")
        .when(has("low_quality:", "low_trust:"), "low_quality_hit").when(has("evidence_missing:"), "evidence_insufficient")
    )


def escalate(feedback: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds stored_type and severity. The third identical row is blocking; a third miss is stored as
    repeated_query, so stored misses stop at two and every later one is a repeated query again."""
    n = F.row_number().over(Window.partitionBy(*keys, "feedback_type").orderBy(*order))
    miss = F.col("feedback_type") == "miss"
    return feedback.withColumn("_n", n).select(
        *feedback.columns,
        F.when(miss & (F.col("_n") >= REPEAT_LIMIT), "repeated_query").otherwise(F.col("feedback_type")).alias("stored_type"),
        F.when(F.col("_n") >= REPEAT_LIMIT, "blocking").otherwise("warning").alias("severity"),
    )


def gap_candidates(feedback: DataFrame) -> DataFrame:
    """The state of each gap after its feedback: (project_id, query_key, event_count, status, query_raw,
    expected). A dismissed gap opens again with every further row and, from the third on, is dismissed again,
    so the last state follows from the count: no replay is needed."""
    last = F.struct("created_at", "event_id")
    grouped = feedback.groupBy("project_id", "query_key").agg(
        F.count("*").alias("event_count"), F.max_by("query", last).alias("query_raw"),
        F.coalesce(F.max_by(F.col("expected"), F.when(F.col("expected") != "", last)), F.lit("")).alias("expected"),
    )
    return grouped.withColumn("status", F.when(F.col("event_count") >= GAP_DISMISS_LIMIT, "dismissed").otherwise("open"))


def _nearest_earlier(keep_latest: int, days: int):
    """For each row of a chunk the most similar of the rows before it: at most ``keep_latest`` of them, none older than ``days`` days."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        rn, own = table["rn"].to_numpy(), table["own"].to_numpy(zero_copy_only=False)
        when, ids, queries = table["created_at"].to_numpy().astype("datetime64[us]"), table["event_id"].to_numpy(), np.array(table["query"].to_pylist(), object)
        vectors = table["vector"].to_pylist()
        size = max((len(v) for v in vectors if v is not None), default=1)
        known = np.array([v is not None for v in vectors])
        flat = np.array([v if v is not None else [0.0] * size for v in vectors], float).reshape(len(vectors), size)
        best, parent = np.full(len(rn), -1, np.int64), np.arange(len(rn))
        for back in range(1, min(keep_latest, len(rn) - 1) + 1):
            late, early = np.arange(back, len(rn)), np.arange(len(rn) - back)
            # scores are compared as whole billionths, so that the order of sums cannot decide
            score = np.where(known[late] & known[early], np.floor((flat[late] * flat[early]).sum(1) * 1e9 + 0.5), 0).astype(np.int64)
            score = np.where(queries[late] == queries[early], 10**9, score)
            fine = (when[late] - when[early] <= np.timedelta64(days + 1, "D") - np.timedelta64(1, "us")) & (score >= round(CLUSTER_SIMILARITY * 1e9)) & (score > best[late])
            best[late[fine]], parent[late[fine]] = score[fine], early[fine]
        at = np.flatnonzero(own)
        return pa.Table.from_arrays([pa.array(ids[at]), pa.array(ids[parent[at]])], names=["event_id", "parent"])

    return run


def followed(parents: DataFrame) -> DataFrame:
    """(event_id, root): links (event_id, parent) followed to their ends; a row whose parent is itself is an end. Each round doubles the
    reach, so a chain of n links takes log2(n) rounds."""
    spark, state = parents.sparkSession, parents
    while True:
        upper = state.select(F.col("event_id").alias("parent"), F.col("parent").alias("above"))
        path = shared_path(spark, "links")
        state.join(upper, "parent").select("event_id", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")).write.parquet(path)
        moved = spark.read.parquet(path)
        state = moved.select("event_id", "parent")
        if moved.where("moved").isEmpty():
            return state.withColumnRenamed("parent", "root")


def cluster_keys(feedback: DataFrame, keep_latest: int = 50, days: int = 90, chunk: int = 4096) -> DataFrame:
    """Adds cluster_key: rows of a project and type, in order of time, take the key of the most similar of
    the latest ``keep_latest`` earlier queries of ``days`` days if their vectors' cosine is 0.85 or more (the latest of equally similar ones),
    else their own query's. Without a vector only equal queries meet.

    Which row a row follows does not depend on keys, so a group is cut into chunks of rows in order, each with the ``keep_latest`` rows before it,
    and all chunks are looked through at once. Keys are the queries at the ends of the links."""
    spark, order = feedback.sparkSession, ["project_id", "feedback_type", "created_at", "event_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = feedback.select("event_id", "project_id", "feedback_type", "query", "created_at", "vector")
    path = shared_path(spark, "ordered")
    # neighbours in time are neighbours in a range partition: its number and the place in it make up the id
    columns.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("part", F.shiftright("id", 33))
    group = ["project_id", "feedback_type"]
    runs = rows.groupBy(*group, "part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*(F.col(c).alias(f"_{c}") for c in group), F.col("part").alias("_part"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    same = [rows[c].eqNullSafe(runs[f"_{c}"]) for c in group] + [rows["part"] == runs["_part"]]
    placed = rows.join(runs, same).withColumn("rn", F.col("offset") + F.col("id") - F.col("first"))
    own = F.floor(F.col("rn") / chunk)
    reach = F.when(F.col("rn") % chunk >= chunk - keep_latest, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = placed.select(*group, "event_id", "query", "created_at", "vector", "rn", F.explode(reach).alias("chunk")).withColumn("own", F.col("chunk") == F.floor(F.col("rn") / chunk))
    kind = feedback.schema["event_id"].dataType.simpleString()
    links = dealt.groupBy(*group, "chunk").applyInArrow(_nearest_earlier(keep_latest, days), f"event_id {kind}, parent {kind}")
    kept = shared_path(spark, "parents")
    links.write.parquet(kept)
    ends = followed(spark.read.parquet(kept))
    keys = feedback.select(F.col("event_id").alias("root"), F.col("query").alias("cluster_key"))
    return feedback.join(ends.join(keys, "root").select("event_id", "cluster_key"), "event_id")


def rebuild_proposals(feedback: DataFrame, open_tasks: DataFrame, least: int = 2) -> DataFrame:
    """(component_id, negatives) with enough negative feedback and no open rebuild task."""
    counts = feedback.groupBy("component_id").agg(F.count("*").alias("negatives")).where(F.col("negatives") >= least)
    return counts.join(open_tasks.select("component_id"), "component_id", "left_anti")


def consumption_stats(audit: DataFrame, attributed: DataFrame, negative: DataFrame) -> DataFrame:
    """(component_id, searches, clicks, negatives, attributions) of components seen in any."""
    calls = audit.where("component_id IS NOT NULL").groupBy("component_id").agg(F.count_if(F.col("tool_name") == "kb_search").alias("searches"), F.count_if(F.col("tool_name") == "kb_get_page").alias("clicks"))
    neg = negative.groupBy("component_id").agg(F.count("*").alias("negatives"))
    att = attributed.groupBy("component_id").agg(F.count("*").alias("attributions"))
    names = ["searches", "clicks", "negatives", "attributions"]
    return calls.join(neg, "component_id", "full_outer").join(att, "component_id", "full_outer").select("component_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


# corrections -----------------------------------------------------------------------------------
def submit_correction(existing: DataFrame, incoming: DataFrame, newest: int = 8) -> DataFrame:
    """Corrections after new ones came in: those equal by fingerprint to one of the newest of their
    anchor are left out, the others retire what is not retired there and wait for review."""
    anchor = ["project_id", "source_path", "rule_id", "fact_key"]
    recent = existing.withColumn("_n", F.row_number().over(Window.partitionBy(*anchor).orderBy(F.desc("created_at"), F.desc("correction_id")))).where(F.col("_n") <= newest)
    fresh = incoming.join(recent.select(*anchor, "fingerprint"), [*anchor, "fingerprint"], "left_anti")
    replaced = fresh.select(*anchor).distinct().withColumn("_hit", F.lit(True))
    kept = existing.join(replaced, anchor, "left").withColumn("state", F.when(F.col("_hit").isNotNull(), "retired").otherwise(F.col("state"))).select(*existing.columns)
    return kept.unionByName(fresh.withColumn("state", F.lit("pending_review")).select(*existing.columns))


def resolve_target(components: DataFrame, wanted: DataFrame) -> DataFrame:
    """(request, component_id, step): the first of component id, path, path without case, and unique
    path suffix that finds a component; several at one step are ambiguous and give null."""
    tries = [
        (1, F.col("c.component_id") == F.col("w.target")), (2, F.col("c.path") == F.col("w.target")),
        (3, F.lower("c.path") == F.lower("w.target")), (4, F.regexp_extract("c.path", r"([^/]+)$", 1) == F.col("w.target")),
    ]
    found = None
    for step, cond in tries:
        part = wanted.alias("w").join(components.alias("c"), cond).select("w.request", "c.component_id", F.lit(step).alias("step"))
        found = part if found is None else found.union(part)
    best = found.groupBy("request", "step").agg(F.count_distinct("component_id").alias("n"), F.min("component_id").alias("component_id"))
    first = best.groupBy("request").agg(F.min_by(F.struct("n", "component_id", "step"), "step").alias("b"))
    return first.select("request", F.when(F.col("b.n") == 1, F.col("b.component_id")).alias("component_id"), "b.step")


# attribution and health ------------------------------------------------------------------------
def segment_class(evidence: Column, components: Column, claims: Column) -> Column:
    """quoted with evidence, derived from components, undecided without claims, else invented."""
    return F.when(F.size(evidence) > 0, "quoted").when(F.size(components) > 0, "derived").when(~claims, "undecided").otherwise("invented")


def needs_writeback(kind: Column, evidence: Column) -> Column:
    return kind.isin("invented", "undecided") | ((kind == "derived") & (F.size(evidence) == 0))


def health(components: DataFrame, stats: DataFrame, now: Column, min_trust: float = 0.7, max_age_days: int = 180, grace_days: int = 30) -> DataFrame:
    """(component_id, low_trust, stale_audit, unused): an audit that is missing counts as stale; what was
    published less than ``grace_days`` ago is not called unused."""
    joined = components.join(stats, "component_id", "left")
    used = sum((F.coalesce(c, F.lit(0)) for c in ("searches", "clicks", "attributions")), F.lit(0))
    days = lambda c: F.date_diff(now.cast("date"), F.col(c).cast("date"))
    return joined.select(
        "component_id", (F.col("trust_score") < min_trust).alias("low_trust"), F.coalesce(days("audited") > max_age_days, F.lit(True)).alias("stale_audit"),
        ((used == 0) & (days("published") > grace_days)).alias("unused"),
    )


def flywheel_state(release: Column, failed_builds: Column, blocking: Column, pending: Column, stale: Column) -> Column:
    """The first state that applies."""
    return F.when(release.isNull(), "no_release").when(failed_builds > 0, "build_failed").when(blocking > 0, "blocked").when(pending > 0, "review").when(stale > 0, "stale").otherwise("healthy")


def span_times(spans: DataFrame) -> DataFrame:
    """(span_id, ms, outcome) from started, completed and failed rows."""
    began = spans.where("phase = 'started'").groupBy("span_id").agg(F.min("ts").alias("began"))
    ended = spans.where("phase <> 'started'").groupBy("span_id").agg(F.min_by("phase", "ts").alias("outcome"), F.min("ts").alias("ended"))
    ms = ((F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("began").cast("timestamp"))) / 1000).cast("long")
    return began.join(ended, "span_id", "left").select("span_id", ms.alias("ms"), F.coalesce("outcome", F.lit("running")).alias("outcome"))
