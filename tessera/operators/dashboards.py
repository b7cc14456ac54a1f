"""Summaries over many tables: convergence, exceptions, workbench, effects of annotations, search results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_row(blocks: list[DataFrame]) -> DataFrame:
    """One-row blocks side by side. Each is an aggregate, so nothing but single rows is broadcast."""
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), blocks)


def convergence(events: DataFrame, tasks: DataFrame, builds: DataFrame) -> DataFrame:
    """Automation outcomes, open tasks, builds and the share of exceptions, each block in one scan."""
    e = events.agg(
        F.count("*").alias("events"), F.count_if(F.col("outcome") == "succeeded").alias("succeeded"), F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_distinct("subject").alias("subjects"), F.count_distinct(F.when(F.col("outcome") == "failed", F.col("subject"))).alias("failing_subjects"), F.max(F.when(F.col("outcome") == "failed", F.col("event_id"))).alias("last_failure"),
    )
    t = tasks.agg(F.count_if(F.col("status") == "open").alias("open_tasks"), F.count_if((F.col("status") == "open") & (F.col("severity") == "blocking")).alias("blocking_tasks"))
    b = builds.agg(F.count("*").alias("builds"), F.count_if(F.col("state") == "failed").alias("failed_builds"))
    rate = F.when(F.col("events") == 0, 0.0).otherwise(F.col("failed") / F.col("events"))
    return one_row([e, t, b]).withColumn("exception_rate", rate)


def exceptions(parts: dict[str, DataFrame], dismissed: DataFrame) -> DataFrame:
    """(kind, dedup_key, severity) of all kinds, without what was dismissed."""
    rows = [df.select(F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), "key").alias("dedup_key"), "severity") for kind, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows).join(dismissed.select("dedup_key"), "dedup_key", "left_anti")


def workbench(items: DataFrame, kinds: list[str], per_kind: int = 4) -> DataFrame:
    """(kind, key, position, priority): the first few of each kind, and of these the one to pick first."""
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("weight"), "key"))
    place = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(kinds[1:], 1), F.when(F.col("kind") == kinds[0], 0))
    first = items.where(F.col("kind").isin(*kinds)).withColumn("position", rank).where(F.col("position") <= per_kind).withColumn("_place", place)
    pick = F.row_number().over(Window.orderBy("_place", "position"))  # a few rows of each kind
    return first.withColumn("priority", pick == 1).select("kind", "key", "position", "priority")


def annotation_effect(annotations: DataFrame, feedback: DataFrame) -> DataFrame:
    """(annotation_id, n_before, n_after, recurred): feedback on an annotation's component before and after it."""
    joined = annotations.join(feedback.select("component_id", F.col("created_at").alias("_t")), "component_id", "left")
    out = joined.groupBy("annotation_id").agg(F.count_if(F.col("_t") < F.col("created_at")).alias("n_before"), F.count_if(F.col("_t") > F.col("created_at")).alias("n_after"))
    return out.withColumn("recurred", F.col("n_after") > 0)


def lifecycle(events: DataFrame, entity: str) -> DataFrame:
    """Events of an entity or that name it in their payload, oldest first."""
    own = (F.col("entity_id") == entity) | (F.get_json_object("payload", "$.correctionId") == entity)
    return events.where(own).orderBy("created_at", "event_id")


def rebind(corrections: DataFrame, latest: DataFrame) -> DataFrame:
    """Corrections confirmed against the latest hash of their source; component-level ones keep theirs and retired
    ones stay as they are."""
    joined = corrections.join(latest.select(F.col("path").alias("source_path"), F.col("hash").alias("_h")), "source_path", "left")
    live = F.col("state") != "retired"
    hash_ = F.when(live & F.col("source_path").isNotNull() & F.col("_h").isNotNull(), F.col("_h")).otherwise(F.col("bound_source_hash"))
    return joined.withColumn("bound_source_hash", hash_).withColumn("state", F.when(live, "active").otherwise(F.col("state"))).drop("_h")


def correction_order(state: Column) -> Column:
    return F.when(state == "pending_review", 0).when(state == "active", 1).otherwise(2)


def topic(query: str, tables: DataFrame, nodes: DataFrame, pages: DataFrame, most: int = 5) -> DataFrame:
    """(kind, key, position): a table of that name, else an entity, else the first pages whose title has it."""
    q = query.strip().lower()
    found = [
        tables.where(F.lower("table") == q).select(F.lit(1).alias("step"), F.lit("table").alias("kind"), F.col("table").alias("key")),
        nodes.where((F.lower("id") == q) | (F.lower("label") == q)).select(F.lit(2).alias("step"), F.lit("entity").alias("kind"), F.col("id").alias("key")),
        pages.where(F.contains(F.lower("title"), F.lit(q))).orderBy("component_id").limit(most).select(F.lit(3).alias("step"), F.lit("page").alias("kind"), F.col("component_id").alias("key")),
    ]
    every = reduce(lambda a, b: a.union(b), found)
    best = every.agg(F.min("step").alias("best"))
    hits = every.join(F.broadcast(best), F.col("step") == F.col("best"))
    return hits.select("kind", "key", F.row_number().over(Window.partitionBy("kind").orderBy("key")).alias("position"))


def cards(hits: DataFrame, pages: DataFrame, trust: DataFrame) -> DataFrame:
    """Hits as answer cards: title, type, trust and what to do next."""
    joined = hits.join(pages.select("component_id", "title", "type"), "component_id").join(trust.select("component_id", "trust_score"), "component_id", "left")
    step = F.when(F.col("trust_score") < 0.7, "check evidence").when(F.col("rank") == 1, "read page").otherwise("compare")
    return joined.select("query_id", "component_id", "rank", "title", "type", "trust_score", step.alias("next_step"))


def automations(events: DataFrame) -> dict[str, DataFrame]:
    """One batch of events by the automation that handles them; used inside ``foreachBatch``."""
    routes = {
        "ingest": ["source.version_imported"], "release": ["build.completed"], "lint": ["release.published"], "writeback": ["annotation.applied"],
        "feedback": ["agent.feedback_recorded"], "remediation": ["lint.issue_found", "exception.raised"],
    }
    return {name: events.where(F.col("event_type").isin(*kinds)) for name, kinds in routes.items()}


def dismiss_info_tasks(tasks: DataFrame) -> DataFrame:
    """Open tasks of severity info are dismissed by policy."""
    hit = (F.col("status") == "open") & (F.col("severity") == "info")
    return tasks.withColumn("status", F.when(hit, "dismissed").otherwise(F.col("status")))


def incremental(items: DataFrame, cache: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Adds reuse: whether the cache holds the item with the same fingerprint, so that it need not be built again."""
    known = cache.select(key, fingerprint).distinct().withColumn("_k", F.lit(True))
    return items.join(known, [key, fingerprint], "left").withColumn("reuse", F.col("_k").isNotNull()).drop("_k")


def frozen_pages(new: DataFrame, released: DataFrame, pending: DataFrame) -> DataFrame:
    """Pages with a pending correction keep the body that was released."""
    old = released.select("artifact_id", F.col("body").alias("_old")).join(pending.select("artifact_id").distinct(), "artifact_id", "left_semi")
    return new.join(old, "artifact_id", "left").withColumn("frozen", F.col("_old").isNotNull()).withColumn("body", F.coalesce("_old", "body")).drop("_old")


def page_tables(pages: DataFrame, explicit: DataFrame, configured: DataFrame) -> DataFrame:
    """(component_id, table): an explicit dependency section wins even if it names no table; else the graph's
    configured_in edges. ``explicit``: component_id with a row for each section, table null where it names none."""
    having = explicit.select("component_id").distinct()
    named = explicit.where("table IS NOT NULL").select("component_id", "table")
    return named.union(pages.select("component_id").join(having, "component_id", "left_anti").join(configured, "component_id").select("component_id", "table")).distinct()


def page_keys(pages: DataFrame) -> DataFrame:
    """(component_id, key): the spellings under which a page is looked up."""
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    keys = F.array("component_id", "title", F.lower("title"), "path", F.lower("path"), base, F.regexp_replace(base, r"\.md$", ""), F.regexp_replace("path", r"\.md$", ""), F.concat(F.lit("/"), "path"))
    return pages.select("component_id", F.explode(F.array_distinct(keys)).alias("key"))


def unresolved_kind(hint: Column) -> Column:
    """What an unresolved dependency hint looks like."""
    return (
        F.when(hint.rlike(r"^https?://"), "link").when(hint.rlike(r"\.(xlsx|xls|csv)$"), "file").when(hint.rlike(r"^[A-Za-z_][A-Za-z0-9_/]*$"), "table_name")
        .when(hint.rlike(r"\p{IsHan}"), "description").otherwise("other")
    )
