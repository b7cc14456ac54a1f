"""Lookups, conformance, path rules and small record operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rounding import half_up
from tessera.functions.text import alias_key_query
from tessera.operators.bundle import indexable
from tessera.operators.containment import contained as texts_with
from tessera.operators.relational import equivalent_paths, first_n
from tessera.sources.scratch import stored

#: The payload fields that may name what was asked, in order.
QUERY_FIELDS = ["query", "q", "topic", "page", "table", "entityId"]
#: Fields of a correction that do not make it another one.
VOLATILE = ["confidence", "queryContext", "sourceContext", "issue", "actor", "createdAt"]
#: Optional frontmatter fields, types that need citations, and navigation pages.
OPTIONAL_FIELDS = ["description", "tags", "timestamp", "resource"]
CITED_TYPES = ["system_rule", "activity_template", "table_schema", "ui_flow"]
RESERVED = ["index.md", "log.md"]


# functions -------------------------------------------------------------------------------------
def feedback_query_key(tool: Column, payload: Column) -> Column:
    """``tool:query`` from the first payload field that is given, else from the whole payload."""
    value = F.coalesce(*(F.get_json_object(payload, f"$.{k}") for k in QUERY_FIELDS), payload)
    return F.concat(tool, F.lit(":"), F.lower(F.trim(value)))


def first_number(*values: Column) -> Column:
    """The first of some texts that is a finite number."""
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return F.coalesce(*(finite(F.trim(v).try_cast("double")) for v in values))


def is_source_ref(ref: Column) -> Column:
    return F.startswith(ref, F.lit("gamedocs/")) | F.startswith(ref, F.lit("gamedata/"))


def correction_fingerprint(fields: Column) -> Column:
    """JSON of a correction's fields (a map) in the order of their names, volatile ones left out."""
    kept = F.map_filter(fields, lambda k, v: ~k.isin(*VOLATILE))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


# paths -----------------------------------------------------------------------------------------
def contained(path: Column) -> Column:
    """A relative path that never leaves its root: no drive, no leading slash, no ``..`` step."""
    p = F.regexp_replace(path, r"\\", "/")
    return ~p.rlike(r"^(?:/|[A-Za-z]:)") & ~F.array_contains(F.split(p, "/"), "..")


def source_root(listing: DataFrame) -> DataFrame:
    """(root): the one folder of a listing of paths that has source folders in it; empty, which is the listing's own root, where that
    has one itself, and where none or several have. Folders that start with a dot are passed over."""
    top = F.regexp_extract("path", r"^(?:([^/]+)/)?(?:gamedata|gamedocs)/", 1)
    found = listing.where(F.col("path").rlike(r"^(?:[^/.][^/]*/)?(?:gamedata|gamedocs)/")).select(top.alias("root")).distinct()
    totals = found.agg(F.count("*").alias("n"), F.min("root").alias("root"))
    return totals.select(F.when(F.col("n") == 1, F.col("root")).otherwise("").alias("root"))


def table_names(listing: DataFrame) -> DataFrame:
    """(table): names of the workbooks and CSV files of a listing, without their extension."""
    name = F.regexp_extract("path", r"([^/]+)\.(?i:xlsx|xls|csv)$", 1)
    return listing.where(F.startswith("path", F.lit("gamedata/"))).select(name.alias("table")).where("table <> ''").distinct()


def tree_entries(paths: DataFrame) -> DataFrame:
    """(parent, name, kind, place): files and folders of a listing, folders first, then by name."""
    parts = F.split("path", "/")
    prefix = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(prefix(i - 1).alias("parent"), F.element_at(parts, i).alias("name"), F.when(i == F.size(parts), "file").otherwise("folder").alias("kind")))
    rows = paths.select(F.inline(each)).distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.col("kind").desc(), "name")))


def legacy_package(listing: DataFrame) -> DataFrame:
    """(package_id, path, kind): files of an older layout as components of a draft package, one for each top folder."""
    kind = F.when(F.col("path").rlike(r"(?i)graph.*\.json$"), "graph_snapshot").when(F.col("path").rlike(r"(?i)schema.*\.json$"), "table_schema_json").when(F.col("path").rlike(r"(?i)\.md$"), "wiki_page")
    return listing.select(F.concat(F.lit("draft-"), F.element_at(F.split("path", "/"), 1)).alias("package_id"), "path", kind.alias("kind")).where("kind IS NOT NULL")


# knowledge behind sources ------------------------------------------------------------------------
def affected_knowledge(components: DataFrame, changed: DataFrame) -> DataFrame:
    """(component_id): components with a source among the changed paths (equal or one the other's ending), or
    with a changed file's name in path or title. ``components``: (component_id, path, title, source_refs)."""
    endings = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))
    refs = components.select("component_id", F.explode("source_refs").alias("ref"))
    by_ref = refs.select("component_id", F.explode(endings(F.col("ref"))).alias("end")).join(changed.select(F.col("path").alias("end")), "end").select("component_id")
    by_target = refs.withColumnRenamed("ref", "end").join(changed.select(F.explode(endings(F.col("path"))).alias("end")), "end").select("component_id")
    stems = changed.select(F.lower(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")).alias("stem")).where("stem <> ''").distinct()
    named = components.select("component_id", F.explode(F.array(F.lower("path"), F.lower("title"))).alias("text"))
    by_name = named.join(texts_with(named, stems.withColumnRenamed("stem", "pattern")).select("text").distinct(), "text").select("component_id")
    return by_ref.union(by_target).union(by_name).distinct()


def correction_debt(components: DataFrame, pending: DataFrame) -> DataFrame:
    """(component_id, pending): how many corrections wait for review on sources of each component."""
    refs = components.select("component_id", F.explode("source_refs").alias("ref"))
    met = equivalent_paths(refs, pending.select("correction_id", "source_path"), "ref", "source_path")
    return met.groupBy("component_id").agg(F.count_distinct("correction_id").alias("pending"))


def trust_changes(before: DataFrame, after: DataFrame, least: float = 0.05) -> DataFrame:
    """(component_id, before, after, delta): components whose trust moved by ``least`` or more at publishing."""
    both = before.select("component_id", F.col("trust").alias("before")).join(after.select("component_id", F.col("trust").alias("after")), "component_id")
    delta = F.col("after") - F.col("before")
    return both.where(F.abs(delta) >= least).select("component_id", "before", "after", half_up(delta).alias("delta"))


# tables ----------------------------------------------------------------------------------------
def resolve_tables(wanted: DataFrame, schemas: DataFrame, aliases: DataFrame) -> DataFrame:
    """(request, table): the table that a request names by its name, title or artifact, case and slashes aside,
    or by an alias of it. ``schemas``: (table, title, artifact_id); ``aliases``: (table, alias)."""
    same = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\\", "/"), r"\s+", " "))
    # many tables may share a name: a key keeps its first table before it meets requests, and equal requests meet it once
    least = lambda keys: keys.groupBy("k").agg(F.min("table").alias("table"))
    asked = wanted.select("request").distinct()
    direct = least(schemas.select("table", F.explode(F.array("table", "title", "artifact_id")).alias("k")).select("table", same(F.col("k")).alias("k")))
    other = least(aliases.select("table", alias_key_query(F.col("alias")).alias("k")).union(aliases.select("table", alias_key_query(F.col("table")))))
    found = [asked.withColumn("k", k).join(keys, "k").select("request", "table", F.lit(step).alias("step")) for step, k, keys in ((1, same(F.col("request")), direct), (0, alias_key_query(F.col("request")), other))]
    first = found[0].union(found[1]).groupBy("request").agg(F.min(F.struct("step", "table")).alias("b"))
    return first.select("request", "b.table")


# pages -----------------------------------------------------------------------------------------
def parse_page(path: Column, front: Column, body: Column) -> Column:
    """struct(title, type, artifact_id, heading): a page's own fields with what stands in for missing ones."""
    get = lambda key: F.regexp_extract(front, rf"(?m)^\s*{key}:\s*[\"']?(.+?)[\"']?\s*$", 1)
    given = lambda key, other: F.when(get(key) != "", get(key)).otherwise(other)
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.md$", "")
    heading = F.trim(F.regexp_extract(body, r"(?m)^#{1,6}\s+(.+)$", 1))
    return F.struct(given("title", name).alias("title"), given("type", F.lit("knowledge_note")).alias("type"), given("artifactId", F.regexp_replace(path, "^/", "")).alias("artifact_id"), heading.alias("heading"))


def known_type(kind: Column, known: list[str]) -> Column:
    """struct(type, coerced): a type that no profile knows becomes ``concept``."""
    fine = kind.isin(*known)
    return F.struct(F.when(fine, kind).otherwise("concept").alias("type"), (~F.coalesce(fine, F.lit(False))).alias("coerced"))


def conformance(pages: DataFrame) -> DataFrame:
    """(path, issue, blocking): what keeps markdown pages from the bundle format. ``pages``: (path, markdown)."""
    text, path = F.col("markdown"), F.col("path")
    closed = text.rlike(r"(?s)^---\r?\n.*?\r?\n---(?:\r?\n|$)")
    front = F.when(closed, F.regexp_extract("markdown", r"(?s)^---\r?\n(.*?)\r?\n---(?:\r?\n|$)", 1))
    body = F.regexp_replace("markdown", r"(?s)^---\r?\n.*?\r?\n---(?:\r?\n|$)", "")
    keys = F.regexp_extract_all("front", F.lit(r"(?m)^([A-Za-z_][A-Za-z0-9_]*):"), F.lit(1))
    parts = pages.where(~F.regexp_extract(path, r"([^/]*)$", 1).isin(*RESERVED)).select("path", "markdown", front.alias("front"), body.alias("body"))
    parts = parts.withColumn("keys", keys).withColumn("type", F.regexp_extract("front", r"(?m)^type:\s*[\"']?(.*?)[\"']?\s*$", 1))
    issue = lambda name, blocking, when: F.when(when, F.struct(F.lit(name).alias("issue"), F.lit(blocking).alias("blocking")))
    whole = F.col("front").isNotNull()
    found = [
        issue("unparseable_yaml", True, ~whole & text.rlike(r"^---\r?\n")), issue("missing_frontmatter", True, ~whole & ~text.rlike(r"^---\r?\n")), issue("missing_type", True, whole & (F.col("type") == "")),
        *(issue(f"missing_{k}", False, whole & ~F.array_contains("keys", k)) for k in OPTIONAL_FIELDS),
        issue("missing_citation", False, whole & F.col("type").isin(*CITED_TYPES) & ~F.col("body").rlike(r"(?m)^#\s+Citations\s*$")),
    ]
    own = parts.select("path", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("path", "i.issue", "i.blocking")
    obsidian = parts.where(whole).select("path", F.explode(F.regexp_extract_all("body", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)))).select("path", F.lit("obsidian_link"), F.lit(False))
    links = parts.where(whole).select("path", F.explode(F.regexp_extract_all("body", F.lit(r"\[[^\]]*\]\((/[^)]+\.md)\)"), F.lit(1))).alias("target"))
    broken = links.join(pages.select(F.col("path").alias("target")), "target", "left_anti").select("path", F.lit("broken_link"), F.lit(False))
    return own.union(obsidian).union(broken)


def conformance_report(issues: DataFrame) -> DataFrame:
    """(line_no, line): a report in markdown, a heading and a line for each kind of issue."""
    counts = issues.groupBy("issue", "blocking").agg(F.count("*").alias("n"))
    order = F.row_number().over(Window.orderBy(F.col("blocking").desc(), "issue"))  # a row a kind of issue
    lines = counts.select((order + 1).alias("line_no"), F.concat(F.lit("- "), F.when(F.col("blocking"), "blocking").otherwise("warning"), F.lit(" "), "issue", F.lit(": "), "n").alias("line"))
    head = issues.sparkSession.createDataFrame([(1, "# Conformance")], "line_no int, line string")
    return head.union(lines)


def candidate_findings(edges: DataFrame, relations: DataFrame) -> DataFrame:
    """(rule, severity, n, penalty): unconfirmed edges block a release, inferred table relations warn."""
    one = edges.where("edge_kind = 'candidate'").agg(F.count("*").alias("n")).select(F.lit("candidateRelationships").alias("rule"), F.lit("blocking").alias("severity"), "n", F.lit(1.0).alias("penalty"))
    two = relations.agg(F.count("*").alias("n")).select(F.lit("tableRelationCandidates").alias("rule"), F.lit("warning").alias("severity"), "n", F.least(F.lit(1.0), F.col("n") / 10).alias("penalty"))
    return one.union(two).where("n > 0")


def canonical_names(rows: DataFrame, columns: list[str], aliases: DataFrame) -> DataFrame:
    """Rows with the named columns as canonical table names where an alias of one is meant."""
    known = aliases.select("table", alias_key_query(F.col("alias")).alias("_k")).union(aliases.select("table", alias_key_query(F.col("table")))).distinct()
    known = known.groupBy("_k").agg(F.min("table").alias("_table"))
    for c in columns:
        rows = rows.withColumn("_k", alias_key_query(F.col(c))).join(known, "_k", "left").withColumn(c, F.coalesce("_table", c)).drop("_k", "_table")
    return rows


def navigation_index(nodes: DataFrame, per_type: int = 120) -> DataFrame:
    """(type, listing, omitted): labels of a type in order, ``per_type`` at most; fields and labels that are
    blank, long, markup or no words are left out."""
    own = nodes.where(indexable())
    few = first_n(own, ["type"], [F.col("label"), F.col("id")], per_type)
    rows = few.groupBy("type").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    counts = own.groupBy("type").agg(F.greatest(F.count("*") - per_type, F.lit(0)).alias("omitted"))
    return rows.join(counts, "type").select("type", F.array_join("labels", "\n").alias("listing"), "omitted")


def schema_assets(fields: DataFrame) -> DataFrame:
    """(table, schema): each table's fields as JSON, in order. ``fields``: (table, place, field)."""
    rows = fields.groupBy("table").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "field"))), lambda x: x["field"]).alias("fields"))
    return rows.select("table", F.to_json(F.struct(F.col("table").alias("table_name"), "fields")).alias("schema"))


# retrieval -------------------------------------------------------------------------------------
def align_tables(hits: DataFrame, page_tables: DataFrame) -> DataFrame:
    """Hits with the tables of their page; without any, the field ``tables`` explains nothing. ``hits`` has an
    array column ``fields``; ``page_tables``: (component_id, tables)."""
    tables = F.coalesce("tables", F.array().cast("array<string>"))
    joined = hits.join(page_tables, "component_id", "left").withColumn("tables", tables)
    return joined.withColumn("fields", F.when(F.size("tables") > 0, F.col("fields")).otherwise(F.array_remove("fields", "tables")))


def kb_search(rankings: list[DataFrame], visible, fallback, queries: DataFrame, limit: int, rerank=None) -> DataFrame:
    """(query_id, component_id, score, rank, mode): rankings fused, filtered by what a role may see, reranked where a
    scorer is given, and cut; queries that are left without a hit get their fallback hits. ``fallback`` takes those queries (query_id) and
    gives (query_id, component_id, score)."""
    from tessera.operators.retrieval import fuse, pool_size, top_by_query

    cut = lambda r: r.where(F.col("rank") <= pool_size(limit))
    pool = visible(top_by_query(fuse([cut(r) for r in rankings]), pool_size(limit)))
    hits = top_by_query(pool.drop("rank"), limit) if rerank is None else rerank(pool, limit)
    hits = stored(hits.select("query_id", "component_id", "score", "rank", F.lit("hybrid_rrf").alias("mode")), "hits")
    without = queries.select("query_id").join(hits.select("query_id").distinct(), "query_id", "left_anti")
    rest = top_by_query(visible(fallback(without)), limit)
    return hits.union(rest.select("query_id", "component_id", "score", "rank", F.lit("fallback").alias("mode")))


def fact_coverage(hits: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, facts, found): expected facts, and those that a text of the query's hits holds."""
    # with their size known, few hits are sent to the texts and the texts stay where they are
    asked = stored(hits.select("query_id", "component_id").join(facts, "query_id"), "asked")
    met = asked.join(texts, "component_id").where(F.contains("body", F.col("fact"))).select("query_id", "fact").distinct()
    counts = met.groupBy("query_id").agg(F.count("*").alias("found"))
    return facts.groupBy("query_id").agg(F.count("*").alias("facts")).join(counts, "query_id", "left").select("query_id", "facts", F.coalesce("found", F.lit(0)).alias("found"))


def insert_latest(target: DataFrame, outer: DataFrame, inner: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``target`` with a row for each key of ``outer`` that it lacks, taken from the latest of ``inner``."""
    missing = outer.select(key).distinct().join(target, key, "left_anti")
    values = [c for c in target.columns if c != key]
    latest = inner.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_r")).select(key, "_r.*")
    return target.unionByName(missing.join(latest, key).select(*target.columns))


def sweep(projects: list[str], job) -> list[tuple[str, str]]:
    """(project, outcome) of a job run for one project after the other; an error stays with its project."""
    out = []
    for project in projects:
        try:
            job(project)
            out.append((project, "done"))
        except Exception as e:  # noqa: BLE001
            out.append((project, f"failed: {e}"))
    return out
