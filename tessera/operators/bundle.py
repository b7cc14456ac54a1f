"""Pages of a release bundle, rendered and parsed; page lookup, edits by annotation, navigation, rules on candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize_path, yaml_scalar
from tessera.operators.documents import description, frontmatter

#: Kinds that a page's tags may name, the version of trust that pages carry, headings of citations, and limits of the navigation index.
TAGGED_KINDS = ["wiki_page", "table_wiki_page"]
TRUST_VERSION = "v2-lite"
CITED = "(?:Citations|引用|证据)"
PER_TYPE, RELATIONS = 120, 200
#: Labels of digits and punctuation alone, and labels with markup, are no names.
NO_NAME, MARKUP, LONGEST = r"""^[\d\s.,;:_/\-+*<>{}()\[\]'"，。、；：]+$""", r"(?i)</?[a-z][\s\S]*>", 80
TRUST_PARTS = ["evidence", "completeness", "auditFreshness", "consistency"]


# rendering ---------------------------------------------------------------------------------------
def quoted(text: Column) -> Column:
    """A text as a double-quoted scalar on one line."""
    return F.regexp_replace(F.to_json(F.array(F.coalesce(text, F.lit("")))), r"^\[|\]$", "")


def number(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def render(page: dict[str, Column], tags: Column, trust: Column, cited: Column) -> Column:
    """A page as markdown; the keys and headings are the bundle's fixed format. ``page``: type, title, body, published_at, component_id, package_id, artifact_id, profile_hash. ``trust``: struct(score, status, the
    parts, lastTrustedAuditAt, caps) or null. ``cited``: array of (quote, evidence_id, source, confidence, note)."""
    body = F.when(F.trim(page["body"]) != "", page["body"]).otherwise(F.concat(F.lit("# "), page["title"], F.lit("\n")))
    described = F.coalesce(F.nullif(description(body, 1 << 20), F.lit("")), page["title"])
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    known = F.array_join(F.transform(F.array_distinct(tags), quoted), ", ")
    front = [
        F.lit("---"), line("type", quoted(page["type"])), line("title", quoted(page["title"])), line("description", quoted(described)), F.concat(F.lit("tags: ["), known, F.lit("]")),
        line("timestamp", quoted(page["published_at"])), line("resource", quoted(F.concat(F.lit("kh://component/"), page["component_id"]))), F.lit("kh:"),
        line("  componentId", quoted(page["component_id"])), line("  packageId", quoted(page["package_id"])), line("  artifactId", quoted(page["artifact_id"])), line("  legislationProfileHash", quoted(page["profile_hash"])),
    ]
    parts = [line(f"    {p}", number(trust[p])) for p in TRUST_PARTS]
    scored = F.concat_ws("\n", F.lit("  trust:"), line("    version", quoted(F.lit(TRUST_VERSION))), line("    score", number(trust["score"])), line("    status", quoted(trust["status"])), *parts, line("    lastTrustedAuditAt", quoted(trust["lastTrustedAuditAt"])))
    caps = F.when(F.size(trust["caps"]) > 0, F.array_join(trust["caps"], "; ")).otherwise("none")
    section = F.concat_ws("\n", F.lit(""), F.lit("# Trust"), F.lit(""), line("- score", number(trust["score"])), line("- status", trust["status"]), *(line(f"- {p}", number(trust[p])) for p in TRUST_PARTS), line("- caps", caps), F.lit(""))
    flat = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    row = lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(F.nullif(flat(c["quote"]), F.lit("")), F.lit("Evidence record")), F.lit(" ("), c["evidence_id"], F.lit("; source "), c["source"], F.lit("; confidence "), number(c["confidence"]), F.when(flat(c["note"]) != "", F.concat(F.lit("; "), flat(c["note"]))).otherwise(""), F.lit(")"))
    citations = F.when(F.size(cited) > 0, F.concat(F.lit("\n# Citations\n\n"), F.array_join(F.transform(cited, row), "\n"), F.lit("\n"))).otherwise("\n")
    head = F.concat_ws("\n", *front, F.when(trust.isNotNull(), scored), F.lit("---"), F.lit(""))
    return F.concat(head, F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit("\n"), F.when(trust.isNotNull(), section).otherwise(""), citations)


# parsing -----------------------------------------------------------------------------------------
def page_citations(body: Column) -> Column:
    """Array of (n, quote, evidence_id, source, confidence) below the first heading of citations, up to the next heading of that level."""
    text = F.regexp_extract(body, rf"(?ms)^#\s+(?i:{CITED})[ \t]*$(.*?)(?=^#\s+\S|\z)", 1)
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+\.\s+\S"))
    get = lambda x, form: F.regexp_extract(x, form, 1)
    meta = r"\(([^()]*)\)$"
    return F.transform(lines, lambda x: F.struct(
        get(x, r"^(\d+)\.").cast("int").alias("n"), get(x, r"^\d+\.\s+(.+?)(?:\s+\([^()]*\))?$").alias("quote"),
        F.trim(get(get(x, meta), r"^([^;]*)")).alias("evidence_id"), F.trim(get(get(x, meta), r";\s*source\s+([^;]*)")).alias("source"),
        F.trim(get(get(x, meta), r";\s*confidence\s+([^;]*)")).try_cast("double").alias("confidence")))


def parse_pages(pages: DataFrame) -> DataFrame:
    """(path, component_id, package_id, artifact_id, title, description, type, kind, trust, citations, body) of (path, markdown). Pages without closed frontmatter or
    without a component are left out. Trust is null unless the page carries a score of the known version."""
    split = pages.select("path", frontmatter(F.col("markdown")).alias("p")).select("path", "p.front", "p.body").where("front <> ''")
    get = lambda key: yaml_scalar(F.col("front"), key)
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.md$", "")
    artifact, tags = F.coalesce(get("artifactId"), F.regexp_replace("path", "^/", "")), F.coalesce(get("tags"), F.lit(""))
    # a tag of the second kind holds the name of the first, which is looked for first
    kind = F.when(F.contains(tags, F.lit(TAGGED_KINDS[0])), TAGGED_KINDS[0]).when(F.startswith(artifact, F.lit("wiki/tables/")), TAGGED_KINDS[1]).otherwise(TAGGED_KINDS[0])
    real = lambda key: get(key).try_cast("double")
    trust = F.when(real("score").isNotNull() & (get("version") == TRUST_VERSION), F.struct(real("score").alias("score"), get("status").alias("status"), *(F.coalesce(real(p), F.lit(0.0)).alias(p) for p in TRUST_PARTS), F.nullif(get("lastTrustedAuditAt"), F.lit("")).alias("lastTrustedAuditAt")))
    out = split.select(
        "path", get("componentId").alias("component_id"), get("packageId").alias("package_id"), artifact.alias("artifact_id"), F.coalesce(get("title"), name).alias("title"),
        get("description").alias("description"), F.coalesce(get("type"), F.lit("knowledge_note")).alias("type"), kind.alias("kind"), trust.alias("trust"), page_citations(F.col("body")).alias("citations"), "body",
    )
    return out.where(F.coalesce("component_id", F.lit("")) != "")


# lookup ------------------------------------------------------------------------------------------
def lookup_keys(pages: DataFrame) -> DataFrame:
    """(component_id, path, key): the thirteen spellings under which a parsed page is found, case, slashes and spaces aside."""
    bare = lambda c: F.regexp_replace(c, r"(?i)\.md$", "")
    base, short = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_replace("artifact_id", "^wiki/", "")
    heading = F.trim(F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1))
    keys = F.array("component_id", "title", bare(F.col("title")), "description", heading, "artifact_id", bare(F.col("artifact_id")), short, bare(short), "path", F.regexp_replace("path", "^/", ""), base, bare(base))
    spelled = F.array_distinct(F.filter(F.transform(keys, lambda k: normalize_path(k)), lambda k: k.isNotNull() & (k != "")))
    return pages.select("component_id", "path", F.explode(spelled).alias("key"))


def find_pages(pages: DataFrame, requests: DataFrame, hits: DataFrame) -> DataFrame:
    """(request, component_id, how): each request by a key of a page, the first page in the order of paths, else by its first search hit. A hit counts if its score
    is 1 or more and it misses no core word. ``hits``: (request, component_id, score, missed)."""
    asked = requests.select("request").distinct().withColumn("key", normalize_path(F.col("request")))
    exact = asked.join(lookup_keys(pages), "key").groupBy("request").agg(F.min_by("component_id", F.struct("path", "component_id")).alias("component_id"))
    rest = asked.select("request").join(exact.select("request"), "request", "left_anti")
    found = hits.where("score >= 1 AND NOT missed").join(rest, "request", "left_semi")
    return exact.select("request", "component_id", F.lit("key").alias("how")).union(found.select("request", "component_id", F.lit("search")))


# edits -------------------------------------------------------------------------------------------
def with_section(body: Column, heading: Column, content: Column) -> Column:
    """The body with the text of one section replaced, up to the next heading of its level or above; a section that is missing is appended as one of the second level."""
    level = lambda line: F.char_length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))
    name = lambda line: F.lower(F.trim(F.regexp_extract(line, r"^#{1,6}\s+(.+)$", 1)))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("level"), F.lit(False).alias("found"))

    def step(acc, line):
        own, skipping = level(line), acc["level"] > 0
        ends = skipping & (own > 0) & (own <= acc["level"])
        begins = ~acc["found"] & (~skipping | ends) & (own > 0) & (name(line) == F.lower(F.trim(heading)))
        out = F.when(begins, F.concat(acc["out"], F.array(line, content))).when(skipping & ~ends, acc["out"]).otherwise(F.concat(acc["out"], F.array(line)))
        return F.struct(out.alias("out"), F.when(begins, own).when(ends, F.lit(0)).otherwise(acc["level"]).alias("level"), (acc["found"] | begins).alias("found"))

    done = F.aggregate(F.split(body, r"\r?\n"), start, step)
    text = F.array_join(done["out"], "\n")
    return F.when(done["found"], text).otherwise(F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n\n## "), heading, F.lit("\n"), content))


def annotate(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Pages (component_id, title, type, facts, body) with their annotations: a new title or type, facts that are set or taken away, then the whole body or one section of it. ``edits``:
    (component_id, title, type, set_facts map, remove_facts array, section, content, body), null where nothing is changed; one row a page."""
    e = edits.select("component_id", *(F.col(c).alias(f"_{c}") for c in ("title", "type", "set_facts", "remove_facts", "section", "content", "body")))
    joined = pages.join(e, "component_id", "left")
    gone = F.coalesce("_remove_facts", F.array().cast("array<string>"))
    given = F.coalesce("_set_facts", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(F.coalesce("facts", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(gone, k) & ~F.array_contains(F.map_keys(given), k))
    whole = F.coalesce("_body", "body")
    body = F.when(F.col("_section").isNotNull(), with_section(whole, F.col("_section"), F.coalesce("_content", F.lit("")))).otherwise(whole)
    return joined.select("component_id", F.coalesce("_title", "title").alias("title"), F.coalesce("_type", "type").alias("type"), F.map_concat(kept, given).alias("facts"), body.alias("body"))


# navigation --------------------------------------------------------------------------------------
def indexable() -> Column:
    """Nodes that the navigation index lists: no fields, and labels that are names."""
    label = F.col("label")
    return (F.col("type") != "field") & (F.trim(label) != "") & (F.char_length(label) <= LONGEST) & ~label.rlike(NO_NAME) & ~label.rlike(MARKUP)


def navigation(nodes: DataFrame, edges: DataFrame, per_type: int = PER_TYPE, relations: int = RELATIONS) -> DataFrame:
    """(section, place, line): lines of the navigation index. A section for each type with its first labels, linked to their pages, and one of relationships with the
    first semantic and key edges; what is left out is counted in a last line. ``nodes``: (id, label, type, wiki_page); ``edges``: (source, relation, target, edge_kind)."""
    label, own = F.col("label"), nodes.where(indexable())
    order = F.row_number().over(Window.partitionBy("type").orderBy("label", "id"))
    first = own.withColumn("place", order).where(F.col("place") <= per_type)
    linked = F.when(F.col("wiki_page").isNotNull(), F.concat(F.lit("["), label, F.lit("]("), F.regexp_replace("wiki_page", "^wiki/", ""), F.lit(")"))).otherwise(label)
    lines = first.select(F.col("type").alias("section"), "place", F.concat(F.lit("- "), linked).alias("line"))
    counts = own.groupBy("type").agg(F.count("*").alias("n")).where(F.col("n") > per_type)
    more = lambda n, what: F.concat(F.lit("- ... "), n.cast("string"), F.lit(f" more omitted; see graph.json for full {what} list."))
    rest = counts.select("type", F.lit(per_type + 1), more(F.col("n") - per_type, "node"))
    kept = edges.where(F.col("edge_kind").isin("semantic", "fk"))
    # the first of all edges: a top-k, not a sort of everything
    some = kept.select("source", "relation", "target").orderBy("source", "relation", "target").limit(relations)
    shown = some.select(F.lit("Relationships"), F.row_number().over(Window.orderBy("source", "relation", "target")), F.concat(F.lit("- "), "source", F.lit(" -"), "relation", F.lit("-> "), "target"))
    left = kept.agg(F.count("*").alias("n")).where(F.col("n") > relations).select(F.lit("Relationships"), F.lit(relations + 1), more(F.col("n") - relations, "relationship"))
    return lines.union(rest).union(shown).union(left)


# rules -------------------------------------------------------------------------------------------
#: Rules on candidates, what they look at, their severity and how a finding counts.
CANDIDATE_RULES = [("candidateRelationships", "wiki/graph.json", "blocking", 1), ("tableRelationCandidates", "wiki/_tables/table_relation_candidates.json", "warning", 10)]


def candidate_findings(edges: DataFrame, relations: DataFrame, profile: DataFrame, dismissals: DataFrame) -> DataFrame:
    """(project_id, rule, ref, severity, n, penalty): unconfirmed edges and inferred table relations of each project, unless its profile has the rule off or the finding was
    dismissed for its file. ``edges``: (project_id, edge_kind); ``relations``: (project_id); ``profile``: (project_id, rule, enabled, severity), missing rows are the
    defaults; ``dismissals``: (project_id, rule, ref)."""
    counted = edges.where("edge_kind = 'candidate'").groupBy("project_id").agg(F.count("*").alias("n")), relations.groupBy("project_id").agg(F.count("*").alias("n"))
    out = None
    for (rule, ref, severity, whole), counts in zip(CANDIDATE_RULES, counted, strict=True):
        rows = counts.select("project_id", F.lit(rule).alias("rule"), F.lit(ref).alias("ref"), F.lit(severity).alias("_severity"), "n", F.least(F.lit(1.0), F.col("n") / whole).alias("penalty"))
        out = rows if out is None else out.union(rows)
    joined = out.join(profile, ["project_id", "rule"], "left").where(F.coalesce("enabled", F.lit(True)))
    open_ = joined.join(dismissals.select("project_id", "rule", "ref"), ["project_id", "rule", "ref"], "left_anti")
    return open_.select("project_id", "rule", "ref", F.coalesce("severity", "_severity").alias("severity"), "n", "penalty")
