"""Markdown pages: frontmatter, sections, citations, dependencies, links, rendering and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import alias_key_query, strip
from tessera.operators.containment import contained

#: Keys that name no table in particular, and sections that are not text.
GENERIC = ["config", "配置", "table", "表", "data", "数据", "配置表", "config表"]
UTILITY = ["trust", "citations", "引用", "证据"]
OKF_TYPES = [("activities/", "activity_template"), ("systems/", "system_rule"), ("tables/", "table_schema"), ("fields/", "field_definition"), ("numeric_rules/", "numeric_rule"), ("ui_flows/", "ui_flow"), ("concepts/", "concept")]


def frontmatter(markdown: Column) -> Column:
    """struct(front, body, unclosed) of a page that may open with ``---``."""
    opened = markdown.rlike(r"^---\r?\n")
    closed = markdown.rlike(r"(?s)^---\r?\n.*?\r?\n---(?:\r?\n|$)")
    front = F.regexp_extract(markdown, r"(?s)^---\r?\n(.*?)\r?\n---(?:\r?\n|$)", 1)
    body = F.regexp_replace(markdown, r"(?s)^---\r?\n.*?\r?\n---(?:\r?\n|$)", "")
    return F.struct(F.when(closed, front).otherwise("").alias("front"), F.when(closed, body).otherwise(markdown).alias("body"), (opened & ~closed).alias("unclosed"))


def top_level_keys(front: Column) -> Column:
    return F.regexp_extract_all(front, F.lit(r"(?m)^([A-Za-z_][A-Za-z0-9_]*):"), F.lit(1))


def sections(pages: DataFrame, key: str = "component_id", body: str = "body") -> DataFrame:
    """(key, section, level, heading, content): text under each heading of one to six marks; what comes
    before the first heading is left out."""
    lines = pages.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("line_no", "line"))
    mark = F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 1)
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = lines.withColumn("mark", mark).withColumn("section", F.sum((F.col("mark") != "").cast("int")).over(order)).where("section > 0")
    rows = F.sort_array(F.collect_list(F.when(F.col("mark") == "", F.struct("line_no", "line"))))
    return numbered.groupBy(key, "section").agg(
        F.max(F.char_length("mark")).alias("level"), F.max(F.when(F.col("mark") != "", F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1)))).alias("heading"),
        strip(F.array_join(F.transform(rows, lambda x: x["line"]), "\n")).alias("content"),
    )


def section_text(parts: DataFrame, heading: str, key: str = "component_id") -> DataFrame:
    """(key, text): a section with its deeper ones, up to the next heading as high or higher."""
    start = parts.where(F.lower("heading") == heading.lower()).groupBy(key).agg(F.min(F.struct("section", "level")).alias("s"))
    later = parts.join(start, key).where(F.col("section") > F.col("s.section"))
    stop = later.where(F.col("level") <= F.col("s.level")).groupBy(key).agg(F.min("section").alias("stop"))
    own = parts.join(start, key).join(stop, key, "left").where((F.col("section") >= F.col("s.section")) & (F.col("stop").isNull() | (F.col("section") < F.col("stop"))))
    text = F.when(F.col("section") == F.col("s.section"), F.col("content")).otherwise(F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("heading"), F.lit("\n"), F.col("content")))
    rows = own.select(key, "section", text.alias("t")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("section", "t"))).alias("r"))
    return rows.select(key, strip(F.array_join(F.transform("r", lambda x: x["t"]), "\n")).alias("text"))


def strip_utility(body: Column) -> Column:
    """The body without its top-level trust and citation sections."""
    step = lambda acc, line: F.struct(
        F.when(line.rlike(r"^#\s+.+$"), F.lower(F.trim(F.regexp_extract(line, r"^#\s+(.+)$", 1))).isin(*UTILITY)).otherwise(acc["skip"]).alias("skip"),
        F.when(F.when(line.rlike(r"^#\s+.+$"), F.lower(F.trim(F.regexp_extract(line, r"^#\s+(.+)$", 1))).isin(*UTILITY)).otherwise(acc["skip"]), acc["out"]).otherwise(F.concat(acc["out"], line, F.lit("\n"))).alias("out"),
    )
    return strip(F.aggregate(F.split(body, r"\r?\n"), F.struct(F.lit(False).alias("skip"), F.lit("").alias("out")), step)["out"])


def citations(parts: DataFrame, key: str = "component_id") -> DataFrame:
    """(key, n, quote, evidence_id, source, confidence) of lines ``n. quote (id; source s; confidence c)``;
    without an id the page and number name it."""
    lines = parts.where(F.lower("heading").isin("citations", "引用", "证据")).select(key, F.explode(F.split("content", r"\r?\n")).alias("line"))
    get = lambda p, g=1: F.regexp_extract("line", p, g)
    rows = lines.where(F.col("line").rlike(r"^\s*\d+\.\s+")).select(key, get(r"^\s*(\d+)\.").cast("int").alias("n"), F.trim(get(r"^\s*\d+\.\s+(.*?)(?:\s*\([^()]*\))?\s*$")).alias("quote"), get(r"\(([^();]+)(?:;[^()]*)?\)\s*$").alias("id"), F.trim(get(r"source\s+([^;()]+)")).alias("source"), get(r"confidence\s+([\d.]+)").alias("c"))
    return rows.select(key, "n", "quote", F.when(F.col("id") != "", F.trim("id")).otherwise(F.concat_ws(":", F.lit("okf"), key, "n")).alias("evidence_id"), "source", F.expr("try_cast(c AS double)").alias("confidence"))


def dependency_hints(parts: DataFrame, key: str = "component_id") -> DataFrame:
    """(key, hint): lines of dependency sections without bullets, empty marks and numbered titles."""
    own = parts.where(F.lower("heading").rlike(r"data dependencies|关联配置表|依赖"))
    lines = own.select(key, F.explode(F.split("content", r"\r?\n")).alias("line")).select(key, F.trim(F.regexp_replace("line", r"^\s*[-*+]\s+", "")).alias("hint"))
    return lines.where((F.col("hint") != "") & ~F.col("hint").isin("无", "none", "None") & ~F.col("hint").rlike(r"^\d+-\d+.*[:：]$"))


def resolve_hints(hints: DataFrame, tables: DataFrame, aliases: DataFrame, key: str = "component_id") -> DataFrame:
    """(key, hint, table, step): a hint is a table by its name (1), by an alias (2), by a name of four characters or more that it contains
    (3), or by an alias of four characters or two Han characters in a row that it contains (4). The first step that finds one counts; a
    hint of a word that any table has stops after the first."""
    h = hints.withColumn("k", alias_key_query(F.col("hint"))).where("k <> ''")
    names = tables.select("table", alias_key_query(F.col("table")).alias("k")).where("k <> ''")
    other = aliases.select("table", alias_key_query(F.col("alias")).alias("k")).where("k <> ''")
    exact = h.join(names, "k").select(key, "hint", "table", F.lit(1).alias("step"))
    open_ = h.where(~F.col("k").isin(*GENERIC))
    alias = open_.join(other, "k").select(key, "hint", "table", F.lit(2).alias("step"))
    texts = open_.select(F.col("k").alias("text"))

    def inside(keys: DataFrame, step: int) -> DataFrame:
        found = contained(texts, keys.select(F.col("k").alias("pattern"))).withColumnRenamed("text", "k")
        return open_.join(found, "k").join(keys.select(F.col("k").alias("pattern"), "table"), "pattern").select(key, "hint", "table", F.lit(step).alias("step"))

    long = F.char_length("k") >= 4
    every = exact.union(alias).union(inside(names.where(long), 3)).union(inside(other.where(long | F.col("k").rlike(r"\p{IsHan}{2}")), 4))
    first = Window.partitionBy(key, "hint")
    return every.withColumn("_m", F.min("step").over(first)).where("step = _m").drop("_m").distinct()


def links(body: Column) -> Column:
    """Targets of markdown and obsidian links."""
    return F.concat(F.regexp_extract_all(body, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)), F.regexp_extract_all(body, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)))


def description(body: Column, length: int = 60) -> Column:
    """The first line that is text, cut."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(?:#|\||[-*+]\s|---|>)"))
    return F.substring(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), 1, length)


def okf_type(path: Column) -> Column:
    out = F.when(F.startswith(path, F.lit("graph/")), "graph_snapshot")
    for prefix, name in OKF_TYPES:
        out = out.when(F.contains(path, F.lit(prefix)), name)
    return out.otherwise("wiki_page")


def render_page(title: Column, kind: Column, component_id: Column, body: Column, trust: Column, cited: Column) -> Column:
    """A page as markdown: frontmatter, body, trust and citations (an array of lines)."""
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), title), F.concat(F.lit("type: "), kind), F.concat(F.lit("component_id: "), component_id), F.lit("---"))
    numbered = F.transform(cited, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.concat_ws("\n", front, body, F.lit("# Trust"), F.concat(F.lit("score: "), trust.cast("string")), F.lit("# Citations"), F.array_join(numbered, "\n"))


def rewrite_problems(markdown: Column, evidence_ids: Column, source: Column) -> Column:
    """What is wrong with a rewritten page: tables out of shape, citations that don't exist, numbers
    that the source does not have."""
    rows = F.filter(F.split(markdown, r"\r?\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$"))
    widths = F.array_distinct(F.transform(rows, lambda x: F.size(F.split(x, r"\|"))))
    cited = F.array_distinct(F.regexp_extract_all(markdown, F.lit(r"\[\^?([A-Za-z]+[-_][A-Za-z0-9_-]+)\]"), F.lit(1)))
    numbers = F.array_distinct(F.regexp_extract_all(markdown, F.lit(r"(?<![A-Za-z0-9_.-])(\d+(?:\.\d+)?)"), F.lit(1)))
    known = F.regexp_extract_all(source, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    each = F.array(F.when(F.size(widths) > 1, "table_shape"), F.when(F.size(F.array_except(cited, evidence_ids)) > 0, "unknown_citation"), F.when(F.size(F.array_except(numbers, known)) > 0, "unknown_number"))
    return F.filter(each, lambda x: x.isNotNull())


def override(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Pages with annotations applied: a new title, type or body where one is given."""
    e = edits.select("component_id", *(F.col(c).alias(f"_{c}") for c in ("title", "type", "body")))
    joined = pages.join(e, "component_id", "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("title", "type", "body") else F.col(c) for c in pages.columns))


def spec_score(sections_have: Column, sections_need: Column, facts_have: Column, facts_need: Column, body: Column) -> Column:
    """0.45 structure, 0.35 facts and 0.20 for a body that isn't empty."""
    share = lambda have, need: F.when(F.size(need) == 0, 1.0).otherwise(F.size(F.array_intersect(need, have)) / F.size(need))
    return 0.45 * share(sections_have, sections_need) + 0.35 * share(facts_have, facts_need) + 0.20 * (F.trim(body) != "").cast("double")
