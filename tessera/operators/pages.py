"""Pages from markdown: extraction without a model, dependency sections, specs; columns of a grid by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import alias_key_query

# fixed values: headings, marks and column names that the formats define
DEPENDENCY_HEADINGS = ["data dependencies", "配置表依赖", "关联配置表", "数据依赖", "表依赖"]
EMPTY_MARK = r"(?i)^(?:[(（]?\s*(?:无|none|n/a|na|null|no)\s*[)）]?|[-*]\s*(?:无|none|n/a|na|null|no))$"
STRUCTURE_HEADING = "章节结构"
KEY_HEADERS = ["key", "fact", "facts", "fact key"]
REQUIRED_HEADERS = ["required", "必填", "是否必填"]
REQUIRED_VALUES = ["yes", "required", "true", "必填", "是"]
FACT_SECTIONS = "fact|dependencies|依赖"

FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
NAME = r"[A-Za-z_][A-Za-z0-9_-]*"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _last(text: Column, pattern: str) -> Column:
    """What the last match holds, trimmed; null without one."""
    return _trim(F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1)))


def _block(front: Column, key: str) -> Column:
    """The indented lines below ``key:``; empty without them."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(front, F.lit(rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t][^\n]*(?:\n|\z))*)"), F.lit(1)), F.lit(-1)), F.lit(""))


def _map(block: Column) -> Column:
    keys = F.regexp_extract_all(block, F.lit(rf"(?m)^[ \t]+({NAME}):[^\n]*$"), F.lit(1))
    values = F.regexp_extract_all(block, F.lit(rf"(?m)^[ \t]+{NAME}:([^\n]*)$"), F.lit(1))
    # a key given twice keeps its last value
    last = lambda k: F.element_at(values, (F.size(keys) - F.array_position(F.reverse(keys), k) + 1).cast("int"))
    return F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), _trim(last(k)).alias("value"))))


def _objects(block: Column, names: list[str]) -> Column:
    """The list items of a block that give every one of ``names``, as structs."""
    start = rf"[ \t]*-[ \t]+{NAME}:"
    items = F.regexp_extract_all(block, F.lit(rf"(?m)^[ \t]*-[ \t]+({NAME}:[^\n]*(?:\n(?!{start})[^\n]*)*)"), F.lit(1))
    rows = F.transform(items, lambda x: F.struct(*(_last(x, rf"(?m)^[ \t]*{n}:([^\n]*)$").alias(n) for n in names)))
    given = lambda x, n: F.coalesce(x[n], F.lit("")) != ""

    def every(x: Column) -> Column:
        out = given(x, names[0])
        for n in names[1:]:
            out &= given(x, n)
        return out

    return F.filter(rows, every)


def extract_page(markdown: Column, path: Column) -> Column:
    """struct(type, title, source, facts, entities, relationships, body, method): ``structured`` where frontmatter
    gives a type and a title; else ``fallback``, a concept named by its first heading or its file. A null text is
    an empty one. Stays a Column: a page is one row, so its length is all that a task holds."""
    text = F.regexp_replace(F.coalesce(markdown, F.lit("")), "\r\n", "\n")
    front, rest = F.regexp_extract(text, FRONT, 1), F.when(text.rlike(FRONT), F.regexp_extract(text, FRONT, 2)).otherwise(text)
    scalar = lambda k: _last(front, rf"(?m)^{k}:[ \t]*(\S[^\n]*)$")
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    heading = _trim(F.regexp_extract(rest, r"(?m)^#[ \t]+(\S[^\n]*)$", 1))
    named = F.array_join(F.transform(F.split(F.regexp_replace(stem, "[-_]+", " "), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")
    title = F.when(heading != "", heading).otherwise(named)
    entity = "array<struct<name:string,type:string>>"
    relation = "array<struct<source:string,relation:string,target:string>>"
    structured = F.struct(
        scalar("type").alias("type"), scalar("title").alias("title"), F.coalesce(scalar("source"), F.lit("")).alias("source"), _map(_block(front, "facts")).alias("facts"),
        _objects(_block(front, "entities"), ["name", "type"]).cast(entity).alias("entities"),
        _objects(_block(front, "relationships"), ["source", "relation", "target"]).cast(relation).alias("relationships"), rest.alias("body"), F.lit("structured").alias("method"),
    )
    fallback = F.struct(
        F.lit("concept").alias("type"), title.alias("title"), F.concat(F.lit("processed/parsed/"), path).alias("source"), F.lit(None).cast("map<string,string>").alias("facts"),
        F.array(F.struct(title.alias("name"), F.lit("concept").alias("type"))).cast(entity).alias("entities"), F.array().cast(relation).alias("relationships"), rest.alias("body"), F.lit("fallback").alias("method"),
    )
    return F.when(scalar("type").isNotNull() & scalar("title").isNotNull(), structured).otherwise(fallback)


def _heading(part: Column) -> Column:
    """The heading that a part of a page starts with; empty for what stands before the first one."""
    return _trim(F.regexp_extract(part, r"^#{1,6}[ \t]+(\S[^\n]*)", 1))


def rewrite_dependencies(body: Column, aliases: Column, tables: Column) -> Column:
    """The body with table aliases annotated in its dependency sections, and with a line for each of ``tables`` in
    its section "Data Dependencies", which is added where it is missing.

    ``aliases``: array of struct(alias, canonical); longer ones apply first. ``tables``: array of names. A null
    body is empty; a line that names the canonical table already is left alone. Line ends become ``\\n``."""
    parts = F.split(F.regexp_replace(F.coalesce(body, F.lit("")), "\r\n", "\n"), r"\n(?=#{1,6}[ \t]+\S)")
    ordered = F.sort_array(F.transform(aliases, lambda a: F.struct((-F.char_length(a["alias"])).alias("n"), a["alias"].alias("alias"), a["canonical"].alias("canonical"))))
    wanted = F.transform(F.array_sort(F.array_distinct(tables)), lambda x: F.concat(F.lit("- "), x))

    def line(text: Column) -> Column:
        step = lambda acc, a: F.when(F.contains(acc, a["alias"]) & ~F.contains(acc, a["canonical"]), F.replace(acc, a["alias"], F.concat(a["alias"], F.lit("（"), a["canonical"], F.lit("）")))).otherwise(acc)
        return F.aggregate(ordered, text, step)

    def annotated(part: Column) -> Column:
        lines = F.split(part, "\n")
        return F.when(F.lower(_heading(part)).isin(*DEPENDENCY_HEADINGS), F.array_join(F.transform(lines, lambda x, i: F.when(i == 0, x).otherwise(line(x))), "\n")).otherwise(part)

    done = F.transform(parts, annotated)
    is_home = lambda part: F.lower(_heading(part)) == "data dependencies"
    home = F.array_position(F.transform(done, is_home), F.lit(True))

    def filled(part: Column) -> Column:
        lines = F.split(part, "\n")
        head, rest = F.element_at(lines, 1), F.slice(lines, F.lit(2), F.size(lines))
        text = _trim(F.array_join(rest, "\n"))
        more = F.filter(wanted, lambda w: ~F.contains(text, F.substring(w, 3, 1 << 30)))
        return F.array_join(F.when((text == "") | text.rlike(EMPTY_MARK), F.concat(F.array(head), wanted)).otherwise(F.concat(F.array(head), rest, more)), "\n")

    whole = F.array_join(F.transform(done, lambda p, i: F.when(i + 1 == home, filled(p)).otherwise(p)), "\n")
    added = F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n\n## Data Dependencies\n"), F.array_join(wanted, "\n"))
    return F.when(F.size(wanted) == 0, F.array_join(done, "\n")).when(home > 0, whole).otherwise(added)


def spec_sections(markdown: Column) -> Column:
    """Sections that a spec demands: those in backticks below the structure heading, else its own headings."""
    parts = F.split(F.regexp_replace(F.coalesce(markdown, F.lit("")), "\r\n", "\n"), r"\n(?=##[ \t]+\S)")
    heads = F.filter(F.transform(parts, lambda p: _trim(F.regexp_extract(p, r"^##[ \t]+(\S[^\n]*)", 1))), lambda h: h != "")
    own = F.filter(parts, lambda p: _trim(F.regexp_extract(p, r"^##[ \t]+(\S[^\n]*)", 1)) == STRUCTURE_HEADING)
    listed = F.flatten(F.transform(own, lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"`##[ \t]+([^`\n]+?)`"), F.lit(1)), _trim)))
    return F.when(F.size(listed) > 0, listed).otherwise(heads)


def spec_facts(specs: DataFrame, key: str = "spec") -> DataFrame:
    """(key, fact, place): fact keys that a spec's tables mark as required, in the order of their first mention.
    ``specs``: (key, markdown). A table counts from its first row with a key column; without a column of
    required marks it counts only below a heading that says that its facts are required, and then in full."""
    text = F.regexp_replace(F.coalesce("markdown", F.lit("")), "\r\n", "\n")
    rows = specs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("line", r"^##[ \t]+(\S[^\n]*)", 1)
    bare = F.regexp_replace(F.regexp_replace("line", r"^\s*\|", ""), r"\|\s*$", "")
    rows = rows.withColumn("cells", F.transform(F.split(bare, r"\|"), _trim)).withColumn("breaks", (head != "") | ~F.contains("line", F.lit("|")) | (F.size("cells") < 2))
    rows = rows.select(key, "at", "cells", "breaks", F.lower(F.coalesce(F.last(F.when(head != "", _trim(head)), True).over(before), F.lit(""))).alias("section"), F.sum(F.col("breaks").cast("int")).over(before).alias("run"))
    rows = rows.where(~F.col("breaks") & ~F.forall("cells", lambda c: c.rlike(r"^:?-{3,}:?$")))
    place = lambda names: F.array_position(F.transform("cells", lambda c: F.lower(F.regexp_replace(c, "^`+|`+$", "")).isin(*names)), F.lit(True))
    forced = F.contains("section", F.lit("facts")) & F.contains("section", F.lit("必填")) & F.contains("section", F.lit("key"))
    example = (F.col("section") == "示例") | F.contains("section", F.lit("example"))
    open_ = (place(REQUIRED_HEADERS) > 0) & ~example & (F.col("section").rlike(FACT_SECTIONS) | (F.col("section") == "") | (F.size("cells") >= 3))
    rows = rows.withColumns({"forced": forced, "k": place(KEY_HEADERS), "r": place(REQUIRED_HEADERS)}).withColumn("starts", (F.col("k") > 0) & (forced | open_))
    first = rows.where("starts").groupBy(key, "run").agg(F.min_by(F.struct("at", "k", "r", "forced"), "at").alias("h"))
    body = rows.select(key, "run", "at", "cells").join(first, [key, "run"]).where("at > h.at AND h.k <= size(cells)")
    cell = lambda i: F.try_element_at("cells", F.col(i).cast("int"))
    marked = F.when(F.col("h.r") > 0, F.coalesce(F.lower(F.try_element_at("cells", F.greatest(F.col("h.r"), F.lit(1)).cast("int"))).isin(*REQUIRED_VALUES), F.lit(False))).otherwise(F.col("h.forced"))
    ticked = F.regexp_extract_all(cell("h.k"), F.lit("`([^`]+)`"), F.lit(1))
    names = F.flatten(F.transform(F.when(F.size(ticked) > 0, ticked).otherwise(F.array(cell("h.k"))), lambda v: F.split(v, r"\s*/\s*")))
    facts = body.where(marked).select(key, "at", F.posexplode(F.transform(names, lambda v: _trim(F.regexp_replace(v, "^`+|`+$", "")))).alias("n", "fact")).where("fact <> ''")
    return facts.groupBy(key, "fact").agg(F.min(F.struct("at", "n")).alias("m")).select(key, "fact", F.row_number().over(Window.partitionBy(key).orderBy("m")).alias("place"))


def field_columns(cells: DataFrame, headers: DataFrame, fields: DataFrame) -> DataFrame:
    """(table, field, col_idx, raw_key, method): which column holds which field of a schema.

    ``cells``: (table, row_idx, col_idx, value); ``headers``: (table, row_idx); ``fields``: (table, place, field), places
    from 0. ``header``: the first column whose header is the field but for case and separators; ``schema_order``: else the column
    at the field's place, if no header took it; ``no_column``: a field without a column; ``no_field``: a column with
    values and no field. A column's raw key is its label in the first row with values, else its header, else its number;
    repeats get _2, _3 and so on."""
    own = cells.where(F.trim("value") != "").join(headers.select("table", F.col("row_idx").alias("header_idx")), "table").withColumn("value", F.trim("value"))
    width = own.groupBy("table").agg((F.max("col_idx") + 1).alias("n"), F.least(F.min("row_idx"), F.min("header_idx")).alias("label_idx"))
    count = fields.groupBy("table").agg((F.max("place") + 1).alias("m"))
    spine = width.join(count, "table", "left").select("table", "label_idx", F.explode(F.sequence(F.lit(0), (F.greatest("n", "m") - 1).cast("int"))).alias("col_idx"))
    at = lambda c: F.max(F.when(F.col("row_idx") == F.col(c), F.col("value")))
    seen = own.join(width.select("table", "label_idx"), "table").groupBy("table", "col_idx").agg(at("header_idx").alias("header"), at("label_idx").alias("label"))
    columns = spine.join(seen, ["table", "col_idx"], "left")
    columns = columns.withColumn("name", F.coalesce("label", "header", F.concat(F.lit("column_"), F.col("col_idx") + 1)))
    nth = F.row_number().over(Window.partitionBy("table", "name").orderBy("col_idx"))
    columns = columns.select("table", "col_idx", "header", F.when(nth == 1, F.col("name")).otherwise(F.concat_ws("_", "name", nth)).alias("raw_key"))
    filled = own.select("table", "col_idx").distinct().withColumn("filled", F.lit(True))
    keyed = fields.groupBy("table", alias_key_query(F.col("field")).alias("k")).agg(F.max_by("field", "place").alias("field"))
    hits = columns.where("header IS NOT NULL").withColumn("k", alias_key_query(F.col("header"))).join(keyed, ["table", "k"])
    by_header = hits.groupBy("table", "field").agg(F.min("col_idx").alias("col_idx")).withColumn("method", F.lit("header"))
    rest = fields.join(by_header.select("table", "field"), ["table", "field"], "left_anti").withColumnRenamed("place", "col_idx")
    free = rest.join(by_header.select("table", "col_idx", F.lit(True).alias("taken")), ["table", "col_idx"], "left")
    placed = free.select("table", "field", F.when(F.col("taken").isNull(), F.col("col_idx").cast("int")).alias("col_idx"), F.when(F.col("taken").isNull(), "schema_order").otherwise("no_column").alias("method"))
    mapped = by_header.select("table", "field", "col_idx", "method").union(placed)
    out = mapped.join(columns.select("table", "col_idx", "raw_key"), ["table", "col_idx"], "left").select("table", "field", "col_idx", "raw_key", "method")
    unused = columns.join(filled, ["table", "col_idx"]).join(mapped.select("table", "col_idx"), ["table", "col_idx"], "left_anti")
    return out.union(unused.select("table", F.lit(None).cast("string"), "col_idx", "raw_key", F.lit("no_field")))
