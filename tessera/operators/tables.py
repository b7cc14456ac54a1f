"""Spreadsheet tables, inferred relations, graphs and data validation."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import alias_key_query

TECHNICAL = r"^[A-Za-z_][A-Za-z0-9_]*$"
#: What a row of types and uses consists of.
META = r"(?i)^\s*(?:int|long|float|double|number|string|string\(intern\)|bool|boolean|json|array|primary|none|null|client|server|all|both)\s*$"
NUMERIC = r"^\s*[-+]?\d+(?:\.\d+)?\s*$"
SCAN_ROWS = 12


# headers ---------------------------------------------------------------------------------------
def header_row(cells: DataFrame) -> DataFrame:
    """(table, row_idx, kind): the last header row of each grid. ``cells``: (table, row_idx, col_idx, value).
    Of the first twelve rows, technical ones have two technical names or more, a share of them of 0.45 or
    more and a share of type marks under 0.6; the last of these closes the header. Without any, the row
    of labels with the best score (labels less numbers and marks); else the first row."""
    value = F.trim("value")
    few = cells.where((F.col("row_idx") < SCAN_ROWS) & (value != ""))
    meta, number = value.rlike(META), value.rlike(NUMERIC)
    rows = few.groupBy("table", "row_idx").agg(
        F.count("*").alias("filled"), F.count_if(value.rlike(TECHNICAL) & ~meta & ~number).alias("names"), F.count_if(meta).alias("meta"), F.count_if(number).alias("numbers"),
        F.count_if(~meta & ~number & (F.char_length(value) <= 80) & ~value.rlike("[=;{}<>]")).alias("labels"),
    )
    share = lambda c: F.col(c) / F.col("filled")
    technical = (F.col("names") >= 2) & (share("names") >= 0.45) & (share("meta") < 0.6)
    label = (F.col("labels") >= 2) & (share("numbers") < 0.5) & (share("meta") < 0.5)
    score = F.when(technical, F.col("row_idx")).when(label, F.col("labels") - F.col("numbers") - F.col("meta")).otherwise(F.lit(0)).cast("long")
    ranked = rows.select("table", "row_idx", F.when(technical, 1).when(label, 2).otherwise(3).alias("step"), (-score).alias("after"))
    best = ranked.groupBy("table").agg(F.min(F.struct("step", "after", "row_idx")).alias("b"))
    kind = F.element_at(F.array(F.lit("technical"), F.lit("label"), F.lit("first")), F.col("b.step"))
    return best.select("table", F.col("b.row_idx").alias("row_idx"), kind.alias("kind"))


def query_header_row(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """(table, row_idx, score): at query time known field names decide: 20 for each direct match of alias keys, 1 for
    each technical name, less what the row has beyond the fields; the first best of twelve. Where no row has a score of 0 or
    more it is the row 0, with the score -1."""
    few = cells.where((F.col("row_idx") < SCAN_ROWS) & (F.trim("value") != ""))
    known = fields.select("table", alias_key_query(F.col("field")).alias("name")).distinct().withColumn("hit", F.lit(1))
    counts = fields.groupBy("table").agg(F.count("*").alias("n_fields"))
    joined = few.withColumn("name", alias_key_query(F.col("value"))).join(known, ["table", "name"], "left")
    rows = joined.groupBy("table", "row_idx").agg(F.count("hit").alias("direct"), F.count_if(F.trim("value").rlike(TECHNICAL)).alias("names"), F.count("*").alias("filled"))
    score = 20 * F.col("direct") + F.col("names") - F.greatest(F.lit(0), F.col("filled") - F.col("n_fields"))
    scored = rows.join(counts, "table").withColumn("score", score)
    best = scored.groupBy("table").agg(F.max_by(F.struct("row_idx", "score"), F.struct("score", -F.col("row_idx"))).alias("b"))
    fine = F.col("b.score") > -1
    return best.select("table", F.when(fine, F.col("b.row_idx")).otherwise(0).alias("row_idx"), F.when(fine, F.col("b.score")).otherwise(-1).alias("score"))


def raw_grid(cells: DataFrame, header_rows: int = 0) -> DataFrame:
    """(table, total_rows, columns, header): a grid's size and the cells of its first ``header_rows`` rows; the
    other rows stay long, as (table, row_idx, col_idx, value)."""
    first = F.sort_array(F.collect_list(F.when(F.col("row_idx") < header_rows, F.struct("row_idx", "col_idx", "value"))))
    size = lambda c: (F.max(c) + 1).cast("int")
    return cells.groupBy("table").agg(size("row_idx").alias("total_rows"), size("col_idx").alias("columns"), F.transform(first, lambda x: x["value"]).alias("header"))


def named_rows(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(table, row_idx, cells): rows below the header as maps from header names, repeated names with
    _2, _3 and so on; blank rows are left out."""
    own = cells.join(headers.select("table", F.col("row_idx").alias("header_idx")), "table")
    heads = own.where((F.col("row_idx") == F.col("header_idx")) & (F.trim("value") != "")).select("table", "col_idx", F.trim("value").alias("name"))
    n = F.row_number().over(Window.partitionBy("table", "name").orderBy("col_idx"))
    heads = heads.withColumn("name", F.when(n == 1, F.col("name")).otherwise(F.concat_ws("_", "name", n)))
    body = own.where(F.col("row_idx") > F.col("header_idx")).join(heads, ["table", "col_idx"])
    rows = body.groupBy("table", "row_idx").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("cells"))
    return rows.where(F.exists(F.map_values("cells"), lambda v: F.trim(v) != ""))


def missing_fields(schema: DataFrame, headers: DataFrame) -> DataFrame:
    """(table, missing, unmapped): schema fields without a column, and columns without a field."""
    a = schema.groupBy("table").agg(F.collect_set("field").alias("fields"))
    b = headers.groupBy("table").agg(F.collect_set("name").alias("names"))
    both = a.join(b, "table", "full_outer")
    none = F.array().cast("array<string>")
    fields, names = F.coalesce("fields", none), F.coalesce("names", none)
    return both.select("table", F.array_sort(F.array_except(fields, names)).alias("missing"), F.array_sort(F.array_except(names, fields)).alias("unmapped"))


# relations -------------------------------------------------------------------------------------
def infer_foreign_keys(fields: DataFrame, confirmed_suffixes: list[str] | None = None) -> DataFrame:
    """(source, target, field, state): a field named like another table with Id, _id or Ids refers to it.
    With ``confirmed_suffixes`` other fields stay candidates. A table does not refer to itself."""
    simple = lambda c: F.lower(F.regexp_extract(c, r"([^/]+)$", 1))
    named = fields.select("table", "field", F.lower(F.regexp_extract("field", r"(?i)^(.+?)_?Ids?$", 1)).alias("stem")).where("stem <> ''")
    targets = fields.select(F.col("table").alias("target")).distinct().withColumn("stem", simple("target"))
    found = named.join(targets, "stem").where((F.col("target") != F.col("table")) & (F.col("stem") != simple("table")))
    ok = F.lit(True)
    if confirmed_suffixes is not None:
        ok = F.lit(False)
        for suffix in confirmed_suffixes:
            ok = ok | F.endswith("field", F.lit(suffix))
    return found.select(F.col("table").alias("source"), "target", "field", F.when(ok, "confirmed").otherwise("candidate").alias("state")).distinct()


def build_nodes(parts: list[DataFrame]) -> DataFrame:
    """(id, label, type, wiki_page): nodes of all parts, the last part wins and a wiki_page stays."""
    every = None
    for i, p in enumerate(parts):
        p = p.select("id", "label", "type", "wiki_page").withColumn("seq", F.lit(i))
        every = p if every is None else every.unionByName(p)
    return every.groupBy("id").agg(F.max_by(F.struct("label", "type"), F.struct("seq", "label")).alias("n"), F.max_by("wiki_page", F.when(F.col("wiki_page").isNotNull(), F.col("seq"))).alias("wiki_page")).select("id", "n.label", "n.type", "wiki_page")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """Edges without self loops, one of each (source, relation, target, from_doc, field)."""
    return edges.where("source <> target").dropDuplicates(["source", "relation", "target", "from_doc", "field"])


def neighbours(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, relation, neighbour, direction): one hop from the wanted nodes, both ways."""
    out = edges.join(wanted, edges.source == wanted.node).select("node", "relation", F.col("target").alias("neighbour"), F.lit("out").alias("direction"))
    back = edges.join(wanted, edges.target == wanted.node).select("node", "relation", F.col("source").alias("neighbour"), F.lit("in").alias("direction"))
    return out.union(back)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges one of whose ends is no node."""
    known = nodes.select(F.col("id"))
    bad_source = edges.join(known, edges.source == known.id, "left_anti")
    bad_target = edges.join(known, edges.source == known.id, "left_semi").join(known, edges.target == known.id, "left_anti")
    return bad_source.union(bad_target)


def candidate_reason(edges: DataFrame, nodes: DataFrame, relations: list[str], entity_types: list[str]) -> DataFrame:
    """Adds reason, null where an edge may be published. Only nodes that were loaded no later than the
    edge count: nodes and edges carry ``seq``."""
    a = nodes.select(F.col("id").alias("source"), F.col("type").alias("source_type"), F.col("seq").alias("source_seq"))
    b = nodes.select(F.col("id").alias("target"), F.col("type").alias("target_type"), F.col("seq").alias("target_seq"))
    joined = edges.join(a, "source", "left").join(b, "target", "left")
    there = F.coalesce((F.col("source_seq") <= F.col("seq")) & (F.col("target_seq") <= F.col("seq")), F.lit(False))
    reason = (
        F.when(~F.col("relation").isin(*relations), "unknown_or_unpublishable_relation").when(~there, "unknown_endpoint")
        .when(~F.col("source_type").isin(*entity_types) | ~F.col("target_type").isin(*entity_types), "unknown_or_unpublishable_entity_type")
    )
    return joined.select(*edges.columns, reason.alias("reason"))


# validation ------------------------------------------------------------------------------------
def findings(rule: str, rows: DataFrame, key: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def primary_key(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that repeat or have an empty part."""
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | empty)
    return findings(rule, counted, F.concat_ws("|", *keys))


def enum_values(df: DataFrame, column: str, allowed: list[str], rule: str, separator: str = ";") -> DataFrame:
    """Values, or parts of lists of values, that are not allowed."""
    each = df.select(F.explode(F.split(F.col(column).cast("string"), separator)).alias("v"))
    return findings(rule, each.where(~F.trim("v").isin(*allowed)), F.col("v"))


def foreign_key(df: DataFrame, column: str, parent: DataFrame, parent_key: str, rule: str, nullable: bool = False) -> DataFrame:
    """Values without a parent row."""
    values = df.select(F.col(column).alias("_v"))
    values = values.where("_v IS NOT NULL") if nullable else values
    return findings(rule, values.join(parent.select(F.col(parent_key).alias("_v")), "_v", "left_anti"), F.col("_v"))


def polymorphic(df: DataFrame, kind: str, ref: str, parents: dict[str, tuple[DataFrame, str]], rule: str) -> DataFrame:
    """References whose parent table depends on a type column; an unknown type is a finding too."""
    out = findings(rule, df.where(~F.col(kind).isin(*parents)), F.concat_ws(":", kind, ref))
    for name, (parent, key) in parents.items():
        own = df.where(F.col(kind) == name).select(F.concat_ws(":", kind, ref).alias("_k"), F.col(ref).alias("_v"))
        out = out.union(findings(rule, own.join(parent.select(F.col(key).alias("_v")), "_v", "left_anti"), F.col("_k")))
    return out


def unknown_ids(texts: DataFrame, column: str, pattern: str, known: DataFrame, key: str, rule: str) -> DataFrame:
    """Ids of a family that occur in cells or texts but belong to no row."""
    found = texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))).alias("_v")).distinct()
    return findings(rule, found.join(known.select(F.col(key).alias("_v")), "_v", "left_anti"), F.col("_v"))


def formula(df: DataFrame, key: str, holds: Column, rule: str) -> DataFrame:
    """Rows for which a formula does not hold."""
    return findings(rule, df.where(~F.coalesce(holds, F.lit(False))), F.col(key))


def approximately(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(b) * tolerance, F.lit(tolerance))


class Reference(NamedTuple):
    """A reference that has to exist: rows of ``table`` for which ``when`` holds name a row of ``target`` by ``value``; both are SQL over the table. A null value is
    a finding unless ``nullable``."""

    rule: str
    table: str
    target: str
    value: str
    when: str = "true"
    nullable: bool = False


def typed_references(tables: dict[str, DataFrame], targets: dict[str, tuple[DataFrame, str]], references: list[Reference]) -> DataFrame:
    """(rule, key) of references without a target. All rules of a table are one pass over it, and all references of all tables meet the keys of
    all targets in one join, whatever the number of rules."""
    asked = None
    for table in sorted({r.table for r in references}):
        each = [F.when(F.expr(r.when), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.target).alias("target"), F.expr(r.value).cast("string").alias("key"), F.lit(r.nullable).alias("nullable"))) for r in references if r.table == table]
        own = tables[table].select(F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))
        asked = own if asked is None else asked.unionByName(own)
    known = None
    for name, (df, key) in targets.items():
        keys = df.select(F.lit(name).alias("target"), F.col(key).cast("string").alias("key"))
        known = keys if known is None else known.unionByName(keys)
    open_ = asked.where(~(F.col("key").isNull() & F.col("nullable"))).select("rule", "target", "key")
    return open_.join(known, ["target", "key"], "left_anti").select("rule", "key")
