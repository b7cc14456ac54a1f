"""Queries of page extraction, dependency sections, specs and columns by field."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pages as P
from tessera.plans.base import query

TEXT = "replace(coalesce(text, ''), chr(13) || chr(10), chr(10))"
HEAD = rf"regexp_extract({TEXT}, '(?m)^#[ \t]+(\S[^\n]*)$', 1)"


@query("doc13_extract_page", rf"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'concept' END AS type,
CASE WHEN doc_id % 3 = 0 THEN 'Doc ' || doc_id WHEN doc_id % 3 = 1 THEN 'Head ' || source WHEN {HEAD} <> '' THEN {HEAD} ELSE 'Page ' || doc_id END AS title,
CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'processed/parsed/' || source || '/page-' || doc_id || '.md' END AS source_path,
CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS VARCHAR) END AS n_chars, CASE WHEN doc_id % 3 = 0 THEN source ELSE NULL END AS related,
md5(CASE WHEN doc_id % 3 = 1 THEN '# Head ' || source || chr(10) ELSE '' END || {TEXT}) AS body_md5, CASE WHEN doc_id % 3 = 0 THEN 'structured' ELSE 'fallback' END AS method FROM documents""")
def doc13(t):
    case, text = F.col("doc_id") % 3, F.coalesce("text", F.lit(""))
    front = F.concat(F.lit("---\ntype: "), "lang", F.lit("\ntitle: Doc "), "doc_id", F.lit("\nfacts:\n  chars: "), "n_chars", F.lit("\nrelationships:\n  - source: "), "doc_id", F.lit("\n    relation: from\n    target: "), "source", F.lit("\n---\n"))
    markdown = F.when(case == 0, F.concat(front, text)).when(case == 1, F.concat(F.lit("# Head "), "source", F.lit("\n"), text)).otherwise(text)
    p = t.documents.select("doc_id", P.extract_page(markdown, F.concat("source", F.lit("/page-"), "doc_id", F.lit(".md"))).alias("p"))
    return p.select(
        "doc_id", "p.type", "p.title", F.col("p.source").alias("source_path"), F.try_element_at("p.facts", F.lit("chars")).alias("n_chars"),
        F.try_element_at("p.relationships", F.lit(1))["target"].alias("related"), F.md5("p.body").alias("body_md5"), "p.method",
    )


@query("doc16_dependency_rewrite", rf"""SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN regexp_replace({TEXT}, '\s+$', '') || '{{n}}{{n}}## Data Dependencies{{n}}- ' || lang
WHEN 1 THEN {TEXT} || '{{n}}## Data Dependencies{{n}}- ' || lang || '{{n}}## End'
ELSE {TEXT} || '{{n}}## 表依赖{{n}}see ' || source || '（T_' || source || '）{{n}}- T_' || source || ' is ' || source || '{{n}}## End ' || source || '{{n}}{{n}}## Data Dependencies{{n}}- ' || lang END) AS body_md5 FROM documents""".replace("{n}", "' || chr(10) || '"))
def doc16(t):
    case, text = F.col("doc_id") % 3, F.coalesce("text", F.lit(""))
    named = F.concat(text, F.lit("\n## 表依赖\nsee "), "source", F.lit("\n- T_"), "source", F.lit(" is "), "source", F.lit("\n## End "), "source", F.lit("\n"))
    body = F.when(case == 0, text).when(case == 1, F.concat(text, F.lit("\n## Data Dependencies\n(none)\n## End"))).otherwise(named)
    aliases = F.array(F.struct(F.col("source").alias("alias"), F.concat(F.lit("T_"), "source").alias("canonical")))
    return t.documents.select("doc_id", F.md5(P.rewrite_dependencies(body, aliases, F.array("lang"))).alias("body_md5"))


def _specs(t):
    key = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("`"), "p_brand", F.lit("` / other"))).otherwise(F.concat("p_brand", F.lit(" / "), "p_type"))
    mark = F.when(F.col("p_size") % 3 == 0, "no").otherwise("Yes")
    listed = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("## 章节结构\n1. `## "), "p_type", F.lit("`\n"))).otherwise("")
    return t.part.select(F.col("p_partkey").alias("spec"), F.concat(F.lit("# Spec\n"), listed, F.lit("## Facts\n|Note|Key|Required|\n|---|:---:|---|\n|a|size|"), mark, F.lit("|\n|b|"), key, F.lit("|yes|\n## End\n")).alias("markdown"))


@query("doc20_spec_facts", """WITH f AS (SELECT p_partkey AS spec, unnest(CASE WHEN p_size % 3 = 0 THEN [] ELSE ['size'] END || CASE WHEN p_partkey % 2 = 0 THEN [p_brand] ELSE [p_brand, p_type] END) AS fact,
generate_subscripts(CASE WHEN p_size % 3 = 0 THEN [] ELSE ['size'] END || CASE WHEN p_partkey % 2 = 0 THEN [p_brand] ELSE [p_brand, p_type] END, 1) AS place FROM part) SELECT spec, fact, CAST(place AS INT) AS place FROM f""")
def doc20(t):
    return P.spec_facts(_specs(t))


@query("doc20_spec_sections", "SELECT p_partkey AS spec, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE 'Facts|End' END AS sections FROM part")
def doc20_sections(t):
    return _specs(t).select("spec", F.array_join(P.spec_sections(F.col("markdown")), "|").alias("sections"))


@query("tab3_field_mapping", """WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey AS "table" FROM supplier)
SELECT "table", 'suppKey' AS field, CASE WHEN k % 5 = 0 THEN 3 ELSE 0 END AS col_idx, CASE WHEN k % 5 = 0 THEN 'Name_2' ELSE 'Name' END AS raw_key, 'header' AS method FROM s
UNION ALL SELECT "table", 'name', 1, 'Title', CASE WHEN k % 2 = 0 THEN 'header' ELSE 'schema_order' END FROM s
UNION ALL SELECT "table", 'city', 2, 'nation', 'schema_order' FROM s
UNION ALL SELECT "table", 'late', CASE WHEN k % 5 <> 0 THEN 3 END, CASE WHEN k % 5 <> 0 THEN 'Name_2' END, CASE WHEN k % 5 <> 0 THEN 'schema_order' ELSE 'no_column' END FROM s
UNION ALL SELECT "table", NULL, 0, 'Name', 'no_field' FROM s WHERE k % 5 = 0""")
def tab3(t):
    s = t.supplier.select(F.col("s_suppkey").alias("k"), F.concat(F.lit("s"), "s_suppkey").alias("table"), "s_name", F.col("s_nationkey").cast("string").alias("n"))
    moved = F.col("k") % 5 == 0
    rows = [
        [F.lit("Name"), F.lit("Title"), F.lit(" "), F.lit("Name")],
        [F.when(moved, "x").otherwise("supp_Key"), F.when(F.col("k") % 2 == 0, "NAME").otherwise("other"), F.lit("nation"), F.when(moved, "Supp Key").otherwise("y")],
        [F.col("k").cast("string"), F.col("s_name"), F.col("n"), F.col("n")],
    ]
    cells = [F.struct(F.lit(r).alias("row_idx"), F.lit(c).alias("col_idx"), v.alias("value")) for r, row in enumerate(rows) for c, v in enumerate(row)]
    grid = s.select("table", F.inline(F.array(*cells)))
    fields = s.select("table", F.posexplode(F.array(*(F.lit(f) for f in ("suppKey", "name", "city", "late")))).alias("place", "field"))
    return P.field_columns(grid, s.select("table", F.lit(1).alias("row_idx")), fields)
