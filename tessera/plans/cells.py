"""Queries of sheets as cells, file snapshots, limits, typed references and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import alias_key_build
from tessera.operators import relational as R
from tessera.operators import sweeps
from tessera.operators import tables as T
from tessera.plans.base import query
from tessera.plans.tables import GRID, _cells
from tessera.sources import files
from tessera.sources.scratch import shared_path


def _sheets(t):
    """Grids of ten documents as sheets, two to a workbook; a third of the rows is blank."""
    cells = _cells(t).withColumn("n", F.substring("table", 2, 9).cast("int"))
    value = F.when(F.col("row_idx") % 3 == 2, " ").when(F.col("col_idx") == 1, F.concat("value", F.lit("|x"))).otherwise(F.col("value"))
    return cells.select(F.concat(F.lit("w"), F.floor(F.col("n") / 2)).alias("path"), F.concat(F.lit("S"), F.col("n") % 2).alias("sheet"), (F.col("n") % 2).alias("sheet_idx"), "row_idx", "col_idx", value.alias("value"))


SHEETS = f"""{GRID}, named AS (SELECT 'w' || CAST(substr(t, 2) AS INT) // 2 AS path, 'S' || CAST(substr(t, 2) AS INT) % 2 AS sheet, r, c, CASE WHEN r % 3 = 2 THEN ' ' WHEN c = 1 THEN v || '|x' ELSE v END AS v FROM cells)"""


@query("src5_sheet_schemas", f"WITH {SHEETS}, s AS (SELECT path, sheet, max(r) AS n FROM named GROUP BY ALL) SELECT path, string_agg(sheet, ',' ORDER BY sheet) AS sheets, CAST(sum(n) AS BIGINT) AS rows_ FROM s GROUP BY path")
def src5(t):
    return files.sheet_schemas(_sheets(t)).select("path", F.array_join("sheets", ",").alias("sheets"), F.col("rows").cast("long").alias("rows_"))


@query("src6_sheet_preview", f"""WITH {SHEETS}, filled AS (SELECT path, sheet, r, row_number() OVER (PARTITION BY path, sheet ORDER BY r) AS k FROM (SELECT DISTINCT path, sheet, r FROM named WHERE trim(v) <> ''))
SELECT path, sheet, r AS row_idx, c AS col_idx, v AS value FROM named JOIN filled USING (path, sheet, r) WHERE k <= 4""")
def src6(t):
    return files.sheet_preview(_sheets(t), 4).select("path", "sheet", "row_idx", F.col("col_idx").cast("long").alias("col_idx"), "value")


@query("src10_sheet_markdown", f"""WITH {SHEETS}, lines AS (SELECT path, sheet, r, '| ' || string_agg(replace(v, '|', '\\|'), ' | ' ORDER BY c) || ' |' AS line FROM named GROUP BY path, sheet, r),
marked AS (SELECT path, sheet, r, line, row_number() OVER (PARTITION BY path, sheet ORDER BY r) AS k FROM lines)
SELECT path, sheet, string_agg(CASE WHEN k = 1 THEN line || chr(10) || '| - | - | - |' ELSE line END, chr(10) ORDER BY r) AS markdown FROM marked GROUP BY path, sheet""")
def src10(t):
    return files.sheet_markdown(_sheets(t))


@query("tab4_named_rows", f"""WITH {GRID}, h AS (SELECT t, c, v FROM cells WHERE r = 0), named AS (SELECT t, c, CASE WHEN row_number() OVER (PARTITION BY t, v ORDER BY c) = 1 THEN v ELSE v || '_' || row_number() OVER (PARTITION BY t, v ORDER BY c) END AS name FROM h)
SELECT t AS "table", r AS row_idx, string_agg(name || '=' || v, ',' ORDER BY name) AS cells FROM cells JOIN named USING (t, c) WHERE r > 0 GROUP BY t, r""")
def tab4(t):
    """Rows below the first one as maps from its names."""
    cells = _cells(t)
    rows = T.named_rows(cells, cells.select("table").distinct().withColumn("row_idx", F.lit(0)))
    return rows.select("table", "row_idx", F.array_join(F.array_sort(F.transform(F.map_entries("cells"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("cells"))


@query("src2_snapshot", """SELECT 'source=' || source AS folder, sha256(string_agg(doc_id || ' ' || lang || chr(10), '' ORDER BY doc_id)) AS hash, CAST(sum(strlen(doc_id || ' ' || lang) + 1) AS BIGINT) AS size, 'text' AS kind FROM documents GROUP BY source""")
def src2(t):
    """A folder a source, with a markdown file in each; what starts with a dot or a mark of Spark's is no source."""
    path = shared_path(t.spark, "snapshot")
    lines = t.documents.select("source", "doc_id", F.concat_ws(" ", "doc_id", "lang").alias("line"))
    plain = {"extension": "md", "quote": "", "escapeQuotes": "false", "sep": "\t", "header": "false"}
    lines.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "line").write.partitionBy("source").options(**plain).csv(path)
    found = files.snapshot(t.spark, path).where("path LIKE '%.md'")
    return found.select(F.regexp_extract("path", "^([^/]+)/", 1).alias("folder"), F.substring("hash", 8, 64).alias("hash"), "size", "kind")


@query("src12_bundle_pages", """SELECT 'source=' || source AS folder, count(*) AS lines FROM documents GROUP BY source""")
def src12(t):
    """Markdown pages of a folder, passed through as they are."""
    path = shared_path(t.spark, "pages")
    plain = {"extension": "md", "quote": "", "escapeQuotes": "false", "sep": "\t", "header": "false"}
    t.documents.select("source", F.concat_ws(" ", F.lit("-"), "doc_id").alias("line")).repartition("source").write.partitionBy("source").options(**plain).csv(path)
    pages = files.markdown_pages(t.spark, path)
    lines = F.size(F.filter(F.split("markdown", "\n"), lambda x: x.startswith("- "))).cast("long")
    return pages.select(F.regexp_extract("path", "^([^/]+)/", 1).alias("folder"), lines.alias("lines"))


@query("src16_alias_files", r"""WITH d AS (SELECT doc_id, doc_id % 5 AS k, 'Table/' || doc_id AS t FROM documents),
e AS (SELECT doc_id AS place, 0 AS n, t, t AS alias FROM d WHERE k < 4
  UNION ALL SELECT doc_id, 1, t, 'Key ' || doc_id FROM d WHERE k = 2
  UNION ALL SELECT doc_id, 2, t, 'alias-' || doc_id FROM d WHERE k < 4
  UNION ALL SELECT doc_id, 3, t, 'Shared_' || doc_id % 10 FROM d WHERE k IN (0, 2, 3)),
m AS (SELECT regexp_replace(lower(alias), '[\s_/\-]+', '', 'g') AS key, max_by(t, place * 10 + n) AS t, max_by(alias, place * 10 + n) AS alias FROM e GROUP BY 1)
SELECT key, t AS "table", alias FROM m""")
def src16(t):
    """Alias files in the order of the documents: lists of records, flat maps, maps of records, maps of lists, and files that are broken. Later ones win."""
    k, n = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    shared = F.concat(F.lit('"Shared_'), (F.col("doc_id") % 10).cast("string"), F.lit('"'))
    listed = F.concat(F.lit('"aliases":["alias-'), n, F.lit('", 5, " ",'), shared, F.lit("]"))
    json = (
        F.when(k == 0, F.concat(F.lit('[{"canonicalName":" Table/'), n, F.lit('",'), listed, F.lit('}, 7, {"aliases":["none"]}]')))
        .when(k == 1, F.concat(F.lit('{"Table/'), n, F.lit('":"alias-'), n, F.lit('","x":3}')))
        .when(k == 2, F.concat(F.lit('{"Key '), n, F.lit('":{"table":"Table/'), n, F.lit('",'), listed, F.lit("}}")))
        .when(k == 3, F.concat(F.lit('{"Table/'), n, F.lit('":["alias-'), n, F.lit('",'), shared, F.lit("]}"))).otherwise('{"broken')
    )
    entries = files.alias_entries(t.documents.select(F.col("doc_id").alias("place"), json.alias("json")))
    return files.merged_aliases(entries, alias_key_build)


@query("srt5_bounded_limits", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN least(event_id, 50) WHEN 3 THEN 10 WHEN 4 THEN 7 ELSE 50 END AS n FROM events")
def srt5(t):
    """Limits as text: none, no number, a number, a negative one, one with spaces, one beyond the most."""
    k = F.col("event_id") % 6
    given = F.when(k == 1, "many").when(k == 2, F.col("event_id").cast("string")).when(k == 3, "-5").when(k == 4, " 7 ").when(k == 5, "500000")
    return t.events.select("event_id", R.bounded(given, 10, 50).alias("n"))


@query("fn21_approximately", "SELECT p_partkey, abs(p_retailprice - p_size * 40) <= greatest(abs(p_size * 40) * 0.25, 0.25) AS close FROM part")
def fn21(t):
    return t.part.select("p_partkey", T.approximately(F.col("p_retailprice"), F.col("p_size") * 40, 0.25).alias("close"))


REFERENCES = [
    T.Reference("line.part", "lineitem", "part", "l_partkey", "l_linenumber % 3 = 0"),
    T.Reference("line.supplier", "lineitem", "supplier", "l_suppkey", "l_linenumber % 3 = 1"),
    T.Reference("line.order", "lineitem", "orders", "CASE WHEN l_orderkey % 9 <> 0 THEN l_orderkey END", "l_linenumber = 1", nullable=True),
    T.Reference("order.customer", "orders", "customer", "o_custkey"),
    T.Reference("order.clerk", "orders", "supplier", "CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END", "o_orderkey % 2 = 0"),
]


@query("val6_typed_targets", """WITH a AS (SELECT 'line.part' AS rule, 'part' AS target, l_partkey AS k, false AS nullable FROM lineitem WHERE l_linenumber % 3 = 0 UNION ALL SELECT 'line.supplier', 'supplier', l_suppkey, false FROM lineitem WHERE l_linenumber % 3 = 1
  UNION ALL SELECT 'line.order', 'orders', CASE WHEN l_orderkey % 9 <> 0 THEN l_orderkey END, true FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT 'order.customer', 'customer', o_custkey, false FROM orders
  UNION ALL SELECT 'order.clerk', 'supplier', CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END, false FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT 'part' AS target, p_partkey AS k FROM part WHERE p_size > 3 UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_acctbal > 0)
SELECT rule, CAST(a.k AS VARCHAR) AS key FROM a LEFT JOIN b ON a.target = b.target AND a.k = b.k WHERE b.k IS NULL AND NOT (a.k IS NULL AND nullable)""")
def val6(t):
    """Five rules over two tables and four targets: two scans of sources, one join."""
    targets = {"part": (t.part.where("p_size > 3"), "p_partkey"), "supplier": (t.supplier.where("s_acctbal > 0"), "s_suppkey"), "orders": (t.orders.where("o_totalprice > 1000"), "o_orderkey"), "customer": (t.customer.where("c_acctbal > 0"), "c_custkey")}
    return T.typed_references({"lineitem": t.lineitem, "orders": t.orders}, targets, REFERENCES)


@query("str10_sweep", """SELECT n_nationkey AS project_id, CASE WHEN n_nationkey IN (3, 11) THEN 'failed' ELSE 'done' END AS outcome, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND n_nationkey NOT IN (3, 11)) AS n, true AS refused FROM nation""")
def str10(t):
    """A sweep over all projects, of which two have an error; a second one in the same period is refused."""
    folder = shared_path(t.spark, "sweep")
    done = []

    def job(projects):
        broken = F.when(F.col("project_id").isin(3, 11), F.raise_error(F.lit("broken project"))).otherwise(F.col("project_id"))
        rows = t.customer.join(projects.select(broken.alias("c_nationkey")), "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("n"))
        path = f"{folder}/out/{len(done)}"
        done.append(path)
        rows.write.parquet(path)

    projects = t.nation.select(F.col("n_nationkey").alias("project_id"))
    outcomes = sweeps.sweep(projects, job, folder, 1)
    refused = sweeps.sweep(projects, job, folder, 1) is None
    counts = t.customer.groupBy(F.col("c_nationkey").alias("project_id")).agg(F.count("*").alias("c"))
    joined = outcomes.join(counts, "project_id", "left")
    n = F.when(F.col("outcome") == "done", F.coalesce("c", F.lit(0))).otherwise(0)
    return joined.select("project_id", "outcome", n.alias("n"), F.lit(refused).alias("refused"))
