"""Sources: directories of files, spreadsheets as long cells, alias files, markdown pages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = "path string, sheet string, sheet_idx int, row_idx int, col_idx int, value string"


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """(path, hash, size, kind) of all files below ``root`` that don't start with a dot, paths relative."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    rel = F.regexp_replace("path", f"^(?:[a-z]+:/*)?/*{re.escape(base.lstrip('/'))}/", "")
    out = files.select(rel.alias("path"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext.isin("xlsx", "xls", "csv"), "table").when(ext.isin("md", "txt"), "text").when(ext == "docx", "document").otherwise("other")
    return out.where(~F.col("path").rlike(r"(^|/)\.")).select("path", F.concat(F.lit("sha256:"), "hash").alias("hash"), "size", kind.alias("kind"))


def markdown_pages(spark: SparkSession, root: str) -> DataFrame:
    """(path, markdown) of all pages but the index and the log at the top."""
    pages = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    with_path = pages.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    rel = F.regexp_replace("path", f"^(?:[a-z]+:/*)?/*{re.escape(base)}/", "")
    return with_path.select(rel.alias("path"), "markdown").where(~F.col("path").isin("index.md", "log.md"))


def _xlsx(content: bytes) -> Iterator[tuple[str, int, int, int, str]]:
    """Cells of all sheets of a workbook, in the order of the workbook; its relations say which part a sheet is in."""
    relation, space = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", space):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{space['m']}}}t")))
        parts = {}
        if "xl/_rels/workbook.xml.rels" in names:
            parts = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for n, sheet in enumerate(book.findall("m:sheets/m:sheet", space)):
            target = parts.get(sheet.get(relation), f"worksheets/sheet{n + 1}.xml")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part not in names:
                continue
            for r, row in enumerate(ElementTree.fromstring(z.read(part)).findall("m:sheetData/m:row", space)):
                at = int(row.get("r", r + 1)) - 1
                for c, cell in enumerate(row.findall("m:c", space)):
                    letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
                    col = 0
                    for x in letters:
                        col = col * 26 + ord(x) - 64
                    value = cell.find("m:v", space)
                    text = value.text if value is not None else "".join(t.text or "" for t in cell.iter(f"{{{space['m']}}}t"))
                    yield sheet.get("name", f"Sheet{n + 1}"), n, at, (col - 1 if letters else c), shared[int(text)] if cell.get("t") == "s" and text else text or ""


def _workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            cells = [(row.path, *c) for c in _xlsx(row.content)]
            yield pd.DataFrame(cells, columns=["path", "sheet", "sheet_idx", "row_idx", "col_idx", "value"])


def workbook_cells(spark: SparkSession, root: str) -> DataFrame:
    """All sheets of all workbooks as (path, sheet, sheet_idx, row_idx, col_idx, value)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(root)
    return files.select("path", "content").mapInPandas(_workbooks, CELLS)


def csv_cells(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """CSV files in the same long form, ragged rows as they are, a byte order mark removed."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\r?\n$", ""), r"\r?\n")).alias("row_idx", "line"))
    # a field is made of quoted runs, others, and at most one quote without its partner; read in one go from left to right
    field = r',((?:"(?:[^"]++|"")*+"|[^,"]++|")*+)'
    parts = rows.select("path", "row_idx", F.posexplode(F.regexp_extract_all(F.concat(F.lit(","), "line"), F.lit(field), F.lit(1))).alias("col_idx", "raw"))
    value = F.when(F.col("raw").rlike(r'^\s*".*"\s*$'), F.regexp_replace(F.regexp_replace("raw", r'^\s*"|"\s*$', ""), '""', '"')).otherwise(F.col("raw"))
    return parts.select("path", F.lit("Sheet1").alias("sheet"), F.lit(0).alias("sheet_idx"), "row_idx", "col_idx", value.alias("value"))


def csv_problems(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(path, row_idx, problem, columns, expected): rows that have not as many columns as their file's first row,
    and files that start with a byte order mark."""
    width = csv_cells(spark, root, pattern).groupBy("path", "row_idx").agg((F.max("col_idx") + 1).alias("columns"))
    ragged = width.join(width.where("row_idx = 0").select("path", F.col("columns").alias("expected")), "path").where("columns <> expected")
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    marked = text.where(F.startswith("value", F.lit("\ufeff"))).select(F.col("_metadata.file_path").alias("path"), F.lit(0), F.lit("byte_order_mark"), F.lit(None).cast("int"), F.lit(None).cast("int"))
    return ragged.select("path", "row_idx", F.lit("column_count").alias("problem"), "columns", "expected").union(marked)


def first_sheet(cells: DataFrame) -> DataFrame:
    """Cells of each workbook's first sheet alone, blank rows kept."""
    first = cells.groupBy("path").agg(F.min("sheet_idx").alias("sheet_idx"))
    return cells.join(first, ["path", "sheet_idx"], "left_semi")


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(table, alias) of a JSON file in any of its layouts: a list of records, a record with the list under
    ``aliases``, or a flat map from alias to table."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("j"))
    record = "array<struct<table:string,canonical:string,canonicalName:string,aliases:array<string>>>"
    listed = F.when(F.trim("j").startswith("["), F.from_json("j", record)).otherwise(F.from_json(F.get_json_object("j", "$.aliases"), record))
    rows = text.select(F.explode(F.filter(listed, lambda x: F.coalesce(x["table"], x["canonical"], x["canonicalName"]).isNotNull())).alias("r"))
    first = rows.select(F.coalesce("r.table", "r.canonical", "r.canonicalName").alias("table"), F.explode("r.aliases").alias("alias"))
    flat = text.where(F.get_json_object("j", "$.aliases").isNull() & ~F.trim("j").startswith("["))
    second = flat.select(F.explode(F.from_json("j", "map<string,string>")).alias("alias", "table")).select("table", "alias")
    return first.union(second)


def alias_entries(texts: DataFrame) -> DataFrame:
    """(place, table, alias, at) of alias files (place, json), place being their order: a list of records, or a record whose values are an alias, a list of aliases or a
    record of its own. A table is an alias of itself, and the key of a record too. ``at`` is the order within a file. What is no JSON, and names or aliases
    that are no text or blank, are left out."""
    name = lambda v, key: F.nullif(F.trim(F.try_variant_get(v, f"$.{key}", "string")), F.lit(""))
    named = lambda v: F.coalesce(name(v, "canonical"), name(v, "canonicalName"), name(v, "table"))
    is_ = lambda v, kind: F.schema_of_variant(v).startswith(kind)
    listed = lambda v: F.when(is_(v, "ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(is_(x, "STRING"), F.try_variant_get(x, "$", "string"))))
    parsed = texts.select("place", F.try_parse_json("json").alias("v")).where("v IS NOT NULL")
    parsed.where(is_(F.col("v"), "ARRAY") | is_(F.col("v"), "OBJECT")).createOrReplaceTempView("_alias_files")
    each = texts.sparkSession.sql("SELECT f.place, e.pos, e.key, e.value AS r FROM _alias_files f, LATERAL variant_explode(f.v) e")
    record, own = is_(F.col("r"), "OBJECT"), F.nullif(F.trim("key"), F.lit(""))
    table = F.when(F.col("key").isNull(), F.when(record, named(F.col("r")))).otherwise(F.coalesce(F.when(record, named(F.col("r"))), own))
    inner = F.try_variant_get("r", "$.aliases", "variant")
    given = F.when(is_(F.col("r"), "STRING"), F.array(F.try_variant_get("r", "$", "string"))).when(record, F.coalesce(listed(inner), F.array().cast("array<string>"))).otherwise(listed(F.col("r")))
    fine = is_(F.col("r"), "STRING") | record | is_(F.col("r"), "ARRAY")
    every = F.concat(F.array(table), F.when(record & F.col("key").isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>")), F.coalesce(given, F.array().cast("array<string>")))
    rows = each.where(fine).select("place", "pos", table.alias("table"), F.posexplode(every).alias("n", "alias")).where("table IS NOT NULL AND trim(alias) <> ''")
    return rows.select("place", "table", F.trim("alias").alias("alias"), F.struct("pos", "n").alias("at"))


def merged_aliases(entries: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """(key, table, alias) of :func:`alias_entries`: for each key of an alias the last entry, later files over earlier ones."""
    rows = entries.withColumn("k", key(F.col("alias"))).where("k <> ''")
    last = rows.groupBy("k").agg(F.max_by(F.struct("table", "alias"), F.struct("place", "at")).alias("b"))
    return last.select(F.col("k").alias("key"), "b.table", "b.alias")


def _docx(content: bytes) -> str:
    """Paragraphs of a word processor file as markdown, headings by their style, pictures as a mark."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for p in ElementTree.fromstring(z.read("word/document.xml")).iter(f"{w}p"):
            style = p.find(f"{w}pPr/{w}pStyle")
            level = re.match(r"Heading([1-6])$", style.get(f"{w}val", "")) if style is not None else None
            text = "".join("![image]" if x.tag == f"{w}drawing" else x.text or "" for x in p.iter() if x.tag in (f"{w}t", f"{w}drawing"))
            if text.strip():
                out.append(f"{'#' * int(level[1])} {text}" if level else text)
    return "\n\n".join(out)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"path": batch["path"], "markdown": [_docx(c) for c in batch["content"]]})


def document_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, markdown) of word processor files; inline pictures in base64 become a mark as well."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(root)
    pages = files.select("path", "content").mapInPandas(_documents, "path string, markdown string")
    return pages.withColumn("markdown", F.regexp_replace("markdown", r"!\[[^\]]*\]\(data:image/[^)]*\)", "![image]"))


def sheet_markdown(cells: DataFrame) -> DataFrame:
    """(path, sheet, markdown): each sheet as a table, the first row as its header."""
    escaped = F.replace(F.replace("value", F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    width = cells.groupBy("path", "sheet").agg((F.max("col_idx") + 1).alias("width"))
    by_row = cells.groupBy("path", "sheet", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", escaped.alias("v")))).alias("m")).join(width, ["path", "sheet"])
    filled = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    lines = by_row.select("path", "sheet", "row_idx", "width", F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |")).alias("line"))
    rows = lines.groupBy("path", "sheet").agg(F.max("width").alias("width"), F.sort_array(F.collect_list(F.struct("row_idx", "line"))).alias("r"))
    texts = F.transform("r", lambda x: x["line"])
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" - |"), F.col("width")))
    return rows.select("path", "sheet", F.array_join(F.concat(F.slice(texts, 1, 1), F.array(rule), F.slice(texts, 2, 1_000_000_000)), "\n").alias("markdown"))


def sheet_schemas(cells: DataFrame) -> DataFrame:
    """(path, sheets, rows): the sheets of each workbook and the rows of all of them below the first."""
    each = cells.groupBy("path", "sheet").agg(F.max("row_idx").alias("rows"))
    return each.groupBy("path").agg(F.array_sort(F.collect_set("sheet")).alias("sheets"), F.sum("rows").alias("rows"))


def sheet_preview(cells: DataFrame, most: int = 12) -> DataFrame:
    """The first rows of each sheet that aren't blank."""
    filled = cells.where(F.trim("value") != "").select("path", "sheet", "row_idx").distinct()
    order = Window.partitionBy("path", "sheet").orderBy("row_idx")
    first = filled.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    return cells.join(first, ["path", "sheet", "row_idx"], "left_semi")


def text_preview(texts: DataFrame, most: int = 60) -> DataFrame:
    """(path, preview, truncated, notice) of (path, text); a text with a zero byte is no text, which the notice says."""
    lines, binary = F.split("text", r"\r?\n"), F.contains("text", F.lit("\0"))
    shown = F.when(~binary, F.array_join(F.slice(lines, 1, most), "\n"))
    return texts.select("path", shown.alias("preview"), (~binary & (F.size(lines) > most)).alias("truncated"), F.when(binary, "binary").alias("notice"))
