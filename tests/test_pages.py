"""Pages from markdown, dependency sections, specs and columns by field, on small inline frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pages as P

PAGE = """---
type: activity
title:  Spring
source: gamedocs/a.md
facts:
  cost: 5
  cost: 6
  empty:
entities:
  - name: Spring
    type: activity
  - name: nameless
relationships:
  - source: a
    relation: uses
    target: b
---
# Body
text
"""


def test_extract_page(spark):
    rows = [("x/a.md", PAGE), ("x/my_own-page.md", "no heading"), ("b.md", "---\ntype: x\n---\n# Head \nrest"), ("c.md", None), ("d.md", ""), ("e.md", PAGE.replace("\n", "\r\n")), ("f.md", "word " * 400_000)]
    df = spark.createDataFrame(rows, "path string, md string")
    got = {r.path: r.p for r in df.select("path", P.extract_page(F.col("md"), F.col("path")).alias("p")).collect()}
    for name in ("x/a.md", "e.md"):
        p = got[name]
        assert (p.type, p.title, p.source, p.method) == ("activity", "Spring", "gamedocs/a.md", "structured")
        assert p.facts == {"cost": "6", "empty": ""}
        assert [(e.name, e.type) for e in p.entities] == [("Spring", "activity")]
        assert [tuple(r) for r in p.relationships] == [("a", "uses", "b")]
        assert p.body == "# Body\ntext\n"
    p = got["x/my_own-page.md"]
    assert (p.type, p.title, p.source, p.method) == ("concept", "My Own Page", "processed/parsed/x/my_own-page.md", "fallback")
    assert (got["b.md"].title, got["b.md"].body, got["b.md"].type) == ("Head", "# Head \nrest", "concept")
    assert got["c.md"].title == "C" and got["c.md"].body == "" and got["d.md"].title == "D"
    assert len(got["f.md"].body) == 2_000_000


def rewrite(spark, body, aliases, tables):
    df = spark.createDataFrame([(body, aliases, tables)], "body string, a array<struct<alias:string,canonical:string>>, t array<string>")
    return df.select(P.rewrite_dependencies(F.col("body"), F.col("a"), F.col("t")).alias("r")).first().r


def test_rewrite_dependencies(spark):
    a = [("items", "ItemTable"), ("items list", "ItemList")]
    body = "items\n## 数据依赖\n- items list\n- items ItemTable\n## Next\nitems"
    got = rewrite(spark, body, a, [])
    assert got.startswith("items\n## 数据依赖\n- ") and "- items ItemTable\n## Next\nitems" in got and "（ItemList）" in got
    assert rewrite(spark, "text \n", [], ["B", "A", "A"]) == "text\n\n## Data Dependencies\n- A\n- B"
    assert rewrite(spark, "## Data Dependencies\n(none)\n## X\ny", [], ["A"]) == "## Data Dependencies\n- A\n## X\ny"
    assert rewrite(spark, "## data dependencies\r\n- A\r\n## X", [], ["A", "B"]) == "## data dependencies\n- A\n- B\n## X"
    assert rewrite(spark, None, [], []) == "" and rewrite(spark, "a", [], []) == "a"


SPEC = """# T
|key|required|
|---|---|
|`cost` / `price`|yes|
|free|no|

## Facts 必填 key
|Key|note|
|-|-|
|---|---|
|owner / ref|x|

## Example
|key|required|z|
|a|yes|1|

## Other
|name|x|
|key|required|
|b|YES|
|a|key|required|
|1|`c`|是|
"""


def test_specs(spark):
    df = spark.createDataFrame([("s", SPEC), ("n", None), ("l", "## 章节结构\n- `## One`\n- `## Two `\n## Three")], "spec string, markdown string")
    sections = {r.spec: r.s for r in df.select("spec", P.spec_sections(F.col("markdown")).alias("s")).collect()}
    assert sections == {"s": ["Facts 必填 key", "Example", "Other"], "n": [], "l": ["One", "Two"]}
    facts = [r.fact for r in P.spec_facts(df).orderBy("spec", "place").collect()]
    assert facts == ["cost", "price", "-", "owner", "ref", "c"]
    assert P.spec_facts(df.limit(0)).count() == 0


def test_field_columns(spark):
    grid = [("Id", "", "Price", "Price", "x"), ("item_id", "", "COST", "other", ""), ("1", "n", "5", "q", "z")]
    cells = spark.createDataFrame([("t", r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "table string, row_idx int, col_idx int, value string")
    headers = spark.createDataFrame([("t", 1)], "table string, row_idx int")
    fields = spark.createDataFrame([("t", i, f) for i, f in enumerate(["itemId", "name", "desc", "cost"])], "table string, place int, field string")
    got = {(r.field, r.col_idx, r.raw_key, r.method) for r in P.field_columns(cells, headers, fields).collect()}
    assert got == {("itemId", 0, "Id", "header"), ("name", 1, "column_2", "schema_order"), ("cost", 2, "Price", "header"), ("desc", None, None, "no_column"), (None, 3, "Price_2", "no_field"), (None, 4, "x", "no_field")}
    assert P.field_columns(cells.limit(0), headers, fields).where("method = 'header'").count() == 0
