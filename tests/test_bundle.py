"""Bundle pages, lookup, annotations, navigation, rules, logs, references and sweeps on inline frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import bundle as B
from tessera.operators import relational as R
from tessera.operators import sweeps
from tessera.operators import tables as T
from tessera.sources import sinks

PAGE = """---
type: "system_rule"
title: "A \\"b\\""
tags: ["x", "table_wiki_page"]
kh:
  componentId: "c1"
  artifactId: "wiki/tables/a.md"
  trust:
    version: "v2-lite"
    score: 0.5
    evidence: 1
    lastTrustedAuditAt: ""
---
# Head line
text
# 引用

1. quote (with) round (e1; source s1; confidence 0.25; note)
2. bare
x. no
# Next
3. not cited (e3; source s; confidence 1)
"""


def test_parsing_takes_what_is_there(spark):
    rows = [("/a/p.md", PAGE), ("/b/none.md", "# no frontmatter"), ("/b/open.md", "---\ntitle: x\n"), ("/b/plain.md", "---\ncomponentId: c2\n---\nbody"), ("/b/nobody.md", "---\ntitle: x\n---\n")]
    out = {r.path: r for r in B.parse_pages(spark.createDataFrame(rows, "path string, markdown string")).collect()}
    assert set(out) == {"/a/p.md", "/b/plain.md"}
    p, q = out["/a/p.md"], out["/b/plain.md"]
    # a tag that holds the name of the first kind is of the first kind
    assert (p.component_id, p.type, p.kind, p.trust.score, p.trust.evidence, p.trust.completeness, p.trust.lastTrustedAuditAt) == ("c1", "system_rule", "wiki_page", 0.5, 1.0, 0.0, None)
    assert [(c.n, c.quote, c.evidence_id, c.source, c.confidence) for c in p.citations] == [(1, "quote (with) round", "e1", "s1", 0.25), (2, "bare", "", "", None)]
    assert (q.title, q.type, q.kind, q.trust, q.citations, q.artifact_id) == ("plain", "knowledge_note", "wiki_page", None, [], "b/plain.md")
    keys = {r.key for r in B.lookup_keys(B.parse_pages(spark.createDataFrame(rows[:1], "path string, markdown string"))).collect()}
    assert {"c1", "head line", "wiki/tables/a.md", "wiki/tables/a", "tables/a.md", "tables/a", "/a/p.md", "a/p.md", "p.md", "p"} <= keys


def test_sections_are_replaced_to_the_next_of_their_level(spark):
    body = "# A\na\n## B\nb\n### C\nc\n## D\nd\n# B\nlast"
    of = lambda name, content="X": spark.range(1).select(B.with_section(F.lit(body), F.lit(name), F.lit(content)).alias("b")).first().b
    assert of("b") == "# A\na\n## B\nX\n## D\nd\n# B\nlast" and of("C") == "# A\na\n## B\nb\n### C\nX\n## D\nd\n# B\nlast"
    assert of("A") == "# A\nX\n# B\nlast" and of("zz") == body + "\n\n## zz\nX"


def test_navigation_counts_what_it_leaves_out(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"l{i}", "t", None) for i in range(5)] + [("f", "x", "field", None), ("m", "<b>", "t", None), ("d", "1-2", "t", None)], "id string, label string, type string, wiki_page string")
    edges = spark.createDataFrame([("a", "r", str(i), "fk") for i in range(4)] + [("a", "r", "z", "candidate")], "source string, relation string, target string, edge_kind string")
    got = [tuple(r) for r in B.navigation(nodes, edges, 3, 2).orderBy("section", "place").collect()]
    assert got == [
        ("Relationships", 1, "- a -r-> 0"), ("Relationships", 2, "- a -r-> 1"), ("Relationships", 3, "- ... 2 more omitted; see graph.json for full relationship list."),
        ("t", 1, "- l0"), ("t", 2, "- l1"), ("t", 3, "- l2"), ("t", 4, "- ... 2 more omitted; see graph.json for full node list."),
    ]


def test_fnv_over_code_units(spark):
    texts = ["", "hello", "é京", "a😀b"]

    def brute(text):
        h, data = 2166136261, text.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
        return f"{h:08x}"

    got = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fnv1a(F.col("t")).alias("h")).collect()}
    assert got == {t: brute(t) for t in texts}


def test_log_is_redacted_and_expires(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "info", '{"token":"s","n":1}'), ("2024-01-09 10:00:00", "debug", "{}"), ("2024-01-10 10:00:00", "error", '{"a":[{"myApiKey":{"x":"s"}}]}')], "created_at string, level string, payload string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    sinks.write_diagnostics(rows, path, ["payload"])
    (tmp_path / "log/notes").mkdir()
    assert sinks.expire_days(spark, path, "2024-01-10", 0) == [] and sinks.expire_days(spark, path, "2024-01-10", 9) == []
    assert sinks.expire_days(spark, path, "2024-01-10", 8) == ["2024-01-01"] and (tmp_path / "log/notes").exists()
    assert [r.payload for r in spark.read.json(path + "/day=2024-01-10").collect()] == ['{"a":[{"myApiKey":"[REDACTED]"}]}']


def test_references_are_one_pass(spark, tmp_path):
    spark.range(6).withColumn("kind", F.when(F.col("id") % 2 == 0, "a").otherwise("b")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    targets = {"x": (spark.createDataFrame([("0",), ("1",)], "k string"), "k"), "y": (spark.range(4), "id")}
    rules = [T.Reference("r1", "t", "x", "id", "kind = 'a'"), T.Reference("r2", "t", "y", "id"), T.Reference("r3", "t", "y", "nullif(id, 1)", "id < 2"), T.Reference("r4", "t", "y", "nullif(id, 1)", "id < 2", nullable=True)]
    got = T.typed_references({"t": table}, targets, rules)
    assert sorted((r.rule, r.key or "") for r in got.collect()) == [("r1", "2"), ("r1", "4"), ("r2", "4"), ("r2", "5"), ("r3", "")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


@pytest.mark.parametrize("broken", [set(), {4}, {0, 7}])
def test_sweeps_isolate_errors(spark, tmp_path, broken):
    done = []

    def job(projects):
        ids = [r.project_id for r in projects.collect()]
        if broken & set(ids):
            raise ValueError("broken")
        done.extend(ids)

    projects = spark.range(9).select(F.col("id").alias("project_id"))
    got = {r.project_id: r.outcome for r in sweeps.sweep(projects, job, str(tmp_path), 3).collect()}
    assert got == {i: "failed" if i in broken else "done" for i in range(9)} and sorted(done) == sorted(set(range(9)) - broken)
    assert sweeps.sweep(projects, job, str(tmp_path), 3) is None and sweeps.sweep(projects.limit(0), job, str(tmp_path), 4).count() == 0


def test_limits_as_text(spark):
    given = [None, "x", "0", "-3", "7", " 8 ", "99", "1e3"]
    got = [r.n for r in spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string").select("i", R.bounded(F.col("g"), 10, 50).alias("n")).orderBy("i").collect()]
    assert got == [10, 10, 10, 10, 7, 8, 50, 10]
