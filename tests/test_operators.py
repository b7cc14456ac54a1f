"""Operators on small inline frames: branches the driver's tables don't reach."""

from __future__ import annotations

import datetime as dt
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.rounding import clamp01, half_up
from tessera.operators import documents as D
from tessera.operators import evaluation as E
from tessera.operators import governance as G
from tessera.operators import lookups as L
from tessera.operators import relational as R
from tessera.operators import retrieval as Q
from tessera.operators import tables as T
from tessera.operators import trust as TR
from tessera.sources import files, sinks


def one(spark, **columns):
    """A column expression's value on one row."""
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_rounding_goes_up_at_half(spark):
    r = one(spark, a=half_up(F.lit(0.5005)), b=half_up(F.lit(-0.0005)), c=clamp01(F.lit(None).cast("double")))
    assert (r.a, r.b, r.c) == (0.5, 0.0, None)


def test_tokens_with_han(spark):
    r = one(spark, t=X.tokenize(F.lit("Skill 活动结构 A1 skill")), n=X.normalize_text(F.lit("ＡＢ  `x`"), unicode_forms=True))
    assert r.t == ["skill", "活动结构", "活动", "动结", "结构", "活动结", "动结构", "a1"] and r.n == "ab x"


def test_text_functions(spark):
    r = one(
        spark, a=X.alias_key_query(F.lit(" Combat/Skill (v2)")), b=X.alias_key_build(F.lit("Combat/Skill-x_y")), c=X.page_slug(F.lit("!!!")), d=X.page_slug(F.lit("Büro 7")),
        e=X.fnv1a(F.lit("hello")), f=X.gap_query_key(F.lit("   ")), g=X.loose_json(F.lit('text ```json\n{"a":1}\n``` end')), h=X.loose_json(F.lit('x {"b": 2} y')), i=X.yaml_scalar(F.lit('a: 1\n  title: "T x"'), "title"),
        j=R.redact(F.lit('{"apiKey":"1","user_token": "abc","n":2}')), k=X.loose_json(F.lit("none")),
    )
    assert (r.a, r.b, r.d, r.e, r.f, r.g, r.h, r.i, r.k) == ("combatskillv2", "combatskillxy", "büro-7", "4f9f2cab", "empty", '{"a":1}', '{"b": 2}', "T x", None)
    assert r.c.startswith("page-") and r.j == '{"apiKey":"[REDACTED]","user_token":"abc","n":2}'


def test_intents_and_anchors(spark):
    q = spark.createDataFrame([(1, "查表 Skill"), (2, "证据"), (3, "plain ab")], "query_id long, query string")
    assert {r.intent for r in Q.intents_of(q).where("query_id = 1").collect()} == {"tables"}
    assert {(r.query_id, r.anchor) for r in Q.anchors_of(q).collect()} == {(1, "skill"), (3, "plain")}
    pages = spark.createDataFrame([("p1", "Skills", "skill table"), ("p2", "Other", "nothing")], "component_id string, title string, body string")
    posts = Q.postings(pages, {"title": F.col("title"), "body": F.col("body")})
    got = {(r.query_id, r.component_id): r.score for r in Q.rank_lexical(posts, q).collect()}
    # body match 1 + title anchor 90 + intent words 'table' (body) 1 + intent 3
    assert got[1, "p1"] == 1 + 90 + 1 + 3


def test_conditional_routes(spark):
    hits = "query_id long, component_id string, score double, rank int"
    lex = spark.createDataFrame([(1, "a", 3.0, 1), (2, "b", 50.0, 1)], hits)
    hashed = spark.createDataFrame([(1, "h", 0.5, 1), (2, "h", 0.5, 1)], hits)
    semantic = spark.createDataFrame([(1, "s", 0.5, 1), (2, "s", 0.5, 1)], hits)
    q = spark.createDataFrame([(1, "活动玩法"), (2, "活动玩法")], "query_id long, query string")
    ids = lambda df: {(r.query_id, r.component_id) for r in df.collect()}
    assert ids(Q.conditional(lex, hashed, semantic, q, 5)) == {(1, "a"), (1, "s"), (2, "b"), (2, "h")}
    assert ids(Q.conditional(lex, hashed, None, q, 5)) == {(1, "a"), (2, "b"), (2, "h")}


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, component_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id long, component_id string, rank int")
    key = lambda df: {(r.component_id, round(r.score, 12)) for r in df.collect()}
    assert key(Q.fuse([a, b])) == key(Q.fuse([b, a])) and Q.pool_size(3) == 20 and Q.pool_size(30) == 60


def test_hit_rate_without_cases_is_one(spark):
    none = spark.createDataFrame([], "query_id long, component_id string, rank int")
    assert Q.hit_at_k(none.drop("rank"), none).first().hit_rate == 1.0


def test_bounded_limit():
    assert [R.bounded_limit(v, 10, 50) for v in (None, "x", 0, -3, 7, "8", 99)] == [10, 10, 10, 10, 7, 8, 50]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 9)), st.sets(st.integers(0, 9)))
def test_diff_is_a_partition(spark, old, new):
    frame = lambda s: spark.createDataFrame([(i, str(i % 3)) for i in s], "k long, h string")
    got = {r.k: r.change for r in R.full_diff(frame(old), frame(new), "k", "h").collect()}
    assert got == {k: "added" if k not in old else "removed" if k not in new else "unchanged" for k in old | new}


def test_trust_never_exceeds_its_caps(spark):
    rows = [(1.0, 0.3, 1.0, 1.0, None, True, 1, 1, "2024-01-01", 0, 0), (1.0, 1.0, 1.0, 1.0, 1.0, True, 1, 1, "2024-01-01", 0, 0), (1.0, 1.0, 1.0, 0.1, None, False, 0, 0, None, 1, 0)]
    df = spark.createDataFrame(rows, "evidence double, completeness double, freshness double, consistency double, consumption double, required boolean, evidence_rows int, source_refs int, audited string, blocking int, warning int")
    got = [(r.trust_score, r.trust_status, r.trust_version) for r in TR.trust(df).collect()]
    assert got == [(0.55, "needs_review", "v2-lite"), (1.0, "trusted", "v3-consumption"), (0.5, "blocked", "v2-lite")]
    r = one(spark, a=TR.consumption_score(F.lit(0), F.lit(0), F.lit(0), F.lit(0)), b=TR.consumption_score(F.lit(2), F.lit(4), F.lit(4), F.lit(0)), c=TR.consumption_score(F.lit(0), F.lit(0), F.lit(0), F.lit(9)))
    assert (r.a, r.b) == (0.5, 1.0) and abs(r.c - 0.05) < 1e-9


def test_build_plan_and_gate(spark):
    plan = lambda kinds: G.build_plan(spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "k int, change string")).first().mode
    assert [plan(["added"]), plan(["added", "removed"]), plan(["unchanged"]), plan(["modified"] * 13)] == ["incremental", "full", "full", "full"]
    facts = {"parent": None, "removed": 0, "changed": 1, "block_on_deletes": True, "blocking_tasks": 0, "block_on_trust_decline": True, "declines": 0, "block_on_corrections": True, "pending_corrections": 0, "below_min_trust": 0, "block_on_regression": True, "regressed": False, "lint_unresolved": 0, "hit_at_k": 0.85, "min_hit_at_k": 0.85, "citation": 1.0, "min_citation": 0.0, "binding_ok": True}
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in facts.items()))
    assert [r.reason for r in G.gate_reasons(row).collect()] == ["missing_parent_release"]


def test_cluster_keys_follow_earlier_rows(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, "p", "miss", "a", at, [1.0, 0.0]), (2, "p", "miss", "b", at + dt.timedelta(days=1), [0.9, 0.436]), (3, "p", "miss", "c", at + dt.timedelta(days=2), [0.0, 1.0]), (4, "p", "miss", "a", at + dt.timedelta(days=200), [1.0, 0.0]), (5, "p", "hit", "b", at, None)]
    df = spark.createDataFrame(rows, "event_id long, project_id string, feedback_type string, query string, created_at timestamp, vector array<double>")
    assert {r.event_id: r.cluster_key for r in G.cluster_keys(df).collect()} == {1: "a", 2: "a", 3: "c", 4: "a", 5: "b"}


def test_gap_state_matches_a_replay(spark):
    rows = [(i, "p", f"q{i % 3}", "k" + str(i % 3), dt.datetime(2024, 1, 1 + i), "want" if i == 1 else "") for i in range(7)]
    df = spark.createDataFrame(rows, "event_id long, project_id string, query string, query_key string, created_at timestamp, expected string")
    state: dict = {}
    for _, _, _, key, _, expected in rows:
        n, status, want = state.get(key, (0, "open", ""))
        n, status, want = n + 1, "open" if status == "dismissed" else status, expected or want
        state[key] = (n, "dismissed" if n >= 3 and status == "open" else status, want)
    assert {r.query_key: (r.event_count, r.status, r.expected) for r in G.gap_candidates(df).collect()} == state


def grid(spark, table, rows):
    return spark.createDataFrame([(table, r, c, str(v)) for r, row in enumerate(rows) for c, v in enumerate(row)], "table string, row_idx int, col_idx int, value string")


def test_header_with_metadata_rows(spark):
    cells = grid(spark, "Equip", [[4, 1], ["编号", "类型"], ["int", "string"], ["key", "both"], ["equipId", "equipType"], ["1", "sword"], ["", ""]])
    assert T.header_row(cells).first().row_idx == 4
    fields = spark.createDataFrame([("Equip", "equipId"), ("Equip", "equipType")], "table string, field string")
    assert T.query_header_row(cells, fields).first().row_idx == 4
    assert [r.cells for r in T.named_rows(cells, T.header_row(cells)).collect()] == [{"equipId": "1", "equipType": "sword"}]


def test_foreign_keys_by_name(spark):
    f = spark.createDataFrame([("Combat/Skill", "Id"), ("Combat/Skill", "BuffId"), ("Buff", "Id"), ("Buff", "buff_id")], "table string, field string")
    assert [(r.source, r.target, r.field, r.state) for r in T.infer_foreign_keys(f, ["_x"]).collect()] == [("Combat/Skill", "Buff", "BuffId", "candidate")]


PAGE = "---\ntitle: Battle\ntype: system\n---\nlost\n# Rules\ntext\n## Data Dependencies\n- Skill\n- 无\n- 1-2 title：\n# Trust\nscore\n# Citations\n1. A quote (ev1; source s1; confidence 0.8)\n2. bare"


def test_page_parts(spark):
    p = spark.createDataFrame([("c1", PAGE)], "component_id string, md string").select("component_id", D.frontmatter(F.col("md")).alias("p")).select("component_id", "p.*")
    parts = D.sections(p)
    assert [(r.heading, r.level) for r in parts.orderBy("section").collect()] == [("Rules", 1), ("Data Dependencies", 2), ("Trust", 1), ("Citations", 1)]
    assert D.section_text(parts, "rules").first().text == "text\n## Data Dependencies\n- Skill\n- 无\n- 1-2 title："
    assert [r.hint for r in D.dependency_hints(parts).collect()] == ["Skill"]
    assert {(r.n, r.evidence_id, r.confidence) for r in D.citations(parts).collect()} == {(1, "ev1", 0.8), (2, "okf:c1:2", None)}
    kept = p.select(D.strip_utility(F.col("body")).alias("x")).first().x
    assert "score" not in kept and "A quote" not in kept and "Skill" in kept
    assert one(spark, u=D.frontmatter(F.lit("---\nno end"))["unclosed"]).u


def test_rewrite_problems(spark):
    table = "| a | b |\n| - | - |\n| 1 |"
    r = one(spark, a=D.rewrite_problems(F.lit(table), F.array(F.lit("e")), F.lit("1")), b=D.rewrite_problems(F.lit("[ev-1] 5"), F.array(F.lit("ev-1")), F.lit("5")))
    assert (r.a, r.b) == (["table_shape"], [])


def test_answers(spark):
    df = spark.createDataFrame([("a", "class=dps, 42 points", ["dps", "≈40"]), ("b", "nothing", ["x"]), ("c", "x", ["x", "y"])], "case_id string, answer string, key_facts array<string>")
    assert {r.case_id: r.status for r in E.score_answers(df).collect()} == {"a": "pass", "b": "fail", "c": "partial"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "src/gamedata").mkdir(parents=True)
    (tmp_path / "src/gamedocs").mkdir()
    (tmp_path / "src/gamedata/a.csv").write_text('﻿Id,Name\n1,"x, ""y"""\n2\n', encoding="utf-8")
    (tmp_path / "src/gamedocs/p.md").write_text("# P\nbody")
    (tmp_path / "src/gamedocs/index.md").write_text("# I")
    root = str(tmp_path / "src")
    assert {(r.path, r.kind) for r in files.snapshot(spark, root).collect()} == {("gamedata/a.csv", "table"), ("gamedocs/p.md", "text"), ("gamedocs/index.md", "text")}
    assert {(r.row_idx, r.col_idx): r.value for r in files.csv_cells(spark, root).collect()} == {(0, 0): "Id", (0, 1): "Name", (1, 0): "1", (1, 1): 'x, "y"', (2, 0): "2"}
    assert {r.path for r in files.markdown_pages(spark, root + "/gamedocs").collect()} == {"p.md"}
    with zipfile.ZipFile(tmp_path / "src/gamedata/b.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Id</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>')
    assert {(r.sheet, r.row_idx, r.col_idx, r.value) for r in files.workbook_cells(spark, root).collect()} == {("S", 0, 0, "Id"), ("S", 0, 2, "7")}
    cells = files.workbook_cells(spark, root)
    assert files.sheet_markdown(cells).first().markdown == "| Id |  | 7 |\n| - | - | - |"
    odd = spark.createDataFrame([("p", "S", 0, 0, "a|b" + chr(92) + "c"), ("p", "S", 1, 1, "x"), ("p", "S", 9, 0, " ")], "path string, sheet string, row_idx int, col_idx int, value string")
    assert files.sheet_markdown(odd).first().markdown.splitlines()[0] == "| a" + chr(92) + "|b" + chr(92) * 2 + "c |  |"
    assert (files.sheet_schemas(odd).first().sheets, files.sheet_schemas(odd).first().rows) == (["S"], 9)
    assert files.sheet_preview(odd, 1).count() == 1
    assert files.text_preview(spark.createDataFrame([("p", "a\nb\nc")], "path string, text string"), 2).first()[1:] == ("a\nb", True, None)
    assert files.text_preview(spark.createDataFrame([("p", "a\0b")], "path string, text string")).first()[1:] == (None, False, "binary")
    with zipfile.ZipFile(tmp_path / "src/gamedocs/d.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a </w:t><w:drawing/><w:t>b</w:t></w:r></w:p></w:body></w:document>')
    assert files.document_markdown(spark, root).first().markdown == "## Head\n\na ![image]b"
    for text in ('[{"table":"T","aliases":["a","b"]}]', '{"aliases":[{"canonical":"T","aliases":["a","b"]}]}', '{"a":"T","b":"T"}'):
        (tmp_path / "alias.json").write_text(text)
        assert {(r["table"], r.alias) for r in files.aliases(spark, str(tmp_path / "alias.json")).collect()} == {("T", "a"), ("T", "b")}
    blobs = spark.createDataFrame([(b"1",), (b"1",), (b"2",)], "content binary")
    sinks.write_blobs(blobs, str(tmp_path / "blobs"))
    sinks.write_blobs(blobs, str(tmp_path / "blobs"))
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 2
    sinks.export_release({"pages": blobs}, str(tmp_path / "rel"), "r1")
    with pytest.raises(Exception, match="exist"):
        sinks.export_release({"pages": blobs}, str(tmp_path / "rel"), "r1")
    sinks.write_log(spark.createDataFrame([(dt.datetime(2024, 1, 2), "m")], "created_at timestamp, message string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    assert sinks.manifest_hash({"b": 1, "a": [2]}) == sinks.manifest_hash({"a": [2], "b": 1})


def test_stream_equals_batch(spark):
    from tessera.plans.registry import QUERIES

    got = {r.allowed: r.n for r in QUERIES["win9_rate_limit"](spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "event_id").orderBy("user_id", "ts", "event_id").collect()
    times: dict = {}
    allowed = 0
    for r in rows:
        kept = [t for t in times.get(r.user_id, []) if (r.ts - t).total_seconds() < 36000]
        if len(kept) < 3:
            kept.append(r.ts)
            allowed += 1
        times[r.user_id] = kept
    assert got == {k: v for k, v in ((True, allowed), (False, len(rows) - allowed)) if v}


def test_sweep_keeps_errors_apart():
    def job(project):
        if project == "b":
            raise ValueError("no source")

    assert L.sweep(["a", "b", "c"], job) == [("a", "done"), ("b", "failed: no source"), ("c", "done")]


def test_best_earlier_over_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(90, 4)), 1)
    df = spark.createDataFrame([(i, i % 2, v[i].tolist()) for i in range(90)] + [(95, 0, None)], "id long, g long, v array<double>")
    got = {r.id: (r.match, round(r.score, 9)) for r in Q.best_earlier(df, "g", "id", "v", block=7).collect()}
    want = {}
    for i in range(2, 90):
        s, j = min((-round(float(v[i] @ v[j]), 9), j) for j in range(i % 2, i, 2))
        want[i] = (j, -s)
    assert got == want
    assert Q.best_earlier(df.limit(0), "g", "id", "v").count() == 0


def test_sampled_groups(spark):
    df = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 5), (3, None)], "u long, e long")
    got = {r.u: (r["count"], r["sample"], r["truncated"]) for r in R.sampled_groups(df, ["u"], "e", 20).collect()}
    assert got == {1: (30, list(range(20)), True), 2: (1, [5], False), 3: (0, None, False)}


def test_answers_by_kind_of_fact(spark):
    df = spark.createDataFrame([("a", "It costs 8-10 Gold", ["10", "Gold", "≈10.2", "gold"]), ("b", "", []), ("c", "x 104", ["10", "≈abc"])], "case_id string, answer string, key_facts array<string>")
    got = {r.case_id: (r.score, r.status) for r in E.score_answers(df).collect()}
    assert got == {"a": (0.75, "partial"), "b": (1.0, "pass"), "c": (0.0, "fail")}
    row = one(spark, n=E.answer_numbers(F.lit("8-10, 3.5 至 4")), u=E.unknown_ids(F.lit("EM009 EM009 M040 MM001 M041"), {"M": (1, 40), "EM": (1, 8)}))
    assert row.n == [8.0, -10.0, 3.5, 4.0, 8.0, 3.5, 10.0, 4.0] and row.u == ["EM009", "M041"]


def test_stale_times(spark):
    now = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    stale = lambda at: X.is_stale(F.lit(at).cast("string"), now, 7)
    row = one(spark, a=stale(None), b=stale("soon"), c=stale("2024-01-03 00:00:00"), d=stale("2024-01-02 23:59:59"))
    assert tuple(row) == (True, True, False, True)
