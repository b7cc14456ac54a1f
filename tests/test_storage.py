"""Release commits, the outbox, the stored index and vectors, containment: failures, restarts and brute force."""

from __future__ import annotations

import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators import documents as D
from tessera.operators import governance as G
from tessera.operators import lookups as L
from tessera.operators import retrieval as R
from tessera.operators import tables as T
from tessera.operators.containment import contained
from tessera.sources import files, index, releases, vectors
from tessera.streaming import outbox


# releases ------------------------------------------------------------------------------------------
def frame(spark, n):
    return spark.range(n).withColumn("v", F.col("id").cast("string"))


def test_failed_writer_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "r")
    assert releases.current(spark, root, "main") is None
    first = releases.publish(spark, root, "main", "r1", {"pages": frame(spark, 3), "graph": frame(spark, 5)})
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("string").alias("v"))
    with pytest.raises(Exception, match="lost"):
        releases.publish(spark, root, "main", "r2", {"pages": frame(spark, 9), "graph": broken})
    assert releases.current(spark, root, "main") == first
    assert releases.read_asset(spark, root, "main", "pages").count() == 3
    assert len(releases.abandoned(spark, root, ["main"])) == 1
    assert releases.read_manifest(spark, first)["assets"]["graph"]["rows"] == 5 and releases.damaged(spark, first) == []


def test_second_writer_is_refused_and_rollback_goes_back(spark, tmp_path):
    root = str(tmp_path / "r")
    for i in (1, 2):
        releases.publish(spark, root, "main", f"r{i}", {"pages": frame(spark, i)})
    with pytest.raises(releases.Conflict):
        releases._move(spark, root, "main", 1, "late", "nowhere", "r1", "publish")
    held = releases.read_asset(spark, root, "main", "pages")
    back = releases.rollback(spark, root, "main")
    assert (back.release_id, back.number, back.parent) == ("r1", 3, None)
    assert releases.read_asset(spark, root, "main", "pages").count() == 1 and held.count() == 2
    with pytest.raises(ValueError, match="no release to go back to"):
        releases.rollback(spark, root, "main")
    assert [p.release_id for p in releases.history(spark, root, "main")] == ["r1", "r2", "r1"]


def test_unfinished_pointer_is_no_pointer(spark, tmp_path):
    root = str(tmp_path / "r")
    releases.publish(spark, root, "main", "r1", {"pages": frame(spark, 1)})
    (tmp_path / "r/channels/main/000000000002.json").write_text('{"number": 2, "rel')
    assert releases.current(spark, root, "main").release_id == "r1"
    moved = releases.publish(spark, root, "main", "r2", {"pages": frame(spark, 2)})
    assert moved.number == 3 and releases.current(spark, root, "main").release_id == "r2"


def test_fingerprint_sees_changes_not_order(spark, tmp_path):
    of = lambda df: tuple(releases.fingerprint(df).first())
    rows = [(1, "a", [1]), (2, None, []), (2, None, [])]
    schema = "k long, s string, xs array<long>"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::-1], schema).repartition(3)
    assert of(a) == of(b) and of(a) != of(spark.createDataFrame([(1, "a", [1]), (2, "", []), (2, None, [])], schema))
    assert of(a.limit(0)) == (0, "0")
    root = str(tmp_path / "r")
    pointer = releases.publish(spark, root, "main", "r1", {"pages": a})
    a.where("k = 1").write.mode("append").parquet(f"{pointer.folder}/pages")
    assert releases.damaged(spark, pointer) == ["pages"]


def test_regression_rolls_back_once(spark, tmp_path):
    root = str(tmp_path / "r")
    releases.publish(spark, root, "main", "r1", {"p/x": frame(spark, 1)})
    assert releases.verify_or_rollback(spark, root, "main", 0.1, 0.85)["event_type"] == "release.regressed_without_parent"
    releases.publish(spark, root, "main", "r2", {"p/x": frame(spark, 2)})
    assert releases.verify_or_rollback(spark, root, "main", 0.85, 0.85)["event_type"] == "release.verified"
    assert releases.verify_or_rollback(spark, root, "main", 0.5, 0.85)["rolled_back_to"] == "r1"
    with pytest.raises(ValueError, match="outside"):
        releases.publish(spark, root, "main", "r3", {"q/x": frame(spark, 1)}, releases.same_package({"p"}))


# outbox --------------------------------------------------------------------------------------------
def events(spark, n):
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"))
    return rows.withColumn("created_at", F.timestamp_seconds(F.col("event_id") + 1_000_000))


@pytest.mark.parametrize("fails_at", [1, 2, 3])
def test_killed_batches_are_delivered_once(spark, tmp_path, fails_at):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    df = events(spark, 40)
    outbox.append_events(df.repartitionByRange(4, "event_id"), source)
    outbox.append_events(df.where("event_id < 10").coalesce(1), source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(source)
    calls, seen = [], Counter()

    def handler(batch, number):
        calls.append(number)
        rows = [r.event_id for r in batch.collect()]
        assert rows == sorted(rows)
        if len(calls) == fails_at:
            raise RuntimeError("killed")
        seen.update(rows)

    with pytest.raises(Exception, match="killed"):
        outbox.deliver_once(spark, stream, folder, handler)
    outbox.deliver_once(spark, stream, folder, handler)
    outbox.deliver_once(spark, stream, folder, handler)  # nothing is left
    assert seen == Counter(range(40)) and outbox.ledger(spark, folder).count() == 40
    assert outbox.ledger(spark, folder).select("event_id").distinct().count() == 40


def test_a_batch_in_the_ledger_is_passed_over(spark, tmp_path):
    """A run that ends between the ledger and Spark's own commit runs the batch again, and nothing comes of it."""
    source, folder, calls = str(tmp_path / "in"), str(tmp_path / "out"), []
    df = events(spark, 6)
    outbox.append_events(df.coalesce(1), source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    outbox.deliver_once(spark, stream, folder, lambda batch, number: calls.append(number))
    (tmp_path / "out/offsets/commits/0").unlink()
    (tmp_path / "out/offsets/commits/.0.crc").unlink()
    outbox.deliver_once(spark, stream, folder, lambda batch, number: calls.append(number))
    assert calls == [0] and outbox.ledger(spark, folder).count() == 6


def test_routes_fail_on_their_own(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "routes")
    df = events(spark, 20)
    df.repartitionByRange(4, "event_id").write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got, broken = {"a": [], "b": []}, {"a"}

    def route(name):
        def run(rows, number):
            if name in broken and number != 1:
                raise RuntimeError(name)
            got[name] += [r.event_id for r in rows.collect()]

        return outbox.Route(F.col("event_type") == name, run)

    routes = {n: route(n) for n in got}
    outbox.route_events(spark, stream, folder, routes)
    state = {r.route: (r.batches, r.events, r.waiting, r.waiting_events) for r in outbox.route_states(spark, folder, ["a", "b"]).collect()}
    assert sorted(got["b"]) == list(range(1, 20, 2)) and state["b"][2:] == (0, 0) and state["a"][0] == 1 and state["a"][1] + state["a"][3] == 10
    broken.clear()
    outbox.retry_waiting(spark, folder, routes, df.schema)
    outbox.retry_waiting(spark, folder, routes, df.schema)
    assert sorted(got["a"]) == list(range(0, 20, 2)) and outbox.waiting_batches(spark, folder, "a") == []


def test_subscribers_do_not_stop_each_other(spark, tmp_path):
    told = []

    def fails(_):
        raise RuntimeError("x")

    assert outbox.append_events(events(spark, 3), str(tmp_path / "in"), [fails, lambda df: told.append(df.count())]) == ["x"]
    assert told == [3] and spark.read.parquet(str(tmp_path / "in")).count() == 3


# stored index --------------------------------------------------------------------------------------
@pytest.mark.parametrize("block_pages,first", [(1, 1), (3, 1), (7, 2), (1000, 4)])
def test_top_k_skips_nothing_that_counts(spark, tmp_path, block_pages, first):
    rng = random.Random(block_pages)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    pages = [(f"p{i}", " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(60)]
    df = spark.createDataFrame(pages, "component_id string, title string, body string")
    fields = {"title": F.col("title"), "body": F.col("body")}
    path = str(tmp_path / "index")
    index.write_index(df, fields, R.FIELD_WEIGHTS, path, keep=("title",), block_pages=block_pages)
    ix = index.read_index(spark, path, fields, R.FIELD_WEIGHTS)
    asked = [(q, w) for q in range(12) for w in set(rng.choices([*words, "none"], k=rng.randint(1, 6)))]
    terms = spark.createDataFrame(asked, "query_id long, term string")
    for k in (1, 5, 100):
        got = {(r.query_id, r.rank): (r.component_id, r.score) for r in index.top_k(ix, terms, k, first).collect()}
        want = {}
        for q in range(12):
            wanted = {w for i, w in asked if i == q}
            scores = [(-sum(R.FIELD_WEIGHTS[f] * len(wanted & set(t.split())) for f, t in (("title", a), ("body", b))), p) for p, a, b in pages]
            want |= {(q, n): (p, float(-s)) for n, (s, p) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)}
        assert got == want
    posts = Counter(tuple(r) for r in ix.posts().collect())
    assert posts == Counter(tuple(r) for r in R.postings(df, fields).select("component_id", "field", "weight", "term").collect())
    share = index.read_share(ix, terms, 1, first).agg(F.sum("read"), F.sum("postings")).first()
    assert 0 < share[0] <= share[1]


def test_index_is_written_again_when_its_source_changes(spark, tmp_path):
    source = str(tmp_path / "pages")
    write = lambda n: spark.createDataFrame([(str(i), "alpha") for i in range(n)], "component_id string, title string").coalesce(1).write.mode("overwrite").parquet(source)
    fields = {"title": F.col("title")}
    counts = []
    for n in (2, 2, 5):
        write(n)
        df = spark.read.parquet(source)
        counts.append(index.index_of(df, df, fields, R.FIELD_WEIGHTS).postings.count())
        assert index.index_of(df, df, fields, R.FIELD_WEIGHTS).pages.count() == n
    assert counts == [2, 2, 5]


# stored vectors ------------------------------------------------------------------------------------
@pytest.mark.parametrize("group", [1, 5, 1000])
def test_nearest_is_brute_force(spark, tmp_path, group):
    rng = np.random.default_rng(group)
    v = (rng.normal(size=(40, 6)) * rng.lognormal(0, 1.5, size=(40, 1))).round(3)
    v[7] = v[3]
    rows = [(f"c{i}", x.tolist()) for i, x in enumerate(v)] + [("null", None), ("hole", [1.0, None, 1.0, 1.0, 1.0, 1.0]), ("nan", [float("nan")] * 6), ("zero", [0.0] * 6)]
    path = str(tmp_path / "v")
    vectors.write_vectors(spark.createDataFrame(rows, "component_id string, vector array<double>"), path, group)
    q = rng.normal(size=(9, 6)).round(3)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(99, None)], "query_id long, vector array<double>")
    known = [(i, np.array(x)) for i, x in rows if x is not None and all(y is not None and y == y for y in x)]
    for k in (1, 4, 100):
        got = {(r.query_id, r.rank): (r.component_id, round(r.score, 9)) for r in vectors.nearest(spark, path, asked, k).collect()}
        want = {}
        for i, x in enumerate(q):
            best = sorted((-np.floor(float(x @ y) * 1e9 + 0.5) / 1e9, c) for c, y in known)[:k]
            want |= {(i, n): (c, round(-s, 9)) for n, (s, c) in enumerate(best, 1)}
        assert {key: c for key, (c, _) in got.items()} == {key: c for key, (c, _) in want.items()}
        assert all(abs(got[x][1] - want[x][1]) < 2e-9 for x in want)


# containment ---------------------------------------------------------------------------------------
def test_contained_is_brute_force(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcé京") for _ in range(n))
    texts = [text(rng.randint(0, 30)) for _ in range(60)] + [None, "", "aaa"]
    patterns = [text(rng.randint(1, 6)) for _ in range(80)] + [None, "", "a", "aa", "zzz", "京"]
    got = contained(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert Counter((r.text, r.pattern) for r in got.collect()) == Counter({(t, p) for t in texts for p in patterns if t and p and p in t})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hints_resolve_in_four_steps(spark):
    tables = spark.createDataFrame([("Combat/Skill",), ("Item",), ("abc",)], "table string")
    aliases = spark.createDataFrame([("Item", "道具表"), ("Item", "xy"), ("Combat/Skill", "配置")], "table string, alias string")
    hints = ["combat_skill", "道具表", "see CombatSkill (v2)", "用道具表查", "has xy in it", "配置", "table", "abcd", ""]
    df = spark.createDataFrame([("p", h) for h in hints], "component_id string, hint string")
    got = {r.hint: (r.table, r.step) for r in D.resolve_hints(df, tables, aliases).collect()}
    assert got == {"combat_skill": ("Combat/Skill", 1), "道具表": ("Item", 2), "see CombatSkill (v2)": ("Combat/Skill", 3), "用道具表查": ("Item", 4)}


# clusters ------------------------------------------------------------------------------------------
@pytest.mark.parametrize("chunk", [60, 4096])
def test_cluster_keys_in_chunks_are_the_replay(spark, chunk):
    import datetime as dt

    rng = np.random.default_rng(5)
    base = rng.normal(size=(8, 4))
    rows, start = [], dt.datetime(2024, 1, 1)
    for i in range(700):
        v = base[rng.integers(8)] + rng.normal(size=4) * 0.25
        v = None if i % 17 == 0 else (v / np.linalg.norm(v)).round(6).tolist()
        rows.append((i, "p1" if i % 11 else "p2", "miss", f"q{rng.integers(60)}", start + dt.timedelta(hours=int(rng.integers(1, 9)) + i * 7 // 2), v))
    df = spark.createDataFrame(rows, "event_id long, project_id string, feedback_type string, query string, created_at timestamp, vector array<double>").repartition(5)
    got = {r.event_id: r.cluster_key for r in G.cluster_keys(df, chunk=chunk).collect()}
    want, seen = {}, {}
    for i, project, _, query, at, v in sorted(rows, key=lambda r: (r[4], r[0])):
        best, key = -1, query
        for text, u, when, known in reversed(seen.setdefault(project, [])[-50:]):
            score = 10**9 if text == query else int(np.floor(np.dot(u, v) * 1e9 + 0.5)) if u is not None and v is not None else 0
            if (at - when).days <= 90 and score >= 850_000_000 and score > best:
                best, key = score, known
        seen[project].append((query, v, at, key))
        want[i] = key
    assert got == want and len(set(got.values())) < len({r[3] for r in rows})


# ranking -------------------------------------------------------------------------------------------
def test_explanations_have_all_lines(spark):
    pages = spark.createDataFrame([("p1", "Skill table", "open the skill table now"), ("p2", "Other", "nothing of it: table")], "component_id string, title string, body string")
    q = spark.createDataFrame([(1, "skill table 查表")], "query_id long, query string")
    posts = R.postings(pages, {"title": F.col("title"), "body": F.col("body")})
    hits = posts.join(R.placed_terms(q), "term").select("query_id", "component_id", "field", "term", "place")
    anchors = R.anchors_of(q)
    facts = spark.createDataFrame([("p1", ["T1", "T2"], "activity_template"), ("p2", [], "concept")], "component_id string, tables array<string>, type string")
    trust = spark.createDataFrame([("p1", 0.5)], "component_id string, trust double")
    phrases = R.phrase_hits(posts, pages.select("component_id", F.concat_ws("\n", "title", "body").alias("text")), spark.createDataFrame([(1, "skill table")], "query_id long, query string"))
    out = {r.component_id: r for r in R.explanations(hits, R.held_anchors(posts, anchors), anchors, phrases, R.intents_of(q), facts, trust).collect()}
    assert out["p1"].why == ["完整短语命中", "核心词命中标题/路径：skill, table", "title 命中：skill, table", "body 命中：skill, table", "配置表意图扩展：table", "配置表意图命中结构化表依赖：T1, T2", "可信度 0.5"]
    assert out["p2"].why == ["核心词命中正文：table", "body 命中：table", "配置表意图扩展：table"] and out["p1"].fields == ["body", "tables", "title"]


def test_intents_raise_pages_without_terms(spark):
    pages = spark.createDataFrame([(f"p{i}", "x", "y") for i in range(6)], "component_id string, title string, body string")
    posts = R.postings(pages, {"title": F.col("title"), "body": F.col("body")})
    q = spark.createDataFrame([(1, "查表"), (2, "nothing")], "query_id long, query string")
    facts = spark.createDataFrame([(f"p{i}", i % 2 == 0, "concept") for i in range(6)], "component_id string, has_tables boolean, type string")
    got = {(r.query_id, r.component_id): r.score for r in R.rank_lexical(posts, q, facts=facts, fill=2).collect()}
    assert got == {(1, "p0"): 4.0, (1, "p2"): 4.0}


def test_phrases_cross_word_borders(spark):
    pages = spark.createDataFrame([("p1", "a foo bar z"), ("p2", "foo barn"), ("p3", "foo x bar"), ("p4", "xfoo bar")], "component_id string, body string")
    posts = R.postings(pages, {"body": F.col("body")})
    asked = spark.createDataFrame([(1, "foo bar"), (2, "oo bar z"), (3, "a"), (4, "***"), (5, "x bar")], "query_id long, query string")
    got = {(r.query_id, r.component_id) for r in R.phrase_hits(posts, pages.select("component_id", F.col("body").alias("text")), asked).collect()}
    assert got == {(1, "p1"), (1, "p2"), (1, "p4"), (2, "p1"), (3, "p1"), (5, "p3")}
    assert tokenize(F.lit("x")) is not None


# sources -------------------------------------------------------------------------------------------
def test_source_root_of_several_children(spark):
    of = lambda *paths: L.source_root(spark.createDataFrame([(p,) for p in paths], "path string")).first().root
    assert of("a/gamedata/x.csv", "a/gamedocs/y.md") == "a" and of("a/gamedata/x", "b/gamedocs/y") == "" and of("gamedata/x", "a/gamedata/y") == ""
    assert of("a/b.txt") == "" and of(".git/gamedata/x", "c/gamedata/y") == "c"


def test_header_choice_compares_alias_keys(spark):
    cells = spark.createDataFrame([("t", 0, 0, "item_id"), ("t", 0, 1, "na me"), ("t", 1, 0, "aa"), ("t", 1, 1, "bb"), ("u", 0, 0, "1"), ("u", 0, 1, "2"), ("u", 0, 2, "3")], "table string, row_idx int, col_idx int, value string")
    fields = spark.createDataFrame([("t", "itemId"), ("t", "name"), ("u", "q")], "table string, field string")
    assert {(r.table, r.row_idx, r.score) for r in T.query_header_row(cells, fields).collect()} == {("t", 0, 41), ("u", 0, -1)}


def test_sheets_in_the_order_of_the_workbook(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda v: f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1"><v>{v}</v></c></row><row r="2"/></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="2" r:id="rId9"/><sheet name="Two" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet(1))
        z.writestr("xl/worksheets/sheet2.xml", sheet(2))
    cells = files.workbook_cells(spark, str(tmp_path))
    assert {(r.sheet, r.sheet_idx, r.value) for r in cells.collect()} == {("One", 0, "2"), ("Two", 1, "1")}
    assert [r.value for r in files.first_sheet(cells).collect()] == ["2"]


def test_csv_fields_of_long_and_broken_lines(spark, tmp_path):
    lines = ['"a,1","b ""x"" y",', ",,", '"' + "q," * 20_000 + '"', 'un"closed,x', "plain"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    got = {}
    for r in files.csv_cells(spark, str(tmp_path)).collect():
        got.setdefault(r.row_idx, []).append((r.col_idx, r.value))
    rows = {k: [x for _, x in sorted(v)] for k, v in got.items()}
    assert rows[0] == ["a,1", 'b "x" y', ""] and rows[1] == ["", "", ""] and rows[2] == ["q," * 20_000] and rows[4] == ["plain"] and rows[3] == ['un"closed', "x"]
