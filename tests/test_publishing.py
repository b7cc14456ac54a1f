"""Publishing: trust scored anew, nested names, profiles and figures on inline frames."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import publishing as P
from tessera.operators import trust as T
from tessera.sources import sinks

NOW = "2024-06-01 00:00:00"


def inputs(spark):
    rows = [(str(i), "pages/systems/x", "wiki_page", 0.9 - i * 0.1, 0.8, 1.0, None, True, 1, 1, None if i % 2 else "2023-01-01 00:00:00", 0, 0) for i in range(6)]
    df = spark.createDataFrame(rows, "component_id string, path string, kind string, evidence double, completeness double, consistency double, consumption double, required boolean, evidence_rows int, source_refs int, audited string, blocking int, warning int")
    audited = F.col("audited").cast("timestamp")
    return df.withColumn("audited", audited).withColumn("freshness", T.freshness_score(audited, F.lit(NOW), T.half_life(F.col("path"), F.col("kind"))))


def test_republish_is_a_full_recompute_of_what_changed(spark):
    df = inputs(spark)
    stored = T.trust(df)
    changed = spark.createDataFrame([("1",), ("4",), ("4",)], "component_id string")
    got = {r.component_id: r for r in P.republish(df, stored, changed, F.lit(NOW)).collect()}
    full = {r.component_id: r for r in P.republish(df, stored, df, F.lit(NOW)).collect()}
    before = {r.component_id: r for r in stored.collect()}
    assert {c for c, r in got.items() if r.recomputed} == {"1", "4"} and len(got) == 6
    for c, r in got.items():
        want = full[c] if c in ("1", "4") else before[c]
        assert (r.trust_score, r.trust_status) == (want.trust_score, want.trust_status) and r.before == before[c].trust_score
        assert r.event == (c in ("1", "4") and abs(r.trust_score - r.before) >= 0.05)
    assert P.republish(df, stored.limit(0), changed, F.lit(NOW)).where("event").count() == 0


def test_names_are_normalised_everywhere_once(spark):
    pages = spark.createDataFrame(
        [
            ("p1", "P", {"config_table": "skill tbl，other", "u": "1"}, [("SKILL TBL", "thing"), ("Item", "table"), ("x", "npc")], [("x", "uses", "item_t"), ("P", "configured_in", "Item")], ["item t", "zzz"]),
            ("p2", "Q", {"u": "1"}, [], [("a", "b", "c")], []),
            ("p3", "R", {}, [], [("Item", "b", "c")], None),
        ],
        "component_id string, title string, facts map<string,string>, entities array<struct<name:string,type:string>>, relationships array<struct<source:string,relation:string,target:string>>, dependencies array<string>",
    )
    aliases = spark.createDataFrame([("Skill", "skill_tbl"), ("Item", "ItemT")], "table string, alias string")
    out = {r.component_id: r for r in P.normalise_pages(pages, aliases).collect()}
    assert out["p1"].facts == {"config_table": "Item, Skill", "u": "1"} and out["p1"].tables == ["Item", "Skill"]
    assert [tuple(e) for e in out["p1"].entities] == [("Skill", "config_table"), ("Item", "table"), ("x", "npc"), ("Item", "config_table")]
    assert [tuple(r) for r in out["p1"].relationships] == [("x", "uses", "Item"), ("P", "configured_in", "Item"), ("P", "configured_in", "Skill")]
    assert out["p2"].facts == {"u": "1"} and out["p2"].tables == [] and len(out["p2"].relationships) == 1
    # an end that is canonical already means nothing
    assert out["p3"].tables == [] and out["p3"].facts == {}


FIELDS = [P.Field("a.x", "number", 0, 1), P.Field("a.n", "int", 1, 10), P.Field("b", "bool"), P.Field("c.d.e", "text"), P.Field("m", "choice", values=("on", "off"))]


def merged(spark, *configs):
    df = spark.createDataFrame([("p", i, c) for i, c in enumerate(configs)], "project_id string, level int, config string")
    rows = P.nested(P.merge_profiles(df, FIELDS).select("project_id", "path", "value")).collect()
    return json.loads(rows[0].config) if rows else None


def test_profiles_merge_by_field(spark):
    base = '{"a":{"x":0.5,"n":3},"b":true,"c":{"d":{"e":"q \\" \\\\ |"}},"m":"on"}'
    assert merged(spark, base) == {"a": {"x": 0.5, "n": 3}, "b": True, "c": {"d": {"e": 'q " \\ |'}}, "m": "on"}
    assert merged(spark, base, '{"a":{"x":7,"zz":1},"b":"yes","m":"never"}', '{"a":{"n":2.5},"c":{"d":5}}') == {"a": {"x": 1.0, "n": 3}, "b": True, "c": {"d": {"e": 'q " \\ |'}}, "m": "on"}
    assert merged(spark, base, '{"a":5,"b":false,"m":"off"}', "not json") == {"a": {"x": 0.5, "n": 3}, "b": False, "c": {"d": {"e": 'q " \\ |'}}, "m": "off"}
    assert merged(spark, base, '{"a":{"x":"0.1","n":null}}', None)["a"] == {"x": 0.5, "n": 3}
    assert merged(spark, "[]") is None and merged(spark, None) is None


def test_figures_take_a_scan_a_table(spark, tmp_path):
    for n in ("a", "b"):
        spark.range(10).withColumn("x", F.col("id") * 2).write.parquet(str(tmp_path / n))
    tables = {n: spark.read.parquet(str(tmp_path / n)) for n in ("a", "b")}
    wanted = [P.Figure("a.n", "a", "count(*)"), P.Figure("a.sum", "a", "sum(x)", 0.1), P.Figure("b.max", "b", "max(x)"), P.Figure("a.d", "a", "count(DISTINCT x % 3)"), P.Figure("b.none", "b", "max(x) FILTER (WHERE x > 99)")]
    got = P.figures(tables, wanted)
    assert {r.name: r.value for r in got.collect()} == {"a.n": 10.0, "a.sum": 90.0, "b.max": 18.0, "a.d": 3.0, "b.none": None}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    stated = spark.createDataFrame([("a.n", 11.0), ("a.sum", 98.0), ("b.max", 18.0), ("b.none", 1.0)], "name string, stated double")
    assert {r.name: r.consistent for r in P.audit_figures(tables, wanted, stated).collect()} == {"a.n": False, "a.sum": True, "b.max": True, "a.d": False, "b.none": False}


def test_tree_hash_follows_folders(spark):
    rows = [("a/b/1", "h1"), ("a/b/2", "h2"), ("a/3", "h3"), ("4", "h4")]
    of = lambda r: {x.path: x.hash for x in sinks.tree_hash(spark.createDataFrame(r, "path string, hash string")).collect()}
    one, two = of(rows), of([("a/b/1", "h1"), ("a/b/2", "h2"), ("a/3", "other"), ("4", "h4")])
    assert set(one) == {"", "a", "a/b"} and one["a/b"] == two["a/b"] and one["a"] != two["a"] and one[""] != two[""] and of(rows[::-1]) == one
    assert of([]) == {} if rows[:0] else sinks.tree_hash(spark.createDataFrame([], "path string, hash string")).count() == 0
