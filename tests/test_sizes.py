"""Results on tables that are larger, or odder, than the driver's."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.text import tokenize
from tessera.operators import lookups as L
from tessera.operators import publishing as P
from tessera.operators import retrieval as R
from tessera.plans import publishing, registry
from tessera.sources import index as I
from tests.compare import SMALL, connect, rows


def folder_with(spark, tmp_path, **changed):
    """A data folder of the smallest tables, some of them changed."""
    import os

    for name in os.listdir(SMALL):
        if name.split(".")[0] not in changed:
            os.symlink(f"{SMALL}/{name}", tmp_path / name)
    for name, df in changed.items():
        df.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    return str(tmp_path)


def same(spark, folder, name):
    got = registry.QUERIES[name](spark, folder).toPandas()
    assert rows(got) == rows(connect(folder).sql(registry.ORACLES[name]).df())


def test_names_that_many_tables_share_do_not_multiply(spark):
    n = 40_000
    wanted = spark.range(n).select(F.lit("HOT  Bolt").alias("request"))
    schemas = spark.range(n).select(F.lit("hot bolt").alias("table"), F.concat(F.lit("T"), "id").alias("title"), F.concat(F.lit("a"), "id").alias("artifact_id"))
    aliases = schemas.select("table", F.lit("bolt (hot)").alias("alias"))
    assert [tuple(r) for r in L.resolve_tables(wanted, schemas, aliases).collect()] == [("HOT  Bolt", "hot bolt")]


def test_prices_of_any_part_number(spark, tmp_path):
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    odd = F.when(F.col("p_partkey") % 7 == 0, F.col("p_retailprice") * 1e6).when(F.col("p_partkey") % 11 == 0, None).when(F.col("p_partkey") % 13 == 0, -1.0).when(F.col("p_partkey") % 17 == 0, float("inf")).otherwise(F.col("p_retailprice"))
    same(spark, folder_with(spark, tmp_path, part=part.withColumn("p_partkey", F.col("p_partkey") + 119_900).withColumn("p_retailprice", odd)), "val8_formula_broken")


def test_figures_of_large_and_empty_tables(spark, tmp_path):
    part = spark.read.parquet(f"{SMALL}/part.parquet").withColumn("p_retailprice", F.col("p_retailprice") * 1e6)
    supplier = spark.read.parquet(f"{SMALL}/supplier.parquet").limit(0)
    same(spark, folder_with(spark, tmp_path, part=part, supplier=supplier), "eva2_all_figures")


def shuffled(spark) -> int:
    """Rows that stages have written for others so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages, total = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator(), 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


@pytest.mark.parametrize("name", ["ret16_kb_search", "ret6_ranked_with_intents", "ret8_explanations", "ret15_rerank_by_terms", "ret7_ranked_search", "ret5_exact_phrase", "ret18_match_class", "ret20_align_tables", "ret6_intent_bonus"])
def test_matches_of_terms_are_not_shuffled(spark, tmp_path, name):
    """All of 2000 pages hold all of some 30 words of 20 queries: 1.2 million matches, of which no stage writes rows for another."""
    text = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("item_id = 0").first().text
    words = text.split()
    documents = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.lit(" "), "id").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 5).alias("source"), F.lit(300).cast("long").alias("n_chars"))
    benchmark = spark.createDataFrame([(i, " ".join(words[i % 3 :])) for i in range(20)], "item_id long, text string")
    folder = folder_with(spark, tmp_path, documents=documents, benchmark=benchmark)
    before = shuffled(spark)
    registry.QUERIES[name](spark, folder).count()
    assert shuffled(spark) - before < 400_000


@pytest.mark.parametrize("name", ["ret2_lexical_score", "ret4_anchors", "ret6_ranked_with_intents", "ret7_ranked_search", "ret1_index_build"])
def test_scores_of_odd_pages(spark, tmp_path, name):
    """Texts that are null, empty, of one long token, or equal."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = F.when(F.col("doc_id") % 9 == 1, None).when(F.col("doc_id") % 9 == 2, "").when(F.col("doc_id") % 9 == 3, F.repeat(F.lit("que"), 400)).when(F.col("doc_id") % 9 < 6, "el mente el QUE ciones").otherwise(F.col("text"))
    same(spark, folder_with(spark, tmp_path, documents=d.withColumn("text", odd)), name)


def test_tokens_of_odd_texts(spark):
    """Tokens cut in Arrow are those of the expression, also where lower case turns other letters into ASCII; parts are bounded in bytes and hold every row."""
    texts = ["A1 b-b A1 b", "", None, "\u212aelvin \u0130x stra\u00dfe \u00c5b", "活动a活动B", "x\0y\nz", "q" * 50_000, "\u01c5 \ufb01 \U0001d400a", "a\u0301 Z"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    want = [r.w for r in rows.orderBy("id").select(tokenize(F.col("t"), han=False).alias("w")).collect()]
    cut = pa.array(texts, pa.string())
    assert T.ascii_tokens(cut).to_pylist() == want
    assert T.ascii_tokens(cut[2:5]).to_pylist() == want[2:5]
    long = pa.array(["é" * 1_000_000] * 9 + [None, "x" * 20_000_000, ""], pa.string())
    cuts = list(T.parts(long, long))
    assert [r for a, b in cuts for r in range(a, b)] == list(range(len(long)))
    assert all(b == a + 1 or sum(2 * len((x or "").encode()) for x in long[a:b].to_pylist()) <= T.PART_BYTES for a, b in cuts)
    assert list(T.parts(cut[:0])) == []


def test_tokens_of_a_field_are_one_text(spark, tmp_path):
    """Pages are dealt and sent to Python as a few texts each, not as arrays of tokens; null and empty fields have none."""
    pages = spark.createDataFrame([("a", "One two", None, 3), ("b", None, "two TWO x1", 4), ("c", "", "", None)], "component_id string, title string, body string, n int")
    fields = {"title": F.col("title"), "body": F.concat_ws(" ", "title", "body")}
    for han in (False, True):
        path = str(tmp_path / str(han))
        I.write_index(pages, fields, R.FIELD_WEIGHTS, path, keep=("title", "n"), han=han)
        ix = I.read_index(spark, path, fields, R.FIELD_WEIGHTS)
        assert not [c for c, kind in ix.rows.dtypes if kind.startswith("array")]
        assert sorted(ix.counts().collect()) == [("a", "body", 2), ("a", "title", 2), ("b", "body", 2)]
        assert {tuple(r) for r in ix.posts().collect()} == {("a", "title", 8, "one"), ("a", "title", 8, "two"), ("a", "body", 1, "one"), ("a", "body", 1, "two"), ("b", "body", 1, "two"), ("b", "body", 1, "x1")}
        asked = spark.createDataFrame([(1, "two"), (2, "x1"), (3, "x")], "query_id long, term string")
        assert {tuple(r)[:3] for r in I.matches(ix, I.as_terms(asked)).collect()} == {(1, "a", 9.0), (1, "b", 1.0), (2, "b", 1.0)}
        held = I.matches(ix, I.as_anchors(asked.withColumnRenamed("term", "anchor"))).collect()
        assert {(r.query_id, r.component_id, r.in_text, r.in_title) for r in held} == {(1, "a", 1, 1), (1, "b", 1, 0), (2, "b", 1, 0), (3, "b", 1, 0)}


@pytest.mark.parametrize("name", ["ret5_exact_phrase", "eva3_live_probe"])
def test_texts_stay_where_they_are(spark, tmp_path, name):
    """Two queries have few hits, which are sent to the texts; the texts of 6000 pages are in no shuffle."""
    n = 6000
    noise = F.concat_ws(" ", *(F.sha1(F.concat("id", F.lit(i))) for i in range(4)))
    text = F.when(F.col("id") % 1000 == 7, F.concat(noise, F.lit(" alphabetical order of things "), noise)).otherwise(noise)
    documents = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(300).cast("long").alias("n_chars"))
    benchmark = spark.createDataFrame([(0, "alphabetical order of things"), (1, "nowhere alphabetical")], "item_id long, text string")
    folder = folder_with(spark, tmp_path, documents=documents, benchmark=benchmark)
    before, limit = shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "64k")
    try:
        assert registry.QUERIES[name](spark, folder).count() == (6 if name.startswith("ret5") else 2)
    finally:
        spark.conf.unset(limit)
    assert shuffled(spark) - before < 1.5 * n
    same(spark, folder, name)


def test_phrases_of_any_characters(spark, tmp_path):
    """Phrases of short tokens inside words, of Han, other letters or signs alone, empty ones, and several of one query_id or of one text."""
    texts = ["a xa by cab.", "Foo 活动流程 bar baz", "大活动图 foo", "... wait! Ещё раз", "été à l'heure", None, "", "foo*bar `x`", "no 活", "1 2 3 | 4", "Foo 活动流程 bar baz"]
    documents = spark.createDataFrame([(i % 10, t, "en", f"src{i % 3}", 9) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    asked = ["a", "a b", "xa by", "b", "活动", "活", "活动流程 bar", "foo 活动流程 bar baz", "...", "ещё", "ещё раз", "é", "", "***", "!", "2 3 4", "foo bar x", "ab", "1", "wait! ещё раз", "foo 活动 bar baz", None]
    benchmark = spark.createDataFrame([*enumerate(asked), (0, "baz"), (1, "a"), (1, "a"), (3, "cab x y z")], "item_id long, text string")
    same(spark, folder_with(spark, tmp_path, documents=documents, benchmark=benchmark), "ret5_exact_phrase")


def test_phrases_of_pages_without_id(spark, tmp_path):
    pages = spark.createDataFrame([(None, "some foo bar here"), ("p", "foo bar"), (None, "nothing")], "component_id string, body string")
    I.write_index(pages, {"body": F.col("body")}, R.FIELD_WEIGHTS, str(tmp_path / "ix"), han=False)
    ix = I.read_index(spark, str(tmp_path / "ix"), {"body": F.col("body")}, R.FIELD_WEIGHTS)
    asked = spark.createDataFrame([(1, "foo bar"), (None, "foo"), (3, "…")], "query_id long, query string")
    got = sorted((tuple(r) for r in R.phrases_stored(ix, pages.withColumnRenamed("body", "text"), asked).collect()), key=repr)
    assert got == sorted([(1, None), (1, "p"), (None, None), (None, "p")], key=repr)


@pytest.mark.parametrize("name", ["ret14_conditional_hybrid", "ret23_compare_rankings"])
def test_vectors_of_whole_texts(spark, tmp_path, name):
    """What a query asks for stands behind the first 2000 characters of a page; other pages are short, empty or null."""
    asked = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    far = [(100_000 + r.item_id, "lorem " * 700 + r.text, "en", "src1", 9) for r in asked.collect()]
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 9 == 1, None).when(F.col("doc_id") % 9 == 2, "").otherwise(F.col("text")).alias("text"), "lang", "source", "n_chars")
    folder = folder_with(spark, tmp_path, documents=documents.union(spark.createDataFrame(far, documents.schema)))
    same(spark, folder, name)
    if name.startswith("ret23"):
        hits = {r.method: r.hits for r in registry.QUERIES[name](spark, folder).collect()}
        cut = connect(folder).sql(registry.ORACLES[name].replace("chr(10) || body)", "chr(10) || substr(body, 1, 2000))")).df()
        assert hits["dense"] > dict(zip(cut.method, cut.hits))["dense"]


def test_anchors_inside_words():
    """Anchors shorter than, of and beyond eight bytes, in words of one and of three bytes a character, against plain loops."""
    r = random.Random(3)
    for alphabet in ("ab", "abc1", "a活动b", "活"):
        some = lambda most, n: list(dict.fromkeys("".join(r.choice(alphabet) for _ in range(r.randint(1, most))) for _ in range(n)))
        words, anchors = some(30, 80), some(12, 30)
        word, anchor = I._inside(words, anchors)
        assert list(zip(word, anchor)) == [(w, a) for w, x in enumerate(words) for a, y in enumerate(anchors) if y in x]
    assert not len(I._inside(words, [])[0])


def test_vectors_of_equal_and_empty_rows(spark):
    """Rows of one key add up, signs of one place cancel, rows without tokens have no vector; tokens are not shuffled one by one."""
    rows = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, ""), (3, None), (4, " ".join(f"w{i}" for i in range(5000)))], "id long, text string").repartition(4)
    before = shuffled(spark)
    got = {(r.id, r.idx): r.value for r in R.hashed_vectors(rows, "id", F.col("text"), han=False).collect()}
    assert shuffled(spark) - before < 20
    want = {}
    for key, text in ((1, "a b"), (1, "b c"), (4, " ".join(f"w{i}" for i in range(5000)))):
        for t in text.split():
            d = hashlib.sha1(t.encode()).digest()
            place = (key, (d[0] * 256 + d[1]) % 64)
            want[place] = want.get(place, 0) + (1 if d[2] % 2 else -1)
    for key in (1, 4):
        norm = math.sqrt(sum(x * x for (k, _), x in want.items() if k == key))
        want |= {p: x / norm for p, x in want.items() if p[0] == key}
    assert got == {p: x for p, x in want.items() if x}


def test_vectors_of_a_large_group_are_sent_eight_times(spark):
    n = 10_000
    rows = spark.range(n).select("id", F.lit(1).alias("g"), F.array(F.cos("id"), F.sin("id")).alias("v"))
    before = shuffled(spark)
    got = {r.id: r.match for r in R.best_earlier(rows, "g", "id", "v").collect()}
    assert shuffled(spark) - before < 15 * n
    assert len(got) == n - 1
    v = np.array([(math.cos(i), math.sin(i)) for i in range(n)])
    for i in (1, 2, 77, 5000, n - 1):
        keys = np.floor(v[:i] @ v[i] * 1e9 + 0.5)
        assert keys[got[i]] >= keys.max() - 1


def test_profiles_are_dealt_once(spark):
    """A profile is one row of one shuffle, and not a row for each of its values in several; the number of tasks follows the profiles."""
    n = 600
    rows = spark.range(n).select(F.col("id").cast("string").alias("project_id"), F.lit(0).alias("level"), F.lit(publishing.DEFAULTS).alias("config"))
    before = shuffled(spark)
    got = P.nested(P.merge_profiles(rows, publishing.FIELDS), deepest=2).collect()
    assert shuffled(spark) - before < 2 * n
    assert len(got) == n and len({r.config for r in got}) == 1
    assert P.leaves(rows.limit(0)).count() == 0
    odd = spark.createDataFrame([("p", 0, c) for c in ('{"a":{},"b":[{"c":1}],"d":{"e":null}}', "[1]", "no", "{}", '{"x.y":1}')], "project_id string, level int, config string")
    assert sorted((r.path, r.value) for r in P.leaves(odd).collect()) == [("b", '[{"c":1}]'), ("d.e", "null"), ("x.y", "1")]
