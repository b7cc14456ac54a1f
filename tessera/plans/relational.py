"""Queries of filters, joins, aggregates, windows, sorts, sets and changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.rounding import half_up
from tessera.operators import relational as R
from tessera.plans import standins as S
from tessera.plans.base import query

r6 = lambda c: half_up(c, 4)


@query("src1_sql_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def src1(t):
    return t.spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :s AND o_totalprice > :p", args={"s": "F", "p": 200000}, orders=t.orders)


@query("flt1_exact_match", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND CAST(c_nationkey AS VARCHAR) = '7'")
def flt1(t):
    return R.exact_match(t.customer, {"c_mktsegment": "BUILDING", "c_nationkey": 7}).select("c_custkey", "c_name")


@query("flt2_value_lookup", "SELECT p_partkey, p_retailprice FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def flt2(t):
    name = t.part.agg(F.min("p_name").alias("p_name"))
    return t.part.join(F.broadcast(name), "p_name", "left_semi").select("p_partkey", "p_retailprice")


@query("flt3_dynamic_filters", "SELECT event_id FROM events WHERE event_type = 'purchase' AND value >= 20 AND user_id < 50")
def flt3(t):
    return R.all_of(t.events, [F.col("event_type") == "purchase", None, F.col("value") >= 20, F.col("user_id") < 50]).select("event_id")


@query("flt4_substring_any", "SELECT p_partkey FROM part WHERE p_name ILIKE '%12%' OR p_brand ILIKE '%12%' OR p_type ILIKE '%12%'")
def flt4(t):
    return t.part.where(R.any_contains(["p_name", "p_brand", "p_type"], "12")).select("p_partkey")


@query("flt5_time_window", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS GROUP BY ALL")
def flt5(t):
    return t.events.where(R.within_days(F.col("ts"), F.lit("2024-01-31").cast("timestamp_ntz"), 7)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("flt6_containment", """WITH a AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list(DISTINCT event_type) AS kinds FROM events GROUP BY ALL)
SELECT user_id, day FROM a WHERE list_contains(kinds, 'error') AND list_has_any(kinds, ['purchase', 'signup'])""")
def flt6(t):
    kinds = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_set("event_type").alias("kinds"))
    return kinds.where(F.array_contains("kinds", "error") & F.arrays_overlap("kinds", F.array(F.lit("purchase"), F.lit("signup")))).select("user_id", "day")


@query("flt7_json_path", "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def flt7(t):
    return t.events.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("flt8_in_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt8(t):
    few = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return few.join(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("flt9_prefix", "SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#00000%'")
def flt9(t):
    return t.customer.where(F.startswith("c_name", F.lit("Customer#00000"))).select("c_custkey")


@query("flt11_null_functions", """SELECT doc_id, coalesce(quality, -1) AS quality, nullif(lang, 'en') AS other_lang,
CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'unknown' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)""")
def flt11(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    verdict = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("unknown")
    return d.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.nullif("lang", F.lit("en")).alias("other_lang"), verdict.alias("verdict"))


@query("flt12_slim_projection", """WITH a AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id)
SELECT user_id, CAST(len(ids) AS INT) AS n, array_to_string(ids[1:20], ',') AS sample, len(ids) > 20 AS truncated FROM a""")
def flt12(t):
    ids = R.sampled_groups(t.events, ["user_id"], "event_id", 20)
    return ids.select("user_id", F.col("count").alias("n"), F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"), "truncated")


@query("flt13_redaction", """SELECT event_id, '{"api_key":"[REDACTED]","a":[{"Token":"[REDACTED]","user_token":1}],"k":' || json_extract_string(props, '$.k') || '}' AS payload FROM events""")
def flt13(t):
    raw = F.concat(F.lit('{"api_key": "s'), "event_id", F.lit('","a":[{"Token":{"x":[1]},"user_token":1}],"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return t.events.select("event_id", R.redact(raw).alias("payload"))


@query("flt15_only_path", f"WITH {S.PAGES_SQL} SELECT component_id FROM pages_ WHERE regexp_extract(path, '[^/]*$') = '12.md'")
def flt15(t):
    return S.pages(t).where(R.path_matches(F.col("path"), F.lit("12.md"))).select("component_id")


@query("flt16_storage_liveness", """SELECT p.p_partkey, CASE WHEN l.l_partkey IS NULL THEN 'orphan' WHEN p_size > 40 THEN 'aged' ELSE 'live' END AS state
FROM part p LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01') l ON p.p_partkey = l.l_partkey""")
def flt16(t):
    used = t.lineitem.where("l_shipdate < timestamp_ntz '1996-01-01'").select("l_partkey").distinct()
    state = F.when(F.col("l_partkey").isNull(), "orphan").when(F.col("p_size") > 40, "aged").otherwise("live")
    return t.part.join(used, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", state.alias("state"))


@query("join1_inner", "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join1(t):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@query("join2_multi_key", """WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_suppkey, n FROM a JOIN b USING (l_partkey, l_suppkey)""")
def join2(t):
    keys = ["l_partkey", "l_suppkey"]
    return t.lineitem.where("l_returnflag = 'R'").select(*keys).distinct().join(t.lineitem.groupBy(*keys).agg(F.count("*").alias("n")), keys)


@query("join3_left_count", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def join3(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("join4_composite_on", "SELECT c_custkey, count(o_orderkey) AS urgent FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000 GROUP BY ALL")
def join4(t):
    cond = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 100000)
    return t.customer.join(t.orders, cond, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("urgent"))


@query("join5_lateral_latest", """SELECT c_custkey, o.o_orderkey AS latest FROM customer c LEFT JOIN LATERAL (
SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true""")
def join5(t):
    latest = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return t.customer.select("c_custkey").join(latest, "c_custkey", "left")


@query("join6_before_after", """WITH first_error AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id, count(*) FILTER (ts < t0) AS n_before, count(*) FILTER (ts > t0) AS n_after FROM events JOIN first_error USING (user_id) GROUP BY ALL""")
def join6(t):
    first = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("at"))
    return t.events.join(first, "user_id").groupBy("user_id").agg(F.count_if(F.col("ts") < F.col("at")).alias("n_before"), F.count_if(F.col("ts") > F.col("at")).alias("n_after"))


@query("join7_unnest", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lang || ',' || source, ',')) AS word FROM documents) GROUP BY ALL")
def join7(t):
    return t.documents.select(F.explode(F.split(F.concat_ws(",", "lang", "source"), ",")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("join8_in_unnest", """WITH ids AS (SELECT unnest(list(DISTINCT l_orderkey)) AS id FROM lineitem WHERE l_quantity > 49 GROUP BY l_suppkey)
SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT id FROM ids)""")
def join8(t):
    # membership in any of the lists is membership in their union, so no list is ever built
    return t.orders.join(t.lineitem.where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("join9_containment", "SELECT n_nationkey, c_custkey FROM nation JOIN customer ON contains(c_name, CAST(n_nationkey + 100 AS VARCHAR))")
def join9(t):
    # nation has a fixed number of rows: the theta join broadcasts it
    return t.customer.join(F.broadcast(t.nation), F.contains("c_name", (F.col("n_nationkey") + 100).cast("string"))).select("n_nationkey", "c_custkey")


@query("join10_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 48)")
def join10(t):
    return t.supplier.join(t.lineitem.where("l_discount > 0.09 AND l_quantity > 48").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi").select("s_suppkey")


@query("join11_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def join11(t):
    return t.customer.join(t.orders.where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


V1 = "v1 AS (SELECT doc_id, md5(text) AS hash FROM documents WHERE doc_id % 10 <> 2)"
V2 = "v2 AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN md5(text || '!') ELSE md5(text) END AS hash FROM documents WHERE doc_id % 10 <> 0)"


def _versions(t):
    d = t.documents
    v1 = d.where("doc_id % 10 <> 2").select("doc_id", F.md5("text").alias("hash"))
    v2 = d.where("doc_id % 10 <> 0").select("doc_id", F.when(F.col("doc_id") % 10 == 1, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("hash"))
    return v1, v2


@query("join12_snapshot_diff", f"""WITH {V1}, {V2} SELECT doc_id, CASE WHEN v1.hash IS NULL THEN 'added' WHEN v2.hash IS NULL THEN 'removed' WHEN v1.hash <> v2.hash THEN 'modified' ELSE 'unchanged' END AS change
FROM v1 FULL JOIN v2 USING (doc_id)""")
def join12(t):
    return R.full_diff(*_versions(t), "doc_id", "hash")


@query("join14_node_edge", """WITH edges AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_totalprice > 300000)
SELECT x.n_name AS source, y.n_name AS target FROM edges JOIN nation x ON a = x.n_nationkey JOIN nation y ON b = y.n_nationkey""")
def join14(t):
    o = t.orders.where("o_totalprice > 300000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = o.select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).distinct()
    x, y = t.nation.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("source")), t.nation.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("target"))
    return edges.join(F.broadcast(x), "a").join(F.broadcast(y), "b").select("source", "target")


@query("join15_map_lookup", "SELECT n_name, CAST(count(*) AS BIGINT) AS suppliers, floor(avg(s_acctbal) * 10000 + 0.5) / 10000 AS avg_balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def join15(t):
    return t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("suppliers"), r6(F.avg("s_acctbal")).alias("avg_balance"))


@query("join18_path_equivalence", f"""WITH {S.PAGES_SQL}, l AS (SELECT component_id, path FROM pages_),
r AS (SELECT 'gamedocs/' || replace(path, '.md', '.docx') AS other, path AS same FROM pages_ WHERE type = 'en')
SELECT component_id, other FROM l JOIN r ON path = same""")
def join18(t):
    p = S.pages(t)
    r = p.where("type = 'en'").select(F.concat(F.lit("gamedocs/"), F.regexp_replace("path", r"\.md$", ".docx")).alias("other"))
    return R.equivalent_paths(p.select("component_id", "path"), r, "path", "other").select("component_id", "other")


@query("fn14_path_candidates", """WITH p AS (SELECT doc_id, ['gamedocs/', 'processed/parsed/', 'processed/parsed/gamedocs/', ''][doc_id % 4 + 1] AS root, source || '/' || doc_id AS stem, CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.tar.docx' END AS ext FROM documents),
s AS (SELECT doc_id, root || stem || ext AS given, CASE WHEN doc_id % 4 = 2 THEN 'gamedocs/' || stem || ext ELSE replace(root, 'processed/parsed/', '') || stem || ext END AS inner_, stem || ext AS file, stem || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.tar.md' END AS page FROM p)
SELECT doc_id, array_to_string(list_sort(list_distinct([given, inner_, file, page, 'gamedocs/' || file, 'gamedocs/' || page, 'processed/parsed/' || page])), ' ') AS spellings FROM s""")
def fn14_paths(t):
    """Paths under four roots, with slashes of either kind in front and inside."""
    n = F.col("doc_id")
    root = F.element_at(F.array(*map(F.lit, ("gamedocs/", "processed\\parsed/", "/processed/parsed/gamedocs\\", "//"))), (n % 4 + 1).cast("int"))
    path = F.concat(root, "source", F.lit("/"), "doc_id", F.when(n % 3 == 0, ".md").otherwise(".tar.docx"))
    return t.documents.select("doc_id", F.array_join(F.array_sort(R.path_spellings(path)), " ").alias("spellings"))


@query("agg1_count", "SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def agg1(t):
    return t.lineitem.where("l_shipdate >= timestamp_ntz '1998-01-01'").agg(F.count("*").alias("n"))


@query("agg2_group_count", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def agg2(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("agg3_filtered_counts", """SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_quantity > 40) AS large, count(*) FILTER (WHERE l_discount = 0) AS full_price,
floor(sum(l_extendedprice * (1 - l_discount)) * 100 + 0.5) / 100 AS revenue FROM lineitem GROUP BY ALL""")
def agg3(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 40).alias("large"), F.count_if(F.col("l_discount") == 0).alias("full_price"), half_up(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("agg4_conditional_sums", "SELECT CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 0) AS BIGINT) AS errors, CAST(coalesce(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END), 0) AS BIGINT) AS high FROM events WHERE ts >= TIMESTAMP '2024-01-30'")
def agg4(t):
    e = t.events.where("ts >= timestamp_ntz '2024-01-30'")
    return e.agg(F.coalesce(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.when(F.col("value") > 50, 1).otherwise(0)), F.lit(0)).alias("high"))


@query("agg5_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE value > 90) AS high_users FROM events GROUP BY ALL")
def agg5(t):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("value") > 90, F.col("user_id"))).alias("high_users"))


@query("agg6_sum_coalesce", "SELECT coalesce(CAST(sum(n_chars) AS BIGINT), 0) AS chars, coalesce(CAST(sum(n_chars) FILTER (WHERE lang = 'xx') AS BIGINT), 0) AS none FROM documents")
def agg6(t):
    return t.documents.agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.when(F.col("lang") == "xx", F.col("n_chars"))), F.lit(0)).alias("none"))


@query("agg7_max_times", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, strftime(max(ts) FILTER (WHERE event_type = 'error'), '%Y-%m-%d %H:%M:%S') AS last_error FROM events GROUP BY ALL")
def agg7(t):
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return t.events.groupBy("user_id").agg(fmt(F.max("ts")).alias("last"), fmt(F.max(F.when(F.col("event_type") == "error", F.col("ts")))).alias("last_error"))


@query("agg8_latest_value", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY ALL")
def agg8(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


@query("agg9_ordered_list", "SELECT user_id, array_to_string(list(event_id ORDER BY ts DESC, event_id DESC) FILTER (WHERE event_type = 'purchase'), ',') AS purchases FROM events GROUP BY ALL HAVING count(*) FILTER (WHERE event_type = 'purchase') > 0")
def agg9(t):
    rows = F.sort_array(F.collect_list(F.struct("ts", "event_id")), asc=False)
    return t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.array_join(F.transform(rows, lambda x: x["event_id"].cast("string")), ",").alias("purchases"))


@query("agg10_correlated_count", "SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AS returned FROM part")
def agg10(t):
    n = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return t.part.join(n, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("returned"))


@query("agg11_count_by", "SELECT coalesce(nullif(CASE WHEN source = 'src1' THEN '' ELSE source END, ''), 'unknown') AS source, count(*) AS n FROM documents GROUP BY ALL")
def agg11(t):
    return R.count_by(t.documents.withColumn("source", F.when(F.col("source") == "src1", "").otherwise(F.col("source"))), "source")


@query("agg12_avg_min_present", "SELECT source, floor(avg(quality) * 10000 + 0.5) / 10000 AS avg_quality, min(quality) AS min_quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def agg12(t):
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(r6(F.avg("quality")).alias("avg_quality"), F.min("quality").alias("min_quality"))


@query("agg13_ratio_defaults", "SELECT source, CASE WHEN count(quality) = 0 THEN 1.0 ELSE floor(sum(quality) / count(quality) * 10000 + 0.5) / 10000 END AS evidence_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def agg13(t):
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(r6(R.ratio(F.sum("quality"), F.count("quality"), 1.0)).alias("evidence_rate"))


@query("agg16_skip_reasons", "SELECT event_type, count(*) AS n, floor(count(*) * 1000.0 / sum(count(*)) OVER () + 0.5) / 10 AS pct FROM events GROUP BY ALL")
def agg16(t):
    return R.with_share(R.count_by(t.events, "event_type"))


@query("agg18_pivot", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY ALL")
def agg18(t):
    p = t.documents.groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count()
    return p.select("source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("en", "de", "fr", "es")))


@query("agg19_category_totals", "SELECT source, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS files, min(doc_id) AS oldest, max(doc_id) AS newest, CAST(coalesce(sum(n_chars) FILTER (lang <> 'en'), 0) AS BIGINT) AS reclaimable FROM documents GROUP BY ALL")
def agg19(t):
    return t.documents.groupBy("source").agg(F.sum("n_chars").alias("bytes"), F.count("*").alias("files"), F.min("doc_id").alias("oldest"), F.max("doc_id").alias("newest"), F.coalesce(F.sum(F.when(F.col("lang") != "en", F.col("n_chars"))), F.lit(0)).alias("reclaimable"))


@query("agg20_package_quality", """SELECT floor(avg(s) * 10000 + 0.5) / 10000 AS score, count(s) AS scored FROM (
SELECT CAST(quality AS DOUBLE) AS s FROM labels UNION ALL SELECT avg(quality) FROM labels JOIN documents USING (doc_id) GROUP BY source)""")
def agg20(t):
    packages = t.labels.join(t.documents, "doc_id").groupBy("source").agg(F.avg("quality").alias("s")).select("s")
    return t.labels.select(F.col("quality").cast("double").alias("s")).union(packages).agg(r6(F.avg("s")).alias("score"), F.count("s").alias("scored"))


@query("agg21_weight_sums", "SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS total FROM lineitem GROUP BY ALL HAVING sum(l_quantity) <> 100")
def agg21(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total")).where("total <> 100")


@query("agg22_evaluation_totals", "SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS pass, count(*) FILTER (quality = 1 AND toxic = 1) AS partial, count(*) FILTER (quality = 0) AS fail FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def agg22(t):
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "pass").when(F.col("quality") == 1, "partial").otherwise("fail")
    p = t.labels.join(t.documents, "doc_id").withColumn("status", status).groupBy("source").pivot("status", ["pass", "partial", "fail"]).count()
    return p.select("source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pass", "partial", "fail")))


@query("agg23_dashboard", """SELECT 'package' AS area, source AS key, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'component', lang, count(*) FROM documents GROUP BY ALL
UNION ALL SELECT 'review', CAST(quality AS VARCHAR), count(*) FROM labels GROUP BY ALL UNION ALL SELECT 'agent', event_type, count(*) FROM events GROUP BY ALL""")
def agg23(t):
    block = lambda df, area, key: df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(area).alias("area"), "key", "n")
    return block(t.documents, "package", "source").union(block(t.documents, "component", "lang")).union(block(t.labels, "review", "quality")).union(block(t.events, "agent", "event_type"))


@query("agg24_top_queries", "SELECT c_mktsegment || '/' || c_nationkey AS query, count(*) AS n FROM customer GROUP BY ALL ORDER BY n DESC, query LIMIT 5")
def agg24(t):
    return t.customer.groupBy(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("query")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(5)


@query("agg25_build_summary", """SELECT o_orderstatus, count(*) AS builds, CAST(sum(o_orderkey % 7 - o_orderkey % 3) AS BIGINT) AS cached FROM orders GROUP BY ALL""")
def agg25(t):
    asked, done = F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 7), F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 3)
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("builds"), F.sum(F.size(asked) - F.size(done)).alias("cached"))


@query("agg26_distinct_across", "SELECT k, count(DISTINCT id) AS ids FROM (SELECT l_suppkey AS k, l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 45) GROUP BY ALL")
def agg26(t):
    a = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("id"))
    b = t.lineitem.where("l_quantity > 45").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("id"))
    return a.union(b).groupBy("k").agg(F.count_distinct("id").alias("ids"))


@query("win1_partition_count", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS alike FROM orders")
def win1(t):
    return t.orders.select("o_orderkey", F.count("*").over(Window.partitionBy("o_custkey", "o_orderstatus")).alias("alike"))


@query("win2_distinct_on", "SELECT DISTINCT ON (o_custkey, o_orderstatus) o_custkey, o_orderstatus, o_orderkey FROM orders ORDER BY o_custkey, o_orderstatus, o_orderdate DESC, o_orderkey DESC")
def win2(t):
    return R.latest_per_key(t.orders, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("win3_latest_row", "SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def win3(t):
    return R.latest_per_key(t.events, ["event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id")


@query("win4_rank", "SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rank FROM customer")
def win4(t):
    return t.customer.select("c_nationkey", "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"))


@query("win5_dedup_suffix", "SELECT doc_id, CASE WHEN r = 1 THEN slug ELSE slug || '-' || r END AS slug FROM (SELECT doc_id, source AS slug, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)")
def win5(t):
    return R.dedup_suffix(t.documents.select("doc_id", F.col("source").alias("slug")), "slug", ["doc_id"])


@query("win6_running_repeats", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS repeat FROM events")
def win6(t):
    return R.repeat_number(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "repeat")


@query("win7_previous_time", "SELECT o_orderkey, strftime(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), '%Y-%m-%d') AS previous FROM orders")
def win7(t):
    return t.orders.select("o_orderkey", F.date_format(F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")), "yyyy-MM-dd").alias("previous"))


@query("win8_first_n", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 12")
def win8(t):
    return R.first_n(t.documents, ["source"], [F.desc("n_chars"), F.col("doc_id")], 12).select("source", "doc_id")


@query("srt1_score_title", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, substr(text, 1, 40), doc_id LIMIT 10")
def srt1(t):
    return t.documents.orderBy(F.desc("n_chars"), F.substring("text", 1, 40), "doc_id").limit(10).select("doc_id", "n_chars")


@query("srt2_score_id", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def srt2(t):
    return t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@query("srt3_custom_rank", "SELECT event_id FROM events ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, value DESC, event_id LIMIT 25")
def srt3(t):
    return t.events.orderBy(F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2), F.desc("value"), "event_id").limit(25).select("event_id")


@query("srt4_nulls_last", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 500")
def srt4(t):
    return t.documents.join(t.labels, "doc_id", "left").orderBy(F.col("quality").desc_nulls_last(), "doc_id").limit(500).select("doc_id", "quality")


@query("srt7_longest_first", "SELECT p_name FROM part ORDER BY length(p_name) DESC, p_name LIMIT 30")
def srt7(t):
    return t.part.orderBy(F.desc(F.char_length("p_name")), "p_name").limit(30).select("p_name")


@query("set1_buckets", f"WITH {V1}, {V2} SELECT doc_id, CASE WHEN v1.hash IS NULL THEN 'added' WHEN v2.hash IS NULL THEN 'removed' ELSE 'unchanged' END AS bucket FROM v1 FULL JOIN v2 USING (doc_id)")
def set1(t):
    return R.buckets(*_versions(t), "doc_id")


@query("set2_unique_sorted", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY ALL")
def set2(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(F.nullif("event_type", F.lit("")))), ",").alias("kinds"))


@query("set3_heterogeneous_union", "SELECT 'nation' AS kind, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region")
def set3(t):
    return t.nation.select(F.lit("nation").alias("kind"), F.col("n_name").alias("name")).unionByName(t.region.select(F.lit("region").alias("kind"), F.col("r_name").alias("name")))


@query("set4_edge_dedup", "SELECT DISTINCT c_nationkey AS source, s_nationkey AS target FROM customer JOIN supplier ON c_custkey % 100 = s_suppkey % 100 WHERE c_nationkey <> s_nationkey")
def set4(t):
    # either side once for each key and end, before they meet
    left = t.customer.select((F.col("c_custkey") % 100).alias("k"), F.col("c_nationkey").alias("source")).distinct()
    right = t.supplier.select((F.col("s_suppkey") % 100).alias("k"), F.col("s_nationkey").alias("target")).distinct()
    e = left.join(right, "k").select("source", "target")
    return e.where("source <> target").dropDuplicates(["source", "target"])


@query("set5_blob_dedup", "SELECT sha256(text) AS hash, min(doc_id) AS first, count(*) AS refs FROM documents GROUP BY ALL")
def set5(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first"), F.count("*").alias("refs"))


@query("set6_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000")
def set6(t):
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(t.orders.where("o_totalprice > 150000").select(F.col("o_custkey").alias("id")))


@query("set7_term_union", "SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT event_type), ['view', 'search']))), ',') AS terms FROM events GROUP BY ALL")
def set7(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("event_type"), F.array(F.lit("view"), F.lit("search")))), ",").alias("terms"))


@query("set8_alias_conflict", "SELECT DISTINCT a.p_partkey FROM part a JOIN part b ON lower(a.p_brand || a.p_type) = lower(b.p_brand || b.p_type) AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey")
def set8(t):
    key = F.lower(F.concat("p_brand", "p_type"))
    owners = t.part.groupBy(key.alias("alias"), "p_size").agg(F.count_distinct("p_partkey").alias("owners")).where("owners > 1")
    return t.part.withColumn("alias", key).join(owners, ["alias", "p_size"], "left_semi").select("p_partkey")


@query("dml1_insert_ignore", f"WITH {V1}, {V2} SELECT doc_id, hash FROM v1 UNION ALL SELECT doc_id, hash FROM v2 WHERE doc_id NOT IN (SELECT doc_id FROM v1)")
def dml1(t):
    return R.insert_new(*_versions(t), ["doc_id"])


@query("dml2_upsert", f"WITH {V1}, {V2} SELECT doc_id, hash FROM v2 UNION ALL SELECT doc_id, hash FROM v1 WHERE doc_id NOT IN (SELECT doc_id FROM v2)")
def dml2(t):
    return R.upsert(*_versions(t), ["doc_id"])


@query("dml3_update_returning", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice < 100000 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def dml3(t):
    hit = (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") < 100000)
    return t.orders.select("o_orderkey", F.when(hit, "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@query("dml7_cascade", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def dml7(t):
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.delete_cascade(t.lineitem, gone, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")
