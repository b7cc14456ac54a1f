"""Queries of the release commit, the outbox ledger and the event router."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.base import query
from tessera.sources import releases as C
from tessera.sources.scratch import shared_path
from tessera.streaming import feedback as ST
from tessera.streaming import outbox as O


def _assets(t, share: str | None = None):
    orders, lines, parts = t.orders, t.lineitem, t.part
    if share:
        orders, lines = orders.where(f"o_orderkey % {share} <> 0"), lines.where(f"l_orderkey % {share} <> 0")
    return {"pages/orders": orders, "graph/lineitem": lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"), "schemas/part": parts}


class Failed(RuntimeError):
    """A writer that stops between two assets."""


def _failing(t):
    broken = t.lineitem.select(F.when(F.col("l_orderkey") > 0, F.raise_error(F.lit("writer lost"))).alias("x").cast("string"))
    return {"pages/orders": t.orders.limit(5), "graph/lineitem": broken, "schemas/part": t.part}


@query("dml5_release_commit", """WITH one AS (SELECT 'graph/lineitem' AS asset, count(*) AS rows_ FROM lineitem UNION ALL SELECT 'pages/orders', count(*) FROM orders UNION ALL SELECT 'schemas/part', count(*) FROM part),
two AS (SELECT 'graph/lineitem' AS asset, count(*) AS rows_ FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL SELECT 'pages/orders', count(*) FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 'schemas/part', count(*) FROM part)
SELECT s.step, s.what, s.release_id, CASE WHEN s.release_id = 'r1' THEN one.rows_ ELSE two.rows_ END AS n, one.asset
FROM (VALUES (1, 'published', 'r1'), (2, 'a writer failed', 'r1'), (3, 'published', 'r2'), (4, 'a second writer was refused', 'r2'), (5, 'rolled back', 'r1')) s(step, what, release_id), one JOIN two USING (asset)""")
def dml5(t):
    """What readers count after each step: a failed writer and a refused one change nothing."""
    root, spark = shared_path(t.spark, "releases"), t.spark
    seen = []

    def read(step, what):
        now = C.current(spark, root, "main")
        for name in sorted(C.read_manifest(spark, now)["assets"]):
            rows = C.read_asset(spark, root, "main", name).agg(F.count("*").alias("n"))
            seen.append(rows.select(F.lit(step).alias("step"), F.lit(what).alias("what"), F.lit(now.release_id).alias("release_id"), "n", F.lit(name).alias("asset")))

    C.publish(spark, root, "main", "r1", _assets(t))
    read(1, "published")
    try:
        C.publish(spark, root, "main", "broken", _failing(t))
    except Exception:  # noqa: BLE001  the error that the writer met on purpose
        read(2, "a writer failed")
    C.publish(spark, root, "main", "r2", _assets(t, "3"))
    read(3, "published")
    try:
        # a writer that began when r1 was current
        C._move(spark, root, "main", 1, "late", f"{root}/data/late", "r1", "publish")
    except C.Conflict:
        read(4, "a second writer was refused")
    C.rollback(spark, root, "main")
    read(5, "rolled back")
    out = seen[0]
    for more in seen[1:]:
        out = out.union(more)
    return out


@query("rel7_verify_or_rollback", """SELECT 'release.auto_rolled_back' AS event_type, 'r2' AS release_id, 'r1' AS rolled_back_to, (SELECT count(*) FROM orders) AS n
UNION ALL SELECT 'release.verified', 'r1', NULL, (SELECT count(*) FROM orders)
UNION ALL SELECT 'refused by its guard', 'other', NULL, (SELECT count(*) FROM orders)""")
def rel7(t):
    """A release whose labelled pages are hit less often than the floor gives way to its parent; one outside its package is refused."""
    root, spark, out = shared_path(t.spark, "releases"), t.spark, []
    state = lambda event: out.append(C.read_asset(spark, root, "main", "pages/orders").agg(F.count("*").alias("n")).select(F.lit(event["event_type"]).alias("event_type"), F.lit(event["release_id"]).alias("release_id"), F.lit(event["rolled_back_to"]).cast("string").alias("rolled_back_to"), "n"))
    guard = C.same_package({"pages"})
    C.publish(spark, root, "main", "r1", {"pages/orders": t.orders}, guard)
    state(C.verify_or_rollback(spark, root, "main", 0.9, 0.85))
    try:
        C.publish(spark, root, "main", "other", {"pages/orders": t.orders, "graph/part": t.part}, guard)
    except ValueError:
        state({"event_type": "refused by its guard", "release_id": "other", "rolled_back_to": None})
    C.publish(spark, root, "main", "r2", {"pages/orders": t.orders.limit(1)}, guard)
    rate = t.labels.agg((F.avg("toxic")).alias("r")).first()["r"]
    state(C.verify_or_rollback(spark, root, "main", rate, 0.85))
    return out[0].union(out[1]).union(out[2])


@query("snk2_release_bundle", """SELECT 'graph/lineitem' AS asset, count(*) AS n, false AS damaged FROM lineitem UNION ALL SELECT 'pages/orders', count(*), false FROM orders UNION ALL SELECT 'schemas/part', count(*), false FROM part""")
def snk2(t):
    """A bundle's assets as its manifest counts them, checked against their fingerprints."""
    root = shared_path(t.spark, "releases")
    pointer = C.publish(t.spark, root, "main", "r1", _assets(t))
    bad = set(C.damaged(t.spark, pointer))
    rows = [(name, said["rows"], name in bad) for name, said in C.read_manifest(t.spark, pointer)["assets"].items()]
    return t.spark.createDataFrame(rows, "asset string, n long, damaged boolean")


def _outbox(t, label: str, files: int = 6):
    """Events in an outbox of several files, some of them appended twice."""
    folder = shared_path(t.spark, label)
    events = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("created_at"), F.col("props").alias("payload"))
    O.append_events(events.repartitionByRange(files, "created_at"), folder)
    O.append_events(events.where("event_id % 10 = 0").coalesce(1), folder)
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return stream, shared_path(t.spark, f"{label}-ledger")


@query("str2_delivery_ledger", "SELECT count(*) AS events, count(DISTINCT event_id) AS different, CAST(1 AS BIGINT) AS failures, (SELECT count(*) FROM events) AS handled FROM events")
def str2_ledger(t):
    """A run that is killed in its second batch and started again: the ledger holds every event once, and so does the handler's own table."""
    stream, folder = _outbox(t, "outbox")
    state = {"calls": 0, "failures": 0}

    def handler(batch, number):
        state["calls"] += 1
        batch.select("event_id").write.mode("overwrite").parquet(f"{folder}/handled/batch={number}")
        if state["calls"] == 2:
            state["failures"] += 1
            raise Failed("killed")

    for _ in range(2):
        try:
            O.deliver_once(t.spark, stream, folder, handler)
        except Exception:  # noqa: BLE001  the first run is killed on purpose
            continue
    handled = t.spark.read.schema("event_id long, batch long").parquet(f"{folder}/handled").agg(F.count("*").alias("handled"))
    counts = O.ledger(t.spark, folder).agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("different"))
    return counts.crossJoin(handled).select("events", "different", F.lit(state["failures"]).cast("long").alias("failures"), "handled")  # one row each


@query("str1_append_and_notify", "SELECT event_type, count(*) AS appended, CASE WHEN event_type = 'error' THEN count(*) ELSE 0 END AS told FROM events GROUP BY event_type")
def str1(t):
    """Events are appended whatever their subscribers do; one that fails does not keep the next from being told."""
    folder, told = shared_path(t.spark, "appended"), shared_path(t.spark, "told")

    def fails(_):
        raise Failed("subscriber")

    events = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("created_at"), F.col("props").alias("payload"))
    O.append_events(events, folder, [fails, lambda df: df.where("event_type = 'error'").write.parquet(told)])
    appended = t.spark.read.schema(events.schema).parquet(folder).groupBy("event_type").agg(F.count("*").alias("appended"))
    heard = t.spark.read.schema(events.schema).parquet(told).groupBy("event_type").agg(F.count("*").alias("told"))
    return appended.join(heard, "event_type", "left").select("event_type", "appended", F.coalesce("told", F.lit(0)).alias("told"))


ROUTES = {"feedback": "event_type = 'view'", "release": "event_type = 'click'", "remediation": "event_type IN ('error', 'purchase')"}


@query("str9_event_router", """SELECT route, n AS events, CASE WHEN route = 'release' THEN 0 ELSE n END AS first_run, CASE WHEN route = 'release' THEN n ELSE 0 END AS waited, CAST(0 AS BIGINT) AS waiting FROM (
SELECT CASE event_type WHEN 'view' THEN 'feedback' WHEN 'click' THEN 'release' ELSE 'remediation' END AS route, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'error', 'purchase') GROUP BY ALL)""")
def str9_router(t):
    """Three routes of one stream, of which one fails throughout the first run: the others are through with everything, and its events wait
    until it works again."""
    folder, ledger_folder = shared_path(t.spark, "routed"), None
    events = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("created_at"))
    events.repartition(4, "event_id").write.parquet(f"{folder}/in")
    stream, ledger_folder = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), f"{folder}/routes"
    broken = {"release"}

    def handler(name):
        def run(rows, number):
            if name in broken:
                raise Failed(name)
            rows.write.mode("overwrite").parquet(f"{folder}/out/{name}/batch={number}")

        return run

    routes = {name: O.Route(F.expr(takes), handler(name)) for name, takes in ROUTES.items()}
    O.route_events(t.spark, stream, ledger_folder, routes)
    first = O.route_states(t.spark, ledger_folder, list(routes)).select("route", F.col("events").alias("first_run"), F.col("waiting_events").alias("waited"))
    first = t.spark.createDataFrame(first.collect(), first.schema)  # a row a route, before the second run changes it
    broken.clear()
    events.limit(0).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    O.route_events(t.spark, stream, ledger_folder, routes)
    O.retry_waiting(t.spark, ledger_folder, routes, events.schema)
    return O.route_states(t.spark, ledger_folder, list(routes)).join(first, "route").select("route", "events", "first_run", "waited", "waiting")
