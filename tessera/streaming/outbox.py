"""An outbox with a ledger of what was delivered, and routes that fail on their own.

Events are appended to a folder; a stream reads them in the order of their files. A batch is handled, then entered into the ledger under
its number. Spark runs a batch again if it ended before its offsets were committed: a batch whose number is in the ledger is
passed over, and one that is not is handled again with the events that no other batch has delivered. So every event
is in the ledger once, whenever a run is killed.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Handler = Callable[[DataFrame, int], None]
LEDGER = "event_id long, created_at timestamp, batch long"


def _done(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of folders batch=n, or an empty one."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def append_events(events: DataFrame, folder: str, subscribers: list[Callable[[DataFrame], None]] = ()) -> list[str]:
    """Append events (event_id, event_type, payload, created_at) to the outbox, then tell the subscribers. An error of one stays with
    it: what was appended stays, and the others are told. Returns the errors."""
    events.write.mode("append").parquet(folder)
    errors = []
    for tell in subscribers:
        try:
            tell(events)
        except Exception as e:  # noqa: BLE001  an error of a subscriber is not the writer's
            errors.append(str(e))
    return errors


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, created_at, batch) of every delivered event."""
    return _table(spark, f"{folder}/delivered", LEDGER)


def deliver_once(spark: SparkSession, stream: DataFrame, folder: str, handler: Handler) -> None:
    """Drain ``stream`` (event_id, created_at and more) through ``handler``, oldest first within a batch, and keep the
    ledger in ``folder``. How much a batch holds is the source's to say (``maxFilesPerTrigger``)."""

    def run(batch: DataFrame, number: int) -> None:
        own = f"{folder}/delivered/batch={number}"
        if _done(spark, own):
            return
        before = ledger(spark, folder).where(F.col("batch") != number).select("event_id")
        fresh = batch.dropDuplicates(["event_id"]).join(before, "event_id", "left_anti").persist()
        try:
            handler(fresh.sort("created_at", "event_id"), number)
            fresh.select("event_id", F.col("created_at").cast("timestamp").alias("created_at")).write.mode("overwrite").parquet(own)
        finally:
            fresh.unpersist()

    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()


class Route(NamedTuple):
    """Which events a route takes, and what it does with them."""

    takes: Column
    handler: Handler


def _handled(spark: SparkSession, folder: str, name: str, route: Route, rows: DataFrame, number: int) -> None:
    """A batch of one route: kept in its backlog, handled, and marked. A batch in the backlog is taken from there."""
    done, waiting = f"{folder}/through/{name}/batch={number}", f"{folder}/backlog/{name}/batch={number}"
    if _done(spark, done):
        return
    if not _done(spark, waiting):
        rows.write.mode("overwrite").parquet(waiting)
    kept = spark.read.schema(rows.schema).parquet(waiting)
    n, error = kept.count(), None
    try:
        if n:
            route.handler(kept, number)
    except Exception as e:  # noqa: BLE001  an error stays with its route
        error = f"{type(e).__name__}: {e}"[:500]
    state = spark.createDataFrame([(name, n, error)], "route string, events long, error string")
    state.write.mode("overwrite").parquet(done if error is None else f"{folder}/failed/{name}/batch={number}")


def retry_waiting(spark: SparkSession, folder: str, routes: dict[str, Route], schema) -> None:
    """Try again what waits in the backlogs, without new events."""
    for name, route in routes.items():
        for number in waiting_batches(spark, folder, name):
            _handled(spark, folder, name, route, spark.createDataFrame([], schema), number)


def route_events(spark: SparkSession, stream: DataFrame, folder: str, routes: dict[str, Route]) -> None:
    """One stream to several routes. Each route has offsets of its own: the batches it is through with. A route that fails keeps
    its events of that batch in a backlog, which is tried again with the next batch, before it; the other routes go on."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, route in routes.items():
                for earlier in waiting_batches(spark, folder, name):
                    if earlier != number:
                        _handled(spark, folder, name, route, batch.limit(0), earlier)
                _handled(spark, folder, name, route, batch.where(route.takes), number)
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()


def waiting_batches(spark: SparkSession, folder: str, route: str) -> list[int]:
    """Batches whose events a route has not handled, oldest first."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/backlog/{route}")
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []
    numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    return [n for n in numbers if not _done(spark, f"{folder}/through/{route}/batch={n}")]


def route_states(spark: SparkSession, folder: str, routes: list[str]) -> DataFrame:
    """(route, batches, events, waiting, waiting_events): what each route is through with, and what waits for it."""
    rows = None
    for name in routes:
        through = _table(spark, f"{folder}/through/{name}", "route string, events long, error string, batch long")
        failed = _table(spark, f"{folder}/failed/{name}", "route string, events long, error string, batch long")
        left = failed.join(through.select("batch"), "batch", "left_anti")
        own = through.agg(F.count("*").alias("batches"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"))
        open_ = left.agg(F.count("*").alias("waiting"), F.coalesce(F.sum("events"), F.lit(0)).alias("waiting_events"))
        one = own.crossJoin(open_).select(F.lit(name).alias("route"), "batches", "events", "waiting", "waiting_events")  # a row each
        rows = one if rows is None else rows.union(one)
    return rows

