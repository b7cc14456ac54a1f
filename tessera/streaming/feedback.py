"""Structured Streaming: audit calls to feedback, escalation, rate limits, windows, an outbox."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.scratch import shared_path

#: Timestamps without a zone cannot carry a watermark.
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_trigger: int = 100) -> DataFrame:
    """Event files of a folder, as they come."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and read the result back."""
    spark = stream.sparkSession
    out, mark = shared_path(spark, label), shared_path(spark, f"{label}-checkpoint")
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def deliver(stream: DataFrame, handler: Callable[[DataFrame, int], None], label: str) -> None:
    """An outbox: each batch goes to ``handler`` once its offsets are in the checkpoint; a batch that is
    run again after a failure has the same number, so a handler can tell."""
    mark = shared_path(stream.sparkSession, f"{label}-checkpoint")
    stream.writeStream.foreachBatch(handler).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()


def escalate(feedback: DataFrame, limit: int = 3) -> DataFrame:
    """(event_id, stored_type, severity): the streaming form of the repeat rule. Keeps one counter for each
    (query, feedback_type); rows of a batch are taken in the order of time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id in rows["event_id"]:
            n += 1
            again = n >= limit
            out.append((event_id, "repeated_query" if again and key[1] == "miss" else key[1], "blocking" if again else "warning"))
        state.update((n,))
        yield pd.DataFrame(out, columns=["event_id", "stored_type", "severity"])

    grouped = feedback.groupBy("query", "feedback_type")
    return grouped.applyInPandasWithState(run, "event_id long, stored_type string, severity string", "n long", "append", GroupStateTimeout.NoTimeout)


def rate_limit(calls: DataFrame, most: int, seconds: int) -> DataFrame:
    """(event_id, allowed): at most ``most`` calls of a user in any ``seconds``; denied calls don't count, so
    each decision depends on the ones before it. Keeps the times of at most ``most`` allowed calls."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        allowed = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts in zip(rows["event_id"], rows["ts"].map(lambda t: t.timestamp()), strict=True):
            allowed = [t for t in allowed if ts - t < seconds]
            ok = len(allowed) < most
            if ok:
                allowed.append(ts)
            out.append((event_id, ok))
        state.update((allowed,))
        yield pd.DataFrame(out, columns=["event_id", "allowed"])

    return calls.groupBy("user_id").applyInPandasWithState(run, "event_id long, allowed boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, length: str, late: str) -> DataFrame:
    """An extension: counts and sums in windows, late rows up to ``late``."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """An extension: sessions of a user, closed after ``gap`` without a row."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select(F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")
