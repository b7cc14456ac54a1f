"""Sinks: content-addressed blobs, release bundles, logs by day, hashes."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import redact


def write_blobs(contents: DataFrame, path: str) -> None:
    """(content) by its hash, sharded by the first two digits; blobs that are there stay."""
    spark = contents.sparkSession
    rows = contents.select(F.sha2("content", 256).alias("hash"), "content").dropDuplicates(["hash"])
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        rows = rows.join(spark.read.parquet(path).select("hash"), "hash", "left_anti")
    rows.withColumn("shard", F.substring("hash", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def export_release(assets: dict[str, DataFrame], path: str, release_id: str) -> None:
    """Each asset of a release under its own folder; a release that is there is an error."""
    for name, df in assets.items():
        df.write.mode("error").parquet(f"{path}/{name}/release_id={release_id}")


def write_log(rows: DataFrame, path: str, ts: str = "created_at") -> None:
    """JSON lines in a folder for each day."""
    rows.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def write_diagnostics(rows: DataFrame, path: str, payloads: list[str], level: str = "info", ts: str = "created_at") -> None:
    """Diagnostic rows of at least ``level`` by day as JSON lines, secrets in the JSON columns ``payloads`` redacted."""
    order = F.array(*map(F.lit, ("debug", "info", "warn", "error")))
    kept = rows.where(F.array_position(order, F.col("level")) >= F.array_position(order, F.lit(level)))
    write_log(kept.withColumns({c: redact(F.col(c)) for c in payloads}), path, ts)


def expire_days(spark: SparkSession, path: str, today: str, days: int) -> list[str]:
    """Remove the folders of days more than ``days`` before ``today``; what is no day stays, and nothing goes without a positive number. Returns the days."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if days <= 0 or not fs.exists(folder):
        return []
    cutoff, gone = dt.date.fromisoformat(today) - dt.timedelta(days=days), []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if re.fullmatch(r"day=\d{4}-\d{2}-\d{2}", name) and dt.date.fromisoformat(name[4:]) < cutoff:
            fs.delete(status.getPath(), True)
            gone.append(name[4:])
    return sorted(gone)


def bundle_hash(files: DataFrame) -> DataFrame:
    """One hash over all files (path, hash) in the order of their paths."""
    line = F.concat("path", F.lit("\0"), "hash", F.lit("\0"))
    return files.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", line.alias("l")))), lambda x: x["l"]), ""), 256).alias("bundle_hash"))


def tree_hash(files: DataFrame) -> DataFrame:
    """(path, hash) of every folder of a release, the root as the empty path. A folder's hash is that of its shards, a shard's that of its entries (name and
    hash, in the order of names) whose names' hashes begin alike; so what one task takes together is a 256th of a folder. ``files``: (path, hash)."""
    rows = files.select(F.split("path", "/").alias("steps"), "hash")
    deepest, out = rows.agg(F.max(F.size("steps"))).first()[0] or 0, None
    for depth in range(deepest, 0, -1):
        own = rows.where(F.size("steps") == depth).select(F.slice("steps", 1, depth - 1).alias("steps"), F.element_at("steps", depth).alias("name"), "hash")
        entry = F.struct("name", F.concat("name", F.lit("\0"), "hash", F.lit("\0")).alias("line"))
        joined = lambda entries: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(entries)), lambda x: x["line"]), ""), 256)
        shards = own.groupBy("steps", F.substring(F.sha2("name", 256), 1, 2).alias("name")).agg(joined(entry).alias("hash"))
        folders = shards.groupBy("steps").agg(joined(entry).alias("hash"))
        out = folders if out is None else out.unionByName(folders)
        rows = rows.where(F.size("steps") < depth).unionByName(folders)
    if out is None:
        return files.limit(0).select("path", "hash")
    return out.select(F.array_join("steps", "/").alias("path"), "hash")


def manifest_hash(manifest: dict) -> str:
    """A hash that does not depend on the order of keys."""
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
