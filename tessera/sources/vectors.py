"""Stored dense vectors, and the exact best inner products of many queries with them.

Vectors are kept in groups in the order of falling norms, each with its largest norm. A query first meets the group of the largest norms;
its k-th best product there is a floor, and by the inequality of Cauchy and Schwarz a group whose largest norm times the query's own is
below the floor cannot add anything, nor can any group after it. Groups of queries meet groups of vectors as matrices, and only the k
best of a query and group are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import stored

#: Vectors of a group, and queries of a group.
GROUP, QUERIES = 1 << 14, 1 << 12
FOUND = pa.schema([("query_id", pa.int64()), ("component_id", pa.string()), ("score", pa.float64())])


def write_vectors(vectors: DataFrame, path: str, group: int = GROUP) -> None:
    """Write (component_id, vector) below ``path``: rows without a null or a non-finite number, in groups of about ``group`` by falling norm."""
    plain = F.transform("vector", lambda x: x.cast("double"))
    fine = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col("vector").isNotNull() & fine).select(F.col("component_id").cast("string").alias("component_id"), plain.alias("vector"))
    # counted, sampled for ranges and dealt: made once
    rows = stored(rows.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))), "normed")
    n = rows.count()
    # neighbours in a range partition have neighbouring norms; a partition is a group
    rows.repartitionByRange(max(1, -(-n // group)), F.col("norm").desc(), "component_id").withColumn("grp", F.spark_partition_id()).write.parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    spark.read.parquet(f"{path}/vectors").groupBy("grp").agg(F.max("norm").alias("most"), F.count("*").alias("n")).write.parquet(f"{path}/groups")


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table[column].combine_chunks()
    flat = flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _best(k: int):
    """The ``k`` best products of each query of a group with a group of vectors, as whole billionths; ties to smaller ids."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        right = right.sort_by("component_id")
        queries, vectors = _matrix(left, "q"), _matrix(right, "vector")
        ids, asked, out = right["component_id"].to_numpy(zero_copy_only=False), left["query_id"].to_numpy(), ([], [], [])
        for a in range(0, len(asked), 256):
            scores = np.floor(queries[a : a + 256] @ vectors.T * 1e9 + 0.5)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            out[0].append(np.repeat(asked[a : a + 256], order.shape[1]))
            out[1].append(ids[order.ravel()])
            out[2].append(np.take_along_axis(scores, order, 1).ravel() / 1e9)
        return pa.Table.from_arrays([pa.array(np.concatenate(out[0]), pa.int64()), pa.array(np.concatenate(out[1]), pa.string()), pa.array(np.concatenate(out[2]))], schema=FOUND)

    return run


def nearest(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, component_id, score, rank): the ``k`` best of each query (query_id, vector), ties by component_id."""
    vectors, groups = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/groups")
    q = F.transform("vector", lambda x: x.cast("double"))
    asked = queries.where("vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), q.alias("q"))
    asked = asked.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)))
    dealt = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("qg", F.pmod(F.xxhash64("query_id"), F.lit(dealt)))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "component_id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def met(pairs: DataFrame) -> DataFrame:
        """``pairs``: queries with the group they meet."""
        wanted = pairs.select("grp", "qg").distinct()
        own = vectors.join(wanted, "grp").select("grp", "qg", "component_id", "vector")
        asking = pairs.select(F.col("grp").alias("with_grp"), F.col("qg").alias("of_qg"), "query_id", "q")
        return asking.groupBy("with_grp", "of_qg").cogroup(own.groupBy("grp", "qg")).applyInArrow(_best(k), "query_id long, component_id string, score double")

    # one row: a norm for each group of vectors
    bounds = groups.agg(F.sort_array(F.collect_list(F.struct((-F.col("most")).alias("m"), "grp", "n"))).alias("bounds"))
    with_bounds = asked.join(F.broadcast(bounds), F.lit(True))
    early = best(met(with_bounds.withColumn("grp", F.col("bounds")[0]["grp"]).where("grp IS NOT NULL")))
    floors = early.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("least"))
    floor = F.when(F.col("found") >= k, F.col("least"))
    later = with_bounds.join(floors, "query_id", "left").withColumn("floor", floor)
    # products are rounded to billionths, so a bound counts from a billionth below
    open_ = F.filter(F.slice("bounds", 2, 1 << 30), lambda b: F.col("floor").isNull() | (-b["m"] * F.col("norm") + 2e-9 >= F.col("floor")))
    rest = later.select("query_id", "q", "qg", F.explode(open_).alias("b")).select("query_id", "q", "qg", F.col("b.grp").alias("grp"))
    return best(early.drop("rank").unionByName(met(rest)))
