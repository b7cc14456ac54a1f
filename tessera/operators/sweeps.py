"""A job over all projects at regular times: never twice at once, and an error of one project is its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.releases import Conflict, claim


def sweep(projects: DataFrame, job: Callable[[DataFrame], None], folder: str, period: int) -> DataFrame | None:
    """(project_id, outcome, error) of ``job`` run for all projects (project_id) at once; None where somebody has claimed the ``period`` already.

    One run serves all projects. Only if it fails is the set cut in two by a hash, and each half tried alone, so the projects with an error are
    found in some log2(n) runs each, and all others are done. A job must bear being run again for a project that it was through with."""
    spark = projects.sparkSession
    try:
        claim(spark, f"{folder}/period-{period:012d}.json")
    except Conflict:
        return None
    outcomes, left = [], [(0, 0)]
    ids = projects.select("project_id").distinct()
    hashed = F.pmod(F.xxhash64("project_id"), F.lit(1 << 20))
    while left:
        depth, part = left.pop()
        own = ids.where(F.pmod(hashed, F.lit(1 << depth)) == part)
        if own.isEmpty():
            continue
        try:
            job(own)
            outcomes.append(own.select("project_id", F.lit("done").alias("outcome"), F.lit(None).cast("string").alias("error")))
        except Exception as e:  # noqa: BLE001  the error stays with the projects that cause it
            if depth < 20 and own.limit(2).count() > 1:
                left += [(depth + 1, part), (depth + 1, part + (1 << depth))]
            else:
                outcomes.append(own.select("project_id", F.lit("failed").alias("outcome"), F.lit(str(e).split("\n")[0][:200]).alias("error")))
    out = spark.createDataFrame([], "project_id string, outcome string, error string").withColumn("project_id", F.col("project_id").cast(ids.schema["project_id"].dataType))
    for more in outcomes:
        out = out.unionByName(more)
    return out
