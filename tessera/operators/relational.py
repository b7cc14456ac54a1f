"""Filters, joins, aggregates, windows and set operators with the governed semantics."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


# filters ---------------------------------------------------------------------------------------
def exact_match(df: DataFrame, filters: dict) -> DataFrame:
    """Rows whose cells equal all filters as text; a missing cell or column counts as empty."""
    cell = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("")) if k in df.columns else F.lit("")
    return df.where(reduce(lambda a, b: a & b, (cell(k) == str(v) for k, v in filters.items()), F.lit(True)))


def all_of(df: DataFrame, conditions: list[Column | None]) -> DataFrame:
    """The conditions that are given, all of them."""
    for c in conditions:
        df = df.where(c) if c is not None else df
    return df


def any_contains(columns: list[str], text: str) -> Column:
    """Case-insensitive substring in any of the columns."""
    return reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{text}%") for c in columns))


def within_days(ts: Column, now: Column, days: int) -> Column:
    return ts >= now - F.expr(f"INTERVAL {days} DAYS")


def bounded_limit(value, default: int, most: int) -> int:
    """A limit from outside: anything that is no positive number gives the default."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        return default
    return default if n <= 0 else min(n, most)


def bounded(value: Column, default: int, most: int) -> Column:
    """The same for a column of limits given as text."""
    n = F.trim(value).try_cast("long")
    return F.when(n > 0, F.least(n, F.lit(most).cast("long"))).otherwise(F.lit(default).cast("long"))


def sampled_groups(df: DataFrame, keys: list[str], value: str, n: int = 20) -> DataFrame:
    """(keys, count, sample, truncated): like :func:`sample_array` of each group, of which no more than the first
    ``n`` values are ever collected."""
    counts = df.groupBy(*keys).agg(F.count(value).cast("int").alias("count"))
    few = first_n(df.where(F.col(value).isNotNull()).select(*keys, value), keys, [F.col(value)], n).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("sample"))
    return counts.join(few, keys, "left").select(*keys, "count", "sample", (F.col("count") > n).alias("truncated"))


def sample_array(values: Column, n: int = 20) -> Column:
    """An array as its count, its first ``n`` and whether that cuts it."""
    return F.struct(F.size(values).alias("count"), F.slice(values, 1, n).alias("sample"), (F.size(values) > n).alias("truncated"))


#: Keys whose values are never shown, besides every key that holds "apikey".
SENSITIVE = {"apikey", "api_key", "authorization", "password", "token", "jwttoken", "secret"}


def _redacted(value):
    if isinstance(value, list):
        return [_redacted(v) for v in value]
    if isinstance(value, dict):
        return {k: "[REDACTED]" if k.lower() in SENSITIVE or "apikey" in k.lower() else _redacted(v) for k, v in value.items()}
    return value


@F.pandas_udf(StringType())
def redact(json_text: pd.Series) -> pd.Series:
    """JSON text with the values of sensitive keys replaced, at any depth; other text as it is."""

    def one(text):
        try:
            return text if text is None else json.dumps(_redacted(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return text

    return json_text.map(one)


def path_matches(path: Column, only: Column) -> Column:
    """A path equals ``only``, is it below ``processed/parsed/``, or has it as file name or last part."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return (path == only) | (F.concat(F.lit("processed/parsed/"), path) == only) | (base == only) | F.endswith(path, F.concat(F.lit("/"), only))


# joins -----------------------------------------------------------------------------------------
def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def full_diff(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, change) between two versions: added, removed, modified or unchanged."""
    a = old.select(key, F.col(fingerprint).alias("before"))
    b = new.select(key, F.col(fingerprint).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


#: The roots that a source lies under, and in which forms: as its own file, or as the page made of it.
ROOTS = {"": ("file", "page"), "gamedocs/": ("file", "page"), "processed/parsed/": ("page",)}


def path_spellings(path: Column) -> Column:
    """The ways one source path is written: as it is given, and below each root in each form that the root has."""
    given = F.ltrim(F.translate(path, "\\", "/"), F.lit("/"))
    file = F.regexp_replace(given, r"^(?:processed/parsed/)?(?:gamedocs/)?", "")
    form = {"file": file, "page": F.regexp_replace(file, r"\.[^.]+$", ".md")}
    below = [F.concat(F.lit(root), form[f]) for root, forms in ROOTS.items() for f in forms]
    inner = F.regexp_replace(given, "^processed/parsed/", "")
    return F.array_distinct(F.filter(F.array(given, inner, *below), lambda x: x != ""))


def equivalent_paths(left: DataFrame, right: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """Pairs of rows whose paths share a spelling."""
    a = left.withColumn("_p", F.explode(path_spellings(F.col(left_path))))
    b = right.withColumn("_p", F.explode(path_spellings(F.col(right_path))))
    return a.join(b, "_p").drop("_p").distinct()


# aggregates ------------------------------------------------------------------------------------
def count_by(df: DataFrame, key: str) -> DataFrame:
    """Counts by a key; an empty or missing key is ``unknown``."""
    return df.groupBy(F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("unknown")).alias(key)).agg(F.count("*").alias("n"))


def ratio(num: Column, den: Column, empty: float) -> Column:
    return F.when(den == 0, F.lit(empty)).otherwise(num / den)


def with_share(df: DataFrame, count: str = "n") -> DataFrame:
    """Counts with their share of the total, one decimal of a percent. The total is an aggregate of
    the counts, joined back as one row."""
    total = df.agg(F.sum(count).alias("_total"))
    return df.join(F.broadcast(total), F.lit(True)).select(*df.columns, (F.floor(F.col(count) * 1000.0 / F.col("_total") + 0.5) / 10).alias("pct"))


# windows ---------------------------------------------------------------------------------------
def repeat_number(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The running number of each row among its repeats."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("repeat", F.count("*").over(w))


def dedup_suffix(df: DataFrame, name: str, order: list[str], joiner: str = "-") -> DataFrame:
    """Equal names in order get -2, -3 and so on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn(name, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(joiner), n)))


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


# sets and changes ------------------------------------------------------------------------------
def buckets(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys as added, removed or unchanged."""
    mark = lambda df, side: df.select(key).distinct().withColumn(side, F.lit(True))
    both = mark(old, "_old").join(mark(new, "_new"), key, "full_outer")
    return both.select(key, F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("unchanged").alias("bucket"))


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert that does nothing on conflict."""
    return existing.unionByName(rows.join(existing, keys, "left_anti"))


def upsert(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert that replaces on conflict."""
    return existing.join(rows, keys, "left_anti").unionByName(rows)


def delete_cascade(children: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return children.join(gone.select(*keys), keys, "left_anti")
