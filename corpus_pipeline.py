"""A corpus from raw documents to packed sequences: five stages, each of one operator.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's documents. All but the last return the columns of documents.

Defined results of every stage: a null text counts as empty; texts of any length are taken whole; a
null doc_id is an id of its own, and rows that repeat are each judged, with the same outcome; an
empty table gives an empty one; further columns are passed on, whatever their names. Near-dedup
keeps the rows of the smallest doc_id of a group, so equal rows of that document all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import keep
from tessera.llm.decontaminate import contamination
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.packing import pack
from tessera.llm.simhash import near_duplicates
from tessera.llm.toxicity import fit, toxicity_scores

#: Toxicity is learnt from labels and texts, near-duplicate groups are not SQL: tested otherwise.
ORACLE_SQL = None


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_scores(docs, model, keep_columns=("text", *_others(docs)), below=0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in one; n_chars follows the text."""
    out = dedup_lines(docs, keep_columns=_others(docs), counts=False).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHash fingerprints links of two bits or fewer connect, as in op5, those with the smallest doc_id stay. Rows of one
    doc_id with unlike texts have a fingerprint each; the document goes only where none of its rows is its group's first."""
    groups = near_duplicates(docs)
    own = groups.select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first"))
    others = own.groupBy(F.col("doc_id").alias("gone")).agg(F.max("first").alias("first")).where("NOT first AND gone IS NOT NULL").select("gone")
    return docs.join(others, docs["doc_id"] == others["gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = keep(found.select(F.col("doc_id").alias("hit")).distinct(), "contaminated")
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit"]), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 1024."""
    return pack(docs, max_tokens=1024)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
