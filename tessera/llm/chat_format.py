"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A logged conversation is often stored again after each turn. Rolling hashes over the turns
tell which conversations are prefixes of longer ones; anti-joins leave the maximal ones.

Defined results: turns are ordered by (turn, role, text), nulls first, and equal turn rows of
a conversation count each; a null role or text is rendered as empty but differs from an empty
one; a null conv_id is one conversation of its own. Of equal conversations the smallest
conv_id stays. Texts of any length are taken whole; an empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _turn_hash(salt: int) -> Column:
    """64 bits of one turn at its place, as a decimal that sums of any length fit in."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(str(salt)), F.col("place").cast("string"), F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, h1, h2): h1 and h2 are rolling sums of place-bound turn
    hashes, so equal values at equal places mean equal turns up to there."""
    turns = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rolling = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("place", F.row_number().over(by_turn))
    hashed = placed.select("conv_id", "turn", "place", "role", "text", _turn_hash(1).alias("t1"), _turn_hash(2).alias("t2"))
    return hashed.select("conv_id", "place", "role", "text", F.sum("t1").over(rolling).alias("h1"), F.sum("t2").over(rolling).alias("h2"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no longer one starts with."""
    rolled = prefix_hashes(conversations).drop("role", "text")
    ends = rolled.groupBy("conv_id").agg(F.max_by(F.struct("place", "h1", "h2"), "place").alias("end"))
    ends = ends.select("conv_id", "end.*")
    # a conversation's own end is no prefix of a longer one: only inner places count
    last = Window.partitionBy("conv_id").orderBy("place")
    inner = rolled.withColumn("next", F.lead("place").over(last)).where("next IS NOT NULL").select("place", "h1", "h2").distinct()
    alike = ends.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    left = alike.join(inner, ["place", "h1", "h2"], "left_anti")
    return left.select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations rendered in ChatML: (conv_id, n_turns, n_copies, text)."""
    maximal = maximal_conversations(conversations)
    turns = conversations.select(
        F.col("conv_id").alias("id"),
        F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"),
    )
    rendered = F.concat(F.lit("<|im_start|>"), F.coalesce(F.col("t.role"), F.lit("")), F.lit("\n"), F.coalesce(F.col("t.text"), F.lit("")), F.lit("<|im_end|>\n"))
    joined = turns.join(maximal, F.col("id").eqNullSafe(F.col("conv_id"))).select("conv_id", "n_turns", "n_copies", F.struct("t.turn", "t.role", "t.text", rendered.alias("line")).alias("t"))
    return joined.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["line"]), "").alias("text"))


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = """
WITH logs AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id),
single AS (SELECT min(conv_id) AS conv_id, turns, count(*) AS n_copies FROM logs GROUP BY turns),
inner_prefixes AS (
  SELECT DISTINCT turns[1:n] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS n FROM logs))
SELECT conv_id, len(turns) AS n_turns, n_copies,
       list_aggregate(list_transform(turns, lambda x: '<|im_start|>' || coalesce(x.r, '') || chr(10) || coalesce(x.t, '') || '<|im_end|>' || chr(10)), 'string_agg', '') AS text
FROM single ANTI JOIN inner_prefixes USING (turns)
"""
