"""Which of many patterns lie in which of many texts, without comparing each with each.

A text can only hold a pattern if it holds every piece of it of three characters. Of its pieces each pattern takes the one
that the fewest texts have, texts meet patterns in an equi-join on that piece, and only then are they compared. So neither a frequent piece
nor the number of patterns times texts decides the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 3


def pieces(text: Column, size: Column | int) -> Column:
    """The different pieces of ``size`` characters of a text; a shorter text has none."""
    last = F.char_length(text) - size + 1
    each = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, size if isinstance(size, Column) else F.lit(size)))
    return F.when(last >= 1, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern): all pairs of different texts and patterns (columns ``text`` and ``pattern``) where the text holds the
    pattern. Patterns shorter than a piece are pieces of their own length. Nulls and empty patterns meet nothing."""
    wanted = patterns.select("pattern").where("pattern <> ''").distinct()
    given = texts.select("text").where("text IS NOT NULL").distinct()
    own = wanted.select("pattern", F.explode(pieces(F.col("pattern"), F.least(F.char_length("pattern"), F.lit(PIECE)))).alias("piece"))
    # texts are cut into shorter pieces only if there are patterns so short
    sizes = sorted({PIECE, *(r["n"] for r in wanted.select(F.least(F.char_length("pattern"), F.lit(PIECE)).alias("n")).distinct().collect())})
    held = given.select("text", F.explode(F.flatten(F.array(*(pieces(F.col("text"), n) for n in sizes)))).alias("piece"))
    met = held.join(own.select("piece").distinct(), "piece", "left_semi")
    counts = met.groupBy("piece").agg(F.count("*").alias("n"))
    # a pattern with a piece that no text has is in none of them
    rated = own.join(counts, "piece", "left")
    rarest = rated.groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r")).where("r.n > 0").select("pattern", "r.piece")
    return held.join(rarest, "piece").where(F.contains("text", F.col("pattern"))).select("text", "pattern")
