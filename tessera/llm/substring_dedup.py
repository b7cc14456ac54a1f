"""Substring dedup of words in a compacted de Bruijn graph.

A window of ``length`` words is an edge between its first and its last ``length - 1`` words. Super-
windows (see :mod:`tessera.llm.repeats`) are paths of edges: where every document holds the same path
around a minimizer, the path is nonbranching and stays compact through the joins by minimizer
and by chunk. Paths that meet others around their minimizer are expanded into edges in one task;
the words at the edges' source coordinates decide whether edges are one, and chains of shared
edges with the same first document are compacted again into spans, which are joined back to
their sources.

Defined results: a null or empty text has no words; equal doc_ids are one document; a null
doc_id is smallest; kept words are joined by one space; texts of any length are taken whole; an empty table
gives no rows; extra columns play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.repeats import Unit, remove_repeats
from tessera.llm.textarrays import fresh_key, window_hashes


def shared_edges(unit: Unit, values: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window of each content, one after the other, the smallest document that holds an
    equal window in any of the contents."""
    windows = sizes - unit.length + 1
    ends = np.cumsum(sizes)
    starts = np.repeat(ends - sizes - np.r_[0, np.cumsum(windows)[:-1]], windows) + np.arange(windows.sum())
    result = np.repeat(least, windows)
    edges = window_hashes(values, unit.length)[starts]
    order = np.lexsort((result, edges))
    new = np.r_[True, edges[order][1:] != edges[order][:-1]]
    # the words at the coordinates of neighbours decide whether their edges are one
    near = np.flatnonzero(~new)
    differ = np.zeros(len(near), bool)
    for k in range(unit.length):
        differ |= values[starts[order[near]] + k] != values[starts[order[near - 1]] + k]
    new[near[differ]] = True
    groups = np.flatnonzero(new)
    smallest = np.minimum.reduceat(result[order], groups)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(smallest, np.diff(np.r_[groups, len(order)]))
    return out


def dedup_words(docs: DataFrame, length: int = 13) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept): kept holds the remaining words."""
    return remove_repeats(docs, Unit("words", length, max(1, length // 3), key=fresh_key()), shared_edges)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k
  FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM split WHERE len(w) >= 13)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING count(DISTINCT doc_id) > 1),
gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM (
    SELECT doc_id, i, unnest(range(0, 13)) AS j FROM windows JOIN firsts USING (k) WHERE doc_id > first)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
judged AS (SELECT words.*, g.i IS NOT NULL AS gone FROM words LEFT JOIN gone g USING (doc_id, i)),
kept AS (
  SELECT doc_id, sum(gone::INT) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""
