"""Suffix-array dedup of bytes, with the difference-cover algorithm.

Documents are cut at minimizers into super-windows (see :mod:`tessera.llm.repeats`); what can share a
window of ``length`` bytes comes together in one task. There the suffixes are sorted: triples at
places that are not multiples of three are named, the names are sorted by recursion until they
cover the window length, the remaining suffixes are merged in, and neighbours in the
order are compared. Equal prefixes form a group, whose smallest document keeps it.

Only contents that differ and share a minimizer are sorted; of these, windows without a partner
of equal hash are left out first, as they can have no equal neighbour.

Defined results: a null or empty text has no bytes; equal doc_ids are one document, so neither
of two such rows removes from the other; a null doc_id is smallest; extra columns play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.repeats import Unit, remove_repeats
from tessera.llm.textarrays import _BYTES, mix, powers, stable_order

HASH_BITS = 40


def _dense(key: np.ndarray, most: int) -> np.ndarray:
    """Ranks from 0 of non-negative integers up to ``most``: by counting where they are few, else by sorting."""
    if most < max(4 * len(key), 1 << 16):
        seen = np.zeros(most + 1, bool)
        seen[key] = True
        return (np.cumsum(seen) - 1)[key]
    order = stable_order(key)
    own = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.r_[False, own[1:] != own[:-1]])
    return out


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks from 1 of rows of non-negative columns, equal rows alike."""
    key = columns[0].astype(np.int64)
    most, place = int(key.max(initial=0)), len(key).bit_length()
    for c in columns[1:]:
        high = int(c.max(initial=0))
        if (most + 1).bit_length() + high.bit_length() + place > 63:
            key = _dense(key, most)
            most = int(key.max(initial=0))
        key = key * (high + 1) + c
        most = most * (high + 1) + high
    return _dense(key, most) + 1


def _below(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of ``others`` are smaller than each key; both are dense ranks."""
    times = np.bincount(others, minlength=int(max(keys.max(initial=0), others.max(initial=0))) + 1)
    return (np.cumsum(times) - times)[keys]


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """A rank for each suffix of ``s`` (values from 1): ordered as their first ``depth`` symbols
    are at least; suffixes equal that far come next to each other."""
    n = len(s)
    # symbols that occur, from 1: names of three then are small numbers
    s = _dense(s, int(s.max(initial=0))) + 1 if n else s
    t = np.r_[s, 0, 0, 0]
    if depth <= 1 or n < 3:
        return _names(s, t[1 : n + 1] if depth > 1 else s) if n else s
    sample = np.flatnonzero(np.arange(n) % 3)
    names = _names(t[sample], t[sample + 1], t[sample + 2])
    if depth > 3 and names.max() < len(names):
        one, two = sample % 3 == 1, sample % 3 == 2
        # names of places 1 mod 3, an end mark, names of places 2 mod 3
        deeper = suffix_ranks(np.r_[names[one], 0, names[two]] + 1, -(-depth // 3))
        names = np.empty(len(sample), np.int64)
        names[one], names[two] = deeper[: one.sum()], deeper[one.sum() + 1 :]
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    p0, p1, p2 = (np.arange(k, n, 3) for k in range(3))
    # one step on, places 0 and 1 mod 3 meet the sample; two steps on, places 0 and 2 do
    both = np.r_[p0, p1]
    ones = _names(t[both], rank[both + 1])
    both = np.r_[p0, p2]
    twos = _names(t[both], t[both + 1], rank[both + 2])
    b0, b1, a0, a2 = ones[: len(p0)], ones[len(p0) :], twos[: len(p0)], twos[len(p0) :]
    at = np.empty(n, np.int64)
    at[sample] = _below(names, names)
    out = np.empty(n, np.int64)
    out[p0] = _below(b0, b0) + _below(b0, b1) + _below(a0, a2)
    out[p1] = at[p1] + _below(b1, b0)
    out[p2] = at[p2] + _below(a2, a0)
    return out + 1


def _hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[starts + length] - sums[starts]) * down[starts])


def equal_prefixes(unit: Unit, data: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window of each content, one after the other, the smallest document that holds an
    equal window in any of the contents. ``least``: the smallest document of each content."""
    windows = sizes - unit.length + 1
    ends = np.cumsum(sizes)
    starts = np.repeat(ends - sizes - np.r_[0, np.cumsum(windows)[:-1]], windows) + np.arange(windows.sum())
    of = np.repeat(np.arange(len(sizes)), windows)
    result = least[of]
    hashes = _hashes(data, starts, unit.length)
    # some bits of a hash are enough to tell windows that are alone; they sort with their places as one number
    by_hash = stable_order((hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64))
    same = np.diff(hashes[by_hash] >> np.uint64(64 - HASH_BITS)) == 0
    partnered = np.zeros(len(hashes), bool)
    partnered[by_hash[np.r_[False, same] | np.r_[same, False]]] = True
    if not partnered.any():
        return result
    # runs of windows with partners, each with an end mark; windows alone have no equal neighbour
    new = np.r_[True, of[1:] != of[:-1]]
    begin = np.flatnonzero(partnered & (new | ~np.r_[False, partnered[:-1]]))
    window_of = np.flatnonzero(partnered)
    run_windows = np.diff(np.r_[np.searchsorted(window_of, begin), len(window_of)])
    run_sizes = run_windows + unit.length - 1
    stop = np.cumsum(run_sizes + 1) - 1
    inner = np.repeat(starts[begin] - np.r_[0, np.cumsum(run_sizes + 1)[:-1]], run_sizes + 1) + np.arange((run_sizes + 1).sum())
    inner = np.minimum(inner, len(data) - 1)
    solid = np.ones(len(inner), bool)
    solid[stop] = False
    text = np.zeros(len(inner), np.int64)
    text[solid] = data[inner[solid]].astype(np.int64) + 1
    ranks = suffix_ranks(text + 1, unit.length)
    begins = np.repeat(stop - run_sizes - np.r_[0, np.cumsum(run_windows)[:-1]], run_windows) + np.arange(len(window_of))
    order = stable_order(ranks[begins])
    sorted_at = begins[order]
    # neighbours are compared in full, eight bytes at a time
    wide = np.r_[data[inner], np.zeros(8, np.uint8)].astype(np.uint64)
    for step in (1, 2, 4):
        wide = wide[:-step] | (wide[step:] << np.uint64(8 * step))
    alive = np.arange(len(order) - 1)
    for k in [*range(0, unit.length - 8, 8), max(0, unit.length - 8)]:
        alive = alive[wide[sorted_at[alive] + k] == wide[sorted_at[alive + 1] + k]]
    same = np.zeros(len(order) - 1, bool)
    same[alive] = True
    groups = np.flatnonzero(np.r_[True, ~same])
    smallest = np.minimum.reduceat(result[window_of][order], groups)
    back = np.empty(len(order), np.int64)
    back[order] = np.repeat(smallest, np.diff(np.r_[groups, len(order)]))
    result = result.copy()
    result[window_of] = back
    return result


def dedup_bytes(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept): kept holds the remaining bytes of the text."""
    if length < 20:
        raise ValueError("windows of fewer than 20 bytes have no minimizers of eight bytes or more")
    return remove_repeats(docs, Unit("bytes", length, max(8, length // 2 - 1)), equal_prefixes)


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS w FROM (SELECT *, unnest(range(0, n - 49)) AS i FROM bytes WHERE n >= 50)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE doc_id > first),
runs AS (
  SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS fresh FROM hits),
numbered AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM runs),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, span, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, a AS to_ FROM spans
  UNION ALL SELECT doc_id, max(span) + 1, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT g.doc_id, string_agg(substr(x, 2 * from_ + 1, 2 * (coalesce(to_, n) - from_)), '' ORDER BY from_, span) AS x
  FROM gaps g JOIN bytes USING (doc_id) GROUP BY g.doc_id),
totals AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.x, b.x))) AS kept_sha256
FROM bytes b LEFT JOIN totals USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
