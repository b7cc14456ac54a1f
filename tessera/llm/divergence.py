"""How far the sources of a language differ in the terms they use.

A count-min sketch of document frequencies, built in each task and merged, never underestimates.
So a term whose estimate is below the threshold cannot be kept, and is dropped before anything is
shuffled; the terms left are counted exactly. Sources are then compared by joins on the terms that both hold;
what one of them lacks comes from histograms of its counts.

Defined results: each row is a document; null text, language and source are empty strings; terms are
runs of ASCII letters and of all code points over 127, A-Z in lower case; equal rows count each; a language without
kept terms gives pairs of value 0; a language of one source gives no pairs; an empty table
gives no rows; texts of any length are read whole; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import flat_bytes, keep, slices
from tessera.llm.textarrays import LETTERS, fresh_key, lowered, mix, words

DEPTH = 4
#: Cells of a sketch row: a cell for each 256 bytes of input between these bounds, so a sketch takes 16 MB at most.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 22
#: Sketches travel in parts of this many cells.
PART = 1 << 16
#: Terms and documents, or groups and terms, that a task holds before it passes their counts on.
HELD = 1 << 19
SLICE_BYTES = 2 << 20


class Slice(NamedTuple):
    """The different terms of each document of a slice, one document after the other: hash of the term, document, times, and
    where the term stands; and the lower-cased bytes."""

    hash: np.ndarray
    doc: np.ndarray
    times: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def _slice(batch: pa.RecordBatch, key: int) -> Slice:
    data, offsets = flat_bytes(batch["text"])
    data = lowered(data)
    w = words(data, offsets, key=key, solid=LETTERS)
    cuts = np.searchsorted(w.doc, np.arange(batch.num_rows + 1)).tolist()
    found, at = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        _, first, times = np.unique(w.hash[a:b], return_index=True, return_counts=True)
        found.append(first + a)
        at.append(times)
    own = np.concatenate(found) if found else np.zeros(0, np.int64)
    return Slice(w.hash[own], w.doc[own], np.concatenate(at) if at else own, w.start[own], w.end[own], data)


def _of_lang(hashes: np.ndarray, langs: np.ndarray | int) -> np.ndarray:
    """Hashes of terms as those of a language's terms."""
    return mix(hashes ^ langs)


def _lang_hash(lang: str, key: int) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), key))


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """DEPTH places in the sketch of each hash."""
    both = np.stack([hashes, mix(hashes ^ np.uint64(0x5851F42D4C957F2D))], 1).view("<u4")
    return (both & np.uint32(cells - 1)).astype(np.int64) + np.arange(DEPTH) * cells


def _sketch(cells: int, key: int):
    """Document frequencies of a task's terms, as parts of a sketch; counters stop at 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n = np.zeros(DEPTH * cells, np.uint8), [], 0

        def add() -> None:
            at, sums = np.unique(_cells(np.concatenate(held), cells), return_counts=True)
            table[at] = np.minimum(table[at] + sums, 255).astype(np.uint8)
            held.clear()

        for batch in (part for b in batches for part in slices(b, "text", SLICE_BYTES)):
            s = _slice(batch, key)
            langs = np.array([_lang_hash(x, key) for x in batch["lang"].to_pylist()], np.uint64)
            held.append(_of_lang(s.hash, langs[s.doc]))
            n += len(s.hash)
            if n > HELD:
                add()
                n = 0
        if held:
            add()
        parts = table.reshape(-1, PART)
        for i in np.flatnonzero(parts.any(axis=1)).tolist():
            at = np.flatnonzero(parts[i])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([parts[i][at].tobytes()], pa.binary())], names=["part", "at", "n"])

    return run


def _merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part of the sketches of all tasks, added up."""
    total = np.zeros(PART, np.uint16)
    for batch in batches:
        for at, n in zip(batch["at"].to_pylist(), batch["n"].to_pylist(), strict=True):
            places = np.frombuffer(at, "<u2")
            total[places] = np.minimum(total[places] + np.frombuffer(n, np.uint8), 255)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.uint8).tobytes()], pa.binary())], names=["part", "n"])


def sketch(rows: DataFrame, cells: int, key: int) -> np.ndarray:
    """The merged sketch, DEPTH x ``cells`` bytes: bounded whatever the input."""
    parts = rows.mapInArrow(_sketch(cells, key), "part int, at binary, n binary")
    merged = parts.groupBy("part").applyInArrow(_merged, "part int, n binary")
    table = np.zeros((DEPTH * cells // PART, PART), np.uint8)
    for row in merged.toLocalIterator():
        table[row["part"]] = np.frombuffer(row["n"], np.uint8)
    return table.ravel()


class Counts(NamedTuple):
    """Counts of terms by group, and the terms."""

    group: np.ndarray
    hash: np.ndarray
    times: np.ndarray
    docs: np.ndarray
    term: pa.Array

    def summed(self) -> Counts:
        """A row for each group and hash."""
        order = np.lexsort((self.hash, self.group))
        group, hashes = self.group[order], self.hash[order]
        first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (hashes[1:] != hashes[:-1])]) if len(order) else order
        add = lambda x: np.add.reduceat(x[order], first) if len(first) else x
        return Counts(group[first], hashes[first], add(self.times), add(self.docs), self.term.take(pa.array(order[first])))


def _bytes_at(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The runs of bytes as strings."""
    sizes = end - start
    ends = np.cumsum(sizes)
    places = np.repeat(start - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(np.r_[0, ends].astype("<i4")), pa.py_buffer(data[places])])


def _counts(known, cells: int, min_docs: int, key: int):
    """(lang, source, term, n, docs) of the terms that may reach ``min_docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n = known.value, [], 0
        groups: dict[tuple[str, str], int] = {}

        def passed() -> pa.RecordBatch:
            c = Counts(*(np.concatenate(x) for x in zip(*(h[:4] for h in held), strict=True)), pa.concat_arrays([h.term for h in held])).summed()
            held.clear()
            names = [pa.array([g[i] for g in groups], pa.string()).take(pa.array(c.group)) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*names, c.term, pa.array(c.times), pa.array(c.docs)], names=["lang", "source", "term", "n", "docs"])

        for batch in (part for b in batches for part in slices(b, "text", SLICE_BYTES)):
            s = _slice(batch, key)
            pairs = list(zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True))
            group = np.array([groups.setdefault(p, len(groups)) for p in pairs], np.int64)[s.doc]
            langs = np.array([_lang_hash(lang, key) for lang, _ in pairs], np.uint64)
            possible = table[_cells(_of_lang(s.hash, langs[s.doc]), cells)].min(axis=1) >= min_docs
            own = np.flatnonzero(possible)
            # the places of terms stand for them until they are summed up
            c = Counts(group[own], s.hash[own], s.times[own], np.ones(len(own), np.int64), pa.array(own)).summed()
            at = c.term.to_numpy()
            held.append(c._replace(term=_bytes_at(s.data, s.start[at], s.end[at])))
            n += len(at)
            if n > HELD:
                yield passed()
                n = 0
        if held:
            yield passed()

    return run


def kept_terms(docs: DataFrame, min_docs: int = 30, cells: int | None = None) -> DataFrame:
    """(lang, source, term, n): how often each group holds each term that ``min_docs`` documents of the language hold."""
    spark, key = docs.sparkSession, fresh_key()
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    if cells is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << int(total // 256).bit_length()))
    known = spark.sparkContext.broadcast(sketch(rows, cells, key))
    counted = rows.mapInArrow(_counts(known, cells, min(min_docs, 255), key), "lang string, source string, term string, n long, docs long")
    exact = keep(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    enough = exact.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")
    return keep(exact.join(enough, ["lang", "term"]).select("lang", "source", "term", "n"), "kept-terms")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1000000000 (n + 5) / (total + 5 terms)), exact for counts of any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    parts = F.lit(1_000_000_000).cast("decimal(10,0)") * (wide(n) + F.lit(5).cast("decimal(1,0)"))
    whole = wide(total) + wide(terms) * F.lit(5).cast("decimal(1,0)")
    return F.lit(1) + F.call_function("div", parts, whole)


def divergence(docs: DataFrame, min_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources of the language, and the terms
    that a source uses more than its language."""
    counts = kept_terms(docs, min_docs)
    groups = keep(docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct(), "groups")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    totals = groups.join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "total", "held"])
    totals = keep(totals.withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(0)), "group-totals")
    shares = keep(counts.join(totals, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).select("lang", "source", "term", "n", "p", "zero"), "shares")

    # by term: more than the language's share
    lang_shares = terms.join(langs, "lang").select("lang", "term", share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    above = shares.join(lang_shares, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    top = above.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)

    # by pair: terms of both, then what each has alone, then what neither has
    a = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    b = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    mended = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("zb")) - F.abs(F.col("za") - F.col("pb"))
    both = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(mended).alias("mended"), F.count("*").alias("common"))
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "mended", "common"))
    others = totals.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"), F.col("held").alias("held_b"))
    pairs = totals.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), F.col("held").alias("held_a"), "v").join(others, "lang").where("a <> b")
    sizes = shares.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("times"))
    alone = sizes.join(others, "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("times") * F.abs(F.col("p") - F.col("zb"))).alias("alone"))
    alone = keep(alone, "held-alone")
    facing = alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("facing"))
    neither = (F.col("v") - F.col("held_a") - F.col("held_b") + F.coalesce("common", F.lit(0))) * F.abs(F.col("za") - F.col("zb"))
    value = F.coalesce("alone", F.lit(0)) + F.coalesce("facing", F.lit(0)) + F.coalesce("mended", F.lit(0)) + neither
    summed = pairs.join(both, ["lang", "a", "b"], "left").join(alone, ["lang", "a", "b"], "left").join(facing, ["lang", "a", "b"], "left")
    pair = summed.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.cast("long").alias("value"))
    return pair.withColumn("rank", F.row_number().over(by_value)).unionByName(top)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT i, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY g.lang, g.source),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0)::HUGEINT + 5)) // (t.total::HUGEINT + 5 * l.v::HUGEINT) AS p,
         1 + (1000000000::HUGEINT * (k.n::HUGEINT + 5)) // (l.total::HUGEINT + 5 * l.v::HUGEINT) AS q
  FROM totals t JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
