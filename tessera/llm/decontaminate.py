"""Benchmark decontamination with SimHash windows.

Every window of an item's number of words that shares a shingle with an item of that size is
fingerprinted by running counts of bits (a window that shares none has similarity zero). The
fingerprints are looked up in a multi-index: of five blocks one at least differs in no more than
a fifth of ``radius`` bits, so every item within ``radius`` is found. The weighted Jaccard
similarity of the shingles then decides exactly.

Items go to the tasks in chunks of a fixed number of bytes, one pass over the documents a
chunk; nothing that grows without bound is broadcast.

Defined results: a null or empty text or item has no words and matches nothing; an item of
fewer words than a shingle is one shingle of all its words; a document shorter than an item
is one window, a document of any length is searched whole; a null doc_id comes back as null;
equal rows of documents give equal rows, equal item_ids with different texts are items of their
own, equal items are one; extra columns play no part; an empty table of either gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import flat_bytes, real_id, slices, with_ids
from tessera.llm.simhash import simhash
from tessera.llm.textarrays import fresh_key, window_hashes, words

FOUND = "doc_id long, item_id long, similarity double, start_word long, n_words long"
#: Bytes of items' texts that a pass over the documents takes along.
CHUNK_BYTES = 16 << 20
#: Windows fingerprinted at a time.
RUN = 1 << 15
FILTER_BITS = 22


class HammingIndex:
    """A multi-index of fingerprints: five blocks of 13 or 12 bits, each with a table from block value to
    the fingerprints (a bit mask) that differ from it in a fifth of ``radius`` bits at most. Of two
    fingerprints within ``radius`` one block at least does, so a lookup in every table finds all."""

    WIDTHS = (13, 13, 13, 13, 12)

    def __init__(self, fingerprints: np.ndarray, radius: int):
        self.fingerprints, self.radius = fingerprints.astype(np.uint64), radius
        self.tables = []
        for shift, width in zip(np.cumsum((0, *self.WIDTHS[:-1])).tolist(), self.WIDTHS, strict=True):
            values, low = np.arange(1 << width, dtype=np.uint64), np.uint64((1 << width) - 1)
            table = np.zeros((1 << width, -(-len(fingerprints) // 64)), np.uint64)
            for i, f in enumerate(self.fingerprints):
                near = np.bitwise_count(values ^ ((f >> np.uint64(shift)) & low)) <= radius // 5
                table[near, i // 64] |= np.uint64(1) << np.uint64(i % 64)
            self.tables.append((np.uint64(shift), low, table))

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and of the fingerprints at ``radius`` differing bits or fewer from them."""
        masks = np.zeros((len(queries), self.tables[0][2].shape[1]), np.uint64)
        for shift, low, table in self.tables:
            masks |= table[((queries >> shift) & low).astype(np.int64)]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(len(self.fingerprints)):
            at = np.flatnonzero((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1))
            at = at[np.bitwise_count(queries[at] ^ self.fingerprints[i]) <= self.radius]
            found.append((at, np.full(len(at), i)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def rolling_fingerprints(hashes: np.ndarray, inside: int) -> np.ndarray:
    """The SimHash of every run of ``inside`` shingle hashes, from running counts of their bits."""
    counts = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, out=counts[1:])
    return np.packbits((counts[inside:] - counts[:-inside]) * 2 > inside, axis=1, bitorder="little").view("<u8").ravel()


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle lists, repeats counted."""
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = np.bincount(place[: len(a)], minlength=len(values)), np.bincount(place[len(a) :], minlength=len(values))
    return float(np.minimum(ca, cb).sum() / max(1, np.maximum(ca, cb).sum()))


class Items:
    """A chunk of benchmark items, ready to be looked for."""

    def __init__(self, ids: list[int], texts: list[str], width: int, similarity: float, radius: int, key: int = 0):
        self.width, self.similarity, self.key = width, similarity, key
        data, offsets = flat_bytes(pa.array(texts, pa.string()))
        w = words(data, offsets, lower=True, key=key)
        cuts = np.searchsorted(w.doc, np.arange(len(ids) + 1))
        self.ids, self.sizes, self.shingles = [], [], []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if b > a:
                self.ids.append(ids[i])
                self.sizes.append(int(b - a))
                self.shingles.append(window_hashes(w.hash[a:b], min(width, int(b - a))))
        self.radius = radius
        self.fingerprints = np.array([simhash(s) for s in self.shingles], np.uint64)
        # by size: the items' places; their index is built in the task
        self.of_size = {n: np.flatnonzero(np.array(self.sizes) == n) for n in set(self.sizes)}
        self.hamming: dict[int, HammingIndex] = {}
        sizes = np.repeat(np.array(self.sizes, np.int64), [len(s) for s in self.shingles]) if self.ids else np.zeros(0, np.int64)
        every = np.concatenate(self.shingles) if self.ids else np.zeros(0, np.uint64)
        order = np.lexsort((sizes, every))
        every, sizes = every[order], sizes[order]
        new = np.r_[True, (every[1:] != every[:-1]) | (sizes[1:] != sizes[:-1])] if len(every) else np.zeros(0, bool)
        #: Each shingle with the sizes of the items that hold it.
        self.sorted, self.held_by = every[new], sizes[new]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[every >> np.uint64(64 - FILTER_BITS)] = True
        self.widths = sorted({min(width, n) for n in self.sizes})

    def _index(self, size: int) -> HammingIndex:
        if size not in self.hamming:
            self.hamming[size] = HammingIndex(self.fingerprints[self.of_size[size]], self.radius)
        return self.hamming[size]

    def search(self, word_hashes: np.ndarray, width: int, hits: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of one document, for items of shingle ``width``. ``hits``:
        places of shingles that some item holds. A window without one has similarity zero; every other
        window of an item's size is fingerprinted and looked up."""
        every = window_hashes(word_hashes, width)
        lo, hi = np.searchsorted(self.sorted, every[hits], "left"), np.searchsorted(self.sorted, every[hits], "right")
        place = np.repeat(hits, hi - lo)
        size_of = self.held_by[np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange(len(place))]
        for size in np.unique(size_of).tolist():
            if min(self.width, size) != width:
                continue
            n = min(size, len(word_hashes))
            inside = n - width + 1
            marks = np.zeros(len(every) + 2, np.int32)
            at = place[size_of == size]
            np.add.at(marks, np.maximum(at - inside + 1, 0), 1)
            np.add.at(marks, at + 1, -1)
            wanted = np.cumsum(marks)[: len(every) - inside + 1] > 0
            edges = np.flatnonzero(np.diff(np.r_[False, wanted, False].astype(np.int8)))
            best: dict[int, tuple[float, int]] = {}
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                for first in range(a, b, RUN):
                    last = min(first + RUN, b)
                    prints = rolling_fingerprints(every[first : last + inside - 1], inside)
                    for start, item in zip(*(x.tolist() for x in self._index(size).within(prints)), strict=True):
                        item = int(self.of_size[size][item])
                        value = weighted_similarity(every[first + start : first + start + inside], self.shingles[item])
                        if value >= self.similarity - 1e-12 and (item not in best or value > best[item][0]):
                            best[item] = (value, first + start)
            for item, (value, start) in sorted(best.items()):
                yield item, value, start, n


def _search(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text")):
            rows = []
            w = words(*flat_bytes(batch["text"]), lower=True, key=items.key)
            ids = batch["doc_id"].to_pylist()
            for width in items.widths:
                hashes = window_hashes(w.hash, width)
                hit = np.flatnonzero(items.filter[hashes >> np.uint64(64 - FILTER_BITS)])
                hit = hit[w.doc[hit] == w.doc[hit + width - 1]] if len(hit) else hit
                place = np.searchsorted(items.sorted, hashes[hit]).clip(0, max(0, len(items.sorted) - 1))
                hit = hit[items.sorted[place] == hashes[hit]] if len(hit) else hit
                for doc in np.unique(w.doc[hit]).tolist():
                    a, b = np.searchsorted(w.doc, [doc, doc + 1])
                    own = hit[np.searchsorted(hit, a) : np.searchsorted(hit, b)] - a
                    rows += [(ids[doc], items.ids[i], value, at, n) for i, value, at, n in items.search(w.hash[a:b], width, own)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): each document and benchmark item of
    which one of the document's item-sized windows is ``similarity`` alike, with the first best
    window. ``radius``: of 64 bits; at similarity 0.8 about 10 differ, with a deviation of 3."""
    texts = with_ids(docs, F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    chunks = total // CHUNK_BYTES + 1
    found, key = None, fresh_key()
    for c in range(chunks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).orderBy("item_id", "text").collect()
        part = texts.mapInArrow(_search(Items([r["item_id"] for r in rows], [r["text"] for r in rows], width, similarity, radius, key)), FOUND)
        found = part if found is None else found.union(part)
    return found.select(real_id(), "item_id", "similarity", "start_word", "n_words")


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
