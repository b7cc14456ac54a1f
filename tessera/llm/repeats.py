"""Repeated spans across documents: what suffix-array and substring dedup share.

A unit is a byte or a word, a window a run of ``length`` units of one document. The smallest
hash among a window's shorter grams, its minimizer, depends on the window's content alone, so
equal windows have equal minimizers; runs of windows around one minimizer occurrence form a
super-window. Packed tables of (minimizer, content) hashes are shuffled by minimizer:

* a minimizer with one content everywhere needs no comparing: its windows repeat exactly where
  the content does, and the smallest document that holds it keeps it;
* a minimizer with several contents is open: the contents themselves are sent to a resolver
  that finds equal windows between them (by suffix sorting, or in a de Bruijn graph);
* a minimizer with very many contents (the border of a passage that many documents hold in contexts of
  their own) is crowded: its windows are dealt one by one by their own hashes, so that no task
  gets them all, and each chunk sends a window once.

Texts are stored once, as compressed chunks of documents. A chunk sends each content once,
however often it holds it, so a passage that a third of all documents share is one content a chunk.
Up to 16 chunks in a row send together, a row a bucket, and answers come back by such a group of
chunks: rows between chunks and buckets are few and long, where a row for each chunk and bucket
would be short and grow with the square of the input. Every table is rebuilt from the chunks or read from the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import flat_bytes, keep, real_id, slices, with_ids
from tessera.llm.textarrays import eight_bytes, mix, powers, rolling_min, stable_order, window_hashes, words

CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
#: Groups of chunks that are made before groups grow, and the bits of the most chunks of a group.
LEAST_GROUPS, GROUP_BITS = 64, 4
#: Units that are hashed at a time; arrays of so many numbers stay in a core's cache.
SEGMENT = 1 << 16
CHUNKS = "chunk long, ids binary, sizes binary, text binary"
SENT = "bucket long, grp long, kind int, payload binary"
ANSWER = "grp long, kind int, payload binary"
#: What a chunk sends is named by its place there, behind the chunk's number in its group.
PLACE_BITS = 28
SETTLED, OPEN, RESOLVED, CROWDED, WINDOWS = range(5)


class Unit(NamedTuple):
    """What windows are made of: their length, that of the grams a minimizer is taken from, and how many
    contents around one minimizer are resolved together; ``key`` keys the hashes of words."""

    kind: str
    length: int
    gram: int
    crowd: int = 2048
    key: int = 0


class Symbols(NamedTuple):
    """Units of a chunk: their values, offsets of documents, and bytes from and to for words."""

    values: np.ndarray
    offsets: np.ndarray
    start: np.ndarray | None = None
    end: np.ndarray | None = None


class SuperWindows(NamedTuple):
    """First window, windows, document, minimizer hash and content hash of each, in order."""

    first: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    h: np.ndarray
    g: np.ndarray


def symbols(unit: Unit, data: np.ndarray, offsets: np.ndarray) -> Symbols:
    if unit.kind == "bytes":
        return Symbols(data, offsets)
    w = words(data, offsets, key=unit.key)
    return Symbols(w.hash, np.searchsorted(w.doc, np.arange(len(offsets))), w.start, w.end)


def _gram_hashes(unit: Unit, values: np.ndarray, wide: np.ndarray | None) -> np.ndarray:
    if wide is None:
        return window_hashes(values, unit.gram)
    n = len(values) - unit.gram + 1
    out, more = wide[:n] * np.uint64(0x9FB21C651E98DF25), np.empty(n, np.uint64)
    for at in sorted({*range(8, unit.gram - 8, 8), unit.gram - 8} - {0}):
        np.multiply(wide[at : at + n], np.uint64(0xC2B2AE3D27D4EB4F + 2 * at), out=more)
        out += more
    np.right_shift(out, np.uint64(32), out=more)
    out ^= more
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


class Runs:
    """Hashes of runs of units: the difference of two prefix sums, times an inverse power. Bytes are summed as mixed
    groups of eight, so the sums are of no single symbol and alternating patterns don't cancel out."""

    def __init__(self, unit: Unit, values: np.ndarray, wide: np.ndarray | None = None):
        self.tail = 7 if unit.kind == "bytes" else 0
        n = max(0, len(values) - self.tail)
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        if self.tail:
            mixed = (eight_bytes(values) if wide is None else wide)[:n] * np.uint64(0x9FB21C651E98DF25)
            np.right_shift(mixed, np.uint64(32), out=self.sums[1:])
            mixed ^= self.sums[1:]
            mixed *= up[:n]
        else:
            mixed = values * up[:n]
        np.cumsum(mixed, out=self.sums[1:])

    def hash(self, first: np.ndarray, units: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[first + units - self.tail] - self.sums[first]) * self.down[first] + np.asarray(units).astype(np.uint64))


def super_windows(unit: Unit, s: Symbols) -> SuperWindows:
    """All super-windows; long inputs go in segments, which only cuts some in two."""
    parts = []
    for at in range(0, max(1, len(s.values) - unit.length + 1), SEGMENT):
        values = s.values[at : at + SEGMENT + unit.length - 1]
        n = len(values) - unit.length + 1
        if n <= 0:
            continue
        wide = np.ascontiguousarray(eight_bytes(values)) if unit.kind == "bytes" else None
        grams = _gram_hashes(unit, values, wide)
        low = np.uint64((1 << 22) - 1)
        place = rolling_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), unit.length - unit.gram + 1)[:n] & low
        lo, hi = np.searchsorted(s.offsets, [at, at + n], "right")
        bounds = np.r_[at, s.offsets[lo:hi], at + n]
        doc = np.repeat(np.arange(lo - 1, hi), np.diff(bounds))
        whole = np.arange(at, at + n) + unit.length <= s.offsets[doc + 1]
        change = np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])]
        edge = np.flatnonzero(change)
        stop = np.r_[edge[1:], n]
        fine = whole[edge]
        first, count = edge[fine], (stop - edge)[fine]
        content = Runs(unit, values, wide).hash(first, count + unit.length - 1)
        parts.append((first + at, count, doc[first], mix(grams[place[first].astype(np.int64)] ^ np.uint64(0x5851F42D4C957F2D)), content))
    if not parts:
        none = np.zeros(0, np.int64)
        return SuperWindows(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    return SuperWindows(*(np.concatenate(x) for x in zip(*parts, strict=True)))


class Distinct(NamedTuple):
    """Distinct (h, g) of a chunk in order: hashes, smallest document, one occurrence of each, and
    for every super-window the place of its own."""

    h: np.ndarray
    g: np.ndarray
    least: np.ndarray
    sample: np.ndarray
    place: np.ndarray


class Windows(NamedTuple):
    """Windows of crowded minimizers in a chunk: start and document of each, its place among the
    distinct ones, and of these the hashes, one start and the smallest document."""

    start: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    hash: np.ndarray
    sample: np.ndarray
    least: np.ndarray


def crowded_windows(unit: Unit, s: Symbols, w: SuperWindows, d: Distinct, at: np.ndarray, ids: np.ndarray) -> Windows:
    """The windows of all super-windows with one of the contents ``at``."""
    own = np.flatnonzero(np.isin(d.place, at))
    count = w.count[own]
    start = np.repeat(w.first[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    doc = ids[np.repeat(w.doc[own], count)]
    hashes, sample, place = np.unique(Runs(unit, s.values).hash(start, unit.length), return_index=True, return_inverse=True)
    least = np.full(len(hashes), np.iinfo(np.int64).max)
    np.minimum.at(least, place, doc)
    return Windows(start, doc, place, hashes, start[sample], least)


def order_of_pairs(h: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """An order by ``h``, then by the others; they are looked at only where ``h`` is equal."""
    order = np.argsort(h)
    equal = h[order][1:] == h[order][:-1]
    tied = np.flatnonzero(np.r_[False, equal] | np.r_[equal, False]) if len(h) else order
    own = order[tied]
    order[tied] = own[np.lexsort((*(m[own] for m in more[::-1]), h[own]))]
    return order


def distinct(w: SuperWindows, ids: np.ndarray) -> Distinct:
    order = order_of_pairs(w.h, w.g)
    h, g, doc = w.h[order], w.g[order], ids[w.doc[order]]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, np.int64)
    place = np.empty(len(h), np.int64)
    place[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(h)]))
    least = np.minimum.reduceat(doc, new) if len(new) else doc
    return Distinct(h[new], g[new], least, order[new], place)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any number types as one compressed value."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), "iufb".index(a.dtype.kind) * 16 + a.dtype.itemsize))], "<i8")
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * n, []
    for size, kind in head.reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, np.dtype(f"<{'iufb'[kind // 16]}{kind % 16}"), size, at))
        at += size * (kind % 16)
    return out


def short(hashes: np.ndarray, n: int) -> np.ndarray:
    """The lowest ``n`` bytes of each hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).ravel()


def wide(data: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = data.reshape(-1, n)
    return out.view("<u8").ravel()


def _chunks(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, press = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        for batch in (part for b in batches for part in slices(b, "text", chunk_bytes)):
            data, offsets = flat_bytes(batch["text"])
            ids = batch["doc_id"].to_numpy().astype("<i8")
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([number]), "ids": pa.array([ids.tobytes()]), "sizes": pa.array([np.diff(offsets).astype("<i8").tobytes()]), "text": pa.array([press.compress(data.tobytes())])}
            )
            number += 1

    return run


def _open_chunk(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a chunk."""
    sizes = np.frombuffer(row["sizes"], "<i8")
    text = zstandard.ZstdDecompressor().decompress(row["text"])
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(text, np.uint8), np.r_[0, np.cumsum(sizes)]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash: ordered hashes have ordered buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    if not len(values):
        return []
    edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], names=["bucket", "grp", "kind", "payload"])


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 3, kinds, strict=True)], names=["grp", "kind", "payload"])


def _codes(number: int, at: np.ndarray) -> np.ndarray:
    """Places in a chunk, behind the chunk's number in its group."""
    return (at + ((number & ((1 << GROUP_BITS) - 1)) << PLACE_BITS)).astype("<u4")


def _emit(unit: Unit, buckets: int, bits: int):
    """The distinct contents of a group's chunks by bucket of their minimizers, a row a bucket."""

    def rows_of(group: int, parts: list[tuple]) -> list[tuple]:
        h, g, least = (np.concatenate(c) for c in zip(*(p[1:] for p in parts), strict=True))
        # documents of a group are near each other, so differences are short
        low = least.min(keepdims=True)
        doc = least.view(np.uint64) - low.view(np.uint64)
        doc = doc.astype(np.min_scalar_type(doc.max()))
        # a chunk's own are in the order of their buckets: of each bucket they are a range
        each = [_bucket(p[1], buckets) for p in parts]
        numbers = np.array([p[0] & ((1 << GROUP_BITS) - 1) for p in parts], "<u4")
        bucket = np.concatenate(each)
        order = stable_order(bucket)
        bucket = bucket[order]
        h, g, doc = short(h[order], 6).reshape(-1, 6), short(g[order], 7).reshape(-1, 7), doc[order]
        runs = _runs(bucket)
        asked = bucket[[a for a, _ in runs]]
        base = np.array([np.searchsorted(x, asked) for x in each], "<u4")
        size = np.array([np.searchsorted(x, asked, "right") for x in each], "<u4") - base
        return [(int(asked[k]), group, OPEN, pack(h[a:b].ravel(), g[a:b].ravel(), low, doc[a:b], numbers, base[:, k], size[:, k])) for k, (a, b) in enumerate(runs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] >> bits != group:
                    if parts:
                        yield _sent(rows_of(group, parts))
                    group, parts = row["chunk"] >> bits, []
                ids, data, offsets = _open_chunk(row)
                d = distinct(super_windows(unit, symbols(unit, data, offsets)), ids)
                if len(d.h):
                    parts.append((row["chunk"], d.h, d.g, d.least))
        if parts:
            yield _sent(rows_of(group, parts))

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by bucket, one bucket at a time."""
    bucket, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != bucket:
                if rows:
                    yield bucket, rows
                bucket, rows = row[0], []
            rows.append(row)
    if rows:
        yield bucket, rows


def _settle(unit: Unit):
    """For each group of chunks, which of their contents a smaller document elsewhere holds, and which are open or crowded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            parts = []
            for i, (_, _, _, payload) in enumerate(rows):
                h, g, low, doc, *cuts = unpack(payload)
                number, base, size = (x.astype(np.int64) for x in cuts)
                first = (number << PLACE_BITS) + base - (np.cumsum(size) - size)
                parts.append((wide(h, 6), wide(g, 7), (low.view(np.uint64) + doc.astype(np.uint64)).view(np.int64), np.full(len(doc), i), np.repeat(first, size) + np.arange(len(doc))))
            h, g, doc, who, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = order_of_pairs(h, g, doc)
            h, g, doc, who, at = h[order], g[order], doc[order], who[order], at[order]
            new_h = np.r_[True, h[1:] != h[:-1]]
            new = new_h | np.r_[True, g[1:] != g[:-1]]
            contents = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_h))
            each = np.repeat(contents, np.diff(np.r_[np.flatnonzero(new_h), len(h)]))
            several, crowded = (each > 1) & (each <= unit.crowd), each > unit.crowd
            least = np.repeat(doc[new], np.diff(np.r_[np.flatnonzero(new), len(h)]))
            later = (each == 1) & (doc > least)
            out = []
            for kind, some in ((SETTLED, later), (OPEN, several), (CROWDED, crowded)):
                picked = np.flatnonzero(some)
                picked = picked[stable_order(who[picked])]
                cuts = np.searchsorted(who[picked], np.arange(len(rows) + 1))
                for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if b > a:
                        some_at = at[picked[a:b]].astype("<u4")
                        out.append((rows[i][1], kind, pack(some_at, least[picked[a:b]]) if kind == SETTLED else pack(some_at)))
            yield _answers(out)

    return run


def _listed(answers: pa.Table, *kinds: int) -> dict[int, list[np.ndarray]]:
    """The columns of the answers of each kind, the chunks' numbers in their group before places."""
    out = {}
    for kind in kinds:
        found = [unpack(p) for k, p in zip(answers["kind"].to_pylist(), answers["payload"].to_pylist(), strict=True) if k == kind]
        if found:
            code, *more = (np.concatenate(c) for c in zip(*found, strict=True))
            code = code.astype(np.int64)
            out[kind] = [code >> PLACE_BITS, code & ((1 << PLACE_BITS) - 1), *more]
    return out


def _of_chunk(listed: dict[int, list[np.ndarray]], kind: int, chunk: int) -> list[np.ndarray] | None:
    """The answers of a kind that are one chunk's."""
    if kind not in listed:
        return None
    number, *columns = listed[kind]
    own = np.flatnonzero(number == (chunk & ((1 << GROUP_BITS) - 1)))
    return [c[own] for c in columns] if len(own) else None


def _contents(unit: Unit, buckets: int, bits: int):
    """The units of the open contents of a group's chunks, a row a bucket."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        rows, listed = [], _listed(answers, OPEN, CROWDED)
        parts: dict[int, list[tuple]] = {RESOLVED: [], WINDOWS: []}
        for row in chunks.to_pylist() if listed else []:
            opened, crowded = (_of_chunk(listed, kind, row["chunk"]) for kind in (OPEN, CROWDED))
            if opened is None and crowded is None:
                continue
            ids, data, offsets = _open_chunk(row)
            s = symbols(unit, data, offsets)
            w = super_windows(unit, s)
            d = distinct(w, ids)
            if crowded is not None:
                c = crowded_windows(unit, s, w, d, crowded[0], ids)
                inner = (c.sample[:, None] + np.arange(unit.length)).ravel()
                parts[WINDOWS].append((_codes(row["chunk"], np.arange(len(c.hash))), c.hash, c.least, np.full(len(c.hash), unit.length), s.values[inner]))
            if opened is not None:
                at = np.sort(opened[0])
                own = d.sample[at]
                first, sizes = w.first[own], w.count[own] + unit.length - 1
                inner = np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                parts[RESOLVED].append((_codes(row["chunk"], at), d.h[at], d.least[at], sizes, s.values[inner]))
        for kind, some in parts.items():
            if not some:
                continue
            code, h, least, sizes, values = (np.concatenate(c) for c in zip(*some, strict=True))
            bucket, starts = _bucket(h, buckets), np.cumsum(sizes) - sizes
            order = stable_order(bucket)
            code, h, least, sizes, starts, bucket = (x[order] for x in (code, h, least, sizes, starts, bucket))
            for a, b in _runs(bucket):
                inner = np.repeat(starts[a:b] - np.r_[0, np.cumsum(sizes[a:b])[:-1]], sizes[a:b]) + np.arange(sizes[a:b].sum())
                rows.append((int(bucket[a]), chunks["chunk"][0].as_py() >> bits, kind, pack(code[a:b], h[a:b], least[a:b], sizes[a:b].astype("<u2"), values[inner])))
        return pa.Table.from_batches([_sent(rows)])

    return run


def _resolve(unit: Unit, resolver: Callable, most: int = 1 << 17):
    """Open contents, minimizer by minimizer in batches: for each window the smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            parts, values = [], []
            for i, (_, _, _, payload) in enumerate(rows):
                at, h, least, sizes, own = unpack(payload)
                parts.append((np.full(len(at), i), at, h, least, sizes.astype(np.int64)))
                values.append(own)
            who, at, h, least, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            values = np.concatenate(values)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            order = np.argsort(h, kind="stable")
            new_h = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
            load = np.cumsum(sizes[order])
            group = np.searchsorted(new_h, np.arange(len(order)), "right") - 1
            # whole minimizers together until a batch is full
            batch_of = (load[new_h] // most)[group]
            answers: list[list] = [[] for _ in rows]
            for b in np.unique(batch_of):
                own = order[batch_of == b]
                inner = np.repeat(starts[own] - np.r_[0, np.cumsum(sizes[own])[:-1]], sizes[own]) + np.arange(sizes[own].sum())
                found = resolver(unit, values[inner], sizes[own], least[own])
                windows = sizes[own] - unit.length + 1
                cut = np.r_[0, np.cumsum(windows)]
                base = np.repeat(least[own], windows)
                smaller = np.flatnonzero(found < base)
                of = np.searchsorted(cut, smaller, "right") - 1
                # neighbouring windows with the same first document are one span
                joined = (smaller[1:] == smaller[:-1] + 1) & (of[1:] == of[:-1]) & (found[smaller[1:]] == found[smaller[:-1]])
                begin = np.flatnonzero(np.r_[True, ~joined]) if len(smaller) else np.zeros(0, np.int64)
                run_of = np.diff(np.r_[begin, len(smaller)])
                smaller, of = smaller[begin], of[begin]
                by = stable_order(who[own][of])
                smaller, of, run_of = smaller[by], of[by], run_of[by]
                edges = np.searchsorted(who[own][of], np.arange(len(rows) + 1))
                for i in range(len(rows)):
                    x, y = edges[i], edges[i + 1]
                    if y > x:
                        answers[i].append((at[own][of[x:y]].astype("<u4"), (smaller[x:y] - cut[of[x:y]]).astype("<u2"), run_of[x:y].astype("<u2"), found[smaller[x:y]]))
            yield _answers([(rows[i][1], rows[i][2], pack(*(np.concatenate(c) for c in zip(*found, strict=True)))) for i, found in enumerate(answers) if found])

    return run


def _apply(unit: Unit):
    """Marks what is covered by a window that a smaller document holds, and cuts it out."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_units", "n_removed", "n_spans", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        rows: list[tuple] = []
        listed = _listed(answers, SETTLED, RESOLVED, CROWDED, WINDOWS)
        for row in chunks.to_pylist():
            ids, data, offsets = _open_chunk(row)
            s = symbols(unit, data, offsets)
            w = super_windows(unit, s)
            d = distinct(w, ids)
            least, marks = d.least.copy(), np.zeros(len(s.values) + 1, np.int32)
            settled, resolved, crowded, windows_of = (_of_chunk(listed, kind, row["chunk"]) for kind in (SETTLED, RESOLVED, CROWDED, WINDOWS))
            if settled is not None:
                least[settled[0]] = settled[1]
            own = ids[w.doc]
            again = np.flatnonzero(own > least[d.place])
            np.add.at(marks, w.first[again], 1)
            np.add.at(marks, w.first[again] + w.count[again] + unit.length - 1, -1)
            if resolved is not None:
                by_place = stable_order(d.place)
                starts = np.searchsorted(d.place[by_place], np.arange(len(d.h) + 1))
                at, window, windows, smaller = resolved
                times = starts[at + 1] - starts[at]
                each = np.repeat(np.arange(len(at)), times)
                nth = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                occurrence = by_place[starts[at[each]] + nth]
                later = own[occurrence] > smaller[each]
                first = (w.first[occurrence] + window[each])[later]
                np.add.at(marks, first, 1)
                np.add.at(marks, first + windows[each][later] + unit.length - 1, -1)
            if crowded is not None:
                c = crowded_windows(unit, s, w, d, crowded[0], ids)
                smallest = c.least.copy()
                if windows_of is not None:
                    smallest[windows_of[0]] = windows_of[3]
                first = c.start[c.doc > smallest[c.place]]
                np.add.at(marks, first, 1)
                np.add.at(marks, first + unit.length, -1)
            gone = np.cumsum(marks[:-1]) > 0
            for i, doc in enumerate(ids.tolist()):
                a, b = int(s.offsets[i]), int(s.offsets[i + 1])
                own_gone = gone[a:b]
                removed = int(own_gone.sum())
                spans = int((np.diff(np.r_[False, own_gone].astype(np.int8)) == 1).sum())
                if unit.kind == "bytes":
                    kept = data[a:b][~own_gone].tobytes() if removed else data[a:b].tobytes()
                else:
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    if removed:
                        at = np.flatnonzero(~own_gone) + a
                        kept = b" ".join(text[x:y] for x, y in zip((s.start[at] - offsets[i]).tolist(), (s.end[at] - offsets[i]).tolist(), strict=True))
                    else:
                        kept = b" ".join(text.split())
                rows.append((doc, b - a, removed, spans, kept))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=names)

    return run


def group_bits(text_bytes: int, chunk_bytes: int) -> int:
    """How many chunks send together, as a power of two: one until there are many, so that small inputs keep their tasks."""
    return min(GROUP_BITS, max(1, text_bytes // (LEAST_GROUPS * chunk_bytes)).bit_length() - 1)


def remove_repeats(docs: DataFrame, unit: Unit, resolver: Callable, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept): each document without the units that a window
    covers which also starts in a document with a smaller doc_id."""
    spark = docs.sparkSession
    texts = with_ids(docs, F.col("text").cast("string").alias("text"))
    chunks = keep(texts.mapInArrow(_chunks(chunk_bytes), CHUNKS), "chunks")
    size = (chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * 3
    buckets, bits = int(size // bucket_bytes + 1), group_bits(size, chunk_bytes)
    grouped = chunks.groupBy(F.shiftright("chunk", bits))
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = chunks.mapInArrow(_emit(unit, buckets, bits), SENT).repartition(parts, "bucket").sortWithinPartitions("bucket")
    first = keep(sent.mapInArrow(_settle(unit), ANSWER), "settled")
    asked = grouped.cogroup(first.where(f"kind IN ({OPEN}, {CROWDED})").groupBy("grp")).applyInArrow(_contents(unit, buckets, bits), SENT)
    second = keep(asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_resolve(unit, resolver), ANSWER), "resolved")
    answers = first.where(f"kind IN ({SETTLED}, {CROWDED})").union(second)
    out = grouped.cogroup(answers.groupBy("grp")).applyInArrow(_apply(unit), "doc_id long, n_units long, n_removed long, n_spans long, kept binary")
    return out.select(real_id(), "n_units", "n_removed", "n_spans", "kept")
