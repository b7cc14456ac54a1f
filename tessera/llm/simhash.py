"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming links, components.

Fingerprints are computed once per document and reduced to distinct ones before any join, so a
group of copies is one fingerprint however large it is. Blocks: fingerprints within two bits
agree on all but two of the blocks; a join on those finds the candidates and the Hamming distance
verifies them. Keys that many fingerprints share are linked through common neighbours instead.

Defined results: a null text is empty; no words give fingerprint zero, linked like any other; a
text of any length is one fingerprint of all its shingles; rows of one doc_id get one row each,
with a fingerprint each, and are linked through their fingerprints only, so that rows of one
doc_id with unlike texts may be in different components; a null doc_id is smallest and comes back
as null; extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, flat_bytes, keep, real_id, slices, with_ids
from tessera.llm.repeats import _runs, pack, short, unpack, wide
from tessera.llm.textarrays import fresh_key, mix, window_hashes, words

SEED = 42
#: Fingerprints of one block key that the join compares with each other; more go by common neighbours.
DENSE = 64
#: Distinct fingerprints from which five blocks make longer keys than four.
MANY = 1 << 28


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each ``width``-word shingle of a text, A-Z in lower case, repeats included."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and space and \\x09-\\x0d
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = [0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                out.append(simhash(shingle_hashes(text.as_buffer().to_pybytes(), width)) if text.is_valid else 0)
            fps = pa.array(np.array(out, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], fps], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long."""
    texts = with_ids(docs, F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_fingerprints(width), "doc_id long, fp long")


def block_keys(fp: Column, radius: int = 2, blocks: int = 4) -> Column:
    """For every choice of ``blocks - radius`` blocks, the choice and the bits there."""
    size = 64 // blocks
    masks = []
    for choice in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << size) - 1) << (size * b) for b in choice)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return F.array(*(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)))


def hamming_links(fps: DataFrame, blocks: int = 4, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, each at 2 differing bits or fewer, that
    connect all fingerprints which such links connect.

    Fingerprints within 2 bits agree on ``blocks - 2`` of the blocks at least: a join on those finds
    every close pair, and the Hamming distance verifies it. Where more than ``dense`` fingerprints share
    a key, no pairs are formed: two of them within 2 bits have a common neighbour within 1 bit of both,
    and no more than 65 fingerprints share such a neighbour, so stars around it link the same."""
    close = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= 2
    keyed = keep(fps.select("fp", F.explode(block_keys(F.col("fp"), 2, blocks)).alias("key")).select("fp", "key.choice", "key.bits"), "blocks")
    shared = keep(keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1"), "shared-blocks")
    few = shared.where(F.col("n") <= dense).select("choice", "bits")
    members = keyed.join(few, ["choice", "bits"], "left_semi")
    other = members.select("choice", "bits", F.col("fp").alias("b"))
    joined = members.withColumnRenamed("fp", "a").join(other, ["choice", "bits"]).where((F.col("a") < F.col("b")) & close(F.col("a"), F.col("b"))).select("a", "b")
    crowd = keyed.join(shared.where(F.col("n") > dense).select("choice", "bits"), ["choice", "bits"], "left_semi").select("fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long")) for b in range(64)))
    stars = crowd.select("fp", F.explode(flips).alias("middle")).groupBy("middle").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    around = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return joined.union(around.where(close(F.col("a"), F.col("b")))).distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """Each document: doc_id, fingerprint, component_id."""
    prints = keep(fingerprints(docs, width), "fingerprints")
    nodes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    links = keep(hamming_links(nodes.select("fp"), 4 if nodes.count() < MANY else 5), "links")
    found = components(links)
    grouped = keep(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"), "first"), "grouped")
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    out = prints.join(grouped.join(least, "component").select("fp", "component_id"), "fp")
    return out.select(real_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real_id("component_id"))


#: Prefix tokens that more shingle sets share come last in the order of tokens, the most shared ones at the end.
HOT, MOST_HOT = 32, 100_000
#: Sets of one token that a task compares all with all; longer lists are cut, and every part meets every other.
PART = 4096
#: Rounds at most that link each set to a few of a list before all pairs that are still in different groups are
#: compared; they end once a round adds less than half a percent of the links.
STAR_ROUNDS = 8
#: Tokens that a task packs together, tokens of a bucket, and sets from which a token's list is dealt over many tasks.
FLUSH, BUCKET_TOKENS, SPLIT = 1 << 18, 1 << 19, 1 << 16
#: Tasks that share such a list.
SPREAD = 256
SENT = "bucket long, token long, node long, size int, before int, p0 long, p1 long, payload binary"


class Naming(NamedTuple):
    """How sets are made and named: words a shingle, the key of the hashes, bits of a name, and names that stand for more
    than one set, which take their second hash instead."""

    width: int
    key: int
    bits: int = 64
    clashing: frozenset[int] = frozenset()

    def sets(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """The different shingles of each text."""
        w = words(*flat_bytes(batch["text"]), lower=True, key=self.key)
        cuts = np.searchsorted(w.doc, np.arange(batch.num_rows + 1)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.unique(window_hashes(w.hash[a:b], max(1, min(self.width, b - a))))

    def hashes(self, shingles: np.ndarray) -> tuple[int, int]:
        """Two hashes of a whole set, 64 bits each; ``bits`` of the first are its name."""
        sums = [mix(mix(x).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))) for x in (shingles, shingles ^ np.uint64(0x9E3779B97F4A7C15))]
        return int((sums[0] >> np.uint64(64 - self.bits)).view(np.int64)[0]), int(sums[1].view(np.int64)[0])

    def name(self, shingles: np.ndarray) -> int:
        first, second = self.hashes(shingles)
        return second if first in self.clashing else first


def _names(naming: Naming):
    """Two hashes, size and parities of each text's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text")):
            sets = list(naming.sets(batch))
            names = np.array([naming.hashes(s) for s in sets], np.int64).reshape(-1, 2)
            columns = [pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([_parities(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", "node", "second", "size", "parities"])

    return run


def _parities(shingles: np.ndarray) -> bytes:
    """For each of some 1.25 to 2.5 classes a shingle, whether an odd number of shingles falls into it."""
    bits = max(64, 1 << max(0, int(1.25 * len(shingles))).bit_length())
    odd = np.bincount((shingles >> np.uint64(16)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _few_parities(shingles: np.ndarray) -> np.ndarray:
    """Parities of 128 classes as two numbers, for lists; they tell small sets apart."""
    odd = np.bincount((shingles >> np.uint64(16)).astype(np.int64) & 127, minlength=128) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _cut(shingles: np.ndarray) -> np.ndarray:
    """48 bits of a shingle name its token."""
    return shingles >> np.uint64(16)


def _prefixes(naming: Naming, similarity: float, hot: np.ndarray, buckets: int, count: bool, split: np.ndarray):
    """Packed tokens of each text's prefix, by bucket: sets at ``similarity`` or more always share one of their
    first tokens in one order of tokens, in which ``hot`` ones come last. With ``count`` tokens and numbers of
    texts, else tokens with the names and sizes of their sets; ``split`` tokens go as rows of their own."""
    at_hash = np.argsort(hot)
    sorted_hot = hot[at_hash]

    def first_places(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tokens, at = np.unique(tokens, return_index=True)
        return tokens, at.astype(np.int32)

    def prefix(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1 if len(shingles) else 0
        if not len(hot):
            return first_places(_cut(shingles[:size]))
        tokens = _cut(shingles)
        at = np.searchsorted(sorted_hot, tokens).clip(0, len(hot) - 1)
        rank = np.where(sorted_hot[at] == tokens, at_hash[at], -1)
        return first_places(tokens[np.lexsort((shingles, rank))[:size]])

    def packed(held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        tokens, before = (np.concatenate([h[i] for h in held]) for i in (2, 3))
        who = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        nodes, sizes = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int32)
        few = np.stack([h[4] for h in held])
        alone = np.isin(tokens, split)
        rows = (buckets + who[alone] % SPREAD, tokens[alone].view(np.int64), nodes[who[alone]], sizes[who[alone]], before[alone], *few[who[alone]].T)
        order = np.flatnonzero(~alone)[np.argsort(tokens[~alone], kind="stable")]
        tokens, who, before = tokens[order], who[order], before[order]
        if count:
            tokens, times = np.unique(tokens, return_counts=True)
        bucket = (tokens * np.uint64(buckets) >> np.uint64(48)).astype(np.int64)
        keys, payloads = [], []
        for a, b in _runs(bucket):
            keys.append(int(bucket[a]))
            if count:
                payloads.append(pack(short(tokens[a:b], 6), times[a:b].astype("<u4")))
            else:
                own, place = np.unique(who[a:b], return_inverse=True)
                payloads.append(pack(short(tokens[a:b], 6), place.astype("<u2" if len(own) < 65536 else "<u4"), nodes[own], sizes[own], before[a:b], few[own].ravel()))
        zeros = np.zeros(len(keys), np.int64)
        columns = [np.r_[zero.astype(row.dtype), row] for zero, row in zip((np.array(keys, np.int64), *[zeros] * 6), rows, strict=True)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(payloads + [None] * len(rows[0]), pa.binary())], names=["bucket", "token", "node", "size", "before", "p0", "p1", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # equal sets once
        n = 0
        for batch in (part for b in batches for part in slices(b, "text")):
            for shingles in naming.sets(batch):
                name = naming.name(shingles)
                if name not in held:
                    held[name] = (name, len(shingles), *prefix(shingles), _few_parities(shingles))
                    n += len(held[name][2])
            if n >= FLUSH:
                yield packed(list(held.values()))
                held, n = {}, 0
        if held:
            yield packed(list(held.values()))

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[np.ndarray]] | pa.RecordBatch]:
    """The unpacked payloads of each bucket, and rows without a payload as they come."""
    bucket, held = None, []
    for batch in batches:
        plain = batch.filter(batch["payload"].is_null())
        if plain.num_rows:
            yield plain
        for key, payload in zip(batch["bucket"].to_pylist(), batch["payload"].to_pylist(), strict=True):
            if payload is None:
                continue
            if key != bucket:
                if held:
                    yield held
                bucket, held = key, []
            held.append(unpack(payload))
    if held:
        yield held


def _totals(least: int):
    """Tokens of more than ``least`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            tokens, place = np.unique(np.concatenate([wide(t, 6) for t, _ in held]), return_inverse=True)
            total = np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[total > least].view(np.int64)), pa.array(total[total > least])], names=["token", "length"])

    return run


LISTS = "token long, node long, size int, before int, p0 long, p1 long, place long, length long, part long, alike long"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of several sets, with place in and length of their lists, sets ordered by size, and a hash of the
    whole list; rows of their own get place and length later."""
    names = [x.split()[0] for x in LISTS.split(", ")]
    for held in _by_bucket(batches):
        if isinstance(held, pa.RecordBatch):
            none = pa.nulls(held.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([held["token"], held["node"], held["size"], held["before"], held["p0"], held["p1"], none, none, held["bucket"], none], names=names)
            continue
        columns = ((wide(t, 6), nodes[who], sizes[who], before, *few.reshape(-1, 2)[who].T) for t, who, nodes, sizes, before, few in held)
        token, node, size, *rest = (np.concatenate(c) for c in zip(*columns, strict=True))
        order = np.lexsort((node, size, token))
        new = np.r_[True, (token[order][1:] != token[order][:-1]) | (node[order][1:] != node[order][:-1])]  # repeated rows of one document
        token, node, size, *rest = (c[order[new]] for c in (token, node, size, *rest))
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        lengths = np.diff(np.r_[starts, len(token)])
        length = np.repeat(lengths, lengths)
        alike = np.repeat(np.add.reduceat(mix(node.view(np.uint64)), starts), lengths).view(np.int64)
        place, more = np.arange(len(token)) - np.repeat(starts, lengths), length > 1
        numbers = [pa.array(c[more]) for c in (token.view(np.int64), node, size, *rest, place, length)]
        yield pa.RecordBatch.from_arrays([*numbers, pa.nulls(int(more.sum()), pa.int64()), pa.array(alike[more])], names=names)


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of sorted rows and where runs of equal keys start; a run is never cut."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        at = [batch.schema.get_field_index(k) for k in keys]
        cuts = np.flatnonzero(np.any([columns[i][1:] != columns[i][:-1] for i in at], axis=0)) + 1
        if held and any(held[-1][i][-1] != columns[i][0] for i in at):
            cuts = np.r_[0, cuts]
        if len(cuts):
            full = [np.concatenate([*(h[i] for h in held), c[: cuts[-1]]]) for i, c in enumerate(columns)]
            held = []
            columns = [c[cuts[-1] :] for c in columns]
            if len(full[0]):
                yield full, np.flatnonzero(np.r_[True, np.any([full[i][1:] != full[i][:-1] for i in at], axis=0)])
        held.append(columns)
    if held:
        yield [np.concatenate([h[i] for h in held]) for i in range(len(held[0]))], np.zeros(1, np.int64)


class _Members:
    """Sets of token lists as arrays."""

    def __init__(self, node: np.ndarray, size: np.ndarray, before: np.ndarray, group: np.ndarray, p0: np.ndarray, p1: np.ndarray, parities: np.ndarray | None = None):
        self.node, self.size, self.before, self.group, self.signed = node, size, before, group, parities is not None
        self.few = np.stack([p0, p1], 1).view(np.uint64)
        if not self.signed:
            return
        self.bytes = np.fromiter(map(len, parities), np.int64, len(parities))
        self.row, self.whole, self.folded = np.empty(len(node), np.int64), {}, {}
        for n in np.unique(self.bytes).tolist():
            own = np.flatnonzero(self.bytes == n)
            self.row[own] = np.arange(len(own))
            self.whole[n] = np.frombuffer(b"".join(parities[own]), np.uint64).reshape(len(own), -1)
            # classes by the low bits: the two halves together are the parities of half as many classes
            half = self.whole[n].shape[1] // 2
            self.folded[n] = self.whole[n][:, :half] ^ self.whole[n][:, half:] if half else None

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many shingles two sets differ at least: one for each class of unequal parity."""
        out = np.zeros(len(i), np.int64)
        low, high = np.minimum(self.bytes[i], self.bytes[j]), np.maximum(self.bytes[i], self.bytes[j])
        smaller, larger = np.where(self.bytes[i] <= self.bytes[j], i, j), np.where(self.bytes[i] <= self.bytes[j], j, i)
        for n in np.unique(low).tolist():
            for table, at in ((self.whole.get(n), np.flatnonzero((low == n) & (high == n))), (self.folded.get(2 * n), np.flatnonzero((low == n) & (high == 2 * n)))):
                for a in range(0, len(at), 1 << 16):
                    own = at[a : a + (1 << 16)]
                    out[own] = np.bitwise_count(self.whole[n][self.row[smaller[own]]] ^ table[self.row[larger[own]]]).sum(1, dtype=np.int64)
        return out

    def pairs(self, i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different groups, smaller node first, that may reach the similarity: by their parities, and, if
        this is the first token they share, by what follows it in either set, which is all they can have in
        common. A pair that is as similar passes at the first token it shares."""
        least = similarity / (1 + similarity) * (self.size[i] + self.size[j]) - 1e-6
        fine = (np.minimum(self.size[i] - self.before[i], self.size[j] - self.before[j]) >= least) & (self.group[i] != self.group[j])
        i, j, least = i[fine], j[fine], least[fine]
        fine = np.bitwise_count(self.few[i] ^ self.few[j]).sum(1, dtype=np.int64) <= self.size[i] + self.size[j] - 2 * least
        i, j, least = i[fine], j[fine], least[fine]
        if self.signed:
            fine = self.apart(i, j) <= self.size[i] + self.size[j] - 2 * least
            i, j = i[fine], j[fine]
        a, b = self.node[i], self.node[j]
        return np.minimum(a, b), np.maximum(a, b)


MEMBERS = ["node", "size", "before", "grp", "p0", "p1"]


def _pair_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    pairs = np.concatenate([np.stack(f, 1) for f in found]) if found else np.zeros((0, 2), np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.r_[True, np.any(pairs[1:] != pairs[:-1], axis=1)]] if len(pairs) else pairs
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _stars(similarity: float):
    """Each set of a list with the one before it, the first one and the first of its 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = batch["token"].to_numpy()
            if not len(token):
                continue
            members = _Members(*(batch[c].to_numpy(zero_copy_only=False) for c in MEMBERS))
            at = np.arange(len(token))
            start = np.maximum.accumulate(np.where(np.r_[True, token[1:] != token[:-1]], at, 0))
            others = (np.maximum(at - 1, start), start, at - (at - start) % 64)
            yield _pair_batch([members.pairs(at, o, similarity) for o in others])

    return run


def _part_pairs(rows: int):
    """Every row once for each part of its list that its own part meets, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, parts = batch["place"].to_numpy() // rows, -(-batch["length"].to_numpy() // rows)
            each = np.repeat(np.arange(batch.num_rows), parts)
            other, own = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts), part[each]
            columns = [batch[c].take(pa.array(each)) for c in ("token", *MEMBERS, "parities")]
            low, high = np.minimum(own, other), np.maximum(own, other)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(low), pa.array(high), pa.array(own)], names=["token", *MEMBERS, "parities", "low", "high", "own"])

    return run


def _all_pairs(similarity: float):
    """All pairs of different groups in a list, or of two parts of a long one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token, *columns, low, high, own), starts in _whole_runs(batches, ["token", "low", "high"]):
            lengths, members = np.diff(np.r_[starts, len(token)]), _Members(*columns)
            after = np.repeat(starts + lengths, lengths) - np.arange(len(token)) - 1
            i, found, total = np.flatnonzero(after > 0), [], 0
            step = 1
            while len(i):
                met = i[(low[i] == high[i]) | (own[i] != own[i + step])]
                found.append(members.pairs(met, met + step, similarity))
                total += len(found[-1][0])
                if total > 1 << 18:
                    yield _pair_batch(found)
                    found, total = [], 0
                step += 1
                i = i[after[i] >= step]
            yield _pair_batch(found)

    return run


def _may_be_alike(similarity: float):
    """Pairs that the parities of their sets leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ends = [np.concatenate([batch[x].to_numpy(zero_copy_only=False), batch[y].to_numpy(zero_copy_only=False)]) for x, y in (("a", "b"), ("na", "nb"), ("pa", "pb"))]
            zero = np.zeros(2 * n, np.int64)
            a, b = _Members(ends[0], ends[1], zero, np.arange(2 * n), zero, zero, ends[2]).pairs(np.arange(n), np.arange(n, 2 * n), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _shingle_sets(naming: Naming):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text")):
            sets = list(naming.sets(batch))
            columns = [pa.array([naming.name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles"])

    return run


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for a, b in zip(batch["sa"], batch["sb"], strict=True):
                x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                total = len(x) + len(y) - shared
                fine.append(total == 0 or shared >= similarity * total - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return run


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, hot_from: int = HOT, part: int = PART, star_rounds: int = STAR_ROUNDS, split_from: int = SPLIT, name_bits: int = 64) -> DataFrame:
    """(doc_id, component_id) of documents linked, through others or directly, by a Jaccard similarity of
    ``similarity`` or more of their sets of ``width``-word shingles.

    Equal sets are one node, told apart by two hashes of the whole set and named by the first, or by the
    second where the first stands for several sets. Candidates come from a prefix filter,
    which loses no pair: in any one order of tokens, sets so similar share one of their first tokens.
    Tokens of many sets come last in that order. A few rounds link the sets of a token's list to some
    of it; then all pairs that are still in different groups are compared, long lists part by part.
    Groups are made of verified links only, so a pair left out is one that links connect already."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = with_ids(docs, F.col("text").cast("string").alias("text"))
    naming = Naming(width, fresh_key(), name_bits)
    prints = keep(texts.mapInArrow(_names(naming), "doc_id long, node long, second long, size long, parities binary"), "shingle-sets-named")
    # as good as never any: of 10^10 sets two or three pairs share 64 bits
    several = prints.groupBy("node").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high").select("node")
    naming = naming._replace(clashing=frozenset(r["node"] for r in several.collect()))
    if naming.clashing:
        prints = prints.join(several.withColumn("clash", F.lit(True)), "node", "left").withColumn("node", F.when(F.col("clash"), F.col("second")).otherwise(F.col("node")))
        prints = keep(prints.select("doc_id", "node", "size", "parities"), "shingle-sets-renamed")
    nodes = keep(prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("n"), F.first("parities").alias("parities")), "nodes")
    tokens = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = int(tokens * (1 - similarity) // BUCKET_TOKENS) + 1

    def sent(hot: np.ndarray, count: bool, split: np.ndarray) -> DataFrame:
        rows = texts.mapInArrow(_prefixes(naming, similarity, hot, buckets, count, split), SENT)
        return rows.repartition(max(parts, buckets), "bucket").sortWithinPartitions("bucket")

    none = np.zeros(0, np.uint64)
    counted = sent(none, True, none).mapInArrow(_totals(hot_from), "token long, length long")
    top = counted.orderBy(F.desc("length"), "token").limit(MOST_HOT).collect()  # MOST_HOT rows at most
    hot = np.array([r["token"] for r in top], np.int64)[::-1].view(np.uint64)
    split = np.array([r["token"] for r in top if r["length"] > split_from], np.int64).view(np.uint64)
    lists = keep(sent(hot, False, split).mapInArrow(_shared, LISTS), "token-lists")
    if len(split):
        long = lists.where("place IS NULL").dropDuplicates(["token", "node"])
        sizes = long.groupBy("token", "part").agg(F.count("*").alias("n"))
        before = Window.partitionBy("token").orderBy("part")
        offsets = sizes.select("token", "part", (F.sum("n").over(before) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy("token")).alias("all"))
        local = F.row_number().over(Window.partitionBy("token", "part").orderBy("size", "node")) - 1
        placed = long.withColumn("local", local).join(offsets, ["token", "part"])
        lists = lists.where("place IS NOT NULL").unionByName(placed.select("token", "node", "size", "before", "p0", "p1", (F.col("local") + F.col("offset")).alias("place"), F.col("all").alias("length"), "part", "token").toDF(*[x.split()[0] for x in LISTS.split(", ")]))
        lists = keep(lists.where("length > 1"), "placed-lists")
    # tokens with the same list are one: the first in the order of tokens is the first that any two of it share
    firsts = lists.where("place = 0").groupBy("alike", "length").agg(F.min_by("token", F.struct("before", "token")).alias("token"))
    lists = keep(lists.drop("part", "alike").join(firsts.select("token"), "token", "left_semi"), "lists")

    def both(pairs: DataFrame, tables: DataFrame, **columns: str) -> DataFrame:
        """Pairs with columns of either set."""
        for end in "ab":
            pairs = pairs.join(tables.select(F.col("node").alias(end), *(F.col(c).alias(name + end) for name, c in columns.items())), end)
        return pairs.select("a", "b", *(name + end for end in "ab" for name in columns))

    def verified(pairs: DataFrame, bounded: bool) -> DataFrame:
        """A bound from the parities first; whole sets are made again for what it leaves."""
        pairs = keep(pairs.distinct(), "pairs")
        if not bounded:
            pairs = keep(both(pairs, nodes, p="parities", n="n").mapInArrow(_may_be_alike(similarity), "a long, b long"), "bounded-pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "doc_id"), "node")
        ends = keep(ends, "ends")
        own = texts.join(ends.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_shingle_sets(naming), "node long, shingles binary")
        sets = keep(own.join(ends.select("node"), "node", "left_semi").dropDuplicates(["node"]), "shingle-sets")
        return keep(both(pairs, sets, s="shingles").mapInArrow(_alike(similarity), "a long, b long"), "links")

    links, found, turn, total, more = None, None, 0, 0, 1
    open_lists = lists.withColumn("grp", F.col("node"))
    while True:
        compared = open_lists.groupBy("token").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
        if not compared["n"]:
            break
        last = compared["pairs"] <= 2 * compared["n"] or turn >= star_rounds or turn >= 1 and more * 200 < total
        if last:
            signed = open_lists.join(nodes.select("node", "parities"), "node").select("token", *MEMBERS, "parities", "place", "length")
            cut = signed.mapInArrow(_part_pairs(part), "token long, node long, size int, before int, grp long, p0 long, p1 long, parities binary, low long, high long, own long")
            pairs = cut.repartition(parts, "token", "low", "high").sortWithinPartitions("token", "low", "high", "own").mapInArrow(_all_pairs(similarity), "a long, b long")
        else:
            order = ["size", "node"] if not turn else [F.xxhash64("node", F.lit(turn))]
            pairs = open_lists.repartition(parts, "token").sortWithinPartitions("token", *order).mapInArrow(_stars(similarity), "a long, b long")
        new = verified(pairs, bounded=last)
        more = new.count()
        total += more
        links = new if links is None else links.union(new)
        found = components(links)
        if last:
            break
        turn += 1
        named = lists.join(found.withColumnRenamed("component", "grp"), "node", "left").withColumn("grp", F.coalesce("grp", "node"))
        mixed = named.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high").select("token")
        mixed = keep(mixed, "mixed")
        open_lists = keep(named.join(mixed, "token", "left_semi").select("token", *MEMBERS, "place", "length"), "open-lists")

    grouped = nodes.select("node", "doc_id")
    if found is not None:
        grouped = grouped.join(found, "node", "left")
        grouped = grouped.withColumn("component", F.coalesce("component", "node"))
    else:
        grouped = grouped.withColumn("component", F.col("node"))
    grouped = keep(grouped, "grouped")
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = grouped.join(least, "component").select("node", "component_id")
    return prints.select("doc_id", "node").join(of, "node").select(real_id(), real_id("component_id"))


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
