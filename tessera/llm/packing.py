"""Best-fit packing of tokenised documents into training sequences.

Documents are tokenised and cut into pieces in one distributed pass. A piece's vector (tokens,
documents, attention cost) depends on its length only, so vector best-fit-decreasing needs no
more than the histogram of lengths: at most ``max_tokens`` numbers reach the driver, whatever
the input. The resulting plan says which ranks of each length go where; ranks are given out
in parallel, with frequent lengths dealt over many buckets.

Defined results: a null or empty text is the end token alone; a text of any length is cut into
pieces, the first of which may be shorter; equal rows are packed each; a null doc_id stays null;
extra columns play no part; no rows give no sequences.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keep, real_id, slices, with_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one length that one task ranks.
BUCKET_ROWS = 1024
#: Tokens decide; among bins with as many left, the one with fewer documents and less attention left.
WEIGHTS = (1.0, 1e-7, 1e-7)
#: Residual vectors told apart; beyond this those of equal tokens are merged.
MAX_STATES = 20_000
#: Rows of a plan that are broadcast, 48 bytes each; a longer plan is joined by shuffle.
BROADCAST_ROWS = 200_000
_encoders: dict = {}


class Encoder:
    """Ids of texts. The rank file holds the vocabulary of the JSON file and encodes several
    times faster; texts with a special token's string go through the JSON file."""

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.special = [x.content for x in self.exact.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if any(x in text for x in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


    def check(self, text: str) -> None:
        """Both files give one text the same ids; tried on a short one of every MB."""
        if self.exact.encode(text[:4096], add_special_tokens=False).ids != self.ids(text[:4096]):
            raise ValueError("the rank file and the JSON file give different ids")


def encoder(json_path: str, ranks_path: str) -> Encoder:
    """One encoder for each worker process."""
    if (json_path, ranks_path) not in _encoders:
        _encoders[json_path, ranks_path] = Encoder(json_path, ranks_path)
    return _encoders[json_path, ranks_path]


def _pieces(json_path: str, ranks_path: str, max_tokens: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(json_path, ranks_path)
        for batch in (part for b in batches for part in slices(b, "text")):
            rows: list[tuple] = []
            texts = batch["text"].to_pylist()
            e.check(min((t for t in texts if t), key=len, default=""))
            for doc, text in zip(batch["doc_id"].to_pylist(), texts, strict=True):
                ids = np.array([*e.ids(text or ""), end_id], "<u4")
                cuts = [0, *range(len(ids) % max_tokens or max_tokens, len(ids), max_tokens), len(ids)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenized_pieces(docs: DataFrame, max_tokens: int = 1024, end_id: int = 2, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = with_ids(docs, F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_pieces(json_path, ranks_path, max_tokens, end_id), PIECES)


class _Bins:
    """Runs of bins by residual vector, in arrays that grow, so that the best one is a vector operation away."""

    def __init__(self, dims: int):
        self.residual, self.alive, self.n = np.zeros((1024, dims), np.int64), np.zeros(1024, bool), 0
        self.at: dict[tuple, int] = {}
        self.runs: list[list[list[int]]] = []

    def add(self, residual: tuple, first: int, bins: int) -> None:
        if residual not in self.at:
            if self.n == len(self.alive):
                self.compact()
            if self.n == len(self.alive):
                self.residual = np.concatenate([self.residual, np.zeros_like(self.residual)])
                self.alive = np.concatenate([self.alive, np.zeros_like(self.alive)])
            self.residual[self.n], self.alive[self.n], self.at[residual] = residual, True, self.n
            self.runs.append([])
            self.n += 1
        self.runs[self.at[residual]].append([first, bins])

    def compact(self) -> None:
        old = [(r, self.runs[i]) for r, i in self.at.items()]
        self.alive[:], self.n, self.at, self.runs = False, 0, {}, []
        for residual, runs in old:
            self.residual[self.n], self.alive[self.n], self.at[residual] = residual, True, self.n
            self.runs.append(runs)
            self.n += 1

    def merge(self) -> None:
        """One state for each token residual, with the smallest of the other residuals: still within every capacity."""
        old = [(r, self.runs[i]) for r, i in self.at.items()]
        least: dict[int, tuple] = {}
        for residual, _ in old:
            least[residual[0]] = tuple(min(x) for x in zip(residual, least.get(residual[0], residual), strict=True))
        self.alive[:], self.n, self.at, self.runs = False, 0, {}, []
        for residual, runs in old:
            for first, bins in runs:
                self.add(least[residual[0]], first, bins)

    def take(self, residual: tuple, want: int) -> list[tuple[int, int]]:
        at, out = self.at[residual], []
        runs = self.runs[at]
        while want and runs:
            first, n = runs.pop()
            if n > want:
                runs.append([first + want, n - want])
                n = want
            out.append((first, n))
            want -= n
        if not runs:
            self.alive[at] = False
            del self.at[residual]
        return out

    def best(self, item: np.ndarray, scale: np.ndarray, score: str) -> tuple | None:
        r = self.residual[: self.n]
        fits = np.flatnonzero(self.alive[: self.n] & (r >= item).all(1))
        if not len(fits):
            return None
        r = r[fits]
        value = (scale * (r - item) ** 2).sum(1) if score == "norm" else -(scale * r * item).sum(1)
        return tuple(int(x) for x in r[int(np.argmin(value))])


def best_fit_plan(
    counts: dict[int, int],
    max_tokens: int,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    score: str = "norm",
    max_states: int = MAX_STATES,
) -> list[tuple[int, int, int, int, int, int]]:
    """Vector best-fit-decreasing over a histogram of lengths. Each row of the plan, (length,
    first rank, items, first bin, items per bin, offset), places consecutive ranks of a length
    in consecutive bins. A bin's residual vector is of tokens, documents and attention cost (the
    sum of squared lengths); an item goes only where all three are left. ``score``: "norm" takes the
    bin whose weighted residual norm is smallest after placing, "dot" the one whose residual has the
    largest weighted dot-product with the item.

    Bins with equal residuals are handled together, item by item in effect: with "norm" the chosen
    bin stays best until it is full, with "dot" all bins of the residual come before any other, and a
    new bin is filled as far as the item fits. Beyond ``max_states`` residuals those of equal tokens
    are merged into the tightest of them, which bounds the work whatever the input."""
    full = np.array([max_tokens, max_docs or max_tokens, max_attention or max_tokens**2], np.int64)
    scale = np.array(weights, float) / full.astype(float) ** 2
    bins, plan, opened = _Bins(3), [], 0
    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, length * length], np.int64)
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left, rank = counts[length], 0
        while left:
            if len(bins.at) > max_states:
                bins.merge()
            residual = bins.best(item, scale, score)
            if residual is None:
                residual = tuple(int(x) for x in full)
                per = min(int((full // item).min()), left)
                runs = [(opened, left // per)]
                opened += left // per
            else:
                per = min(int((np.array(residual) // item).min()), left) if score == "norm" else 1
                runs = bins.take(residual, left // per)
            after = tuple(int(x) for x in np.array(residual) - per * item)
            for first, n in runs:
                plan.append((length, rank, n * per, first, per, max_tokens - residual[0]))
                rank, left = rank + n * per, left - n * per
                if after[0] and after[1]:
                    bins.add(after, first, n)
    return plan


def pack(docs: DataFrame, max_tokens: int = 1024, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm", **tokenizer) -> DataFrame:
    """Every piece with its sequence_id and its gapless offset there. Pieces are no longer than
    ``max_tokens`` and than what ``max_attention`` leaves for one document."""
    spark = docs.sparkSession
    longest = max_tokens if max_attention is None else min(max_tokens, math.isqrt(max_attention))
    pieces = keep(tokenized_pieces(docs, longest, **tokenizer), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = best_fit_plan(counts, max_tokens, max_docs, max_attention, weights, score)
    dealt = spark.createDataFrame([(k, n // BUCKET_ROWS + 1) for k, n in counts.items()], "length long, buckets long")
    rows = spark.createDataFrame(plan, "length long, first_rank long, items long, first_bin long, per_bin long, base long")
    rows = rows.withColumnRenamed("length", "plan_length")
    if len(plan) <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    # at most max_tokens rows
    bucketed = pieces.join(F.broadcast(dealt), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "buckets"))
    sizes = bucketed.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    local = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = bucketed.withColumn("local", F.row_number().over(local)).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    placed = ranked.join(rows, (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("items")))
    nth = F.col("rank") - F.col("first_rank")
    return placed.select(
        real_id(), "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).alias("sequence_id"),
        (F.col("base") + (nth % F.col("per_bin")) * F.col("length")).alias("offset"),
    )


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    # the contract limits tokens alone: the other capacities are as large as 1024 tokens can need
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), max_tokens=1024, max_docs=1024, max_attention=1024 * 1024)
