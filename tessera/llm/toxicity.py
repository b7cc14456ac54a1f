"""Toxicity by compression distance.

Zstandard trains two dictionaries, one on ordinary text and one on the text of toxic documents that
ordinary ones hardly share (byte sequences that are several times as frequent there). Every window
of a text is compressed with either; how much shorter the toxic dictionary makes the best windows,
and how many windows pass each of three thresholds, is calibrated into a probability on the
training documents. Scores use the text alone.

Bound: ``per_class`` labelled documents of each class (chosen by hash) train the dictionaries and the
calibration, with all their windows; scoring covers every whole text.

Defined results: a null text is empty and scores like one; without training documents of both
classes every score is 0; of several labels of one doc_id the largest counts, null labels
count as none; a null doc_id is never held out nor trained on; a text of any length is scored
by all its windows, repeated rows each; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import real_id, with_ids

WINDOW = 64
GRAM = 5
#: Match finding that pays off on windows of a few words: matches of three bytes, optimal parsing.
SEARCH = {"min_match": 3, "strategy": 6, "search_log": 4, "target_length": 32, "window_log": 16, "hash_log": 14, "chain_log": 14}
FEATURES = 10


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The whole text in lower case as windows of whole words, ``size`` bytes or a little more."""
    out, current = [], b""
    for word in text.lower().encode("utf-8", "replace").split():
        current += b" " + word
        if len(current) >= size:
            out.append(current + b" ")
            current = b""
    if current or not out:
        out.append(current + b" ")
    return out


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kept = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    kept.precompute_compress(compression_params=zstandard.ZstdCompressionParameters(**SEARCH))
    bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return zstandard.ZstdCompressor(dict_data=kept, compression_params=zstandard.ZstdCompressionParameters(**SEARCH, **bare))


@dataclass
class Model:
    """Both dictionaries and the calibration; a few ten kilobytes, sent with the tasks."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.c_[(features - self.mean) / self.scale, np.ones(len(features))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Gauge:
    """Features of a text: how the windows' lengths under the two dictionaries differ."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary).compress, _compressor(toxic).compress

    def features(self, text: str | None) -> list[float]:
        ordinary, toxic, cut = self.ordinary, self.toxic, windows(text or "")
        x = np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in cut), np.int64, len(cut))
        top = np.sort(x)[::-1][:3]
        over = [(x > t).sum() for t in (2, 4, 6)]
        return [float(top[0]), float(top.mean()), *(math.sqrt(n) for n in over), *(float(n) / len(x) for n in over), float(np.maximum(x, 0).mean()), math.log(len(x) + 1)]


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte n-grams inside words of a document, its bytes, and the grams' places."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), data, np.zeros(0, np.int64)
    grams, inner = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(GRAM):
        grams = (grams << np.uint64(8)) | data[k : n + k]
        if 0 < k < GRAM - 1:
            inner &= data[k : n + k] != 32
    places = np.flatnonzero(inner)
    return grams[places], data, places


def _counts(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    seen = [np.unique(_grams(d)[0]) for d in documents]
    return np.unique(np.concatenate(seen), return_counts=True)


def contrasting_text(toxic: list[list[bytes]], ordinary: list[list[bytes]], ratio: float, least: int) -> list[bytes]:
    """For each toxic document that has any, its text made of n-grams that are ``ratio`` times as frequent in toxic
    documents as in ordinary ones."""
    gt, nt = _counts(toxic)
    go, no = _counts(ordinary)
    at = np.searchsorted(go, gt).clip(0, len(go) - 1)
    other = np.where(go[at] == gt, no[at], 0)
    marked = gt[(nt >= least) & ((nt + 0.5) / (other + 0.5) * len(ordinary) / len(toxic) >= ratio)]
    out = []
    for document in toxic:
        grams, data, places = _grams(document)
        covered = np.zeros(len(data) + 1, bool)
        for k in range(GRAM):
            covered[places[np.isin(grams, marked)] + k] = True
        edges = np.flatnonzero(np.diff(np.r_[False, covered].astype(np.int8)))
        text = data.tobytes()
        passages = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
        if passages:
            out.append(b" ".join(passages))
    return out


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b" ".join(dict.fromkeys(samples))[-size:]


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], size: int = 32768, toxic_size: int = 2048, ratio: float = 20.0, least: int = 8) -> tuple[bytes, bytes]:
    """Two dictionaries that zstandard trains: one on the windows of ordinary documents, one on what toxic documents
    hold and ordinary ones hardly do. The toxic one is used after the ordinary one, so that what is
    ordinary costs the same with either."""
    plain = list(dict.fromkeys(w for d in ordinary for w in d))
    least = max(2, min(least, len(toxic) // 10))
    base = _dictionary(size, plain)
    return base, base + _dictionary(toxic_size, contrasting_text(toxic, ordinary, ratio, least))


def calibrate(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method: (mean, scale, weights)."""
    mean, scale = features.mean(0), features.std(0) + 1e-9
    x = np.c_[(features - mean) / scale, np.ones(len(features))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weights * (p - labels)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [windows(text or "") for text in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(out, pa.list_(pa.binary()))], names=["toxic", "windows"])


def _features(ordinary: bytes, toxic: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gauge = Gauge(ordinary, toxic)
        for batch in batches:
            out = [gauge.features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(out, pa.list_(pa.float64()))], names=["toxic", "features"])

    return run


def _scores(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gauge = Gauge(model.ordinary, model.toxic) if model else None
        for batch in batches:
            n = batch.num_rows
            scores = model.score(np.array([gauge.features(t) for t in batch["text"].to_pylist()]).reshape(n, FEATURES)) if model and n else np.zeros(n)
            index = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in index), pa.array(scores)], names=[*(batch.schema.names[i] for i in index), "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, toxic_weight: float = 2.0) -> Model | None:
    """A model from the labelled documents that are not held out; None without both classes.
    ``toxic_weight`` is how many times a toxic document counts against its share."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return None
    by_hash = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (0, 1)]
    chosen = F.broadcast(by_hash[0].union(by_hash[1]))  # 2 x per_class rows at most
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("toxic", "text")
    rows = texts.mapInArrow(_windows, "toxic int, windows array<binary>").collect()
    sides = [[[bytes(w) for w in r["windows"]] for r in rows if r["toxic"] == t] for t in (0, 1)]
    if not sides[0] or not sides[1]:
        return None
    sides = [list({b" ".join(d): d for d in side}.values()) for side in sides]
    ordinary, toxic = train_dictionaries(sides[1], sides[0])
    measured = texts.mapInArrow(_features(ordinary, toxic), "toxic int, features array<double>").collect()
    x, y = np.array([r["features"] for r in measured]), np.array([r["toxic"] for r in measured], float)
    share = {t: total[t] / max(1, (y == t).sum()) for t in (0, 1)}
    weights = np.where(y == 1, share[1] * toxic_weight, share[0])
    return Model(ordinary, toxic, *calibrate(x, y, weights / weights.mean()))


def toxicity_scores(docs: DataFrame, model: Model | None, keep_columns: tuple[str, ...] = (), below: float | None = None) -> DataFrame:
    """(doc_id, ``keep_columns``, score) for every row of ``docs``; with ``below`` only rows of smaller scores, without the score."""
    rows = with_ids(docs, F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep_columns)))
    extra = [f for f in rows.schema.fields if f.name.startswith("keep_")]
    schema = ", ".join(["doc_id long", *(f"{f.name} {f.dataType.simpleString()}" for f in extra), "score double"])
    scored = rows.select("doc_id", *(f.name for f in extra), "text").mapInArrow(_scores(model), schema)
    kept = [real_id(), *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep_columns))]
    return scored.select(*kept, "score") if below is None else scored.where(F.col("score") < below).select(*kept)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = toxicity_scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
