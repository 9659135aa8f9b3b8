"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod
from .textcore import ALNUM, SpanHashes, chain, column_bytes, distinct, mix, release, released, slices, token_bounds, window_rows

#: Labelled texts that the model learns from, and their bytes, at most: those whose ids hash lowest. What doesn't fit is passed over.
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 1 << 26
BITS = 20
#: Positions of a gram's words: single words, pairs, pairs with one or two words between them.
GRAMS = ((0,), (0, 1), (0, 2), (0, 3))
#: Leading bytes of a word that stand for it as one more word, for languages that build words from parts.
STEMS = (4, 6, 8)


def _keys(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (rows.astype(np.uint64) << np.uint64(BITS)) | (hashes >> np.uint64(64 - BITS))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of all rows, row by row, and the first of each row."""
    starts, ends, firsts = token_bounds(data, offsets, ALNUM)
    spans = SpanHashes(data)
    hashes = spans(starts, ends)
    keys = []
    for size in STEMS:
        long = np.flatnonzero(ends - starts > size)
        rows = np.searchsorted(firsts, long, side="right") - 1
        keys.append(_keys(rows, mix(spans(starts[long], starts[long] + size) + np.uint64(100 + size))))
    for gram in GRAMS:
        pos, rows = window_rows(firsts, gram[-1] + 1)
        keys.append(_keys(rows, mix(chain(hashes, gram)[pos] + np.uint64(gram[-1]))))
    keys = distinct(np.concatenate(keys))
    firsts = np.searchsorted(keys, np.arange(len(offsets), dtype=np.uint64) << np.uint64(BITS))
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int32), firsts


def packed(at: np.ndarray) -> bytes:
    """Sorted places below 2 ** BITS: how many there are for each leading value, and the last 16 bits of each."""
    return np.bincount(at >> 16, minlength=1 << (BITS - 16)).astype(np.uint32).tobytes() + at.astype(np.uint16).tobytes()


def unpacked(raw: np.ndarray) -> np.ndarray:
    head = 4 << (BITS - 16)
    counts = raw[:head].view(np.uint32)
    return np.repeat(np.arange(len(counts), dtype=np.int32) << 16, counts) + raw[head:].view(np.uint16)


class FTRL:
    """Per-coordinate learning rates; a coordinate stays zero until its gradients outweigh the L1 term."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last one is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w[:-1])
        return at.astype(np.int32), w[at].astype(np.float32), float(w[-1])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for low, high, data, offsets in slices(batch["text"]):
            at, firsts = features(data, offsets)
            out += [packed(at[firsts[k] : firsts[k + 1]]) for k in range(high - low)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(out, pa.binary())], ["doc_id", "toxic", "features"])


def _sample(docs: DataFrame, labels: DataFrame, folds: int, rows: int, size: int) -> list[tuple[int, int]]:
    """(doc_id, toxic) of the documents to learn from: `rows` of them at most, and `size` bytes, all rows of a doc_id together."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), folds) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).join(F.broadcast(known), "doc_id")  # of `rows` rows at most
    found = found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.count(F.lit(1)).alias("times"), F.sum("size").alias("size"))
    out, n, held = [], 0, 0
    for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # again `rows` rows at most
        if n + r["times"] <= rows and held + r["size"] <= size:
            out.append((r["doc_id"], r["toxic"]))
            n, held = n + r["times"], held + r["size"]
    return out


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, epochs: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (places, values, bias) learnt from at most sample_rows labelled rows, of sample_bytes at most, that are not held out.

    The sample's features are made where the texts lie; one task learns from them in a fixed order, and only the weights that L1
    leaves come to the driver. A doc_id labelled more than once is toxic if any label says so; null ids and labels don't count.
    """
    known = docs.sparkSession.createDataFrame(_sample(docs, labels, folds, sample_rows, sample_bytes), "doc_id long, toxic int")
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")  # of sample_rows rows at most
    made = sample.mapInArrow(released(_featurise), "doc_id long, toxic int, features binary")

    def learn(key, table):
        ids, y, x = table["doc_id"].to_numpy(), table["toxic"].to_numpy(), []
        for column in table["features"].chunks:  # looked at where they lie; not copied into objects, whose memory a worker would keep
            data, offsets = column_bytes(column)
            x += [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        mixed = mix(ids.astype(np.uint64))
        model = FTRL()
        for epoch in range(epochs):
            for k in np.lexsort((np.array([len(v) for v in x]), mix(mixed + np.uint64(epoch)))):
                model.learn(unpacked(x[k]), int(y[k]))
        at, w, bias = model.sparse()
        del model, x
        release()
        return pa.table({"places": pa.array([at.tobytes()], pa.binary()), "values": pa.array([w.tobytes()], pa.binary()), "bias": pa.array([bias])})

    rows = made.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "places binary, values binary, bias double").collect()
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    return np.frombuffer(rows[0]["places"], np.int32), np.frombuffer(rows[0]["values"], np.float32), rows[0]["bias"]


def _scores(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    out = []
    for low, high, data, offsets in slices(column):
        at, firsts = features(data, offsets)
        sums = np.concatenate(([0.0], np.cumsum(weights[at])))
        out.append(1 / (1 + np.exp(-np.clip(sums[firsts[1:]] - sums[firsts[:-1]] + bias, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def _dense(model) -> tuple[np.ndarray, float]:
    places, values, bias = model.value
    weights = np.zeros(1 << BITS)
    weights[places] = values
    return weights, bias


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for each row of docs.

    Only texts are inputs of a score. A null or empty text has the score of the bias alone. A null doc_id counts as held out.
    Without labels every score is 0.5. Repeated rows are scored alike; a very long text is scored by itself, in memory of its own length; no
    rows give no rows. Other columns are not looked at. The model learns from at most sample_rows labelled rows of sample_bytes in all.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, sample_rows, sample_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = _dense(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(_scores(batch["text"], weights, bias))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns, whatever these are called.

    A null or empty text has the score of the bias alone, and a null doc_id or a repeated row is like any other. A very long text is
    scored by itself, in memory of its own length. No rows give no rows; without labels nothing is known, and all rows stay.
    """
    places, values, bias = train(docs, labels, folds, sample_rows, sample_bytes)
    if not len(places) and not bias:
        return docs
    model = docs.sparkSession.sparkContext.broadcast((places, values, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = _dense(model)
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch["text"], weights, bias) < threshold))

    return docs.mapInArrow(released(run), docs.schema)
