"""LM scoring: a class-factored gated recurrent model, trained and averaged over all partitions, scores every whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .shared import crc_mod, materialize
from .textcore import NOT_SPACE, slices, span_hashes, token_bounds

FOLDS = 10
#: Words with an output of their own in the network; words whose counts are broadcast. Both bound what tasks hold; the counts
#: of all other words are joined in.
NETWORK_WORDS, HEAD_WORDS = 2048, 200_000
#: Rounds of averaging; each learns from every token of all training texts.
ROUNDS = 2
#: Replicas of the network that are averaged in one group.
FAN = 32
END = np.uint64(0x51ED270B8F1D6A35)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words, each row closed by an end, and the first of each row."""
    starts, ends, firsts = token_bounds(data, offsets, NOT_SPACE)
    out = np.full(len(starts) + len(offsets) - 1, END, np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    out[np.arange(len(starts)) + row] = span_hashes(data, starts, ends)
    return out, firsts + np.arange(len(offsets))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [token_hashes(data, offsets)[0] for _, _, data, offsets in slices(batch["text"])]
        found = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        firsts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[firsts].view(np.int64)), pa.array(np.diff(np.append(firsts, len(found))))], ["word", "n"])


class Lexicon:
    """The most frequent words: counts, and which of them the network knows."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, kinds: int) -> None:
        order = np.lexsort((words, -counts))
        words, counts = words[order], counts[order]
        n = min(NETWORK_WORDS, len(words))
        self.known = n
        self.network_counts = counts[:n].astype(np.float64)
        self.firsts = gru.make_classes(self.network_counts) if n else np.zeros(0, np.int64)
        self.rest, self.rest_kinds = total - int(counts[:n].sum()), kinds - n
        self.total, self.kinds = total, kinds
        rank = np.argsort(words)
        self.words, self.counts, self.rank = words[rank], counts[rank], rank

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The network's id of each word, and its count or -1 where the lexicon hasn't got it."""
        spare = self.known + (hashes % np.uint64(gru.SPARE)).astype(np.int64)
        if not len(self.words):
            return spare, np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        here = self.words[at] == hashes
        rank = self.rank[at]
        return np.where(here & (rank < self.known), rank, spare), np.where(here, self.counts[at], -1)

    def model(self) -> gru.Model:
        return gru.Model(self.firsts, self.network_counts, self.rest + 0.1 * (self.rest_kinds + 1))


def _lexicon(counts: DataFrame) -> tuple[Lexicon, int]:
    """Built on the driver from HEAD_WORDS words at most: those above a count that so many words reach."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kinds")).first()
    steps = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()  # 100,000 rows at most
    held, least = 0, 1 << 62
    for n, words in sorted(((r["n"], r["words"]) for r in steps), reverse=True):
        held += words
        if held > HEAD_WORDS:
            break
        least = n
    head = counts.where(F.col("n") >= least).toPandas()
    return Lexicon(head["word"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64), sums["total"], sums["kinds"])


def _train_round(lexicon, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        model = known.model()
        if weights is not None:
            model.unpack(weights.value)
        seen = 0
        for batch in batches:
            texts = []
            for _, _, data, offsets in slices(batch["text"]):
                hashes, firsts = token_hashes(data, offsets)
                ids = known.look_up(hashes)[0].astype(np.int32)
                texts.extend(ids[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True))
            seen += gru.train(model, texts)
        if seen:
            row = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]), pa.array([model.pack().tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["replica", "seen", "weights"])

    return run


def _average(table):
    rows = list(zip(table["seen"].to_pylist(), table["weights"].to_pylist(), strict=True))
    total = sum(n for n, _ in rows)
    mean = sum(np.frombuffer(w, np.float32) * np.float32(n / total) for n, w in rows)
    return pa.table({"replica": pa.array([table["replica"][0].as_py() // FAN], pa.int64()), "seen": pa.array([total]), "weights": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def _trained(texts: DataFrame, lexicon) -> np.ndarray:
    """Weights after ROUNDS rounds: in each, every partition learns from every token of its training texts on a replica of the last round's
    mean, and the replicas are averaged, FAN at a time, until FAN at most reach the driver."""
    spark, weights = texts.sparkSession, None
    schema = "replica long, seen double, weights binary"
    for _ in range(ROUNDS):
        replicas = texts.mapInArrow(_train_round(lexicon, None if weights is None else spark.sparkContext.broadcast(weights)), schema)
        n = texts.rdd.getNumPartitions()
        while n > FAN:
            replicas = replicas.groupBy(F.floor(F.col("replica") / FAN)).applyInArrow(_average, schema)
            n = -(-n // FAN)
        rows = replicas.collect()
        if not rows:
            return lexicon.value.model().pack()
        total = sum(r["seen"] for r in rows)
        weights = sum(np.frombuffer(r["weights"], np.float32) * np.float32(r["seen"] / total) for r in rows)
    return weights


def _scorer(lexicon, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        model = known.model()
        model.unpack(weights.value)
        model.ready()
        base_bottom = np.log10(known.total + 0.1 * (known.kinds + 1))
        rest_bottom = np.log10(known.rest + 0.1 * (known.rest_kinds + 1))
        task, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, sizes, hits, base, extra, tails, times = [], [], [], [], [], [], []
            for _, _, data, offsets in slices(batch["text"]):
                hashes, firsts = token_hashes(data, offsets)
                ids, counts = known.look_up(hashes)
                here = counts >= 0
                logs = np.where(here, np.log10(np.maximum(counts, 0) + 0.1), 0.0)
                outside = ids >= known.known
                for values, to in ((here, hits), (logs - base_bottom, base), (np.where(outside, logs - rest_bottom, 0.0), extra)):
                    to.append(np.add.reduceat(values.astype(np.float64), firsts[:-1]))
                for a, b in zip(firsts[:-1], firsts[1:], strict=True):
                    texts.append(ids[a:b].astype(np.int32))
                    far = np.sort(hashes[a:b][~here[a:b]])
                    new = np.flatnonzero(np.concatenate(([True], far[1:] != far[:-1]))) if len(far) else np.zeros(0, np.int64)
                    tails.append(far[new].view(np.int64))
                    times.append(np.diff(np.append(new, len(far))))
                sizes.append(np.diff(firsts))
            if not texts:
                continue
            found = gru.score(model, texts) / np.log(10)
            stops = pa.array(np.cumsum([0] + [len(x) for x in tails]), pa.int32())
            n = len(texts)
            columns = [
                pa.array((np.int64(task) << np.int64(33)) + nth + np.arange(n)), batch["doc_id"], batch["held_out"], pa.array(np.concatenate(sizes)), pa.array(np.concatenate(hits).astype(np.int64)),
                pa.array(np.concatenate(base)), pa.array(found + np.concatenate(extra)), pa.ListArray.from_arrays(stops, pa.array(np.concatenate(tails))), pa.ListArray.from_arrays(stops, pa.array(np.concatenate(times))),
            ]
            nth += n
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail", "times"])

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Tokens are the words between ASCII white space, A-Z folded, and one end. Texts whose crc32(doc_id) mod FOLDS is 0 are held out
    (as are rows without a doc_id); counts and network learn from all others. base_score is the smoothed unigram model's, score the
    network's: P(class | what came before) P(word | class, what came before), where words beyond NETWORK_WORDS form one class and
    share it by their smoothed counts. A null or empty text is an end alone. Without training texts both models still give finite
    scores. Repeated rows are scored alike and, unless held out, counted each. A very long text is scored window by window, in memory of
    its own length. No rows give no rows. Other columns are not looked at. The network's weights hang on how the rows are parted,
    as every partition trains a replica: the same rows in other files give other scores, within what another seed would.

    Counts of words beyond HEAD_WORDS are joined to the texts' rarer words by shuffles; each row's scores are then completed.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"))
    learn = rows.where("NOT held_out").select("text")
    counts = materialize(learn.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    known = _lexicon(counts)
    lexicon = sc.broadcast(known)
    weights = sc.broadcast(_trained(learn, lexicon))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<long>, times array<long>"
    passed = materialize(rows.mapInArrow(_scorer(lexicon, weights), schema))
    tails = passed.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    met = tails.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(n + 0.1)).alias("logs"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("met")
    )
    done = passed.drop("tail", "times").join(met, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
