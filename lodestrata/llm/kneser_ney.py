"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text, and perplexity bounds for each language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lm_score import END, token_hashes
from .shared import Scratch, crc_mod, materialize, shuffles_cleared
from .textcore import mix, slices

#: Nothing is broadcast any more; kept for callers that set it.
HEAD_GRAMS = 500_000
#: A fifth of trusted texts isn't learnt from: their perplexities give the bounds.
FOLDS = 5
#: Shares of a language's trusted texts that lie below the lower and below the upper bound.
LOW, HIGH = 0.002, 0.99
#: Held-out trusted texts of a language at which its own quantiles weigh as much as those of all.
HALFWAY = 100
#: Rows of bounds that are broadcast at most.
BROADCAST_LANGUAGES = 10_000
START = 0x2545F4914F6CDD1D
#: Parts that words are dealt to at most, and tokens of all texts for each; tokens of all texts for each shard of a part.
PARTS, PART_TOKENS, SHARD_TOKENS = 6, 1 << 21, 1 << 20
#: Triplets of a batch that are held before they are packed.
HELD_TOKENS = 1 << 21
#: Tasks at most in which words' counts are summed.
PLACES = 256
#: Sorted hashes pack well as places in a dictionary.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": 1 << 24}


def _part(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _grams(part: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch["text"]):
                a, b, c, _ = _contexts(data, offsets)
                mine = _part(b, parts) == part
                yield pa.RecordBatch.from_arrays([pa.array(x[mine].view(np.int64)) for x in (a, b, c)], ["a", "b", "c"])

    return run


def _contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token the one two before, the one before, itself, and the first token of each row; texts begin with two starts."""
    c, firsts = token_hashes(data, offsets)
    b, a = np.roll(c, 1), np.roll(c, 2)
    heads = firsts[:-1]
    b[heads] = a[heads] = np.uint64(START)
    seconds = heads[np.diff(firsts) > 1] + 1
    a[seconds] = np.uint64(START)
    return a, b, c, firsts


def _key(*parts: np.ndarray) -> np.ndarray:
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for x in parts:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + x)
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What a count of one, two, three or more gives away; a half, one, and one and a half where counts of counts are missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * after / n, 0.0), float(k)) for k, n, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discounted(counts: DataFrame) -> tuple[Column, Column, Column]:
    """Of an order's counts n: each one's discount, and for a group of them what they give away and their sum."""
    found = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    d1, d2, d3 = discounts(*found)
    own = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    return own, F.sum(own), F.sum("n")


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-300)))


class Counts:
    """Counts of some texts' grams: trigrams, and for lower orders the different words before a gram (or, after a start, the gram itself).

    Trigrams go by their middle word into parts, which are counted one after the other, so that only one part's shuffles are on disk at
    a time; a part has all trigrams of its pairs, and all pairs of their first words. Tables are sorted, as that packs best."""

    def __init__(self, texts: DataFrame, parts: int, scratch: Scratch) -> None:
        start = np.uint64(START).astype(np.int64).item()
        self.three, self.two = [], []
        for k in range(parts):
            grams = texts.select("text").mapInArrow(_grams(k, parts), "a long, b long, c long")
            three = grams.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))
            self.three.append(scratch.table(three.sortWithinPartitions("b", "a", "c"), **PACKED))
            two = self.three[k].groupBy("b", "c").agg(F.when(F.col("b") == start, F.sum("n")).otherwise(F.count(F.lit(1))).alias("n"))
            self.two.append(scratch.table(two.sortWithinPartitions("b", "c"), **PACKED))
        one = scratch.table(reduce(DataFrame.union, [x.groupBy("c").agg(F.count(F.lit(1)).alias("n")) for x in self.two]).groupBy("c").agg(F.sum("n").alias("n")))
        own, given, total = _discounted(one)
        whole = one.agg(given.alias("given"), total.alias("total"), F.count(F.lit(1)).alias("kinds")).first()
        total, lost, kinds = whole["total"] or 1, 1.0 if whole["total"] is None else whole["given"] / whole["total"], whole["kinds"]
        self.unknown = lost / (kinds + 1)
        self.one = scratch.table(one.select("c", "n", ((F.col("n") - own) / total + self.unknown).alias("p")))
        self.off = [_discounted(reduce(DataFrame.union, x)) for x in (self.two, self.three)]

    def part(self, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Of one part (b, c, n, p, gain), (b, weight, total), (a, b, c, n, p, gain), (a, b, weight, total): counts joined with their
        contexts and with the next lower order. The rows of one context are dealt once for its sum and for its grams."""
        two, three = self.two[k].repartition("b"), self.three[k].repartition("a", "b")
        left = F.col("weight") * F.col("below")
        gain = lambda mixed: _log(mixed) - _log(F.col("weight")) - _log(F.col("below"))  # noqa: E731  as terms are added, also where a weight is 0
        own, given, total = self.off[0]
        w2 = two.groupBy("b").agg((given / total).alias("weight"), total.alias("total"))
        mixed = (F.col("n") - own) / F.col("total") + left
        p2 = self.two[k].join(w2, "b").join(self.one.select("c", F.col("p").alias("below")), "c").select("b", "c", "n", mixed.alias("p"), gain(mixed).alias("gain"))
        own, given, total = self.off[1]
        w3 = three.groupBy("a", "b").agg((given / total).alias("weight"), total.alias("total"))
        mixed = (F.col("n") - own) / F.col("total") + left
        p3 = three.join(w3, ["a", "b"]).join(p2.select("b", "c", F.col("p").alias("below")), ["b", "c"]).select("a", "b", "c", "n", mixed.alias("p"), gain(mixed).alias("gain"))
        return p2, w2, p3, w3


def kneser_ney(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model of some texts as two tables: (order, a, b, c, p, n, gain), the probability of c after a b, after b, or by itself, and
    (order, a, b, weight, total), what a context leaves to the next lower order. Order 0 has the probability of a word not met.
    n is a gram's count, total its context's; gain is the natural log of p over what backing off would give."""
    counts = Counts(texts, 1, Scratch(texts.sparkSession))
    p1, unknown, (p2, w2, p3, w3) = counts.one, counts.unknown, counts.part(0)
    none = F.lit(None).cast("long")
    spark = texts.sparkSession
    p0 = spark.range(1).select(F.lit(0).alias("order"), none.alias("a"), none.alias("b"), none.alias("c"), F.lit(unknown).alias("p"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("gain"))
    p1 = p1.select(F.lit(1), none, none, "c", "p", "n", _log(F.col("p")) - _log(F.lit(unknown)))
    p = p0.union(p1).union(p2.select(F.lit(2), none, "b", "c", "p", "n", "gain")).union(p3.select(F.lit(3), "a", "b", "c", "p", "n", "gain"))
    weights = w2.select(F.lit(2).alias("order"), none.alias("a"), "b", "weight", "total").union(w3.select(F.lit(3), "a", "b", "weight", "total"))
    return p, weights


class Tables:
    """The model for look-up: sorted keys and natural logs."""

    def __init__(self, p: pa.Table, weights: pa.Table) -> None:
        self.unknown = float("-inf")
        self.p, self.weight = {}, {}
        for rows, names, out, value in ((p, "abc", self.p, "p"), (weights, "ab", self.weight, "weight")):
            order = rows["order"].to_numpy()
            for k in (0, 1, 2, 3):
                own = rows.filter(pa.array(order == k))
                logs = np.log(np.maximum(own[value].to_numpy(), 1e-300)).astype(np.float32)
                if k == 0:
                    self.unknown = float(logs[0]) if len(logs) else self.unknown
                    continue
                columns = names[-k:] if value == "p" else names[3 - k :]
                if columns:
                    keys = _key(*[own[x].to_numpy().view(np.uint64) for x in columns])
                    rank = np.argsort(keys)
                    out[k] = keys[rank], logs[rank]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        here = table[0][at] == keys
        return here, np.where(here, table[1][at], np.float32(0))

    def log_likelihood(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of each text's probability, and its number of tokens."""
        a, b, c, firsts = _contexts(data, offsets)
        here, out = self._find(self.p[1], _key(c))
        out = np.where(here, out, np.float32(self.unknown)).astype(np.float64)
        seen, back = self._find(self.weight[2], _key(b))
        known, p = self._find(self.p[2], _key(b, c)) if len(c) else (here, out)
        out = np.where(known, p, out + back)
        context, back = self._find(self.weight[3], _key(a, b))
        both = np.flatnonzero(context)
        out += np.where(context, back, 0)
        found, p = self._find(self.p[3], _key(a[both], b[both], c[both]))
        out[both[found]] = p[found]
        return np.add.reduceat(out, firsts[:-1]) if len(firsts) > 1 else np.zeros(0), np.diff(firsts)


def _context(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of a pair as a context, which is another than its key as a gram."""
    return mix(_key(a, b) + np.uint64(4))


def _names(ids: pa.Array, c: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A hash of each row's doc_id and tokens: rows that share one are judged alike."""
    if not len(ids):
        return np.zeros(0, np.int64)
    place = np.arange(len(c)) - np.repeat(firsts[:-1], np.diff(firsts))
    text = np.add.reduceat(mix(c + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), firsts[:-1])
    own = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) + ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(START))
    return mix(text ^ own).view(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch["text"]):
            c, firsts = token_hashes(data, offsets)
            own = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays([pa.array(_names(own["doc_id"], c, firsts)), own["doc_id"], own["lang"], pa.array(np.diff(firsts))], ["row", "doc_id", "lang", "n_tokens"])


def _homes(words: np.ndarray, homes: int) -> np.ndarray:
    return ((words >> np.uint64(24)) % np.uint64(homes)).astype(np.int32)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte of like worth, which packs best."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(raw: memoryview, kind: type) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _steps(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.zeros(1, keys.dtype)))


def _packed(a: np.ndarray, b: np.ndarray, c: np.ndarray, rows: np.ndarray | None = None) -> bytes:
    """Triplets, and the text that each one is of, in order of middle words: different words once, then places among them."""
    words, at = np.unique(np.concatenate((b, a, c)), return_inverse=True)
    b, a, c = at.astype(np.uint32).reshape(3, -1)
    order = np.argsort(b, kind="stable")
    columns = [np.diff(b[order], prepend=np.uint32(0)), a[order], c[order]] + ([] if rows is None else [rows[order].astype(np.uint32)])
    return np.array([len(words), len(b)], np.int64).tobytes() + _steps(words) + b"".join(map(_planes, columns))


def _unpacked(raw: bytes) -> list[np.ndarray]:
    """Words a, b and c of triplets, and their texts if they were packed."""
    n_words, n = np.frombuffer(raw[:16], np.int64).tolist()
    raw = memoryview(raw)[16:]
    words = np.cumsum(_numbers(raw[: 8 * n_words], np.uint64))
    b, a, c, *rows = (_numbers(raw[k : k + 4 * n], np.uint32) for k in range(8 * n_words, len(raw), 4 * n)) if n else [np.zeros(0, np.uint32)] * 3
    return [words[a], words[np.cumsum(b)], words[c], *rows]


def _sent(first: int, last: int, homes: int, shards: int, asks: bool):
    """For each batch of texts the triplets of each home from first to before last, which is that of the middle word; with asks, their texts too, and
    the texts' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, task = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()

        def packed(parts: list[tuple[np.ndarray, ...]]) -> tuple[list[bytes], list[int]]:
            home, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(home.astype(np.int16) if homes < 1 << 15 else home, kind="stable")
            edges = np.searchsorted(home[order], np.arange(first, last + 1))
            full = np.flatnonzero(np.diff(edges))
            a, b, c, row = (x[order] for x in columns)
            edges = zip(edges[full].tolist(), edges[full + 1].tolist(), strict=True)
            return [press.compress(_packed(a[i:j], b[i:j], c[i:j], row[i:j] if asks else None)) for i, j in edges], (full + first).tolist()

        def out(block: int, packs: list[bytes], own: list[int], kind: int) -> pa.RecordBatch:
            home, n = np.array(own, np.int32), len(own)
            columns = [pa.array(home % shards), pa.array(home), pa.array([kind] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array(packs, pa.binary()), pa.nulls(n, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, SENT_NAMES)

        for nth, batch in enumerate(batches):
            parts, names, held, block = [], [], 0, (task << 24) + nth
            for low, high, data, offsets in slices(batch["text"]):
                a, b, c, firsts = _contexts(data, offsets)
                home = _homes(b, homes)
                mine = np.flatnonzero((home >= first) & (home < last))
                row = np.repeat(np.arange(low, high, dtype=np.uint32), np.diff(firsts))[mine]
                parts.append((home[mine], a[mine], b[mine], c[mine], row))
                held += len(mine)
                if asks:
                    names.append(_names(batch["doc_id"].slice(low, high - low), c, firsts))
                if held > HELD_TOKENS:
                    yield out(block, *packed(parts), ASKS if asks else LEARNT)
                    parts, held = [], 0
            if held:
                yield out(block, *packed(parts), ASKS if asks else LEARNT)
            if names:
                yield out(block, [np.concatenate(names).tobytes()], [first + block % (last - first)], NAMES)

    return run


#: What is sent to a shard: texts' names, what texts ask for, triplets to learn from, and counts of words.
NAMES, ASKS, LEARNT, WORDS = range(4)
SENT = "shard int, home int, kind int, block long, payload binary, n binary"
SENT_NAMES = [x.split()[0] for x in SENT.split(", ")]


class Home:
    """Counts of the triplets of some middle words: all grams of these words, and all contexts that end in one."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        self.three, at, self.n3 = np.unique(_key(a, b, c), return_index=True, return_counts=True)
        a, b, c = a[at], b[at], c[at]
        self.contexts, self.context_of = np.unique(_context(a, b), return_inverse=True)
        self.two, at, self.pair_of = np.unique(_key(b, c), return_index=True, return_inverse=True)
        self.b, self.c = b[at], c[at]
        sums = np.bincount(self.pair_of, weights=self.n3, minlength=len(at)).astype(np.int64)
        self.n2 = np.where(self.b == np.uint64(START), sums, np.bincount(self.pair_of, minlength=len(at)))
        self.words, self.word_of = np.unique(self.b, return_inverse=True)

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The words whose counts this home needs, an end among them, and how many different words here stand before each."""
        words, at = np.unique(np.concatenate((self.c, self.words, [END])), return_inverse=True)
        return words, np.bincount(at[: len(self.c)], minlength=len(words))

    def terms(self, words: np.ndarray, n: np.ndarray, off: Discounts) -> tuple[np.ndarray, np.ndarray]:
        """Keys and terms of all grams and contexts: a text's log-likelihood is the sum of the terms of its triplets, pairs, contexts and middle
        words, and for each token the log of a word not met.

        Backing off multiplies the weights of contexts, so that a gram's term is the log of what it gains over backing off, and a context's that
        of its weight; a gram that isn't in the model has none. A word's term is its gain as a word and its weight as a context; the
        start has its weight, and the gain of the end that closes the text."""
        p1 = off.word(n)
        own = off.own(1, self.n2)
        total = np.bincount(self.word_of, weights=self.n2, minlength=len(self.words))
        w2 = np.bincount(self.word_of, weights=own, minlength=len(self.words)) / np.maximum(total, 1)
        below = p1[np.searchsorted(words, self.c)]
        left = w2[self.word_of]
        p2 = (self.n2 - own) / total[self.word_of] + left * below
        g2 = _logs(p2) - _logs(left) - _logs(below)
        own = off.own(2, self.n3)
        total = np.bincount(self.context_of, weights=self.n3, minlength=len(self.contexts))
        w3 = np.bincount(self.context_of, weights=own, minlength=len(self.contexts)) / np.maximum(total, 1)
        below, left = p2[self.pair_of], w3[self.context_of]
        g3 = _logs((self.n3 - own) / total[self.context_of] + left * below) - _logs(left) - _logs(below)
        as_word = np.where(self.words == np.uint64(START), END, self.words)
        g1 = _logs(p1[np.searchsorted(words, as_word)]) - np.log(off.unknown)
        keys = np.concatenate((_key(self.words), self.two, self.contexts, self.three))
        order = np.argsort(keys)
        return keys[order], np.concatenate((g1 + _logs(w2), g2, _logs(w3), g3))[order]


def _logs(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-300))


class Discounts(NamedTuple):
    """Of each order, from words on; the sum of words' counts, and the probability of a word not met."""

    orders: list[tuple[float, float, float]]
    total: float
    unknown: float

    def own(self, k: int, n: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.orders[k]])[np.minimum(n, 3)]

    def word(self, n: np.ndarray) -> np.ndarray:
        return (n - self.own(0, n)) / self.total + self.unknown


#: What is found of an order's counts: how many are one, two, three and four, how many there are, and their sum.
FOUND = 6


def _found(n: np.ndarray) -> list[int]:
    few = np.bincount(np.minimum(n, 5), minlength=6)
    return [*few[1:5].tolist(), int((n > 0).sum()), int(n.sum())]


def _settled(found: list[int]) -> Discounts:
    orders = [discounts(*found[k : k + 4]) for k in range(0, 3 * FOUND, FOUND)]
    n1, n2, _, _, kinds, total = found[:FOUND]
    d1, d2, d3 = orders[0]
    lost = (n1 * d1 + n2 * d2 + (kinds - n1 - n2) * d3) / total if total else 1.0
    return Discounts(orders, float(total or 1), lost / (kinds + 1))


def _homes_of(packs: list[bytes]) -> Home:
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    parts = [_unpacked(unpress.decompress(x)) for x in packs]
    return Home(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else Home(*[np.zeros(0, np.uint64)] * 3)


def _counted(places: int):
    """Each home's words that it needs counts of, in parts by the word, and what is found of its pairs' and triplets' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packs, press = {}, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for home, x in zip(batch["home"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                packs.setdefault(home, []).append(x)
        for home in sorted(packs):
            model = _homes_of(packs.pop(home))
            words, n = model.asked()
            place = _homes(mix(words), places)
            order = np.argsort(place, kind="stable")
            edges = np.searchsorted(place[order], np.arange(places + 1)).tolist()
            words, n = words[order], n[order]
            found = [[0] * FOUND + _found(model.n2) + _found(model.n3)] + [[0] * 3 * FOUND] * (places - 1)
            packed = [[press.compress(f(x[i:j])) for i, j in zip(edges[:-1], edges[1:], strict=True)] for f, x in ((_steps, words), (_planes, n))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(places, dtype=np.int32)), pa.array([home] * places, pa.int32()), *(pa.array(x, pa.binary()) for x in packed), pa.array(found, pa.list_(pa.int64()))], ["place", "home", "payload", "n", "found"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that homes asked for, now with counts over all homes, and what is found of these."""
    import zstandard

    rows = [x for batch in batches for x in batch.to_pylist()]
    press, unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    keys = [np.cumsum(_numbers(memoryview(unpress.decompress(x["payload"])), np.uint64)) for x in rows]
    if not rows:
        return
    words, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([_numbers(memoryview(unpress.decompress(x["n"])), np.int64) for x in rows]), minlength=len(words)).astype(np.int64)
    found, begin = _found(n), 0
    for x, own in zip(rows, keys, strict=True):
        sums = n[at[begin : begin + len(own)]]
        begin += len(own)
        whole = [a + b for a, b in zip(x["found"], found + [0] * 2 * FOUND, strict=True)]
        found = [0] * FOUND
        yield pa.RecordBatch.from_arrays([pa.array([x["home"]], pa.int32()), pa.array([x["payload"]], pa.binary()), pa.array([press.compress(_planes(sums))], pa.binary()), pa.array([whole], pa.list_(pa.int64()))], ["home", "payload", "n", "found"])


def _answers(off: Discounts, blocks: int):
    """Of a home's words and triplets, and what is asked of it: for each text of a block what its grams there sum up to; and names as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, unpress, held = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), {k: [] for k in (NAMES, ASKS, LEARNT, WORDS)}
        out = lambda block, names, logs: pa.RecordBatch.from_arrays([pa.array([block % blocks], pa.int32()), pa.array([block], pa.int64()), pa.array([names], pa.binary()), pa.array([logs], pa.binary())], ["to", "block", "names", "logs"])
        for batch in batches:
            for x in batch.select(["kind", "block", "payload", "n"]).to_pylist():
                if x["kind"] == NAMES:
                    yield out(x["block"], x["payload"], None)
                else:
                    held[x["kind"]].append(x)
        if not held[LEARNT]:
            return
        model = _homes_of([x["payload"] for x in held.pop(LEARNT)])
        words = np.concatenate([np.cumsum(_numbers(memoryview(unpress.decompress(x["payload"])), np.uint64)) for x in held[WORDS]])
        n = np.concatenate([_numbers(memoryview(unpress.decompress(x["n"])), np.int64) for x in held.pop(WORDS)])
        order = np.argsort(words)
        term = _LookUp(*model.terms(words[order], n[order], off))
        del model
        for x in held[ASKS]:
            a, b, c, row = _unpacked(unpress.decompress(x["payload"]))
            firsts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))  # triplets are in order of middle words
            times = np.diff(np.append(firsts, len(b)))
            here, found = term(_key(b[firsts]))
            known = np.flatnonzero(np.repeat(here, times))  # a word that the model hasn't got is in none of its grams
            sums = np.repeat(found, times)[known]
            a, b, c, row = a[known], b[known], c[known], row[known]
            sums += term(_key(b, c))[1]
            here, found = term(_context(a, b))
            sums += found
            both = np.flatnonzero(here)
            sums[both] += term(_key(a[both], b[both], c[both]))[1]
            logs = np.bincount(row, weights=sums)
            met = np.flatnonzero(logs)
            yield out(x["block"], None, press.compress(np.array([len(met)]).tobytes() + _planes(np.diff(met, prepend=0).astype(np.uint32)) + logs[met].tobytes()))

    return run


class _LookUp:
    """Terms by sorted keys, which are even over their range: leading bits say where a key would be, a few steps at most before it is there."""

    def __init__(self, keys: np.ndarray, terms: np.ndarray) -> None:
        bits = max(len(keys).bit_length(), 1) + 1
        self.shift = np.uint64(64 - bits)
        self.begins = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys, self.terms = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(terms, 0.0)

    def __call__(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.begins[asked >> self.shift]
        behind = np.flatnonzero(self.keys[at] < asked)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < asked[behind]]
        here = (self.keys[at] == asked) & (at < len(self.keys) - 1)
        return here, np.where(here, self.terms[at], 0.0)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of each block's texts and the sums of what homes have answered."""
    import zstandard

    unpress, names, answers = zstandard.ZstdDecompressor(), {}, {}
    for batch in batches:
        for x in batch.to_pylist():
            if x["names"] is None:
                answers.setdefault(x["block"], []).append(x["logs"])
            else:
                names[x["block"]] = x["names"]
    for block, x in names.items():
        row = np.frombuffer(x, np.int64)
        logs = np.zeros(len(row))
        for raw in answers.pop(block, []):
            raw = memoryview(unpress.decompress(raw))
            n = int(np.frombuffer(raw[:8], np.int64)[0])
            logs[np.cumsum(_numbers(raw[8 : 8 + 4 * n], np.uint32))] += np.frombuffer(raw[8 + 4 * n :])
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(logs)], ["row", "logs"])


def perplexities(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity of each row of docs under the model of all the texts of learn.

    Each word has a home, to which all triplets go that it is the middle of, of texts to learn from and of texts to score: there are all pairs that
    begin with it and all contexts that end in it, so that only words' own counts are summed across homes. Homes are first counted for these
    and for discounts; then, part by part, they are counted anew and send back sums for each text of a batch. So only one part's
    shuffles are on disk at a time, and no gram is written; each part reads all texts. Within a home grams are told apart by 64 bits.
    A home is one task, which holds its different grams, and what is asked of it packed. docs is read several times, in any order.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    with shuffles_cleared(spark):
        rows = materialize(docs.select("doc_id", "lang", "text").mapInArrow(_rows, "row long, doc_id long, lang string, n_tokens long"))
        tokens = rows.agg(F.sum("n_tokens")).first()[0] or 0
        parts = min(PARTS, -(-tokens // PART_TOKENS)) or 1
        shards = max(2 * spark.sparkContext.defaultParallelism, -(-tokens // (parts * SHARD_TOKENS)))
        homes, places = parts * shards, min(shards, PLACES)
        learnt = scratch.table(learn.select("text"), compression="zstd")
        sent = learnt.mapInArrow(_sent(0, homes, homes, shards, False), SENT).repartitionById(shards, F.col("shard"))
        asked = sent.mapInArrow(_counted(places), "place int, home int, payload binary, n binary, found array<long>").repartitionById(places, F.col("place"))
        words = scratch.table(asked.mapInArrow(_summed, "home int, payload binary, n binary, found array<long>"))
        found = words.agg(*[F.coalesce(F.sum(F.col("found")[k]), F.lit(0)) for k in range(3 * FOUND)]).first()
        off = _settled(list(found))
        sums = []
        for k in range(parts):
            first, last = k * shards, (k + 1) * shards
            none = F.lit(None)
            to_learn = learnt.mapInArrow(_sent(first, last, homes, shards, False), SENT)
            counts = words.where(F.col("home").between(first, last - 1)).select(F.col("home") - first, "home", F.lit(WORDS), none.cast("long"), "payload", "n")
            met = docs.select("doc_id", "text").mapInArrow(_sent(first, last, homes, shards, True), SENT).union(to_learn).union(counts)
            met = met.repartitionById(shards, F.col("shard")).mapInArrow(_answers(off, shards), "to int, block long, names binary, logs binary")
            sums.append(scratch.table(met.repartitionById(shards, F.col("to")).mapInArrow(_sums, "row long, logs double")))
        logs = reduce(DataFrame.union, sums).groupBy("row").agg((F.sum("logs") * parts / F.count(F.lit(1))).alias("logs"))  # rows that share a name come several times
        total = F.col("logs") + F.col("n_tokens") * F.lit(float(np.log(off.unknown)))
        done = rows.join(logs, "row").select("doc_id", "lang", "n_tokens", F.exp(F.least(-total / F.col("n_tokens"), F.lit(700.0))).alias("perplexity"))
        done = materialize(done)
        scratch.clear()
    return done


def judge_quality(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, low_bound, high_bound, keep for each row of docs.

    The model learns from all texts labelled of good quality that aren't held out; perplexity is that of each whole
    text, its end included. A text is kept if its perplexity is between its language's bounds: the low and high quantiles of
    trusted texts that were not learnt from, drawn smoothly (as logs) towards those of all languages, the more so the fewer the
    language has: with HALFWAY of them, by half. Below lie texts that repeat themselves, above those of strange words. A language
    without such texts has the bounds of all; without any, all is kept. A doc_id labelled more than once is trusted if all
    labels are good; null ids and labels count for nothing. A null text counts as empty, a null language is one of its own. Repeated
    rows are judged alike, and learnt from each. A very long text is one row, whose grams are made slice by slice. No rows give no rows.
    """
    docs = docs.select("doc_id", "lang", "text")
    trusted = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    learn = docs.where(crc_mod(F.col("doc_id"), FOLDS) != 0).join(trusted, "doc_id", "left_semi").select("text")
    scored = perplexities(docs, learn)
    held = scored.where(crc_mod(F.col("doc_id"), FOLDS) == 0).join(trusted, "doc_id", "left_semi")
    ends = F.percentile_approx("perplexity", [low, high], 10_000)
    by_lang = held.groupBy(F.coalesce("lang", F.lit("")).alias("of")).agg(ends.alias("own"), F.count(F.lit(1)).alias("held"))
    overall = held.agg(ends.alias("any"))
    bounds = scored.select(F.coalesce("lang", F.lit("")).alias("of")).distinct().join(by_lang, "of", "left").crossJoin(overall)  # one row for each language
    bounds = materialize(bounds)
    if bounds.count() <= BROADCAST_LANGUAGES:  # else a shuffle, whose hot languages adaptive joins split
        bounds = F.broadcast(bounds)
    judged = scored.join(bounds, F.coalesce("lang", F.lit("")) == F.col("of"))
    weight = F.coalesce(F.col("held"), F.lit(0)) / (F.coalesce(F.col("held"), F.lit(0)) + HALFWAY)
    bound = lambda k: F.exp(weight * F.log(F.coalesce(F.col("own")[k], F.col("any")[k])) + (1 - weight) * F.log(F.col("any")[k]))
    low_bound, high_bound = bound(0), bound(1)
    keep = F.coalesce(F.col("perplexity").between(low_bound, high_bound), F.lit(True))
    return judged.select("doc_id", "lang", "n_tokens", "perplexity", low_bound.alias("low_bound"), high_bound.alias("high_bound"), keep.alias("keep"))
