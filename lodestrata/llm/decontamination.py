"""Benchmark decontamination: a broadcast set of normalised test n-grams, and a scan of every training text for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textcore import ALNUM, folded_words, released, rolling, slices, span_hashes, token_bounds, window_rows

#: Words of a window; shorter items are one window of their own length.
WINDOW = 13
#: Words of benchmark texts in one broadcast block: about 30 MB. More blocks are scanned one after the other.
BLOCK_WORDS = 1_000_000
_BITS = 22


class WindowSet:
    """The windows of a block of items: hashes to look up, and words to verify hits against."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.names = [name for name, _ in items]
        self.words = [words for _, words in items]
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, words in enumerate(self.words):
            text = np.frombuffer(b" ".join(words), np.uint8)
            starts, ends, _ = token_bounds(text, np.array([0, len(text)]), ALNUM)
            size = min(window, len(words))
            found.setdefault(size, []).append((rolling(span_hashes(text, starts, ends), size), k))
        self.sizes = {}
        for size, parts in found.items():
            hashes = np.concatenate([h for h, _ in parts])
            item = np.concatenate([np.full(len(h), k) for h, k in parts])
            at = np.concatenate([np.arange(len(h)) for h, _ in parts])
            order = np.argsort(hashes, kind="stable")
            hashes, item, at = hashes[order], item[order], at[order]
            distinct, first, times = np.unique(hashes, return_index=True, return_counts=True)
            maybe = np.zeros(1 << _BITS, bool)
            maybe[distinct >> np.uint64(64 - _BITS)] = True
            self.sizes[size] = (maybe, distinct, first, times, item, at)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, set[tuple[int, int]]]:
        """Token starts, ends, first tokens of rows, whether a window covers each token, and (row, item) pairs."""
        starts, ends, firsts = token_bounds(data, offsets, ALNUM)
        hashes = span_hashes(data, starts, ends)
        edges = np.zeros(len(starts) + 1, np.int64)
        pairs: set[tuple[int, int]] = set()
        for size, (maybe, distinct, first, times, item, at) in self.sizes.items():
            windows = rolling(hashes, size)
            pos, rows = window_rows(firsts, size)
            near = maybe[windows[pos] >> np.uint64(64 - _BITS)]
            pos, rows = pos[near], rows[near]
            k = np.minimum(np.searchsorted(distinct, windows[pos]), len(distinct) - 1)
            same = distinct[k] == windows[pos]
            pos, rows, k = pos[same], rows[same], k[same]
            good = self._verified(data, starts, ends, pos, item[first[k]], at[first[k]], size)
            pos, rows, k = pos[good], rows[good], k[good]
            np.add.at(edges, pos, 1)
            np.add.at(edges, pos + size, -1)
            each = np.repeat(np.arange(len(k)), times[k])
            own = first[k][each] + np.arange(len(each)) - np.repeat(np.cumsum(times[k]) - times[k], times[k])
            pairs.update(zip(rows[each].tolist(), item[own].tolist(), strict=True))
        return starts, ends, firsts, np.cumsum(edges[:-1]) > 0, pairs

    def _verified(self, data, starts, ends, pos, item, at, size) -> np.ndarray:
        """Whether the words themselves agree; hits that follow on each other in text and item are compared together."""
        good = np.zeros(len(pos), bool)
        if not len(pos):
            return good
        breaks = np.flatnonzero((np.diff(pos) != 1) | (np.diff(item) != 0) | (np.diff(at) != 1)) + 1
        for low, high in zip([0, *breaks], [*breaks, len(pos)], strict=True):
            got = folded_words(data[starts[pos[low]] : ends[pos[high - 1] + size - 1]], ALNUM)
            want = self.words[item[low]][at[low] : at[high - 1] + size]
            if got == want:
                good[low:high] = True
            else:
                for j in range(low, high):
                    good[j] = got[j - low : j - low + size] == want[j - low : j - low + size]
        return good


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [" ".join(w.decode() for w in folded_words(np.frombuffer((t or "").encode(), np.uint8), ALNUM)) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["name"], pa.array(words, pa.string())], ["name", "words"])


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[WindowSet]:
    """The benchmark's items, normalised where they lie, in blocks of bounded size, one at a time on the driver."""
    items, n = [], 0
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").mapInArrow(released(_normalised), "name string, words string")
    for name, text in named.where("words <> ''").toLocalIterator():
        words = text.encode().split(b" ")
        items.append((name, words))
        n += len(words)
        if n >= block_words:
            yield WindowSet(items, window)
            items, n = [], 0
    yield WindowSet(items, window)


def _looked_through(windows: WindowSet, texts: pa.Array) -> Iterator[dict]:
    """For each text, in order: which words are hit, the names of items that hit them, and where its words start and end."""
    for low, high, data, offsets in slices(texts):
        starts, ends, firsts, cover, pairs = windows.scan(data, offsets)
        items: dict[int, set[str]] = {}
        for row, item in pairs:
            items.setdefault(row, set()).add(windows.names[item])
        for row in range(high - low):
            a, b = firsts[row], firsts[row + 1]
            yield {"cover": cover[a:b], "items": sorted(items.get(row, ())), "starts": starts[a:b] - offsets[row], "ends": ends[a:b] - offsets[row]}


def _hits(block):
    """A mapInArrow function: nth, cover, items of the rows that a block's windows hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_looked_through(block.value, batch["text"]))
            hit = [k for k, x in enumerate(found) if x["items"]]
            columns = [batch["nth"].take(pa.array(hit, pa.int64())), pa.array([np.packbits(found[k]["cover"]).tobytes() for k in hit], pa.binary()), pa.array([found[k]["items"] for k in hit], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["nth", "cover", "items"])

    return run


def _finisher(block, finish: Callable[[pa.RecordBatch, list[dict]], pa.RecordBatch]):
    """A mapInArrow function over row, told (what other blocks have found): looks for the block's windows in the texts, and finishes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_looked_through(block.value, batch["row"].field("text")))
            for x, told in zip(found, batch["told"].to_pylist(), strict=True):
                for more in told or ():
                    x["cover"] = x["cover"] | np.unpackbits(np.frombuffer(more["cover"], np.uint8), count=len(x["cover"])).astype(bool)
                    x["items"] = sorted({*x["items"], *more["items"]})
            yield finish(pa.RecordBatch.from_struct_array(batch["row"]), found)

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    return materialize(docs.select(F.monotonically_increasing_id().alias("nth"), F.struct("*").alias("row")))


def _scan(docs: DataFrame, benchmark: DataFrame, finish, schema, window: int, block_words: int) -> DataFrame:
    """finish over the rows of docs. Of more than one block of windows, all but the last leave their hits in tables of (nth, cover, items), so
    that the rows themselves are written once, with numbers, and read once a block."""
    spark, rows, told, held = docs.sparkSession, None, None, None
    for block in _blocks(benchmark, window, block_words):
        if held is not None:
            rows = _numbered(docs) if rows is None else rows
            found = materialize(rows.select("nth", "row.text").mapInArrow(released(_hits(held)), "nth long, cover binary, items array<string>"))
            told = found if told is None else told.union(found)
            held.unpersist()
        held = spark.sparkContext.broadcast(block)
    none = F.lit(None).cast("array<struct<nth:long,cover:binary,items:array<string>>>")
    if rows is None:
        ready = docs.select(F.struct("*").alias("row"), none.alias("told"))
    else:  # of each row no more entries than there are blocks
        ready = rows.join(told.groupBy("nth").agg(F.collect_list(F.struct("nth", "cover", "items")).alias("told")), "nth", "left").select("row", "told")
    return ready.mapInArrow(released(_finisher(held, finish)), schema)


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _report(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
    hits = [int(x["cover"].sum()) for x in found]
    words = [len(x["cover"]) for x in found]
    flags = [contaminated(h, n) for h, n in zip(hits, words, strict=True)]
    columns = [batch["doc_id"], pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array([x["items"] for x in found], pa.list_(pa.string())), pa.array(flags)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items", "contaminated"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids whose windows occur), contaminated for each row of docs.

    Words are runs of digits, a-z after folding A-Z, and characters beyond ASCII. A word inside any occurrence of a window is hit; a
    text is contaminated if a twentieth of its words are, and at least one. A null or empty text has no words and is clean. Items
    without words have no windows; a null item_id counts as an empty one, and items that share an id count once. Repeated rows
    are judged each by itself. Other columns are not looked at. The windows are broadcast in blocks of block_words words at most
    (or one longer item); with more blocks the texts are written once and read once for each. No rows give no rows.
    """
    return _scan(docs.select("doc_id", "text"), benchmark, _report, "doc_id long, n_words long, n_hit long, items array<string>, contaminated boolean", window, block_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever these are called.

    Nulls, long texts, repeated rows and items are as find_contamination has them: a null or empty text is clean and stays. No rows give
    no rows; without items all rows stay.
    """

    def keep(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        flags = [not contaminated(int(x["cover"].sum()), len(x["cover"])) for x in found]
        return batch.filter(pa.array(flags, pa.bool_()))

    return _scan(docs, benchmark, keep, docs.schema, window, block_words)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows and columns of docs; from each text the stretches from a hit run's first to its last word are cut out.

    Null and empty texts stay as they are, as does every text without hits; columns may have any names. No rows give no rows.
    """

    def cut(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        for k, x in enumerate(found):
            if x["cover"].any():
                raw, edges = texts[k].encode(), np.diff(np.concatenate(([0], x["cover"].astype(np.int8), [0])))
                parts, at = [], 0
                for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
                    parts.append(raw[at : x["starts"][a]])
                    at = x["ends"][b - 1]
                texts[k] = b"".join([*parts, raw[at:]]).decode()
        at = batch.schema.get_field_index("text")
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return _scan(docs, benchmark, cut, docs.schema, window, block_words)


def digest(result: DataFrame) -> DataFrame:
    items = F.array_sort("items")
    return result.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 13) AS z FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, z, array_to_string(w[i : i + z - 1], ' ') AS k FROM (SELECT item_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM s)),
z AS (SELECT DISTINCT z FROM bw),
dw AS (SELECT doc_id, z, i, array_to_string(w[i : i + z - 1], ' ') AS k FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM d, z WHERE len(w) >= z)),
h AS (SELECT dw.doc_id, dw.i, dw.z, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.z = bw.z),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + z)) AS p FROM (SELECT DISTINCT doc_id, i, z FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
