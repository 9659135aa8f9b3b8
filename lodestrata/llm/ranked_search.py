"""Ranked lexical search: items' accumulators pass through the owners of terms, rarest first, one after the other."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, materialize

TOP, STAGES = 10, 4
#: Documents and bytes of text of a slice, items and words of a bundle, bundles that are carried at once, bytes of terms that are looked for at once, bytes of a text that are split at once.
SLICE, SLICE_BYTES, BUNDLE, BUNDLE_WORDS, TOGETHER, TERM_BYTES, PIECE = 4096, 8_000_000, 256, 100_000, 8, 32_000_000, 1_000_000
#: ASCII bytes but letters and digits become blanks, A-Z become a-z; bytes of other letters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

BAGS = "bundle long, place int, id {}, terms array<string>, times array<long>"
POSTINGS = "slice long, filled long, words long, docs array<{}>, lengths array<long>, terms array<long>, counts array<long>, maxima array<long>, shortest array<long>, at array<int>, tfs array<long>"
DEALT = "slice long, docs array<{}>, terms array<long>, counts array<long>, at array<int>, impacts array<long>, later array<long>, most array<long>"
CARRIED = "slice long, bundle long, place array<int>, at array<int>, score array<long>"
FOUND = "bundle long, place int, {} {}, score long"


def search(documents: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """item_key, rank (from 1), key, score: the documents that score highest for each item, by falling score and then rising key, nulls last.

    Documents are tokenised once for every 32 MB of the items' different terms, which is what tasks get to know of them, and become slices: postings of up to
    4,096 documents, sorted by term, as integer contributions. Terms belong to four owners by their weights, of about as many postings each, the rarest to
    the first. A bundle of up to 256 items has a sparse accumulator for each slice. It goes from owner to owner, as a cogroup with the owner's
    postings of that slice, which are added to it. What can't reach the slice's tenth score any more, whatever the owners still to come would add, is
    left out on the way: the tenth is only ever passed by documents that have been there since their first term, so results are exact. At the end each
    slice gives ten documents an item, and the ten best of these are selected.

    A frequent term is as many postings as it has slices, so no key is hot; a slice and its accumulators have a bound (a longer text is a slice by
    itself). Of items, bundles of 2,048 items at most are with the tasks at a time; more go through the stages after them. What an owner's stage shuffles is
    written by Spark, and the postings are a table in the shared folder, so that lost executors cost little.

    Null and empty texts have no terms: such items get no rows, such documents aren't counted. Repeated rows, of either side, and null keys are rows of
    their own. Other columns are passed over. Without documents or items nothing is found.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession)
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    docs = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    bags = scratch.table(items.select(F.col(item_key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_bags, BAGS.format(item_kind)))
    terms = scratch.table(bags.select(F.explode("terms").alias("term")).distinct().mapInArrow(_numbered, "term string, number long"))
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    blocks = -(-size // TERM_BYTES)
    of_block = F.pmod(F.xxhash64("term"), F.lit(max(1, blocks)))
    if blocks > 1:
        docs = scratch.table(docs)
    written = []
    for block in range(blocks):
        known = {row.term.encode(): row.number for row in terms.where(of_block == block).collect()}
        shared = spark.sparkContext.broadcast(known)
        written.append(scratch.table(docs.mapInArrow(lambda batches, shared=shared: _postings(batches, shared.value), POSTINGS.format(kind))))
        shared.unpersist()
    n, words = written[0].agg(F.sum("filled"), F.sum("words")).first() if written else (0, 0)
    none = spark.createDataFrame([], f"`{item_key}` {item_kind}, rank int, `{key}` {kind}, score long")
    if not n:
        scratch.clear()
        return none

    weights = []
    for postings in written:
        df = postings.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("number")).agg(F.sum("x.counts").alias("df"))
        weights.append(scratch.table(df.withColumn("w", F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long"))))
    every = weights[0]
    for more in weights[1:]:
        every = every.union(more)
    cuts = _cuts(every.groupBy("w").agg(F.sum("df").alias("postings")).collect())  # a row for each weight, some 25,000 at most
    dealt = []
    for postings, of_terms in zip(written, weights, strict=True):
        found = of_terms.select("number", "w").toPandas().sort_values("number")
        shared = spark.sparkContext.broadcast((found["number"].to_numpy(np.int64), found["w"].to_numpy(np.int64)))
        pieces = postings.mapInArrow(lambda batches, shared=shared: _deal(batches, *shared.value, cuts, n, words), "stage int, " + DEALT.format(kind))
        dealt.append(scratch.table(pieces, by="stage"))
        shared.unpersist()

    entries = bags.select("bundle", "place", F.explode(F.arrays_zip("terms", "times")).alias("x")).select("bundle", "place", F.col("x.terms").alias("term"), F.col("x.times").alias("times"))
    entries = scratch.table(scratch.table(entries).join(terms, "term").join(every.select("number"), "number").select("bundle", "place", "number", "times"))
    bundles = [row.bundle for row in entries.select("bundle").distinct().orderBy("bundle").collect()]  # one for 256 items
    results = []
    for first in range(0, len(bundles), TOGETHER):
        some = bundles[first : first + TOGETHER]
        table = entries.where(F.col("bundle").isin(some)).toPandas()
        shared = spark.sparkContext.broadcast({b: _sorted_bag(of) for b, of in table.groupby("bundle")})
        carried = spark.createDataFrame([], CARRIED)
        for stage in range(STAGES):
            owner = dealt[0].where(F.col("stage") == stage)
            for more in dealt[1:]:
                owner = owner.union(more.where(F.col("stage") == stage))
            owner = owner.drop("stage").withColumn("bundle", F.explode(F.array(*[F.lit(b).cast("long") for b in some])))
            last = stage == STAGES - 1
            add = _adder(shared, top, last, key)
            carried = carried.groupBy("slice", "bundle").cogroup(owner.groupBy("slice", "bundle")).applyInArrow(add, FOUND.format(f"`{key}`", kind) if last else CARRIED)
        results.append(scratch.table(carried))
    found = results[0] if results else None
    for more in results[1:]:
        found = found.union(more)
    if found is None:
        scratch.clear()
        return none
    best = Window.partitionBy("bundle", "place").orderBy(F.desc("score"), F.col(key).asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    out = materialize(ranked.join(bags.select("bundle", "place", F.col("id").alias("of")), ["bundle", "place"]).select(F.col("of").alias(item_key), "rank", F.col(key), "score"))
    scratch.clear()
    return out


def split(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a stretch of about a megabyte at a time."""
    plain = (text or "").encode().translate(LETTERS)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def impacts(tf: np.ndarray, length: np.ndarray, w: np.ndarray, n: int, words: int) -> np.ndarray:
    """What a term of weight w adds to the score of documents that hold it tf times."""
    m = 25 + 75 * length * n // words
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _numbers() -> Iterator[int]:
    """Numbers that no other task has."""
    first = TaskContext.get().partitionId() << 32
    return iter(range(first, first + (1 << 32)))


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundles = _numbers()
    bundle, place, held = next(bundles), 0, 0
    for batch in batches:
        for at in range(batch.num_rows):
            bag: Counter[bytes] = Counter()
            for piece in split(batch.column(1)[at].as_py()):
                bag.update(piece)
            if place and (place == BUNDLE or held + len(bag) > BUNDLE_WORDS):
                bundle, place, held = next(bundles), 0, 0
            head = {"bundle": [bundle], "place": pa.array([place], pa.int32()), "id": batch.column(0).slice(at, 1)}
            cells = {"terms": pa.array([[t.decode() for t in bag]], pa.list_(pa.string())), "times": pa.array([list(bag.values())], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(head | cells)
            place, held = place + 1, held + len(bag)


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = _numbers()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(islice(numbers, batch.num_rows)), pa.int64())], ["term", "number"])


def _postings(batches: Iterable[pa.RecordBatch], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Slices of the partition's documents, one after the other; the same ones whatever terms are known."""
    slices = _numbers()
    ids, lengths, at, terms, tfs, size = [], [], [], [], [], 0

    def slice_row() -> pa.RecordBatch:
        docs, of, tf, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, terms, tfs, [np.array(lengths, np.int64)]))
        order = np.lexsort((docs, of))
        docs, of, tf = docs[order], of[order], tf[order]
        first = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.zeros(0, np.int64)
        runs = {"terms": of[first], "counts": np.diff(np.append(first, len(of))), "maxima": np.maximum.reduceat(tf, first) if len(of) else of, "shortest": np.minimum.reduceat(length[docs], first) if len(of) else of}
        row = {"slice": [next(slices)], "filled": [int((length > 0).sum())], "words": [int(length.sum())], "docs": _lists([pa.concat_arrays(ids)]), "lengths": _lists([length])}
        row |= {k: _lists([v]) for k, v in runs.items()} | {"at": _lists([docs.astype(np.int32)]), "tfs": _lists([tf])}
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py()
            bag: Counter[bytes] = Counter()
            n = 0
            for piece in split(text):
                n += len(piece)
                bag.update(filter(known.__contains__, piece))
            if ids and (len(ids) == SLICE or size + len(text or "") > SLICE_BYTES):
                yield slice_row()
                ids, lengths, at, terms, tfs, size = [], [], [], [], [], 0
            at.append(np.full(len(bag), len(ids), np.int64))
            terms.append(np.fromiter((known[t] for t in bag), np.int64, len(bag)))
            tfs.append(np.fromiter(bag.values(), np.int64, len(bag)))
            ids.append(batch.column(0).slice(i, 1))
            lengths.append(n)
            size += len(text or "")
    if ids:
        yield slice_row()


def _lists(values: list) -> pa.Array:
    """An array of one list."""
    flat = values[0] if isinstance(values[0], pa.Array) else pa.array(values[0])
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _list(batch: pa.RecordBatch | pa.Table, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _cuts(weights: list) -> list[int]:
    """Weights at which the next owner's terms begin, falling, so that owners have about as many postings."""
    whole, sum_, cuts = sum(row.postings for row in weights), 0, []
    for row in sorted(weights, key=lambda row: -row.w):
        if len(cuts) < STAGES - 1 and sum_ * STAGES >= whole * (len(cuts) + 1):
            cuts.append(row.w)
        sum_ += row.postings
    return cuts


def _deal(batches: Iterable[pa.RecordBatch], numbers: np.ndarray, weights: np.ndarray, cuts: list[int], n: int, words: int) -> Iterator[pa.RecordBatch]:
    """Each slice's postings as contributions, a row for every owner; with what the terms of later owners add at most."""
    for batch in batches:
        for row in range(batch.num_rows):
            lengths, terms, counts, at, tfs, maxima, shortest = (_list(batch, k, row) for k in ("lengths", "terms", "counts", "at", "tfs", "maxima", "shortest"))
            w = weights[np.searchsorted(numbers, terms)]
            gain = impacts(tfs, lengths[at], np.repeat(w, counts), n, words)
            most = impacts(maxima, shortest, w, n, words)
            stage = sum((w <= cut).astype(int) for cut in cuts) if cuts else np.zeros(len(w), int)
            stage_of = np.repeat(stage, counts)
            for k in range(STAGES if len(terms) else 0):
                mine, later, of = stage == k, stage > k, stage_of == k
                cells = {"terms": terms[mine], "counts": counts[mine], "at": at[of], "impacts": gain[of], "later": terms[later], "most": most[later]}
                head = {"stage": pa.array([k], pa.int32()), "slice": batch.column("slice").slice(row, 1), "docs": batch.column("docs").slice(row, 1)}
                yield pa.RecordBatch.from_pydict(head | {name: _lists([v]) for name, v in cells.items()})


def _sorted_bag(of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a bundle, sorted, with the places of their items and how often these have them."""
    of = of.sort_values("number")
    return of["number"].to_numpy(np.int64), of["place"].to_numpy(np.int64), of["times"].to_numpy(np.int64)


def _adder(shared, top: int, last: bool, key: str) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The stage of one owner: takes a bundle's accumulator for a slice and the owner's postings of that slice."""

    def add(group: tuple, carried: pa.Table, owner: pa.Table) -> pa.Table:
        slice_, bundle = (x.as_py() for x in group)
        number, place, times = shared.value[bundle]
        n_items = int(place.max()) + 1
        ids = owner.column("docs")[0].values
        score = np.zeros((n_items, len(ids)), np.int64)
        if carried.num_rows:
            score[_list(carried, "place", 0), _list(carried, "at", 0)] = _list(carried, "score", 0)
        later = np.zeros(n_items, np.int64)
        for row in range(owner.num_rows):
            terms, counts, at, gain = (_list(owner, k, row) for k in ("terms", "counts", "at", "impacts"))
            ends = np.cumsum(counts)
            low, high = np.searchsorted(number, terms), np.searchsorted(number, terms, "right")
            for i in np.flatnonzero(high > low):
                docs, of = slice(ends[i] - counts[i], ends[i]), slice(low[i], high[i])
                score[place[of][:, None], at[docs]] += times[of][:, None] * gain[docs]
            terms, most = _list(owner, "later", row), _list(owner, "most", row)
            low, high = np.searchsorted(number, terms), np.searchsorted(number, terms, "right")
            of = np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            np.add.at(later, place[of], times[of] * np.repeat(most, high - low))
        tenth = np.partition(score, len(ids) - top, axis=1)[:, len(ids) - top] if len(ids) > top else np.zeros(n_items, np.int64)
        places, at = np.nonzero((score > 0) & (score + later[:, None] >= tenth[:, None]))
        found = score[places, at]
        if not last:
            cells = {"place": places.astype(np.int32), "at": at.astype(np.int32), "score": found}
            return pa.table({"slice": [slice_], "bundle": [bundle]} | {k: _lists([v]) for k, v in cells.items()})
        keys = ids.take(pa.array(at))
        by_key = np.argsort(np.asarray(pc.rank(keys, sort_keys="ascending", null_placement="at_end", tiebreaker="first")), kind="stable")
        order = by_key[np.lexsort((-found[by_key], places[by_key]))]
        nth = np.arange(len(order)) - np.searchsorted(places[order], places[order])
        order = order[nth < top]
        return pa.table({"bundle": pa.array(np.full(len(order), bundle), pa.int64()), "place": pa.array(places[order], pa.int32()), key: keys.take(pa.array(order)), "score": pa.array(found[order], pa.int64())})

    return add


#: The same in SQL, every score of every document summed up.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t FROM documents),
d AS (SELECT doc_id, t, len(t)::BIGINT AS n FROM w WHERE len(t) > 0),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM d),
tf AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(t) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2.0 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, a GROUP BY t, docs),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark),
i AS (SELECT item_id, t, count(*)::BIGINT AS times FROM q GROUP BY ALL),
s AS (SELECT i.item_id, tf.doc_id, sum(i.times * df.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + ((75 * tf.n * a.docs) // a.words)))))::BIGINT AS score
      FROM i JOIN df ON i.t = df.t JOIN tf ON i.t = tf.t, a GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
