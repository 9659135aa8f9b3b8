"""Document fingerprints: a quartile digest of hashed byte triplets, and a bounded difference score between digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import slices

BUCKETS, WINDOW = 256, 5
#: The two later bytes of each triplet within a window; the first is the window's own.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
#: The difference from which on two digests count as wholly unlike.
MOST = 300.0
_LEAST_LONG = -(1 << 63)


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many triplets of each row fall into each bucket: all that fit, also where less than a window is left; a row shorter than three
    bytes has none."""
    n, size = len(offsets) - 1, len(data)
    counts = np.zeros(n * BUCKETS, np.int64)
    wide = data.astype(np.uint32)
    one, two, three = (wide * np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
    row = np.repeat(np.arange(n, dtype=np.int32 if n * BUCKETS < 1 << 31 else np.int64) * BUCKETS, np.diff(offsets))
    for salt, (a, b) in enumerate(TRIPLETS, 1):
        if size <= b:
            continue
        h = one[: size - b] + two[a : size - b + a]
        h += three[b:]
        h += np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        within = row[: size - b] == row[b:]  # not across a row's end
        counts += np.bincount((row[: size - b] + (h >> np.uint32(24)))[within], minlength=len(counts))
    return counts.reshape(n, BUCKETS)


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of bytes for each text: its length on a logarithmic scale, its quartiles' ratios, and two bits for each bucket."""
    counts = bucket_counts(data, offsets)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    size = np.minimum(np.round(np.log1p(np.diff(offsets)) * 8), 255).astype(np.uint8)
    ratio = lambda q: np.round(255 * q / np.maximum(q3, 1)).astype(np.uint8)
    codes = ((counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])).astype(np.uint8)
    packed = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
    return np.concatenate((size[:, None], ratio(q1)[:, None], ratio(q2)[:, None], packed), axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, down to 0 for a difference of MOST or more: steps between bucket codes, whose largest counts double,
    a step of length or ratio beyond the first, at half weight and at most a quarter of MOST each."""
    unpack = lambda x: np.stack([x[:, 3:] >> k & 3 for k in (0, 2, 4, 6)], axis=2).astype(np.int16)
    steps = np.abs(unpack(a) - unpack(b))
    body = (steps + 3 * (steps == 3)).sum(axis=(1, 2))
    head = np.abs(a[:, :3].astype(np.int16) - b[:, :3].astype(np.int16))
    head = np.minimum(np.maximum(head - 1, 0) * np.array([0.5, 0.25, 0.25]), MOST / 4).sum(axis=1)
    return 1 - np.minimum(body + head, MOST) / MOST


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) for each row; a null text counts as empty. No row needs another; equal texts have equal ones.

    Repeated rows and null ids are rows like any other; a long text is looked at in time linear in its length; no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x.tobytes().hex() for _, _, data, offsets in slices(batch["text"], 1 << 18) for x in digests(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _places(*columns: np.ndarray) -> np.ndarray:
    """One text for each row of long columns, so that texts are in the rows' order."""
    wide = np.empty((len(columns[0]), len(columns)), ">u8")
    for k, x in enumerate(columns):
        wide[:, k] = x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return wide.view(f"S{8 * len(columns)}")[:, 0]


def _pack(firsts: np.ndarray):
    """Rows with the range of (key, tie) they belong to. What a range begins with is also sent to the range before, the very first to the last,
    so that every range sees what follows on its last row. Equal rows of a batch are sent once, with their number (times; 0: only what
    follows), and texts are compressed for the way."""
    edges = _places(*firsts.T)
    heads = {tuple(x): k for k, x in enumerate(firsts.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            key, tie = (batch[x].to_numpy(zero_copy_only=False) for x in ("key", "tie"))
            part = np.maximum(np.searchsorted(edges, _places(key, tie), side="right") - 1, 0)
            first: dict[tuple[int, bytes], int] = {}
            packed, times = [], np.zeros(len(key), np.int64)
            for k, (i, text) in enumerate(zip(key.tolist(), batch["text"].to_pylist(), strict=True)):
                packed.append(press.compress((text or "").encode()))
                times[first.setdefault((i, packed[k]), k)] += 1
            own = np.flatnonzero(times)
            lead = [(k, (heads[x] - 1) % len(heads)) for k, x in zip(own.tolist(), zip(key[own].tolist(), tie[own].tolist(), strict=True), strict=True) if x in heads]
            take = np.concatenate((own, np.array([k for k, _ in lead], np.int64)))
            part = np.concatenate((part[own], np.array([r for _, r in lead], np.int64))).astype(np.int32)
            times = np.concatenate((times[own], np.zeros(len(lead), np.int64)))
            at = pa.array(take)
            columns = [pa.array(part), pa.array(times), *[batch[x].take(at) for x in ("key", "tie", "doc_id")], pa.array(packed, pa.binary()).take(at)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "times", "key", "tie", "doc_id", "packed"])

    return run


def _digests(texts: list[str]) -> np.ndarray:
    return np.concatenate([digests(d, o) for _, _, d, o in slices(pa.array(texts, pa.string()), 1 << 18)])


def _compare(rows: list[list], after: str) -> pa.RecordBatch:
    """The results for rows [doc_id, text, times], which after follows on. Of equal rows all but the last follow on each other."""
    single = [x for i, t, n in rows for x in ([(i, t, n - 1)] if n > 1 else []) + [(i, t, 1)]]
    texts = [x[1] for x in single]
    following = [*texts[1:], after]
    edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following, strict=True)]
    own, new = _digests([*texts, after]), _digests(edited)
    out = pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in single], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([x.tobytes().hex() for x in own[:-1]]), pa.array([x.tobytes().hex() for x in new]), pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:])),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
    times = [x[2] for x in single]
    return out if max(times) == 1 else out.take(pa.array(np.repeat(np.arange(len(times)), times)))


def _study(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the rows of whole ranges, in order, what follows on each range after it."""
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    held: list[list] = []
    part, size, closed, was = None, 0, True, None
    for batch in batches:
        for p, times, key, doc_id, packed in zip(*[batch[x].to_pylist() for x in ("part", "times", "key", "doc_id", "packed")], strict=True):
            if closed and p == part:  # told before what follows on this range
                continue
            if times and held and was == (key, packed):
                held[-1][2] += times
                continue
            text, was = unpress.decompress(packed).decode(), (key, packed)
            if not times:
                if held:
                    yield _compare(held, text)
                part, held, size, closed = p, [], 0, True
                continue
            closed = False
            if size > 1 << 20:
                yield _compare(held, text)
                held, size = [], 0
            held.append([doc_id, text, times])
            part, size = p, size + len(text)


def compare_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and how alike it is to that and to the next document.

    Rows are ordered by doc_id (null first), those of equal ids by a hash of their texts. The edited text has its last quarter of
    code points, rounded down, replaced by as many (or all) of the next row's first ones; the last row's next is the first.
    A null text counts as empty; a lone row follows on itself; no rows give no rows. Returns doc_id, n_chars (code points),
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Other columns are not looked at.

    Places alone are ordered first, into ranges of like size, which may part the rows of one doc_id; texts are then moved once,
    compressed, straight to their range's task, each range's successor besides. Equal rows move once for each batch that has them, so
    that no row, however often repeated, makes a task large. A task holds some megabytes of texts at a time, or the longest one.
    """
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LEAST_LONG)).alias("key"), F.xxhash64("text").alias("tie"), "text")
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["key", "tie"]
    ranges = keyed.select(*place).repartitionByRange(parts, *place).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*place)).alias("first"))
    firsts = np.array(sorted(tuple(r["first"]) for r in ranges.collect()), np.int64).reshape(-1, 2)  # two numbers for each range
    if not len(firsts):
        firsts = np.array([[_LEAST_LONG] * 2], np.int64)
    packed = keyed.mapInArrow(_pack(firsts), "part int, times long, key long, tie long, doc_id long, packed binary")
    ordered = packed.repartitionById(len(firsts), "part").sortWithinPartitions("part", F.col("times") == 0, *place).select("part", "times", "key", "doc_id", "packed")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_study, schema)
