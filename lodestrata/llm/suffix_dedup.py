"""Suffix-array dedup: bytes of strings that start in an earlier document too, settled by external induced sorting of shards.

A window is SPAN consecutive bytes. Each window belongs to the least hash among its WIDTH-byte grams, and consecutive windows with
one such anchor make a stretch. Equal windows have equal anchors, so stretches are compared with those of the same anchor only:
equal stretches by a hash, with no text moved; what is left of anchors that several different stretches have goes to shards, text
and all. There, stretches are cut down to windows that a hash finds in other documents, and their suffixes are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced import Growing, chunks, induced_order, on_disk
from .shared import materialize
from .textcore import SLICE_BYTES, SpanHashes, distinct, slices

SPAN, WIDTH = 50, 25
BLOCK_BYTES = 1 << 19
#: Bytes of text that a shard is meant for: with more text there are more shards.
SHARD_TEXT = 1 << 25
#: Different windows whose owners are compared in memory at a time.
HELD_KEYS = 1 << 20
#: Runs are cut down again while a round takes one in so many windows away, or more.
SHRINKS = 8
#: Stands for a null doc_id: it is after all others, and covers nothing.
_LAST = (1 << 63) - 1


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, SpanHashes]:
    """First and end byte, row and anchor hash of each maximal run of windows with one anchor, in order; and the bytes' hashes."""
    hashes = SpanHashes(data, fold=False)
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, none.view(np.uint64), hashes
    at = np.arange(len(data) - WIDTH + 1)
    grams = hashes(at, at + WIDTH)
    low = np.uint64(0xFFFFFFFF)
    least, width = (grams & ~low) | at.astype(np.uint64), 1  # half of the hash and the place, so that the first of equals is least
    while width < SPAN - WIDTH + 1:
        step = min(width, SPAN - WIDTH + 1 - width)
        least = np.minimum(least[step:], least[:-step])
        width += step
    where = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(where)]
    starts = np.flatnonzero(np.arange(len(where)) + SPAN <= offsets[1:][row])
    if not len(starts):
        return none, none, none, none.view(np.uint64), hashes
    anchor, row = where[starts], row[starts]
    fresh = np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(row) != 0) | (np.diff(starts) != 1)))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last] + SPAN, row[first], grams[anchor[first]], hashes


def _six(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press, task, nth = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch["doc_id"].to_pylist()
        for low, high, data, offsets in slices(batch["text"], BLOCK_BYTES):
            row = [pa.array([(task << 33) + nth]), pa.array([ids[low:high]], pa.list_(pa.int64())), pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([press.compress(data.tobytes())], pa.binary())]
            nth += 1
            yield pa.RecordBatch.from_arrays(row, ["block", "ids", "offsets", "packed"])


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """block, ids (null: last), offsets, bytes of each row."""
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    for k in range(len(batch)):
        ids = np.array([_LAST if x is None else x for x in batch["ids"][k].as_py()], np.int64)
        yield batch["block"][k].as_py(), ids, np.array(batch["offsets"][k].as_py(), np.int64), np.frombuffer(unpress.decompress(batch["packed"][k].as_py()), np.uint8)


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by part, the parts that occur, and where each one's begin (and the last ends)."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    firsts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    return order, part[firsts], np.append(firsts, len(part))


def _leads(content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each stretch of a block, which of those that are equal speaks for them: the first of the smallest document's."""
    order = np.lexsort((doc, content))
    heads = np.append(True, np.diff(content[order]) != 0)[: len(order)]
    lead = np.empty(len(order), np.int64)
    lead[order] = order[heads][np.cumsum(heads) - 1]
    return lead


def _announce(parts: int):
    """For each block and part of anchors: six bytes of the anchor and the content hash of each different stretch, and its smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, offsets, data in _opened(batch):
                starts, ends, row, anchors, hashes = stretches(data, offsets)
                content = hashes(starts, ends)
                leads = distinct(_leads(content, ids[row]))
                order, names, firsts = _dealt(anchors[leads], parts)
                out = []
                for a, b in zip(firsts[:-1], firsts[1:], strict=True):
                    own = leads[order[a:b]]
                    new = np.diff(row[own], prepend=-1) != 0  # rows ascend within a block
                    out.append((_six(anchors[own] // np.uint64(parts)), _six(content[own]), np.diff(ids[row[own][new]], prepend=0).tobytes(), (np.cumsum(new) - 1).astype(np.uint16).tobytes()))
                columns = [pa.array([block] * len(out), pa.int64()), pa.array(names, pa.int64()), *[pa.array([x[k] for x in out], pa.binary()) for k in range(4)]]
                yield pa.RecordBatch.from_arrays(columns, ["block", "part", "anchors", "contents", "ids", "of"])

    return run


def _fates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each announced stretch: covered (a smaller document has the same one), or open (another stretch of its anchor, whose
    first document is another, may share some of its windows)."""
    blocks, parts, sizes, anchors, contents, docs = [], [], [], [], [], []
    for batch in batches:
        for x in batch.to_pylist():
            blocks.append(x["block"])
            parts.append(x["part"])
            anchors.append(_wide(x["anchors"]))
            contents.append(_wide(x["contents"]))
            docs.append(np.cumsum(np.frombuffer(x["ids"], np.int64))[np.frombuffer(x["of"], np.uint16)])
            sizes.append(len(anchors[-1]))
    if not blocks:
        return
    anchor = np.concatenate(anchors)  # one column after the other, so that few are held twice at a time
    del anchors
    content = np.concatenate(contents)
    del contents
    doc = np.concatenate(docs)
    del docs
    part = np.repeat(np.array(parts, np.int32), sizes)
    order = np.lexsort((doc, content, anchor, part))
    anchor = anchor[order]
    content = content[order]
    doc = doc[order]
    part = part[order]
    other = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])))
    fresh = other.copy()
    fresh[1:] |= content[1:] != content[:-1]
    least = doc[fresh]
    covered = doc > least[np.cumsum(fresh) - 1]
    heads = np.cumsum(other)[fresh] - 1
    groups = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1])))
    several = np.minimum.reduceat(least, groups) != np.maximum.reduceat(least, groups)
    is_open = several[np.cumsum(other) - 1] & ~covered
    fate = np.zeros((2, len(order)), bool)
    fate[0, order], fate[1, order] = covered, is_open
    at = np.cumsum([0, *sizes])
    out = [[np.packbits(fate[k, a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] for k in (0, 1)]
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(parts, pa.int64()), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["block", "part", "covered", "open"])


def _spread(parts: int):
    """Each block's covered bytes as a bitmap (shard null), and its open stretches with their text for their anchor's shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for k, (block, ids, offsets, data) in enumerate(_opened(batch)):
                told = {x["part"]: x for x in batch["told"][k].as_py() or ()}
                starts, ends, row, anchors, hashes = stretches(data, offsets)
                doc = ids[row]
                lead = _leads(hashes(starts, ends), doc)
                leads = distinct(lead)
                order, names, firsts = _dealt(anchors[leads], parts)
                covered, is_open = np.zeros((2, len(starts)), bool)
                for name, a, b in zip(names.tolist(), firsts[:-1], firsts[1:], strict=True):
                    for flags, x in ((covered, "covered"), (is_open, "open")):
                        flags[leads[order[a:b]]] = np.unpackbits(np.frombuffer(told[name][x], np.uint8), count=b - a)
                covered = covered[lead] | (doc > doc[lead])
                is_open = np.flatnonzero(is_open[lead] & (doc == doc[lead]))
                cover, rows = np.zeros(len(data) + 1, np.int64), []
                np.add.at(cover, starts[covered], 1)
                np.add.at(cover, ends[covered], -1)
                order, names, firsts = _dealt(anchors[is_open], parts)
                for name, a, b in zip(names.tolist(), firsts[:-1], firsts[1:], strict=True):
                    own = is_open[order[a:b]]
                    sizes = ends[own] - starts[own]
                    at = np.arange(sizes.sum()) + np.repeat(starts[own] - (np.cumsum(sizes) - sizes), sizes)
                    meta = np.stack([doc[own], starts[own], sizes])
                    rows.append((block, name, press.compress(meta.tobytes() + data[at].tobytes()), len(own)))
                rows.append((block, None, press.compress(np.packbits(np.cumsum(cover[:-1]) > 0).tobytes()), 0))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary()), pa.array([x[3] for x in rows], pa.int64())], ["block", "shard", "payload", "n"])

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, where covered windows of its open stretches start. The shard goes to files as it comes."""
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    data, doc, start, size, block = Growing(np.uint8), *(Growing(np.int64) for _ in range(4))
    for batch in batches:
        for x in batch.to_pylist():
            raw = unpress.decompress(x["payload"])
            for to, part in zip((doc, start, size), np.frombuffer(raw, np.int64, 3 * x["n"]).reshape(3, -1), strict=True):
                to.add(part)
            data.add(np.frombuffer(raw, np.uint8, offset=24 * x["n"]))
            block.add(np.full(x["n"], x["block"]))
    if not block.n:
        return
    doc, start, size, block = doc.mapped(), start.mapped(), size.mapped(), block.mapped()
    first = _before(size)
    found = covered_windows(data.mapped(), first, size, doc)
    for low, high in chunks(len(found)):
        here = np.asarray(found[low:high])
        of = np.searchsorted(first, here, side="right") - 1
        place, home = here - first[of] + start[of], block[of]
        order = np.argsort(home, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(home[order]) != 0)))
        out = [place[order[a:b]].tobytes() for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(home[order[edges]]), pa.int64()), pa.array(out, pa.binary())], ["block", "places"])


def _before(sizes: np.ndarray) -> np.ndarray:
    """The sum of the sizes before each one."""
    out, total = on_disk(len(sizes), np.int64), 0
    for low, high in chunks(len(sizes)):
        past = np.cumsum(sizes[low:high]) + total
        out[low:high] = past - sizes[low:high]
        total = int(past[-1])
    return out


def covered_windows(data: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where windows start in data, which is strings of given firsts, sizes and documents, that a smaller document's string has too.

    Windows that a hash finds in one document only are passed over; what is left are runs of windows. Of equal runs one is looked at,
    for the smallest of their documents; what these share with others is cut out and looked at likewise, and what then still differs has
    its suffixes sorted: every window gets the smallest document among its neighbours in that order with SPAN bytes in common."""
    room = size - SPAN + 1
    several = _in_several(_window_keys(data, first, size), _before(room), doc)
    low, length, owner = _shared_runs(several, _before(room), first, doc)
    kind, base, winner = _winners(data, low, length, owner)
    out = Growing(np.int64)
    for which, values in _laid_out(kind, base, winner, length):
        own = np.asarray(length[which]) - SPAN + 1
        inner = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        out.add((np.repeat(low[which], own) + inner)[values < np.repeat(owner[which], own)])
    return out.mapped()


def _winners(data: np.ndarray, low: np.ndarray, length: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run the number of its text, for each different text its first window, and for each window of these the smallest owner of
    a run that has an equal one.

    Windows that no other text has are settled with their text. What is left of the texts are shorter runs, of which more are equal: they
    are settled the same way, until few windows fall away, and the suffixes of what is left then are sorted."""
    kind, heads = _kinds(data, low, length)
    least = on_disk(len(heads), np.int64)
    least[:] = _LAST
    for a, b in chunks(len(low)):
        np.minimum.at(least, kind[a:b], owner[a:b])
    room = length[heads] - SPAN + 1
    base = _before(room)  # of each different run, its first window among all of theirs
    winner = on_disk(int(base[-1] + room[-1]) if len(heads) else 0, np.int64)
    for k, (a, n) in enumerate(zip(base.tolist(), room.tolist(), strict=True)):
        winner[a : a + n] = least[k]
    mixed = _in_several(_window_keys(data, low[heads], length[heads]), base, np.arange(len(heads)))
    part, size, of = _shared_runs(mixed, base, low[heads], np.arange(len(heads)))
    left = int((size - SPAN + 1).sum())
    if left and SHRINKS * left <= (SHRINKS - 1) * int((length - SPAN + 1).sum()):
        inner = (values for _, values in _laid_out(*_winners(data, part, size, least[of]), size))
        held = np.zeros(0, np.int64)
        for a, b in chunks(len(mixed)):
            at = np.flatnonzero(mixed[a:b]) + a
            while len(held) < len(at):
                held = np.concatenate((held, next(inner)))
            winner[at], held = held[: len(at)], held[len(at) :]
    elif left:
        _settle_sorted(data, low[heads], length[heads], base, np.flatnonzero(np.add.reduceat(mixed, base)), winner)  # others share no window
    return kind, base, winner


def _laid_out(kind: np.ndarray, base: np.ndarray, winner: np.ndarray, length: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Some runs at a time, and what their texts' windows have, window by window."""
    at, runs = 0, length - SPAN + 1
    while at < len(runs):
        end = max(at + 1, int(np.searchsorted(np.cumsum(runs[at : at + BLOCK_BYTES]), BLOCK_BYTES)) + at)
        own = np.asarray(runs[at:end])
        inner = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        yield slice(at, end), winner[np.repeat(base[kind[at:end]], own) + inner]
        at = end


def _window_keys(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each window of strings in data, string by string, about SLICE_BYTES of them at a time."""
    out, low = Growing(np.uint64), 0
    while low < len(first):
        high = max(low + 1, int(np.searchsorted(np.cumsum(size[low : low + SLICE_BYTES]), SLICE_BYTES)) + low)
        own = np.asarray(size[low:high])
        begins, room = np.cumsum(own) - own, own - SPAN + 1
        text = data[np.arange(own.sum()) + np.repeat(first[low:high] - begins, own)]
        at = np.arange(room.sum()) + np.repeat(begins - (np.cumsum(room) - room), room)
        out.add(SpanHashes(text, fold=False)(at, at + SPAN))
        low = high
    return out.mapped()


def _in_several(keys: np.ndarray, base: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Whether each key has more than one owner; string k has the keys from base[k] on. Keys are dealt out once, by ranges of their values with some
    HELD_KEYS each, and each range is then read by itself, a chunk at a time, whose different keys are summed up before they are put together."""
    out = on_disk(len(keys), bool)
    passes = len(keys) // HELD_KEYS + 1
    parts = _by_range(keys, passes)
    for k in range(passes):
        seen = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for part, at in parts(k):
            own = owners[np.searchsorted(base, at, side="right") - 1]
            seen = _extremes(np.concatenate((seen[0], part)), np.concatenate((seen[1], own)), np.concatenate((seen[2], own)))
        more = seen[0][seen[1] != seen[2]]
        for part, at in parts(k) if len(more) else ():
            out[at] = more[np.minimum(np.searchsorted(more, part), len(more) - 1)] == part
    return out


def _by_range(keys: np.ndarray, passes: int) -> Callable[[int], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Gives, for one of so many ranges of values, the keys in it and their places, about a chunk at a time."""
    if passes == 1:
        return lambda _: ((np.asarray(keys[a:b]), np.arange(a, b)) for a, b in chunks(len(keys)))
    dealt, places, borders = Growing(np.uint64), Growing(np.int64), []
    for a, b in chunks(len(keys)):
        part = np.asarray(keys[a:b])
        which = ((part >> np.uint64(32)) * np.uint64(passes)) >> np.uint64(32)
        order = np.argsort(which, kind="stable")
        dealt.add(part[order])
        places.add(order + a)
        borders.append(a + np.searchsorted(which[order], np.arange(passes + 1, dtype=np.uint64)))
    dealt, places = dealt.mapped(), places.mapped()

    def read(k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for border in borders:
            held.append(slice(int(border[k]), int(border[k + 1])))
            size += held[-1].stop - held[-1].start
            if size >= HELD_KEYS or border is borders[-1]:
                yield np.concatenate([dealt[x] for x in held]), np.concatenate([places[x] for x in held])
                held, size = [], 0

    return read


def _extremes(keys: np.ndarray, least: np.ndarray, most: np.ndarray) -> list[np.ndarray]:
    """The different keys in order, each with the least of its least and the most of its most."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return [keys[heads], np.minimum.reduceat(least[order], heads), np.maximum.reduceat(most[order], heads)] if len(keys) else [keys, least, most]


def _shared_runs(several: np.ndarray, base: np.ndarray, first: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, length and document of each maximal run of windows that are in several documents; a run ends with its string, and may be
    parted where a chunk ends."""
    low, length, owner = Growing(np.int64), Growing(np.int64), Growing(np.int64)
    for a, b in chunks(len(several)):
        at = np.flatnonzero(several[a:b]) + a
        if not len(at):
            continue
        of = np.searchsorted(base, at, side="right") - 1
        place = first[of] + at - base[of]
        fresh = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(of) != 0))))
        last = np.append(fresh[1:], len(at)) - 1
        low.add(place[fresh])
        length.add(place[last] + SPAN - place[fresh])
        owner.add(doc[of[fresh]])
    return low.mapped(), length.mapped(), owner.mapped()


def _kinds(data: np.ndarray, low: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run the number of its text, and for each different text its first run: found by hash and length, compared byte by byte."""
    keys = Growing(np.uint64)
    spans = lambda a, b: np.arange(length[a:b].sum()) + np.repeat(low[a:b] - (np.cumsum(length[a:b]) - length[a:b]), length[a:b])
    pieces, at = [], 0
    while at < len(low):
        end = max(at + 1, int(np.searchsorted(np.cumsum(length[at : at + SLICE_BYTES]), SLICE_BYTES)) + at)
        pieces.append((at, end))
        stops = np.cumsum(length[at:end])
        keys.add(SpanHashes(data[spans(at, end)], fold=False)(stops - length[at:end], stops))
        at = end
    keys = keys.mapped()
    order = np.lexsort((np.arange(len(low)), length, keys))  # eight bytes for each run, which is of SPAN bytes at least
    fresh = np.append(True, (np.diff(keys[order]) != 0) | (np.diff(length[order]) != 0))[: len(order)]
    kind, heads = on_disk(len(low), np.int64), order[fresh]
    kind[order] = np.cumsum(fresh) - 1
    apart = []
    for a, b in pieces:
        other = low[heads[kind[a:b]]]
        own = np.asarray(length[a:b])
        there = np.arange(own.sum()) + np.repeat(other - (np.cumsum(own) - own), own)
        unlike = data[spans(a, b)] != data[there]
        if unlike.any():
            apart += (a + np.flatnonzero(np.logical_or.reduceat(unlike, np.cumsum(own) - own))).tolist()
    kind[apart] = len(heads) + np.arange(len(apart))
    return kind, np.concatenate((heads, np.array(apart, np.int64))).astype(np.int64)


def _settle_sorted(data: np.ndarray, low: np.ndarray, length: np.ndarray, base: np.ndarray, chosen: np.ndarray, winner: np.ndarray) -> None:
    """Lower winner to the least over all equal windows of the chosen strings: neighbours in suffix order with SPAN bytes in common."""
    if len(chosen) < 2:
        return
    text, home = Growing(np.int32), Growing(np.int64)
    for k in chosen.tolist():
        a, n = int(low[k]), int(length[k])
        text.add(np.append(data[a : a + n].astype(np.int32) + 2, 1))
        home.add(np.concatenate((base[k] + np.arange(n - SPAN + 1), np.full(SPAN, -1))))
    text.add(np.zeros(1))
    home.add(np.full(1, -1))
    home, group, least = memoryview(home.mapped()), Growing(np.int64), _LAST
    ends = memoryview(winner)
    held: list[int] = []
    for place, common in induced_order(text.mapped(), SPAN):
        if (k := home[place]) >= 0:
            held.append(k)
            least = min(least, ends[k])
            if len(held) >= HELD_KEYS:
                group.add(np.array(held))
                held = []
        if common < SPAN:
            if group.n:
                for a, b in chunks(group.n):
                    winner[group.mapped()[a:b]] = least
                group = Growing(np.int64)
            if held:
                for k in held:
                    ends[k] = least
            held, least = [], _LAST


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        for k, (_, _, offsets, data) in enumerate(_opened(batch)):
            bits = batch["cover"][k].as_py()
            gone = np.unpackbits(np.frombuffer(unpress.decompress(bits), np.uint8), count=len(data)).astype(np.int64) if bits else np.zeros(len(data), np.int64)
            edges = np.zeros(len(data) + 1, np.int64)
            for raw in batch["places"][k].as_py() or ():
                places = np.frombuffer(raw, np.int64)
                np.add.at(edges, places, 1)
                np.add.at(edges, places + SPAN, -1)
            gone = (gone + np.cumsum(edges[:-1])) > 0
            n, removed, spans, kept = [], [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own = gone[a:b]
                n.append(int(b - a))
                removed.append(int(own.sum()))
                spans.append(int((np.diff(own.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(data[a:b][~own].tobytes())
            columns = [pa.array(batch["ids"][k].as_py(), pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for each row: UTF-8 bytes without those that a SPAN-byte string covers which
    also starts in a row of a smaller doc_id.

    Strings are judged on the input and never cross rows. Cutting may split a character, hence kept is binary. A null text counts as
    empty. A null doc_id is after all others, and rows without one cover nothing. Rows that share a doc_id don't cover each other.
    A text shorter than SPAN bytes stays. A very long text is one block, held by one task at a time. No rows give no rows. Other columns of
    docs are not looked at. parts is the number of shards; by default it grows with the text, and a shard's arrays are in files.

    That two stretches, or windows of one shard, are alike is told by 96 and more bits of hashes where no text is compared.
    """
    blocks = materialize(docs.select("doc_id", "text").mapInArrow(_pack, "block long, ids array<long>, offsets array<long>, packed binary"))
    if not parts:
        volume = blocks.agg(F.sum(F.element_at("offsets", -1))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-volume // SHARD_TEXT))
    told = blocks.mapInArrow(_announce(parts), "block long, part long, anchors binary, contents binary, ids binary, of binary")
    fates = told.repartitionById(parts, F.col("part").cast("int")).mapInArrow(_fates, "block long, part long, covered binary, open binary")
    by_block = fates.groupBy("block").agg(F.collect_list(F.struct("part", "covered", "open")).alias("told"))  # a row for each part at most
    spread = materialize(blocks.join(by_block, "block", "left").mapInArrow(_spread(parts), "block long, shard long, payload binary, n long"))
    settled = spread.where("shard IS NOT NULL").repartitionById(parts, F.col("shard").cast("int")).mapInArrow(_settle, "block long, places binary")
    places = settled.groupBy("block").agg(F.collect_list("places").alias("places"))  # again a few rows for each part
    cover = spread.where("shard IS NULL").select("block", F.col("payload").alias("cover"))
    return blocks.join(cover, "block", "left").join(places, "block", "left").mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, n, c, substr(h, 1000 * c + 1, 1098) AS g FROM (SELECT doc_id, h, strlen(h) // 2 AS n, unnest(range(0, (strlen(h) // 2 + 499) // 500)) AS c FROM d)),
w AS (SELECT doc_id, 500 * c + j AS i, substr(g, 2 * j + 1, 2) AS x, CASE WHEN 500 * c + j + 50 <= n THEN substr(g, 2 * j + 1, 100) END AS k FROM (SELECT *, unnest(range(0, least(500, n - 500 * c))) AS j FROM p)),
r AS (SELECT k, min(doc_id) AS least FROM w WHERE k IS NOT NULL GROUP BY k HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT w.doc_id, w.i, w.x, CASE WHEN r.least < w.doc_id THEN 1 ELSE 0 END AS hit FROM w LEFT JOIN r ON w.k = r.k),
c AS (SELECT doc_id, i, x, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM c),
s AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (gone = 1 AND was = 0) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, (strlen(d.h) // 2)::BIGINT AS n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(s.kept, ''))) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
