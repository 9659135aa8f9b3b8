"""BPE encoding and decoding with a public vocabulary, reusing content-defined chunks that texts share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import FOLD, SpanHashes, distinct, released, slices, token_bounds

VOCABULARY = "word_bpe_49k.json"
#: Bytes that the rolling hash sees, and its leading bits that are zero at a cut: chunks of some 512 bytes.
SIGHT, CUT_BITS = 16, 9
#: Bytes of stretches that a worker's store of chunks, and that of words, hold; a full one is emptied.
CHUNK_BYTES, WORD_BYTES = 1 << 24, 1 << 23
#: Bytes of text that are looked at together.
TEXT_BYTES = 1 << 19

_NOT_BLANK = np.array([b not in (0x20, 0x0A) for b in range(256)])
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_POINT = np.array([chr(b) in ".,;:!?" for b in range(256)])
_ENCODERS: dict[str, ChunkEncoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Clash(Exception):
    """Two different stretches of bytes have one hash."""


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begins[0], begins[0] + 1, ... of sizes[0] items, then those of the next."""
    return np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


class Store:
    """Encoded stretches of bytes by hash; what a hash finds is compared byte by byte."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.clear(0)

    def clear(self, room: int) -> None:
        self.keys, self.rows, self.used, self.n_ids = np.zeros(0, np.uint64), np.zeros((0, 6), np.int32), 0, 0
        self.raw, self.ids = np.empty(max(self.limit, room), np.uint8), np.empty(max(self.limit, room), np.int32)

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each stretch is there, and the rows of those that are: begin and size of its bytes and ids, ids of its first and of its last word."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), self.rows
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        here = self.keys[at] == hashes
        rows = self.rows[at[here]]
        sizes = (ends - starts)[here]
        if (sizes != rows[:, 1]).any() or (self.raw[_spread(rows[:, 0].astype(np.int64), sizes)] != data[_spread(starts[here], sizes)]).any():
            raise Clash
        return here, rows

    def add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, sizes: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> None:
        """Put in different stretches that are not there yet."""
        lengths = ends - starts
        if max(self.used + lengths.sum(), self.n_ids + len(ids)) > len(self.raw):
            self.clear(int(max(lengths.sum(), len(ids))))
        self.raw[self.used : self.used + lengths.sum()] = data[_spread(starts, lengths)]
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        rows = np.stack([self.used + np.cumsum(lengths) - lengths, lengths, self.n_ids + np.cumsum(sizes) - sizes, sizes, heads, tails], axis=1).astype(np.int32)
        self.used, self.n_ids = self.used + int(lengths.sum()), self.n_ids + len(ids)
        order = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[order])
        self.keys, self.rows = np.insert(self.keys, at, hashes[order]), np.insert(self.rows, at, rows[order], axis=0)


class ChunkEncoder:
    """Encodes texts chunk by chunk; a chunk that is known from whatever text is not encoded again.

    Cuts lie where a hash of the last SIGHT bytes says so, hence at the same places in shared passages, be it within a word. Each
    chunk is encoded as if it were a text. Where a cut has broken a word, the ids beside it are wrong: the join, from the word
    before the broken one to the word after it, is encoded anew, and if what that gives for both of these words isn't what they
    have by themselves, a longer join is, until both ends agree or it is the whole text. Words are what blanks and newlines part;
    a new chunk's words, less a point after a letter, are looked up too, so that each is given to the library once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.names = [self.tokenizer.id_to_token(k) for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.zero = self._plain("0")
        #: What the vocabulary does not tell apart or leave whole is asked for, not taken for granted.
        some = [x for x in (n.removesuffix("</w>") for n in self.names[::23]) if x.isascii() and x.isalpha()]
        self.folds = all(np.array_equal(self._plain(x.upper()), self._plain(x)) for x in some)
        self.model = self.tokenizer.model
        self.bare = all(self._plain(x).tolist() == [t.id for t in self.model.tokenize(x.lower() if self.folds else x)] for x in some)
        self.parts = all(np.array_equal(self._plain(x + "."), np.append(self._plain(x), self._plain("."))) for x in some)
        self.chunks, self.words = Store(CHUNK_BYTES), Store(WORD_BYTES)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        try:
            return self._by_chunks(data, offsets)
        except Clash:
            return self._whole(data, offsets)

    def _by_chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = SpanHashes(data, fold=False)
        edges = distinct(np.concatenate((offsets, self._cuts(data, hashes))))
        starts, ends = edges[:-1], edges[1:]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ids, begins, sizes, heads, tails = self._known(self.chunks, hashes, data, starts, ends, self._new_chunks)
        low, high, firsts = token_bounds(data, offsets, _NOT_BLANK)  # words of the whole texts
        inner = edges[1:-1]
        of = np.searchsorted(low, inner, side="right") - 1
        broken = (of >= 0) & (low[np.maximum(of, 0)] < inner) & (inner < high[np.maximum(of, 0)]) if len(low) else np.zeros(len(inner), bool)
        left, right = np.append(False, broken), np.append(broken, False)
        gone = (heads == sizes) & (left | right) & (tails == sizes)  # nothing but part of one word
        cut_head, cut_tail = np.where(left & ~gone, heads, 0), np.where(right & ~gone, tails, 0)
        sizes_left = np.where(gone, 0, sizes - cut_head - cut_tail)
        joins = distinct(of[broken])
        flat, begin, size, whole = self._repair(data, low, high, firsts, joins)
        if whole:
            return self._whole(data, offsets)
        order = np.argsort(np.concatenate((starts * 2, low[joins] * 2 + 1)), kind="stable")
        place = np.concatenate((starts, low[joins]))[order]
        both = np.concatenate((ids, flat))
        begin, size = np.concatenate((begins + cut_head, begin + len(ids)))[order], np.concatenate((sizes_left, size))[order]
        stops = np.append(0, np.cumsum(size))
        return both[_spread(begin, size)], stops[np.searchsorted(place, offsets)]

    def _cuts(self, data: np.ndarray, hashes: SpanHashes) -> np.ndarray:
        """Where the rolling hash says so, if not also one byte before (as in runs of one character), and a character begins."""
        at = np.arange(SIGHT, len(data))
        zero = (hashes(at - SIGHT, at) >> np.uint64(64 - CUT_BITS)) == 0
        zero[1:] &= ~zero[:-1]
        cut = at[zero]
        return cut[(data[cut] & 0xC0) != 0x80]

    def _known(self, store: Store, hashes: SpanHashes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, ...]:
        """For each stretch the place, number, and numbers at the first and last word, of its ids in an array of ids; new ones are encoded
        once each, and stored."""
        keys = hashes(starts, ends)
        order = np.argsort(keys, kind="stable")
        fresh = np.append(True, np.diff(keys[order]) != 0)[: len(order)]
        first = order[fresh]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(fresh) - 1
        sizes = ends - starts
        again = np.flatnonzero(first[group] != np.arange(len(starts)))
        same = first[group[again]]
        if (sizes[again] != sizes[same]).any() or (data[_spread(starts[again], sizes[again])] != data[_spread(starts[same], sizes[again])]).any():
            raise Clash
        here, rows = store.find(keys[first], data, starts[first], ends[first])
        begin, n, head, tail = np.zeros((4, len(first)), np.int64)
        begin[here], n[here], head[here], tail[here] = np.arange(rows[:, 3].sum() + 1)[np.cumsum(rows[:, 3]) - rows[:, 3]], rows[:, 3], rows[:, 4], rows[:, 5]
        ids = store.ids[_spread(rows[:, 2].astype(np.int64), rows[:, 3].astype(np.int64))]
        new = first[~here]
        if len(new):
            made, own, heads, tails = encode(hashes, data, starts[new], ends[new])
            store.add(keys[new], data, starts[new], ends[new], made, own, heads, tails)
            begin[~here], n[~here], head[~here], tail[~here] = len(ids) + np.cumsum(own) - own, own, heads, tails
            ids = np.concatenate((ids, made))
        return ids, begin[group], n[group], head[group], tail[group]

    def _new_chunks(self, hashes: SpanHashes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids of some chunks, their numbers, and those of the words (or parts of words) at both ends."""
        text = data[_spread(starts, ends - starts)]
        bounds = np.append(0, np.cumsum(ends - starts))
        low, high, firsts = token_bounds(text, bounds, _NOT_BLANK)
        ids, n = self._words(text, low, high)
        total = np.append(0, np.cumsum(n))
        some = firsts[1:] > firsts[:-1]
        heads, tails = np.zeros((2, len(starts)), np.int64)
        if len(low):
            a, b = np.minimum(firsts[:-1], len(low) - 1), np.maximum(firsts[1:] - 1, 0)
            heads = np.where(some & (low[a] == bounds[:-1]), n[a], 0)
            tails = np.where(some & (high[b] == bounds[1:]), n[b], 0)
        return ids, np.diff(total[firsts]), heads, tails

    def _words(self, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, in order, and how many each has."""
        if not len(low):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.folds and not (text == 0x3C).any():  # special tokens begin with this sign, and are told apart
            text = FOLD[text]
        off = (high - low > 1) & _POINT[text[high - 1]] & _LETTER[text[high - 2]] & self.parts
        starts, ends = np.concatenate((low, high[off] - 1)), np.concatenate((high - off, high[off]))
        order = np.argsort(starts, kind="stable")
        ids, begin, n, _, _ = self._known(self.words, SpanHashes(text, fold=False), text, starts[order], ends[order], self._new_words)
        total = np.append(0, np.cumsum(n))
        past = np.cumsum(1 + off)
        return ids[_spread(begin, n)], total[past] - total[past - 1 - off]

    def _new_words(self, hashes: SpanHashes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        ids, sizes = self._library(data, starts, ends)
        return ids, sizes, sizes, sizes

    def _repair(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, firsts: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """Ids of all broken words, place and number of each one's, and whether some text's joins never agreed."""
        row = np.searchsorted(firsts, joins, side="right") - 1
        first, last = firsts[row], firsts[row + 1] - 1
        begin, size = np.zeros((2, len(joins)), np.int64)
        parts, held, span, live = [np.zeros(0, np.int32)], 0, 1, np.arange(len(joins))
        while len(live):
            a, b = np.maximum(joins[live] - span, first[live]), np.minimum(joins[live] + span, last[live])
            ids, n = self._library(data, low[a], high[b])
            at = np.cumsum(n) - n
            before, after = self._own(data, low, high, a, joins[live]), self._own(data, low, high, joins[live] + 1, b + 1)
            good = self._agrees(ids, at, n, *before, True) & self._agrees(ids, at, n, *after, False) & (n >= before[1] + after[1])
            begin[live], size[live] = held + at + before[1], n - before[1] - after[1]
            parts.append(ids)
            held += len(ids)
            left = ~good
            if (left & (a == first[live]) & (b == last[live])).any():
                return parts[0], begin, size, True
            live, span = live[left], span * 2
        return np.concatenate(parts), begin, size, False

    def _own(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids that the words from a to before b have by themselves, one join after the other, and how many each join has."""
        words = _spread(a, b - a)
        starts, ends = low[words], high[words]
        text = data[_spread(starts, ends - starts)]
        stops = np.cumsum(ends - starts)
        ids, n = self._words(text, stops - (ends - starts), stops)
        total = np.append(0, np.cumsum(n))
        past = np.cumsum(b - a)
        return ids, total[past] - total[past - (b - a)]

    @staticmethod
    def _agrees(ids: np.ndarray, at: np.ndarray, n: np.ndarray, want: np.ndarray, sizes: np.ndarray, front: bool) -> np.ndarray:
        """Whether each join's ids begin (or end) with those wanted."""
        good = n >= sizes
        sizes_left = np.where(good, sizes, 0)
        there = _spread(at if front else at + n - sizes_left, sizes_left)
        own = _spread(np.cumsum(sizes) - sizes, sizes_left)
        wrong = np.repeat(np.arange(len(n)), sizes_left)[ids[there] != want[own]]
        good[wrong] = False
        return good

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _library(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of some stretches, and their numbers. Bare words go to its model at once; others many in one call, with a
        lone zero between them; those with a zero in them one by one."""
        raw = data.tobytes()
        out: list[list[int]] = []
        plain, texts, tokenize = [], [], self.model.tokenize
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            x = raw[a:b]
            if self.bare and x.isalpha():  # of bytes: ASCII letters alone
                out.append([t.id for t in tokenize((x.lower() if self.folds else x).decode())])
            elif b"0" in x:
                out.append(self._plain(x.decode()).tolist())
            else:
                out.append([])
                plain.append(k)
                texts.append(x.decode())
        ids = self._plain(" 0 ".join(texts)).tolist()
        stops = [k for k, x in enumerate(ids) if x == self.zero[0]] if len(self.zero) == 1 else []
        if len(stops) == len(plain) - 1:
            for k, a, b in zip(plain, [0, *(x + 1 for x in stops)], [*stops, len(ids)], strict=True):
                out[k] = ids[a:b]
        else:
            for k, x in zip(plain, texts, strict=True):
                out[k] = self._plain(x).tolist()
        return np.array([x for own in out for x in own], np.int32), np.array([len(x) for x in out], np.int64)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text given to the library as it is."""
        raw = data.tobytes()
        made = [self._plain(raw[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.concatenate([np.zeros(0, np.int32), *made]), np.cumsum([0] + [len(x) for x in made])


def _encoder(path: str) -> ChunkEncoder:
    """One for each worker process, so that chunks are known across its tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>), decoded (the ids' tokens joined by blanks, as the vocabulary without a decoder has it) for each row.

    A null or empty text has no ids and decodes to an empty string; white space alone has none either. Equal rows are encoded
    alike, and a null doc_id is like any other. A very long text is encoded in one task, whose memory it is a small multiple of.
    No rows give no rows. path names the vocabulary file on every executor. Other columns of docs are not looked at.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        names = pa.array(encoder.names, pa.string())
        for batch in batches:
            for low, high, data, offsets in slices(batch["text"], TEXT_BYTES):
                flat, stops = encoder.encode(data, offsets)
                flat, stops = pa.array(flat, pa.int32()), pa.array(stops, pa.int32())
                decoded = pc.binary_join(pa.ListArray.from_arrays(stops, names.take(flat)), " ")
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(low, high - low), pa.ListArray.from_arrays(stops, flat), decoded], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text (the tokens of ids joined by blanks; unknown or null ids are left out) for each row of doc_id, ids.

    Null or empty ids give an empty text; no rows give no rows. Other columns are not looked at.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _encoder(path).names
        known = pa.array(names, pa.string())
        for batch in batches:
            ids = [[i for i in row or () if i is not None and 0 <= i < len(known)] for row in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([" ".join([names[i] for i in row]) for row in ids], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(released(run), "doc_id long, text string")


def digest(result: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return result.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
