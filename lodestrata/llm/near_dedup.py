"""MinHash near-dedup: banded SetSketch registers propose links, the sketches' joint likelihood sifts them, whole sets confirm them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, materialize
from .textcore import NOT_SPACE, distinct, mix, released, rolling, slices, span_hashes, token_bounds

REGISTERS, ROWS = 504, 7
#: Base of the register values and their rate: values are 1 - log_base(minimum), between 0 and LIMIT + 1.
BASE, RATE, LIMIT = 1.02, 20.0, 1400
#: Standard deviations that a sketch's estimate may fall short of the threshold before whole sets are no longer compared.
MARGIN = 5.0
#: Unresolved texts, and others, that one comparison task holds, and bytes of sketches and compressed texts of either.
ASKING, ASKED = 512, 1024
ASKING_BYTES, ASKED_BYTES = 8 << 20, 16 << 20
#: Bytes of shingle sets that a comparison keeps for later pairs.
HELD_BYTES = 64 << 20
#: Pairs whose comparison costs as much as moving a text into a block.
MOVING = 64
#: Slots of the bitmap of ids whose texts are fetched; beyond that many ids, more texts than needed are moved.
SLOTS = 1 << 22

_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64))
_XOR = (_SEEDS >> np.uint64(32)).astype(np.uint32)
_ODD = (_SEEDS.astype(np.uint32)) | np.uint32(1)
_BLOCK = 64
_ROOM = np.empty((_BLOCK, REGISTERS), np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The distinct 64-bit shingles of each text, in order; a text of fewer words has its whole sequence as one."""
    starts, ends, firsts = token_bounds(data, offsets, NOT_SPACE)
    hashes = span_hashes(data, starts, ends)
    windows = rolling(hashes, words)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(distinct(windows[a : b - words + 1]))
        else:
            out.append(rolling(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers: the exponentially spaced, truncated minimum of each of REGISTERS hashes; a union's are the larger of both."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), _BLOCK):
        part = low[at : at + _BLOCK, None]
        room = _ROOM[: len(part)]
        np.bitwise_xor(part, _XOR, out=room)
        np.multiply(room, _ODD, out=room)
        np.minimum(least, room.min(axis=0), out=least)
    smallest = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity most likely for pairs of sketches (rows) of sets of known sizes.

    With u and v the sets' shares of both sizes and J the similarity, a register of a is larger with chance p(u - vJ), one of b
    with p(v - uJ), and else they are equal, where p(x) = -log_base(1 - x (base - 1) / base). The likelihood of all three counts
    is climbed on a grid that grows finer.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = REGISTERS - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1 - 1e-12)

    for _ in range(3):
        grid = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, 12)
        up, down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
        total = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
        best = np.take_along_axis(grid, total.argmax(axis=1)[:, None], axis=1)[:, 0]
        step = (high - low) / 11
        low, high = np.maximum(best - step, 0), np.minimum(best + step, np.minimum(u / v, v / u))
    return best


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch["text"]):
                sets = shingle_sets(data, offsets, words)
                columns = [
                    batch["doc_id"].slice(low, high - low), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                    pa.array([sketch(x).tobytes() if len(x) else b"" for x in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "sketch"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each band of a row's sketch its key, beside the row's other columns (longs)."""
    for batch in batches:
        registers = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint16).reshape(len(batch), -1, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, REGISTERS // ROWS + 1, dtype=np.uint64), registers.shape[:2])
        for k in range(ROWS):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + registers[:, :, k])
        names = [x for x in batch.schema.names if x != "sketch"]
        others = [pa.array(np.repeat(batch[x].to_numpy(zero_copy_only=False), REGISTERS // ROWS)) for x in names]
        yield pa.RecordBatch.from_arrays([*others, pa.array(key.reshape(-1).view(np.int64))], [*names, "band"])


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(x) + len(y) - len(distinct(np.concatenate((x, y))))
    return 100 * both >= percent * (len(x) + len(y) - both) > 0


class _Sets:
    """Shingle sets of compressed texts; of those made before, HELD_BYTES at most are held."""

    def __init__(self, words: int) -> None:
        import zstandard

        self.unpress, self.words, self.held, self.size = zstandard.ZstdDecompressor(), words, {}, 0

    def of(self, packed: bytes) -> np.ndarray:
        if packed in self.held:
            return self.held[packed]
        data = np.frombuffer(self.unpress.decompress(packed), np.uint8)
        made = shingle_sets(data, np.array([0, len(data)]), self.words)[0]
        if self.size + made.nbytes + len(packed) > HELD_BYTES:
            self.held, self.size = {}, 0
        self.held[packed], self.size = made, self.size + made.nbytes + len(packed)
        return made


def _compare(words: int, percent: int):
    """Links between a block of asking texts and a block of others: by sketch first, then on whole sets at once, so that no pairs but
    links leave the task. Components that a link has joined aren't compared again."""
    threshold = percent / 100
    margin = threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / REGISTERS)

    def run(table):
        asks = table["asks"].to_numpy()
        ids, label, n = (table[x].to_numpy() for x in ("id", "label", "n"))
        registers = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        packed, sets, joined, out = table["packed"], _Sets(words), {}, []

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        for k in mine:
            other = theirs[(label[theirs] != label[k]) & (np.minimum(n[theirs], n[k]) >= threshold * np.maximum(n[theirs], n[k]) - 1e-9)]
            other = other[(registers[other] == registers[k]).mean(axis=1) >= margin]  # equal registers are at least as frequent as J
            if not len(other):
                continue
            near = likely(registers[other], registers[np.full(len(other), k)], n[other].astype(float), np.full(len(other), float(n[k])))
            for j in other[np.argsort(-near)][: int((near >= margin).sum())]:
                a, b = root(int(label[k])), root(int(label[j]))
                if a != b and _similar(sets.of(packed[k].as_py()), sets.of(packed[j].as_py()), percent):
                    joined[max(a, b)] = min(a, b)
                    out.append((int(ids[k]), int(ids[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _packed(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        slots, press = wanted.value, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            mine = batch.filter(pa.array(slots[batch["slot"].to_numpy(zero_copy_only=False)]))
            texts = [press.compress((x or "").encode()) for x in mine["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([mine["doc_id"], pa.array(texts, pa.binary())], ["id", "packed"])

    return run


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(words)
        for batch in batches:
            good = [_similar(sets.of(x.as_py()), sets.of(y.as_py()), percent) for x, y in zip(batch["packed_a"], batch["packed_b"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _texts(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """id, packed: compressed texts of those ids, and of a few more rows whose ids share their slots of a bitmap."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    bits = np.zeros(SLOTS, bool)
    bits[ids.select(slot("id").alias("slot")).distinct().toPandas()["slot"].to_numpy(dtype=np.int64)] = True  # SLOTS values at most
    wanted = docs.sparkSession.sparkContext.broadcast(bits)
    return scratch.table(docs.select("doc_id", "text", slot("doc_id").alias("slot")).mapInArrow(released(_packed(wanted)), "id long, packed binary"))


def _links(pairs: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those of pairs (a, b) whose whole sets are as similar as asked. Texts move compressed, and only those of ids in pairs."""
    texts = _texts(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), scratch)
    one, other = texts.withColumnsRenamed({"id": "a", "packed": "packed_a"}), texts.withColumnsRenamed({"id": "b", "packed": "packed_b"})
    return pairs.join(other, "b").join(one, "a").select("a", "b", "packed_a", "packed_b").mapInArrow(released(_confirm(words, percent)), "a long, b long").distinct()


def _units(rows: DataFrame, *by: str) -> DataFrame:
    """Of each group of rows that is in more than one component: its largest component, into how many blocks the texts outside it, and
    all, are parted, what comparing the ones with the others costs, and its rows' number and hashes, which tell equal groups."""
    hashes = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    parts = rows.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"), *hashes)
    whole = parts.groupBy(*by).agg(
        F.sum("size").alias("total"), F.sum("bytes").alias("bytes"), F.max(F.struct("size", "label", "bytes")).alias("most"), F.count(F.lit(1)).alias("parts"), *[F.bit_xor(h).alias(h) for h in ("h1", "h2")]
    ).where("parts > 1")
    outside, outside_bytes = F.col("total") - F.col("most.size"), F.col("bytes") - F.col("most.bytes")
    blocks = lambda n, most, size, most_bytes: F.greatest(F.ceil(n / most), F.ceil(size / most_bytes)).cast("int")
    return whole.select(
        *by, F.col("most.label").alias("main"), blocks(outside, ASKING, outside_bytes, ASKING_BYTES).alias("askers"), blocks(F.col("total"), ASKED, F.col("bytes"), ASKED_BYTES).alias("others"),
        ((outside + F.lit(float(MOVING))) * F.col("total")).alias("cost"), "total", "h1", "h2",
    )


def _blocks(ready: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks (grp, band, x, y) of texts that ask and texts that are asked, of all components but the asking one's.

    A group tied by bands that is one block is compared as it is. In a larger one every link still to be found shares a band, so texts are
    compared within the bands' buckets, equal buckets once; or all at once, where that costs less as most texts share most of
    their bands. The buckets of texts tied through others only are small, however large the group.
    """
    groups = scratch.table(_units(ready, "grp"))
    large = groups.where("CAST(askers AS long) * others > 1")
    several = ready.join(large.select("grp"), "grp", "left_semi").select("grp", "id", "label", "bytes", "sketch")
    members = scratch.table(several.mapInArrow(released(_bands), "grp long, id long, label long, bytes long, band long"))
    buckets = scratch.table(_units(members, "grp", "band").dropDuplicates(["grp", "total", "h1", "h2"]))
    summed = buckets.groupBy("grp").agg(F.sum("cost").alias("apart"))
    parted = scratch.table(large.join(summed, "grp", "left").where("coalesce(apart, 0) < cost").select("grp"))
    plan = ["main", "askers", "others"]
    whole = ready.join(groups.select("grp", *plan).join(parted, "grp", "left_anti"), "grp").withColumn("band", F.lit(0).cast("long"))
    inside = members.join(buckets.join(parted, "grp", "left_semi").select("grp", "band", *plan), ["grp", "band"]).select("grp", "band", "id", *plan)
    columns = ["grp", "band", "id", "label", "n", "sketch", "packed", *plan]
    rows = whole.select(*columns).union(inside.join(ready.drop("grp"), "id").select(*columns))
    spot = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    carried = ["id", "label", "n", "sketch", "packed"]
    asking = rows.where("label <> main").select("grp", "band", spot("askers").alias("x"), every("others").alias("y"), F.lit(True).alias("asks"), *carried)
    asked = rows.select("grp", "band", every("askers").alias("x"), spot("others").alias("y"), F.lit(False).alias("asks"), *carried)
    return asking.union(asked)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_class for each row of docs.

    Texts are sets of `words`-word shingles; two are linked if 100 * shared >= percent * union. component_id is the smallest
    doc_id that links reach, kept says whether it is the row's own. Equal sets are one class (n_class rows) and looked at once.

    A null text, or one without words, is linked with nothing. A row without a doc_id is linked with nothing either, has no
    component and is kept. Rows that share a doc_id are one document, linked by whatever text of theirs is near.

    Texts with a band of registers in common are compared with the band's first; links among these make a first round of
    components. Where texts tied by bands fall into more than one component, every text outside the largest one is compared with
    texts in other components, in blocks bounded by rows and bytes: with all of a small group, and within the bands' buckets of a large one
    (see _blocks); by sketch, and what may be near enough by MARGIN deviations on whole sets. At the threshold, a link shares no
    band with chance (1 - 0.8**ROWS)**(REGISTERS / ROWS), some 4e-8. Very long texts are blocks of few rows.
    """
    docs, scratch = docs.select("doc_id", "text"), Scratch(docs.sparkSession)
    made = materialize(docs.mapInArrow(released(_sketches(words)), "doc_id long, n_shingles long, set_key binary, sketch binary"))
    full = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.table(full.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n_class")))
    chosen = classes.select("set_key", F.col("id").alias("doc_id"))
    nodes = scratch.table(full.join(chosen, ["set_key", "doc_id"]).dropDuplicates(["set_key"]).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch"))
    bands = nodes.select("id", "sketch").mapInArrow(released(_bands), "id long, band long")
    hubs = scratch.table(bands.groupBy("band").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("times")).where("times > 1").select("band", "a"))
    tied = scratch.table(bands.join(hubs, "band").where("a <> id").select("a", F.col("id").alias("b")).distinct())
    first = scratch.table(_links(tied, docs, words, percent, scratch))
    groups, labels = connected_components(tied), connected_components(first)
    scratch.paths += [groups.written_to, labels.written_to]
    sides = groups.withColumnRenamed("component", "grp").join(labels.withColumnRenamed("component", "label"), "id", "left")
    sides = scratch.table(sides.withColumn("label", F.coalesce("label", "id")))
    unlike = sides.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("grp")
    ready = scratch.table(sides.join(unlike, "grp"))
    ready = ready.join(nodes, "id").join(_texts(docs, ready.select("id"), scratch), "id")
    ready = scratch.table(ready.withColumn("bytes", (F.length("sketch") + F.length("packed")).cast("long")))
    second = _blocks(ready, scratch).groupBy("grp", "band", "x", "y").applyInArrow(_compare(words, percent), "a long, b long")
    final = connected_components(first.union(second))
    scratch.paths += [final.written_to]
    named = classes.join(final, "id", "left").select("set_key", "n_class", F.coalesce("component", "id").alias("component"))
    named = materialize(named)
    scratch.clear()
    ids = made.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    rows = ids.join(named, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), F.coalesce("n_class", F.lit(1)).alias("n_class"))


def keep_one_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all columns, that near_duplicates keeps: of each component the one of the smallest doc_id.

    Rows without words or without a doc_id are linked with nothing and stay; rows that share a doc_id stay or go together. Columns
    may have any names: rows are carried as structs. No rows give no rows. docs is read several times, so let it be a table.
    Only rows whose ids share a slot of a bitmap with a dropped id are joined with the dropped ids; all others go straight on.
    """
    gone = materialize(near_duplicates(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct())
    bits = np.zeros(SLOTS, bool)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    bits[gone.select(slot("gone").alias("slot")).distinct().toPandas()["slot"].to_numpy(dtype=np.int64)] = True  # SLOTS values at most
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    rows = docs.select(F.struct("*").alias("row"))

    def pick(near: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = shared.value[batch["slot"].to_numpy(zero_copy_only=False)]
                yield batch.filter(pa.array(hit == near)).select(["row"])

        return rows.withColumn("slot", slot("row.doc_id")).mapInArrow(released(run), rows.schema)

    kept = pick(False).union(pick(True).join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i : array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS k FROM t),
x AS (SELECT doc_id, len(k) AS n, unnest(k) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.k)::BIGINT AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept FROM s JOIN c ON s.doc_id = c.doc_id
"""
