"""WARC archives with a two-level capture index: compressed blocks of sorted keys, and a sparse directory of the blocks."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, materialize, shared_dir

#: Bytes of a file after which the next begins; lines of a block at least, and blocks of an index, but for one more a partition, at most.
FILE_BYTES, BLOCK_LINES, BLOCKS = 256_000_000, 1000, 100_000
#: Bytes between records that are read over rather than asked for apart, and bytes that are read at once if records are smaller.
GAP, SPAN = 64_000, 8_000_000
#: Bytes of a file that one task reads.
STRETCH = 32_000_000
URL_KEY = 512
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LINES = "line string, file string, offset long, length long"
DIRECTORY = "first string, part int, file string, offset long, length long, lines long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = DATE) -> DataFrame:
    """Write a gzipped WARC record for every row of pages and the index of them all into folder; gives the directory.

    Of the rows with an equal payload (html in UTF-8; null: empty) of least bytes or more, those with the smallest key are responses and the others revisits of it, without a
    payload; smaller ones are all responses. Rows that repeat that smallest key, too, are responses each; a null key is larger than any
    other, and alone with its payload a response. Keys are whole numbers. A null or empty url is written as urn:page:KEY.

    Payloads that occur once move to no other task if there are few that repeat, else with their digest; a digest with very many rows is a hot side of a join
    with one row on the other, both read from plain shuffles or tables, which adaptive execution splits. Tasks write files in folder under names of their own
    and only the rows that Spark commits name them, so a lost task's file is never referred to. The folder must be one that pyarrow can open (file, s3, gs,
    hdfs), shared by all executors. An index has some 100,000 blocks at most: with more captures, blocks get longer.
    """
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    copies = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    copies = scratch.table(copies.where("n > 1").select("digest", "first"))
    known = rows.join(copies, "digest", "left").select("id", "url", "payload", "digest", "first")
    lines = scratch.table(known.mapInArrow(lambda batches: _write_records(batches, folder, date), LINES))
    per_block = max(BLOCK_LINES, -(-lines.count() // BLOCKS))
    sorted_ = lines.repartitionByRange("line").sortWithinPartitions("line")
    sorted_.mapInArrow(lambda batches: _write_blocks(batches, folder, per_block), DIRECTORY).write.parquet(f"{folder}/directory")
    scratch.clear()
    return directory(pages.sparkSession, folder)


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """first (the first line of each block), where the block is, and how many lines it has."""
    return spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")


def find(requests: DataFrame, folder: str) -> DataFrame:
    """file, offset, length of all captures in folder whose index line begins with a column `prefix` of requests and a blank: surt(url), or
    capture_key(url, id) for one page. Equal requests are one.

    Requests are sorted into ranges, so that a block is read by few tasks, once each. A task looks for a request in the directory, which has a bound and is
    with all tasks, reads the blocks that can hold it by their ranges, and looks for it in these.
    """
    spark = requests.sparkSession
    entries = directory(spark, folder).orderBy("first", "part", "offset").select("first", "file", "offset", "length").collect()  # BLOCKS and a block a partition at most
    shared = spark.sparkContext.broadcast([tuple(e) for e in entries])
    wanted = requests.select("prefix").distinct().repartitionByRange(_tasks(spark), "prefix").sortWithinPartitions("prefix")
    return wanted.mapInArrow(lambda batches: _look_up(batches, folder, shared.value), "file string, offset long, length long")


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records at places (file, offset, length).

    Stretches of files go to tasks, and neighbours in them are read at once. A response's payload must have the digest and length that its record names, else this
    raises. Of a revisit, both are what the record says of the payload that it stands for.
    """
    stretch = F.floor(F.col("offset") / STRETCH)
    ordered = places.repartition(_tasks(places.sparkSession), "file", stretch).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(lambda batches: _read(batches, folder), RECORDS)


def _tasks(spark: SparkSession) -> int:
    """As many as the session's shuffles have; not fewer because rows are small, for each is a read of its own."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def archive_and_read(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write pages into a new folder (in the shared one by default), then look up every page in the index and read its record; revisits
    take length and digest from the response that they refer to, nulls if it isn't there. Repeated rows are records of their own. Without pages nothing is read."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    scratch = Scratch(spark)
    write_archive(pages, folder, key, url, html, least)
    asked = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url")).mapInArrow(_keys, "prefix string")
    seen = scratch.table(read_records(find(asked, folder), folder))
    responses = scratch.table(seen.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("named"), F.col("payload_bytes").alias("size")).distinct())
    revisits = seen.where("record_type = 'revisit'").withColumnRenamed("payload_digest", "named").drop("payload_bytes")
    met = revisits.join(responses.withColumn("digest", F.col("named")), ["refers_to", "named"], "left")
    met = met.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    out = materialize(seen.where("record_type = 'response'").union(met).withColumnRenamed("page_id", key))
    scratch.clear()
    return out


def surt(url: str | None) -> str:
    """The sort key of a url: its host reversed, then the path; without scheme, user, usual port, www. and fragment. Printable ASCII, 512 characters at most: of a longer
    one the end is a digest. - for none."""
    text = (url or "").strip()
    if not text:
        return "-"
    scheme, there, rest = text.partition("://")
    rest = (rest if there else text).partition("#")[0]
    cut = min((at for at in (rest.find("/"), rest.find("?")) if at >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, colon, port = host.rpartition(":")
    if not colon or not port.isdigit():
        name, port = host, ""
    if port == {"http": "80", "https": "443"}.get(scheme.lower()):
        port = ""
    name = name.rstrip(".").removeprefix("www.")
    if not name.startswith("[") and not name.replace(".", "").isdigit():
        name = ",".join(reversed(name.split(".")))
    key = _printable(f"{name}{':' if port else ''}{port}){path if path.startswith('/') else '/' + path}")
    return key if len(key) <= URL_KEY else f"{key[: URL_KEY - 41]}~{hashlib.sha1(key.encode()).hexdigest()}"


def capture_key(url: str | None, page: int | None, date: str = DATE) -> str:
    """The part of an index line that names one page: its url's key, the time, and the page in a form that sorts as numbers do, null last."""
    stamp = "".join(c for c in date if c.isdigit())
    return f"{surt(url)} {stamp} {'~' if page is None else f'{page + (1 << 63):020d}'}"


def _printable(text: str) -> str:
    return quote(text.encode("utf-8", "replace"), safe="!\"#$%&'()*+,/:;<=>?@[\\]^_`{|}~-.")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One record: a response, or if first is given a revisit of that page's response, with the payload's length in its HTTP headers only."""
    name = f"urn:page:{'null' if page is None else page}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_printable((url or '').strip()) or name}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers and HTTP headers, names in lower case, and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"a record of {fields.get('warc-record-id')} is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _page(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, urls = (batch.column(k).to_pylist() for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for p, u in zip(pages, urls, strict=True)], pa.string())], ["prefix"])


def _file(store: FileSystem, base: str, kind: str, ending: str):
    """A new file that no other task writes: its name, and the stream."""
    name = f"{kind}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.{ending}"
    store.create_dir(base, recursive=True)
    return name, store.open_output_stream(f"{base}/{name}", compression=None)


def _write_records(batches: Iterable[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    store, base = FileSystem.from_uri(folder)
    name, out, at = None, None, 0
    try:
        for batch in batches:
            lines, offsets, lengths, files = [], [], [], []
            for i in range(batch.num_rows):
                page, url, payload, digest, first = (batch.column(k)[i].as_py() for k in range(5))
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    (name, out), at = _file(store, base, "pages", "warc.gz"), 0
                raw = gzip.compress(record(page, url, payload, base64.b32encode(digest).decode(), None if first is None or page == first else first, date), 6, mtime=0)
                out.write(raw)
                lines.append(capture_key(url, page, date)), files.append(name), offsets.append(at), lengths.append(len(raw))
                at += len(raw)
            yield pa.RecordBatch.from_pydict({"line": lines, "file": files, "offset": offsets, "length": lengths})
    finally:
        if out is not None:
            out.close()


def _write_blocks(batches: Iterable[pa.RecordBatch], folder: str, per_block: int) -> Iterator[pa.RecordBatch]:
    store, base = FileSystem.from_uri(folder)
    name, out, at, block = None, None, 0, []

    def flush() -> pa.RecordBatch:
        nonlocal name, out, at, block
        if out is None:
            name, out = _file(store, base, "index", "gz")
        raw = gzip.compress("\n".join(block).encode(), 6, mtime=0)
        out.write(raw)
        row = {"first": [block[0]], "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name], "offset": [at], "length": [len(raw)], "lines": [len(block)]}
        at, block = at + len(raw), []
        return pa.RecordBatch.from_pydict(row)

    try:
        for batch in batches:
            for line in batch.to_pylist():
                block.append(f"{line['line']} {line['file']} {line['offset']} {line['length']}")
                if len(block) == per_block:
                    yield flush()
        if block:
            yield flush()
    finally:
        if out is not None:
            out.close()


def _look_up(batches: Iterable[pa.RecordBatch], folder: str, entries: list[tuple[str, str, int, int]]) -> Iterator[pa.RecordBatch]:
    store, base = FileSystem.from_uri(folder)
    firsts = [first for first, *_ in entries]
    held: tuple[int, list[str]] = (-1, [])
    for batch in batches:
        for prefix in batch.column(0).to_pylist():
            low, high, found = f"{prefix} ", f"{prefix}!", []
            block = max(0, bisect_left(firsts, low) - 1)
            while block < len(entries) and firsts[block] < high:
                if held[0] != block:
                    _, name, offset, length = entries[block]
                    with store.open_input_file(f"{base}/{name}") as file:
                        held = block, gzip.decompress(file.read_at(length, offset)).decode().split("\n")
                lines = held[1]
                found += [line.rsplit(" ", 3)[1:] for line in lines[bisect_left(lines, low) : bisect_left(lines, high)]]
                if len(found) >= 10_000:
                    yield _places(found)
                    found = []
                block += 1
            if found:
                yield _places(found)


def _places(found: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": [f for f, _, _ in found], "offset": [int(o) for _, o, _ in found], "length": [int(n) for _, _, n in found]})


def _read(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, base = FileSystem.from_uri(folder)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        rows = []
        for name, spans in _spans(batch.to_pylist()):
            with store.open_input_file(f"{base}/{name}") as file:
                for start, end, records in spans:
                    raw = file.read_at(end - start, start)
                    rows += [_checked(gzip.decompress(raw[at - start : at - start + n])) for at, n in records]
        yield pa.RecordBatch.from_pylist(rows, schema)


def _spans(places: list[dict]) -> Iterator[tuple[str, list[tuple[int, int, list[tuple[int, int]]]]]]:
    """Sorted places as files with the stretches of them that are read at once, and the records in each."""
    name, spans = None, []
    for place in places:
        at, n = place["offset"], place["length"]
        if place["file"] != name:
            if name is not None:
                yield name, spans
            name, spans = place["file"], []
        if spans and at - spans[-1][1] <= GAP and at + n - spans[-1][0] <= SPAN:
            start, end, records = spans[-1]
            records.append((at, n))
            spans[-1] = (start, max(end, at + n), records)
        else:
            spans.append((at, at + n, [(at, n)]))
    if name is not None:
        yield name, spans


def _checked(raw: bytes) -> dict:
    fields, http, payload = parse(raw)
    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
    if kind == "response" and (len(payload), base32_sha1(payload)) != (size, digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} isn't what was written")
    refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
    return {"page_id": _page(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers}


#: The same in SQL; five hexadecimal digits are four of base 32.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
g AS (SELECT h, k, (('0x' || substr(h, (k // 4 * 5 + 1)::INTEGER, 5))::INTEGER >> (15 - 5 * (k % 4))::INTEGER) & 31 AS v FROM (SELECT DISTINCT h FROM p), range(32) AS t(k)),
d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' ORDER BY k) AS payload_digest FROM g GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (html) JOIN d USING (h)
"""
