"""JSON files of any size: the elements of a list one after the other, with no more of the file in memory than the longest of them."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import CLAIM

PIECE = 1 << 20
#: Characters of the longest escape, which may be cut in two.
ESCAPE = 12
_BLANK = " \t\r\n"
_DECODER = json.JSONDecoder()


class _Text:
    """A stream of UTF-8 as text of which the front is looked at and taken away."""

    def __init__(self, stream, piece: int) -> None:
        self.stream, self.piece, self.decoder, self.text, self.at, self.ended = stream, piece, codecs.getincrementaldecoder("utf-8-sig")(), "", 0, False

    def more(self) -> bool:
        raw = b"" if self.ended else self.stream.read(self.piece)
        self.ended = self.ended or not raw
        self.text, self.at = self.text[self.at :] + self.decoder.decode(raw, self.ended), 0
        return not self.ended

    def peek(self) -> str:
        """The next character that isn't blank; an empty text at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in _BLANK:
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise ValueError(f"{wanted} is missing")
        self.at += 1

    def value(self) -> object:
        """The next value. One that ends where the text does may go on, and is looked at again with more of it; what has to be read then doubles, so the
        work stays in proportion."""
        self.peek()
        while True:
            try:
                _, end = _DECODER.raw_decode(self.text, self.at)
            except json.JSONDecodeError as error:
                if error.pos < len(self.text) - ESCAPE and not error.msg.startswith("Unterminated string"):
                    raise  # not for want of more
                end = len(self.text)
            if end < len(self.text) or self.ended:
                break
            held = len(self.text) - self.at
            while len(self.text) - self.at < 2 * held + 1 and self.more():
                pass
        value, self.at = _DECODER.raw_decode(self.text, self.at)
        return value


def elements(stream, within: str = "claims", piece: int = PIECE) -> Iterator[dict]:
    """The elements of a stream (bytes) that holds a list, an object with a list named `within`, or one object, which is then the only element. Of such an object
    the other values are passed over; if a name comes twice, the first list counts. Anything else raises ValueError, where it is met."""
    text = _Text(stream, piece)
    first = text.peek()
    if first == "[":
        yield from _list(text)
    elif first == "{":
        text.take("{")
        rest: dict = {}
        found = False
        while text.peek() != "}":
            name = text.value()
            if not isinstance(name, str):
                raise ValueError("a name is missing")
            text.take(":")
            if name == within and text.peek() == "[" and not found:
                found = True
                yield from _list(text)
            else:
                value = text.value()
                rest |= {} if found else {name: value}
            if text.peek() == ",":
                text.take(",")
                if text.peek() == "}":
                    raise ValueError("a name is missing")
            elif text.peek() != "}":
                raise ValueError("} is missing")
        text.take("}")
        if not found:
            yield rest
    else:
        raise ValueError("neither a list nor an object")
    if text.peek():
        raise ValueError("there is more after the end")


def _list(text: _Text) -> Iterator[object]:
    text.take("[")
    while text.peek() != "]":
        yield text.value()
        if text.peek() == ",":
            text.take(",")
            if text.peek() == "]":
                raise ValueError("an element is missing")
        elif text.peek() != "]":
            raise ValueError("] is missing")
    text.take("]")


class JsonElements(DataSource):
    """format("lodestrata_json_elements") with files (a JSON list of places that pyarrow can open, shared by all executors): file, pos, json of each element, and
    one row with a null json of a file that can't be read to its end. A file is a partition, and is read twice: first to its end, then for its rows."""

    @classmethod
    def name(cls) -> str:
        return "lodestrata_json_elements"

    def schema(self) -> str:
        return "file string, pos long, json string"

    def reader(self, schema) -> DataSourceReader:
        return _JsonReader(json.loads(self.options["files"]))


class _JsonReader(DataSourceReader):
    def __init__(self, files: list[str]) -> None:
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow.fs import FileSystem

        if partition.value is None:
            return
        store, place = FileSystem.from_uri(partition.value)
        try:
            with store.open_input_stream(place) as stream:
                for _ in elements(stream):
                    pass
        except (ValueError, OSError, RecursionError):
            yield partition.value, None, None
            return
        with store.open_input_stream(place) as stream:
            for pos, element in enumerate(elements(stream)):
                yield partition.value, pos, json.dumps(element, ensure_ascii=False)


def read_large_claims(spark: SparkSession, path: str, names: str = "claims-*.json") -> tuple[DataFrame, DataFrame]:
    """As files.read_claims, for a folder with files of any size: claims with ord, a struct of file and place, and the files that can't be read. Elements that
    aren't objects are claims without a text, and so are left out."""
    spark.dataSource.register(JsonElements)
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{names}")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    files = sorted(f.getPath().toString().replace("file:/", "file:///", 1).replace("file://///", "file:///") for f in found)
    rows = spark.read.format("lodestrata_json_elements").option("files", json.dumps(files)).load()
    claims = rows.where("json IS NOT NULL").select(F.struct("file", "pos").alias("ord"), F.from_json("json", CLAIM).alias("x")).select("ord", "x.*")
    return claims.where("length(trim(coalesce(claim, ''))) > 0"), rows.where("pos IS NULL").select("file")
