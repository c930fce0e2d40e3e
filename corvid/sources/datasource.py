"""A Python data source over a folder of record files, one JSON object a line, with predicate pushdown.

It is the extension point for sources Spark has no reader for: a subclass lists its objects and reads their records.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, StringContains

from corvid.model import EngineError

#: What a source says of itself, as (searches itself with grep, lists since a time, how it tells deletes)
CAPABILITIES = {
    "file": (True, False, "full_scan"), "postgres": (True, False, "full_scan"), "mysql": (True, False, "full_scan"), "snowflake": (False, False, "full_scan"), "bigquery": (False, False, "full_scan"),
    "mongo": (False, False, "full_scan"), "slack": (False, False, "never"), "discord": (False, False, "never"), "feishu": (False, True, "never"), "gmail": (False, False, "never"),
    "github": (False, False, "full_scan"), "jira": (False, False, "full_scan"), "linear": (False, False, "full_scan"), "zendesk": (False, False, "full_scan"), "hubspot": (False, False, "full_scan"),
    "notion": (False, False, "full_scan"), "s3": (False, False, "full_scan"), "gdrive": (False, True, "full_scan"), "web": (False, False, "explicit"),
}


class RecordFiles(DataSource):
    """format("corvid_records"): option path is a folder; columns object (file name), row, record (JSON text)."""

    @classmethod
    def name(cls) -> str:
        return "corvid_records"

    def schema(self) -> str:
        return "object string, row long, record string"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RecordStream(self.options)


class RecordReader(DataSourceReader):
    def __init__(self, options):
        if "path" not in options:
            raise EngineError("missing_option", "corvid_records needs the option path")
        self.path, self.object, self.words = options["path"], None, []

    def pushFilters(self, filters: list[Filter]):
        """Takes over equality on the object's name and substrings of the record; hands back the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("object",) and self.object is None:
                self.object = f.value
            elif isinstance(f, StringContains) and f.attribute == ("record",):
                self.words.append(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(self.path)
        names = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(at)) if i.is_file and i.extension in ("jsonl", "ndjson"))
        return [InputPartition(n) for n in names if self.object in (None, n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(self.path)
        with files.open_input_stream(f"{at}/{partition.value}") as stream:
            rest, row = b"", 0
            while True:
                block = stream.read(1 << 20)
                parts = (rest + block).split(b"\n")
                rest = parts.pop() if block else b""
                for raw in parts:
                    if raw.strip():
                        text = compact(raw)
                        if all(w in text for w in self.words):
                            yield partition.value, row, text
                        row += 1
                if not block:
                    return


@dataclass
class Span(InputPartition):
    """The lines of a file that begin at bytes [begin, end)."""

    file: str
    begin: int
    end: int


class RecordStream(DataSourceStreamReader):
    """The folder as a change feed: files that come and lines that are appended, each line once it is whole. An offset is how far
    each file has been read. In a stream, row is the byte at which a record begins.

    Options: path; max_bytes, about how much a batch takes (all there is by default); span_bytes, about how much a task reads.
    """

    def __init__(self, options):
        if "path" not in options:
            raise EngineError("missing_option", "corvid_records needs the option path")
        self.path = options["path"]
        self.most, self.span = int(options.get("max_bytes", 0)), int(options.get("span_bytes", 64 << 20))
        self.told: dict[str, int] = {}

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """As far as whole lines go, but no more than max_bytes beyond what the last batch was told; the oldest names first."""
        from pyarrow import fs

        files, at = self._files()
        left, now = self.most or None, dict(self.told)
        for i in sorted((i for i in files.get_file_info(fs.FileSelector(at)) if i.is_file and i.extension in ("jsonl", "ndjson")), key=lambda i: i.base_name):
            begin = now.get(i.base_name, 0)
            if i.size <= begin or left is not None and left <= 0:
                continue
            end = self._line_end(files, f"{at}/{i.base_name}", begin, i.size if left is None else min(i.size, begin + left), i.size)
            if end > begin:
                now[i.base_name] = end
                left = None if left is None else left - (end - begin)
        self.told = now
        return now

    @staticmethod
    def _line_end(files, name: str, begin: int, near: int, size: int) -> int:
        """The last line's end up to `near`, else the first one after it, else begin."""
        with files.open_input_file(name) as f:
            stop = near
            while stop > begin:
                start = max(begin, stop - (1 << 16))
                found = f.read_at(stop - start, start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                stop = start
            while near < size:
                block = f.read_at(min(1 << 16, size - near), near)
                found = block.find(b"\n")
                if found >= 0:
                    return near + found + 1
                near += len(block)
        return begin

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.told = {k: max(v, self.told.get(k, 0)) for k, v in end.items()} | {k: v for k, v in self.told.items() if k not in end}  # after a restart
        out = []
        for name, to in sorted(end.items()):
            for begin in range(start.get(name, 0), to, self.span):
                out.append(Span(name, begin, min(to, begin + self.span)))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """A span's lines; one that begins before it belongs to the span before, one that ends after it is read to its end."""
        files, at = self._files()
        with files.open_input_file(f"{at}/{partition.file}") as f:
            place = partition.begin
            rest = b""
            if place and f.read_at(1, place - 1) != b"\n":
                while block := f.read_at(1 << 16, place):
                    found = block.find(b"\n")
                    place += found + 1 if found >= 0 else len(block)
                    if found >= 0:
                        break
            ahead = place
            while place < partition.end:
                block = f.read_at(1 << 20, ahead)
                ahead += len(block)
                parts = (rest + block).split(b"\n")
                rest = parts.pop()
                for raw in parts:
                    if place >= partition.end:
                        return
                    if raw.strip():
                        yield partition.file, place, compact(raw)
                    place += len(raw) + 1
                if not block:
                    return


def compact(line: bytes) -> str:
    """A record without blanks between its parts; a line that is no JSON stays as it is."""
    try:
        return json.dumps(json.loads(line), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return line.decode("utf-8", "replace")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordFiles)
