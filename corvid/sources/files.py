"""A file tree as a table, and its ignore rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid import model
from corvid.functions import text as t

#: Names of the files that list what to ignore.
IGNORE_FILES = (".gitignore", ".ignore")


def scan(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(root, path, size, modified, content): every file below root but hidden ones; columns that nothing reads aren't loaded."""
    top = root.rstrip("/") if "://" in root else f"file://{root.rstrip('/')}"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(top)
    whole = F.regexp_replace("path", "^file:/+", "file:///")
    return files.select(F.lit(top).alias("root"), F.substring(whole, len(top) + 2, 100_000).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def ignore_rules(files: DataFrame, names: tuple[str, ...] = IGNORE_FILES, extra: list[str] = model.DEFAULT_IGNORE) -> list[tuple[bool, str]]:
    """The rules of the defaults and of all ignore files in the tree, outer folders first.

    Ignore files are hidden, so each folder is looked into by name, on the executors. They are few and small.
    """
    folders = files.select("root", F.explode(F.concat(F.array(F.lit("")), t.ancestors(F.col("path")))).alias("folder")).distinct()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            found = []
            for root, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, at = fs.FileSystem.from_uri(root)
                for name in names:
                    place = "/".join(x for x in (at, folder, name) if x)
                    if system.get_file_info(place).is_file:
                        with system.open_input_stream(place) as stream:
                            found.append((folder, name, stream.read().decode("utf-8", "ignore")))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["folder", "name", "text"])

    found = folders.mapInArrow(look, "folder string, name string, text string").collect()
    rules = [t.ignore_rule("", line) for line in extra]
    for row in sorted(found, key=lambda r: (r.folder.count("/") + bool(r.folder), r.folder, r.name)):
        rules += [t.ignore_rule(row.folder, line) for line in row.text.splitlines()]
    return [r for r in rules if r]


def objects(files: DataFrame) -> DataFrame:
    """The files that no rule drops, with their kind, media type, priority and content hash."""
    kept = files.where(~t.ignored(F.col("path"), ignore_rules(files)))
    path = F.col("path")
    return kept.select("path", "size", "modified", t.object_kind(path).alias("okind"), t.media_type(path).alias("media_type"), t.task_priority(path).alias("priority"), F.sha1("content").alias("sha1"), F.col("content"))
