"""What a source is, and which one a scheme names."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid import model
from corvid.functions import text as t
from corvid.operators import order
from corvid.operators.keys import primary_key as keys_of
from corvid.operators.pages import RangePages
from corvid.sources import files, flatten
from corvid.sources.datasource import CAPABILITIES, register


class Source(Protocol):
    """A source lists its objects and reads them; the catalog does the rest."""

    scheme: str

    def listing(self, spark: SparkSession) -> DataFrame:
        """(object_uri, okind, content) of all objects; content is null where an object is read as records."""

    def records(self, spark: SparkSession, object_uri: str) -> tuple[DataFrame, bool]:
        """The records of a structured object, and whether a limit cut them."""

    # A source whose objects are many also has facts(spark) and groups(spark, uris), as below, which take all of them at once.


@dataclass(frozen=True)
class RecordGroup:
    """Records (with _object_uri and _row, their place in it) of objects of one kind. preset: the name of what is known of the
    kind; cut: whether a limit cut them."""

    rows: DataFrame
    preset: str | None = None
    keys: tuple[str, ...] = ()
    cut: bool = False


def facts_of(source: Source, spark: SparkSession, uris: list[str] | None) -> DataFrame:
    """(object_uri, facts) of structured objects: how many records each has and their hash, which tells whether they changed."""
    if hasattr(source, "facts"):
        return source.facts(spark)
    told = [(u, source.records(spark, u)[0].agg(F.concat_ws("|", F.count("*"), F.sum(F.xxhash64(F.struct("*")).cast("decimal(38,0)"))).alias("f")).first().f) for u in uris or []]
    return spark.createDataFrame(told, "object_uri string, facts string")


def groups_of(source: Source, spark: SparkSession, uris: DataFrame) -> list[RecordGroup]:
    """The records of some objects (object_uri), by kind. Tables are a kind each; they are few."""
    if hasattr(source, "groups"):
        return source.groups(spark, uris)
    found = []
    for r in uris.collect():
        rows, cut = source.records(spark, r["object_uri"])
        keys = keys_of(rows)
        numbered = rows.withColumn("_row", F.lit(None).cast("long")) if keys else order.positions(rows, rows.columns)
        found.append(RecordGroup(numbered.withColumn("_object_uri", F.lit(r["object_uri"])), None, tuple(keys), cut))
    return found


def capped_scan(rows: DataFrame, by: list[str], most: int) -> tuple[DataFrame, bool]:
    """The first `most` rows in a total order, and whether there are more."""
    if rows.limit(most + 1).count() <= most:
        return rows, False
    return rows.orderBy(*by).limit(most), True


@dataclass
class FileTree:
    """A folder of any file system that Spark reads, without what ignore files name."""

    root: str
    scheme: str = "file"

    def listing(self, spark: SparkSession) -> DataFrame:
        found = files.objects(files.scan(spark, self.root))
        text = F.when(F.col("okind").isin("document", "code", "text_blob"), F.col("content").cast("string"))
        return found.select(F.concat(F.lit(f"{self.scheme}://local{self.root.rstrip('/')}/"), "path").alias("object_uri"), "okind", text.alias("content"))

    def records(self, spark: SparkSession, object_uri: str) -> tuple[DataFrame, bool]:
        raise model.EngineError("not_found", f"{object_uri} has no records")


@dataclass
class Tables:
    """Tables by name, each an object of rows and one of its schema; a scan stops at max_read_rows and says so."""

    root: str
    tables: dict[str, Callable[[SparkSession], DataFrame]]
    keys: dict[str, list[str]] = field(default_factory=dict)
    max_read_rows: int = 100_000
    scheme: str = "postgres"
    _pages: dict[str, RangePages] = field(default_factory=dict, repr=False)

    def listing(self, spark: SparkSession) -> DataFrame:
        rows = []
        for name, load in sorted(self.tables.items()):
            text = "; ".join(f"{f.name} {f.dataType.simpleString()}" for f in load(spark).schema)
            rows += [(f"{self.root}/{name}/schema.json", "table_schema", text), (f"{self.root}/{name}/rows.jsonl", "table_rows", None)]
        return spark.createDataFrame(rows, "object_uri string, okind string, content string")

    def records(self, spark: SparkSession, object_uri: str) -> tuple[DataFrame, bool]:
        name = object_uri.removeprefix(self.root + "/").removesuffix("/rows.jsonl")
        if name not in self.tables:
            raise model.EngineError("not_found", object_uri)
        rows = self.tables[name](spark)
        return capped_scan(rows, self.keys.get(name) or rows.columns, self.max_read_rows)

    def page(self, spark: SparkSession, object_uri: str, begin: int, end: int) -> DataFrame:
        """The rows [begin, end) of those that a scan reads; only the ranges of the key that they are in are read."""
        name = object_uri.removeprefix(self.root + "/").removesuffix("/rows.jsonl")
        if name not in self.tables:
            raise model.EngineError("not_found", object_uri)
        if name not in self._pages:
            rows = self.tables[name](spark)
            self._pages[name] = RangePages(rows, self.keys.get(name) or keys_of(rows) or rows.columns)
        return self._pages[name].page(begin, min(end, self.max_read_rows))


@dataclass
class RecordFolder:
    """A folder of files with one JSON record a line, read with predicate pushdown. A file's name tells the kind of its records
    (messages.jsonl, issues.jsonl); other names count as the scheme's main kind. Kinds with threads are message streams."""

    root: str
    path: str
    scheme: str = "slack"

    def _load(self, spark: SparkSession) -> DataFrame:
        register(spark)
        return spark.read.format("corvid_records").option("path", self.path).load()

    def kinds(self) -> dict[str, str]:
        """Preset by kind; the first is the main one."""
        return {k.split(".", 1)[1]: k for k in model.PRESETS if k.startswith(f"{self.scheme}.")}

    def _preset(self, name: Column) -> Column:
        known = self.kinds()
        stem = F.regexp_extract(name, r"([^/.]+)\.[^/]*$", 1)
        out = F.lit(next(iter(known.values()), None))
        for kind, preset in known.items():
            out = F.when(stem == kind, preset).otherwise(out)
        return out.cast("string")

    def listing(self, spark: SparkSession) -> DataFrame:
        streams = [k for k, c in model.PRESETS.items() if c.group_by]
        okind = F.when(self._preset(F.col("object")).isin(streams), "message_stream").otherwise("record_collection")
        return self._load(spark).select(F.concat(F.lit(self.root + "/"), "object").alias("object_uri"), okind.alias("okind"), F.lit(None).cast("string").alias("content")).distinct()

    def facts(self, spark: SparkSession) -> DataFrame:
        hashed = F.sum(F.xxhash64("row", "record").cast("decimal(38,0)"))
        return self._load(spark).groupBy(F.concat(F.lit(self.root + "/"), "object").alias("object_uri")).agg(F.concat_ws("|", F.count("*"), hashed).alias("facts"))

    def _parsed(self, rows: DataFrame) -> DataFrame:
        """The records' fields as columns; their types are what all of these records have in common. What is no JSON object is left out."""
        value = rows.withColumn("_value", F.try_parse_json("record")).where("_value is not null")
        shape = value.agg(F.schema_of_variant_agg("_value").alias("s")).first()["s"] or ""
        if not shape.startswith("OBJECT<"):
            return rows.select("_object_uri", "_row").limit(0)
        ddl = re.sub(r"\bOBJECT<", "STRUCT<", re.sub(r": (?:VOID|VARIANT)\b", ": STRING", re.sub(r"<(?:VOID|VARIANT)>", "<STRING>", shape)))
        opened = value.select("_object_uri", "_row", F.from_json("record", ddl).alias("_r"))
        own = [f for f in opened.schema["_r"].dataType.fieldNames() if f not in flatten.PLACE]
        return opened.select("_object_uri", "_row", *(F.col("_r")[f].alias(f) for f in own))

    def groups(self, spark: SparkSession, uris: DataFrame) -> list[RecordGroup]:
        rows = self._load(spark).withColumn("_preset", self._preset(F.col("object"))).select(F.concat(F.lit(self.root + "/"), "object").alias("_object_uri"), F.col("row").alias("_row"), "record", "_preset")
        rows = rows.join(uris.select(F.col("object_uri").alias("_object_uri")), "_object_uri", "left_semi")
        found = []
        for preset in self.kinds().values() or [None]:
            own = rows.where(F.col("_preset") == preset) if preset else rows
            found.append(RecordGroup(flatten.flattened(preset, self._parsed(own.drop("_preset"))), preset))
        return [g for g in found if len(g.rows.columns) > len(flatten.PLACE)]

    def records(self, spark: SparkSession, object_uri: str) -> tuple[DataFrame, bool]:
        """The records as they were written, parsed, with their place _row."""
        one = self._load(spark).where(F.col("object") == object_uri.removeprefix(self.root + "/"))
        return self._parsed(one.select(F.lit(object_uri).alias("_object_uri"), F.col("row").alias("_row"), "record")).drop("_object_uri"), False


@dataclass
class Pages:
    """Crawled pages (url, html), as text."""

    pages: Callable[[SparkSession], DataFrame]
    root: str = "web://crawl"
    scheme: str = "web"

    def listing(self, spark: SparkSession) -> DataFrame:
        return self.pages(spark).select(F.concat(F.lit(self.root), t.url_path(F.col("url"))).alias("object_uri"), F.lit("document").alias("okind"), t.html_to_text(F.col("html")).alias("content"))

    def records(self, spark: SparkSession, object_uri: str) -> tuple[DataFrame, bool]:
        raise model.EngineError("not_found", f"{object_uri} has no records")


_SOURCES: dict[str, type] = {s: Tables for s in ("postgres", "mysql", "snowflake", "bigquery", "mongo")} | {s: RecordFolder for s in ("slack", "discord", "feishu", "gmail", "github", "jira", "linear", "zendesk", "hubspot", "notion")} | {s: FileTree for s in ("file", "s3", "gdrive")} | {"web": Pages}


def register_source(scheme: str, source: type) -> None:
    _SOURCES[scheme] = source


def source_of(scheme: str) -> type:
    """The class of a scheme's sources."""
    if scheme not in _SOURCES:
        raise model.EngineError("unknown_scheme", scheme, tuple(sorted(_SOURCES)))
    return _SOURCES[scheme]


def schemes() -> list[str]:
    return sorted(_SOURCES)


def detection_of(scheme: str) -> str:
    """How a source tells deletes; an unknown one is taken to list everything."""
    return CAPABILITIES.get(scheme, (False, False, "full_scan"))[2]
