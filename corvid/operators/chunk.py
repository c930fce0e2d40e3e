"""Chunk producers: records, message threads, documents, code, schemas, folders."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvid import model
from corvid.functions import code
from corvid.functions import records as r
from corvid.functions import text as t
from corvid.operators import threads
from corvid.session import shared_folder

#: Where texts are cut, by level: marks, and how many of their characters stay before the cut.
LEVELS = ((("\n# ", "\n## ", "\n### "), 1), (("\n\n",), 2), ((". ", "! ", "? "), 2), (tuple(" \t\n\r\f\v"), 1))
#: Bytes of text that are cut before their pieces are handed on.
BLOCK_BYTES = 4 << 20


def capped(content: Column) -> tuple[Column, Column]:
    """(content cut to the cap, whether it was cut)"""
    return F.substring(content, 1, model.CONTENT_CAP), F.length(content) > model.CONTENT_CAP


def json_value(records: DataFrame, path: str) -> Column:
    """A path's value as JSON: numbers and truth values as they are, all else as text or lists of it."""
    value, many = r.resolve(records, path)
    if many:
        return F.to_json(F.transform(value, lambda x: x.cast("string")))
    plain = dict(records.select(value.alias("v")).dtypes)["v"].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")
    return F.coalesce(value.cast("string") if plain else t.json_text(value.cast("string")), F.lit("null"))


def record_chunks(records: DataFrame, object_uri: str | None, config: model.ObjectConfig, locator: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """(object_uri, locator, content, cut, metadata, chunk_index, partial) of every record with text.

    Locator and metadata are the configuration's fields as JSON. A text of more than a chunk's size becomes several chunks with
    their number in the locator. order: only needed where chunk_max may bind; the object's chunks are then marked as partial.
    Where none of the text fields exists in the records there is no chunk (and missing_fields tells why). object_uri: None where
    the records are of several objects, which _object_uri tells.
    """
    uri = F.lit(object_uri) if object_uri is not None else F.col("_object_uri")
    content = r.render_template(records, config.render_template) if config.render_template else r.render(records, config.text_fields)
    fields = {f: json_value(records, f) for f in config.locator_fields}
    own = locator if locator is not None else t.locator_json(**fields) if fields else t.locator_json(_row=F.col("_row"))
    part = t.locator_json(**fields, chunk_index=F.lit("@")) if fields else None
    metadata = t.locator_json(**{f: json_value(records, f) for f in config.metadata_fields}) if config.metadata_fields else F.lit("{}")
    out = records.select(uri.alias("object_uri"), own.alias("locator"), (part if part is not None else F.lit(None).cast("string")).alias("_part"), metadata.alias("metadata"), content.alias("content"), *(order or [])).where(F.trim("content") != "")
    partial = F.lit(False)
    if order and config.chunk_max < model.CHUNK_MAX:
        first = out.orderBy(*order).limit(config.chunk_max + 1)
        partial = F.lit(first.count() > config.chunk_max)
        out = out.orderBy(*order).limit(config.chunk_max)
    small = out.where(F.length("content") <= model.CHUNK_SIZE)
    text, cut = capped(F.col("content"))
    whole = small.select("object_uri", "locator", text.alias("content"), cut.alias("cut"), "metadata", F.lit(0).alias("chunk_index"))
    split = text_chunks(out.where(F.length("content") > model.CHUNK_SIZE).drop("partial"), keep=("object_uri", "_part", "metadata"))
    numbered = F.replace("_part", F.lit('"chunk_index":@'), F.concat(F.lit('"chunk_index":'), F.col("chunk_index").cast("string")))
    parts = split.select("object_uri", F.coalesce(numbered, F.concat(F.lit('{"chunk_index":'), F.col("chunk_index").cast("string"), F.lit("}"))).alias("locator"), "content", F.lit(False).alias("cut"), "metadata", "chunk_index")
    return whole.unionByName(parts).select("object_uri", "locator", "content", "cut", "metadata", "chunk_index", partial.alias("partial"))


def missing_fields(records: DataFrame, fields: list[str]) -> DataFrame:
    """(field, seen): whether any record has a value under each field's top key."""
    tops = [r.top_field(f) for f in fields]
    seen = [F.max(F.col(k).isNotNull()).alias(f"s{i}") if k in records.columns else F.lit(False).alias(f"s{i}") for i, k in enumerate(tops)]
    row = records.agg(*seen) if any(k in records.columns for k in tops) else records.agg(F.count("*")).select(*seen)
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f"s{i}", F.lit(False)).alias("seen")) for i, f in enumerate(fields)])).alias("x")).select("x.*")


def thread_key(messages: DataFrame, group_by: str | None = None) -> Column:
    """The thread of each message: the configured field, else the first known thread field with a value, else the message's own place."""
    names = [group_by] if group_by else [*model.THREAD_KEYS, *model.PLACE_KEYS]
    found = [F.col(n).cast("string") for n in names if n in messages.columns]
    if not found:
        raise model.EngineError("invalid_config", "no field tells the thread of a message")
    return F.coalesce(*found)


def thread_messages(messages: DataFrame, key: str, order: str, rendered: Column) -> DataFrame:
    """(key, messages): each thread's rendered messages in order."""
    both = messages.select(key, F.struct(F.col(order).alias("seq"), rendered.alias("text")).alias("m"))
    return both.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("m")).select(key, F.transform("m", lambda x: x["text"]).alias("messages"))


def thread_parts(whole: DataFrame, key: str, most: int = model.THREAD_CHARS, overlap: int = model.THREAD_OVERLAP) -> DataFrame:
    """(key, chunk_index, first, last, content): threads cut between messages into parts of at most `most` characters where a
    message allows, with `overlap` messages carried over. One fold over the array of message lengths."""
    state = "struct<start:int,size:int,done:array<struct<first:int,last:int>>>"
    joined = lambda a, n: F.aggregate(F.slice("sizes", a + 1, n), F.lit(0), lambda s, x: s + x)

    def step(acc: Column, item: Column) -> Column:
        i, size = item["i"], item["size"]
        full = (acc["size"] > 0) & (acc["size"] + size > most)
        carried = F.greatest(acc["start"], i - overlap)
        start = F.when(full, carried).otherwise(acc["start"])
        held = F.when(full, joined(carried, i - carried)).otherwise(acc["size"])
        done = F.when(full, F.concat(acc["done"], F.array(F.struct(acc["start"].alias("first"), (i - 1).alias("last"))))).otherwise(acc["done"])
        return F.struct(start.alias("start"), (held + size).alias("size"), done.alias("done"))

    sized = whole.where(F.size("messages") > 0).withColumn("sizes", F.transform("messages", lambda m: F.length(m) + 2))
    items = F.transform("sizes", lambda x, i: F.struct(i.alias("i"), x.alias("size")))
    begin = F.struct(F.lit(0).alias("start"), F.lit(0).alias("size"), F.array().cast("array<struct<first:int,last:int>>").alias("done")).cast(state)
    last = F.size("messages") - 1
    ranges = F.aggregate(items, begin, lambda a, x: step(a, x).cast(state), lambda a: F.concat(a["done"], F.array(F.struct(a["start"].alias("first"), last.alias("last")))))
    parts = sized.select(key, "messages", F.posexplode(ranges).alias("chunk_index", "range"))
    text = F.array_join(F.slice("messages", F.col("range.first") + 1, F.col("range.last") - F.col("range.first") + 1), "\n\n")
    return parts.select(key, "chunk_index", F.col("range.first").alias("first"), F.col("range.last").alias("last"), text.alias("content"))


def thread_chunks(messages: DataFrame, config: model.ObjectConfig) -> DataFrame:
    """(object_uri, locator, content, cut, metadata, chunk_index, partial): the threads of message streams (with _object_uri and
    _row), each in its order of arrival, cut between messages; a message that is too long for a chunk is cut as text.

    A message's thread is the value of the configured field, else of the first known thread field that has one, else its own
    time, id or place. The locator of a thread of one chunk is its thread; further chunks have their number and their messages.
    """
    name = config.group_by or "thread"
    fields = [c for c in ([config.group_by] if config.group_by else [*model.THREAD_KEYS]) + [*model.PLACE_KEYS] if c in messages.columns]
    said = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), json_value(messages, c))
    thread = F.coalesce(*map(said, fields), t.json_text(F.col("_row").cast("string")))
    rendered = r.render_template(messages, config.render_template) if config.render_template else r.render(messages, config.text_fields)
    told = messages.select("_object_uri", thread.alias("_thread"), "_row", rendered.alias("_text")).where(F.trim("_text") != "")
    keyed = told.withColumn("_key", F.struct("_object_uri", "_thread"))
    parts = threads.thread_parts(keyed, "_key", "_row", "_text").select("_key", F.col("chunk_index").alias("_part"), "first", "last", "content")
    cut = text_chunks(parts, keep=("_key", "_part", "first", "last")).drop("locator", "partial")
    own = Window.partitionBy("_key")
    numbered = cut.withColumns({"n": F.count("*").over(own), "at": F.row_number().over(own.orderBy("_part", "chunk_index")) - 1})
    key = t.json_text(F.lit(name))
    whole = F.concat(F.lit("{"), key, F.lit(":"), F.col("_key._thread"), F.lit("}"))
    entries = F.array_sort(F.array(F.concat(F.lit('"chunk_index":'), F.col("at").cast("string")), F.concat(F.lit('"msg_range":['), F.col("first").cast("string"), F.lit(","), F.col("last").cast("string"), F.lit("]")), F.concat(key, F.lit(":"), F.col("_key._thread"))))
    locator = F.when(F.col("n") == 1, whole).otherwise(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")))
    text, long = capped(F.col("content"))
    return numbered.select(F.col("_key._object_uri").alias("object_uri"), locator.alias("locator"), text.alias("content"), long.alias("cut"), F.lit("{}").alias("metadata"), F.col("at").alias("chunk_index"), F.lit(False).alias("partial"))


def split_text(text: str, size: int) -> list[tuple[int, int]]:
    """(begin, end) of pieces of at most size characters that make up the text, cut at the highest level that serves.

    Greedy: the cut is the last place within size characters before a heading, else after a blank line, else after a sentence,
    else after white space; without any, a hard cut.
    """
    at, out = 0, []
    while len(text) - at > size:
        for marks, ahead in LEVELS:
            # ahead: how much of the mark stands before the cut
            cut = max((i + ahead for m in marks if (i := text.rfind(m, at, at + size - ahead + len(m))) >= 0), default=at)
            if cut > at:
                break
        else:
            cut = at + size
        out.append((at, cut))
        at = cut
    return [*out, (at, len(text))] if at < len(text) else out


def split_code(text: str, size: int, ext: str = ".py") -> list[tuple[int, int]]:
    """Pieces of whole definitions, as many as fit; what is longer than a piece is cut at the definitions in it, else as text."""
    out: list[tuple[int, int]] = []
    for a, b in code.units(text, ext, size):
        if out and b - out[-1][0] <= size:
            out[-1] = (out[-1][0], b)
        else:
            out += [(a + x, a + y) for x, y in split_text(text[a:b], size)]
    return out


def code_outline(objects: DataFrame, text_col: str = "content") -> DataFrame:
    """(object_uri, kind, name, depth, first, last) of every definition in code objects, at every level; first and last are its lines
    from 1. The extension of the uri tells the language."""
    schema = "object_uri string, kind string, name string, depth int, first int, last int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = code.walk(code.definitions(text or "", extension(uri)))
                if found:
                    columns = zip(*((uri, d.kind, d.name, d.depth, d.begin + 1, d.end) for d in found), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["object_uri", "kind", "name", "depth", "first", "last"])

    return objects.select("object_uri", text_col).mapInArrow(run, schema)


def extension(uri: str | None) -> str:
    name = (uri or "").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""


def text_chunks(objects: DataFrame, size: int = model.CHUNK_SIZE, is_code: bool = False, text_col: str = "content", keep: tuple[str, ...] = ("object_uri",), most: int = model.CHUNK_MAX) -> DataFrame:
    """(*keep, chunk_index, locator, content, partial): body chunks with the lines [start, end) they span; blank pieces are dropped.

    Pieces of one text that span the same lines have their number in the locator too, so that locators tell chunks apart. Of a
    text with more than `most` pieces the first are kept, and they are marked as partial.
    """
    told = "object_uri" in keep
    schema = T.StructType([*(objects.schema[c] for c in keep), T.StructField("chunk_index", T.IntegerType()), T.StructField("locator", T.StringType()), T.StructField("content", T.StringType()), T.StructField("partial", T.BooleanType())])

    def pieces(text: str, uri: str | None) -> list[tuple[int, str, str, bool]]:
        line, seen, found = 1, 0, []
        for a, b in split_code(text, size, extension(uri)) if is_code else split_text(text, size):
            line += text.count("\n", seen, a)
            seen = a
            if text[a:b].strip(" \t\n\r\f\v"):
                found.append((line, line + text.count("\n", a, b) + (text[b - 1] != "\n"), text[a:b]))
        times = Counter((x, y) for x, y, _ in found)
        number = lambda n, x, y: f'"chunk_index":{n},' if times[x, y] > 1 else ""
        return [(n, f'{{{number(n, x, y)}"lines":[{x},{y}]}}', piece, len(found) > most) for n, (x, y, piece) in enumerate(found[:most])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begin = batch.column(len(keep)), 0
            held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // BLOCK_BYTES
            for end in [*(np.flatnonzero(np.diff(held)) + 1).tolist(), batch.num_rows]:
                uris = batch.column(keep.index("object_uri")).slice(begin, end - begin).to_pylist() if is_code and told else [None] * (end - begin)
                made = [pieces(t or "", u) for t, u in zip(texts.slice(begin, end - begin).to_pylist(), uris, strict=True)]
                which = pa.array(np.repeat(np.arange(begin, end), [len(m) for m in made]))
                columns = list(zip(*(x for m in made for x in m), strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(which) for i in range(len(keep))), *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.bool_()), strict=True))], names=schema.names)
                begin = end

    return objects.select(*keep, F.col(text_col).alias("_text_to_cut")).mapInArrow(run, schema)


def located_chunks(objects: DataFrame, keep: tuple[str, ...] = (), size: int = model.CHUNK_SIZE, code_objects: bool = False, most: int = model.CHUNK_MAX) -> DataFrame:
    """Body chunks of objects (connector_uri, object_uri, content, *keep) in the chunk table's columns."""
    made = text_chunks(objects, size, code_objects, keep=("connector_uri", "object_uri", *keep), most=most).withColumn("chunk_kind", F.lit("body"))
    text, cut = capped(F.col("content"))
    made = made.withColumns({"chunk_id": t.chunk_id(F.col("connector_uri"), F.col("object_uri"), F.col("chunk_kind"), F.col("locator")), "partial": F.col("partial") | cut}).withColumn("content", text)
    return made.select("chunk_id", "connector_uri", "object_uri", "locator", "content", "chunk_kind", F.lit("{}").alias("metadata"), "chunk_index", "partial", *keep)


def schema_summary(df: DataFrame, object_uri: str) -> DataFrame:
    """One chunk that describes a table's columns."""
    text = "columns: " + "; ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.sparkSession.createDataFrame([(object_uri, "schema_summary", text)], "object_uri string, chunk_kind string, content string")


def folder_summaries(objects: DataFrame, root: str, excerpt: int = model.CHILD_EXCERPT, most: int = model.FOLDER_TEXT, salts: int = 64) -> DataFrame:
    """(folder, n_children, content): bottom-up, each folder from excerpts of its files and of its sub-folders' summaries.

    One aggregation for each level, the deepest first; a level is checkpointed, so that the plan of the next one doesn't grow. A
    summary is the children in order of their names, cut at `most` characters. Children that can't be in it are told in salted
    groups before they move: there what earlier ones of the same group take is enough already.
    """
    shared_folder(objects.sparkSession)
    base = root.rstrip("/")
    depth = F.size(F.split("path", "/"))
    nodes = objects.where(F.col("object_uri").startswith(base + "/")).select(F.col("object_uri").alias("path"), F.substring("content", 1, excerpt).alias("text")).withColumn("depth", depth)
    bottom = nodes.agg(F.max("depth").alias("d")).first()["d"] or 0
    top, done, current = len(base.split("/")), None, nodes.limit(0)
    for level in range(bottom, top, -1):
        here = nodes.where(F.col("depth") == level).unionByName(current)
        line = F.concat(t.basename(F.col("path")), F.lit(": "), F.col("text"))
        named = here.select(t.parent(F.col("path")).alias("folder"), t.basename(F.col("path")).alias("name"), line.alias("line"))
        group = Window.partitionBy("folder", F.pmod(F.xxhash64("name"), F.lit(salts))).orderBy("name")
        taken = F.coalesce(F.sum(F.length("line") + 1).over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        shown = named.withColumn("_taken", taken).where(F.col("_taken") < most)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "line"))), lambda x: x["line"]), "\n")
        folded = named.groupBy("folder").agg(F.count("*").alias("n_children")).join(shown.groupBy("folder").agg(F.substring(text, 1, most).alias("content")), "folder").checkpoint()
        done = folded if done is None else done.unionByName(folded)
        current = folded.select(F.col("folder").alias("path"), F.substring("content", 1, excerpt).alias("text"), F.lit(level - 1).alias("depth"))
    return done if done is not None else objects.sparkSession.createDataFrame([], "folder string, n_children long, content string")


def produced(objects: DataFrame, producers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The union of what each producer makes of the objects that are routed to it."""
    routed = objects.withColumn("producer", t.producer_of(F.col("okind")))
    made = [make(routed.where(F.col("producer") == name)) for name, make in producers.items()]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out
