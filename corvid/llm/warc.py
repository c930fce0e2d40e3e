"""Deterministic sharded WARC writer and reader.

Records are range-sorted by their id and, within one id, by a hash of their payload. The cuts between shards are quantiles of
payload bytes, taken from a sample that a hash of these keys chooses, so the same input gives the same shards in every run,
however it is partitioned and however its ids are spread: outliers, clusters and many null ids make no large shard. Each shard
is one group of one task, which writes gzip members (a warcinfo record, then one record for each row), rolls the file when its
compressed size is reached, and regenerates headers and digests. A file is written in a temporary folder and renamed when
complete; a retried or speculative task writes the same bytes to the same final name, and what failed tasks leave is deleted.
The list of files is itself a written table, the manifest; only what it names is read back, and the writer raises if it doesn't
count every row.

Of records with equal payloads the one with the largest id is the response; the others are revisits that refer to it.

Edge cases: a null payload is an empty one; empty payloads equal each other. Repeated rows (same id and payload) stand in one
shard; the first is the response, the others revisit it. A null id counts as the smallest and is written without an id header.
A very long payload is one record, held in memory on its own. An empty table gives no file. Other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import hashed_share, shared_dir, written

#: Shards that there are at least (where rows are as many), and keys sampled for each shard to find the cuts.
LEAST_SHARDS, SAMPLED_PER_SHARD = 64, 64
#: Rows that the writer unpacks at once.
SLICE = 256
#: The folder of files that aren't complete.
TEMPORARY = "_temporary"
MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("sha1", T.StringType())])
READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])


def file_system(uri: str):
    """The Arrow file system of a uri and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    """The id of a record, which revisits can tell without seeing the response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {copy} {digest}')}>"


def warcinfo(file: str, date: str) -> bytes:
    """The record at the beginning of each file."""
    block = b"software: corvid\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, file)}>", f"WARC-Date: {date}", f"WARC-Filename: {file}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, copy: int, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of the response with id first."""
    url = "".join(c for c in url or "" if c not in "\r\n")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, copy)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, digest, 0)}", f"WARC-Refers-To-Date: {date}", *([f"X-Refers-To-Page: {first}"] if first is not None else [])]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time or name, so that equal records give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Roller:
    """Writes the members of one shard, in the temporary folder until a file is complete."""

    def __init__(self, folder: str, shard: int, most: int, date: str):
        self.files, self.at = file_system(folder)
        self.shard, self.most, self.date = shard, most, date
        self.parts: list[tuple] = []
        self.out = self.temporary = self.name = None
        self.size, self.records, self.sha1 = 0, 0, hashlib.sha1()

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{len(self.parts):05d}.warc.gz"
            self.temporary = f"{self.at}/{TEMPORARY}/{uuid.uuid4().hex}"
            self.out = self.files.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.sha1 = 0, 0, hashlib.sha1()
            self._write(member(warcinfo(self.name, self.date)))
        self._write(data)
        self.records += 1
        if self.size >= self.most:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha1.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.move(self.temporary, f"{self.at}/{self.name}")
            self.parts.append((self.shard, self.name, self.records, self.size, self.sha1.hexdigest()))
            self.out = None


def shard_cuts(keyed: DataFrame, rows: int, held: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """The first (page_id, tie) of every shard but the first, in order: quantiles of bytes over a hash-chosen sample of the keys.

    keyed: (page_id, tie, bytes) rows, together held bytes. The sample has about SAMPLED_PER_SHARD keys a shard; a key counts
    once however many rows share it, so its size is bounded.
    """
    target = max(1, min(target, held // LEAST_SHARDS))
    shards = -(-held // target)
    chosen = keyed.where(hashed_share(F.struct("page_id", "tie"), rows, SAMPLED_PER_SHARD * shards)).groupBy("page_id", "tie").agg(F.sum("bytes").alias("bytes"))
    sample = chosen.orderBy("page_id", "tie").toArrow()
    page, tie = (sample.column(c).to_numpy() for c in ("page_id", "tie"))
    before = np.cumsum(sample.column("bytes").to_numpy()) - sample.column("bytes").to_numpy()
    number = before * shards // max(1, int(sample.column("bytes").to_numpy().sum()))
    first = np.flatnonzero(np.diff(number)) + 1
    return page[first].astype(np.int64), tie[first].astype(np.int64)


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = 256 << 20, file_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one record for each row; returns the manifest, which is written to folder/_manifest."""
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("tie", F.xxhash64("payload"))
    size = F.length("payload") + 512
    whole = pages.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("held")).first()
    # a null id sorts like the smallest there can be
    ordering = F.coalesce("page_id", F.lit(-(2**63))).alias("page_id")
    cut_pages, cut_ties = shard_cuts(pages.select(ordering, "tie", size.alias("bytes")), whole["rows"], whole["held"], shard_bytes)

    @F.pandas_udf("int")
    def shard_of(page: pd.Series, tie: pd.Series) -> pd.Series:
        low, high = np.searchsorted(cut_pages, page.to_numpy(), "left"), np.searchsorted(cut_pages, page.to_numpy(), "right")
        shard = low.astype(np.int32)
        for k in np.flatnonzero(low < high):  # ids at which a cut lies: the hash decides
            shard[k] = low[k] + np.searchsorted(cut_ties[low[k] : high[k]], tie.iloc[k], "right")
        return pd.Series(shard)

    hashed = pages.withColumn("sha1", F.sha1("payload"))
    first = hashed.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # which payload repeats is told by a light row just before the page's own, so that payloads are shuffled once only
    notes = hashed.select("page_id", "tie", "sha1").distinct().join(first, "sha1").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "tie", "sha1", "first", F.lit(0).alias("kind"))
    both = notes.unionByName(hashed.withColumns({"first": F.lit(None).cast("long"), "kind": F.lit(1)}))
    placed = both.withColumn("shard", shard_of(ordering, F.col("tie")))
    columns = ["shard", "page_id", "url", "payload", "sha1", "first", "kind"]
    files, at = file_system(folder)
    files.create_dir(f"{at}/{TEMPORARY}", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, copy, noted = None, None, 0, (None, None, None)

        def parts() -> pa.RecordBatch:
            roller.close()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*roller.parts, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=MANIFEST.names)

        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            for shard, page, url, payload, sha1, first_id, kind in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if roller is None or shard != roller.shard:
                    if roller is not None:
                        yield parts()
                    roller, last = Roller(folder, shard, file_bytes, date), None
                if kind == 0:
                    noted = (page, sha1, first_id)
                    continue
                # rows with one id and one payload follow each other: the first of them is the response
                copy = copy + 1 if (page, sha1) == last else 0
                last = (page, sha1)
                best = noted[2] if noted[:2] == (page, sha1) else page
                revisit = page != best or copy > 0
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                roller.add(member(record(page, url, payload, digest, best, revisit, copy, date)))
        if roller is not None:
            yield parts()

    # a task for every two shards where these are more than the session's shuffle partitions
    tasks = len(cut_pages) // 2
    dealt = placed.repartition(tasks, "shard") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else placed.repartition("shard")
    ordered = dealt.sortWithinPartitions("shard", "page_id", "tie", "sha1", "kind", "url").select(*columns)
    manifest = written(ordered.mapInArrow(run, MANIFEST), f"{folder}/_manifest")
    listed = manifest.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"]
    if listed != whole["rows"]:
        raise ValueError(f"{whole['rows']} rows came in, the manifest lists {listed} records")
    files.delete_dir(f"{at}/{TEMPORARY}")
    return manifest


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a compressed archive."""
    unpacker, held, done = zlib.decompressobj(31), b"", False
    while not done:
        raw = stream.read(1 << 20)
        done = not raw
        while raw:
            held += unpacker.decompress(raw)
            raw = unpacker.unused_data
            if unpacker.eof:
                unpacker = zlib.decompressobj(31)
                head, _, rest = held.partition(b"\r\n\r\n")
                headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                yield headers, rest[: int(headers["Content-Length"])]
                held = b""


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the manifest's files, in READ's columns; the payload is null for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = file_system(folder)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for headers, block in records_of(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b": ")[2])
                        page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page")
                        response = headers["WARC-Type"] == "response"
                        if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or response and headers["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
                            raise ValueError(f"{name}: a record's digest doesn't match")
                        rows.append((None if page is None else int(page), headers["WARC-Target-URI"], headers["WARC-Type"], size, headers["WARC-Payload-Digest"].removeprefix("sha1:"), None if refers is None else int(refers), payload if response else None))
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=READ.names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=READ.names)

    return manifest.select("file").repartition("file").mapInArrow(run, READ)


def archive_digest(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads them back: one row for each page."""
    folder = f"{shared_dir(pages.sparkSession)}/warc"
    back = read_archives(write_archives(pages, folder), folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
