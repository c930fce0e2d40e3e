"""Canonical exact fingerprints of documents.

A text is normalised (NFKC), its case folded and its white space collapsed; the fingerprint is the 128-bit xxhash of what is
left. Digests that several documents share are checked by their bytes: of each digest the smallest and the largest canonical
text are compared, which combines before the shuffle, so that a group of any size is checked without being gathered. Should
two documents ever share a digest and differ, the SHA-256 of the canonical text is appended to that digest, wherever it occurs.

Being exact, two fingerprints are either equal (likeness 1) or not (likeness 0).

Edge cases: a null text counts as empty. Rows are put in order by descending doc_id, then by a hash of their text, then by the
text, so repeated and null ids (which come last) have a defined next document and spread over tasks. The next document of the
last is the first; a lone document is its own. A very long text is one row. An empty table gives an empty result. Other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import hashed_share, shared_dir, written

#: Documents that one range of the order holds, about; the most ranges there are (each is one row of a broadcast table); keys
#: sampled for each range to find where it begins.
RANGE_ROWS, MOST_RANGES, SAMPLED_PER_RANGE = 1000, 50_000, 32


def canonical(text: str) -> bytes:
    """NFKC, case folded, NFKC again (folding can undo it), runs of white space as one blank, none at the ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def shared_digests(docs: DataFrame, work: str, hashed: Callable[[bytes], str] = digest) -> DataFrame:
    """(fingerprint): the digests that differing canonical texts of documents share; almost always none."""
    schema = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [canonical(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashed(t) for t in texts], pa.string()), pa.array([pack(t) for t in texts], pa.binary())], names=schema.names)

    # equal texts compress to equal bytes, and those take a third of the room
    every = docs.select("text").mapInArrow(run, schema)
    ends = every.groupBy("fingerprint").agg(F.min("packed").alias("low"), F.max("packed").alias("high"))
    return written(ends.where("low <> high").select("fingerprint"), f"{work}/clashing")


def range_starts(keyed: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The (place, tie) at which each range but the first begins: quantiles of a hash-chosen sample of the keys.

    A key counts once in the sample however many rows share it, so its size is bounded.
    """
    ranges = min(MOST_RANGES, max(1, rows // RANGE_ROWS))
    sample = keyed.where(hashed_share(F.struct("place", "tie"), rows, SAMPLED_PER_RANGE * ranges)).groupBy("place", "tie").agg(F.count("*").alias("n")).orderBy("place", "tie").toArrow()
    place, tie, n = (sample.column(c).to_numpy().astype(np.int64) for c in ("place", "tie", "n"))
    first = np.flatnonzero(np.diff((np.cumsum(n) - n) * ranges // max(1, n.sum()))) + 1
    return place[first], tie[first]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[bytes], str] = digest) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text of a document has its last third replaced by the beginning of the next document.
    """
    spark = docs.sparkSession
    work = shared_dir(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    clashing = shared_digests(docs, work, hashed)
    # the place falls as the id grows; the bits are flipped, as a minus could overflow
    place = F.bitwise_not(F.coalesce(F.col("doc_id"), F.lit(-(2**63))))
    keyed = docs.select("doc_id", "text", place.alias("place"), F.xxhash64("text").alias("tie"))
    places, ties = range_starts(keyed.select("place", "tie"), docs.count())

    @F.pandas_udf("int")
    def range_of(place: pd.Series, tie: pd.Series) -> pd.Series:
        low, high = np.searchsorted(places, place.to_numpy(), "left"), np.searchsorted(places, place.to_numpy(), "right")
        part = low.astype(np.int32)
        for k in np.flatnonzero(low < high):  # ids at which a range begins: the hash decides
            part[k] = low[k] + np.searchsorted(ties[low[k] : high[k]], tie.iloc[k], "right")
        return pd.Series(part)

    ranged = keyed.withColumn("part", range_of("place", "tie"))
    # the first document of each range is sent to the range before it as well, to close its last document's edit
    heads = keyed.select("place", "tie").withColumn("part", range_of("place", "tie")).groupBy("part").agg(F.min(F.struct("place", "tie")).alias("top")).orderBy("part").collect()
    ends = spark.createDataFrame([(row["part"], *row["top"], before["part"]) for before, row in zip([*heads[-1:], *heads[:-1]], heads, strict=True)], "part int, place long, tie long, at int")
    tops = ranged.join(F.broadcast(ends), ["part", "place", "tie"]).groupBy("at").agg(F.min(F.struct("text", "doc_id")).alias("top"))
    closing = tops.select("top.doc_id", "top.text", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("tie"), F.col("at").alias("part"), F.lit(1).alias("guest"))
    dealt = ranged.select("doc_id", "text", "place", "tie", "part", F.lit(0).alias("guest")).union(closing)

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()), T.StructField("wide", T.StringType()), T.StructField("edited_wide", T.StringType())])
    clashes = clashing.limit(1).count() > 0

    def one(own: tuple, following: tuple) -> tuple:
        key, text, plain = own
        third = len(text) // 3
        edited = text[: len(text) - third] + following[1][:third]
        changed = canonical(edited)
        wide = (hashlib.sha256(plain).hexdigest(), hashlib.sha256(changed).hexdigest()) if clashes else (None, None)
        return key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), hashed(plain), hashed(changed), float(plain == changed), float(plain == following[2]), *wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = None, None
        for batch in batches:
            out = []
            for doc, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part")), strict=True):
                if at != part:
                    part, before = at, None
                row = (doc, text, canonical(text))
                if before is not None:
                    out.append(one(before, row))
                before = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string()), strict=True)], names=schema.names)

    # a range's guest comes last and closes it
    ordered = dealt.repartition("part").sortWithinPartitions("part", "guest", "place", "tie", "text").select("doc_id", "text", "part")
    done = ordered.mapInArrow(run, schema)
    if not clashes:
        return done.drop("wide", "edited_wide")
    for column, wide in (("fingerprint", "wide"), ("edited_fingerprint", "edited_wide")):
        marked = clashing.select(F.col("fingerprint").alias(column), F.lit(True).alias("clash"))
        done = done.join(marked, column, "left").withColumn(column, F.when(F.col("clash"), F.concat_ws("-", column, wide)).otherwise(F.col(column))).drop("clash")
    return done.select(*schema.names[:7])
