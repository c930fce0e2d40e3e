"""A persisted inverted index over a chunk table, with block-max skipping, and BM25 on it.

The chunks of a segment are numbered task by task, in the order in which they come, and cut into ranges of RANGE. The postings of a term in a range
are a block, with the most that any of them can add to a score. The blocks of a term in PACK ranges are one row, their postings and
what heads them as bytes, for most terms are in few chunks, and what a build costs goes by its rows. A query adds up these bounds by range, scores the ranges
of the largest bounds first, and then only those whose bound reaches the score of the worst hit so far. So hits are those of
scoring everything, while most blocks are never read. Rows lie in buckets of their term, sorted by term and pack.

The index grows by segments: new chunks are a new segment, and the objects that they replace, or that are gone, are listed with it
and no longer count in earlier ones. Term and chunk counts are kept as sums that each segment adds to or subtracts from, so a
segment costs its own size. Where segments become many they are written as one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corvid import model
from corvid.functions import text as t
from corvid.operators import order, search
from corvid.operators.ledger import Ledger, Transaction, once

#: Chunks in a range; ranges that are scored first, and how many times as many in each further round while hits are too few; an
#: index of so few ranges is scored whole, in one look.
RANGE, FIRST_RANGES, GROWTH, WHOLE = 128, 64, 8, 512
#: Ranges in a pack.
PACK = 64
#: Postings in a bucket of terms, about; blocks in a share of a bucket, about; most buckets; segments up to which none are merged.
BUCKET_POSTINGS, SHARE_BLOCKS, MOST_BUCKETS, MOST_SEGMENTS = 2_000_000, 200_000, 4096, 16
#: Neighbouring ranges whose chunks are written together; tasks that share a range for what is left of their chunks.
SHARE_RANGES, TAILS = 4096, 4
#: Up to so many ranges are named in a filter on the blocks; more are joined.
NAMED_RANGES = 1000
BLOCKS = "term string, pack long, n int, cf long, heads binary, narrow binary, wide binary"
DOCS = "doc long, range long, chunk_id string, object_uri string, connector_uri string, chunk_kind string, len int"
TERMS = "term string, df long, cf long"
#: How blocks are stored; segments in another form can't be read.
FORM = 2
KEYS = ("chunk_id", "object_uri", "connector_uri", "chunk_kind")
CHUNK = "struct<doc:bigint,chunk_id:string,object_uri:string,connector_uri:string,chunk_kind:string,len:int>"
TOLD = pa.struct([("doc", pa.int64()), *((k, pa.string()) for k in KEYS), ("len", pa.int32())])
#: What is shuffled: a term's blocks of a pack, or (d) a chunk; place: the pack, or the chunk's range.
ROWS = f"term string, place bigint, cf bigint, heads binary, narrow binary, wide binary, d {CHUNK}"
_ROWS = pa.schema([("term", pa.string()), ("place", pa.int64()), ("cf", pa.int64()), ("heads", pa.binary()), ("narrow", pa.binary()), ("wide", pa.binary()), ("d", TOLD)])
#: Blocks one by one, their postings as bytes, narrow or wide; and as lists, with what heads a block.
_MOVED = pa.schema([("term", pa.string()), ("range", pa.int64()), ("narrow", pa.binary()), ("wide", pa.binary()), ("d", TOLD)])
LISTS = "term string, range bigint, n int, cf bigint, max_tf int, min_len int, impact double, docs array<bigint>, tfs array<int>, lens array<int>"
_LISTS = pa.schema([("term", pa.string()), ("range", pa.int64()), ("n", pa.int32()), ("cf", pa.int64()), ("max_tf", pa.int32()), ("min_len", pa.int32()), ("impact", pa.float64()), ("docs", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("lens", pa.list_(pa.int32()))])
#: A block of a row: which range of the pack it is of, whether its postings are wide, how many, and the most that one adds, rounded up.
HEAD = np.dtype([("at", "u1"), ("wide", "u1"), ("n", "<u2"), ("impact", "<f4")])
#: A posting of a block whose chunks are close together, occur and are as long as these hold, and of any other.
NARROW, WIDE = np.dtype([("doc", "u1"), ("tf", "u1"), ("len", "<u2")]), np.dtype([("doc", "<i8"), ("tf", "<i4"), ("len", "<i4")])

_IN_WORD = np.array([c > 127 or chr(c).isalnum() for c in range(256)])


def _bytes(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """counts[i] of the values in a row as the bytes of row i."""
    offsets = np.r_[0, np.cumsum(counts * values.dtype.itemsize)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _values(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(values, how many are of each row), of _bytes."""
    counts = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) // kind.itemsize
    data = column.cast(pa.binary()).buffers()[2]
    first = np.frombuffer(column.cast(pa.binary()).buffers()[1], np.int32)[column.offset] if data is not None else 0
    return (np.frombuffer(data, kind, int(counts.sum()), int(first)) if data is not None else np.zeros(0, kind)), counts


def _blocks(terms: pa.Array, row: np.ndarray, ranges: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray, size: int) -> pa.RecordBatch:
    """Postings, each of a row of terms and a range and in their order, as blocks that are to be shuffled."""
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (ranges[1:] != ranges[:-1])]) if len(row) else np.zeros(0, np.int64)
    n, place = np.diff(np.r_[first, len(row)]), doc - ranges * size
    fits = (ranges >= 0) & (place >= 0) & (place < 1 << 8) & (tf < 1 << 8) & (length < 1 << 16)
    small = np.logical_and.reduceat(fits, first) if len(first) else np.zeros(0, bool)
    every = np.repeat(small, n)
    as_values = lambda kind, own, docs: np.rec.fromarrays([docs[own], tf[own], length[own]], dtype=kind)
    return pa.RecordBatch.from_arrays([terms.take(pa.array(row[first])).cast(pa.string()), pa.array(ranges[first]), _bytes(as_values(NARROW, every, place), np.where(small, n, 0)), _bytes(as_values(WIDE, ~every, doc), np.where(small, 0, n)), pa.nulls(len(first), TOLD)], schema=_MOVED)


def _chunks(ranges: np.ndarray, doc: np.ndarray, columns: list[pa.Array]) -> pa.RecordBatch:
    """Numbered chunks (KEYS, len) as ROWS."""
    d = pa.StructArray.from_arrays([pa.array(doc, pa.int64()), *(c.cast(TOLD[1 + i].type) for i, c in enumerate(columns))], fields=list(TOLD))
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()) if f.name == "place" else d if f.name == "d" else pa.nulls(len(d), f.type) for f in _ROWS], schema=_ROWS)


def _cut(column: pa.Array, lengths: np.ndarray) -> pa.Array:
    """The bytes of a column, in their order, as rows of these lengths."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    begin = int(np.frombuffer(offsets, np.int32)[column.offset]) if len(column) else 0
    ends = (begin + np.r_[0, np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), data if data is not None else pa.py_buffer(b"")])


def _postings(ranges: np.ndarray, narrow: pa.Array, wide: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, tf, len of each posting, how many are of each block)."""
    (small, n_small), (large, n_large) = _values(narrow, NARROW), _values(wide, WIDE)
    n = n_small + n_large
    in_wide = np.repeat(n_large > 0, n)

    def of(name: str) -> np.ndarray:
        out = np.empty(len(in_wide), np.int64)
        out[~in_wide], out[in_wide] = small[name], large[name]
        return out

    return of("doc") + np.where(in_wide, 0, np.repeat(ranges * size, n)), of("tf"), of("len"), n


def _added(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / mean))


def _rows(blocks: pa.RecordBatch, size: int, mean: float) -> pa.RecordBatch:
    """Blocks, those of a term beside each other and by their ranges, as ROWS."""
    if not blocks.num_rows:
        return pa.RecordBatch.from_arrays([pa.nulls(0, f.type) for f in _ROWS], schema=_ROWS)
    ranges, term = blocks.column(1).to_numpy(), blocks.column(0).dictionary_encode().indices.to_numpy()
    _, tf, length, n = _postings(ranges, blocks.column(2), blocks.column(3), size)
    pack = np.where(ranges < 0, ranges, ranges // PACK)
    first, at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (pack[1:] != pack[:-1])]), np.r_[0, np.cumsum(n)[:-1]]
    heads = np.zeros(len(n), HEAD)
    heads["at"], heads["n"] = np.where(ranges < 0, 0, ranges - pack * PACK), n
    narrow, wide = (pc.binary_length(blocks.column(c)).to_numpy().astype(np.int64) for c in (2, 3))
    heads["wide"], heads["impact"] = wide > 0, np.nextafter(np.maximum.reduceat(_added(tf, length, mean), at).astype(np.float32), np.float32(np.inf))
    cf = np.add.reduceat(np.add.reduceat(tf, at), first)
    held = [_cut(blocks.column(c), np.add.reduceat(k, first)) for c, k in ((2, narrow), (3, wide))]
    return pa.RecordBatch.from_arrays([blocks.column(0).take(pa.array(first)), pa.array(pack[first]), pa.array(cf), _bytes(heads, np.diff(np.r_[first, len(n)])), *held, pa.nulls(len(first), TOLD)], schema=_ROWS)


def _heads(packs: pa.Array, heads: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, range, HEAD) of each block of rows."""
    own, k = _values(heads, HEAD)
    row = np.repeat(np.arange(len(k)), k)
    pack = packs.to_numpy()[row]
    return row, np.where(pack < 0, pack, pack * PACK + own["at"]), own


def _split(packs: pa.Array, heads: pa.Array, narrow: pa.Array, wide: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(row, range, narrow, wide) of each block of rows."""
    row, ranges, own = _heads(packs, heads)
    n, is_wide = own["n"].astype(np.int64), own["wide"] > 0
    return row, ranges, _cut(narrow, np.where(is_wide, 0, n * NARROW.itemsize)), _cut(wide, np.where(is_wide, n * WIDE.itemsize, 0))


def _unpacked(size: int, mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks one by one to LISTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in batches:
            if not blocks.num_rows:
                continue
            doc, tf, length, n = _postings(blocks.column(1).to_numpy(), blocks.column(2), blocks.column(3), size)
            first, add = np.r_[0, np.cumsum(n)[:-1]], _added(tf, length, mean)
            listed = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.r_[first, len(values)], pa.int32()), pa.array(values, kind))
            heads = [pa.array(n, pa.int32()), pa.array(np.add.reduceat(tf, first)), pa.array(np.maximum.reduceat(tf, first), pa.int32()), pa.array(np.minimum.reduceat(length, first), pa.int32()), pa.array(np.maximum.reduceat(add, first), pa.float64())]
            yield pa.RecordBatch.from_arrays([blocks.column(0).cast(pa.string()), blocks.column(1), *heads, listed(doc, pa.int64()), listed(tf, pa.int32()), listed(length, pa.int32())], schema=_LISTS)

    return run


def _opened(size: int, mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as they are stored (seg, term, pack, heads, narrow, wide) to seg and LISTS."""
    lists = _unpacked(size, mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ranges, narrow, wide = _split(*batch.columns[2:])
            blocks = pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row)).cast(pa.string()), pa.array(ranges, pa.int64()), narrow, wide, pa.nulls(len(row), TOLD)], schema=_MOVED)
            for made in lists(iter([blocks])):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *made.columns], names=["seg", *_LISTS.names])

    return run


def _headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seg, term, pack, heads) to (seg, term, range, impact) of each block."""
    for batch in batches:
        row, ranges, own = _heads(*batch.columns[2:])
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in (0, 1)), pa.array(ranges, pa.int64()), pa.array(own["impact"].astype(np.float64))], names=["seg", "term", "range", "impact"])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, words) of batches of texts; words are runs of ASCII letters, digits and all other characters beyond ASCII, so about as many."""
    for batch in batches:
        column = batch.column(0).cast(pa.binary())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        inside = _IN_WORD[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.zeros(0, bool)
        begins = inside & ~np.r_[False, inside[:-1]][: len(inside)]
        starts = ends[:-1] - ends[0]
        starts = starts[starts < len(inside)]
        begins[starts] = inside[starts]
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([int(begins.sum())], pa.int64())], names=["n", "words"])


def _coded(terms: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct terms in their order, the place of each of the terms in it): sorted rows are merged later, not sorted."""
    coded = terms.dictionary_encode()
    by_term = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(by_term), np.int64)
    rank[by_term.to_numpy()] = np.arange(len(by_term))
    return coded.dictionary.take(by_term), rank[coded.indices.to_numpy()]


def _packed(size: int, mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbered chunks (doc, KEYS, len, words) to ROWS. A task numbers its chunks in a row and cuts them into ranges; what is left
    at the end of TAILS neighbouring tasks makes one range, of a negative number."""

    def pack(rows: pa.RecordBatch, tail: bool = False) -> Iterator[pa.RecordBatch]:
        doc, length, lists = rows.column(0).to_numpy(), rows.column(len(KEYS) + 1).to_numpy(zero_copy_only=False), rows.column(len(KEYS) + 2)
        task, nth = doc >> 33, doc & (1 << 33) - 1
        ranges = -1 - task // TAILS if tail else (task << 33) // size + nth // size
        yield _chunks(ranges, doc, [rows.column(i) for i in range(1, len(KEYS) + 2)])
        dictionary, code = _coded(lists.flatten())
        which = np.repeat(np.arange(len(doc)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        both, tf = np.unique(code * len(doc) + which, return_counts=True)
        at = both % len(doc)
        yield _rows(_blocks(dictionary, both // len(doc), ranges[at], doc[at], tf, length[at], size), size, mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, most = None, PACK * size
        for batch in batches:
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            while rows.num_rows > most:  # the first chunk is a pack's first
                yield from pack(rows.slice(0, most))
                rows = rows.slice(most)
            rest = rows
        if rest is not None and rest.num_rows:
            whole = rest.num_rows - rest.num_rows % size
            if whole:
                yield from pack(rest.slice(0, whole))
            if whole < rest.num_rows:
                yield from pack(rest.slice(whole), tail=True)

    return run


def _renumbered(size: int, mean: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One old pack: its rows (seg, pack, term, heads, narrow, wide) and its living chunks (seg, pack, base, doc, KEYS, len), whose
    first one's new number is base, to ROWS under new numbers."""

    def run(rows: pa.Table, chunks: pa.Table) -> pa.Table:
        if not chunks.num_rows:
            return _ROWS.empty_table()
        own = chunks.column("doc").to_numpy()
        alive, base = np.sort(own), chunks.column("base")[0].as_py()
        doc = base + np.searchsorted(alive, own)
        out = [_chunks(doc // size, doc, [chunks.column(c).combine_chunks() for c in (*KEYS, "len")])]
        if rows.num_rows:
            row, ranges, narrow, wide = _split(*(rows.column(c).combine_chunks() for c in ("pack", "heads", "narrow", "wide")))
            old, tf, length, n = _postings(ranges, narrow, wide, size)
            place = np.minimum(np.searchsorted(alive, old), len(alive) - 1)
            terms, code = _coded(rows.column("term").combine_chunks())
            which, new = np.repeat(code[row], n), base + place
            kept = np.flatnonzero(alive[place] == old)
            kept = kept[np.lexsort((new[kept], which[kept]))]
            out.append(_rows(_blocks(terms, which[kept], new[kept] // size, new[kept], tf[kept], length[kept], size), size, mean))
        return pa.Table.from_batches(out)

    return run


def saturated(tf: Column, length: Column, avgdl: float) -> Column:
    """What a posting adds to a score, but for its term's weight."""
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / F.lit(avgdl)))


class Postings:
    def __init__(self, spark: SparkSession, root: str, ledger: Ledger | None = None, name: str = "postings"):
        self.spark, self.name = spark, name
        self.ledger = ledger or Ledger(spark, root)
        self.root = f"{self.ledger.root}/{name}"

    def state(self, tx: Transaction | None = None) -> dict:
        """segments: their number, folder, buckets and how many chunks they have; next, chunks and words: sums over what lives."""
        return (tx.state if tx is not None else self.ledger.state()).get(self.name) or {"segments": [], "next": 1, "chunks": 0, "words": 0}

    def segments(self) -> int:
        return len(self.state()["segments"])

    # reading

    def _read(self, state: dict, table: str, schema: str, words: list[str] | None = None) -> DataFrame:
        """A table of all segments, with the segment's number; words: only the buckets of these terms."""
        out, names = None, [c.split()[0] for c in schema.split(", ")]
        for s in state["segments"]:
            if table not in s["tables"]:
                continue
            if table == "blocks" and s.get("form") != FORM:
                raise model.EngineError("index_outdated", f"segment {s['number']} was written in an earlier form; index its objects anew")
            folder = f"{self.root}/{s['folder']}/{'kind=' if table in ('blocks', 'docs') else ''}{table}"
            if words is not None:
                wanted = {zlib.crc32(w.encode()) % s["buckets"] for w in words} & set(s["held"])
                if not wanted:
                    continue
                own = self.spark.read.schema(schema).parquet(*[f"{folder}/bucket={b}" for b in sorted(wanted)]).where(F.col("term").isin(words))
            else:
                own = self.spark.read.schema(schema).parquet(folder)
            own = own.select(*names).withColumn("seg", F.lit(s["number"]))
            out = own if out is None else out.unionByName(own)
        return out if out is not None else self.spark.createDataFrame([], f"{schema}, seg int")

    def _living(self, docs: DataFrame, state: dict) -> DataFrame:
        """Chunks of objects that no later segment lists as gone or replaced."""
        if not any("gone" in s["tables"] for s in state["segments"]):
            return docs
        gone = self._read(state, "gone", "object_uri string").groupBy("object_uri").agg(F.max("seg").alias("until"))
        return docs.join(gone, "object_uri", "left").where(F.col("seg") >= F.coalesce("until", F.lit(0))).drop("until")

    def vocabulary(self) -> DataFrame:
        """(term, df, cf): how many living chunks hold each term, and how often it occurs."""
        return self._read(self.state(), "terms", TERMS).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")

    def stats(self) -> DataFrame:
        """(n, avgdl) of all living chunks: one row."""
        state = self.state()
        return self.spark.createDataFrame([(state["chunks"], state["words"] / state["chunks"] if state["chunks"] else 0.0)], "n long, avgdl double")

    # writing

    def add(self, chunks: DataFrame, removed: DataFrame | None = None, tx: Transaction | None = None) -> int | None:
        """Indexes chunks as a new segment. removed: the chunks, with their content, that these replace or that are gone; all
        earlier chunks of their objects count no more."""
        return once(self.ledger, tx, lambda own: self._add(chunks, removed, own))

    def _add(self, chunks: DataFrame, removed: DataFrame | None, tx: Transaction) -> None:
        state = self.state(tx)
        about = chunks.select("content").mapInArrow(_sized, "n long, words long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
        rows = chunks.select(*KEYS, t.tokens(F.col("content")).alias("words")).select(F.monotonically_increasing_id().alias("doc"), *KEYS, F.size("words").cast("int").alias("len"), "words")
        self._write(lambda mean: rows.mapInArrow(_packed(RANGE, mean), ROWS), about, removed, state, tx)

    def _write(self, parts: Callable[[float], DataFrame], about: Row, removed: DataFrame | None, state: dict, tx: Transaction, replaces: bool = False) -> None:
        """parts: ROWS by the mean length that bounds are told for, where blocks of one term and range may be several; about: how many
        chunks are in it, and about how many words. Rows are shuffled once, as bytes, to where they are written."""
        folder = tx.folder()
        at = f"{self.root}/{folder}"
        less = removed.select("chunk_id", t.tokens(F.col("content")).alias("words")) if removed is not None else None
        gone = {"n": 0, "words": 0}
        if less is not None:
            count = lambda rows: rows.agg(F.count("*").alias("rows"), F.countDistinct("chunk_id").alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).first()
            gone = count(less)
            if gone["rows"] != gone["n"]:
                less = less.dropDuplicates(["chunk_id"])
                gone = count(less)
        totals = lambda n, words: (n, words) if replaces else (state["chunks"] + n - gone["n"], state["words"] + words - gone["words"])
        chunks, total = totals(about["n"], about["words"])
        mean = max(total / chunks, 1e-9) if chunks else 1.0
        # how finely it is cut follows from how much it is; a term of every range has as many blocks as there are ranges
        buckets = min(MOST_BUCKETS, max(1, math.ceil(about["words"] / BUCKET_POSTINGS)))
        shares = max(1, math.ceil(about["n"] / RANGE / SHARE_BLOCKS))
        bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int")
        held = lambda table: {int(n[7:]) for n in self.ledger.names(f"{self.name}/{folder}/{table}") if n.startswith("bucket=")}
        new = {"n": 0, "words": 0}
        if about["n"]:
            is_doc = F.col("d").isNotNull()
            kind, share = F.when(is_doc, "docs").otherwise("blocks"), F.when(is_doc, F.floor(F.col("place") / SHARE_RANGES)).otherwise(F.pmod(F.col("place"), F.lit(shares)))
            at_bucket = F.coalesce(bucket, F.lit(0)).alias("bucket")
            # a task of its own for a bucket or two
            tasks = min(2 * (buckets * shares + math.ceil(about["n"] / RANGE / SHARE_RANGES)), MOST_BUCKETS)
            placed = parts(mean).repartition(tasks, kind, at_bucket, share.cast("long"))
            n = F.octet_length("narrow") / NARROW.itemsize + F.octet_length("wide") / WIDE.itemsize
            whole = placed.select(kind.alias("kind"), at_bucket, "term", F.when(~is_doc, F.col("place")).alias("pack"), F.when(is_doc, F.col("place")).alias("range"), n.cast("int").alias("n"), "cf", "heads", "narrow", "wide", *[F.col("d")[c].alias(c) for c in ("doc", *KEYS, "len")])
            whole.sortWithinPartitions("kind", "bucket", "term", "pack", "doc").write.partitionBy("kind", "bucket").option("compression", "zstd").parquet(at)
            new = self.spark.read.schema(DOCS).parquet(f"{at}/kind=docs").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first()
        chunks, total = totals(new["n"], new["words"])
        in_blocks = held("kind=blocks")
        counts = self.spark.read.schema(BLOCKS).parquet(f"{at}/kind=blocks").groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf")) if in_blocks else self.spark.createDataFrame([], TERMS)
        if less is not None:
            of = lambda words, df, cf: less.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("k")).select("term", (-F.col("k") * df).alias("df"), (-F.col("k") * cf).alias("cf"))
            each = of(F.array_distinct("words"), 1, 0).unionByName(of(F.col("words"), 0, 1))
            counts = counts.unionByName(each).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df <> 0 or cf <> 0")
            removed.select("object_uri").distinct().write.parquet(f"{at}/gone")
        counts.select("term", "df", "cf", bucket.alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/terms")
        in_terms = held("terms")
        there = {"docs": new["n"], "blocks": in_blocks, "terms": in_terms, "gone": removed is not None}
        entry = {"number": state["next"], "folder": folder, "form": FORM, "buckets": buckets, "held": sorted(in_blocks), "chunks": new["n"], "mean": mean, "tables": sorted(k for k, v in there.items() if v)}
        if in_terms != in_blocks:  # counts of terms may cancel out, and terms may only be gone
            entry["held_terms"] = sorted(in_terms)
        tx.state[self.name] = {"segments": [*([] if replaces else state["segments"]), entry], "next": state["next"] + 1, "chunks": chunks, "words": total}
        if len(tx.state[self.name]["segments"]) > MOST_SEGMENTS:
            self._compact(tx)

    def compact(self, tx: Transaction | None = None) -> int | None:
        """All living postings as one segment; the earlier ones are read no more."""
        return once(self.ledger, tx, self._compact)

    def _compact(self, tx: Transaction) -> None:
        """Living chunks are numbered anew without gaps: counts by old pack tell each pack's first new number, and its rows and
        chunks meet to be renumbered."""
        state = self.state(tx)
        pack = F.when(F.col("range") < 0, F.col("range")).otherwise(F.floor(F.col("range") / PACK)).cast("long")
        living = self._living(self._read(state, "docs", DOCS), state).withColumn("pack", pack)
        new = living.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first()
        packs = order.sums_before(living.groupBy("seg", "pack").agg(F.count("*").alias("k")), ["seg", "pack"], "k", "base").select("seg", "pack", "base")
        chunks = living.join(packs, ["seg", "pack"]).select("seg", "pack", "base", "doc", *KEYS, "len").groupBy("seg", "pack")
        rows = self._read(state, "blocks", BLOCKS).select("seg", "pack", "term", "heads", "narrow", "wide").groupBy("seg", "pack")
        self._write(lambda mean: rows.cogroup(chunks).applyInArrow(_renumbered(RANGE, mean), ROWS), new, None, state, tx, replaces=True)

    # searching

    def _bounds(self, state: dict, weights: dict[str, float], mean: float) -> DataFrame:
        """(seg, range, bound, blocks): the most that a chunk of each range can score, from the blocks' heads alone."""
        words = sorted(weights)
        weight = F.create_map(*[F.lit(x) for w in words for x in (w, weights[w])])
        # bounds from the time of writing hold for a smaller mean length; for a larger one they grow with it at most
        own = F.col("impact") * F.greatest(F.lit(1.0), F.lit(mean) / F.col("mean"))
        then = F.create_map(*[x for s in state["segments"] for x in (F.lit(s["number"]), F.lit(float(s.get("mean", mean))))])
        stored = self._read(state, "blocks", BLOCKS, words).select("seg", "term", "pack", "heads")
        heads = stored.mapInArrow(_headed, "seg int, term string, range long, impact double").withColumn("mean", F.element_at(then, F.col("seg")))
        return heads.groupBy("seg", "range").agg(F.sum(own * F.element_at(weight, F.col("term"))).alias("bound"), F.count("*").alias("blocks"))

    def _score(self, state: dict, weights: dict[str, float], mean: float, ranges: DataFrame | None, n: int, where: Column | None) -> DataFrame:
        """(chunk_id, object_uri, score) of the living chunks of n ranges, or of all (None)."""
        words = sorted(weights)
        weight = F.create_map(*[F.lit(x) for w in words for x in (w, weights[w])])
        blocks, docs = self._read(state, "blocks", BLOCKS, words), self._read(state, "docs", DOCS)
        if ranges is not None and n <= NAMED_RANGES:  # the numbers reach the scan
            named = [r["range"] for r in ranges.select("range").distinct().collect()]
            blocks, docs = blocks.where(F.col("pack").isin(sorted({r if r < 0 else r // PACK for r in named}))), docs.where(F.col("range").isin(named))
        blocks = blocks.select("seg", "term", "pack", "heads", "narrow", "wide").mapInArrow(_opened(RANGE, mean), f"seg int, {LISTS}")
        blocks = blocks if ranges is None else blocks.join(ranges.select("seg", "range"), ["seg", "range"], "left_semi")
        own = blocks.select("seg", "range", "term", F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("x"))
        part = F.element_at(weight, F.col("term")) * saturated(F.col("x.tfs"), F.col("x.lens"), mean)
        sums = own.groupBy("seg", "range", F.col("x.docs").alias("doc")).agg(F.round(F.sum(part), 6).alias("score"))
        told = docs.join(sums, ["seg", "range", "doc"])
        return self._living(told if where is None else told.where(where), state).select("chunk_id", "object_uri", "score")

    def _weights(self, state: dict, query: str) -> dict[str, float]:
        """The weight of each of the query's words that any living chunk holds."""
        words = sorted(set(search._tokens(query)))
        if not words or not state["chunks"]:
            return {}
        counts = {**state, "segments": [{**s, "held": s.get("held_terms", s["held"])} for s in state["segments"]]}
        df = self._read(counts, "terms", TERMS, words).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").collect()  # the query's words
        return {r["term"]: math.log(1 + (state["chunks"] - r["df"] + 0.5) / (r["df"] + 0.5)) for r in df}

    def bm25(self, query: str, where: Column | None = None, top_k: int = 10) -> DataFrame:
        """(chunk_id, object_uri, score): as search.bm25 over the living chunks."""
        return self.skipping(query, where, top_k)[0]

    def skipping(self, query: str, where: Column | None = None, top_k: int = 10) -> tuple[DataFrame, int, int]:
        """(hits, ranges whose blocks were read, ranges with any of the words)."""
        state = self.state()
        weights = self._weights(state, query)
        best = [F.desc("score"), F.col("chunk_id")]
        if not weights:
            return self.spark.createDataFrame([], "chunk_id string, object_uri string, score double"), 0, 0
        mean = state["words"] / state["chunks"]
        few = sum(math.ceil(s["chunks"] / RANGE) for s in state["segments"]) <= WHOLE
        if few:
            return self._score(state, weights, mean, None, 0, where).orderBy(*best).limit(top_k), 0, 0
        bounds = self._bounds(state, weights, mean).persist()
        try:
            every, taken, wanted = bounds.count(), 0, max(FIRST_RANGES, 2 * top_k // RANGE)
            hits, worst = [], -math.inf
            first = [F.desc("bound"), F.col("seg"), F.col("range")]
            while taken < every:
                # the best ranges first; once there are hits enough, all that may still hold a better one
                if len(hits) >= top_k:
                    left = bounds.where(F.col("bound") >= worst - 1e-5).count()
                    if left <= taken:
                        break
                    wanted = left
                chosen = bounds.orderBy(*first).limit(wanted)
                done = bounds.orderBy(*first).limit(taken) if taken else None
                part = chosen if done is None else chosen.join(done.select("seg", "range"), ["seg", "range"], "left_anti")
                hits += [tuple(r) for r in self._score(state, weights, mean, part, wanted - taken, where).orderBy(*best).limit(top_k).collect()]  # top_k rows
                hits = sorted(hits, key=lambda h: (-h[2], h[0]))[:top_k]
                worst, taken = (hits[-1][2] if len(hits) >= top_k else -math.inf), min(wanted, every)
                wanted = min(every, wanted * GROWTH)
        finally:
            bounds.unpersist()
        return self.spark.createDataFrame(hits, "chunk_id string, object_uri string, score double").orderBy(*best), taken, every
