"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the centred, normalised vectors is learnt so that their signs are balanced binary codes that keep angles. Each
table takes a substring of the code (the first tables cut it up, further ones cut up a shuffled code); vectors that agree in a
substring meet in a bucket, and there the original vectors are compared by their cosine in double precision. A pair that agrees
in several substrings is counted in the first of them only. Codes are of centred vectors, the threshold is one on the vectors as
they are, so how many bits two codes share at the threshold depends on the data: it is measured on pairs made from the sample,
half of them apart in any direction, half in that of another vector. For each length of substrings as many tables are drawn as it
takes to miss no more than one pair in a hundred of either half; the length is taken whose tables compare and move least. So
substrings grow with the number of vectors, and comparisons a vector stay about level.

Equal vectors of one label are folded into one class first. A large bucket is cut into blocks of bounded size; each pair of
blocks is compared on its own and gives, for each vector, its number of links and the smallest vector that it reaches inside
the pair of blocks. So no task sees a whole large bucket and no list of pairs is ever written.

Edge cases: a vector that is null, empty, zero, or holds a null or non-finite component, or whose label or id is null, links
with nothing. Vectors of different lengths don't link. Rows that repeat an id are one node: they share a component and the sum
of their links. An empty table gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import components, sample_of, shared_dir, written


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 50, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): code bit k of x is the sign of ((x - mean) @ projection)[k]."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    values, vectors = np.linalg.eigh(centred.T @ centred)
    axes = vectors[:, np.argsort(values)[::-1][:bits]]
    reduced = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        code = np.where(reduced @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(code.T @ reduced)
        rotation = (u @ vt).T
    return mean, axes @ rotation


def unit_rows(column: pa.ListArray) -> list[np.ndarray | None]:
    """Each vector at length 1 in double precision, or None where it can't link."""
    out: list[np.ndarray | None] = []
    for row in column:
        values = row.values
        if values is None or len(values) == 0 or values.null_count:
            out.append(None)
            continue
        x = values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(x).max()
        if not np.isfinite(x).all() or top == 0:
            out.append(None)
            continue
        x = x / top  # no overflow or underflow in the norm
        out.append(x / np.sqrt(x @ x))
    return out


def units_of(raw: np.ndarray) -> np.ndarray:
    """unit_rows for vectors of equal length that can link."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


#: Comparisons that cost as much as moving a vector into a bucket, and most tables that are tried for one length of substrings.
MOVE, MOST_TABLES = 200, 400


def threshold_pairs(sample: np.ndarray, threshold: float, pairs: int = 4000, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of unit vectors, row by row at a cosine of threshold: vectors of the sample and what they are moved to, for the
    first half in a random direction, for the second in that of another vector of the sample."""
    random = np.random.default_rng(seed)
    left = sample[random.integers(0, len(sample), pairs)]
    other = random.standard_normal(left.shape)
    other[pairs // 2 :] = sample[random.integers(0, len(sample), pairs - pairs // 2)]
    other -= (other * left).sum(axis=1, keepdims=True) * left
    length = np.sqrt((other * other).sum(axis=1, keepdims=True))
    other = np.divide(other, length, out=np.zeros_like(other), where=length > 1e-9)  # no other direction: the pair is one vector
    right = threshold * left + math.sqrt(1 - threshold**2) * other
    return left, right / np.sqrt((right * right).sum(axis=1, keepdims=True))


def table_positions(rows: int, agree: np.ndarray, miss: float = 0.01, seed: int = 9) -> list[np.ndarray]:
    """The code bits of each table's substring. agree: for pairs at the threshold (as threshold_pairs makes them), by bit, whether
    their codes agree."""
    pairs, bits = agree.shape
    best: tuple[float, list[np.ndarray]] = (math.inf, [])
    for width in range(1, min(bits, 48) + 1):
        random, order, tables, met, at = np.random.default_rng(seed), np.arange(bits), [], np.zeros(pairs, bool), 0
        cost = lambda n, width=width: n * (MOVE + rows / 2**width)
        while len(tables) < MOST_TABLES and cost(len(tables) + 1) < best[0]:
            if at + width > bits:
                order, at = random.permutation(bits), 0
            tables.append(order[at : at + width])
            met |= agree[:, tables[-1]].all(axis=1)
            at += width
            if max(1 - met[: pairs // 2].mean(), 1 - met[pairs // 2 :].mean()) <= miss:
                best = (cost(len(tables)), tables)
                break
    return best[1]


CODED = T.StructType([T.StructField("vec", T.LongType()), T.StructField("times", T.LongType()), T.StructField("label", T.StringType()), T.StructField("raw", T.BinaryType()), T.StructField("code", T.LongType()), T.StructField("parts", T.ArrayType(T.LongType()))])
LINKED = T.StructType([T.StructField("vec", T.LongType()), T.StructField("links", T.LongType()), T.StructField("low", T.LongType())])


def codes(classes: DataFrame, mean: np.ndarray, projection: np.ndarray, tables: list[np.ndarray]) -> DataFrame:
    """(vec, times, label, vector, code, substrings) of the vectors that can link."""
    dims, bits = projection.shape
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_rows(batch.column(3))
            good = [i for i, u in enumerate(units) if u is not None]
            fitted = np.zeros((len(good), dims))
            for k, i in enumerate(good):
                n = min(dims, len(units[i]))
                fitted[k, :n] = units[i][:n]  # other lengths than the usual one still get a code
            bit = ((fitted - mean) @ projection) >= 0
            code = (bit * weights).sum(axis=1, dtype=np.uint64)
            parts = np.stack([bit[:, t] @ (np.int64(1) << np.arange(len(t), dtype=np.int64)) for t in tables], axis=1)
            kept = batch.take(pa.array(good, pa.int64()))
            raw = [v.values.to_numpy(zero_copy_only=False).tobytes() for v in kept.column(3)]
            offsets = pa.array(np.arange(len(good) + 1, dtype=np.int32) * len(tables))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(2), pa.array(raw, pa.binary()), pa.array(code.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(parts.ravel()))], names=CODED.names)

    return classes.select("vec", "times", "label", "embedding").mapInArrow(run, CODED)


def lowest_reachable(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches by links inside one small block."""
    low = ids.copy()
    while True:
        step = np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        step = np.minimum(low, step)
        if (step == low).all():
            return low
        low = step


def compare(left: tuple, right: tuple | None, masks: list[np.uint64], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within one block (right None) or between two blocks of a bucket: (vec, links, lowest reachable vec).

    masks: the substrings of the tables before this one; pairs that agree in one of them are counted there.
    """
    ids, times, units, code = left if right is None else tuple(np.concatenate(x) for x in zip(left, right, strict=True))
    linked = units @ units.T >= threshold
    np.fill_diagonal(linked, False)
    if right is not None:
        linked[: len(left[0]), : len(left[0])] = False
        linked[len(left[0]) :, len(left[0]) :] = False
    i, j = np.nonzero(linked)
    differ = code[i] ^ code[j]
    for mask in masks:
        linked[i, j] &= differ & mask != 0
    links = linked @ times
    some = links > 0
    return ids[some], links[some], lowest_reachable(linked[np.ix_(some, some)], ids[some])


def bucket_links(coded: DataFrame, tables: list[np.ndarray], block: int, threshold: float, kind: str) -> DataFrame:
    """(vec, links, low): partial link counts, and an edge to the smallest vector reached, for each block comparison."""
    members = coded.select("vec", "times", "label", "raw", "code", F.length("raw").alias("width"), F.posexplode("parts").alias("table", "part"))
    masks = [np.uint64(sum(1 << int(p) for p in t)) for t in tables]
    bucket = ["label", "width", "table", "part"]
    sizes = members.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    own = F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int")
    placed = members.join(sizes, bucket).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    keys = [*bucket, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block_of(rows: list[tuple]) -> tuple:
            return (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), units_of(np.stack([np.frombuffer(r[2], kind) for r in rows])), np.array([r[3] for r in rows], np.int64).view(np.uint64))

        def settle(key: tuple, rows: list[tuple]) -> tuple:
            left, right = [r for r in rows if r[4] == key[4]], [r for r in rows if r[4] != key[4]]
            if key[4] != key[5] and not (left and right) or len(rows) < 2:
                return (np.zeros(0, np.int64),) * 3
            return compare(block_of(left), block_of(right) if right else None, masks[: key[2]], threshold)

        key, rows = None, []
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in (*keys, "vec", "times", "raw", "code", "own")]
            for row in zip(*columns, strict=True):
                if row[:6] != key:
                    if rows:
                        out.append(settle(key, rows))
                    key, rows = row[:6], []
                rows.append(row[6:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=LINKED.names)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in settle(key, rows)], names=LINKED.names)

    return paired.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "vec", "times", "raw", "code", "own").mapInArrow(run, LINKED)


def near_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = 192, sample_rows: int = 20_000, miss: float = 0.01, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    The rotation is fitted on about sample_rows rows (twice as many at most), chosen by a hash of label and vector; every vector
    is indexed. Of pairs at the threshold a share of about miss is missed, of closer pairs less.
    """
    spark = vectors.sparkSession
    work = shared_dir(spark)
    single = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("embedding"))
    # vectors are told apart by 128 bits of hashes, so that arrays are never join keys
    same = ["label", "m1", "m2"]
    rows = rows.withColumns({"m1": F.xxhash64(F.lit(1), "label", "embedding"), "m2": F.xxhash64(F.lit(2), "embedding", "label")})
    usable = rows.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0")
    width = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims = width[0]["d"] if width else 1
    sample = [x for r in sample_of(usable.where(F.size("embedding") == dims), "m1", sample_rows).select("embedding").toArrow().column(0).chunks for x in unit_rows(r) if x is not None]
    mean, projection = learn_rotation(np.stack(sample) if sample else np.eye(dims), min(64, dims))
    # equal vectors of a label: the smallest id stands for all
    classes = written(usable.groupBy(*same).agg(F.min("vec_id").alias("vec"), F.count("*").alias("times"), F.first("embedding").alias("embedding")), f"{work}/classes")
    left, right = threshold_pairs(np.stack(sample) if sample else np.eye(dims), threshold)
    agree = ((left - mean) @ projection >= 0) == ((right - mean) @ projection >= 0)
    tables = table_positions(classes.count(), agree, miss)
    coded = written(codes(classes, mean, projection, tables), f"{work}/codes")
    found = written(bucket_links(coded, tables, block, threshold, "<f4" if single else "<f8"), f"{work}/found")
    counts = found.groupBy("vec").agg(F.sum("links").alias("links"))
    owners = written(usable.select("vec_id", *same).join(classes.select(*same, "vec", "times"), same).select("vec_id", "vec", "times"), f"{work}/owners")
    edges = found.select(F.col("vec").alias("a"), F.col("low").alias("b")).union(owners.join(coded.select("vec"), "vec", "left_semi").select(F.col("vec").alias("a"), F.col("vec_id").alias("b")))
    labels = components(edges, f"{work}/parts")
    sums = coded.select("vec").distinct().join(counts, "vec", "left").select("vec", F.coalesce("links", F.lit(0)).alias("links"))
    known = classes.join(sums, "vec", "left").select(*same, F.when(F.col("links").isNotNull(), F.col("links") + F.col("times") - 1).otherwise(0).alias("n_links"))
    out = rows.select("vec_id", *same).join(known, same, "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"))
