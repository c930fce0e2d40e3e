"""Near-duplicate documents by min-max hashing of word shingles.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so a signature takes half the
hash evaluations. Values are banded; documents that share a band are candidates, and every link is confirmed on the full
shingle sets, so nothing below the threshold is linked.

Documents with equal sets are folded into one class first. In a band's bucket each member is paired with the bucket's smallest
member only; these pairs are confirmed and joined into components. In a bucket of at most STRAY_BLOCK members those outside its
largest component are then compared with all members of other components. In larger buckets, which documents with a common
template make, members of different components are compared only where they share one of their rarest shingles: two sets above
the threshold must share one of the rarest fifth of each (of |set| - ceil(threshold * |set|) + 1 shingles), counted over all
members of such buckets. Pairs are named for rare shingles of at most RARE documents; documents that share one which more have
(families of copies that differ a little) are compared by blocks as in small buckets. So every candidate pair is confirmed,
refuted or already connected, and documents that only share a template are never paired.

Edge cases: a null or blank text has no shingle; it links with nothing and is its own component. A text of fewer words than a
shingle has one shingle, the whole sequence. A null doc_id links with nothing: its component_id is null and it is kept. Rows
that share a doc_id are one node of the graph, so they get the same component. Of ties the smallest doc_id wins everywhere. Very
long texts are shingled whole, their signatures in pieces. An empty table gives an empty result. Other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvid.llm.common import HOT_LEAST, HOT_SHARE, among, components, matched, remove, shared_dir, written

#: Documents whose words are hashed together.
BLOCK = 2000
#: Shingles that go through the permutations at once.
CHUNK = 2048
#: Members of a bucket that are compared without regard to their shingles, and most of them in one side of a block comparison.
STRAY_BLOCK = 512
#: Documents that hold a rare shingle, up to which its pairs are written out.
RARE = 16
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes. Words are runs without ASCII white space, A-Z in lower case."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), "[ \t-\r]+")
    coded = pc.dictionary_encode(lists.flatten())
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    empty = pc.index(coded.dictionary, "").as_py()
    code, at = coded.indices.to_numpy(), lists.offsets.to_numpy()
    at = at - at[0]
    for begin, end in zip(at[:-1], at[1:], strict=True):
        own = code[begin:end]
        own = hashes[own[own != empty] if empty >= 0 else own]
        if len(own) >= words:
            n = len(own) - words + 1
            value = np.zeros(n, dtype=np.uint64)
            for k in range(words):
                value = mixed(value * MIX[0] + own[k : k + n])
            yield np.unique(value)
        elif len(own):
            value = np.full(1, len(own), dtype=np.uint64)
            for x in own:
                value = mixed(value * MIX[0] + x)
            yield value
        else:
            yield np.zeros(0, dtype=np.uint64)


class MinMax:
    """Band keys from the minimum and the maximum of each permutation."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        self.bands, self.rows = bands, rows
        random = np.random.default_rng(seed)
        n = -(-bands * rows // 2)
        self.a = random.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = random.integers(0, 2**63, n, dtype=np.uint64)
        # a permutation's two values go to different bands
        self.order = np.arange(bands * rows).reshape(rows, bands).T

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        low, high = np.full(len(self.a), 2**64 - 1, dtype=np.uint64), np.zeros(len(self.a), dtype=np.uint64)
        for i in range(0, len(shingles), CHUNK):
            value = shingles[None, i : i + CHUNK] * self.a[:, None] + self.b[:, None]
            value ^= value >> np.uint64(32)
            low, high = np.minimum(low, value.min(axis=1)), np.maximum(high, value.max(axis=1))
        signature = np.concatenate([low, high])[: self.bands * self.rows][self.order]
        key = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            key = mixed(key * MIX[0] + signature[:, k])
        return key.view(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def list_array(parts: list[np.ndarray], dtype: np.dtype) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype)))


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys) of every document."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = MinMax(bands, rows)
        for batch in blocks(batches):
            size, digest, keys = [], [], []
            for shingles in shingle_sets(batch.column(1), words):
                size.append(len(shingles))
                digest.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                keys.append(hashing.keys(shingles) if len(shingles) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), list_array(keys, np.int64)], names=schema.names)

    return docs.mapInArrow(run, schema)


def full_sets(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, shingles, band keys) of the given documents."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = MinMax(bands, rows)
        for batch in blocks(batches, 500):
            sets = list(shingle_sets(batch.column(1), words))
            keys = [hashing.keys(s) if len(s) else np.zeros(bands, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), list_array([s.view(np.int64) for s in sets], np.int64), list_array(keys, np.int64)], names=schema.names)

    return docs.mapInArrow(run, schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    # sizes alone refute most false candidates, before any set moves
    sized = pairs.join(left.drop("sa"), "a").join(right.drop("sb"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b").distinct()
    both = F.size(F.array_intersect("sa", "sb"))
    return sized.join(left, "a").join(right, "b").where(both * 100 >= (F.col("na") + F.col("nb") - both) * percent).select("a", "b")


CELL = ["key", "i", "j"]


def cells(placed: DataFrame) -> DataFrame:
    """(key, i, j, doc_id, part, stray): members of placed (key, doc_id, part) in the block comparisons that join what is apart.

    Members outside their bucket's largest part (the strays) meet all members, by blocks of bounded size.
    """
    parts = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("largest"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    number = lambda n: F.ceil(n / STRAY_BLOCK).cast("int")
    sizes = main.select("key", "main", number(F.col("all") - F.col("largest")).alias("rows"), number(F.col("all")).alias("columns"))
    cut = placed.join(sizes, "key")
    place = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    left = cut.where("part <> main").select("key", "doc_id", "part", F.lit(True).alias("stray"), place(F.col("rows")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
    right = cut.select("key", "doc_id", "part", F.lit(False).alias("stray"), place(F.col("columns")).alias("j"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"))
    return left.unionByName(right)


def rarest(wide: DataFrame, sets: DataFrame, percent: int, work: str) -> DataFrame:
    """(key, doc_id, part, n, before, held): the rarest shingles of each of wide (doc_id, part) that others have among theirs; n is
    the size of the document's set, before how many of its shingles are rarer, held the number of documents with the shingle among
    their rarest. All documents have one order of shingles, by how many have them."""
    own = written(sets.join(wide, "doc_id").select("doc_id", "part", F.col("n").alias("size"), F.explode("shingles").alias("key")), f"{work}/wide")
    often = written(own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{work}/often")
    # every row learns how many have its shingle; those that very many have, at most HOT_SHARE, are broadcast
    limit = max(HOT_LEAST, own.count() // HOT_SHARE)
    told = own.join(F.broadcast(often.where(F.col("n") >= limit)), "key", "left")
    # what is known by now looks up a number of its own, which spreads it; whatever it may find doesn't count
    asked = F.when(F.col("n").isNull(), F.col("key")).otherwise(F.xxhash64("doc_id", "key"))
    others = often.where(F.col("n") < limit).select(F.col("key").alias("asked"), F.col("n").alias("n2"))
    ranked = told.withColumn("asked", asked).join(others, "asked", "left").withColumn("n", F.coalesce("n", "n2", F.lit(1)))
    before = F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "key")) - 1
    kept = written(ranked.withColumn("before", before).where((F.col("before") <= F.col("size") - F.ceil(F.col("size") * percent / 100)) & (F.col("n") > 1)).select("key", "doc_id", "part", "size", "before"), f"{work}/rare")
    counts = written(kept.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key", "n"), f"{work}/held")
    return written(matched(kept, ["key"], counts, kept.count()).select("key", "doc_id", "part", F.col("size").alias("n"), "before", F.col("n").alias("held")), f"{work}/shared")


def rare_pairs(kept: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different parts that share a shingle of kept (key, doc_id, part, n); each shingle has few documents."""
    own_keys = kept.groupBy("doc_id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("key")).alias("keys"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def pair(key: int, rows: list[tuple]) -> list[tuple]:
        """rows: (doc_id, part, stray, n, keys); a pair is named in the first shingle that it shares."""
        out = []
        for a, part, _, n, keys in (r for r in rows if r[2]):
            for b, other, _, m, theirs in (r for r in rows if not r[2] and r[1] != part and min(r[3], n) * 100 >= max(r[3], n) * percent):
                if np.intersect1d(keys, theirs, assume_unique=True)[0] == key:
                    out.append((a, b))
        return out

    full = cells(kept.select("key", "doc_id", "part")).join(own_keys, "doc_id")
    return full.repartition(*CELL).sortWithinPartitions(*CELL).select(*CELL, "doc_id", "part", "stray", "n", "keys").mapInArrow(cell_by_cell(pair, ["doc_id", "part", "stray", "n"], ["keys"]), schema).distinct()


def cell_by_cell(settle: Callable[[int, list[tuple]], list[tuple]], plain: list[str], lists: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls settle(key, rows) with the rows of each cell, which follow each other; yields the pairs that it returns."""

    def batch_of(links: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            links = []
            columns = [batch.column(c) for c in lists]
            for at, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (*CELL, *plain)), strict=True)):
                if row[:3] != current:
                    links += settle(current[0], rows) if rows else []
                    current, rows = row[:3], []
                rows.append((*row[3:], *(c[at].values.to_numpy() for c in columns)))
            if links:
                yield batch_of(links)
        if rows and (links := settle(current[0], rows)):
            yield batch_of(links)

    return run


def linked_parts(strays: list[tuple], others: list[tuple], percent: int, may: Callable[[int, np.ndarray, int], np.ndarray]) -> list[tuple]:
    """Links between strays and others, each (doc_id, part, shingles), that join different parts; at most one for each pair of parts.
    may(k, sizes, n): which of the others stray k, with n shingles, is to be compared with."""
    parent = {r[1]: r[1] for r in [*strays, *others]}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size, links = np.array([len(r[2]) for r in others]), []
    for k, (doc, part, shingles) in enumerate(strays):
        near = np.minimum(size, len(shingles)) * 100 >= np.maximum(size, len(shingles)) * percent
        chosen = [j for j in np.flatnonzero(near & may(k, size, len(shingles))) if root(others[j][1]) != root(part)]
        if not chosen:
            continue
        ends = np.cumsum([0, *(size[j] for j in chosen)])
        hits = np.concatenate([[0], np.cumsum(np.isin(np.concatenate([others[j][2] for j in chosen]), shingles))])
        both = hits[ends[1:]] - hits[ends[:-1]]
        for j, n in zip(chosen, both.tolist(), strict=True):
            if n * 100 >= (int(size[j]) + len(shingles) - n) * percent and (x := root(part)) != (y := root(others[j][1])):
                parent[x] = y
                links.append((doc, others[j][0]))
    return links


def stray_links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what is still apart in the buckets of placed (key, doc_id, part): at most one for each pair of
    parts in a block comparison."""
    full = cells(placed).join(sets, "doc_id")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def settle(key: int, rows: list[tuple]) -> list[tuple]:
        """rows: (doc_id, part, stray, shingles, keys)"""
        strays, others = [r for r in rows if r[2]], [r for r in rows if not r[2]]
        if not strays or not others:
            return []
        keys = np.stack([r[4] for r in others])
        # a pair is compared in the first band that it shares
        first = lambda k, size, n: strays[k][4][(keys == strays[k][4]).argmax(axis=1)] == key
        return linked_parts([(r[0], r[1], r[3]) for r in strays], [(r[0], r[1], r[3]) for r in others], percent, first)

    return full.repartition(*CELL).sortWithinPartitions(*CELL).select(*CELL, "doc_id", "part", "stray", "shingles", "keys").mapInArrow(cell_by_cell(settle, ["doc_id", "part", "stray"], ["shingles", "keys"]), schema)


def reaches(common: Column, apart: Column, percent: int) -> Column:
    """Whether sets with at most `common` shingles in common and `apart` or more in one of them only can have that similarity."""
    return common * (100 - percent) >= apart * percent


def family_cells(shared: DataFrame, percent: int, work: str) -> DataFrame:
    """(key, i, j, doc_id, part, stray, before): the block comparisons of the documents that have a shingle of shared (key, doc_id,
    part, n, before) in common. Each shingle has many documents.

    Where a shingle is the first, in the common order, that two documents share, what comes before it is in one of them only. So
    documents go into groups by how much comes before, and two groups meet only if what comes after may outweigh that: a template
    whose documents differ in just more than the threshold allows makes no comparison at all.
    """
    least = shared.groupBy("key").agg(F.min("before").alias("least"))
    rest = F.col("n") - F.col("before")
    hot = written(shared.join(least, "key").where(reaches(rest, F.col("before") + F.col("least"), percent)).select("key", "doc_id", "part", "n", "before"), f"{work}/hot")
    # as in cells(): what is outside a shingle's largest part meets all
    parts = hot.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    told = written(hot.join(parts, "key").withColumn("stray", F.col("part") != F.col("main")).drop("main", "parts"), f"{work}/told")

    def groups(rows: DataFrame, k: int) -> DataFrame:
        return rows.groupBy("key", F.col("before").alias(f"before{k}")).agg(F.max(rest).alias(f"rest{k}"), F.ceil(F.count("*") / STRAY_BLOCK).cast("int").alias(f"slots{k}"), F.min("part").alias(f"low{k}"), F.max("part").alias(f"high{k}"))

    one_part = (F.col("low1") == F.col("high1")) & (F.col("low1") == F.col("low2")) & (F.col("low2") == F.col("high2"))
    # a document's groups are as many as its rarest shingles at most
    meet = groups(told.where("stray"), 1).join(groups(told, 2), "key").where(reaches(F.least("rest1", "rest2"), F.col("before1") + F.col("before2"), percent) & ~one_part)
    meet = written(meet.select("key", "before1", "before2", "slots1", "slots2"), f"{work}/meet")
    slot = lambda n: F.pmod(F.xxhash64("doc_id"), n)
    cell = lambda before, own: (F.col(before).cast("long") * (1 << 32) + own).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    firsts = told.where("stray").join(meet.withColumnRenamed("before1", "before"), ["key", "before"]).withColumn("other", every("slots2"))
    firsts = firsts.select("key", cell("before", slot(F.col("slots1"))).alias("i"), cell("before2", F.col("other")).alias("j"), "doc_id", "part", F.lit(True).alias("stray"), "before")
    seconds = told.join(meet.withColumnRenamed("before2", "before"), ["key", "before"]).withColumn("other", every("slots1"))
    seconds = seconds.select("key", cell("before1", F.col("other")).alias("i"), cell("before", slot(F.col("slots2"))).alias("j"), "doc_id", "part", F.lit(False).alias("stray"), "before")
    return firsts.unionByName(seconds)


def family_links(shared: DataFrame, sets: DataFrame, percent: int, work: str) -> DataFrame:
    """Links (a, b) of family_cells, at most one for each pair of parts in a block comparison."""
    full = family_cells(shared, percent, work).join(sets.select("doc_id", "shingles"), "doc_id")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def settle(key: int, rows: list[tuple]) -> list[tuple]:
        """rows: (doc_id, part, stray, before, shingles)"""
        firsts, seconds = [r for r in rows if r[2]], [r for r in rows if not r[2]]
        ahead = np.array([r[3] for r in seconds])

        def may(k: int, size: np.ndarray, n: int) -> np.ndarray:
            return np.minimum(size - ahead, n - firsts[k][3]) * (100 - percent) >= (ahead + firsts[k][3]) * percent

        return linked_parts([(r[0], r[1], r[4]) for r in firsts], [(r[0], r[1], r[4]) for r in seconds], percent, may) if firsts and seconds else []

    return full.repartition(*CELL).sortWithinPartitions(*CELL).select(*CELL, "doc_id", "part", "stray", "before", "shingles").mapInArrow(cell_by_cell(settle, ["doc_id", "part", "stray", "before"], ["shingles"]), schema)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 24, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Documents link when their shingle sets have 100 * intersection >= percent * union. With 24 bands of 5 rows a pair at
    similarity 0.8 is missed with a chance of 1 in 14,000, one at 0.9 practically never.
    """
    spark = docs.sparkSession
    work = shared_dir(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs, words, bands, rows), f"{work}/signed")
    linkable = signed.where("doc_id is not null and n_shingles > 0")
    classes = written(linkable.groupBy("digest").agg(F.min("doc_id").alias("class")), f"{work}/classes")
    # a class's row of band keys: that of its smallest document
    chosen = linkable.join(classes, (linkable.digest == classes.digest) & (linkable.doc_id == F.col("class")), "left_semi").dropDuplicates(["doc_id", "digest"])
    every = written(chosen.select("doc_id", F.explode("keys").alias("key")), f"{work}/keys")
    firsts = written(every.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1"), f"{work}/firsts")
    members = written(matched(every, ["key"], firsts, every.count()), f"{work}/members")
    stars = members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    wanted = written(members.select("doc_id").distinct(), f"{work}/wanted")
    sets = written(full_sets(among(docs, "doc_id", wanted).select("doc_id", "text"), words, bands, rows), f"{work}/sets")
    copies = linkable.join(classes, "digest").where("doc_id <> class").select(F.col("class").alias("a"), F.col("doc_id").alias("b")).distinct()
    found = written(confirmed(stars, sets, percent), f"{work}/stars")
    # what its bucket's largest component leaves out is compared with all of the bucket
    labels = components(found, f"{work}/parts").withColumnRenamed("node", "doc_id")
    placed = members.where("n > 2").select("key", "doc_id", "n").join(labels, "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("part"))
    placed = written(placed, f"{work}/placed")
    small, large = placed.where(F.col("n") <= STRAY_BLOCK).drop("n"), placed.where(F.col("n") > STRAY_BLOCK)
    found = found.union(written(stray_links(small, sets, percent), f"{work}/strays"))
    apart = large.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    wide = written(large.join(apart, "key", "left_semi").select("doc_id", "part").distinct(), f"{work}/apart")
    if wide.limit(1).count():
        shared = rarest(wide, sets.drop("keys"), percent, work)
        named = written(rare_pairs(shared.where(F.col("held") <= RARE), percent), f"{work}/rare_pairs")
        found = found.union(written(confirmed(named, sets, percent), f"{work}/rare_links"))
        found = found.union(written(family_links(shared.where(F.col("held") > RARE), sets, percent, work), f"{work}/family_links"))
    links = found.union(copies)
    labels = components(links, f"{work}/last")
    # what is returned reads the signatures and the components only
    remove(spark, *(f"{work}/{t}" for t in ("classes", "keys", "firsts", "members", "wanted", "sets", "stars", "parts", "placed", "strays", "apart", "wide", "often", "rare", "held", "shared", "hot", "told", "meet", "rare_pairs", "rare_links", "family_links")))
    out = signed.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
