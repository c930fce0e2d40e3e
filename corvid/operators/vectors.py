"""A vector index on disk: inverted lists under trained centroids, product-quantised residuals, exact rerank.

Vectors are compared at unit length, so the dot product is the cosine. A sample trains the centroids, the codes of what is left after
the nearest centroid is taken away, and how many lists a query must read: as many as it takes to find WANTED of the true
neighbours of held-out vectors. A query scores the codes of these lists with a table of partial products, and computes the cosine of
the best candidates from their vectors. Lists are folders, cut further where they are long, with rows sorted by key; a query opens the
folders of its lists, the codes of all their rows and the vectors of its candidates. The index grows by segments, as the postings do.

A null, empty, zero or non-finite vector, or one of another length than the first ones, is in no list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.operators import search
from corvid.operators.ledger import Ledger, Transaction, once

#: Vectors that train (about; twice as many at most), most lists, dimensions of a code's byte, codewords of each, rounds of training.
SAMPLE, MOST_LISTS, WIDTH, WORDS, ROUNDS = 50_000, 4096, 4, 256, 12
#: What share of ten true neighbours must be found on held-out vectors; candidates by code for each hit; rows of a file, about.
WANTED, CANDIDATES, FILE_ROWS = 0.98, 20, 500_000
KEYS = ("object_uri", "connector_uri", "chunk_kind")


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(rows[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, max(len(rows), 1), 4096)])


def k_means(rows: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres by Lloyd's rounds; a centre without rows moves to one that is far from its own."""
    random = np.random.default_rng(seed)
    centres = rows[random.choice(len(rows), k, replace=len(rows) < k)]
    for _ in range(rounds):
        own = nearest(rows, centres)
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        moved = sums / np.maximum(count, 1)[:, None]
        if (empty := np.flatnonzero(count == 0)).size:
            far = np.argsort(((rows - centres[own]) ** 2).sum(axis=1))[::-1]
            moved[empty] = rows[far[np.arange(empty.size) % len(rows)]]
        centres = moved
    return centres


class Quantiser:
    """Centroids, codewords of each part of a residual, and how many lists a query reads."""

    def __init__(self, centres: np.ndarray, words: np.ndarray, probes: int):
        self.centres, self.words, self.probes = centres, words, probes  # (lists, dims), (parts, words, width)

    @classmethod
    def trained(cls, sample: np.ndarray, rows: int, seed: int = 5) -> Quantiser:
        lists = int(min(MOST_LISTS, max(1, round(4 * math.sqrt(rows))), max(1, len(sample) // 8)))
        held = np.arange(len(sample)) % 20 == 7
        fit = sample[~held] if held.any() else sample
        centres = k_means(fit, lists, ROUNDS, seed)
        left = cls._parts(fit - centres[nearest(fit, centres)])
        words = np.stack([k_means(left[:, p], min(WORDS, len(fit)), ROUNDS, seed + p) for p in range(left.shape[1])])
        own = cls(centres, words, lists)
        asked = sample[held][:200]
        if len(asked):
            place = nearest(sample, centres)
            true = np.argsort(-(asked @ sample.T), axis=1)[:, :10]
            order = np.argsort(-(asked @ centres.T), axis=1)
            rank = np.argsort(order, axis=1)
            need = np.sort(rank[np.arange(len(asked))[:, None], place[true]].ravel()) + 1
            own.probes = int(min(lists, need[min(len(need) - 1, math.ceil(WANTED * len(need)) - 1)] + 1))
        return own

    @staticmethod
    def _parts(rows: np.ndarray) -> np.ndarray:
        parts = -(-rows.shape[1] // WIDTH)
        padded = np.zeros((len(rows), parts * WIDTH))
        padded[:, : rows.shape[1]] = rows
        return padded.reshape(len(rows), parts, WIDTH)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of unit vectors."""
        place = nearest(rows, self.centres)
        left = self._parts(rows - self.centres[place])
        return place, np.stack([nearest(left[:, p], self.words[p]) for p in range(left.shape[1])], axis=1).astype(np.uint8)

    def lost(self, rows: np.ndarray, place: np.ndarray, code: np.ndarray) -> np.ndarray:
        """How far each unit vector is from what its list and code tell: no cosine is wrong by more."""
        told = self.words[np.arange(code.shape[1]), code]
        return np.sqrt(((self._parts(rows - self.centres[place]) - told) ** 2).sum(axis=(1, 2)))

    def tables(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The query's products with every centroid, and with every codeword of each part."""
        return self.centres @ query, np.einsum("pwd,pd->pw", self.words, self._parts(query[None])[0])


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str, ledger: Ledger | None = None, name: str = "vectors", key: str = "chunk_id", key_type: str = "string"):
        self.spark, self.name, self.key = spark, name, key
        self.ledger = ledger or Ledger(spark, root)
        self.root = f"{self.ledger.root}/{name}"
        self.schema = f"{key} {key_type}, object_uri string, connector_uri string, chunk_kind string, code binary, lost float, vector array<float>"
        self._known: tuple[str, Quantiser] | None = None

    def state(self, tx: Transaction | None = None) -> dict:
        return (tx.state if tx is not None else self.ledger.state()).get(self.name) or {"segments": [], "next": 1, "model": None, "rows": 0}

    # training and writing

    def _quantiser(self, state: dict) -> Quantiser:
        if self._known is None or self._known[0] != state["model"]:
            rows = self.spark.read.parquet(f"{self.root}/{state['model']}").collect()  # MOST_LISTS centroids and WORDS codewords a part at most
            part = lambda k: np.array([r["vector"] for r in sorted((r for r in rows if r["kind"] == k), key=lambda r: r["n"])])
            parts = 1 + max(r["kind"] for r in rows) - 2
            self._known = state["model"], Quantiser(part(1), np.stack([part(2 + p) for p in range(parts)]), next(r["n"] for r in rows if r["kind"] == 0))
        return self._known[1]

    def _train(self, vectors: DataFrame, tx: Transaction, state: dict) -> None:
        n = vectors.count()
        share = min(1.0, SAMPLE / max(n, 1))
        marked = vectors.withColumn("_mark", F.xxhash64(F.lit(11), self.key)).where(F.pmod("_mark", F.lit(1_000_003)) < int(share * 1_000_003) + 1)
        found = [r["vector"] for r in marked.orderBy("_mark").limit(2 * SAMPLE).select("vector").collect()]
        rows = [v for v in found if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
        dims = max({len(v) for v in rows}, key=[len(v) for v in rows].count, default=1)
        sample = unit(np.array([v for v in rows if len(v) == dims], np.float64)) if rows else np.ones((1, 1))
        q = Quantiser.trained(sample, n)
        table = [(0, q.probes, []), *((1, k, v.tolist()) for k, v in enumerate(q.centres)), *((2 + p, k, v.tolist()) for p, words in enumerate(q.words) for k, v in enumerate(words))]
        state["model"] = tx.folder()
        self.spark.createDataFrame(table, "kind int, n int, vector array<double>").coalesce(1).write.parquet(f"{self.root}/{state['model']}")

    def add(self, vectors: DataFrame, removed: DataFrame | None = None, tx: Transaction | None = None, vector_col: str = "dense_vec", retrain: bool = False) -> int | None:
        """Indexes vectors (key, KEYS where there are, vector_col) as a new segment; all earlier vectors of the objects in removed
        (object_uri) count no more. The first vectors train the index; retrain trains it anew, on these and for these only."""
        return once(self.ledger, tx, lambda own: self._add(vectors, removed, own, vector_col, retrain))

    def _add(self, vectors: DataFrame, removed: DataFrame | None, tx: Transaction, vector_col: str, retrain: bool) -> None:
        state = dict(self.state(tx))
        columns = [F.col(c) if c in vectors.columns else F.lit(None).cast("string").alias(c) for c in KEYS]
        rows = vectors.select(self.key, *columns, F.col(vector_col).cast("array<float>").alias("vector")).where("vector is not null")
        if state["model"] is None or retrain:
            self._train(rows, tx, state)
            state["segments"] = [] if retrain else state["segments"]
        q = self._quantiser(state)
        dims = q.centres.shape[1]
        coded = T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("lost", T.FloatType()), T.StructField("list", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(len(KEYS) + 1)
                good = [i for i, v in enumerate(lists) if len(v.values) == dims and not v.values.null_count]
                raw = np.array([lists[i].values.to_numpy() for i in good], np.float64).reshape(-1, dims)
                fine = np.isfinite(raw).all(axis=1) & (raw != 0).any(axis=1)
                kept = batch.take(pa.array(np.array(good, np.int64)[fine]))
                if kept.num_rows:
                    place, code = q.encode(units := unit(raw[fine]))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(q.lost(units, place, code).astype(np.float32)), pa.array(place.astype(np.int32))], names=coded.names)

        folder = tx.folder()
        placed = rows.mapInArrow(run, coded)
        n = rows.count()
        shares = max(1, math.ceil(n / len(q.centres) / FILE_ROWS))
        dealt = placed.repartition("list", F.pmod(F.xxhash64(self.key), F.lit(shares))).sortWithinPartitions("list", self.key)
        dealt.select(self.key, *KEYS, "code", "lost", "vector", "list").write.partitionBy("list").parquet(f"{self.root}/{folder}/lists")
        entry = {"number": state["next"], "folder": folder, "rows": n, "held": sorted(int(x[5:]) for x in self.ledger.names(f"{self.name}/{folder}/lists") if x.startswith("list=")), "gone": removed is not None}
        if removed is not None:
            removed.select("object_uri").distinct().write.parquet(f"{self.root}/{folder}/gone")
        tx.state[self.name] = {**state, "segments": [*state["segments"], entry], "next": state["next"] + 1, "rows": state["rows"] + n}

    # searching

    def _lists(self, state: dict, wanted: set[int]) -> DataFrame:
        out = None
        for s in state["segments"]:
            if held := sorted(wanted & set(s["held"])):
                own = self.spark.read.schema(f"{self.schema}, list int").option("basePath", f"{self.root}/{s['folder']}/lists").parquet(*[f"{self.root}/{s['folder']}/lists/list={k}" for k in held]).withColumn("seg", F.lit(s["number"]))
                out = own if out is None else out.unionByName(own)
        return out if out is not None else self.spark.createDataFrame([], f"{self.schema}, list int, seg int")

    def _living(self, rows: DataFrame, state: dict) -> DataFrame:
        gone = None
        for s in state["segments"]:
            if s["gone"]:
                own = self.spark.read.schema("object_uri string").parquet(f"{self.root}/{s['folder']}/gone").withColumn("until", F.lit(s["number"]))
                gone = own if gone is None else gone.unionByName(own)
        if gone is None:
            return rows
        last = gone.groupBy("object_uri").agg(F.max("until").alias("until"))
        return rows.join(last, "object_uri", "left").where(F.col("seg") >= F.coalesce("until", F.lit(0))).drop("until")

    def top(self, query: list[float], top_k: int = 10, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """(key, object_uri, score): nearly always the top_k of highest cosine; scores are exact. Where a filter leaves too few in
        the lists that are read, more lists are."""
        return self.reading(query, top_k, where, probes)[0]

    def exact(self, query: list[float], top_k: int = 10, where: Column | None = None) -> DataFrame:
        """(key, object_uri, score): the top_k of highest cosine, as of a scan. Codes tell each vector's cosine but for what they
        lost; every vector that may reach the worst hit of top by that is compared."""
        found = self.top(query, top_k, where).collect()  # top_k rows
        state = self.state()
        if not found:
            return self.spark.createDataFrame([], f"{self.schema.split(',')[0]}, object_uri string, score double")
        # scores are rounded to six places, and what codes lost is kept as a float
        worst = found[-1]["score"] - 1e-5 if len(found) >= top_k else -math.inf
        q, every = self._quantiser(state), {k for s in state["segments"] for k in s["held"]}
        of_list, of_word = q.tables(unit(np.array(query, np.float64)[None])[0])
        parts = np.arange(len(of_word))
        rows = self._living(self._lists(state, every), state)
        rows = (rows if where is None else rows.where(where)).select("list", "code", "lost", self.key, "object_uri", "vector")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    most = of_list[batch.column(0).to_numpy()] + of_word[parts, code].sum(axis=1) + batch.column(2).to_numpy()
                    near = batch.filter(pa.array(most >= worst))
                    yield pa.RecordBatch.from_arrays(near.columns[3:], names=near.schema.names[3:])

        able = rows.mapInArrow(run, T.StructType(rows.schema.fields[3:]))
        return search.dense(able, query, top_k, self.key, "vector", ("object_uri",)).select(self.key, "object_uri", "score")

    def reading(self, query: list[float], top_k: int = 10, where: Column | None = None, probes: int | None = None) -> tuple[DataFrame, int, int]:
        """(hits, lists that were read, all lists)."""
        state = self.state()
        result = f"{self.schema.split(',')[0]}, object_uri string, score double"
        if state["model"] is None or not any(query):
            return self.spark.createDataFrame([], result), 0, 0
        q = self._quantiser(state)
        if len(query) != q.centres.shape[1]:
            search.wrong_dimensions(len(query), q.centres.shape[1])
        own = unit(np.array(query, np.float64)[None])[0]
        of_list, of_word = q.tables(own)
        order = np.argsort(-of_list)
        wanted, every, parts = probes or q.probes, len(order), np.arange(len(of_word))
        scored = T.StructType([T.StructField("place", T.LongType()), T.StructField("list", T.IntegerType()), T.StructField(self.key, self.spark.createDataFrame([], self.schema).schema[self.key].dataType), T.StructField("near", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    near = of_list[batch.column(0).to_numpy()] + of_word[parts, code].sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(0), batch.column(2), pa.array(near)], names=scored.names)

        while True:
            chosen = {int(k) for k in order[:wanted]}
            rows = self._living(self._lists(state, chosen), state)
            rows = rows if where is None else rows.where(where)
            best = rows.select("list", "code", self.key).mapInArrow(run, scored).orderBy(F.desc("near"), self.key).limit(top_k * CANDIDATES).collect()  # so many rows
            if len(best) >= top_k or wanted >= every:
                break
            wanted = min(every, wanted * 4)
        keys = [r[self.key] for r in best]
        again = self._living(self._lists(state, {r["list"] for r in best}), state).where(F.col(self.key).isin(keys))
        again = again if where is None else again.where(where)
        return search.dense(again, query, top_k, self.key, "vector", ("object_uri",)).select(self.key, "object_uri", "score"), min(wanted, every), every
