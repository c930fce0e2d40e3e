"""Cases that a reviewer found at larger sizes, made small."""

import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from test_catalog import folder
from test_oracle import SF, TABLES, plain

from corvid.catalog import Catalog
from corvid.operators import index, postings, search
from corvid.operators.postings import Postings
from corvid.operators.vectors import VectorIndex
from corvid.plans import registry

CHUNK = "chunk_id string, object_uri string, connector_uri string, chunk_kind string, content string"


def compared(spark, path, name):
    """(rows of a query, rows of its counterpart) over a data folder."""
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(path))
    columns = sorted(df.columns)
    want = duck.sql(registry.ORACLE[name])
    order = [want.columns.index(c) for c in columns]
    return Counter(tuple(map(plain, r)) for r in df.select(*columns).collect()), Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def grown(tmp_path, name, select):
    """The smallest tables, one of them by a SELECT over itself (as t)."""
    for t in TABLES:
        if t != name:
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    duckdb.sql(f"COPY (WITH t AS (SELECT * FROM '{SF}/{name}.parquet') {select}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return tmp_path


def test_terms_whose_counts_cancel_out_are_found_in_an_index_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(postings, "BUCKET_POSTINGS", 10)
    rows = spark.createDataFrame([(f"c{i}", f"u{i}", "docs://a", "body", f"alpha beta gamma delta epsilon w{i}") for i in range(20)], CHUNK)
    outdated = rows.withColumn("content", F.concat(F.lit("alpha "), "content"))
    own = Postings(spark, folder(spark))
    own.add(outdated)
    own.add(rows, outdated)
    for word in ("alpha", "beta", "gamma", "delta", "epsilon", "w7"):
        assert own.bm25(word, None, 30).collect() == search.bm25(rows, word, None, 30).collect()


def test_pages_that_share_a_url_are_asked_for_one_by_one(spark, tmp_path):
    path = grown(tmp_path, "pages", "SELECT * FROM t UNION ALL SELECT page_id + 100001, url, html FROM t")
    got, want = compared(spark, path, "web_conditional")
    assert got == want


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_segment_is_shuffled_once_and_as_blocks(spark):
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(300)).cast("string"))
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), word), " ")
    rows = spark.range(4000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("u"), "id").alias("object_uri"), F.lit("docs://a").alias("connector_uri"), F.lit("body").alias("chunk_kind"), content.alias("content"))
    rows.write.parquet(at := f"{folder(spark)}/rows")
    rows = spark.read.parquet(at)
    letters = rows.agg(F.sum(F.length("content"))).first()[0]
    before = shuffled(spark)
    own = Postings(spark, folder(spark))
    own.add(rows)
    assert shuffled(spark) - before < 1.5 * letters
    own.compact()
    assert own.bm25("w7 w8", None, 20).collect() == search.bm25(rows, "w7 w8", None, 20).collect()


def test_a_first_sync_shuffles_each_text_for_its_vectors_only(spark):
    marks = lambda k: F.translate(F.sha2(F.concat_ws("/", "id", k.cast("string")), 256), "0123456789abcdef", "!#$%&()*+,-./:;<")  # noqa: E731  # no words
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), marks), " ")
    spark.range(600).select(F.concat(F.lit("docs://a/"), "id", F.lit(".md")).alias("object_uri"), content.alias("content")).write.parquet(at := f"{folder(spark)}/rows")
    rows = spark.read.parquet(at)
    letters = rows.agg(F.sum(F.length("content"))).first()[0]
    before = shuffled(spark)
    own = Catalog(spark, folder(spark), buckets=4)
    own.add("docs://a", rows)
    assert shuffled(spark) - before < 3 * letters
    assert own.objects.read().where("search_status = 'indexed'").count() == 600 and own.ledger.names("work") == []


def test_new_rows_are_laid_beside_a_bucket_until_it_has_many_folders(spark, monkeypatch):
    monkeypatch.setattr(index, "MOST_FOLDERS", 2)
    own = index.Snapshots(spark, folder(spark), spark.createDataFrame([], "object_uri string, n int").schema, buckets=1)
    one = lambda *rows: spark.createDataFrame(rows, own.schema)
    keys = lambda *names: spark.createDataFrame([(n,) for n in names], "object_uri string")
    folders = []
    for gone, new in ((None, one(("a", 1), ("b", 2))), (keys("z"), one(("c", 3))), (None, one(("d", 4))), (None, one(("e", 5))), (keys("a", "d"), one(("d", 6)))):
        tx = own.ledger.begin()
        assert sorted(tuple(r) for r in own.replace(gone, new, tx).collect()) == sorted(tuple(r) for r in new.collect())
        tx.commit()
        folders.append(len(own.folders()[0]))
    assert folders == [1, 2, 2, 2, 2]
    assert sorted(tuple(r) for r in own.read().collect()) == [("b", 2), ("c", 3), ("d", 6), ("e", 5)]


def test_postings_are_shuffled_as_bytes_of_the_width_they_need(spark):
    rng = np.random.default_rng(5)
    row, doc = np.repeat(np.arange(40), 25), np.tile(np.arange(1000, 1025), 40)
    for ranges, tf, length in ((doc // 8, 3, 70), (doc // 8, 300, 70), (doc // 8, 3, 70_000), (np.full(1000, -2), 3, 70)):
        tfs, lens = rng.integers(1, tf + 1, 1000), rng.integers(1, length + 1, 1000)
        moved = postings._blocks(pa.array([f"w{i}" for i in range(40)]), row, ranges, doc, tfs, lens, 8)
        (made,) = postings._unpacked(8, 50.0)(iter([moved.slice(3)]))
        told = [(t, r, d, f, n) for b in made.to_pylist() for t, r in [(b["term"], b["range"])] for d, f, n in zip(b["docs"], b["tfs"], b["lens"], strict=True)]
        want = [(f"w{w}", r, d, f, n) for w, r, d, f, n in zip(row.tolist(), ranges.tolist(), doc.tolist(), tfs.tolist(), lens.tolist(), strict=True)]
        assert told == want[len(want) - len(told):] and made.num_rows == moved.num_rows - 3
        assert all((b["n"], b["cf"], b["max_tf"], b["min_len"]) == (len(b["docs"]), sum(b["tfs"]), max(b["tfs"]), min(b["lens"])) for b in made.to_pylist())
        sizes = [pc.sum(pc.binary_length(moved.column(c))).as_py() for c in (2, 3)]
        assert (sizes == [4000, 0]) == (tf < 256 and length < 1 << 16 and ranges[0] >= 0) and sizes[0] / 4 + sizes[1] / 16 == 1000


def test_a_text_is_embedded_in_batches_and_not_by_a_fold_for_each_dimension(spark):
    rows = spark.createDataFrame([("a", "Alpha beta, ALPHA"), ("b", ""), ("c", None), ("d", " ,.!")], "id string, content string")
    made = rows.select("id", index.hash_embedding(F.col("content"), 8).alias("v"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "sequence(" not in plan
    got = {r.id: r.v for r in made.collect()}
    want = np.zeros(8)
    for w in ("alpha", "beta", "alpha"):
        want[zlib.crc32(w.encode()) % 8] += 1
    assert got["a"] == (want / np.sqrt((want * want).sum())).astype(np.float32).tolist() and got["b"] == got["c"] == got["d"] == [0.0] * 8


def test_exact_hits_of_a_vector_index_are_those_of_a_scan_where_nearly_exact_ones_are_not(spark):
    x = np.random.default_rng(3).normal(size=(3000, 32)).astype(np.float32)
    x[2000:] = x[:1000]  # ties in score
    rows = spark.createDataFrame([(i, f"u{i}", v.tolist()) for i, v in enumerate(x)], "vec_id long, object_uri string, embedding array<float>")
    own, missed = VectorIndex(spark, folder(spark), key="vec_id", key_type="long"), 0
    own.add(rows, vector_col="embedding")
    nearly = own.top
    own.top = lambda query, k, where=None: nearly(query, k, where, probes=1)  # the first guess may be bad
    for q in (0, 1500, 2999):
        query = [float(v) for v in x[q]]
        scan = search.dense(rows, query).collect()
        missed += own.top(query, 10).select("vec_id", "score").collect() != scan
        assert own.exact(query).select("vec_id", "score").collect() == scan
    assert missed


def test_blocks_of_a_term_are_one_row_for_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(postings, "WHOLE", 0)
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(150)).cast("string"))
    content = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.pmod("id", F.lit(30)) + 5), word), " "), F.when(F.col("id") == 700, F.repeat(F.lit(" w3"), 300)).otherwise(""))
    spark.range(3000).coalesce(1).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("u"), "id").alias("object_uri"), F.lit("docs://a").alias("connector_uri"), F.lit("body").alias("chunk_kind"), content.alias("content")).write.parquet(at := f"{folder(spark)}/rows")
    rows = spark.read.parquet(at).coalesce(1)
    own = Postings(spark, folder(spark))

    def same(living):
        for query in ("w3 w7", "w149", "w3"):
            assert own.bm25(query, None, 15).collect() == search.bm25(living, query, None, 15).collect()
        tokens = living.select("chunk_id", F.explode(F.split("content", " ")).alias("term")).groupBy("term").agg(F.countDistinct("chunk_id").alias("df"), F.count("*").alias("cf"))
        assert {tuple(r) for r in own.vocabulary().collect()} == {tuple(r) for r in tokens.collect()}
        n = living.agg(F.count("*").alias("n"), F.avg(F.size(F.split("content", " "))).alias("avgdl")).first()
        assert tuple(own.stats().first()) == tuple(n)

    own.add(rows)
    stored = own._read(own.state(), "blocks", postings.BLOCKS)
    assert stored.count() == 2 * 150  # a pack, and what is left of the last range; 24 ranges have 3,600 blocks
    same(rows)
    gone = rows.where(F.col("object_uri").endswith("5"))
    own.add(rows.limit(0), gone)
    living = rows.where(~F.col("object_uri").endswith("5"))
    same(living)
    own.compact()
    same(living)
    assert own._read(own.state(), "blocks", postings.BLOCKS).count() <= 2 * 150


def test_rows_of_blocks_are_cut_into_the_same_blocks_and_bounds_hold():
    rng = np.random.default_rng(7)
    for ranges_of in (lambda d: d // 8, lambda d: np.full(len(d), -3)):
        for most_tf, most_len in ((3, 70), (300, 70), (3, 70_000)):
            doc = np.concatenate([np.sort(rng.choice(np.arange(500, 2500), 60, replace=False)) for _ in range(20)])
            row, tf, length = np.repeat(np.arange(20), 60), rng.integers(1, most_tf + 1, 1200), rng.integers(1, most_len + 1, 1200)
            blocks = postings._blocks(pa.array([f"w{i:02}" for i in range(20)]), row, ranges_of(doc), doc, tf, length, 8)
            rows = postings._rows(blocks, 8, 40.0)
            assert rows.num_rows < blocks.num_rows or ranges_of(doc)[0] < 0
            for begin in (0, 7):
                part = rows.slice(begin)
                stored = pa.RecordBatch.from_arrays([pa.array([1] * part.num_rows, pa.int32()), *(part.column(c) for c in ("term", "place", "heads", "narrow", "wide"))], names=["seg", "term", "pack", "heads", "narrow", "wide"])
                (got,) = postings._opened(8, 40.0)(iter([stored]))
                (want,) = postings._unpacked(8, 40.0)(iter([blocks.slice(blocks.num_rows - got.num_rows)]))
                assert got.drop_columns(["seg"]).to_pylist() == want.to_pylist()
                (heads,) = postings._headed(iter([stored.select(["seg", "term", "pack", "heads"])]))
                bound, impact = heads.column("impact").to_numpy(), got.column("impact").to_numpy()
                assert (bound >= impact).all() and (bound <= impact * 1.00001).all() and heads.column("range").equals(got.column("range"))
            assert pc.sum(rows.column("cf")).as_py() == tf.sum()
    assert postings._rows(blocks.slice(0, 0), 8, 40.0).num_rows == 0
