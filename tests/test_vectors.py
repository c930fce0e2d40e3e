import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.catalog import Catalog
from corvid.operators import search, vectors
from corvid.session import shared_folder


def folder(spark):
    return f"{shared_folder(spark)}/tests/{uuid.uuid4().hex}"


def clustered(n, offset, seed):
    """Vectors in groups of very different sizes, around a common mean of length offset."""
    random = np.random.default_rng(seed)
    centres = random.standard_normal((n // 40, 64))
    own = centres[(random.random(n) ** 2 * len(centres)).astype(int)] + 0.35 * random.standard_normal((n, 64))
    mean = random.standard_normal(64)
    return np.float32(own + offset * mean / np.linalg.norm(mean) * 8)


def frame(spark, x, start=0):
    return spark.createDataFrame([(f"c{start + k}", f"u{(start + k) % 97}", "docs://a", "body", [float(v) for v in row]) for k, row in enumerate(x)], "chunk_id string, object_uri string, connector_uri string, chunk_kind string, dense_vec array<float>")


@pytest.mark.parametrize(("n", "offset"), [(3000, 0.0), (12_000, 0.0), (6000, 1.0)])
def test_recall_and_share_of_lists(spark, n, offset):
    x = clustered(n, offset, n)
    own = vectors.VectorIndex(spark, folder(spark))
    own.add(frame(spark, x))
    u = vectors.unit(x.astype(np.float64))
    found, read = 0, 0
    for i in range(5, n, n // 8):
        hits, lists, every = own.reading([float(v) for v in x[i]])
        got = [(r.chunk_id, r.score) for r in hits.collect()]
        cosine = u @ u[i]
        true = {f"c{k}" for k in np.argsort(-cosine)[:10]}
        found += len(true & {c for c, _ in got})
        read += lists / every
        assert all(abs(s - cosine[int(c[1:])]) < 1e-5 for c, s in got) and [s for _, s in got] == sorted((s for _, s in got), reverse=True)
    assert found >= 0.95 * 80 and read / 8 < 0.25


def test_segments_filters_and_odd_vectors(spark):
    x = clustered(2000, 0.0, 3)
    own, rows = vectors.VectorIndex(spark, folder(spark)), frame(spark, x)
    odd = spark.createDataFrame([("n", None), ("e", []), ("z", [0.0] * 64), ("s", [1.0]), ("i", [float("inf")] * 64), ("m", [None] * 64)], "chunk_id string, dense_vec array<float>")
    own.add(rows.unionByName(odd, allowMissingColumns=True))
    query = [float(v) for v in x[10]]
    assert own.top(query, 5).first().chunk_id == "c10"
    # object u10 and others are replaced by vectors elsewhere
    gone = rows.where("object_uri in ('u10', 'u11')")
    own.add(gone.withColumn("dense_vec", F.transform("dense_vec", lambda v: -v)), gone)
    living = rows.where("object_uri not in ('u10', 'u11')")
    exact = search.dense(living, query, 5, "chunk_id", "dense_vec")
    assert [r.chunk_id for r in own.top(query, 5).collect()] == [r.chunk_id for r in exact.collect()]
    assert own.top([-v for v in query], 1).first().chunk_id == "c10"
    one = search.in_scope("docs://a", "u20")
    assert {r.object_uri for r in own.top(query, 8, one).collect()} == {"u20"} and own.top(query, 8, one).count() == 8
    with pytest.raises(Exception, match="dimension_mismatch"):
        own.top([1.0, 2.0])
    assert vectors.VectorIndex(spark, folder(spark)).top(query).collect() == []


def test_catalog_with_a_vector_index(spark):
    own = Catalog(spark, folder(spark), buckets=4, vectors=True)
    texts = [("docs://a/x.md", "alpha beta gamma"), ("docs://a/y.md", "delta epsilon"), ("docs://a/z.md", "zeta eta theta")]
    listing = lambda rows: spark.createDataFrame(rows, "object_uri string, content string")
    own.add("docs://a", listing(texts))
    own.add("docs://a", listing([("docs://a/x.md", "iota kappa"), *texts[1:]]))
    engine = own.engine(["docs://a"])
    assert engine.search("iota kappa", mode="semantic", top_k=1).first().source == "docs://a/x.md"
    assert engine.search("delta", mode="hybrid", top_k=1).first().source == "docs://a/y.md"
    assert own.ledger.state().keys() == {"cache", "chunks", "objects", "postings", "vectors"}
