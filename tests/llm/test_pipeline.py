import importlib.util

import pytest
from pyspark.sql import functions as F

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")


def test_stages_on_the_corpus(spark):
    import brute

    import corpus_pipeline as p

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in p.STAGES[:-1]:
        before = docs.collect()
        docs = p.written(stage(spark, docs, sf_dir), f"{p.shared_dir(spark)}/x")
        assert docs.columns == columns
        kept.append((before, docs.collect()))
    (raw, lang), (_, good), (pool, unique), (_, lines) = kept
    told = {r.doc_id for r in raw if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in lang} <= told and len(lang) > 0.98 * len(told)
    assert 0 < len(good) < len(lang)
    want = brute.near_duplicates([(r.doc_id, r.text) for r in pool], 5, 80)
    assert {r.doc_id for r in unique} == {i for i, (_, _, keep) in want.items() if keep}
    want = brute.without_repeats([(r.doc_id, r.text) for r in unique], 160)
    assert {r.doc_id: r.text for r in lines} == {i: text for i, (text, _, _) in want.items()} and all(r.n_chars == len(r.text) for r in lines)
    packed = p.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in lines}
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 4096 for r in full)


def test_edges(spark):
    import corpus_pipeline as p

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "No id here but words.", "en", None, 3), (3, "the word " * 30_000, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = docs.withColumns({c: F.lit(1) for c in ("record", "row", "found", "score", "place", "component", "units", "piece", "length", "maybe", "word")})
    for frame in (docs, docs.limit(0), clashing):
        for name, stage in p.STAGES:
            out = stage(spark, frame, "/root/testdata/sf0.001")
            out.collect()
            assert name == "packing" or out.columns == frame.columns


def test_near_duplicates_with_repeated_and_null_ids(spark):
    import corpus_pipeline as p

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(7, c), (5, a), (5, b), (7, c), (3, a), (None, d), (None, d), (None, c), (9, None), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = p.near_duplicate_stage(spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns
    want = [(3, a), (5, b), (7, c), (None, d), (9, None), (9, None), (None, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_languages_never_learnt_are_rejected(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = ["Za\u017c\u00f3\u0142\u0107 g\u0119\u015bl\u0105 ja\u017a\u0144 i inne polskie s\u0142owa, kt\u00f3re s\u0105 tutaj napisane dla pr\u00f3by.", "Привет, это русский текст о погоде и жизни в городе.", "これは日本語の文章です。"]
    more = spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(foreign)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in p.language_stage(spark, docs.select(*more.columns).unionByName(more), "").select("doc_id").collect()}
    assert not any(i >= 10**6 for i in kept) and len(kept) > 0.99 * docs.count()
