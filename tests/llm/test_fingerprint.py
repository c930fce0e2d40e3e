import hashlib

import xxhash

from corvid.llm import fingerprint
from corvid.llm.fingerprint import canonical, fingerprints

SCHEMA = "doc_id long, text string, n_chars string, fingerprint int, key int, part int"


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "", 0, 0, 0) for i, t in rows], SCHEMA)
    return fingerprints(df, **more).collect()


def brute(rows):
    tie = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    order = sorted(((-(2**63) if i is None else i, t or "") for i, t in rows), key=lambda r: (-r[0], tie(r[1]), r[1].encode()))
    out = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        mark = lambda x: xxhash.xxh3_128_hexdigest(canonical(x))
        out.append((None if i == -(2**63) else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), mark(t), mark(edited), float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(following))))
    return sorted(out, key=str)


def test_whole_table_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, run(spark, rows)), key=str) == brute(rows)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 2)
    rows = [(5, None), (4, ""), (3, "ﬁne  É\n"), (3, "fine É"), (9, "FINE é"), (None, "abc def"), (7, "𝔘x" * 100_000), (8, "a" * 10), (8, "a" * 10), (2, "x")]
    got = run(spark, rows)
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert len({r.fingerprint for r in got if r.doc_id in (3, 9)}) == 1
    assert sorted(map(tuple, run(spark, rows[:1])), key=str) == brute(rows[:1])
    assert run(spark, []) == []


def test_equal_digests_of_different_texts_are_told_apart(spark):
    rows = [(i, t) for i, t in enumerate(["one", "One ", "two", "three", "three"])]
    got = {r.doc_id: r.fingerprint for r in run(spark, rows, hashed=lambda b: str(len(b)))}
    assert got[0] == got[1] != got[2] and got[3] == got[4] == "5" and got[0].startswith("3-")
    assert got[2].startswith("3-") and got[2] != got[0]


def test_a_third_of_all_rows_with_one_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 10)
    rows = [(i % 3 and i, f"text {i} " * (i % 5)) for i in range(600)] + [(None, f"none {i}") for i in range(200)]
    assert sorted(map(tuple, run(spark, rows)), key=str) == brute(rows)
