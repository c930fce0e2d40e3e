import brute
import pytest
from pyspark.sql import types as T

from corvid.llm.common import components, shared_dir
from corvid.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, a int, b int, key string"


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 0, 0, "x") for i, t in rows], SCHEMA)
    return [tuple(r) for r in near_duplicates(df, **more).collect()]


def test_matches_brute_force_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    base = [f"w{i}" for i in range(60)]
    rows += [(10_000 + k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(40)]
    rows += [(20_000 + k, " ".join(base)) for k in range(30)]
    got = {r[0]: r[1:] for r in run(spark, rows, words=4, percent=80)}
    assert got == brute.near_duplicates(rows, 4, 80)


@pytest.mark.parametrize("rare", [1, 4, 1000])
def test_strays_of_a_large_bucket_are_all_compared(spark, monkeypatch, rare):
    """Families of copies that differ a little: compared by blocks, by pairs of rare shingles, or by both."""
    import random

    from corvid.llm import minhash

    monkeypatch.setattr(minhash, "STRAY_BLOCK", 7)
    monkeypatch.setattr(minhash, "RARE", rare)
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(160):
        own = list(base)
        for at in rnd.sample(range(120), rnd.choice([0, 1, 3, 4, 5])):
            own[at] = f"x{k}{at}"
        rows.append((k, " ".join(own)))
    rnd.shuffle(rows)
    got = {r[0]: r[1:] for r in run(spark, rows, words=4, percent=80)}
    assert got == brute.near_duplicates(rows, 4, 80)
    assert len({v[1] for v in got.values()}) > 1


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one  TWO"), (3, "É two"), (2, "é two"), (None, "one two"), (9, "one  TWO"), (11, "a " * 60_000)]
    got = sorted(run(spark, rows, words=4), key=str)
    want = [(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (3, 1, 3, True), (2, 1, 2, True), (None, 1, None, True), (9, 1, 8, False), (11, 1, 11, True)]
    assert got == sorted(want, key=str)
    assert run(spark, []) == []


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(300, 340)] + [(i, 2) for i in range(300, 303)] + [(7, 7)]
    df = spark.createDataFrame(edges, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    got = {r.node: r.component for r in components(df, shared_dir(spark)).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == brute.smallest_reachable(nodes, edges[:-1])


def test_documents_that_share_a_template_are_not_paired(spark, monkeypatch):
    """1,500 unrelated documents of one bucket, of similarity 0.6 through 300 words they share, and two true copies among them."""
    from corvid.llm import minhash

    seen = []
    pairs = minhash.rare_pairs
    monkeypatch.setattr(minhash, "rare_pairs", lambda *a: (seen.append((found := pairs(*a)).count()), found)[1])
    template = " ".join(f"t{i}" for i in range(300))
    rows = [(k, template + " " + " ".join(f"u{k}x{i}" for i in range(100))) for k in range(1500)]
    rows += [(2000 + k, rows[7 * k][1] + " more") for k in range(2)]
    got = {r[0]: r[2] for r in run(spark, rows, words=4, percent=80)}
    assert {i for i, c in got.items() if c != i} == {2000, 2001} and got[2001] == 7
    assert len(seen) == 1 and seen[0] <= 4


@pytest.mark.parametrize("own", [50])
def test_templates_just_below_the_threshold_make_hardly_a_comparison(spark, monkeypatch, own):
    """350 shared words and 50 of one's own: similarity 0.776; the bare template and one true copy are among them."""
    from corvid.llm import minhash

    template, moved, each = " ".join(f"t{i}" for i in range(350)), [], []
    cells = minhash.family_cells
    monkeypatch.setattr(minhash, "family_cells", lambda *a: (moved.append((found := cells(*a)).count()), found)[1])
    for n in (300, 900):
        rows = [(k, template + " " + " ".join(f"u{k}x{i}" for i in range(own))) for k in range(n)]
        rows += [(5000, rows[70][1] + " more"), (5001, template)]
        if n == 300:  # with the bare template each has a similarity of 0.85 or more, so all are one component through it
            assert {r[2] for r in run(spark, rows, words=4, percent=80)} == {0}
        moved.clear()
        got = {r[0]: r[2] for r in run(spark, rows[:-1], words=4, percent=80)}
        assert {i: c for i, c in got.items() if c != i} == {5000: 70}
        each.append((moved or [0])[-1] / n)
    assert max(each) <= 0.1, each


def test_templates_with_parts_of_many_lengths(spark, monkeypatch):
    """Some link, most don't; compared with brute force."""
    from corvid.llm import minhash

    monkeypatch.setattr(minhash, "STRAY_BLOCK", 8)
    monkeypatch.setattr(minhash, "RARE", 3)
    template = " ".join(f"t{i}" for i in range(120))
    rows = [(k, template + " " + " ".join(f"u{k}x{i}" for i in range(k % 37))) for k in range(150)]
    rows += [(1000 + k, " ".join(f"t{i}" for i in range(k, 120)) + " " + " ".join(f"v{k}x{i}" for i in range(12))) for k in range(30)]
    got = {r[0]: r[1:] for r in run(spark, rows, words=4, percent=80)}
    assert got == brute.near_duplicates(rows, 4, 80)
