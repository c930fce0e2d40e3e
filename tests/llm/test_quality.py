import itertools
import zlib

import numpy as np

from corvid.llm import quality


def test_marginals_match_enumeration():
    random = np.random.default_rng(0)
    gains, moves = random.standard_normal(5), random.standard_normal((2, 2))
    weight = {y: np.exp(sum(g for g, one in zip(gains, y) if one) + sum(moves[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=5)}
    total = sum(weight.values())
    p, moved, z = quality.Field(np.zeros(1), moves).marginals(gains)
    assert np.allclose(p, [sum(w for y, w in weight.items() if y[k]) / total for k in range(5)]) and np.isclose(z, np.log(total))
    want = np.array([[sum(w * sum(u == a and v == b for u, v in zip(y, y[1:])) for y, w in weight.items()) / total for b in (0, 1)] for a in (0, 1)])
    assert np.allclose(moved, want)
    both = quality.batch_marginals(np.stack([gains, gains]), moves)
    assert np.allclose(both[0], [p, p]) and np.allclose(both[1], 2 * want)


def test_held_out_ranking(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    own = {r.doc_id: r.quality for r in labels.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    field = quality.train(docs, labels.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0"), steps=150)
    rows = [(r.score, own[r.record.doc_id]) for r in quality.score(docs, field).collect() if r.record.doc_id in own and held(r.record.doc_id)]
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \n\n ", 1), (4, "word " * 50_000, 1), (5, "\n" * 20_000, 1), (None, "A good line.\nAnother one.", 1), (4, "word " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    nothing = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r.score, 9) for r in quality.score(docs, nothing).collect()} == {0.5}
    field = quality.train(docs, spark.createDataFrame([(1, 0), (2, None), (4, 1), (None, 1)], "doc_id long, quality int"), steps=30)
    got = quality.score(docs, field).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.record.doc_id in (1, 2)}) == 1
    assert quality.score(docs.limit(0), field).collect() == []


def test_lines_learnt_from_are_spread_over_the_document():
    import numpy as np

    from corvid.llm.quality import spread

    rows = np.arange(1000)
    assert spread(rows, 1000) is rows
    got = spread(rows, 40)
    assert got[0] == 0 and got[-1] == 999 and len(got) == 40 and (np.diff(got) > 1).sum() == 3
    assert len(spread(rows, 999)) <= 999 and len(spread(rows, 1)) == 1


def test_scores_against_enumeration(spark):
    """Features by plain counting, line probabilities by enumerating all labellings, weighted by the lines' bytes."""
    rows = [(1, "A good line. It ends well.\nAnother one follows here.\nSo it goes on.", 1), (2, "BAD!! BAD!! BAD!!\n||||\nword word word word", 0), (3, "é 12, a?\n\nlast", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    field = quality.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"), steps=40)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\t\n\r ", ".,", "!?", "|"]
    for r in quality.score(docs, field).collect():
        lines = r.record.text.split("\n")
        length = [len(x.encode()) + 1 for x in lines]
        own = []
        for one, n in zip(lines, length):
            data = (one + "\n").encode()
            kind = [next((k for k, g in enumerate(groups) if chr(b) in g), 8 if b > 127 else 7) for b in data]
            words = one.split()
            shape = [sum(a == b for a, b in zip(words, words[1:])) / len(words), 1 - len(set(words)) / len(words), min(len(one) / len(words), 30) / 30, float(words[0][0].isupper()), float(one.rstrip()[-1:] in ".!?" and bool(one.rstrip())), 0.0] if words else [0.0] * 5 + [1.0]
            own.append([kind.count(k) / n for k in range(9)] + shape + [np.log1p(n) / 10])
        none = [0.0] * quality.OWN
        full = [o + [x**0.5 for x in o[:11]] + (own[k - 1] if k else none) + (own[k + 1] if k + 1 < len(own) else none) + [float(k == 0), float(k == len(own) - 1), 1.0] for k, o in enumerate(own)]
        gains = [sum(a * b for a, b in zip(f, field.weights)) for f in full]
        weight = {y: np.exp(sum(g for g, one in zip(gains, y) if one) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=len(lines))}
        good = [sum(w for y, w in weight.items() if y[k]) / sum(weight.values()) for k in range(len(lines))]
        assert np.isclose(r.score, sum(g * n for g, n in zip(good, length)) / sum(length), atol=1e-6)


def test_samples_are_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(f"id{i % 3}", f"text {i}") for i in range(5000)] + [("same", "copy")] * 3000, "doc_id string, text string")
    labels = spark.createDataFrame([("id0", 1), ("id0", 0), ("id1", 1), ("same", 1)] * 500, "doc_id string, quality int")
    sizes = []
    fit = quality.fit
    quality.fit = lambda documents, y, steps: (sizes.append((len(documents), sorted(set(y)))), fit(documents, y, steps))[1]
    try:
        quality.train(docs, labels, sample_rows=100, steps=2)
    finally:
        quality.fit = fit
    assert 0 < sizes[0][0] <= 200
