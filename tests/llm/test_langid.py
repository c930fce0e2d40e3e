import zlib

import numpy as np
from pyspark.sql import functions as F

from corvid.llm import langid

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    model = langid.train(docs, langid.fold(F.col("doc_id"), 3) != 1, per_language=120)
    rows = [r for r in langid.identify(docs.select("doc_id", "text", "lang"), model).collect() if zlib.crc32(str(r.record.doc_id).encode()) % 3 == 1]
    assert np.mean([r.found.lang_pred == r.record.lang for r in rows]) > 0.96
    assert all(0 <= r.found.score <= 1 for r in rows)
    assert set(model.members) == {"germanic", "romance"} and [len(m) for m in model.within.values()] == [1, 1]


def test_counts_of_a_long_text_are_whole():
    text = "the quick brown fox jumps é " * 30_000
    parts = sum(langid.counts(text[:0] + w).sum() for w in ["x"])
    assert langid.counts(text).sum() == sum(len((" " + " ".join(text.split()) + " ").encode()) - n for n in range(4)) and parts == 3 + 2 + 1


def test_edges(spark):
    rows = [(i, f"der die das und nicht {i}", "de", 1) for i in range(20)] + [(100 + i, f"the and of with {i}", "en", 1) for i in range(20)] + [(200 + i, f"los las que por {i}", "xx", 1) for i in range(20)]
    rows += [(None, "und die das", None, 1), (301, None, "de", 1), (302, "", "de", 1), (303, "123 !?", "de", 1), (301, None, "de", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, found int")
    model = langid.train(docs, F.lit(True))
    got = [(r.record.doc_id, r.found.lang_pred, r.found.score) for r in langid.identify(docs, model).collect()]
    assert all(p == "und" and s == 0 for i, p, s in got if i is not None and i > 300)
    assert [p for i, p, _ in got if i is None] == ["de"] and {p for i, p, _ in got if i is not None and 200 <= i < 220} == {"xx"}
    empty = langid.train(docs.limit(0), F.lit(True))
    assert {r.found.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).collect() == []


def test_repeated_and_null_ids_train_within_the_bound(spark):
    for key in (None, 3, 7, 12, 21, 35, 1043):
        rows = [(key, f"der die das und {i}" if i % 2 else f"the and of {i}", "de" if i % 2 else "en") for i in range(5000)] + [(9, "los las que por", "es")] * 3000
        sizes = []
        build = langid.Model.__init__
        langid.Model.__init__ = lambda self, x, langs, families: (sizes.append(len(x)), build(self, x, langs, families))[1]
        try:
            model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), per_language=50)
        finally:
            langid.Model.__init__ = build
        assert sizes[0] <= 300 and model.predict("der und die")[0] == "de" and model.predict("los que las")[0] == "es"


def test_predictions_against_a_plain_count(spark):
    """Features by a dictionary of n-grams, votes by plain sums."""
    from collections import Counter

    docs = spark.read.parquet(DATA)
    model = langid.train(docs, langid.fold(F.col("doc_id"), 3) != 1, per_language=40)

    def plain(text):
        data = (" " + " ".join(text.lower().split()) + " ").encode()
        cells = Counter()
        for n in range(1, 5):
            for at in range(len(data) - n + 1):
                key = 0
                for b in data[at : at + n]:
                    key = (key * 0x01000193 + b + 1) % 2**32
                cells[(key * 0x9E3779B1 % 2**32) >> 19] += 1
        total = sum(cells.values())
        x = {c: (n / total) ** 0.5 for c, n in cells.items()}

        def vote(names, machines):
            votes, sums = Counter({n: 0 for n in names}), Counter()
            for i, j, w in machines:
                m = sum(float(w[c]) * v for c, v in x.items())
                votes[names[i] if m >= 0 else names[j]] += 1
                sums[names[i]] += m
                sums[names[j]] -= m
            return max(names, key=lambda n: (votes[n], sums[n]))

        family = vote(model.families, model.between)
        return vote(model.members[family], model.within[family])

    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect() if any(c.isalpha() for c in r.text)]
    assert [model.predict(t)[0] for t in texts] == [plain(t) for t in texts]
