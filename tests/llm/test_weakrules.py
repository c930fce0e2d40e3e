import re
from collections import Counter

import numpy as np
import pytest

from corvid.llm import weakrules
from corvid.llm.queries import op13_weak_rules

SF = "/root/testdata/sf0.01"


def base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), word by word."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def votes(counts):
    """The votes of one document by the rules' bounds."""
    c = dict(zip(weakrules.COUNTS, counts, strict=True))
    holds = lambda x: c[x[1]] > 0 and x[2] <= c[x[0]] / c[x[1]] <= x[3]
    return [1 if any(map(holds, bad)) else 2 if good and all(map(holds, good)) else 0 for _, bad, good in weakrules.RULES]


TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b c d e a b c d e", "a a a a a a", "x\ny\nx\n x\n\n\ny", "# * $ % & | < > #|#", "é ü ß 日本語  x", "a b c d e f\na b c d e", "line one\r\nline one\r\nline one\n", "tail without end " * 4,
    "Mit Punkt. Und noch einer! " * 30, "w" * 70_000 + " " + "v u t s r " * 2, " ".join(f"w{i % 7}" for i in range(50)), "\x00 \x1f \x1c a",
]


def test_counts_like_plain_python(spark):
    docs = spark.createDataFrame([(i, t, 5, True) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, kept boolean")
    got = {r["record"]["doc_id"]: r for r in weakrules.judge(docs).collect()}
    for i, t in enumerate(TEXTS):
        want = base(t)
        assert tuple(got[i][c] for c in weakrules.COUNTS[:5]) == want, t
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
        assert got[i]["votes"] == int("".join(map(str, votes([got[i][c] for c in weakrules.COUNTS]))), 3)
        assert got[i]["record"]["n_words"] == 5 and got[i]["record"]["kept"]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(weakrules, "MIX", np.uint64(0))  # every window gets one hash
    random = np.random.default_rng(1)
    code, owner = random.integers(0, 3, 300), np.repeat(np.arange(3), 100)
    got = weakrules.repeated_windows(code, owner)
    for k in range(3):
        own = " ".join(map(str, code[owner == k]))
        assert got[owner == k].sum() == base(own)[4]


def test_estimate_is_the_plain_algorithm():
    """Document by document, with sums in plain Python, on votes whose accuracy is known."""
    random = np.random.default_rng(2)
    rules, truth = len(weakrules.RULES), random.random(4000) < 0.7
    real = np.linspace(0.65, 0.95, rules)
    right = random.random((4000, rules)) < real
    cast = np.where(random.random((4000, rules)) < 0.5, 0, np.where(right == truth[:, None], 2, 1))
    patterns, at, times = np.unique(cast @ 3 ** np.arange(rules - 1, -1, -1), return_inverse=True, return_counts=True)
    posterior, accuracy, share = weakrules.estimate(patterns, times.astype(float))
    assert np.abs(accuracy - real).max() < 0.06 and abs(share - truth.mean()) < 0.03
    assert ((posterior[at] >= 0.5) == truth).mean() > 0.9
    acc, good = [weakrules.ACCURACY] * rules, 0.5
    for _ in range(5):
        p = []
        for v in cast[:400]:
            a, b = good, 1 - good
            for j, x in enumerate(v):
                a *= {0: 1, 2: acc[j], 1: 1 - acc[j]}[int(x)]
                b *= {0: 1, 1: acc[j], 2: 1 - acc[j]}[int(x)]
            p.append(a / (a + b))
        acc = [(sum(q if v[j] == 2 else 1 - q for q, v in zip(p, cast[:400], strict=True) if v[j]) + 10 * weakrules.ACCURACY) / (sum(1 for v in cast[:400] if v[j]) + 10) for j in range(rules)]
        good = (sum(p) + 5) / 410
    few, counts = np.unique(cast[:400] @ 3 ** np.arange(rules - 1, -1, -1), return_counts=True)
    old, weakrules.ROUNDS = weakrules.ROUNDS, 5
    try:
        _, fast, fast_share = weakrules.estimate(few, counts.astype(float))
    finally:
        weakrules.ROUNDS = old
    assert fast == pytest.approx(acc) and fast_share == pytest.approx(good)


def test_junk_goes_and_clean_documents_stay(spark):
    got = {r.doc_id: r for r in op13_weak_rules(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    assert all(tuple(got[k])[1:6] == base(t) for k, t in docs.items())
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    clean, junk = [r.doc_id for r in labels if r.quality == 1], [r.doc_id for r in labels if r.quality == 0]
    assert sum(got[k].kept or got[k].base_failed for k in clean) >= 0.98 * len(clean)
    assert sum(got[k].kept for k in junk) <= 0.05 * len(junk)


def test_no_rows(spark):
    assert weakrules.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []
