import re
from itertools import permutations

from corvid.llm.audit import filter_audit


def brute(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic). Every order is applied to every document."""
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    judged = []
    for key, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        fails += "E" * (key is not None and any(k is not None and k < key and (o or "") == t for k, o, _ in rows))
        judged.append((source or "", fails, key in good, key in toxic))
    out = {}
    for part in {j[0] for j in judged}:
        own = [j[1:] for j in judged if j[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                early = [x for x in own if f in x[0] and x not in gone and set(x[0]) & set(order[: step - 1])]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(early), sum(x[0] == f for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, rows, labels):
    docs = spark.createDataFrame([(k, t, s, 0, "x") for k, t, s in rows], "doc_id long, text string, source string, mask int, part string")
    got = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len({r[:3] for r in got}) == len(got)
    return {tuple(r)[:3]: tuple(r)[3:] for r in got}


def test_every_order_like_brute_force(spark):
    plain = " ".join(f"word{i}" for i in range(60))
    texts = [plain, "same " * 60, "LOUD " * 30 + plain, plain + " 5%", "few words", "few words", "", None, "  \t\n", "é" * 30 + " ÀÉ", "A" + "x" * 18, "A" + "x" * 19, "a|b"]
    rows = [(100 + i, t, ["s1", "s2", None, ""][i % 4]) for i, t in enumerate(texts)]
    rows += [(90, plain, "s2"), (90, plain, "s1"), (None, plain, "s1"), (None, "few words", None), (300, "word " * 40_000, "long"), (301, "word " * 40_000, "s1")]
    rows += [(1000 + i, "copied text that many have", f"s{i % 3}") for i in range(200)]
    labels = [(100, 1, 0), (102, 1, 1), (103, 0, 1), (103, 1, None), (90, 1, 0), (None, 1, 1), (1000, 1, 1), (1005, 1, None), (7777, 1, 1)]
    got, want = run(spark, rows, labels), brute(rows, labels)
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {} and got.keys() == want.keys()


def test_without_rows_or_labels(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}
    got = run(spark, [(1, "a", "s")], [])
    assert got["s", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and got["s", "EDCBA", 5] == (0, 1, 0, 1, 0, 0, 120) and len(got) == 600
