import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corvid.llm import packing
from corvid.llm.packing import best_filling, best_fit, least_sequences, pack, plan_sequences

FILE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length int, salt string, rank int"


def check(spark, rows, capacity):
    df = spark.createDataFrame([(i, t, 0, "", 1) for i, t in rows], SCHEMA)
    got = pack(df, FILE, capacity).collect()
    tokenizer = Tokenizer.from_file(FILE)
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), [r.length for r in got]


def test_whole_corpus(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 3)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    n, lengths = check(spark, rows, 512)
    counts = np.bincount(lengths, minlength=513)[1:]
    assert n <= sum(k for _, k in best_fit(counts, 512)) and n <= 1.01 * least_sequences(counts, 512)


def test_knapsack_against_brute_force():
    value = np.array([0.0, 2.1, 3.3, 0.0, 5.6])
    best = best_filling(value, 13)
    reach = [0.0] * 14
    for room in range(1, 14):
        reach[room] = max([reach[room - 1], *(reach[room - n] + value[n - 1] for n in range(1, 6) if n <= room and value[n - 1])])
    assert np.isclose(sum(value[n - 1] * k for n, k in best.items()), reach[13]) and sum(n * k for n, k in best.items()) <= 13


def test_plans_hold_every_piece():
    rnd = random.Random(1)
    for _ in range(3):
        histogram = {rnd.randint(1, 100): rnd.randint(1, 400) for _ in range(30)}
        held = Counter()
        plan = plan_sequences(histogram, 100)
        for filling, number in plan:
            assert sum(n * k for n, k in filling.items()) <= 100
            for n, k in filling.items():
                held[n] += k * number
        assert held == histogram
        counts = np.zeros(100, int)
        for n, k in histogram.items():
            counts[n - 1] = k
        assert least_sequences(counts, 100) <= sum(n for _, n in plan) <= sum(n for _, n in best_fit(counts, 100))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (4, "long " * 20_000), (5, "x" * 9000), (6, "it's <|endoftext|> İx ΟΔΟΣ é \x1c\x1d 12a! a.b, Éa!!")]
    check(spark, rows, 64)
    assert pack(spark.createDataFrame([], SCHEMA), FILE, 64).collect() == []
