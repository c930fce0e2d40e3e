import random

import public_tokenizers
import pytest
import sentencepiece

from corvid.llm import pieces as module
from corvid.llm.pieces import BLANK, PieceBytes, PieceModel, decode, encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return PieceModel(MODEL)


def test_ids_are_the_librarys_on_whole_texts(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = decode(encode(docs, MODEL), MODEL).collect()
    assert len(rows) == len(text)
    assert all(list(r.ids) == library.encode(text[r.doc_id]) and r.text == text[r.doc_id] for r in rows)


def test_random_mixtures(model, library):
    back = PieceBytes(MODEL)
    rnd = random.Random(5)
    pieces = [p.replace(BLANK, " ") for p in model.rank]
    odd = ["é", "\n", " ", "  ", "日本", "\t", "a", "the", "𝔘", "0", "000", "́"]
    for _ in range(800):
        text = "".join(rnd.choice(pieces) if rnd.random() < 0.7 else rnd.choice(odd) for _ in range(rnd.randint(0, 25)))
        assert model.encode(text).tolist() == library.encode(text)
        assert back.decode(model.encode(text)) == text


def test_stream_commits_within_a_bounded_window(model, library):
    text = "a" * 4000 + "==" * 2000 + "nocutsinthislongstretch" * 300
    widest, meeting = 0, model.meeting

    def watched(last):
        nonlocal widest
        widest = max(widest, len(last))
        return meeting(last)

    model.meeting = watched
    got = model.ids(model.pieces(BLANK + text[i : i + 7] if i == 0 else text[i : i + 7] for i in range(0, len(text), 7)))
    model.meeting = meeting
    assert got == library.encode(text) and 0 < widest <= 12 * model.longest


def test_edges(spark, library):
    rows = [(1, None, 0), (2, "", 0), (3, " ", 0), (4, "x\0y z", 0), (5, "é" * 120_000, 0), (6, "same", 0), (6, "same", 0), (None, "n", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = decode(encode(df, MODEL), MODEL).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((i, t) for i, t, _ in rows), key=str)
    assert all(r.text is None or list(r.ids) == library.encode(r.text) for r in got)
    assert decode(encode(df.limit(0), MODEL), MODEL).collect() == []


def test_memory_is_bounded_by_bytes_and_blocks(model, library, monkeypatch):
    monkeypatch.setattr(module, "MEMORY_BYTES", 4000)
    fresh = PieceModel(MODEL)
    for k in range(60):
        text = " ".join(f"word{k}x{i} {'y' * (i % 30)}" for i in range(9))
        assert fresh.encode(text).tolist() == library.encode(text) and fresh.held <= 4000
        assert sum(module.ENTRY_BYTES + 2 * len(w) + len(p) for w, p in fresh.known.items()) == fresh.held


def test_decoding_in_blocks(spark, monkeypatch, library):
    monkeypatch.setattr(module, "BLOCK_IDS", 7)
    back = PieceBytes(MODEL)
    text = "the quick brown fox é 日本 jumps"
    ids = module.np.array(library.encode(text))
    assert back.decode(ids) == text and back.decode_all(module.np.concatenate([ids, ids[:3]]), module.np.array([0, len(ids), len(ids), len(ids) + 3])) == [text, "", back.decode(ids[:3])]
    with pytest.raises(ValueError):
        back.decode(module.np.array([10**6]))
