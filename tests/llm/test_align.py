import hashlib
import os
from collections import Counter

import pytest

from corvid.llm.align import FIELDS, align_documents
from corvid.llm.queries import op12_token_alignment, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokens():
    """Both tokenizers of the libraries, on whole texts: [(id, bytes)] of A and of B."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    # each byte's character, read off characters that hold every byte there is in UTF-8
    samples = [*range(0x800), *(max(0x800, k << 12) for k in range(16)), *(max(0x10000, k << 18) for k in range(5))]
    chars = {c: x for n in samples for c, x in zip(level.pre_tokenize_str(chr(n))[0][0], chr(n).encode(), strict=True)}
    level_bytes = lambda token: bytes(chars[c] for c in token)

    def encode(text):
        got_a = [(i, level_bytes(a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        got_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return got_a, got_b

    return encode


def brute(texts, encode):
    """Byte by byte: which A and which B token each byte is in."""
    docs, counts = [], Counter()
    for t in texts:
        a, b = encode(t) if t else ([], [])
        if b"".join(x for _, x in a) != (" " + t).encode() if t else True:
            a = b = []
        elif b"".join(x for _, x in b) != (" " + t).encode():
            a = b = []
        in_a, in_b = [k for k, (_, x) in enumerate(a) for _ in x], [k for k, (_, x) in enumerate(b) for _ in x]
        links = sorted(set(zip(in_a, in_b, strict=True)))
        groups, at_a, at_b = [], 0, 0
        for p in range(len(in_a)):
            if p + 1 == len(in_a) or in_a[p + 1] != in_a[p] and in_b[p + 1] != in_b[p]:
                groups.append(",".join(str(i) for i, _ in a[at_a : in_a[p] + 1]) + "|" + ",".join(str(i) for i, _ in b[at_b : in_b[p] + 1]))
                at_a, at_b = in_a[p] + 1, in_b[p] + 1
        pairs = [(a[i][0], b[j][0]) for i, j in links]
        counts.update(pairs)
        docs.append((len(a), len(b), len(groups), pairs, ";".join(groups)))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(n_a, n_b, n_groups, len(pairs), groups, sum(counts[p] == highest[p[1]] for p in pairs), sum(counts[p] for p in pairs)) for n_a, n_b, n_groups, pairs, groups in docs]


TEXTS = [
    None, "", " ", "  ", "a ", " a", "a  b", "a\n b\t c \n\n d", "word", "▁", "has ▁ in it", "<|endoftext|> and <s> </s> <unk> <0x41>", "日本語 テキスト です", "emoji 👩‍👩‍👧 ok", "\x00 nul\x00 x", "  x 　 y", "don't we'll I'd",
    "tabs\t\tand   blanks     x", "ﬁ ligature é ​ zero", "12345 67 8.9e10 !!! ??? --- ...", "\r\n \r\n x", "x" * 5000, "ab " * 3000, "ünïcödé Straße ñandú", "  lead and trail  ", "the the the", "﻿bom", "ends in line\n", "\n", "a  b",
]


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_like_the_libraries_byte_by_byte(spark, tokens, monkeypatch, block):
    from corvid.llm import align

    monkeypatch.setattr(align, "BLOCK_BYTES", block)  # workers have their own; there, more partitions make more blocks
    rows = [(k % 20, t, "x") for k, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(1 if block > 1000 else 7)
    got = sorted((r.doc_id, *(r[c] for c in FIELDS), r.groups, r.n_best, r.count_sum) for r in align_documents(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).collect())
    assert got == sorted((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], tokens), strict=True))


def test_blocks_of_few_texts(tokens):
    import pyarrow as pa

    from corvid.llm import align

    known = align.aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    for t, (n_a, n_b, n_groups, n_links, groups, _, _) in zip(TEXTS, brute(TEXTS, tokens), strict=True):
        (sums, found, _), pairs, totals = align.aligned_block(pa.array([t], pa.string()), known, False)
        assert [int(x[0]) for x in sums] == [n_a, n_b, n_groups, n_links] and found == [groups] and totals.sum() == n_links and (totals > 0).sum() <= n_links and len(pairs) == len(totals)


def test_query_on_a_whole_table(spark, tokens):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in op12_token_alignment(spark, SF).collect()}
    for r, (n_a, n_b, n_groups, n_links, groups, n_best, count_sum) in zip(docs, brute([r.text for r in docs], tokens), strict=True):
        assert got[r.doc_id] == (r.doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_no_rows(spark):
    assert align_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).collect() == []
