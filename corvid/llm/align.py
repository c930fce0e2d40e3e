"""Alignment of two tokenizers: the groups of tokens between their common boundaries, and how often each pair of ids meets.

A text with a blank before it is cut where both tokenizers have a boundary anyway, before a blank after a letter, mark or digit, and
each distinct stretch is aligned once: a label for each byte says whether no token ends there, one of A, one of B, or one of both; a
regular expression scans the labels for the spans up to each common end, and the labels within a span count its tokens. Two
tokens that overlap share the bytes up to just one label, so each label is one link of an A token with a B token.

Documents are worked on in blocks of bounded size. A block numbers its distinct pairs of ids and gives how often it has each;
these counts are added up over all blocks, each pair learns its count and whether it is the most frequent of its B id (ties
included), and the numbered pairs of each block come back to its documents, which keep numbers only. So neither tokens nor links
of the corpus are ever shuffled, and a pair that is everywhere is one row a block.

Edge cases: a null or empty text, and one whose A or B bytes aren't its own (a B tokenizer may change characters), has no tokens: zeros,
and an empty group string. Rows that repeat an id are documents of their own; a null id is kept. Strings of special tokens are
plain text. A very long text is a block of its own and takes about 40 bytes of memory a byte. An empty table gives an empty
result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import remove, shared_dir, written
from corvid.llm.pieces import blocks

#: Bytes of text in a block, distinct stretches that are aligned together, and bytes of them that a worker remembers.
BLOCK_BYTES, STRETCHES, MEMORY_BYTES = 8 << 20, 20_000, 96 << 20
#: No tokenizer joins a blank to one of these before it; before other characters a blank stays.
SOLID = r"[\p{L}\p{M}\p{N}\p{P}\p{S}]"
CUT, STAYS = regex.compile(f"(?<={SOLID}) "), f"(^|[^{SOLID[1:]}) "
#: What labels a byte: no end, an end of A, of B, of both.
LABELS = b"nabc"
SPAN = re.compile(rb"[nab]*c")
FIELDS = ("n_a", "n_b", "n_groups", "n_links")


class SpanCounts(dict):
    """(A tokens, B tokens) of a span by its labels."""

    def __missing__(self, span: bytes) -> tuple[int, int]:
        if len(self) > 100_000:
            self.clear()
        found = self[span] = (span.count(b"a") + 1, span.count(b"b") + 1)
        return found


def merge_ranks(file: str) -> tuple[dict[bytes, int], str | None]:
    """The bytes of every token of a byte-level model, by id, without special ones. Their ids must be the order of the merges."""
    with open(file, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model["added_tokens"]}
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    vocab = model["model"]["vocab"]
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
    ids = [vocab[m.replace(" ", "")] for m in merges]
    if any(b <= a for a, b in zip(ids[:-1], ids[1:], strict=True)):
        raise ValueError(f"{file}: ids don't follow the order of the merges")
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}


class Aligner:
    """Both tokenizers, and the alignment of stretches."""

    def __init__(self, byte_file: str, piece_file: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        ranks = merge_ranks(byte_file)
        self.a = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        a_bytes = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.a_size = np.array([len(a_bytes.get(i, b"")) for i in range(max(a_bytes) + 1)], np.int64)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        self.blank = self.b.piece_to_id("\u2581")
        most = max(len(self.a_size), len(self.b_size))
        self.text = {end: np.array([f"{i}{end}" for i in range(most)], object) for end in (",", "|", ";", "\n")}
        self.spans = SpanCounts()
        self.known: dict[str, tuple] = {}
        self.held = 0

    def align(self, stretches: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, pairs, groups) of each stretch with a blank before it; None where its tokens aren't its bytes."""
        a_ids = [self.a.encode_ordinary(" " + s) for s in stretches]
        b_ids = [own or [self.blank] for own in self.b.encode(stretches, num_threads=1)]  # the library gives nothing for nothing
        data = [b" " + s.encode() for s in stretches]
        good = [b"".join(map(self.b_bytes.__getitem__, b)) == d for b, d in zip(b_ids, data, strict=True)]
        a_ids, b_ids = [a for a, g in zip(a_ids, good, strict=True) if g], [b for b, g in zip(b_ids, good, strict=True) if g]
        n_a, n_b = np.array(list(map(len, a_ids)), np.int64), np.array(list(map(len, b_ids)), np.int64)
        a, b = (np.fromiter((i for own in ids for i in own), np.int64) for ids in (a_ids, b_ids))
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        found: list[tuple] = []
        if len(a):
            # all stretches in a row: each ends in a common end
            label = np.zeros(ends_a[-1], np.uint8)
            label[ends_a - 1] += 1
            label[ends_b - 1] += 2
            counts = np.array([self.spans[s] for s in SPAN.findall(np.frombuffer(LABELS, np.uint8)[label].tobytes())], np.int64)
            place = np.flatnonzero(label)
            kind = label[place]
            at_a, at_b = np.cumsum(kind & 1) - (kind & 1), np.cumsum(kind >> 1) - (kind >> 1)
            pairs = a[at_a] << 32 | b[at_b]
            # tokens in the order of the groups' text: a group's A tokens, then its B tokens
            group = np.concatenate([np.repeat(np.arange(len(counts)), counts[:, 0]), np.repeat(np.arange(len(counts)), counts[:, 1])])
            side = np.repeat([0, 1], [len(a), len(b)])
            order = np.argsort(group * 2 + side, kind="stable")
            group, side, token = group[order], side[order], np.concatenate([a, b])[order]
            stretch_ends = np.cumsum(n_a + n_b) - 1
            new_group, new_side = np.append(group[1:] != group[:-1], True), np.append(side[1:] != side[:-1], True)
            parts = np.where(new_group, self.text[";"][token], np.where(new_side, self.text["|"][token], self.text[","][token]))
            parts[stretch_ends] = self.text["\n"][token[stretch_ends]]
            groups = "".join(parts.tolist()).split("\n")
            links = np.searchsorted(place, ends_a[np.cumsum(n_a) - 1] - 1, side="right")
            n_groups = np.diff(np.concatenate([[0], np.searchsorted(np.cumsum(counts[:, 0]), np.cumsum(n_a), side="right")]))
            cut = np.concatenate([[0], links])
            found = [(int(n_a[k]), int(n_b[k]), int(n_groups[k]), pairs[cut[k] : cut[k + 1]].tobytes(), groups[k]) for k in range(len(n_a))]
        each = iter(found)
        return [next(each) if g else None for g in good]

    def learn(self, stretches: list[str]) -> dict[str, tuple]:
        known = self.known
        new = [s for s in stretches if s not in known]
        if self.held > MEMORY_BYTES:
            known.clear()
            self.held, new = 0, stretches
        for i in range(0, len(new), STRETCHES):
            part = new[i : i + STRETCHES]
            for s, found in zip(part, self.align(part), strict=True):
                known[s] = found
                self.held += 300 + 2 * len(s) + (len(found[3]) + len(found[4]) if found else 0)
        return known


@functools.lru_cache(maxsize=2)
def aligner(byte_file: str, piece_file: str) -> Aligner:
    """The tokenizers of a worker: what they remember serves all of the worker's tasks."""
    return Aligner(byte_file, piece_file)


def stretches(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct stretches without their blank, their codes in the order of the texts, where each text's begin)."""
    filled = texts.fill_null("")
    size = pc.binary_length(filled).to_numpy() > 0
    slow = pc.match_substring_regex(filled, STAYS).to_numpy(zero_copy_only=False)  # few texts: they are cut one by one
    lists = pc.split_pattern(pc.if_else(pa.array(slow), "", filled), " ")
    single = [CUT.split(t) for t in filled.filter(pa.array(slow)).to_pylist()]
    at = lists.offsets.to_numpy().astype(np.int64)
    first, sizes = at[:-1] - at[0], np.diff(at)
    sizes[slow] = list(map(len, single))
    first[slow] = at[-1] - at[0] + np.concatenate([[0], np.cumsum(sizes[slow])])[:-1]
    sizes[~size] = 0
    coded = pc.dictionary_encode(pa.concat_arrays([lists.flatten(), pa.array([w for own in single for w in own], pa.string())]))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return coded.dictionary, coded.indices.to_numpy()[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])], ends


ROWS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in FIELDS), T.StructField("groups", T.StringType()),
    T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("totals", T.ArrayType(T.LongType())),
])


def aligned_block(texts: pa.Array, known: Aligner, digest: bool) -> tuple[list, np.ndarray, np.ndarray]:
    """(FIELDS, groups, codes and times of each text, the block's distinct pairs, how often it has each)."""
    words, code, at = stretches(texts)
    listed = words.to_pylist()
    memory = known.learn(listed)
    found = [memory[w] for w in listed]
    bad = np.array([f is None for f in found], bool)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    spoilt = np.bincount(owner[bad[code]], minlength=len(texts)) > 0 if len(code) else np.zeros(len(texts), bool)
    found = [f or (0, 0, 0, b"", "") for f in found]
    code, owner = code[~spoilt[owner]], owner[~spoilt[owner]]
    sizes = np.bincount(owner, minlength=len(texts))
    at = np.concatenate([[0], np.cumsum(sizes)])
    length = np.array([len(f[3]) for f in found], np.int64) // 8
    per_word = [*(np.array([f[k] for f in found], np.int64) for k in range(3)), length]
    sums = [np.diff(np.concatenate([[0], np.cumsum(x[code])])[at]) for x in per_word]
    flat = np.frombuffer(b"".join(f[3] for f in found), np.int64)
    first = np.concatenate([[0], np.cumsum(length)])[:-1]
    pairs, number = np.unique(flat, return_inverse=True)
    # a text's links are those of its stretches: (text, number of the pair), counted
    links = length[code]
    ends = np.concatenate([[0], np.cumsum(links)])
    source = np.repeat(first[code] - ends[:-1], links) + np.arange(ends[-1])
    key, times = np.unique(np.repeat(owner, links) * max(len(pairs), 1) + number[source], return_counts=True)
    its_text, its_pair = key // max(len(pairs), 1), key % max(len(pairs), 1)
    bounds = np.searchsorted(its_text, np.arange(len(texts) + 1))
    text_of = [f[4] for f in found]
    groups = []
    for k in range(len(texts)):
        joined = ";".join([text_of[c] for c in code[at[k] : at[k + 1]].tolist()])
        groups.append(hashlib.sha256(joined.encode()).hexdigest() if joined and digest else joined)
    totals = np.bincount(its_pair, weights=times, minlength=len(pairs)).astype(np.int64)
    return [sums, groups, (bounds, its_pair, times)], pairs, totals


def align_blocks(docs: DataFrame, byte_file: str, piece_file: str, digest: bool) -> DataFrame:
    """ROWS: a row for each document, and rows with the numbered pairs of each block (doc_id null, codes the numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = aligner(byte_file, piece_file), TaskContext.get().partitionId() << 32
        for batch in (part for b in batches for part in blocks(b, pc.binary_length(b.column(1)), BLOCK_BYTES)):
            (sums, groups, (bounds, codes, times)), pairs, totals = aligned_block(batch.column(1), known, digest)
            block, n = block + 1, batch.num_rows
            none = lambda kind, rows: pa.nulls(rows, kind)
            lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, block)), batch.column(0), *(pa.array(x, pa.int64()) for x in sums), pa.array(groups, pa.string()),
                lists(codes, pa.int32()), lists(times, pa.int32()), none(pa.list_(pa.int64()), n), none(pa.list_(pa.int64()), n),
            ], names=ROWS.names)
            cuts = np.append(np.arange(0, len(pairs), 4096), len(pairs)).astype(np.int32)
            chunks = lambda values, kind: pa.ListArray.from_arrays(pa.array(cuts), pa.array(values, kind))
            if m := len(cuts) - 1:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m, block)), *(none(pa.int64(), m) for _ in range(5)), none(pa.string(), m),
                    chunks(np.arange(len(pairs)), pa.int32()), none(pa.list_(pa.int32()), m), chunks(pairs, pa.int64()), chunks(totals, pa.int64()),
                ], names=ROWS.names)

    return docs.mapInArrow(run, ROWS)


SUMMED = T.StructType([f for f in ROWS if f.name in ("doc_id", *FIELDS, "groups")] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])


def summed(own: pa.Table, values: pa.Table) -> pa.Table:
    """The documents of one block with the sums over their links, from what is known of the block's pairs."""
    count, best = np.zeros(values.num_rows, np.int64), np.zeros(values.num_rows, np.int64)
    code = values.column("code").to_numpy()
    count[code], best[code] = values.column("count").to_numpy(), values.column("best").to_numpy()
    lists = own.column("codes").combine_chunks()
    numbers, times = lists.flatten().to_numpy(), own.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    over = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[numbers] * times)])[at])
    return pa.table([*(own.column(c) for c in ("doc_id", *FIELDS, "groups")), pa.array(over(best)), pa.array(over(count))], names=SUMMED.names)


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, count, best) of every pair of ids that is linked; pair is the A id times 2^32 plus the B id."""
    counts = held.select(F.explode(F.arrays_zip("pairs", "totals")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.totals").alias("count"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id")
    highest = counts.groupBy(b_id).agg(F.max("count").alias("highest"))  # a row for each id of B's vocabulary at most
    return counts.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))


def align_documents(docs: DataFrame, byte_file: str, piece_file: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of every row; groups as `a1,a2|b1;a3|b2,b3`, or its SHA-256.

    byte_file: a byte-level model of the tokenizers library (A); piece_file: a sentencepiece model (B).
    """
    spark = docs.sparkSession
    work = shared_dir(spark)
    rows = written(align_blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), byte_file, piece_file, digest), f"{work}/blocks")
    numbered = rows.where("pairs is not null").select("block", "codes", "pairs", "totals")
    counts = written(pair_counts(numbered), f"{work}/counts")
    flat = numbered.select("block", F.explode(F.arrays_zip("codes", "pairs")).alias("x")).select("block", F.col("x.codes").alias("code"), F.col("x.pairs").alias("pair"))
    values = flat.join(counts, "pair").select(F.col("block").alias("of_block"), "code", "count", "best")
    own = rows.where("pairs is null").select("block", *SUMMED.names[:6], "codes", "times")
    done = written(own.groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(summed, SUMMED), f"{work}/done")
    remove(spark, f"{work}/blocks", f"{work}/counts")
    return done
