"""Best-fit packing of token pieces into sequences of a fixed capacity.

The number of sequences is minimised by the configuration linear program over the histogram of piece lengths: one variable for
each way to fill a sequence, one covering row for each length. Multiplicative weights solve it: lengths that are still badly
covered weigh more, a knapsack dynamic program prices the best filling under these weights, and the filling joins the solution.
The solution is rounded down, and what rounding leaves over is packed best-fit on the histogram. Where the number of sequences
is further above the least possible one than a stated gap, the program is solved with four times the rounds, up to a limit; the
best plan is taken, and it is never worse than best-fit alone.

The driver sees only the histogram (at most `capacity` rows whatever the input); pieces get their places on the executors, a
bounded number of them in each window.

Edge cases: a null text counts as empty, and an empty text is one piece that holds the end id alone. Repeated rows are packed
each on its own; which of several pieces of one length comes first is decided by their place in a written table. A very long
text gives many pieces. An empty table gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvid.llm.common import shared_dir, written

#: Distinct words whose ids a Python worker remembers before it starts anew.
WORD_MEMORY = 600_000
#: Documents that are tokenised together.
BLOCK = 4000
#: A letter, then marks before a blank: the tokenizer parts the two anyway. (None of these marks is part of a special token.)
LETTER_THEN_MARKS = r"([a-zA-ZÀ-ÖØ-öø-ÿ])([!-&(-/:;=?@\[-^`{}~]+)( |$)"
#: A word of such letters in lower case: it is one word of the merge model, and normalising leaves it alone.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: Pieces of one length that are numbered together, about.
NUMBERED = 100_000

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


class WordIds:
    """Ids of texts as packed little-endian uint32, by way of their distinct words.

    The tokenizer drops white space, lowers case and never joins what white space parts, so a text's ids are those of its
    words in order. Only blanks, tabs and line ends are cut here; rarer white space is left to the tokenizer. Words of plain
    Latin letters go straight to its merge model; all others take the tokenizer's full path.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker for each core already
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {i: byte_level.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x100)}
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        core = word.lower()
        if PLAIN.fullmatch(core):
            ids = [t.id for t in self.model.tokenize(core if core.isascii() else core.translate(self.as_bytes))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        if len(self.known) >= WORD_MEMORY:
            self.known.clear()
        packed = self.known[word] = array("I", ids).tobytes()
        return packed

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin; nulls count as empty."""
        parted = pc.replace_substring_regex(texts.fill_null(""), r"[\n\t\r]", " ")
        parted = pc.replace_substring_regex(parted, LETTER_THEN_MARKS, r"\1 \2\3")
        lists = pc.split_pattern(parted, " ")
        marked = pc.dictionary_encode(lists.flatten())
        at = lists.offsets.to_numpy().astype(np.int64)
        words = marked.dictionary.to_pylist()
        known, word = self.known.get, self.word
        ids = [known(w) or word(w) if w else b"" for w in words]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        first = np.concatenate([[0], np.cumsum(size)])
        code = marked.indices.to_numpy()
        length = size[code]
        ends = np.concatenate([[0], np.cumsum(length)])
        source = np.repeat(first[code] - ends[:-1], length) + np.arange(ends[-1])
        return flat[source], ends[at - at[0]]


@functools.lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> WordIds:
    """The tokenizer of a worker: the words it remembers serve all of the worker's tasks."""
    return WordIds(tokenizer_file)


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids, the end id last, cut every capacity ids."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_file)
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            out: tuple[list, ...] = ([], [], [], [], [])
            flat, begins = words(batch.column(1))
            for i, key in enumerate(batch.column(0).to_pylist()):
                ids = flat[begins[i] : begins[i + 1]].tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (key, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=PIECES.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def best_filling(value: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack by dynamic programming: the multiset of lengths (1-based index into value) of the largest value that fits."""
    lengths = np.flatnonzero(value > 0) + 1
    gain = value[lengths - 1]
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = np.searchsorted(lengths, room, side="right")
        if n:
            total = best[room - lengths[:n]] + gain[:n]
            k = int(total.argmax())
            if total[k] > best[room]:
                best[room], last[room] = total[k], lengths[k]
    filling: dict[int, int] = defaultdict(int)
    room = capacity
    while room > 0:
        if last[room]:
            filling[int(last[room])] += 1
            room -= int(last[room])
        else:
            room -= 1
    return dict(filling)


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """A lower bound: all tokens must fit, and pieces of more than half a sequence need one each."""
    lengths = np.arange(1, len(counts) + 1)
    return int(max(-(-int(lengths @ counts) // capacity), counts[2 * lengths > capacity].sum()))


def fractional_fillings(counts: np.ndarray, capacity: int, rounds: int = 120, rate: float = 0.1) -> list[tuple[dict[int, int], float]]:
    """The configuration linear program by multiplicative weights: fillings and how often each is used, a fraction.

    In each round the knapsack prices the best filling under the weights; a length's weight then grows or shrinks by
    exp(rate * (1 - what this filling gives it, relative to what a sequence must give it on average)). The answer is the mean
    over all rounds, scaled to the least number of sequences there can be.
    """
    lengths = np.flatnonzero(counts) + 1
    if not len(lengths):
        return []
    wanted = counts[lengths - 1]
    least = float(least_sequences(counts, capacity))
    weight = (lengths / capacity) ** 1.3
    used: dict[tuple, float] = defaultdict(float)
    value = np.zeros(len(counts))
    for _ in range(rounds):
        value[lengths - 1] = weight
        filling = best_filling(value, capacity)
        used[tuple(sorted(filling.items(), reverse=True))] += least / rounds
        given = np.zeros(len(counts))
        for n, k in filling.items():
            given[n - 1] = k
        weight = weight * np.exp(rate * np.clip(1 - given[lengths - 1] * least / wanted, -3, 1) / np.sqrt(rounds / 120))
        weight /= weight.sum()
    return [(dict(f), x) for f, x in used.items()]


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: (filling, number of sequences). Equal sequences are filled together."""
    groups: dict[int, list[list]] = defaultdict(list)  # room left -> [filling, number]
    rooms = np.zeros(capacity + 1, dtype=bool)
    done: list[tuple[dict[int, int], int]] = []

    def put(filling: dict[int, int], room: int, number: int) -> None:
        if room:
            groups[room].append([filling, number])
            rooms[room] = True
        else:
            done.append((filling, number))

    for length in range(len(counts), 0, -1):
        left = int(counts[length - 1])
        while left:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = length + int(fitting[0])
                filling, number = groups[room].pop()
                rooms[room] = bool(groups[room])
                each = min(room // length, max(1, left // number))
                take = min(number, left // each)
                if take < number:
                    put(filling, room, number - take)
                put(filling | {length: filling.get(length, 0) + each}, room - each * length, take)
                left -= each * take
            else:
                each = min(capacity // length, left)
                number = left // each
                put({length: each}, capacity - each * length, number)
                left -= each * number
    return done + [(f, n) for g in groups.values() for f, n in g]


def plan_sequences(histogram: dict[int, int], capacity: int, rounds: int = 120, most_rounds: int = 480, gap: float = 0.001) -> list[tuple[dict[int, int], int]]:
    """Fillings and how many sequences use each; together they hold exactly the pieces of the histogram."""
    counts = np.zeros(capacity, dtype=np.int64)
    for length, number in histogram.items():
        counts[length - 1] = number
    best = best_fit(counts, capacity)
    allowed = int(least_sequences(counts, capacity) * (1 + gap))
    while rounds <= most_rounds:
        plan: list[tuple[dict[int, int], int]] = []
        left = counts.copy()
        for filling, times in fractional_fillings(counts, capacity, rounds):
            number = min([int(times + 1e-9), *(int(left[n - 1]) // k for n, k in filling.items())])
            if number > 0:
                plan.append((filling, number))
                for n, k in filling.items():
                    left[n - 1] -= k * number
        plan += best_fit(left, capacity)
        if sum(n for _, n in plan) <= sum(n for _, n in best):
            best = plan
        if sum(n for _, n in best) <= allowed:
            break
        rounds *= 4
    total: dict[tuple, int] = defaultdict(int)
    for filling, number in best:
        total[tuple(sorted(filling.items(), reverse=True))] += number
    return [(dict(f), n) for f, n in sorted(total.items(), reverse=True)]


def slots_of(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, pieces per sequence, offset in the sequence), by first rank."""
    rows: dict[int, list] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for filling, number in plan:
        offset = 0
        for length, k in sorted(filling.items(), reverse=True):
            rows[length].append((ranks[length], sequence, k, offset))
            ranks[length] += k * number
            offset += k * length
        sequence += number
    return {length: np.asarray(r, dtype=np.int64) for length, r in rows.items()}


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the pieces of all documents; adds sequence_id and offset to what token_pieces returns."""
    spark = docs.sparkSession
    work = shared_dir(spark)
    # row numbers are in a written table, so they never change
    pieces = written(token_pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), f"{work}/pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slots_of(plan_sequences(histogram, capacity))
    # numbers the pieces of each length from 0, by (length, salt): as many salts as its pieces need, so that no length lands in one task
    salts = F.broadcast(spark.createDataFrame([(n, -(-k // NUMBERED)) for n, k in sorted(histogram.items())], "length long, salts long"))  # at most capacity rows
    salted = pieces.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts"))).drop("salts")
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                block = slots[int(n)]
                row = block[np.searchsorted(block[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + nth // row[:, 2]
                offset[at] = row[:, 3] + nth % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PIECES.names), pa.array(sequence), pa.array(offset)], names=[*PIECES.names, "sequence_id", "offset"])

    out = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*PIECES.names, "rank").mapInArrow(place, out)
