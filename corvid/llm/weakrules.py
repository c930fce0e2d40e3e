"""Document quality from weak rules: each votes good, bad or abstains, and what the votes are worth is estimated from the votes alone.

One pass over the texts counts words, symbols, repeated lines and repeated five-word windows. Rules turn shares of these counts
into votes. How often each pattern of votes occurs is counted over all documents (with R rules there are 3^R patterns at most, so
this table is small whatever the input); expectation-maximisation over the pattern counts estimates how often each rule is right
when it votes and the share of good documents, and gives each pattern its probability of being good. A document is kept where
that probability reaches a threshold, in place of having to pass every rule. Two base limits hold beside it: too few words, or
too many that repeat, and a document goes.

Votes count as independent within a class, and whether a rule abstains tells nothing. Accuracies start from ACCURACY, are
smoothed by PRIOR_VOTES votes, so a rule that never votes stays at it, and never fall below a half. Where no rule votes, the share of good documents decides.

Edge cases: a null text is one without words; it fails the base limits, as an empty text does. Repeated rows vote each on its own.
Words are runs without ASCII white space; lines are equal character by character. A very long text is counted whole, with about a
hundred bytes of memory a word. An empty table gives an empty result. Columns of the input are carried in a nested column, so
their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import shared_dir, written
from corvid.llm.pieces import blocks

#: Bytes of text that are counted together.
BLOCK_BYTES = 2 << 20
#: Words in a window that may repeat.
WINDOW = 5
#: n_letters: letters and digits; n_bare: words without either; n_ends: words that end a sentence; n_runs: words equal to the one before.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks", "n_bare", "n_ends", "n_runs")
MIX = np.uint64(0x9E3779B97F4A7C15)

#: (name, bad, good): votes bad where a share of bad, (count, per count, at least, at most), lies within its bounds, and good where
#: all shares of good do; else it abstains. Most rules only know one side: that a text has no symbols doesn't make it good.
MANY = float("inf")
PROSE = ("n_letters", "word_chars", 0.92, 1.0)
RULES = [
    ("symbols", [("n_symbols", "n_words", 0.15, MANY)], []),
    ("bare_words", [("n_bare", "n_words", 0.15, MANY)], []),
    ("shouting", [("n_upper", "n_letters", 0.4, 1.0)], []),
    ("marks", [("n_marks", "n_words", 0.3, MANY)], []),
    ("letters", [("n_letters", "word_chars", 0.0, 0.8)], []),
    ("repeated_words", [("n_repeat_words", "n_words", 0.15, 1.0)], []),
    ("runs", [("n_runs", "n_words", 0.15, 1.0)], []),
    ("repeated_lines", [("n_dup_lines", "n_lines", 0.3, 1.0)], []),
    ("sentences", [], [PROSE, ("n_ends", "n_words", 0.02, 0.3), ("n_runs", "n_words", 0.0, 0.02)]),
    ("varied", [], [PROSE, ("n_repeat_words", "n_words", 0.0, 0.02), ("n_runs", "n_words", 0.0, 0.1), ("n_upper", "n_letters", 0.0, 0.15)]),
]
#: What rules are taken to be right in before anything is known, and how many votes that counts as.
ACCURACY, PRIOR_VOTES, ROUNDS = 0.8, 10.0, 200


def by_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over the rows at[k] to at[k + 1]."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[at])


def distinct_by_text(owner: np.ndarray, code: np.ndarray, texts: int) -> np.ndarray:
    """How many different codes each owner has."""
    most = int(code.max()) + 1 if len(code) else 1
    return np.bincount(np.unique(owner * most + code) // most, minlength=texts)


def repeated_windows(code: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True for each word in a window of WINDOW words that its text has twice or more."""
    n = len(code) - WINDOW + 1
    covered = np.zeros(len(code) + 1, dtype=np.int64)
    if n <= 0:
        return covered[: len(code)] > 0
    start = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    value = owner[start].astype(np.uint64)
    for k in range(WINDOW):
        value = (value ^ (value >> np.uint64(29))) * MIX + code[start + k].astype(np.uint64)
    order = np.argsort(value, kind="stable")
    columns = [owner[start], *(code[start + k] for k in range(WINDOW))]
    near = value[order[1:]] == value[order[:-1]]
    same = near & np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in columns])
    if (near != same).any():  # different windows of one hash: sort by the words themselves
        order = np.lexsort(columns)
        same = np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in columns])
    again = start[np.unique(np.concatenate([order[1:][same], order[:-1][same]]))]
    np.add.at(covered, again, 1)
    np.add.at(covered, again + WINDOW, -1)
    return np.cumsum(covered)[: len(code)] > 0


def counted_texts(texts: pa.Array) -> list[np.ndarray]:
    """The COUNTS of each text."""
    texts = texts.fill_null("")
    number = np.arange(len(texts))

    def dealt(lists: pa.ListArray, wanted: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(codes, owners, bounds by text, dictionary) of the parts that hold the wanted pattern."""
        coded = pc.dictionary_encode(lists.flatten())
        code, offsets = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        owner = np.repeat(number, np.diff(offsets))
        good = pc.match_substring_regex(coded.dictionary, wanted).to_numpy(zero_copy_only=False)[code]
        owner = owner[good]
        return code[good].astype(np.int64), owner, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]), coded.dictionary

    of_words = lambda pattern: pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)[code]
    count = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy().astype(np.int64)
    code, owner, at, words = dealt(pc.split_pattern_regex(texts, "[ \t-\r]+"), "(?s).")
    line, its_text, _, _ = dealt(pc.split_pattern(texts, "\n"), "[^ \t-\r]")
    lines = np.bincount(its_text, minlength=len(texts))
    run = np.concatenate([[False], (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])]) if len(code) else np.zeros(0, bool)
    chars = pc.utf8_length(words).to_numpy().astype(np.int64)
    return [
        np.diff(at), by_text(chars[code], at), count("[#*$%&|<>]"), lines - distinct_by_text(its_text, line, len(texts)), by_text(repeated_windows(code, owner), at),
        lines, count(r"[\p{L}\p{N}]"), count(r"\p{Lu}"), count("[!?]"), by_text(~of_words(r"[\p{L}\p{N}]"), at), by_text(of_words(r"[.!?…]['\")»]*$"), at), by_text(run, at),
    ]


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(record, and the COUNTS) of every row; record holds the row's columns."""
    record = T.StructField("record", T.StructType(docs.schema.fields))
    schema = T.StructType([record, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in blocks(b, pc.binary_length(b.column(1)), BLOCK_BYTES)):
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counted_texts(batch.column(1)))], names=schema.names)

    return docs.select(F.struct(*docs.columns).alias("record"), F.col(text_col)).mapInArrow(run, schema)


def within(count: str, per: str, least: float, most: float) -> Column:
    """Whether a share lies within bounds; not where there is nothing to take a share of."""
    share = F.try_divide(F.col(count).cast("double"), F.col(per).cast("double"))
    return F.coalesce(share.between(least, most), F.lit(False))


def vote(name: str, bad: list[tuple], good: list[tuple]) -> Column:
    """2 for good, 1 for bad, 0 where the rule abstains."""
    any_of = reduce(lambda a, b: a | b, [within(*x) for x in bad], F.lit(False))
    all_of = reduce(lambda a, b: a & b, [within(*x) for x in good], F.lit(bool(good)))
    return F.when(any_of, 1).when(all_of, 2).otherwise(0).alias(name)


def pattern() -> Column:
    """The votes of all rules as one number in base 3."""
    return reduce(lambda a, b: a * 3 + b, [vote(*r) for r in RULES]).cast("long").alias("votes")


def estimate(patterns: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of being good of each pattern of votes, accuracy of each rule, share of good documents)."""
    rules = len(RULES)
    votes = patterns[:, None] // 3 ** np.arange(rules - 1, -1, -1) % 3
    is_good, is_bad = (votes == 2).astype(float), (votes == 1).astype(float)
    accuracy, good_share = np.full(rules, ACCURACY), 0.5
    for _ in range(ROUNDS):
        odds = np.log(accuracy / (1 - accuracy))
        posterior = 1 / (1 + np.exp(-np.clip((is_good - is_bad) @ odds + np.log(good_share / (1 - good_share)), -700, 700)))
        good, bad = times * posterior, times * (1 - posterior)
        right, voted = good @ is_good + bad @ is_bad, times @ (is_good + is_bad)
        before = accuracy
        accuracy = np.maximum((right + PRIOR_VOTES * ACCURACY) / (voted + PRIOR_VOTES), 0.5)  # a rule is no worse than a toss
        good_share = (good.sum() + PRIOR_VOTES / 2) / (times.sum() + PRIOR_VOTES)
        if np.abs(accuracy - before).max() < 1e-9:
            break
    return posterior, accuracy, float(good_share)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def judge(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """(record, COUNTS, votes, probability, base_failed, kept) of every row of docs."""
    spark = docs.sparkSession
    voted = written(counts(docs, text_col).withColumn("votes", pattern()), f"{shared_dir(spark)}/counts")
    seen = voted.groupBy("votes").agg(F.count("*").alias("times")).orderBy("votes").collect()  # 3^R rows at most, and as most rules know one side far fewer
    known = estimate(np.array([r["votes"] for r in seen], np.int64), np.array([r["times"] for r in seen], np.float64))[0] if seen else []
    table = spark.createDataFrame([(r["votes"], float(p)) for r, p in zip(seen, known, strict=True)], "votes long, probability double")
    told = voted.join(F.broadcast(table), "votes")  # as few rows
    return told.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
