"""Language identification in two steps: the family first, then the language within the family.

A text's features are the relative frequencies of its hashed byte n-grams (one to four bytes of the lower-cased text, words
marked by a blank at both ends). A linear one-versus-one support vector machine for each pair of families votes for a family;
within it, one for each pair of languages votes for the language. All machines are trained by the Pegasos method on a bounded,
hash-chosen sample of the labelled rows (at most twice per_language rows of each language); every whole text is scored.

The families of languages are a parameter; a language that isn't listed forms a family of its own.

Edge cases: a text that is null or has no letter is `und` with score 0. Without any labelled row every text is `und`.
Repeated rows get equal results and count once in the sample, however many they are; null or repeated ids are no obstacle,
since a row is sampled by its id and text together. Very long texts are counted whole, in pieces. Columns of the input are
carried in `record`, so names can't clash.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvid.llm.common import hashed_share

# Languages by family
FAMILIES = {"germanic": ["da", "de", "en", "is", "nl", "no", "sv"], "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"], "slavic": ["bg", "cs", "pl", "ru", "sk", "uk"]}
#: Hash cells of the n-grams, and the longest n-gram in bytes.
CELLS, LONGEST = 1 << 13, 4
#: A score below which a text is in none of the learnt languages, or has too little to tell: 0.25 is a toss at both steps.
LEAST_SCORE = 0.37
#: Bytes of a text that are counted at once.
CHUNK = 1 << 18
LETTER = re.compile(r"[^\W\d_]")


def counts(text: str) -> np.ndarray:
    """How often each n-gram cell occurs in the whole text."""
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    total = np.zeros(CELLS, dtype=np.int64)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + LONGEST - 1].astype(np.uint32)
        room = min(CHUNK, len(data) - at)
        key = np.zeros(len(part), dtype=np.uint32)
        for n in range(LONGEST):
            key = key[: len(part) - n] * np.uint32(0x01000193) + part[n:] + np.uint32(1)
            cell = (key * np.uint32(0x9E3779B1)) >> np.uint32(19)
            total += np.bincount(cell[:room], minlength=CELLS)
    return total


def features(count: np.ndarray) -> np.ndarray:
    """Square roots of the frequencies: unit length, and rare n-grams still count."""
    return np.sqrt(count / max(1, count.sum()))


def train_machine(x: np.ndarray, y: np.ndarray, epochs: int = 12, strength: float = 1e-4, seed: int = 1) -> np.ndarray:
    """A linear support vector machine by stochastic subgradient steps (Pegasos), averaged over the last half."""
    random = np.random.default_rng(seed)
    w, mean, steps, kept = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, 0
    for epoch in range(epochs):
        for i in random.permutation(len(x)):
            steps += 1
            rate = 1 / (strength * (steps + 100))
            wrong = y[i] * (x[i] @ w) < 1
            w *= 1 - rate * strength
            if wrong:
                w += rate * y[i] * x[i]
        if epoch >= epochs // 2:
            mean += w
            kept += 1
    return mean / max(1, kept)


class Model:
    """The machines between families and, for each family, between its languages."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, list[str]] = FAMILIES):
        self.family_of = {lang: next((f for f, members in families.items() if lang in members), lang) for lang in sorted(set(langs))}
        self.families = sorted(set(self.family_of.values()))
        self.members = {f: [x for x, g in self.family_of.items() if g == f] for f in self.families}
        of = np.array([self.family_of[x] for x in langs])
        self.between = self._pairs(x, of, self.families)
        self.within = {f: self._pairs(x[of == f], np.array(langs)[of == f], self.members[f]) for f in self.families}

    @staticmethod
    def _pairs(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[tuple[int, int, np.ndarray]]:
        out = []
        for i, j in itertools.combinations(range(len(names)), 2):
            own = (y == names[i]) | (y == names[j])
            out.append((i, j, train_machine(x[own], np.where(y[own] == names[i], 1.0, -1.0)).astype(np.float32)))
        return out

    @staticmethod
    def _vote(x: np.ndarray, names: list[str], machines: list) -> tuple[str, float]:
        """The name with most votes, ties by the sum of margins; how sure its own machines are on average, 0.5 to 1."""
        votes, margins, sure = [0] * len(names), [0.0] * len(names), [[] for _ in names]
        for i, j, w in machines:
            m = float(x @ w)
            votes[i if m >= 0 else j] += 1
            margins[i] += m
            margins[j] -= m
            p = 1 / (1 + np.exp(-2 * m))
            sure[i].append(p)
            sure[j].append(1 - p)
        best = max(range(len(names)), key=lambda k: (votes[k], margins[k], -k))
        return names[best], float(np.mean(sure[best])) if sure[best] else 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.families or not LETTER.search(text):
            return "und", 0.0
        x = features(counts(text)).astype(np.float32)
        family, p = self._vote(x, self.families, self.between)
        lang, q = self._vote(x, self.members[family], self.within[family])
        return lang, p * q


def train(docs: DataFrame, learnable: Column, per_language: int = 300, families: dict[str, list[str]] = FAMILIES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits the model on about per_language rows of each language, chosen by a hash of id and text among the learnable rows."""
    rows = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(id_col, text_col).alias("mark"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    size = {r["lang"]: (r["n"], r["least"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("mark").alias("least")).collect()}
    if not size:
        return Model(np.zeros((0, CELLS)), [], families)
    wanted = F.lit(False)
    for lang, (n, least) in sorted(size.items()):
        wanted = wanted | ((F.col("lang") == lang) & (hashed_share(F.col("mark"), n, per_language) | (F.col("mark") == least)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    chosen = rows.where(wanted).dropDuplicates(["lang", "mark"]).withColumn("nth", nth).where(F.col("nth") <= 2 * per_language).select("mark", "lang", "text")
    schema = T.StructType([T.StructField("mark", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [features(counts(t)).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("lang"), pa.array(data, pa.binary())], names=schema.names)

    found = sorted(chosen.mapInArrow(run, schema).collect(), key=lambda r: (r["lang"], r["mark"]))
    return Model(np.stack([np.frombuffer(r["counts"], np.float32) for r in found]), [r["lang"] for r in found], families)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and lang_score to docs, in one struct column `found`, so that names can't clash; columns of docs are in `record`."""
    packed = docs.select(F.struct(*docs.columns).alias("record"), F.col(text_col).alias("text"))
    found = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([packed.schema["record"], T.StructField("found", found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = zip(*(model.predict(t) for t in batch.column("text").to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=found.names)], names=schema.names)

    return packed.mapInArrow(run, schema)


def accepted(found: str = "found", least: float = LEAST_SCORE) -> Column:
    """Whether the machines are sure enough of a text's language."""
    return (F.col(found)["lang_pred"] != "und") & (F.col(found)["score"] >= least)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))
