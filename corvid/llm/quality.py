"""Document quality from a linear-chain conditional random field over lines.

Each line has features of its own characters and words (how many letters are upper case, marks, digits, repeated words, ...)
and those of the lines before and after it. The field labels every line good or bad; forward-backward gives each line's
probability to be good, and the document's score is their mean, weighted by the lines' lengths.

Training takes a bounded, hash-chosen sample of the labelled documents; a document's label stands for all its lines, and the
field's likelihood is climbed by full-batch Adam steps with a penalty on large weights.

Edge cases: a null or blank text has one empty line, and is scored like any other. Very long lines and texts are counted
whole. Without a labelled row every score is 0.5. Of labels that repeat an id the lowest holds. Repeated rows get equal scores
and count once in the sample; it holds 2 * sample_rows documents at most, however often an id is repeated. Ids may be of any
type. Columns of the input are carried in `record`, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import sample_of

#: Byte classes: lower, upper, digit, blank, full stop and comma, exclamation and question mark, bar, other marks, non-ASCII.
CLASSES = 9
CLASS_OF = np.full(256, 7, dtype=np.uint8)
CLASS_OF[ord("a") : ord("z") + 1], CLASS_OF[ord("A") : ord("Z") + 1], CLASS_OF[ord("0") : ord("9") + 1] = 0, 1, 2
CLASS_OF[[9, 10, 13, 32]], CLASS_OF[[ord("."), ord(",")]], CLASS_OF[[ord("!"), ord("?")]], CLASS_OF[ord("|")] = 3, 4, 5, 6
CLASS_OF[128:] = 8
OWN = CLASSES + 7


def own_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line, length of each line)."""
    lines = text.split("\n")
    data = np.frombuffer(text.encode("utf-8", "surrogatepass") + b"\n", dtype=np.uint8)
    line = np.cumsum(data == 10) - (data == 10)
    n = len(lines)
    x = np.zeros((n, OWN))
    x[:, :CLASSES] = np.bincount(line * CLASSES + CLASS_OF[data], minlength=n * CLASSES).reshape(n, CLASSES)
    length = x[:, :CLASSES].sum(axis=1)
    x[:, :CLASSES] /= length[:, None]
    for i, one in enumerate(lines):
        words = one.split()
        k = len(words)
        if k:
            same = sum(map(str.__eq__, words[1:], words))
            x[i, CLASSES : CLASSES + 5] = same / k, 1 - len(set(words)) / k, min(len(one) / k, 30) / 30, (words[0][:1].isupper()), one.rstrip()[-1:] in ".!?"
        else:
            x[i, CLASSES + 5] = 1
    x[:, CLASSES + 6] = np.log1p(length) / 10
    return x, length


def expand(own: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (zero beyond the ends, which two flags tell), some squares, and 1."""
    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    flags = np.zeros((n, 3))
    flags[0, 0], flags[-1, 1], flags[:, 2] = 1, 1, 1
    return np.concatenate([own, np.sqrt(own[:, : CLASSES + 2]), before, after, flags], axis=1)


WIDTH = 3 * OWN + CLASSES + 2 + 3


class Field:
    """weights: of the features, for good against bad; moves[a, b]: of label b after label a (0 bad, 1 good)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def marginals(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(P(good) of each line, expected moves, log of the partition sum), given each line's gain of good over bad."""
        n = len(gains)
        (m00, m01), (m10, m11) = self.moves.tolist()
        g = gains.tolist()
        fore = [(0.0, g[0])]
        for k in range(1, n):
            a, b = fore[-1]
            fore.append((logadd(a + m00, b + m10), logadd(a + m01, b + m11) + g[k]))
        total = logadd(*fore[-1])
        p, c, d = [0.0] * n, 0.0, 0.0
        moved = np.zeros((2, 2))
        for k in range(n - 1, -1, -1):
            a, b = fore[k]
            p[k] = np.exp(min(0.0, b + d - total))
            if k:
                u, v = fore[k - 1]
                gain = g[k]
                moved += np.exp(np.minimum(0.0, np.array([[u + m00 + c, u + m01 + gain + d], [v + m10 + c, v + m11 + gain + d]]) - total))
                c, d = logadd(m00 + c, m01 + gain + d), logadd(m10 + c, m11 + gain + d)
        return np.array(p), moved, total

    def good(self, gains: np.ndarray) -> np.ndarray:
        return self.marginals(gains)[0]

    def score(self, text: str | None) -> float:
        own, length = own_features(text or "")
        p = self.good(expand(own) @ self.weights)
        return float(min(1.0, max(0.0, p @ length / length.sum())))


def logadd(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + float(np.log1p(np.exp(low - high)))


def fit(documents: list[np.ndarray], labels: list[int], steps: int = 400, penalty: float = 1e-4, window: int = 16) -> Field:
    """Full-batch Adam on the mean log-likelihood of the label sequences. Chains are learnt from in windows of lines (scoring
    takes them whole); windows of equal length are worked on together."""
    field = Field(np.zeros(WIDTH), np.zeros((2, 2)))
    if not documents:
        return field
    sizes: dict[int, list[tuple]] = {}
    for d, label in zip(documents, labels, strict=True):
        for at in range(0, len(d), window):
            part = d[at : at + window]
            sizes.setdefault(len(part), []).append((part, label))
    groups = [(np.stack([x for x, _ in own]), np.array([y for _, y in own])) for own in sizes.values()]
    lines = sum(map(len, documents))
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, steps + 1):
        w, moves = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        slope = np.zeros(WIDTH + 4)
        for x, y in groups:
            p, moved = batch_marginals(x @ w, moves)
            slope[:WIDTH] += np.einsum("dl,dlf->f", y[:, None] - p, x)
            seen = np.zeros((2, 2))
            seen[0, 0], seen[1, 1] = (y == 0).sum() * (x.shape[1] - 1), (y == 1).sum() * (x.shape[1] - 1)
            slope[WIDTH:] += (seen - moved).ravel()
        slope = slope / lines - penalty * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))


def batch_marginals(gains: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Field.marginals for documents of equal length: (P(good), expected moves of all together)."""
    docs, n = gains.shape
    fore = np.zeros((n, docs, 2))
    fore[0, :, 1] = gains[:, 0]
    for k in range(1, n):
        fore[k] = np.logaddexp(fore[k - 1][:, :1] + moves[0], fore[k - 1][:, 1:] + moves[1])
        fore[k, :, 1] += gains[:, k]
    total = np.logaddexp(fore[-1, :, 0], fore[-1, :, 1])
    back = np.zeros((docs, 2))
    p, moved = np.zeros((docs, n)), np.zeros((2, 2))
    for k in range(n - 1, -1, -1):
        p[:, k] = np.exp(np.minimum(0, fore[k, :, 1] + back[:, 1] - total))
        if k:
            onward = back + np.stack([np.zeros(docs), gains[:, k]], axis=1)
            joint = fore[k - 1][:, :, None] + moves[None] + onward[:, None, :] - total[:, None, None]
            moved += np.exp(np.minimum(0, joint)).sum(axis=0)
            back = np.logaddexp(moves[:, 0] + onward[:, :1], moves[:, 1] + onward[:, 1:])
    return p, moved


def spread(rows: np.ndarray, most: int, runs: int = 4) -> np.ndarray:
    """rows, or where there are more than most, that many of them: runs of neighbours, evenly from the first row to the last."""
    if len(rows) <= most:
        return rows
    length = max(1, most // runs)
    begins = np.linspace(0, len(rows) - length, max(1, most // length)).astype(int)
    return rows[np.unique(begins[:, None] + np.arange(length))]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, most_lines: int = 400, steps: int = 400, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """labels: (doc_id, quality) rows to learn from. About sample_rows of their documents are used, chosen by hashes; of a
    sampled document of more lines about most_lines are learnt from, in four runs spread evenly over it (scoring always takes
    all)."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("string").alias("key")).agg(F.min("quality").cast("int").alias("y"))
    # hashes of ids choose the labels, so that at most 2 * sample_rows small rows are broadcast; those of ids and texts bound what
    # many rows of one id can add
    chosen = sample_of(labels.withColumn("mark", F.xxhash64("key")), "mark", sample_rows).drop("mark")
    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "key")
    rows = sample_of(rows.withColumn("mark", F.xxhash64("key", "text")), "mark", sample_rows)
    schema = T.StructType([T.StructField("mark", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("own", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [spread(own_features(t or "")[0], most_lines).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("y"), pa.array(own, pa.binary())], names=schema.names)

    found = sorted(rows.select("mark", "y", "text").mapInArrow(run, schema).collect(), key=lambda r: r["mark"])
    return fit([expand(np.frombuffer(r["own"], np.float32).reshape(-1, OWN).astype(float)) for r in found], [r["y"] for r in found], steps)


def score(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """(record, score): record is the input row."""
    packed = docs.select(F.struct(*docs.columns).alias("record"), F.col(text_col).alias("text"))
    schema = T.StructType([packed.schema["record"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [field.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(scores, pa.float64())], names=schema.names)

    return packed.mapInArrow(run, schema)
