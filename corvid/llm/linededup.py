"""Substring de-duplication by hashed lines and sentences.

A text is cut into units that tile it: at line ends and, by default, after sentence ends as well, so that a passage is found
wherever it stands in a line. A unit is normalised (Unicode case and white space folded), and the digests of all units of the
corpus are grouped. Of each digest the earliest occurrence, by document and position, stays. Later ones are removed where
neighbouring repeated units make a run of min_chars characters or more, so that a stock phrase alone costs a document nothing;
min_chars=0 removes every repeat. Characters count in every script, whether it parts words or not. Where removed units stood is
kept as character offsets of the original text.

Only digests move: the group that a common line makes is folded before the shuffle; the few digests that make up more than a
thousandth of all units are joined by broadcast (there can't be more than a thousand of them); texts that lose nothing aren't
shuffled.

Edge cases: a null text stays null and has no unit; blank units are never removed and don't end a run. Repeated rows (same
doc_id) are ranked by their text after their id, and of equal rows all but one lose their units. A null doc_id ranks last. A
very long text is cut like any other, and its units spread over all tasks. An empty table gives an empty result. Other columns
of the input are carried along in the column `record`, so names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import matched, remove, shared_dir, sifted, written

#: Where units end.
LINES, PARAGRAPHS = r"(?<=\n)", r"(?<=\n\n)"
SENTENCES = r"(?<=\n)|(?<=[.!?] )|(?<=[。！？])"


def removable(repeated: list[tuple[int, int]], blank: list[bool], min_chars: int) -> list[int]:
    """Positions of the repeated (position, characters) whose run has min_chars or more; blank units don't end a run."""
    out: list[int] = []
    run: list[int] = []
    held, last = 0, -2
    for pos, chars in [*sorted(repeated), (len(blank) + 1, 0)]:
        if not all(blank[last + 1 : pos]) or last < 0 or pos > len(blank):
            out += run if held >= min_chars else []
            run, held = [], 0
        run.append(pos)
        held, last = held + chars, pos
    return out


def remove_repeats(docs: DataFrame, min_chars: int = 160, units: str = SENTENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(record, text, n_units, n_removed, removed): record is the input row; removed lists (start, length) in characters."""
    work = shared_dir(docs.sparkSession)
    # row numbers tell rows apart that share a doc_id; they are in a written table, so they never change
    rows = written(docs.select(F.struct(*docs.columns).alias("record"), F.monotonically_increasing_id().alias("row")), f"{work}/rows")
    text = F.col("record")[text_col]
    cut_up = rows.select("row", F.col("record")[id_col].alias("doc"), F.hash(text).alias("tie"), F.posexplode(F.split(text, units)).alias("pos", "unit"))
    # most units have single blanks only, which needs no regular expression
    odd = reduce(Column.__or__, [F.col("unit").contains(c) for c in ("  ", "\t", "\r", "\f", "\v")])
    plain = F.btrim(F.lower("unit"), F.lit(" \n"))
    folded = F.when(odd, F.trim(F.regexp_replace(F.lower("unit"), r"\s+", " "))).otherwise(plain)
    cut_up = cut_up.select("row", "doc", "tie", "pos", folded.alias("folded")).where(F.length("folded") > 0)
    hashed = cut_up.select("row", F.coalesce("doc", F.lit(2**63 - 1)).alias("doc"), "tie", "pos", F.length("folded").alias("chars"), F.xxhash64(F.lit(1), "folded").alias("h1"), F.hash("folded").alias("h2"))
    hashed = written(hashed, f"{work}/units")
    place = F.struct("doc", "tie", "row", "pos")
    digest = ["h1", "h2"]
    first = written(hashed.groupBy(*digest).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), f"{work}/first")
    repeats = matched(hashed, digest, first, hashed.count()).where(place != F.col("first"))
    # texts whose repeats are too short taken together lose nothing; the exact runs are told with the text at hand
    losing = repeats.groupBy("row").agg(F.collect_list(F.struct("pos", "chars")).alias("repeated"), F.sum("chars").alias("chars")).where(F.col("chars") >= min_chars).drop("chars")
    losing = written(losing, f"{work}/losing")
    remove(docs.sparkSession, f"{work}/units", f"{work}/first")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    schema = T.StructType([rows.schema["record"], T.StructField("text", T.StringType()), T.StructField("n_units", T.IntegerType()), T.StructField("n_removed", T.IntegerType()), T.StructField("removed", T.ArrayType(span))])
    told = sifted(rows, "row", losing.select("row"))
    touched = told.where("maybe").select("record.*").join(losing, "row", "left").select("record", text.alias("text"), F.coalesce("repeated", F.array().cast(losing.schema["repeated"].dataType)).alias("repeated"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = re.compile(units)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for old, repeated in zip(batch.column("text").to_pylist(), batch.column("repeated").to_pylist(), strict=True):
                pieces = [] if old is None else ends.split(old)
                blank = [not p.strip(" \t\n\v\f\r") for p in pieces]
                lost = set(removable([(r["pos"], r["chars"]) for r in repeated], blank, min_chars))
                spans, at = [], 0
                for i, piece in enumerate(pieces if lost else ()):
                    if i in lost:
                        spans.append({"start": at, "length": len(piece)})
                    at += len(piece)
                new = "".join(p for i, p in enumerate(pieces) if i not in lost) if lost else old
                for column, value in zip(out, (new, len(pieces), len(lost), spans), strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("record"), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=schema.names)

    whole = told.where("not maybe").select("record.record")
    pieces = F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(units)) + 1)
    whole = whole.select("record", text.alias("text"), pieces.alias("n_units"), F.lit(0).alias("n_removed"), F.array().cast(schema["removed"].dataType).alias("removed"))
    return whole.union(touched.mapInArrow(cut, schema))
