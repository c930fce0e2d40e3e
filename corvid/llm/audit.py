"""Audit of how five filters interact: what each removes, alone and after the others, in each of their 120 orders.

Each document is read once and turned into a mask of the filters that it fails, by native expressions. Whether its text is that
of a smaller doc_id is told by grouping the texts' digests (SHA-256), with the smallest doc_id of each; only rows of texts that
occur again are shuffled for it. Masks are counted into a histogram of 32 cells a part, and everything about the orders follows
from these cells: a filter removes the cells that it fails and none of the earlier filters does.

Filters: A under 50 words; B fewer than 65 distinct words in 100; C more than 5 upper-case letters A-Z in 100 code points; D holds
one of #$%&*|; E the text of a smaller doc_id. Words are runs without ASCII white space, and case counts.

Edge cases: a null text is empty (and fails A only, or E too), a null source is the part ''. A null doc_id never fails E and has
no label; rows that repeat both id and text don't fail E by each other. A document with several label rows is good, or toxic, if
one of them says so. Very long texts are judged whole, by expressions that hold one text at a time. An empty table gives no
rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import matched, remove, shared_dir, written

FILTERS = "ABCDE"
#: The bit of E, which depends on other rows.
COPY = 1 << FILTERS.index("E")
CELLS = 1 << len(FILTERS)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTED = ("n", "good", "toxic")


def own_mask(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # a transform over a one-element array evaluates what is in it once
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    chars = F.length(text)
    fails = lambda n: [n["words"] < 50, n["distinct"] * F.lit(100).cast("long") < n["words"] * F.lit(65).cast("long"), (chars - F.length(F.translate(text, UPPER, ""))) * F.lit(100).cast("long") > chars * F.lit(5).cast("long"), text.rlike("[#$%&*|]")]
    return F.transform(F.array(sizes), lambda n: reduce(lambda a, b: a + b, [F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails(n))]))[0]


def masks(docs: DataFrame, labels: DataFrame, work: str) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail just the filters of mask, by label; n may be negative, and
    rows of one key add up."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), own_mask(text).alias("mask"), F.xxhash64(text).alias("mark"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = rows.join(marked, "doc_id", "left")
    rows = written(known.select("doc_id", "part", "mask", "mark", "digest", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")), f"{work}/masks")
    # combined before the shuffle, so a text that very many rows have is one row of each task
    texts = written(rows.groupBy("mark", "digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), f"{work}/texts")
    again = matched(rows, ["mark", "digest"], texts, rows.count()).where("doc_id > first")
    moved = again.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.lit(-1).alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), F.lit(1).alias("n")))).alias("x"))
    return rows.select("part", "good", "toxic", "mask", F.lit(1).alias("n")).unionByName(moved.select("part", "good", "toxic", "x.mask", "x.n"))


def cells(masked: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows a part, whatever the number of documents."""
    n = F.col("n").cast("long")
    return masked.groupBy("part", "mask").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def by_mask(count: str) -> Column:
    """The counts of a part's cells as an array, at the place of their mask."""
    held = F.map_from_entries(F.collect_list(F.struct("mask", count)))  # 32 entries at most
    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: F.coalesce(F.try_element_at(held, m), F.lit(0).cast("long")))


def orders(counted: DataFrame) -> DataFrame:
    """The audit's rows, one for each part, order and step, from the cells."""
    # (filter bit, bits of the filters before it): 80 pairs, which the 600 steps of all orders share
    per_part = counted.groupBy("part").agg(*[by_mask(c).alias(c) for c in COUNTED])
    own = F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), lambda k: F.call_function("shiftleft", F.lit(1), k)))
    before = F.explode(F.filter(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: m.bitwiseAND(F.col("own")) == 0))
    pairs = per_part.withColumn("own", own).withColumn("before", before)

    def over(counts: str, holds) -> Column:
        """The sum of counts over the masks of which holds is true."""
        masked = F.transform(F.col(counts), lambda n, m: F.when(holds(m), n).otherwise(F.lit(0).cast("long")))
        return F.aggregate(masked, F.lit(0).cast("long"), lambda s, n: s + n)

    fails, earlier = lambda m: m.bitwiseAND(F.col("own")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~earlier(m)
    # a document that fails k filters meets a given one of them first in 120 / k of the orders
    share = F.transform(F.col("n"), lambda n, m: F.when(fails(m), n * (F.lit(120) / F.greatest(F.bit_count(m), F.lit(1))).cast("long")).otherwise(F.lit(0).cast("long")))
    told = pairs.select(
        "part", "own", "before",
        over("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"), over("n", removed).alias("removed"), over("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        over("n", lambda m: m == F.col("own")).alias("unique_fails"), over("good", removed).alias("good_lost"), over("toxic", removed).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda s, n: s + n).alias("shapley"),
    )
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [("".join(p), k + 1, bit[p[k]], sum(bit[f] for f in p[:k])) for p in permutations(FILTERS) for k in range(len(FILTERS))]
    each = counted.sparkSession.createDataFrame(steps, "filter_order string, step int, own int, before int")
    return told.join(F.broadcast(each), ["own", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")  # 600 rows


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction audit of docs (doc_id, text, source) with labels (doc_id, quality, toxic)."""
    work = shared_dir(docs.sparkSession)
    counted = written(cells(masks(docs, labels, work)), f"{work}/cells")
    remove(docs.sparkSession, f"{work}/masks", f"{work}/texts")
    return orders(counted)
