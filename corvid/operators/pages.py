"""Pages of a table in a total order, of which only the ranges that a page lies in are read.

One pass over the key alone cuts the table into ranges of its first key column and counts them; a page then knows from the counts
in which ranges its rows are, and its filter on the key reaches the scan: the row groups, files or predicates of a database that
hold these ranges. A value that very many rows share is one range with exact bounds; within it a page sorts that range.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a range, about, and most ranges.
RANGE_ROWS, MOST_RANGES = 100_000, 20_000


class RangePages:
    """rows: a table or a scan that takes filters; by: its total order, ascending with nulls first."""

    def __init__(self, rows: DataFrame, by: list[str], range_rows: int = RANGE_ROWS):
        self.rows, self.by, self.first = rows, by, by[0]
        keys = rows.select(self.first)
        nulls, n = keys.agg(F.count_if(F.col(self.first).isNull()), F.count("*")).first()
        parts = max(1, min(MOST_RANGES, -(-(n - nulls) // range_rows)))
        # the key alone moves, and what comes back is a row for each range
        dealt = keys.where(F.col(self.first).isNotNull()).repartitionByRange(parts, self.first)
        found = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(self.first).alias("low"), F.max(self.first).alias("high"), F.count("*").alias("n")).orderBy("part").collect()
        #: (lowest key, highest key, rows) in order; a range of nulls has None twice
        self.ranges = ([(None, None, nulls)] if nulls else []) + [(r["low"], r["high"], r["n"]) for r in found]
        self.ends = list(accumulate(r[2] for r in self.ranges))

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def holding(self, begin: int, end: int) -> list[int]:
        """The ranges in which the rows [begin, end) are."""
        begin, end = max(begin, 0), min(end, len(self))
        return list(range(bisect.bisect_right(self.ends, begin), bisect.bisect_left(self.ends, end) + 1)) if begin < end else []

    def within(self, chosen: list[int]) -> Column:
        """A filter on the first key column for neighbouring ranges."""
        known = [self.ranges[k] for k in chosen if self.ranges[k][0] is not None]
        key = F.col(self.first)
        inside = key.between(F.lit(known[0][0]), F.lit(known[-1][1])) if known else F.lit(False)
        return inside | key.isNull() if len(known) < len(chosen) else inside

    def page(self, begin: int, end: int) -> DataFrame:
        """The rows [begin, end) in order."""
        chosen = self.holding(begin, end)
        if not chosen:
            return self.rows.limit(0)
        before = self.ends[chosen[0] - 1] if chosen[0] else 0
        return self.rows.where(self.within(chosen)).orderBy(*self.by).offset(max(begin, 0) - before).limit(min(end, len(self)) - max(begin, 0))
