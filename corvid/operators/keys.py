"""Which columns tell the records of a table apart, found from the data where no catalog says it."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def primary_key(records: DataFrame, most: int = 2) -> list[str]:
    """The first column, in the schema's order, or else the first pair of columns (up to `most` together), without nulls and
    repeats; none: an empty list. One pass estimates distinct values; only what may be a key is counted exactly."""
    plain = [f.name for f in records.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant", "binary")]
    facts = records.agg(F.count("*").alias("n"), *[F.struct(F.approx_count_distinct(c, 0.02).alias("d"), F.count(c).alias("k")).alias(f"c{i}") for i, c in enumerate(plain)]).first()
    n = facts["n"]
    full = [c for i, c in enumerate(plain) if facts[f"c{i}"]["k"] == n]
    about = {c: facts[f"c{i}"]["d"] for i, c in enumerate(plain)}
    for size in range(1, most + 1):
        for names in combinations(full, size):
            room = 1.0
            for c in names:
                room *= about[c]
            if room >= 0.9 * n and (size == 1 or not any(about[c] >= 0.9 * n for c in names)) and not records.groupBy(*names).count().where("count > 1").limit(1).count():
                return list(names)
    return []
