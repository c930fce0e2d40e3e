"""Which pages a crawl visits: breadth-first over the links of fetched pages, as one join for each level."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.functions import text as t
from corvid.session import shared_folder


def absolute(link: Column, base: Column) -> Column:
    """A link as a whole url, seen from the page at base."""
    scheme, host = F.regexp_extract(base, "^([a-z]+):", 1), F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), r"^([a-z]+://[^/]+/(?:.*/)?)", 1)
    whole = F.when(link.rlike("^[a-z]+:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
    return whole.when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(F.when(folder == "", F.concat(host, F.lit("/"))).otherwise(folder), link))


def crawl(pages: DataFrame, seeds: list[str], domains: list[str] | None = None, most: int = 50) -> DataFrame:
    """(url, depth, nth) of the pages that a crawl from seeds visits, in the order of the visits, `most` of them.

    pages: (url, links), each url once. A link that is no page of the table could not be fetched: it doesn't count. A page is
    visited where it is found first, by its parent's place and the link's place. A level holds `most` rows at most, so ranking
    it is bounded; the join with pages is all that is shuffled. Each level is checkpointed, so its plan doesn't grow.
    """
    spark = pages.sparkSession
    shared_folder(spark)
    known = pages.where(t.allowed_domain(F.col("url"), domains)) if domains else pages
    found = spark.createDataFrame([(u, 0, i) for i, u in enumerate(dict.fromkeys(seeds))], "url string, parent int, pos int")
    visited, held = None, 0
    for depth in itertools.count():
        best = found.groupBy("url").agg(F.min(F.struct("parent", "pos")).alias("at"))
        fresh = best if visited is None else best.join(visited.select("url"), "url", "left_anti")
        # by hash: most of a level's links may be new, or hardly any
        level = fresh.join(known.select("url", "links"), "url").orderBy("at", "url").limit(most - held)
        nth = F.row_number().over(Window.orderBy("at", "url")) - 1 + held  # `most` rows at most
        level = level.select("url", F.lit(depth).alias("depth"), nth.alias("nth"), "links").checkpoint()
        size = level.count()
        rows = level.select("url", "depth", "nth")
        visited, held = (rows if visited is None else visited.unionByName(rows)), held + size
        if not size or held >= most:
            break
        found = level.select(F.col("nth").alias("parent"), F.posexplode("links").alias("pos", "url"))
    return visited


def conditional(pages: DataFrame, stored: DataFrame, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """(*key, change, etag, links) of a conditional fetch: pages (*key, status, etag, links) as they answered now, stored (*key, etag,
    links) as they were. An unchanged page (same etag, or status 304) keeps its stored links, so that a crawl goes on below it; a
    page that failed keeps its stored state; nothing is ever deleted. key tells pages apart; of pages that may share their url it
    is more than the url."""
    old = stored.select(*key, F.col("etag").alias("_etag"), F.col("links").alias("_links"), F.lit(True).alias("_known"))
    joined = pages.join(old, list(key), "full_outer")
    same = (F.col("status") == 304) | ((F.col("status") == 200) & F.col("etag").isNotNull() & (F.col("etag") == F.col("_etag")))
    change = F.when(F.col("status").isNull(), "not_visited").when(F.col("_known") & same, "unchanged").when(F.col("status") != 200, "failed")
    change = change.when(F.col("_known"), "modified").otherwise("added")
    fresh = change.isin("added", "modified")
    return joined.select(*key, change.alias("change"), F.when(fresh, F.col("etag")).otherwise(F.col("_etag")).alias("etag"), F.when(fresh, F.col("links")).otherwise(F.col("_links")).alias("links"))
