"""Change detection between an old and a new listing, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def diff(old: DataFrame, new: DataFrame, key: str = "path", fingerprint: str = "fingerprint") -> DataFrame:
    """(path, change): added, modified, deleted or unchanged."""
    o = old.select(key, F.col(fingerprint).alias("_old"), F.lit(True).alias("_had"))
    n = new.select(key, F.col(fingerprint).alias("_new"), F.lit(True).alias("_has"))
    change = F.when(F.col("_had").isNull(), "added").when(F.col("_has").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, size, inode, sha1): like diff for files. Contents decide only where size or time differ: same hash, only touched."""
    o = old.select("path", F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"), F.col("inode").alias("o_inode"), F.col("sha1").alias("o_sha1"), F.col("status").alias("o_status"))
    n = new.select("path", F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime"), F.col("inode").alias("n_inode"), F.col("sha1").alias("n_sha1"))
    same = (F.col("o_size") == F.col("n_size")) & (F.col("o_mtime") == F.col("n_mtime")) & (F.col("o_status") == "indexed")
    change = F.when(F.col("o_size").isNull(), "added").when(F.col("n_size").isNull(), "deleted").when(same, "unchanged").when(F.col("o_sha1") == F.col("n_sha1"), "touched").otherwise("modified")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"), F.coalesce("n_size", "o_size").alias("size"), F.coalesce("n_inode", "o_inode").alias("inode"), F.coalesce("n_sha1", "o_sha1").alias("sha1"))


def renames(changes: DataFrame) -> DataFrame:
    """(path, old_path, reason): added files paired with deleted ones by inode and size, the rest by content. Each is used once;
    paths are paired in order."""

    def paired(added: DataFrame, deleted: DataFrame, keys: list[str], reason: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("path"))
        a = added.select("path", *keys, nth.alias("_n"))
        d = deleted.select(F.col("path").alias("old_path"), *keys, nth.alias("_n"))
        return a.join(d, [*keys, "_n"]).select("path", "old_path", F.lit(reason).alias("reason"))

    added, deleted = (changes.where(F.col("change") == c) for c in ("added", "deleted"))
    first = paired(added, deleted, ["inode", "size"], "inode")
    rest = added.join(first.select("path"), "path", "left_anti")
    gone = deleted.join(first.select(F.col("old_path").alias("path")), "path", "left_anti")
    return first.unionByName(paired(rest, gone, ["sha1"], "sha1"))


def gated(changes: DataFrame, detection: str, incremental: bool) -> DataFrame:
    """Without a full listing a missing object isn't a deleted one."""
    return changes.where("change <> 'deleted'") if incremental or detection == "never" else changes


def merged(old: DataFrame, seen: DataFrame, key: str, since: bool) -> DataFrame:
    """The next state: what was seen, over the old one if only what is newer was listed."""
    return seen.unionByName(old.join(seen, key, "left_anti")) if since else seen


def manifest_diff(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """(path, action): upload where size or time differ, delete_candidate where the manifest lacks a known file."""
    m = manifest.select("path", F.col("size").alias("m_size"), F.col("mtime").alias("m_mtime"))
    s = state.select("path", F.col("size").alias("s_size"), F.col("mtime").alias("s_mtime"))
    action = F.when(F.col("m_size").isNull(), "delete_candidate").when((F.col("m_size") == F.col("s_size")) & (F.col("m_mtime") == F.col("s_mtime")), "keep").otherwise("upload")
    return m.join(s, "path", "full_outer").select("path", action.alias("action"))


def replayed(state: DataFrame) -> DataFrame:
    """Rows of an uploaded state as changes."""
    change = F.when(F.col("status") == "deleted", "deleted").when(F.col("renamed_from").isNotNull(), "renamed").when(F.col("status") == "staged", "modified")
    return state.select("path", F.col("renamed_from").alias("old_path"), change.alias("change")).where("change is not null")


def table_fingerprint(df: DataFrame, cursor: str | None) -> Column | DataFrame:
    """One row: count and, where there is one, the largest cursor."""
    top = F.max(F.col(cursor)).cast("string") if cursor else F.lit("")
    return df.agg(F.concat(F.count("*").cast("string"), F.lit("|"), F.coalesce(top, F.lit(""))).alias("fingerprint"))


def schema_fingerprint(df: DataFrame) -> str:
    return ";".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
