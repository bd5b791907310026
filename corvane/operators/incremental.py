"""Keyed tables over time: change sets, merges, retention, reuse by content, inheritance between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_set(before: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): new, modified, deleted or unchanged, by one full outer join."""
    a = before.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_was"))
    b = now.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_is"))
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, of the highest version; at equal versions the fresh row. Keys are compared null-safely by grouping."""
    rows = stored.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(version, "_fresh", *[c for c in rest if c not in (version, "_fresh")])).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}") for c in stored.columns])


def insert_missing(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows, and the fresh ones whose key is not stored."""
    return stored.unionByName(fresh.join(stored.select(*keys).distinct(), keys, "left_anti"))


def accumulate(stored: DataFrame, fresh: DataFrame, keys: list[str], count: str, seen: str) -> DataFrame:
    """Counts added up per key, with the latest sighting."""
    rows = stored.select(*keys, count, seen).unionByName(fresh.select(*keys, count, seen))
    return rows.groupBy(*keys).agg(F.sum(count).alias(count), F.max(seen).alias(seen))


def without_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def patched(df: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the columns that ``updates`` gives for their key; a null there changes nothing."""
    new = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(new, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def recent(df: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` before ``now``."""
    return df.where(F.col(time) >= now - F.expr(f"interval {int(days)} days"))


def keep_last(df: DataFrame, n: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The last ``n`` rows, of each group if ``by`` is given."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def reuse(fresh: DataFrame, cached: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Fresh rows with the value cached for their keys, null where it must be made anew; of several cached the smallest."""
    known = cached.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(value))
    return fresh.join(known, keys, "left")


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def inherit(child: DataFrame, parents: DataFrame, gone: DataFrame, path: str = "path", order: str = "parent_no") -> DataFrame:
    """Files of a snapshot: its own, and those of its parents in order that it neither changed nor deleted.

    ``parents`` has the columns of ``child`` and ``order``; the first parent that has a path gives it.
    """
    left = parents.join(child.select(path).distinct(), path, "left_anti").join(gone.select(path).distinct(), path, "left_anti")
    rest = [c for c in child.columns if c != path]
    first = left.groupBy(path).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(path, *[F.col(f"r.{c}").alias(c) for c in rest])
    return child.unionByName(first.select(*child.columns))


def pending(df: DataFrame, state: str, step: str) -> DataFrame:
    """Rows whose state map does not say 'complete' for a step; a missing entry is pending."""
    return df.where(F.coalesce(F.try_element_at(F.col(state), F.lit(step)), F.lit("")) != "complete")


def stale(df: DataFrame, known: DataFrame, key: str, time: str, now: Column, hours: int) -> DataFrame:
    """Keys that were never fetched, or longer than ``hours`` ago."""
    joined = df.select(key).distinct().join(known.groupBy(key).agg(F.max(time).alias("_t")), key, "left")
    return joined.where(F.col("_t").isNull() | (F.col("_t") < now - F.expr(f"interval {int(hours)} hours"))).select(key)


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One digest of a set of rows, whatever their order: a sum of hashes, so that nothing is gathered."""
    h = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum"))
