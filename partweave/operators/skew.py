"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partweave.session import Workspace

#: A key is hot when it holds more than one part in HOT_SHARE of the rows; so at most HOT_SHARE keys are hot,
#: which bounds what is broadcast for them.
HOT_SHARE = 1000
#: Below so many rows a key is never called hot: one task handles them anyway.
HOT_LEAST = 100_000


def hot_threshold(total: int, share: int = HOT_SHARE, least: int = HOT_LEAST) -> int:
    """Rows from which a key counts as hot, given the number of rows."""
    return max(least, total // share)


def join_unique(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, how: str = "left") -> DataFrame:
    """Join ``left`` with ``right``, whose ``key`` is unique, without sending a hot key's rows to one task.

    ``hot`` has the column ``key`` and one row for each hot key (at most HOT_SHARE, see hot_threshold), or is
    None if no key is hot.  Rows of hot keys meet a broadcast of the hot part of ``right`` where they are; the
    others are shuffled by the key as usual.  ``how`` is "left" or "inner".  The result equals the plain join.
    """
    if hot is None:
        return left.join(right, key, how)
    hot = F.broadcast(hot.select(key))
    cold_rows = left.join(hot, key, "left_anti").join(right, key, how)
    hot_rows = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
    return cold_rows.unionByName(hot_rows)


def hot_keys(counted: DataFrame, count_col: str, total: int, key: str) -> DataFrame | None:
    """The hot keys of a table with one row and one count a key; None if there is none, which takes no job where the
    total itself is too small."""
    if total <= hot_threshold(total):
        return None
    hot = counted.filter(F.col(count_col) > hot_threshold(total)).select(key)
    return None if hot.isEmpty() else hot


def heavy_keys(rows: DataFrame, key: Column, least: int = HOT_LEAST) -> tuple[DataFrame | None, int]:
    """(_h, _n) of the hash keys that are hot among ``rows``, or None, and the threshold.  One aggregation, combined
    before the shuffle; at most HOT_SHARE rows come of it."""
    seen = Observation(f"keys-{uuid.uuid4().hex}")
    counted = rows.filter(key.isNotNull()).groupBy(key.alias("_h")).agg(F.count("*").alias("_n")).observe(seen, F.sum("_n").alias("total"))
    saved = Workspace(rows.sparkSession, "heavy").save(counted.filter(F.col("_n") > least), "keys")
    limit = hot_threshold(seen.get["total"] or 0, least=least)
    hot = saved.filter(F.col("_n") > limit)
    return (None if hot.isEmpty() else hot), limit


def split_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, least: int = HOT_LEAST) -> DataFrame:
    """The inner join of ``left`` and ``right`` on ``keys``, in which no task meets a whole hot key.

    Where a key is hot on either side, its rows of each side are cut into parts by a hash of their id, and every part
    of the one meets every part of the other in a cell of its own.  A cell holds about as many rows of each side as a
    key may have without being hot.  The result equals the plain join.  ``left`` and ``right`` are read twice, so
    costly ones should be staged first."""
    h = F.xxhash64(*keys)
    (hot_left, limit_left), (hot_right, limit_right) = heavy_keys(left, h, least), heavy_keys(right, h, least)
    if hot_left is None and hot_right is None:
        return left.join(right, keys)
    cut = lambda hot, limit, name: hot.select("_h", F.ceil(F.col("_n") / limit).cast("int").alias(name))
    none = left.sparkSession.createDataFrame([], "_h bigint, _n bigint")
    parts = cut(none if hot_left is None else hot_left, limit_left, "_a").join(cut(none if hot_right is None else hot_right, limit_right, "_b"), "_h", "full")
    parts = F.broadcast(parts.select("_h", F.coalesce("_a", F.lit(1)).alias("_a"), F.coalesce("_b", F.lit(1)).alias("_b")))

    def cells(side: DataFrame, own: str, other: str, key: str) -> DataFrame:
        known = side.withColumn("_h", h).join(parts, "_h", "left")
        place = F.coalesce(F.pmod(F.xxhash64(key), F.col(own)).cast("int"), F.lit(0))
        known = known.withColumn(f"{own}_at", place).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
        return known.drop("_h", "_a", "_b")

    met = cells(left, "_a", "_b", left_id).join(cells(right, "_b", "_a", right_id), [*keys, "_a_at", "_b_at"])
    return met.drop("_a_at", "_b_at")


def numbered(rows: DataFrame, scope: str, order: str, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, within their scope in order of the unique column ``order``.

    Rows are sorted in ranges, numbered within each range, and a range begins where the ranges of its scope before it
    end; so a scope of any size is spread over many tasks.  The ranges are written down before they are counted."""
    ws = Workspace(rows.sparkSession, "numbered")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ws.save(rows.repartitionByRange(parts, scope, order).withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(scope).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(scope, "_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(scope, "_range").orderBy(order)) - 1
    known = ranged.withColumn("_inside", inside).join(starts.select(scope, "_range", "_start"), [scope, "_range"])
    return known.withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")
