"""The best N rows of every group (problem 6).

Method: ``row_number`` over a window ordered by score, rank and identifier, with a filter on the rank.  Spark's
WindowGroupLimit then keeps at most N rows of a group in each task before the shuffle and again after it, so a
group of any size costs its own tasks only N rows of shuffle each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed ranking of matching methods; whatever is not named here comes after, as equals.
METHOD_ORDER = [
    "MASTER_RULE",
    "INTERCHANGE",
    "EXACT_NORM",
    "EXACT_NORMALIZED",
    "LINE_PN",
    "DESC_SIM",
    "FUZZY",
    "FUZZY_SUBSTRING",
    "AI",
    "WEB_SEARCH",
    "RULE_BASED",
    "SUPERSESSION",
    "HUMAN_REVIEW",
]


def method_rank(method: Column) -> Column:
    """Place of a method in METHOD_ORDER, from 0; null and unknown methods share the place after the last."""
    place = F.array_position(F.lit(METHOD_ORDER), F.upper(F.trim(method)))
    return F.coalesce(F.when(place > 0, place - 1), F.lit(len(METHOD_ORDER))).cast("int")


def latest_versions(rows: DataFrame, id_col: str, version_col: str, keep: list[str]) -> DataFrame:
    """One row for each id: the one with the greatest version (a null version is the least; rows equal in it are
    told apart by the kept columns, so the choice does not depend on the order of delivery).  A maximum over a
    struct is combined before the shuffle, so repeated deliveries of one id never meet in one task as rows."""
    cols = [F.col(c) for c in keep]
    newest = rows.groupBy(id_col).agg(F.max(F.struct(F.col(version_col).alias("_version"), *cols)).alias("_newest"))
    return newest.select(id_col, *[F.col(f"_newest.{c}").alias(c) for c in keep])


def top_n(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each value of ``group`` by ``order``, which must be a total order; ``_rank`` from 1."""
    window = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)


def best_candidates(candidates: DataFrame, n: int = 3) -> DataFrame:
    """(match_candidate_id, store_item_id, confidence, method, rank): the best ``n`` candidates of each store item.

    Of each id only the newest version counts.  A confidence that is null, NaN or outside 0..1 leaves the id out;
    so does a null id or a null store_item_id, which names no store item.  Ties are broken by method, then id.
    Other columns are ignored; an empty table gives an empty result.
    """
    newest = latest_versions(
        candidates.filter(F.col("id").isNotNull()), "id", "updated_at", ["store_item_id", "confidence", "method"]
    )
    usable = newest.filter(
        F.col("store_item_id").isNotNull()
        & F.col("confidence").isNotNull()
        & ~F.isnan("confidence")
        & F.col("confidence").between(0.0, 1.0)
    )
    order = [F.col("confidence").desc(), method_rank(F.col("method")).asc(), F.col("id").asc()]
    return top_n(usable, "store_item_id", order, n).select(
        F.col("id").alias("match_candidate_id"),
        "store_item_id",
        "confidence",
        "method",
        F.col("_rank").alias("rank"),
    )
