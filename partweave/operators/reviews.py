"""Decisions on candidates as append-only versions, what is exported for them and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partweave.operators.matching import once
from partweave.operators.rules import check_reviews, join_items, newest

#: Columns of the review export, and those that the filtered export leaves out.
EXPORT_COLUMNS = [
    "match_id", "project_id", "status", "method", "confidence", "store_part_number", "store_line_code", "store_description", "store_cost",
    "supplier_part_number", "supplier_line_code", "supplier_description", "supplier_cost", "vendor_action", "review_decision", "corrected_supplier_part",
]
COSTS = ["store_cost", "supplier_cost"]
_KEPT = ["project_id", "store_item_id", "target_type", "target_id", "method", "confidence", "status", "vendor_action"]


def with_targets(candidates: DataFrame, stores: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Candidates with their store row and, where the target is a row of the catalogue, the supplier row.  A target of the
    inventory, one found on the web or a mere interchange has no supplier row."""
    s = once(stores).select(
        F.col("id").alias("store_item_id"), F.col("part_number").alias("store_part_number"), F.col("line_code").alias("store_line_code"),
        F.col("description").alias("store_description"), F.col("current_cost").alias("store_cost"),
    )
    u = once(suppliers).select(
        F.col("id").alias("supplier_id"), F.col("part_number").alias("supplier_part_number"), F.col("line_code").alias("supplier_line_code"),
        F.col("description").alias("supplier_description"), F.col("current_cost").alias("supplier_cost"),
    )
    ours = (F.col("target_type") == "SUPPLIER") & ~F.col("target_id").startswith("WEB_")
    return join_items(join_items(candidates, s, "store_item_id").withColumn("supplier_id", F.when(ours, F.col("target_id"))), u, "supplier_id")


def export_rows(candidates: DataFrame, stores: DataFrame, suppliers: DataFrame) -> DataFrame:
    """EXPORT_COLUMNS of every candidate's newest version, the reviewer's columns empty."""
    full = with_targets(newest(candidates, *_KEPT), stores, suppliers).withColumnRenamed("id", "match_id")
    usable = F.when(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.col("confidence"))
    return full.withColumn("confidence", usable).withColumns({"review_decision": F.lit(""), "corrected_supplier_part": F.lit("")}).select(*EXPORT_COLUMNS)


def filtered_export(rows: DataFrame, status: str | None = None, method: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The export without costs, of one status, one method or chosen ids (a table with match_id); what is not given, or
    "all", does not filter."""
    if status and status != "all":
        rows = rows.filter(F.col("status") == status.upper())
    if method and method != "all":
        rows = rows.filter(F.col("method") == method)
    if ids is not None:
        rows = rows.join(ids.select("match_id").distinct(), "match_id", "left_semi")
    return rows.drop(*COSTS)


def decision_history(candidates: DataFrame) -> DataFrame:
    """(id, before, status, updated_at): each version of a candidate that changes its status to a decision."""
    versions = candidates.filter("id is not null and updated_at is not null").groupBy("id", "updated_at").agg(F.max("status").alias("status"))
    before = F.lag("status").over(Window.partitionBy("id").orderBy("updated_at"))
    return versions.withColumn("before", before).filter(F.col("status").isin("CONFIRMED", "REJECTED") & ~F.col("status").eqNullSafe(F.col("before"))).select("id", "before", "status", "updated_at")


def unmatched_projects(candidates: DataFrame) -> DataFrame:
    """(project_id, removed, kept): what undoing the matches of each project removes; confirmed ones stay."""
    c = newest(candidates, "project_id", "status")
    confirmed = F.coalesce(F.col("status") == "CONFIRMED", F.lit(False))
    return c.groupBy("project_id").agg(F.count(F.when(~confirmed, 1)).alias("removed"), F.count(F.when(confirmed, 1)).alias("kept"))


def decide(candidates: DataFrame, ids: DataFrame, status: str, decided_by: str) -> DataFrame:
    """New versions (id, status, decided_by, decided_at) of the candidates in ``ids`` (a table with id), to be appended;
    ids that no candidate has give none."""
    if status not in ("CONFIRMED", "REJECTED"):
        raise ValueError("a decision is CONFIRMED or REJECTED")
    known = newest(candidates, "status").join(ids.select("id").distinct(), "id", "left_semi")
    return known.select("id", F.lit(status).alias("status"), F.lit(decided_by).alias("decided_by"), F.current_timestamp().alias("decided_at"))


def import_reviews(reviews: DataFrame, candidates: DataFrame, all_or_nothing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of review rows; with ``all_or_nothing`` one refused row refuses all."""
    checked = check_reviews(reviews, candidates)
    accepted, refused = checked.filter("error is null"), checked.filter("error is not null")
    if all_or_nothing and not refused.isEmpty():
        return accepted.limit(0), refused.unionByName(accepted.withColumn("error", F.lit("another row was refused")))
    return accepted, refused
