"""Rows that cannot be loaded, each with its reason (problem 2).

Method: strict load plus anti-join.  Every raw row has a mark that tells its place.  Only rows that conform in every
respect are loaded, into typed columns; the marks of the loaded rows are subtracted from all marks, and only the
remainder is diagnosed.  So a row that the reader should lose would still come out, as unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.session import Workspace
from partweave.sources.headers import has_role
from partweave.sources.rawrows import raw_offsets, strict_rows, with_columns_checked

#: Fixed patterns of cells (Java regular expressions over the trimmed cell).
COST = r"^\$?(\d+|\d{1,3}(,\d{3})+)(\.\d*)?$|^\$?\.\d+$"
WHOLE = r"^-?\d+(\.0*)?$"
EXPONENT = r"^[+-]?(\d+(\.\d*)?[eE][+-]\d+|\d+\.\d*[eE]\d+)$"
SHEET = r"^=|^#(N/A|REF!|VALUE!|DIV/0!|NAME\?|NUM!|NULL!|SPILL!|CALC!|BLOCKED!|UNKNOWN!|FIELD!)$"


def _trim(c: Column) -> Column:
    """Without white space at the ends, no-break spaces included."""
    return F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def _cells(role: str) -> Column:
    """The trimmed cells that stand under any header of a role."""
    both = F.arrays_zip(F.col("names").alias("name"), F.col("cells").alias("cell"))
    return F.transform(F.filter(both, lambda z: has_role(z["name"], role)), lambda z: F.coalesce(_trim(z["cell"]), F.lit("")))


def _bad_number(c: Column) -> Column:
    return ~c.rlike("[\\p{L}\\p{N}]") | c.rlike(EXPONENT) | c.rlike(SHEET)


def _bad_value() -> Column:
    """Whether any of the four checked values is not valid; a file without a header for a role is not checked for it."""
    return (
        F.exists(_cells("part_number"), _bad_number)
        | F.exists(_cells("cost"), lambda c: (c != "") & ~c.rlike(COST))
        | F.exists(_cells("quantity"), lambda c: (c != "") & ~c.rlike(WHOLE))
        | F.exists(_cells("usage"), lambda c: (c != "") & ~c.rlike(WHOLE))
    )


def _first(role: str) -> Column:
    return F.nullif(F.get(_cells(role), F.lit(0)), F.lit(""))


def load_rows(rows: DataFrame) -> DataFrame:
    """The conforming rows, typed: (record, id, file_id, part_number, description, line_code, cost, quantity, usage)."""
    good = rows.filter(F.col("fits") & ~F.coalesce(_bad_value(), F.lit(False)))
    whole = lambda role: F.regexp_replace(_first(role), r"\.0*$", "").try_cast("bigint")
    return good.select(
        "record",
        "id",
        "file_id",
        _first("part_number").alias("part_number"),
        _first("description").alias("description"),
        _first("line_code").alias("line_code"),
        F.regexp_replace(_first("cost"), "[$,]", "").try_cast("decimal(18,4)").alias("cost"),
        whole("quantity").alias("quantity"),
        whole("usage").alias("usage"),
    )


def diagnose(remainder: DataFrame, rows: DataFrame) -> DataFrame:
    """(record, id, reason) of raw rows that were not loaded, by what the strict reader made of them: nothing at all
    (unread), no cells (quoting), cells that are not the file's columns (column_count), else a bad value."""
    seen = rows.select("record", F.lit(True).alias("seen"), F.col("cells").isNotNull().alias("formed"), "fits")
    reason = F.when(F.col("seen").isNull(), "unread").when(~F.col("formed"), "quoting").when(~F.col("fits"), "column_count").otherwise("value")
    return remainder.join(seen, "record", "left").select("record", "id", reason.alias("reason"))


def split_rows(items: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loaded, rejected) of the uploaded rows.

    ``loaded`` is load_rows; ``rejected`` is (store_item_id, reason), the first reason that holds of quoting,
    column_count and value.  Rows without raw_data were keyed in by hand and are in neither.  A row delivered twice
    comes out once.  Empty tables give empty results; further columns of either table are ignored.
    """
    ws = Workspace(items.sparkSession, "rejects")
    rows = ws.save(with_columns_checked(ws.save(strict_rows(items, files), "strict")), "checked")
    loaded = load_rows(rows)
    remainder = raw_offsets(items).select("record", "id").join(loaded.select("record"), "record", "left_anti")
    rejected = diagnose(remainder, rows).select(F.col("id").alias("store_item_id"), "reason").distinct()
    return loaded.dropDuplicates(["record"]), rejected
