"""Strict reading of uploaded rows kept as text.

``strict_rows`` gives each raw row its cells if it is well formed in its file's format, and null if not: RFC 4180
for the file's delimiter, or a strictly valid JSON object.  It reads one row at a time, in Arrow batches, so it
needs no shuffle beyond the join with the file list.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.operators.skew import hot_keys, join_unique
from partweave.session import spread


@lru_cache(maxsize=64)
def _patterns(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    d = re.escape(delimiter)
    field = rf'(?:"(?:[^"]|"")*"|[^"{d}\r\n]*)'
    return re.compile(rf"{field}(?:{d}{field})*(?:\r?\n)?"), re.compile(rf'(?:^|{d})("(?:[^"]|"")*"|[^"{d}\r\n]*)')


def split_delimited(text: str, delimiter: str) -> list[str] | None:
    """The fields of one RFC 4180 record, or None if it is not one.  A line break may end the record."""
    whole, one = _patterns(delimiter)
    if not whole.fullmatch(text):
        return None
    if '"' not in text:
        return text.rstrip("\r\n").split(delimiter)
    return [f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in one.findall(text)]


def _refuse(name: str):
    raise ValueError(name)


def split_json(text: str) -> tuple[list[str], list[str | None]] | None:
    """Keys and cells of one strictly valid JSON object, or None.  Numbers keep their spelling; null stays null;
    nested values come as JSON text.  Texts nested too deeply to be read count as not valid."""
    try:
        pairs = json.loads(text, object_pairs_hook=_Pairs, parse_int=str, parse_float=str, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    if not isinstance(pairs, _Pairs):
        return None
    return [k for k, _ in pairs], [_cell(v) for _, v in pairs]


class _Pairs(list):
    """The pairs of a JSON object, told apart from an array."""


def _plain(value):
    if isinstance(value, _Pairs):
        return {k: _plain(v) for k, v in value}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _cell(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(_plain(value), ensure_ascii=False)


#: name of a column for comparison: trimmed, upper case
def column_name(name: str) -> str:
    return name.strip().upper()


SCHEMA = (
    "record string, id string, file_id string, row_format string, header array<string>, "
    "names array<string>, cells array<string>"
)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    headers: dict[tuple[str, str], list[str] | None] = {}
    for batch in batches:
        out: dict[str, list] = {"header": [], "names": [], "cells": []}
        for raw, fmt, delimiter, line in zip(batch["raw_data"], batch["row_format"], batch["field_delimiter"], batch["header_line"]):
            header = names = cells = None
            if fmt == "json":
                if (both := split_json(raw)) is not None:
                    names, cells = both
            else:
                delimiter = delimiter or ","
                if line is not None and (line, delimiter) not in headers:
                    parts = split_delimited(line, delimiter)
                    headers[line, delimiter] = [column_name(x) for x in (line.split(delimiter) if parts is None else parts)]
                header = headers.get((line, delimiter))
                cells = split_delimited(raw, delimiter)
                if cells is not None and header is not None and len(cells) == len(header):
                    names = header
            out["header"].append(header)
            out["names"].append(names)
            out["cells"].append(cells)
        yield batch[["record", "id", "file_id", "row_format"]].assign(**out)


def raw_offsets(items: DataFrame) -> DataFrame:
    """(record, id, file_id, raw_data): every raw row that is not null; ``record`` marks its place by the row's id,
    its file and its content, so a row delivered twice keeps one mark."""
    kept = items.select("id", "file_id", "raw_data").filter(F.col("raw_data").isNotNull())
    mark = F.concat_ws("|", F.coalesce("id", F.lit("?")), F.coalesce("file_id", F.lit("?")), F.hex(F.xxhash64("raw_data")))
    return kept.select(mark.alias("record"), "id", "file_id", "raw_data")


def strict_rows(items: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each raw row, with the columns of SCHEMA.

    ``cells`` is null if the row is not well formed.  ``names`` are the JSON keys as written, or the file's header
    (trimmed, upper case) if a delimited row has as many fields.  ``header`` is null for JSON.  A row whose file is
    unknown is read as JSON if it begins with a brace, else as comma-separated without a header.
    """
    offsets = spread(raw_offsets(items))
    about = files.select(F.col("id").alias("file_id"), "row_format", "field_delimiter", "header_line").dropDuplicates(["file_id"])
    per_file = items.filter("raw_data is not null and file_id is not null").groupBy("file_id").agg(F.count("*").alias("n"))
    hot = hot_keys(per_file, "n", items.count(), "file_id")
    joined = join_unique(offsets, about, "file_id", hot, "left")
    guess = F.when(F.ltrim(F.col("raw_data")).startswith("{"), "json").otherwise("delimited")
    return joined.withColumn("row_format", F.coalesce("row_format", guess)).mapInPandas(_read, SCHEMA)


def json_columns(rows: DataFrame) -> DataFrame:
    """(file_id, columns): the columns of each JSON file, which are the keys of more than half of its valid rows."""
    valid = rows.filter("row_format = 'json' and cells is not null").select("record", "file_id", "names")
    valid = valid.dropDuplicates(["record"]).withColumn("file_id", F.coalesce("file_id", F.lit("")))
    sizes = valid.groupBy("file_id").agg(F.count("*").alias("valid"))
    keys = valid.select("file_id", F.explode(F.array_distinct("names")).alias("key")).groupBy("file_id", "key").agg(F.count("*").alias("n"))
    common = keys.join(sizes, "file_id").filter("2 * n > valid")
    return common.groupBy("file_id").agg(F.sort_array(F.collect_list("key")).alias("columns"))


def with_columns_checked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fits``, whether they are well formed and their columns are the file's, and ``names`` trimmed and
    upper-cased.

    Only JSON rows meet the list of their file's columns; a file's list is joined with its rows, and a file that
    holds a large share of them is joined by broadcast."""
    json_rows = rows.filter("row_format = 'json'").withColumn("file_id", F.coalesce("file_id", F.lit("")))
    columns = json_columns(rows)
    per_file = json_rows.groupBy("file_id").agg(F.count("*").alias("n"))
    hot = hot_keys(per_file, "n", rows.count(), "file_id")
    known = join_unique(json_rows, columns, "file_id", hot, "left")
    same = F.coalesce(F.sort_array("names") == F.col("columns"), F.lit(False))
    a = known.withColumn("fits", F.col("cells").isNotNull() & same).drop("columns").withColumn(
        "names", F.transform("names", lambda n: F.upper(F.trim(n)))
    )
    a = a.withColumn("file_id", F.nullif("file_id", F.lit("")))
    b = rows.filter("row_format <> 'json'").withColumn("fits", F.col("cells").isNotNull() & (F.col("header").isNull() | F.col("names").isNotNull()))
    return a.unionByName(b)
