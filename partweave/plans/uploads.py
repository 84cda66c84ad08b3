"""Queries over the uploaded rows: what cannot be loaded (problem 2) and how schemas drift (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partweave.operators.drift import change_report, schema_drift, unified_rows
from partweave.operators.rejects import split_rows
from partweave.sources.headers import PATTERNS, ROLE_OF, ROLES
from partweave.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_rows(table(spark, folder, "store_items"), table(spark, folder, "files"))[1]


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return split_rows(table(spark, folder, "store_items"), table(spark, folder, "files"))[0].drop("record")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return change_report(schema_drift(table(spark, folder, "store_items"), table(spark, folder, "files")))


def p5_table(spark: SparkSession, folder: str) -> DataFrame:
    return unified_rows(schema_drift(table(spark, folder, "store_items"), table(spark, folder, "files"))).drop("record")


QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded, "p5_found": p5_found, "p5_table": p5_table}


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


#: DuckDB's regular expressions have no lookahead: of the patterns the words that must not stand there are told apart.
_SQL_PATTERNS = {
    "part_number": (PATTERNS["part_number"], "^$"),
    "cost": (r"\bCOST\b", r"CORE|EXT|TOTAL|DATE|FREIGHT|COST.*CODE"),
    "quantity": (r"\b(QTY|QUANTITY|ON HAND|ONHAND|QOH|OH|STOCK)\b", r"MIN|MAX|ORDER|PACK|SOLD|DATE|REORD|(QTY|QUANTITY|HAND|QOH|OH|STOCK).*(NUM|NO\b|#|CODE|ID)"),
    "usage": (r"\bUSAGE\b|\b12 *(MO|MON|MONTH|M)S?\b", "DATE"),
}


def _is(role: str) -> str:
    yes, no = _SQL_PATTERNS[role]
    return f"(list_contains({_list(ROLES[role])}, name) OR (NOT list_contains({_list(ROLE_OF)}, name) AND regexp_matches(name, '{yes}') AND NOT regexp_matches(name, '{no}')))"


_P2_ROWS = rf"""
WITH f AS (
  SELECT id AS file_id, row_format, field_delimiter AS d, header_line,
         '"(?:[^"]|"")*"|[^"' || CASE WHEN field_delimiter IN ('|') THEN '\|' ELSE field_delimiter END || '\r\n]*' AS fld,
         CASE WHEN field_delimiter = '|' THEN '\|' ELSE field_delimiter END AS q
  FROM files
), s AS (
  SELECT DISTINCT id, file_id, raw_data AS raw FROM store_items WHERE raw_data IS NOT NULL
), flat AS (
  SELECT s.id, raw, regexp_full_match(raw, '(?:' || fld || ')(?:' || q || '(?:' || fld || '))*') AS ok,
         regexp_extract_all(d || raw, q || '(' || fld || ')', 1) AS cells,
         list_transform(regexp_extract_all(d || header_line, q || '(' || fld || ')', 1), lambda x: upper(trim(x, ' "'))) AS names
  FROM s JOIN f USING (file_id) WHERE row_format = 'delimited'
), js AS (
  SELECT s.id, s.file_id, raw, CASE WHEN json_valid(raw) AND NOT regexp_matches(raw, ',\s*}}\s*$') THEN coalesce(json_type(raw) = 'OBJECT', false) ELSE false END AS ok FROM s JOIN f USING (file_id) WHERE row_format = 'json'
), jk AS (
  SELECT id, file_id, raw, list_sort(json_keys(CASE WHEN ok THEN raw ELSE '{{}}' END)) AS keys FROM js WHERE ok
), jc AS (
  SELECT file_id, list_sort(list(k)) AS cols
  FROM (SELECT file_id, k, count(*) AS n FROM (SELECT file_id, unnest(keys) AS k FROM jk) GROUP BY ALL)
  JOIN (SELECT file_id, count(*) AS m FROM jk GROUP BY ALL) USING (file_id) WHERE 2 * n > m GROUP BY file_id
), jcell AS (
  SELECT id, unnest(keys) AS k, raw FROM jk
), cell AS (
  SELECT id, upper(trim(k)) AS name, json_extract_string(raw, '$."' || k || '"') AS v FROM jcell
  UNION ALL
  SELECT id, unnest(names), unnest(list_transform(cells, lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END))
  FROM flat WHERE ok AND len(cells) = len(names)
), c AS (
  SELECT id, name, coalesce(trim(v, ' ' || chr(160) || chr(9) || chr(10) || chr(13)), '') AS v FROM cell
), badv AS (
  SELECT DISTINCT id FROM c WHERE
    ({_is("part_number")} AND (NOT regexp_matches(v, '[\p{{L}}\p{{N}}]') OR v LIKE '=%'
        OR regexp_full_match(v, '#(N/A|REF!|VALUE!|DIV/0!|NAME\?|NUM!|NULL!|SPILL!|CALC!|BLOCKED!|UNKNOWN!|FIELD!)')
        OR regexp_full_match(v, '[+-]?([0-9]+(\.[0-9]*)?[eE][+-][0-9]+|[0-9]+\.[0-9]*[eE][0-9]+)')))
    OR ({_is("cost")} AND v <> '' AND NOT regexp_full_match(v, '\$?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)(\.[0-9]*)?|\$?\.[0-9]+'))
    OR (({_is("quantity")} OR {_is("usage")}) AND v <> '' AND NOT regexp_full_match(v, '-?[0-9]+(\.0*)?'))
), structural AS (
  SELECT id, CASE WHEN NOT ok THEN 'quoting' WHEN len(cells) <> len(names) THEN 'column_count' END AS fault FROM flat
  UNION ALL
  SELECT js.id, CASE WHEN NOT js.ok THEN 'quoting' WHEN cols IS NULL OR jk.keys <> cols THEN 'column_count' END
  FROM js LEFT JOIN jk USING (id) LEFT JOIN jc ON jc.file_id = js.file_id
)
"""

SQL = {
    "p2_found": _P2_ROWS
    + """SELECT DISTINCT id AS store_item_id, coalesce(fault, 'value') AS reason
FROM structural WHERE fault IS NOT NULL OR id IN (SELECT id FROM badv)""",
}
