"""The queries of the subpackage llm, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partweave.llm.components import number_groups
from partweave.llm.leakage import leaked_items
from partweave.llm.linkage import link
from partweave.llm.listings import product_groups, same_products
from partweave.llm.makers import read_makers
from partweave.llm.pii import find_pii, redact
from partweave.llm.tokens import encode_documents
from partweave.llm.topn import METHOD_ORDER, best_candidates
from partweave.sources.tables import table


def _catalogues(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, name) for name in ("store_items", "supplier_items", "line_code_mappings")]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return link(*_catalogues(spark, folder)).select("store_item_id", "supplier_item_id")


def p1_scored(spark: SparkSession, folder: str) -> DataFrame:
    return link(*_catalogues(spark, folder), threshold=0.0, checked=False)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_products(*_catalogues(spark, folder))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return product_groups(*_catalogues(spark, folder))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return number_groups(table(spark, folder, "interchanges"), table(spark, folder, "master_rules"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return best_candidates(table(spark, folder, "match_candidates")).select("match_candidate_id")


def _pii(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents")
    makers = read_makers(table(spark, folder, "line_code_mappings"))
    return documents, find_pii(documents, table(spark, folder, "name_list"), makers)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pii(spark, folder)[1].select("doc_id", "pii_kind", "start_char")


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redact(*_pii(spark, folder))


QUERIES = {
    "p1_found": p1_found,
    "p1_scored": p1_scored,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}

_METHODS = "[" + ", ".join(f"'{m}'" for m in METHOD_ORDER) + "]"

SQL = {
    "p3_found": """
WITH RECURSIVE said AS (
  SELECT merrill_part_number AS x, vendor_part_number AS y FROM interchanges
  UNION ALL SELECT store_part_number, supplier_part_number FROM master_rules WHERE enabled AND rule_type = 'POSITIVE_MAP'
), link AS (
  SELECT DISTINCT regexp_replace(upper(x), '[^A-Z0-9]', '', 'g') AS a, regexp_replace(upper(y), '[^A-Z0-9]', '', 'g') AS b
  FROM said WHERE regexp_matches(x, '[0-9]') AND regexp_matches(y, '[0-9]')
), edge AS (
  SELECT a, b FROM link WHERE a <> b UNION SELECT b, a FROM link WHERE a <> b
), reach(a, b) AS (
  SELECT a, a FROM edge UNION SELECT a, b FROM edge
  UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b
)
SELECT min(b) AS group_norm, a AS part_norm FROM reach GROUP BY a""",
    "p6_found": f"""
WITH newest AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, store_item_id DESC NULLS LAST, confidence DESC NULLS LAST, method DESC NULLS LAST) AS v FROM match_candidates
), ranked AS (
  SELECT id, row_number() OVER (PARTITION BY store_item_id ORDER BY confidence DESC,
           coalesce(nullif(list_position({_METHODS}, upper(trim(method))), 0), 99), id) AS r
  FROM newest WHERE v = 1 AND id IS NOT NULL AND store_item_id IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1
)
SELECT id AS match_candidate_id FROM ranked WHERE r <= 3""",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
