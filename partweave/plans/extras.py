"""Further joins and reports over the candidates and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.functions.text import digit_core, norm_canonical, norm_stored
from partweave.operators.matching import first_by, once
from partweave.operators.rules import line_code_map, newest
from partweave.operators.skew import split_join
from partweave.plans.reports import _LINES, _newest
from partweave.plans.sqltext import sql_canonical, sql_stored
from partweave.sources.tables import table


def core_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Each store row's first supplier whose number contains its longest run of at least six digits.  Candidates meet in
    the run's first six digits, which the supplier's number then holds somewhere."""
    s = once(table(spark, folder, "store_items")).select("project_id", F.col("id").alias("store_id"), digit_core(norm_stored(F.col("part_number"))).alias("core")).filter("core is not null")
    u = once(table(spark, folder, "supplier_items")).select("project_id", F.col("id").alias("supplier_id"), norm_stored(F.col("part_number")).alias("norm")).filter("length(norm) >= 6")
    pieces = F.transform(F.sequence(F.lit(1), F.length("norm") - 5), lambda i: F.substring("norm", i, F.lit(6)))
    u = u.withColumn("key", F.explode(F.array_distinct(pieces)))
    met = split_join(s.withColumn("key", F.substring("core", 1, 6)), u, ["project_id", "key"], "store_id", "supplier_id").filter(F.contains("norm", "core"))
    return first_by(met, ["store_id"], [F.length("norm"), F.col("supplier_id")]).select("project_id", "store_id", "supplier_id", "core")


def translated_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Store rows and supplier rows with one canonical number whose line codes a mapping translates (two hops)."""
    m = line_code_map(table(spark, folder, "line_code_mappings")).filter("supplier_code is not null")
    s = once(table(spark, folder, "store_items")).select("project_id", F.col("id").alias("store_id"), F.upper(F.trim("line_code")).alias("client_code"), norm_canonical(F.col("part_number")).alias("norm"))
    u = once(table(spark, folder, "supplier_items")).select("project_id", F.col("id").alias("supplier_id"), F.upper(F.trim("line_code")).alias("supplier_code"), norm_canonical(F.col("part_number")).alias("norm"))
    return s.filter("norm <> ''").join(m, "client_code").join(u, ["project_id", "supplier_code", "norm"]).select("project_id", "store_id", "supplier_id", "maker")


def attempt_history(spark: SparkSession, folder: str) -> DataFrame:
    """For each store row which stages proposed anything, and the best usable confidence."""
    c = newest(table(spark, folder, "match_candidates"), "store_item_id", "match_stage", "confidence")
    usable = F.when(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.col("confidence"))
    stage = lambda k: F.coalesce(F.bool_or(F.col("match_stage") == k), F.lit(False)).alias(f"stage_{k}")
    return c.filter("store_item_id is not null").groupBy("store_item_id").agg(*[stage(k) for k in range(6)], F.max(usable).alias("best"), F.count("*").alias("n"))


def pair_winners(spark: SparkSession, folder: str) -> DataFrame:
    """One candidate for each pair of a store row and a target: the earliest stage, then the highest usable confidence,
    then the smaller id."""
    c = newest(table(spark, folder, "match_candidates"), "store_item_id", "target_id", "match_stage", "confidence")
    usable = F.when(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.col("confidence"))
    kept = c.filter("store_item_id is not null and target_id is not null")
    return first_by(kept, ["store_item_id", "target_id"], [F.col("match_stage").asc_nulls_last(), usable.desc_nulls_last(), F.col("id")]).select("store_item_id", "target_id", "id")


def confidence_selectors(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates that bulk selections by confidence would take, by project."""
    c = newest(table(spark, folder, "match_candidates"), "project_id", "confidence").filter(F.col("confidence").between(0, 1) & ~F.isnan("confidence"))
    k = F.col("confidence")
    part = lambda test, name: F.count(F.when(test, 1)).alias(name)
    return c.groupBy("project_id").agg(part(k >= 0.9, "high"), part((k >= 0.7) & (k < 0.9), "medium"), part(k < 0.7, "low"))


def repeated_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and ids of each table that is delivered by id."""
    one = lambda t: table(spark, folder, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
    a, b, c, d = (one(t) for t in ("store_items", "supplier_items", "interchanges", "match_candidates"))
    return a.unionAll(b).unionAll(c).unionAll(d)


QUERIES = {
    "core_containment": core_containment, "translated_matches": translated_matches, "attempt_history": attempt_history, "pair_winners": pair_winners,
    "confidence_selectors": confidence_selectors, "repeated_deliveries": repeated_deliveries,
}

_OK = "CASE WHEN confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) THEN confidence END"
SQL = {
    "core_containment": f"""WITH a AS (SELECT DISTINCT project_id, id AS store_id, list_filter(string_split_regex({sql_stored('part_number')}, '[^0-9]+'), lambda r: length(r) >= 6) AS runs FROM store_items),
s AS (SELECT project_id, store_id, list_filter(runs, lambda r: length(r) = list_max(list_transform(runs, lambda q: length(q))))[1] AS core FROM a WHERE len(runs) > 0),
u AS (SELECT DISTINCT project_id, id AS supplier_id, {sql_stored('part_number')} AS norm FROM supplier_items)
SELECT s.project_id, store_id, supplier_id, core FROM s JOIN u ON u.project_id = s.project_id AND contains(norm, core) QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY length(norm), supplier_id) = 1""",
    "translated_matches": f"""WITH {_LINES}, s AS (SELECT DISTINCT project_id, id AS store_id, upper(trim(line_code)) AS code, {sql_canonical('part_number')} AS norm FROM store_items),
u AS (SELECT DISTINCT project_id, id AS supplier_id, upper(trim(line_code)) AS code, {sql_canonical('part_number')} AS norm FROM supplier_items)
SELECT s.project_id, store_id, supplier_id, maker FROM s JOIN m ON client_code = s.code JOIN u ON u.project_id = s.project_id AND u.code = supplier_code AND u.norm = s.norm WHERE s.norm <> ''""",
    "attempt_history": f"WITH {_newest('store_item_id', 'match_stage', 'confidence')} SELECT store_item_id, "
    + ", ".join(f"coalesce(bool_or(match_stage = {k}), false) AS stage_{k}" for k in range(6))
    + f", max({_OK}) AS best, count(*) AS n FROM c WHERE store_item_id IS NOT NULL GROUP BY store_item_id",
    "pair_winners": f"""WITH {_newest('store_item_id', 'target_id', 'match_stage', 'confidence')} SELECT store_item_id, target_id, id FROM c WHERE store_item_id IS NOT NULL AND target_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY store_item_id, target_id ORDER BY match_stage ASC NULLS LAST, {_OK} DESC NULLS LAST, id) = 1""",
    "confidence_selectors": f"WITH {_newest('project_id', 'confidence')}, k AS (SELECT project_id, {_OK} AS k FROM c) SELECT project_id, count(*) FILTER (k >= 0.9) AS high, count(*) FILTER (k >= 0.7 AND k < 0.9) AS medium, count(*) FILTER (k < 0.7) AS low FROM k WHERE k IS NOT NULL GROUP BY ALL",
    "repeated_deliveries": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n, count(DISTINCT id) AS ids FROM {t}" for t in ("store_items", "supplier_items", "interchanges", "match_candidates")),
}
