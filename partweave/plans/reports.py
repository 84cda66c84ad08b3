"""Reports over candidates, rules and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.operators import rules as r
from partweave.operators.matching import exact_best, once
from partweave.plans.matchers import EXACT_BEST
from partweave.plans.sqltext import sql_canonical, sql_stored
from partweave.sources.tables import table

#: The order in which statuses are shown.
STATUS_ORDER = ["PENDING", "CONFIRMED", "REJECTED"]
#: Lower bounds of the confidence classes.
BOUNDS = [0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


def _c(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return r.newest(table(spark, folder, "match_candidates"), *columns)


def _four(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("store_items", "supplier_items", "master_rules", "match_candidates")]


def _usable() -> Column:
    return F.when(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.col("confidence"))


def rule_positive(spark: SparkSession, folder: str) -> DataFrame:
    return r.positive_candidates(*_four(spark, folder))


def rule_negative(spark: SparkSession, folder: str) -> DataFrame:
    return r.blocked_candidates(*_four(spark, folder))


def learned_rules(spark: SparkSession, folder: str) -> DataFrame:
    return r.learned_rules(*_four(spark, folder))


def interchange_rules(spark: SparkSession, folder: str) -> DataFrame:
    return r.interchange_rules(table(spark, folder, "interchanges"))


def pattern_mining(spark: SparkSession, folder: str) -> DataFrame:
    """Punctuation changes among the exact matches."""
    stores, suppliers = table(spark, folder, "store_items"), table(spark, folder, "supplier_items")
    best = exact_best(stores, suppliers)
    s = once(stores).select(F.col("id").alias("store_id"), F.col("part_number").alias("a"), F.upper(F.trim("line_code")).alias("line"))
    u = once(suppliers).select(F.col("id").alias("supplier_id"), F.col("part_number").alias("b"))
    return r.mined_patterns(best.join(s, "store_id").join(u, "supplier_id").withColumnRenamed("store_id", "id"))


def line_code_map(spark: SparkSession, folder: str) -> DataFrame:
    return r.line_code_map(table(spark, folder, "line_code_mappings"))


def line_code_translation(spark: SparkSession, folder: str) -> DataFrame:
    return r.translated_line_codes(table(spark, folder, "store_items"), table(spark, folder, "line_code_mappings"))


def analytics_summary(spark: SparkSession, folder: str) -> DataFrame:
    c = _c(spark, folder, "store_item_id", "status")
    status = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("bigint").alias(s.lower())
    counts = c.agg(F.count("*").alias("candidates"), *[status(s) for s in STATUS_ORDER], F.countDistinct(F.when(F.col("status") != "REJECTED", F.col("store_item_id"))).alias("matched_items"))
    items = table(spark, folder, "store_items").agg(F.countDistinct("id").alias("items"))
    return counts.crossJoin(F.broadcast(items)).withColumn("match_rate", F.round(F.coalesce(F.try_divide(F.col("matched_items").cast("double"), F.col("items")), F.lit(0.0)), 6))


def source_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    m = F.upper(F.trim("method"))
    source = (
        F.when(m == "MASTER_RULE", "rules").when(m.isin("INTERCHANGE", "SUPERSESSION"), "interchange").when(m.isin("EXACT_NORM", "EXACT_NORMALIZED", "LINE_PN"), "exact")
        .when(m.isin("FUZZY", "FUZZY_SUBSTRING", "DESC_SIM"), "fuzzy").otherwise("other")
    )
    return _c(spark, folder, "method", "status").filter(F.col("status").isin("PENDING", "CONFIRMED")).groupBy(source.alias("source")).agg(F.count("*").alias("n"))


def confidence_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Half-open classes, empty ones included."""
    bounds = spark.createDataFrame([(i, b) for i, b in enumerate(BOUNDS)], "bucket int, low double")
    bucket = F.lit(None).cast("int")
    for i, b in enumerate(BOUNDS):
        bucket = F.when(F.col("conf") >= b, i).otherwise(bucket)
    counts = _c(spark, folder, "confidence").select(_usable().alias("conf")).filter("conf is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return F.broadcast(bounds).join(counts, "bucket", "left").select("bucket", "low", F.coalesce("n", F.lit(0)).alias("n"))


def match_rate_by_project(spark: SparkSession, folder: str) -> DataFrame:
    items = once(table(spark, folder, "store_items")).select("id", "project_id")
    hit = _c(spark, folder, "store_item_id", "status").filter("status <> 'REJECTED'").select(F.col("store_item_id").alias("id")).distinct()
    marked = items.join(hit.withColumn("hit", F.lit(1)), "id", "left")
    return marked.groupBy("project_id").agg(F.count("*").alias("items"), F.count("hit").alias("matched"), F.round(F.count("hit") / F.count("*"), 6).alias("match_rate"))


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    c = _c(spark, folder, "project_id", "status")
    return c.groupBy("project_id").agg(*[F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("bigint").alias(s.lower()) for s in STATUS_ORDER])


def method_distribution(spark: SparkSession, folder: str) -> DataFrame:
    c = _c(spark, folder, "method", "confidence")
    return c.groupBy(F.upper(F.trim("method")).alias("method")).agg(F.count("*").alias("n"), F.round(F.avg(_usable()), 6).alias("average"))


def feature_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Averages of what the JSON column says, by method; rows that say nothing count as unknown."""
    part = lambda k: F.get_json_object("features", f"$.{k}").try_cast("double")
    c = _c(spark, folder, "method", "features")
    told = F.when(part("partSim").isNotNull(), "both").when(part("descSim").isNotNull(), "description").otherwise("unknown")
    return c.groupBy(told.alias("told")).agg(F.count("*").alias("n"), F.round(F.avg(part("partSim")), 6).alias("part"), F.round(F.avg(part("descSim")), 6).alias("description"))


def _export(spark: SparkSession, folder: str) -> DataFrame:
    c = _c(spark, folder, "project_id", "store_item_id", "target_type", "target_id", "method", "confidence", "status")
    s = once(table(spark, folder, "store_items")).select(F.col("id").alias("store_item_id"), F.col("part_number").alias("store_number"), F.col("description").alias("store_text"))
    u = once(table(spark, folder, "supplier_items")).select(F.col("id").alias("target_id"), F.col("part_number").alias("target_number"), F.col("supplier").alias("supplier"))
    full = r.join_items(r.join_items(c, s, "store_item_id"), u, "target_id")
    return full.withColumn("status_order", F.array_position(F.lit(STATUS_ORDER), F.col("status")).cast("int"))


def review_export(spark: SparkSession, folder: str) -> DataFrame:
    """What a reviewer gets, in order of status, confidence and id (the place is a column)."""
    return _export(spark, folder).select("id", "store_item_id", "store_number", "target_id", "target_number", "supplier", "method", _usable().alias("confidence"), "status", "status_order")


def matches_page(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of 50 of one project's matches (pagination is the feature), with the number of all."""
    rows = review_export(spark, folder).join(table(spark, folder, "match_candidates").agg(F.min("project_id").alias("p")).join(_c(spark, folder, "project_id").withColumnRenamed("project_id", "p"), "p").select("id"), "id", "left_semi")
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy("status_order", F.col("confidence").desc_nulls_last(), "id").offset(100).limit(50)
    return page.select("id", "status", "confidence").crossJoin(F.broadcast(total))


def population_profile(spark: SparkSession, folder: str) -> DataFrame:
    s = once(table(spark, folder, "store_items"))
    share = lambda c: F.round(100.0 * F.count(F.nullif(F.trim(c), F.lit(""))) / F.nullif(F.count("*"), F.lit(0)), 2).alias(f"{c}_percent")
    return s.groupBy("project_id").agg(F.count("*").alias("n"), *[share(c) for c in ("line_code", "description", "canonical_part_number", "brand", "category", "manufacturer_name")])


def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda t: table(spark, folder, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n"))
    parts = [one(t) for t in ("store_items", "supplier_items", "interchanges", "master_rules", "match_candidates", "files")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def rule_search(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of which any of four columns contains a text, without case; % and _ are ordinary characters."""
    needle = F.lit("k50")
    cols = ["store_part_number", "supplier_part_number", "line_code", "created_by"]
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
    return once(table(spark, folder, "master_rules")).filter(hit).select("id", "rule_type", "store_part_number", "supplier_part_number")


def event_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows by operation, and all together (grouping sets)."""
    e = table(spark, folder, "events")
    return e.rollup("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.coalesce("event_type", F.lit("ALL")).alias("operation"), "n", "total")


QUERIES = {
    "rule_positive": rule_positive, "rule_negative": rule_negative, "learned_rules": learned_rules, "interchange_rules": interchange_rules, "pattern_mining": pattern_mining,
    "line_code_map": line_code_map, "line_code_translation": line_code_translation, "analytics_summary": analytics_summary, "source_breakdown": source_breakdown,
    "confidence_histogram": confidence_histogram, "match_rate_by_project": match_rate_by_project, "status_counts": status_counts, "method_distribution": method_distribution,
    "feature_stats": feature_stats, "review_export": review_export, "matches_page": matches_page, "population_profile": population_profile, "table_counts": table_counts,
    "rule_search": rule_search, "event_totals": event_totals,
}

_NEW = """c AS (SELECT * FROM match_candidates WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, {tie}) = 1)"""


def _newest(*columns: str) -> str:
    return _NEW.format(tie=", ".join(f"{c} DESC NULLS LAST" for c in columns) or "id")


_USABLE = "CASE WHEN confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) THEN confidence END"
_NUMBERS = f"""s AS (SELECT DISTINCT project_id, id AS store_id, {sql_canonical('part_number')} AS store_key FROM store_items WHERE {sql_canonical('part_number')} <> ''),
u AS (SELECT DISTINCT project_id, id AS supplier_id, {sql_canonical('part_number')} AS supplier_key FROM supplier_items WHERE {sql_canonical('part_number')} <> ''),
r AS (SELECT DISTINCT id AS rule_id, rule_type, confidence, CASE WHEN scope = 'PROJECT_SPECIFIC' THEN project_id END AS rule_project, {sql_canonical('store_part_number')} AS store_key, {sql_canonical('supplier_part_number')} AS supplier_key FROM master_rules WHERE enabled)"""
_SIGN = """CASE WHEN upper(regexp_replace(trim(a), '[-/.\\s]', '', 'g')) = upper(regexp_replace(trim(b), '[-/.\\s]', '', 'g')) THEN coalesce(nullif(concat_ws('_', CASE WHEN contains(a, '/') AND contains(b, '-') THEN 'slash_to_dash' WHEN contains(a, '-') AND contains(b, '/') THEN 'dash_to_slash' END,
  CASE WHEN contains(a, '-') AND NOT contains(b, '-') THEN 'remove_dash' END, CASE WHEN contains(a, '/') AND NOT contains(b, '/') THEN 'remove_slash' END,
  CASE WHEN contains(a, '.') AND NOT contains(b, '.') THEN 'remove_dot' END, CASE WHEN contains(trim(a), ' ') AND NOT contains(trim(b), ' ') THEN 'remove_space' END), ''), 'punctuation_change') END"""
_LINES = """m AS (SELECT upper(trim(client_line_code)) AS client_code, manufacturer_name AS maker, upper(trim(arnold_line_code)) AS supplier_code FROM line_code_mappings WHERE client_line_code IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY upper(trim(client_line_code)) ORDER BY confidence DESC NULLS LAST, id) = 1)"""
_EXPORT = f"""{_newest('project_id', 'store_item_id', 'target_type', 'target_id', 'method', 'confidence', 'status')}, s AS (SELECT DISTINCT id AS sid, part_number AS store_number FROM store_items), u AS (SELECT DISTINCT id AS uid, part_number AS target_number, supplier FROM supplier_items),
x AS (SELECT c.id, store_item_id, store_number, target_id, target_number, supplier, method, {_USABLE} AS confidence, status, list_position(['PENDING','CONFIRMED','REJECTED'], status)::int AS status_order, project_id
  FROM c LEFT JOIN s ON sid = store_item_id LEFT JOIN u ON uid = target_id)"""

SQL = {
    "rule_positive": f"""WITH {_newest('store_item_id', 'target_id')}, {_NUMBERS}
SELECT store_id, supplier_id, rule_id, r.confidence FROM s JOIN r ON r.store_key = s.store_key AND r.rule_type = 'POSITIVE_MAP' AND (rule_project IS NULL OR rule_project = s.project_id)
JOIN u ON u.project_id = s.project_id AND u.supplier_key = r.supplier_key WHERE NOT EXISTS (SELECT 1 FROM c WHERE store_item_id = store_id AND target_id = supplier_id)
QUALIFY row_number() OVER (PARTITION BY store_id, supplier_id ORDER BY r.confidence DESC NULLS LAST, rule_id) = 1""",
    "rule_negative": f"""WITH {_newest('store_item_id', 'target_id')}, {_NUMBERS}
SELECT c.id, min(rule_id) AS rule_id FROM c JOIN s ON store_item_id = store_id JOIN u ON target_id = supplier_id JOIN r ON r.rule_type = 'NEGATIVE_BLOCK' AND r.store_key = s.store_key AND r.supplier_key = u.supplier_key
WHERE rule_project IS NULL OR rule_project = s.project_id GROUP BY c.id""",
    "learned_rules": f"""WITH {_newest('store_item_id', 'target_id', 'status')}, {_NUMBERS},
t AS (SELECT CASE WHEN status = 'CONFIRMED' THEN 'POSITIVE_MAP' ELSE 'NEGATIVE_BLOCK' END AS rule_type, store_key, supplier_key, count(*) AS decisions FROM c JOIN s ON store_item_id = store_id JOIN u ON target_id = supplier_id WHERE status IN ('CONFIRMED', 'REJECTED') GROUP BY ALL)
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rule_type = t.rule_type AND r.store_key = t.store_key AND r.supplier_key = t.supplier_key)""",
    "interchange_rules": f"""SELECT DISTINCT {sql_stored('merrill_part_number')} AS store_key, {sql_stored('vendor_part_number')} AS supplier_key, least(coalesce(confidence, 0.95), 0.95) AS confidence, id AS edge_id FROM interchanges
WHERE regexp_matches({sql_stored('merrill_part_number')}, '[0-9]') AND regexp_matches({sql_stored('vendor_part_number')}, '[0-9]') AND {sql_stored('merrill_part_number')} <> {sql_stored('vendor_part_number')}
QUALIFY row_number() OVER (PARTITION BY {sql_stored('merrill_part_number')}, {sql_stored('vendor_part_number')} ORDER BY least(coalesce(confidence, 0.95), 0.95) DESC, id) = 1""",
    "pattern_mining": f"""{EXACT_BEST}, k AS (SELECT store_id, store_number AS a, supplier_number AS b, upper(trim(store_line)) AS line, CASE WHEN store_number = supplier_number AND text_similarity >= 0.9 THEN 0.99 WHEN text_similarity >= 0.9 THEN 0.98
  WHEN text_similarity >= 0.75 THEN 0.95 WHEN text_similarity >= 0.6 THEN 0.92 WHEN text_similarity >= 0.5 THEN 0.87 WHEN text_similarity >= 0.4 THEN 0.83 WHEN text_similarity >= 0.3 THEN 0.80
  WHEN text_similarity >= 0.2 THEN 0.75 ELSE 0.70 END AS k FROM b), t AS (SELECT store_id, k, line, {_SIGN} AS signature FROM k)
SELECT signature, count(*) AS n, round(avg(k), 6)::double AS average, CASE WHEN min(line) = max(line) AND count(line) = count(*) THEN min(line) END AS line_code, min(store_id) AS example_id FROM t WHERE signature IS NOT NULL GROUP BY signature HAVING count(*) >= 2""",
    "line_code_map": f"WITH {_LINES} SELECT * FROM m",
    "line_code_translation": f"""WITH {_LINES}, s AS (SELECT DISTINCT id, upper(trim(line_code)) AS line_code, upper(trim(part_number)) AS number FROM store_items)
SELECT id, line_code, maker, supplier_code, CASE WHEN supplier_code IS NOT NULL THEN supplier_code || '-' || CASE WHEN starts_with(number, line_code) AND length(number) > length(line_code) + 2 THEN regexp_replace(substr(number, length(line_code) + 1), '^[-\\s]', '') ELSE number END END AS rewritten
FROM s LEFT JOIN m ON client_code = line_code""",
    "analytics_summary": f"""WITH {_newest('store_item_id', 'status')} SELECT count(*) AS candidates, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'REJECTED') AS rejected,
  count(DISTINCT CASE WHEN status <> 'REJECTED' THEN store_item_id END) AS matched_items, (SELECT count(DISTINCT id) FROM store_items) AS items, round(coalesce(count(DISTINCT CASE WHEN status <> 'REJECTED' THEN store_item_id END) / nullif((SELECT count(DISTINCT id) FROM store_items), 0), 0), 6)::double AS match_rate FROM c""",
    "source_breakdown": f"""WITH {_newest('method', 'status')} SELECT CASE upper(trim(method)) WHEN 'MASTER_RULE' THEN 'rules' WHEN 'INTERCHANGE' THEN 'interchange' WHEN 'SUPERSESSION' THEN 'interchange' WHEN 'EXACT_NORM' THEN 'exact' WHEN 'EXACT_NORMALIZED' THEN 'exact' WHEN 'LINE_PN' THEN 'exact'
  WHEN 'FUZZY' THEN 'fuzzy' WHEN 'FUZZY_SUBSTRING' THEN 'fuzzy' WHEN 'DESC_SIM' THEN 'fuzzy' ELSE 'other' END AS source, count(*) AS n FROM c WHERE status IN ('PENDING', 'CONFIRMED') GROUP BY ALL""",
    "confidence_histogram": f"""WITH {_newest('confidence')}, b AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6])::int AS bucket, unnest([0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])::double AS low, unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 9])::double AS high)
SELECT bucket, low, count(k) AS n FROM b LEFT JOIN (SELECT {_USABLE} AS k FROM c) ON k >= low AND k < high GROUP BY ALL""",
    "match_rate_by_project": f"""WITH {_newest('store_item_id', 'status')}, s AS (SELECT DISTINCT id, project_id FROM store_items), h AS (SELECT DISTINCT store_item_id FROM c WHERE status <> 'REJECTED')
SELECT project_id, count(*) AS items, count(store_item_id) AS matched, round(count(store_item_id) / count(*), 6) AS match_rate FROM s LEFT JOIN h ON store_item_id = id GROUP BY ALL""",
    "status_counts": f"WITH {_newest('project_id', 'status')} SELECT project_id, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'REJECTED') AS rejected FROM c GROUP BY ALL",
    "method_distribution": f"WITH {_newest('method', 'confidence')} SELECT upper(trim(method)) AS method, count(*) AS n, round(avg({_USABLE}), 6) AS average FROM c GROUP BY 1",
    "feature_stats": f"""WITH {_newest('method', 'features')}, f AS (SELECT try_cast(json_extract_string(features, '$.partSim') AS double) AS p, try_cast(json_extract_string(features, '$.descSim') AS double) AS d FROM c)
SELECT CASE WHEN p IS NOT NULL THEN 'both' WHEN d IS NOT NULL THEN 'description' ELSE 'unknown' END AS told, count(*) AS n, round(avg(p), 6) AS part, round(avg(d), 6) AS description FROM f GROUP BY ALL""",
    "review_export": f"WITH {_EXPORT} SELECT * EXCLUDE (project_id) FROM x",
    "matches_page": f"WITH {_EXPORT}, y AS (SELECT * FROM x WHERE project_id = (SELECT min(project_id) FROM match_candidates)) SELECT id, status, confidence, (SELECT count(*) FROM y) AS total FROM y ORDER BY status_order NULLS FIRST, confidence DESC NULLS LAST, id LIMIT 50 OFFSET 100",
    "population_profile": """WITH s AS (SELECT DISTINCT id, project_id, line_code, description, canonical_part_number, brand, category, manufacturer_name FROM store_items)
SELECT project_id, count(*) AS n, """ + ", ".join(f"round(100.0 * count(nullif(trim({c}), '')) / nullif(count(*), 0), 2)::double AS {c}_percent" for c in ("line_code", "description", "canonical_part_number", "brand", "category", "manufacturer_name")) + " FROM s GROUP BY ALL",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("store_items", "supplier_items", "interchanges", "master_rules", "match_candidates", "files")),
    "rule_search": "SELECT DISTINCT id, rule_type, store_part_number, supplier_part_number FROM master_rules WHERE contains(lower(store_part_number), 'k50') OR contains(lower(supplier_part_number), 'k50') OR contains(lower(line_code), 'k50') OR contains(lower(created_by), 'k50')",
    "event_totals": "SELECT coalesce(event_type, 'ALL') AS operation, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type)",
}
