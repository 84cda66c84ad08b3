"""Queries that read and compare identifiers and texts row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.functions import text as t
from partweave.functions.similarity import cost_comparison, unit_mismatch, windowed_similarity
from partweave.operators.matching import alike_pairs, common_run_scores, exact_pairs, once
from partweave.operators.skew import numbered
from partweave.plans.sqltext import SQL_ALIKE, SQL_ROWS, sql_canonical, sql_join_key, sql_lower_key, sql_score_key, sql_stored
from partweave.sources.tables import table


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "store_items"))


def number_forms(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("part_number")
    return _items(spark, folder).select(
        "id", t.norm_join(n).alias("join_key"), t.norm_stored(n).alias("stored"), t.norm_canonical(n).alias("canonical"),
        t.norm_score(n).alias("score_key"), t.norm_lower(n).alias("lower_key"), t.norm_punct(n).alias("punct"),
    )


def line_code_split(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("part_full")
    a, b = t.line_code_prefix(n), t.line_code_pattern(n)
    return _items(spark, folder).filter("part_full is not null").select(
        "id", a["line_code"].alias("prefix_code"), a["mfr_part"].alias("prefix_part"), b["line_code"].alias("pattern_code"), b["mfr_part"].alias("pattern_part")
    )


def number_variants(spark: SparkSession, folder: str) -> DataFrame:
    kept = _items(spark, folder).filter("part_number is not null")
    return kept.select("id", F.posexplode(t.number_variants(F.trim("part_number"))).alias("place", "variant"))


def description_keywords(spark: SparkSession, folder: str) -> DataFrame:
    kept = _items(spark, folder).filter("description is not null")
    return kept.select("id", F.array_join(t.keywords(F.col("description")), " ").alias("words"), F.array_join(t.keywords(F.col("description"), 3, 3), " ").alias("long_words"))


def search_texts(spark: SparkSession, folder: str) -> DataFrame:
    number, line, text = F.col("part_number"), F.col("line_code"), F.col("description")
    return _items(spark, folder).select("id", t.search_query(number, text).alias("query"), t.embedding_text(number, line, text).alias("embedding_text"))


def punctuation_signatures(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("merrill_part_number"), F.col("vendor_part_number")
    told = once(table(spark, folder, "interchanges")).select("id", t.punctuation_signature(a, b).alias("signature"), t.character_change(F.trim(a), F.trim(b)).alias("change"))
    return told.filter("signature is not null").select("id", "signature", "change", t.change_class(F.col("change")).alias("rule_type"))


def cost_checks(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("store_cost"), F.col("supplier_cost")
    pairs = exact_pairs(table(spark, folder, "store_items"), table(spark, folder, "supplier_items"))
    told = pairs.withColumn("cost", cost_comparison(a, b))
    parts = [F.col(f"cost.{x}").alias(f"cost_{x}") for x in ("difference", "percent", "similarity", "close")]
    return told.select("store_id", "supplier_id", *parts, unit_mismatch(a, b).alias("unit"))


def common_runs(spark: SparkSession, folder: str) -> DataFrame:
    return common_run_scores(table(spark, folder, "store_items"), table(spark, folder, "supplier_items"))


def windowed_scores(spark: SparkSession, folder: str) -> DataFrame:
    pairs = alike_pairs(table(spark, folder, "store_items"), table(spark, folder, "supplier_items"))
    return pairs.select("store_id", "supplier_id", windowed_similarity(F.col("store_number"), F.col("supplier_number")).alias("score"))


def stride_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A sampling operator: of each project's rows in order of id, every tenth, beginning at a place that a hash of
    the project tells."""
    rows = numbered(_items(spark, folder).filter("id is not null and project_id is not null").select("project_id", "id"), "project_id", "id")
    return rows.filter(F.pmod(F.col("place") + t.string_hash32(F.col("project_id")), F.lit(10)) == 0)


QUERIES = {
    "number_forms": number_forms,
    "line_code_split": line_code_split,
    "number_variants": number_variants,
    "description_keywords": description_keywords,
    "search_texts": search_texts,
    "punctuation_signatures": punctuation_signatures,
    "cost_checks": cost_checks,
    "common_runs": common_runs,
    "windowed_scores": windowed_scores,
    "stride_sample": stride_sample,
}

_ONCE = "(SELECT DISTINCT id, project_id, part_number, part_full, line_code, description FROM store_items)"
_WORDS = "list_filter(string_split_regex(regexp_replace(upper(description), '[^A-Z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > {n} AND w NOT IN ('THE','A','AN','AND','OR','FOR','WITH','TO','IN','ON','AT'))"
_PAIRS = f"WITH {SQL_ROWS}, p AS (SELECT * FROM s JOIN u USING (project_id) WHERE {sql_join_key('store_number')} = {sql_join_key('supplier_number')} AND {sql_join_key('store_number')} <> '')"

SQL = {
    "number_forms": f"""SELECT id, {sql_join_key('part_number')} AS join_key, {sql_stored('part_number')} AS stored, {sql_canonical('part_number')} AS canonical,
  {sql_score_key('part_number')} AS score_key, {sql_lower_key('part_number')} AS lower_key, upper(translate(part_number, '-/.', '')) AS punct FROM {_ONCE}""",
    "line_code_split": f"""WITH r AS (SELECT id, part_full AS n, upper(substr(part_full, 1, 3)) AS h, substr(part_full, 4) AS m, upper(trim(part_full)) AS t FROM {_ONCE} WHERE part_full IS NOT NULL),
c AS (SELECT *, length(n) >= 3 AND length(regexp_replace(h, '[^A-Z]', '', 'g')) >= 2 AND length(m) >= 2 AS ok, regexp_matches(t, '^([A-Z]{{2,3}})[-\\s]?(.+)$') AS p FROM r)
SELECT id, CASE WHEN ok THEN h END AS prefix_code, CASE WHEN ok THEN m WHEN n <> '' THEN n END AS prefix_part,
  CASE WHEN p THEN regexp_extract(t, '^([A-Z]{{2,3}})[-\\s]?(.+)$', 1) END AS pattern_code, CASE WHEN p THEN regexp_extract(t, '^([A-Z]{{2,3}})[-\\s]?(.+)$', 2) ELSE t END AS pattern_part FROM c""",
    "number_variants": f"""WITH r AS (SELECT id, trim(part_number) AS c FROM {_ONCE} WHERE part_number IS NOT NULL),
v AS (SELECT id, unnest([c, CASE WHEN regexp_matches(c, '[A-Z]$') THEN substr(c, 1, length(c) - 1) END, regexp_replace(c, '[-\\s]', '', 'g'),
  CASE WHEN NOT contains(c, '-') AND length(c) > 4 THEN substr(c, 1, 4) || '-' || substr(c, 5) END,
  CASE WHEN NOT contains(c, '-') AND length(c) > 6 THEN substr(c, 1, 3) || '-' || substr(c, 4) END]) AS variant, unnest([1, 2, 3, 4, 5]) AS k FROM r),
f AS (SELECT id, variant, min(k) AS k FROM v WHERE variant IS NOT NULL GROUP BY ALL)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::int AS place, variant FROM f""",
    "description_keywords": f"""SELECT id, array_to_string({_WORDS.format(n=2)}[1:5], ' ') AS words, array_to_string({_WORDS.format(n=3)}[1:3], ' ') AS long_words
FROM {_ONCE} WHERE description IS NOT NULL""",
    "search_texts": f"""WITH r AS (SELECT *, nullif(trim(regexp_replace(regexp_replace(description, '(?i)\\b(KIT|ASSY|ASSEMBLY|SET)\\b', '', 'g'), '\\s+', ' ', 'g')), '') AS d FROM {_ONCE})
SELECT id, concat_ws(' ', nullif(trim(part_number), ''), d) AS query, concat_ws(' | ', nullif(trim(part_number), ''), nullif(trim(line_code), ''), nullif(trim(substr(description, 1, 200)), '')) AS embedding_text FROM r""",
    "punctuation_signatures": f"""WITH r AS (SELECT DISTINCT id, upper(trim(merrill_part_number)) AS a, upper(trim(vendor_part_number)) AS b, trim(merrill_part_number) AS x, trim(vendor_part_number) AS y FROM interchanges),
g AS (SELECT *, concat_ws('_', CASE WHEN contains(a, '/') AND contains(b, '-') THEN 'slash_to_dash' WHEN contains(a, '-') AND contains(b, '/') THEN 'dash_to_slash' END,
    CASE WHEN contains(a, '-') AND NOT contains(b, '-') THEN 'remove_dash' END, CASE WHEN contains(a, '/') AND NOT contains(b, '/') THEN 'remove_slash' END,
    CASE WHEN contains(a, '.') AND NOT contains(b, '.') THEN 'remove_dot' END, CASE WHEN contains(a, ' ') AND NOT contains(b, ' ') THEN 'remove_space' END) AS told,
    [c FOR c, i IN string_split(x, '') IF list_position(string_split(x, ''), c) = i] AS p, [c FOR c, i IN string_split(y, '') IF list_position(string_split(y, ''), c) = i] AS q FROM r WHERE {sql_canonical('a')} = {sql_canonical('b')}),
h AS (SELECT *, list_filter(p, lambda c: NOT list_contains(q, c)) AS gone, list_filter(q, lambda c: NOT list_contains(p, c)) AS come FROM g),
k AS (SELECT id, CASE WHEN told = '' THEN 'punctuation_change' ELSE told END AS signature,
  CASE WHEN len(gone) = 1 AND len(come) = 1 THEN 'Replace "' || gone[1] || '" with "' || come[1] || '"' WHEN len(gone) > 0 AND len(come) = 0 THEN 'Remove "' || array_to_string(gone, ', ') || '"'
       WHEN len(gone) = 0 AND len(come) > 0 THEN 'Add "' || array_to_string(come, ', ') || '"' WHEN upper(x) = upper(y) AND x <> y THEN 'Change case'
       WHEN starts_with(y, x) THEN 'Add suffix "' || substr(y, length(x) + 1) || '"' WHEN ends_with(y, x) THEN 'Add prefix "' || substr(y, 1, length(y) - length(x)) || '"'
       ELSE 'Transform "' || x || '" → "' || y || '"' END AS change FROM h)
SELECT *, CASE WHEN contains(change, 'Replace') OR contains(change, 'Remove') THEN 'punctuation' WHEN contains(change, 'case') THEN 'case_normalization'
  WHEN contains(change, 'prefix') OR contains(change, 'suffix') THEN 'affix' ELSE 'custom' END AS rule_type FROM k""",
    "cost_checks": f"""{_PAIRS}, c AS (SELECT store_id, supplier_id, store_cost::double AS a, supplier_cost::double AS b FROM p), r AS (SELECT *, greatest(a, b) / least(a, b) AS ratio, a > 0 AND b > 0 AS ok FROM c)
SELECT store_id, supplier_id, CASE WHEN ok THEN abs(a - b) END AS cost_difference, CASE WHEN ok THEN abs(a - b) / ((a + b) / 2) * 100 END AS cost_percent,
  CASE WHEN ok THEN exp(-0.1 * (abs(a - b) / ((a + b) / 2) * 100)) END AS cost_similarity, CASE WHEN ok THEN abs(a - b) / ((a + b) / 2) * 100 <= 5 END AS cost_close,
  CASE WHEN NOT coalesce(ok, false) THEN NULL WHEN abs(ratio / 12 - 1) < 0.1 THEN 'per-foot vs per-dozen' WHEN abs(ratio / 50 - 1) < 0.1 THEN 'per-foot vs per-roll (50ft)'
       WHEN abs(ratio / 100 - 1) < 0.1 THEN 'per-unit vs per-hundred' WHEN abs(ratio / 1000 - 1) < 0.1 THEN 'per-unit vs per-thousand' WHEN ratio > 10 THEN 'Unknown unit mismatch (large price difference)' END AS unit FROM r""",
    "windowed_scores": f"""WITH RECURSIVE {SQL_ROWS}, {SQL_ALIKE}, q AS (SELECT DISTINCT store_number AS a, supplier_number AS b FROM p WHERE store_number <> '' AND supplier_number <> ''),
r AS (SELECT a, b, CASE WHEN length(a) > length(b) THEN b ELSE a END AS sh, CASE WHEN length(a) > length(b) THEN a ELSE b END AS lo FROM q),
f(a, b, sh, n, e, i, st) AS (SELECT a, b, sh, length(lo), length(lo) // 2 - 1, 0, lo FROM r
  UNION ALL SELECT a, b, sh, n, e, i + 1, CASE WHEN pos > 0 THEN substr(st, 1, w + pos - 2) || chr(1) || substr(st, w + pos) ELSE st END
  FROM (SELECT *, instr(substr(st, w, least(n, i + 1 + e) - w + 1), substr(sh, i + 1, 1)) AS pos FROM (SELECT *, greatest(1, i + 1 - e) AS w FROM f WHERE i < length(sh)))),
g AS (SELECT a, b, (length(st) - length(replace(st, chr(1), ''))) / n AS score FROM f WHERE i = length(sh))
SELECT store_id, supplier_id, coalesce(score, 0)::double AS score FROM p LEFT JOIN g ON a = store_number AND b = supplier_number""",
    "stride_sample": """WITH RECURSIVE h(project_id, i, v) AS (SELECT DISTINCT project_id, 0, 0::bigint FROM store_items WHERE project_id IS NOT NULL
  UNION ALL SELECT project_id, i + 1, (v * 31 + ascii(substr(project_id, i + 1, 1)) + 2147483648) % 4294967296 - 2147483648 + CASE WHEN (v * 31 + ascii(substr(project_id, i + 1, 1)) + 2147483648) % 4294967296 < 0 THEN 4294967296 ELSE 0 END
  FROM h WHERE i < length(project_id)),
k AS (SELECT project_id, abs(v) AS v FROM h WHERE i = length(project_id)),
r AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY id) - 1 AS place FROM (SELECT DISTINCT project_id, id FROM store_items WHERE project_id IS NOT NULL))
SELECT project_id, id, place FROM r JOIN k USING (project_id) WHERE (place + v) % 10 = 0""",
    "common_runs": f"""WITH RECURSIVE {SQL_ROWS}, {SQL_ALIKE}, c AS (SELECT store_id, supplier_id, {sql_stored('store_number')} AS a, {sql_stored('supplier_mfr')} AS b FROM p),
d AS (SELECT *, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS sh, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS lo FROM c)
SELECT store_id, supplier_id, (CASE WHEN a IS NULL OR b IS NULL OR a = '' OR b = '' THEN 0 WHEN a = b THEN 1 WHEN contains(lo, sh) THEN length(sh) / length(lo)
  ELSE coalesce(list_max(list_filter(range(3, length(sh) + 1), lambda k: len(list_filter(range(1, length(sh) - k + 2), lambda i: contains(lo, substr(sh, i, k)))) > 0)), 0) / length(lo) END)::double AS score FROM d""",
}
