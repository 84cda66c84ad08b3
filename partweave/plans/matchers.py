"""Queries that match store rows with supplier rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.functions.similarity import attribute_match, number_similarity, weighted_score, word_jaccard
from partweave.operators import matching as m
from partweave.operators.simjoin import vector_topk as nearest
from partweave.operators.staged import punctuation_rules, second_stage, staged_matches, staged_program
from partweave.plans.sqltext import SQL_ALIKE, SQL_ROWS, sql_canonical, sql_edit, sql_jaccard, sql_join_key, sql_lower_key, sql_score_key, sql_stored, sql_trigrams
from partweave.sources.tables import table


def _two(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "store_items"), table(spark, folder, "supplier_items")


def exact_best(spark: SparkSession, folder: str) -> DataFrame:
    return m.exact_best(*_two(spark, folder))


def exact_stats(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("text_similarity")
    band = lambda lo, hi: F.sum(F.when((d >= lo) & (d < hi), 1).otherwise(0)).cast("bigint")
    return m.exact_best(*_two(spark, folder)).agg(
        F.count("*").alias("matches"), F.round(F.avg(d), 6).alias("average"), band(0.9, 2).alias("excellent"), band(0.75, 0.9).alias("very_good"),
        band(0.6, 0.75).alias("good"), band(0.5, 0.6).alias("fair"), band(0, 0.5).alias("poor"),
    )


def exact_by_line(spark: SparkSession, folder: str) -> DataFrame:
    return m.exact_by_line(*_two(spark, folder))


def exact_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return m.exact_canonical(*_two(spark, folder))


def interchange_bridge(spark: SparkSession, folder: str) -> DataFrame:
    return m.interchange_bridge(*_two(spark, folder), table(spark, folder, "interchanges"))


def interchange_first(spark: SparkSession, folder: str) -> DataFrame:
    return m.interchange_first(*_two(spark, folder), table(spark, folder, "interchanges"))


def unmatched_items(spark: SparkSession, folder: str) -> DataFrame:
    return m.unmatched(table(spark, folder, "store_items"), table(spark, folder, "match_candidates")).select("id", "project_id")


def matched_items(spark: SparkSession, folder: str) -> DataFrame:
    return m.matched(table(spark, folder, "store_items"), table(spark, folder, "match_candidates")).select("id", "project_id")


def waterfall_tiers(spark: SparkSession, folder: str) -> DataFrame:
    return m.waterfall(*_two(spark, folder), table(spark, folder, "line_code_mappings"))


def waterfall_stats(spark: SparkSession, folder: str) -> DataFrame:
    return waterfall_tiers(spark, folder).groupBy("project_id", "tier").agg(F.count("*").alias("n"))


def fuzzy_best(spark: SparkSession, folder: str) -> DataFrame:
    return m.fuzzy_best(*_two(spark, folder))


def fuzzy_bands(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("confidence")
    band = F.when(c >= 0.9, "high").when(c >= 0.75, "medium").otherwise("low")
    return fuzzy_best(spark, folder).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def tiered_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return m.tiered_candidates(*_two(spark, folder)).select("store_id", "supplier_id", "tier", "rank")


def variation_matches(spark: SparkSession, folder: str) -> DataFrame:
    return m.variation_matches(*_two(spark, folder))


def brand_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return m.collisions(table(spark, folder, "supplier_items"))


def match_scores(spark: SparkSession, folder: str) -> DataFrame:
    return m.number_scores(*_two(spark, folder))


def weighted_scores(spark: SparkSession, folder: str) -> DataFrame:
    full = m.alike_pairs(*_two(spark, folder), more=["category", "subcategory"])
    number = number_similarity(F.col("store_number"), F.col("supplier_number"))
    words = word_jaccard(F.col("store_text"), F.col("supplier_text"))
    score = weighted_score(number, words, attribute_match(F.col("store_category"), F.col("supplier_category")), attribute_match(F.col("store_subcategory"), F.col("supplier_subcategory")))
    return full.select("store_id", "supplier_id", words.alias("word_score"), score.alias("score"))


def additive_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Line 100, containment 50, 40 by edit similarity, 5 for each shared long word, 20 or 10 for a close cost; the
    best 100 of at least 10 of each store row among all supplier rows of its project."""
    return m.additive_best(*_two(spark, folder))


def vector_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of all vectors to each vector whose id is divisible by 100."""
    e = table(spark, folder, "embeddings")
    return nearest(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 10, 0.0).withColumn("similarity", F.round("similarity", 6))


def _staged_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return *_two(spark, folder), table(spark, folder, "interchanges"), punctuation_rules(table(spark, folder, "master_rules"))


def learned_punctuation(spark: SparkSession, folder: str) -> DataFrame:
    return punctuation_rules(table(spark, folder, "master_rules"))


def staged(spark: SparkSession, folder: str) -> DataFrame:
    return staged_matches(*_staged_inputs(spark, folder))


def second_stage_top3(spark: SparkSession, folder: str) -> DataFrame:
    stores, suppliers, interchanges, rules = _staged_inputs(spark, folder)
    return second_stage(stores, suppliers, staged_matches(stores, suppliers, interchanges, rules))


def staged_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return staged_program(*_staged_inputs(spark, folder))[0]


def stage_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return staged_program(*_staged_inputs(spark, folder))[1]


QUERIES = {
    "exact_best": exact_best, "exact_stats": exact_stats, "exact_by_line": exact_by_line, "exact_canonical": exact_canonical, "interchange_bridge": interchange_bridge,
    "interchange_first": interchange_first, "unmatched_items": unmatched_items, "matched_items": matched_items, "waterfall_tiers": waterfall_tiers,
    "waterfall_stats": waterfall_stats, "fuzzy_best": fuzzy_best, "fuzzy_bands": fuzzy_bands, "tiered_candidates": tiered_candidates, "variation_matches": variation_matches,
    "brand_collisions": brand_collisions, "match_scores": match_scores, "weighted_scores": weighted_scores, "additive_scores": additive_scores, "vector_nearest": vector_nearest,
    "learned_punctuation": learned_punctuation, "staged": staged, "second_stage_top3": second_stage_top3, "staged_pipeline": staged_pipeline, "stage_metrics": stage_metrics,
}

_KEY_S, _KEY_U = sql_join_key("store_number"), sql_join_key("supplier_number")
_TRGM = sql_jaccard(sql_trigrams("store_text"), sql_trigrams("supplier_text"))
_PAIRS = f"WITH RECURSIVE {SQL_ROWS}, p AS (SELECT *, {_TRGM} AS text_similarity FROM s JOIN u USING (project_id) WHERE {_KEY_S} = {_KEY_U} AND {_KEY_S} <> '')"
EXACT_BEST = f"""{_PAIRS}, b AS (SELECT * FROM p WHERE text_similarity >= 0.05 QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY text_similarity DESC, supplier_id) = 1)"""
_COMPLEX = "regexp_matches(store_number, '[0-9]') AND regexp_matches(store_number, '[A-Za-z]') AND length(regexp_replace(store_number, '[^a-zA-Z0-9]', '', 'g')) > 5"
_EDGES = f"""k AS (SELECT DISTINCT project_id, id AS edge_id, vendor, line_code AS edge_line, unnest(['MERRILL', 'VENDOR']) AS side,
  unnest([{sql_join_key('merrill_part_number')}, {sql_join_key('vendor_part_number')}]) AS norm, unnest([{sql_join_key('vendor_part_number')}, {sql_join_key('merrill_part_number')}]) AS other FROM interchanges),
e AS (SELECT * FROM k WHERE regexp_matches(norm, '[0-9]') AND regexp_matches(other, '[0-9]'))"""
_CANON_S, _CANON_U = sql_canonical("store_number"), sql_canonical("supplier_number")
_WATERFALL = f"""WITH {SQL_ROWS}, mm AS (SELECT DISTINCT upper(trim(client_line_code)) AS f, upper(trim(arnold_line_code)) AS t FROM line_code_mappings WHERE client_line_code IS NOT NULL AND arnold_line_code IS NOT NULL),
p AS (SELECT s.project_id, store_id, supplier_id, CASE WHEN store_number = supplier_number AND store_line IS NOT DISTINCT FROM supplier_line THEN 1
    WHEN upper(trim(store_line)) IS NOT DISTINCT FROM upper(trim(supplier_line)) THEN 2 WHEN mm.t IS NOT NULL THEN 3 END AS tier
  FROM s JOIN u ON s.project_id = u.project_id AND {_CANON_S} = {_CANON_U} AND {_CANON_S} <> '' LEFT JOIN mm ON mm.f = upper(trim(store_line)) AND mm.t = upper(trim(supplier_line))),
w AS (SELECT project_id, store_id, supplier_id, tier FROM p WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY tier, supplier_id) = 1)"""
_FUZZY = f"""WITH {SQL_ROWS}, a AS (SELECT *, {sql_trigrams('store_number')} AS x FROM s), c AS (SELECT *, {sql_trigrams('supplier_number')} AS y FROM u),
p AS (SELECT project_id, store_id, supplier_id, store_line, supplier_line, {sql_jaccard('x', 'y')} AS ps, store_text, supplier_text FROM a JOIN c USING (project_id)),
q AS (SELECT *, {_TRGM} AS ts FROM p WHERE ps >= 0.4),
f AS (SELECT project_id, store_id, supplier_id, ps AS part_similarity, ts AS text_similarity, CASE WHEN ps >= 0.9 AND ts >= 0.7 THEN least(0.99, ps * 0.7 + ts * 0.3 + 0.05)
  ELSE greatest(0.6, least(0.95, ps * 0.7 + ts * 0.3)) END AS confidence FROM q WHERE ts >= 0.25 QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY ps DESC, ts DESC, supplier_id) = 1)"""
_SCORE_S, _SCORE_U = sql_score_key("store_number"), sql_score_key("supplier_number")
_NUMBER = f"""(CASE WHEN coalesce(store_number, '') = '' OR coalesce(supplier_number, '') = '' THEN 0 WHEN {_SCORE_S} = {_SCORE_U} THEN 1
  WHEN contains({_SCORE_S}, {_SCORE_U}) OR contains({_SCORE_U}, {_SCORE_S}) THEN 0.85 + least(length({_SCORE_S}), length({_SCORE_U})) / greatest(length({_SCORE_S}), length({_SCORE_U})) * 0.15
  ELSE least(1.0, 1 - levenshtein({_SCORE_S}, {_SCORE_U}) / greatest(length({_SCORE_S}), length({_SCORE_U})) +
    CASE WHEN substr({_SCORE_S}, 1, least(4, length({_SCORE_S}), length({_SCORE_U}))::int) = substr({_SCORE_U}, 1, least(4, length({_SCORE_S}), length({_SCORE_U}))::int) THEN 0.1 ELSE 0 END) END)::double"""
_WORDS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({c}), '[^\\w\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 2))"
_LONG = "string_split_regex(regexp_replace(upper({c}), '[^A-Z0-9\\s]', ' ', 'g'), '\\s+')"
_ATTR = "(CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.5 WHEN lower({a}) = lower({b}) THEN 1 ELSE 0 END)"

_RULES = f"""pw AS (SELECT DISTINCT id, {sql_canonical('store_part_number')} AS a, {sql_canonical('supplier_part_number')} AS b, confidence FROM master_rules WHERE enabled AND rule_type = 'POSITIVE_MAP'),
pc AS (SELECT confidence, list_filter(list_distinct(string_split(a, '')), lambda c: NOT contains(b, c)) AS gone, list_filter(list_distinct(string_split(b, '')), lambda c: NOT contains(a, c)) AS come
  FROM pw WHERE {sql_stored('a')} = {sql_stored('b')} AND {sql_stored('a')} <> ''),
pr AS (SELECT 'punctuation:' || gone[1] || '>' || coalesce(come[1], '') AS rule_id, gone[1] AS old, coalesce(come[1], '') AS new, round(avg(confidence), 6) AS confidence
  FROM pc WHERE len(gone) = 1 AND len(come) <= 1 GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
_MFR_S, _MFR_U = sql_canonical("store_mfr"), sql_canonical("supplier_mfr")
_COST = "CASE WHEN store_cost > 0 AND supplier_cost > 0 THEN abs(store_cost::double - supplier_cost::double) / ((store_cost::double + supplier_cost::double) / 2) * 100 END"
_STAGED = f"""WITH RECURSIVE {SQL_ROWS}, {_EDGES}, {_RULES},
sn AS (SELECT *, {_CANON_S} AS canon, {_MFR_S} AS mfr FROM s), un AS (SELECT *, {_CANON_U} AS canon, {_MFR_U} AS mfr FROM u),
lk AS (SELECT project_id, store_id, 1 AS step, '' AS sub, NULL::double AS base, 'c' || canon AS key FROM sn WHERE canon <> ''
  UNION ALL SELECT project_id, store_id, 2, '', NULL, 'l' || upper(store_line || ':' || store_mfr) FROM sn WHERE store_line <> '' AND store_mfr <> ''
  UNION ALL SELECT project_id, store_id, 3, '', NULL, 'm' || mfr FROM sn WHERE mfr <> ''
  UNION ALL SELECT DISTINCT sn.project_id, store_id, 4, other, NULL::double, 'n' || other FROM sn JOIN e ON e.project_id = sn.project_id AND e.norm = {_KEY_S}
  UNION ALL SELECT project_id, store_id, 5, '', NULL, 'm' || mfr FROM sn WHERE mfr <> '' AND store_line <> ''
  UNION ALL SELECT project_id, store_id, 6, '', NULL, 'c' || substr(canon, length(x) + 1) FROM sn, (SELECT unnest(['ABC', 'DTN', 'BSC', 'CTS', 'RB', 'WA', 'DP']) AS x) WHERE starts_with(canon, x) AND length(canon) > length(x) + 3
  UNION ALL SELECT project_id, store_id, 7, rule_id, confidence, 'c' || {sql_canonical('replace(upper(store_number), old, new)')} FROM sn JOIN pr ON contains(upper(store_number), old) WHERE {sql_canonical('replace(upper(store_number), old, new)')} <> ''),
ix AS (SELECT project_id, supplier_id, 'c' || canon AS key FROM un WHERE canon <> '' UNION ALL SELECT project_id, supplier_id, 'm' || mfr FROM un WHERE mfr <> ''
  UNION ALL SELECT project_id, supplier_id, 'n' || {_KEY_U} FROM un WHERE {_KEY_U} <> '' UNION ALL SELECT project_id, supplier_id, 'l' || upper(supplier_line || ':' || supplier_mfr) FROM un WHERE supplier_line <> '' AND supplier_mfr <> ''),
ev AS (SELECT store_id, step, sub, base, list(supplier_id ORDER BY supplier_id) AS c FROM lk JOIN ix USING (project_id, key) GROUP BY ALL),
st AS (SELECT store_id, list({{'step': step, 'sub': sub, 'base': base, 'c': c}} ORDER BY step, sub) AS steps FROM ev GROUP BY store_id),
rc(store_id, steps, i, picked, supplier_id) AS (SELECT store_id, steps, 0, []::varchar[], NULL::varchar FROM st
  UNION ALL SELECT store_id, steps, i + 1, CASE WHEN x IS NULL THEN picked ELSE list_append(picked, x) END, x
  FROM (SELECT *, CASE WHEN steps[i + 1].step = 6 AND len(picked) > 0 THEN NULL ELSE list_filter(steps[i + 1].c, lambda c: NOT list_contains(picked, c))[1] END AS x FROM rc WHERE i < len(steps))),
pk AS (SELECT store_id, supplier_id, steps[i].step AS step, steps[i].sub AS sub, steps[i].base AS base FROM rc WHERE supplier_id IS NOT NULL),
cf AS (SELECT pk.*, s.project_id, {_COST} AS pct, coalesce(upper(store_line) = upper(supplier_line) AND store_line <> '', false) AS same FROM pk JOIN s USING (store_id) JOIN u USING (supplier_id)),
cg AS (SELECT *, CASE WHEN pct <= 10 THEN exp(-0.1 * pct) END AS sim FROM cf),
one AS (SELECT store_id, supplier_id, step, CASE step WHEN 2 THEN 'LINE_PN' WHEN 4 THEN 'INTERCHANGE' WHEN 7 THEN 'RULE_BASED' ELSE 'EXACT_NORM' END AS method,
  (CASE step WHEN 1 THEN least(0.99, 0.95 + 0.04 * coalesce(sim, 0)) WHEN 2 THEN least(0.95, 0.90 + 0.05 * coalesce(sim, 0)) WHEN 3 THEN CASE WHEN same THEN least(0.90, least(0.85, 0.75 + 0.10 * coalesce(sim, 0)) + 0.10) ELSE least(0.85, 0.75 + 0.10 * coalesce(sim, 0)) END
   WHEN 4 THEN 1.0 WHEN 5 THEN least(0.92, 0.85 + 0.07 * coalesce(sim, 0)) WHEN 6 THEN least(0.88, 0.80 + 0.08 * coalesce(sim, 0)) ELSE base END)::double AS confidence, CASE WHEN step = 7 THEN sub END AS rule_id FROM cg)"""
_FOURS = "CASE WHEN length({c}) >= 4 THEN list_transform(range(1, length({c}) - 2), lambda i: substr({c}, i, 4)) ELSE [] END"
_SECOND = f"""{_STAGED}, sa AS (SELECT *, {_FOURS.format(c='canon')} AS xs FROM sn WHERE canon <> '' AND store_id NOT IN (SELECT store_id FROM one)), ua AS (SELECT *, canon AS y, {_FOURS.format(c='canon')} AS ys FROM un WHERE canon <> ''),
pa AS (SELECT store_id, supplier_id FROM sa JOIN ua USING (project_id) WHERE (store_line <> '' AND store_line = supplier_line) OR (length(store_mfr) >= 4 AND starts_with(supplier_mfr, substr(store_mfr, 1, 5))) OR list_has_any(xs, ys)),
hs(store_id, k, i, v) AS (SELECT store_id, coalesce(nullif({sql_stored('store_number')}, ''), store_number), 0, 0::bigint FROM sa WHERE store_id NOT IN (SELECT store_id FROM pa)
  UNION ALL SELECT store_id, k, i + 1, (v * 31 + ascii(substr(k, i + 1, 1)) + 2147483648) % 4294967296 - 2147483648 + CASE WHEN (v * 31 + ascii(substr(k, i + 1, 1)) + 2147483648) % 4294967296 < 0 THEN 4294967296 ELSE 0 END FROM hs WHERE i < length(k)),
pl AS (SELECT project_id, supplier_id, row_number() OVER (PARTITION BY project_id ORDER BY supplier_id) - 1 AS place, count(*) OVER (PARTITION BY project_id) AS n FROM ua),
dr AS (SELECT store_id, sa.project_id, unnest(list_transform(range(0, least(1000, n)), lambda j: (j * (n // least(1000, n)) + abs(v)) % n)) AS place FROM hs JOIN sa USING (store_id) JOIN (SELECT DISTINCT project_id, n FROM pl) USING (project_id) WHERE i = length(k)),
pb AS (SELECT * FROM pa UNION ALL SELECT store_id, supplier_id FROM dr JOIN pl USING (project_id, place)),
sc AS (SELECT store_id, supplier_id, {_COST} AS pct, (contains(sa.canon, y) OR contains(y, sa.canon)) AND least(length(sa.canon), length(y)) >= 4 AND least(length(sa.canon), length(y)) / greatest(length(sa.canon), length(y)) >= 0.5 AS inside,
  EXISTS (SELECT 1 FROM (SELECT DISTINCT project_id, supplier_line AS l FROM ua) q WHERE q.project_id = sa.project_id AND q.l = store_line AND store_line <> '') AS own, sa.canon AS x, y, store_text, supplier_text FROM pb JOIN sa USING (store_id) JOIN ua USING (supplier_id)),
sd AS (SELECT *, 0.7 * (CASE WHEN inside THEN least(length(x), length(y)) / greatest(length(x), length(y)) ELSE {sql_edit('x', 'y')} END) + 0.3 * (CASE WHEN coalesce(store_text, '') = '' OR coalesce(supplier_text, '') = '' THEN 0 ELSE {sql_edit('store_text', 'supplier_text')} END) AS score FROM sc),
se AS (SELECT store_id, supplier_id, round(CASE WHEN pct <= 10 THEN least(0.95, score + 0.05 * exp(-0.1 * pct)) WHEN pct > 50 THEN score * 0.9 ELSE score END, 9)::double AS confidence FROM sd WHERE score >= 0.65 * (CASE WHEN inside THEN 0.75 WHEN own THEN 0.9 ELSE 1 END)),
two AS (SELECT store_id, supplier_id, confidence, (row_number() OVER w)::int AS rank, count(*) OVER (PARTITION BY store_id) AS candidates FROM se WINDOW w AS (PARTITION BY store_id ORDER BY confidence DESC, supplier_id) QUALIFY rank <= 3)"""

SQL = {
    "exact_best": f"""{EXACT_BEST} SELECT project_id, store_id, supplier_id, text_similarity, (CASE WHEN store_number = supplier_number AND text_similarity >= 0.9 THEN 0.99 WHEN text_similarity >= 0.9 THEN 0.98
  WHEN text_similarity >= 0.75 THEN 0.95 WHEN text_similarity >= 0.6 THEN 0.92 WHEN text_similarity >= 0.5 THEN 0.87 WHEN text_similarity >= 0.4 THEN 0.83 WHEN text_similarity >= 0.3 THEN 0.80
  WHEN text_similarity >= 0.2 THEN 0.75 ELSE 0.70 END)::double AS confidence FROM b""",
    "exact_stats": f"""{EXACT_BEST} SELECT count(*) AS matches, round(avg(text_similarity), 6) AS average, count(*) FILTER (text_similarity >= 0.9) AS excellent, count(*) FILTER (text_similarity >= 0.75 AND text_similarity < 0.9) AS very_good,
  count(*) FILTER (text_similarity >= 0.6 AND text_similarity < 0.75) AS good, count(*) FILTER (text_similarity >= 0.5 AND text_similarity < 0.6) AS fair, count(*) FILTER (text_similarity < 0.5) AS poor FROM b""",
    "exact_by_line": f"""{_PAIRS} SELECT project_id, store_id, supplier_id, (CASE WHEN store_number = supplier_number AND store_line IS NOT DISTINCT FROM supplier_line THEN 1.0
  WHEN {sql_join_key('store_line')} = {sql_join_key('supplier_line')} THEN 0.98 WHEN {_COMPLEX} THEN 0.95 ELSE 0.92 END)::double AS confidence
FROM p WHERE store_line IS NULL OR supplier_line IS NULL OR {sql_join_key('store_line')} = {sql_join_key('supplier_line')} OR ({_COMPLEX})""",
    "exact_canonical": f"WITH {SQL_ROWS} SELECT s.project_id, store_id, supplier_id, upper(store_canonical) AS canonical FROM s JOIN u ON s.project_id = u.project_id AND upper(store_canonical) = upper(supplier_canonical) WHERE store_canonical <> ''",
    "interchange_bridge": f"WITH {SQL_ROWS}, {_EDGES} SELECT DISTINCT s.project_id, store_id, supplier_id, edge_id FROM s JOIN e ON e.project_id = s.project_id AND e.norm = {_KEY_S} JOIN u ON u.project_id = s.project_id AND {_KEY_U} = e.other",
    "interchange_first": f"""WITH {SQL_ROWS}, {_EDGES}, a AS (SELECT s.project_id, store_id, edge_id, side, vendor, edge_line, other FROM s JOIN e ON e.project_id = s.project_id AND e.norm = {_KEY_S}
  QUALIFY row_number() OVER (PARTITION BY store_id, edge_id ORDER BY side) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY coalesce(trim(vendor) <> '', false) DESC, coalesce(trim(edge_line) <> '', false) DESC, edge_id) = 1),
t AS (SELECT project_id, {_KEY_U} AS other, min(supplier_id) AS supplier_id FROM u GROUP BY ALL)
SELECT b.project_id, store_id, edge_id, side AS matched_on, coalesce(supplier_id, 'INTERCHANGE_ONLY') AS target_id FROM b LEFT JOIN t ON t.project_id = b.project_id AND t.other = b.other""",
    "unmatched_items": "SELECT DISTINCT id, project_id FROM store_items s WHERE NOT EXISTS (SELECT 1 FROM match_candidates c WHERE c.store_item_id = s.id)",
    "matched_items": "SELECT DISTINCT id, project_id FROM store_items s WHERE EXISTS (SELECT 1 FROM match_candidates c WHERE c.store_item_id = s.id)",
    "waterfall_tiers": f"{_WATERFALL} SELECT * FROM w",
    "waterfall_stats": f"{_WATERFALL} SELECT project_id, tier, count(*) AS n FROM w GROUP BY ALL",
    "fuzzy_best": f"{_FUZZY} SELECT * FROM f",
    "fuzzy_bands": f"{_FUZZY} SELECT CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.75 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM f GROUP BY ALL",
    "tiered_candidates": f"""WITH {SQL_ROWS}, a AS (SELECT *, {sql_trigrams('store_number')} AS x FROM s), c AS (SELECT *, {sql_trigrams('supplier_number')} AS y FROM u),
p AS (SELECT project_id, store_id, supplier_id, store_line, supplier_line, {sql_jaccard('x', 'y')} AS sim FROM a JOIN c USING (project_id)),
n AS (SELECT store_id, supplier_id, sim, CASE WHEN upper(store_line) = upper(supplier_line) THEN 1 WHEN sim >= 0.4 THEN 2 END AS tier FROM p WHERE sim >= 0.3),
kw AS (SELECT DISTINCT project_id, store_id, unnest(list_filter({_LONG.format(c='store_text')}, lambda w: length(w) > 3)[1:3]) AS w FROM s WHERE store_id NOT IN (SELECT store_id FROM n WHERE tier IS NOT NULL)),
uw AS (SELECT project_id, supplier_id, ' ' || array_to_string({_LONG.format(c='supplier_text')}, ' ') || ' ' AS held FROM u WHERE supplier_text IS NOT NULL),
al AS (SELECT store_id, supplier_id, tier, sim FROM n WHERE tier IS NOT NULL UNION ALL SELECT store_id, supplier_id, 3, count(*) FROM kw JOIN uw ON kw.project_id = uw.project_id AND contains(held, w) GROUP BY 1, 2),
f AS (SELECT * FROM al QUALIFY tier = min(tier) OVER (PARTITION BY store_id))
SELECT store_id, supplier_id, tier, row_number() OVER (PARTITION BY store_id ORDER BY sim DESC, supplier_id)::int AS rank FROM f QUALIFY rank <= 20""",
    "variation_matches": f"""WITH {SQL_ROWS}, r AS (SELECT project_id, store_id, trim(store_number) AS c FROM s WHERE store_number IS NOT NULL),
v AS (SELECT project_id, store_id, unnest([c, CASE WHEN regexp_matches(c, '[A-Z]$') THEN substr(c, 1, length(c) - 1) END, regexp_replace(c, '[-\\s]', '', 'g'),
  CASE WHEN NOT contains(c, '-') AND length(c) > 4 THEN substr(c, 1, 4) || '-' || substr(c, 5) END, CASE WHEN NOT contains(c, '-') AND length(c) > 6 THEN substr(c, 1, 3) || '-' || substr(c, 4) END]) AS variant, unnest([1, 2, 3, 4, 5]) AS k FROM r),
f AS (SELECT project_id, store_id, variant, min(k) AS k FROM v WHERE variant IS NOT NULL GROUP BY ALL),
n AS (SELECT *, (row_number() OVER (PARTITION BY store_id ORDER BY k) - 1)::int AS place FROM f),
b AS (SELECT n.project_id, store_id, supplier_id, place FROM n JOIN u ON u.project_id = n.project_id AND {sql_lower_key('variant')} = {sql_lower_key('supplier_number')} AND {sql_lower_key('variant')} <> ''
  QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY place, supplier_id) = 1)
SELECT *, greatest(0.6, 0.75 - 0.05 * place)::double AS confidence FROM b""",
    "brand_collisions": f"""SELECT project_id, {sql_stored('part_number')} AS norm, count(DISTINCT brand) + max((brand IS NULL)::int) AS brands, count(*) AS listings
FROM (SELECT DISTINCT id, project_id, part_number, brand FROM supplier_items) WHERE {sql_stored('part_number')} <> '' GROUP BY 1, 2 HAVING count(DISTINCT brand) + max((brand IS NULL)::int) > 2""",
    "match_scores": f"WITH {SQL_ROWS}, {SQL_ALIKE} SELECT store_id, supplier_id, {_NUMBER} AS number_score, {sql_edit('store_number', 'supplier_number')} AS edit_score, text_similarity FROM p",
    "weighted_scores": f"""WITH {SQL_ROWS}, {SQL_ALIKE}, c AS (SELECT DISTINCT id, category AS c1, subcategory AS s1 FROM store_items), d AS (SELECT DISTINCT id, category AS c2, subcategory AS s2 FROM supplier_items),
q AS (SELECT store_id, supplier_id, {_NUMBER} AS n, {sql_jaccard(_WORDS.format(c='store_text'), _WORDS.format(c='supplier_text'))} AS w, {_ATTR.format(a='c1', b='c2')} AS a, {_ATTR.format(a='s1', b='s2')} AS b
  FROM p JOIN c ON c.id = store_id JOIN d ON d.id = supplier_id)
SELECT store_id, supplier_id, w AS word_score, (CASE WHEN a = 0 THEN 0 ELSE greatest(0, least(1, n * 0.5 + w * 0.3 + a * 0.1 + b * 0.1)) END)::double AS score FROM q""",
    "additive_scores": f"""WITH {SQL_ROWS}, p AS (SELECT *, coalesce(store_number, '') <> '' AND coalesce(supplier_number, '') <> '' AS told FROM s JOIN u USING (project_id)),
q AS (SELECT store_id, supplier_id, round(CASE WHEN upper(store_line) = upper(supplier_line) AND store_line <> '' THEN 100 ELSE 0 END
  + CASE WHEN told AND (contains(upper(store_number), upper(supplier_number)) OR contains(upper(supplier_number), upper(store_number))) THEN 50 ELSE 0 END + CASE WHEN told THEN 40 * {sql_edit('store_number', 'supplier_number')} ELSE 0 END
  + 5 * coalesce(len(list_intersect(list_distinct(list_filter(string_split_regex(lower(store_text), '\\s+'), lambda w: length(w) > 3)), list_distinct(list_filter(string_split_regex(lower(supplier_text), '\\s+'), lambda w: length(w) > 3)))), 0)
  + CASE WHEN abs(store_cost::double - supplier_cost::double) < 5 THEN 20 WHEN abs(store_cost::double - supplier_cost::double) < 20 THEN 10 ELSE 0 END, 9)::double AS score FROM p)
SELECT store_id, supplier_id, score, row_number() OVER (PARTITION BY store_id ORDER BY score DESC, supplier_id)::int AS rank FROM q WHERE score >= 10 QUALIFY rank <= 100""",
    "learned_punctuation": f"WITH {_RULES} SELECT * FROM pr",
    "staged": f"{_STAGED} SELECT * FROM one",
    "second_stage_top3": f"{_SECOND} SELECT * FROM two",
    "staged_pipeline": f"{_SECOND} SELECT store_id, supplier_id, 1 AS stage, method, confidence FROM one UNION ALL SELECT store_id, supplier_id, 2, 'FUZZY_SUBSTRING', confidence FROM two",
    "stage_metrics": f"""{_SECOND}, n AS (SELECT count(DISTINCT id) AS n FROM store_items), r AS (SELECT count(DISTINCT id) AS n FROM store_items WHERE id NOT IN (SELECT store_id FROM one)), b AS (SELECT store_id, max(confidence) AS best FROM two GROUP BY 1)
SELECT 1 AS stage, 'Deterministic Matching' AS name, n AS items, (SELECT count(*) FROM one) AS matches, round(coalesce((SELECT count(*) FROM one) / nullif(n, 0), 0), 6)::double AS match_rate, round(coalesce((SELECT avg(confidence) FROM one), 0), 6)::double AS average FROM n
UNION ALL SELECT 2, 'Fuzzy Matching', n, (SELECT count(*) FROM two), round(coalesce((SELECT count(*) FROM b) / nullif(n, 0), 0), 6)::double, round(coalesce((SELECT avg(best) FROM b), 0), 6)::double FROM r""",
    "vector_nearest": """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT query_id, vec_id AS target_id, list_cosine_similarity(q::double[], embedding::double[]) AS similarity FROM q, embeddings)
SELECT query_id, target_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, target_id)::int AS rank FROM p WHERE similarity >= 0 QUALIFY rank <= 10""",
}
