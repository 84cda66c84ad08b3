"""Queries that score candidates in the further ways, and look candidates up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partweave.functions import text as t
from partweave.functions.similarity import composite_score, cost_validated, incompatible, windowed_similarity, word_jaccard
from partweave.operators import matching as m
from partweave.operators.rules import line_code_map
from partweave.operators.simjoin import trigram_join
from partweave.operators.skew import HOT_LEAST, split_join
from partweave.plans.forms import GENERIC_NUMBER
from partweave.plans.identifiers import SQL as IDENTIFIER_SQL
from partweave.plans.matchers import EXACT_BEST
from partweave.plans.reports import _LINES
from partweave.plans.sqltext import SQL_ROWS, sql_jaccard, sql_lower_key, sql_score_key, sql_stored, sql_trigrams
from partweave.sources.tables import table


def _two(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "store_items"), table(spark, folder, "supplier_items")


def ranked_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return m.ranked_candidates(*_two(spark, folder))


def catalogue_best(spark: SparkSession, folder: str) -> DataFrame:
    return m.catalogue_best(*_two(spark, folder))


def keyword_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Of each project the 100 supplier rows whose number, line code and description hold most of the numbers and line
    codes of the rows that can be searched for."""
    stores, suppliers = _two(spark, folder)
    n, text, line = F.col("part_number"), F.col("description"), F.col("line_code")
    some = lambda c: F.coalesce(c != "", F.lit(False))
    kept = m.once(stores).filter((F.length(n) >= 2) & ~n.rlike(GENERIC_NUMBER) & (some(text) | some(line)))
    words = kept.select("project_id", F.explode(F.array_compact(F.array(F.lower(n), F.lower(F.nullif(line, F.lit("")))))).alias("word")).distinct()
    whole = F.lower(F.concat(F.col("part_number"), F.lit(" "), F.coalesce("line_code", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    u = m.once(suppliers).filter("part_number is not null").select("project_id", F.col("id").alias("supplier_id"), whole.alias("whole"))
    counts = m.words_held(words, u).groupBy("project_id", "supplier_id").agg(F.count("*").alias("hits"))
    order = Window.partitionBy("project_id").orderBy(F.col("hits").desc(), F.col("supplier_id"))
    return counts.withColumn("rank", F.row_number().over(order)).filter("rank <= 100")


def composite_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Composite score of pairs with alike numbers, why a pair is ruled out, and a cap where the number is ambiguous (more
    than two brands list it) and neither brand nor line code tells them apart."""
    stores, suppliers = _two(spark, folder)
    makers = F.broadcast(line_code_map(table(spark, folder, "line_code_mappings")).filter("maker is not null").select("client_code", "maker"))
    s = m.once(stores).select(F.col("id").alias("store_id"), F.col("subcategory").alias("store_sub"), F.upper(F.trim("line_code")).alias("client_code")).join(makers, "client_code", "left")
    u = m.once(suppliers).select(F.col("id").alias("supplier_id"), F.col("subcategory").alias("supplier_sub"), "brand", "project_id", t.norm_stored(F.col("part_number")).alias("norm"))
    u = u.join(m.collisions(suppliers).select("project_id", "norm", F.lit(True).alias("ambiguous")), ["project_id", "norm"], "left").drop("project_id", "norm")
    p = m.alike_pairs(stores, suppliers).join(s, "store_id").join(u, "supplier_id")
    a, b = t.norm_stored(F.col("store_number")), t.norm_stored(F.col("supplier_number"))
    part = windowed_similarity(a, b)
    mfr = F.when((F.col("store_mfr") != "") & (F.col("supplier_mfr") != ""), windowed_similarity(t.norm_stored(F.col("store_mfr")), t.norm_stored(F.col("supplier_mfr"))))
    told = (F.col("store_text") != "") & (F.col("supplier_text") != "")
    words = F.when(told, word_jaccard(F.col("store_text"), F.col("supplier_text"), None)).otherwise(0.0)
    plain = lambda c: t.norm_punct(F.coalesce(F.col(c), F.lit("")))
    score = composite_score(part, words, mfr, F.col("store_cost"), F.col("supplier_cost"), plain("store_number") == plain("supplier_number"))
    other_maker = F.coalesce(F.lower("brand") != F.lower("maker"), F.lit(False))
    reason = F.when(incompatible(F.col("store_sub"), F.col("supplier_sub")), "SUBCATEGORY_MISMATCH").when(other_maker, "LINECODE_MANUFACTURER_MISMATCH").when(told & (words < 0.2) & (part < 0.4), "EXTREME_MISMATCH")
    apart = F.coalesce(F.lower("brand") == F.lower("maker"), F.lit(False)) | F.coalesce(F.col("store_line") == F.col("supplier_line"), F.lit(False))
    capped = F.when(F.col("ambiguous").isNotNull() & ~apart, F.least(score, F.lit(0.6))).otherwise(score)
    return p.select("store_id", "supplier_id", F.round(capped, 6).alias("confidence"), reason.alias("rejected"))


def cost_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Best exact matches with their confidence after a look at the costs."""
    stores, suppliers = _two(spark, folder)
    costs = lambda df, key: m.once(df).select(F.col("id").alias(key), F.col("current_cost").alias(f"{key}_cost"))
    best = m.exact_best(stores, suppliers).join(costs(stores, "store_id"), "store_id").join(costs(suppliers, "supplier_id"), "supplier_id")
    return best.select("store_id", "supplier_id", F.round(cost_validated(F.col("confidence"), F.col("store_id_cost"), F.col("supplier_id_cost")), 6).alias("confidence"))


def interchange_direct(spark: SparkSession, folder: str) -> DataFrame:
    """Store rows without a candidate whose number is any of the four numbers of an interchange of their project, with the
    first supplier row that bears any of the four, or INTERCHANGE_ONLY; the first of all by target, then interchange."""
    stores, suppliers = _two(spark, folder)
    numbers = ["merrill_part_number", "vendor_part_number", "ours_part_number", "theirs_part_number"]
    norms = F.array_distinct(F.array_compact(F.array(*[F.nullif(t.norm_stored(F.col(c)), F.lit("")) for c in numbers])))
    edges = m.once(table(spark, folder, "interchanges")).select("project_id", F.col("id").alias("edge_id"), F.explode(norms).alias("norm"))
    open_rows = m.unmatched(stores, table(spark, folder, "match_candidates")).select("project_id", F.col("id").alias("store_id"), t.norm_stored(F.col("part_number")).alias("norm")).filter("norm <> ''")
    u = m.once(suppliers).select("project_id", F.col("id").alias("supplier_id"), t.norm_stored(F.col("part_number")).alias("norm")).filter("norm <> ''")
    firsts = u.groupBy("project_id", "norm").agg(F.min("supplier_id").alias("supplier_id"))
    targets = edges.join(firsts, ["project_id", "norm"]).groupBy("project_id", "edge_id").agg(F.min("supplier_id").alias("supplier_id"))
    met = open_rows.join(edges, ["project_id", "norm"]).join(targets, ["project_id", "edge_id"], "left").withColumn("target_id", F.coalesce("supplier_id", F.lit("INTERCHANGE_ONLY")))
    best = m.first_by(met, ["store_id"], [F.col("target_id"), F.col("edge_id")])
    return best.select("store_id", "target_id", "edge_id", F.when(F.col("supplier_id").isNull(), "INTERCHANGE_ONLY").otherwise("INTERCHANGE_BRIDGE").alias("method"))


def variant_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """For each store row the candidates of its first tier that has any: the same line code and number similarity .3, the
    best 20; a spelling variant with similarity .5, the best 20 by the number itself; one of its first five keywords
    anywhere in the description, the first 50 by id."""
    stores, suppliers = _two(spark, folder)
    ws = m.Workspace(spark, "variants")
    s = ws.save(m._store(stores).select("project_id", "store_id", "store_number", "store_line", "store_text"), "stores")
    u = ws.save(m._supplier(suppliers).select("project_id", "supplier_id", "supplier_number", "supplier_line", "supplier_text"), "suppliers")
    upper = lambda c: F.upper(F.col(c))
    in_line = lambda rows, side: rows.filter(F.col(f"{side}_line") != "").withColumn("line", F.struct("project_id", F.col(f"{side}_line").alias("code")))
    lines = trigram_join(in_line(s, "store"), in_line(u, "supplier"), "line", "store_id", "supplier_id", upper("store_number"), upper("supplier_number"), 0.3)
    order = Window.partitionBy("store_id").orderBy(F.col("similarity").desc(), F.col("supplier_id"))
    top = lambda rows, tier, n: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("store_id", "supplier_id", F.lit(tier).alias("tier"), "rank")
    one = ws.save(top(lines, 1, 20), "one")
    rest = ws.save(s.join(one.select("store_id").distinct(), "store_id", "left_anti"), "rest")
    spelled = rest.filter("store_number is not null").select("project_id", "store_id", "store_number", F.posexplode(t.number_variants(F.col("store_number"))).alias("k", "variant"))
    spelled = spelled.withColumn("row", F.struct("store_id", "k"))
    near = trigram_join(spelled, u, "project_id", "row", "supplier_id", upper("variant"), upper("supplier_number"), 0.5)
    pairs = near.select("row.store_id", "supplier_id").distinct().join(rest.select("store_id", "store_number"), "store_id").join(u.select("supplier_id", "supplier_number"), "supplier_id")
    scored = pairs.withColumn("similarity", m.trigram_similarity(upper("store_number"), upper("supplier_number")))
    two = ws.save(top(scored, 2, 20), "two")
    rest = rest.join(two.select("store_id").distinct(), "store_id", "left_anti")
    words = ws.save(rest.select("project_id", "store_id", F.explode(F.array_distinct(t.keywords(F.col("store_text")))).alias("word")), "words")
    held = m.words_held(words.select("project_id", "word").distinct(), u.filter("supplier_text is not null").select("project_id", "supplier_id", F.upper("supplier_text").alias("whole")))
    three = top(_first_holders(words, held, 50).withColumn("similarity", F.lit(0.0)), 3, 50)
    return one.unionByName(two).unionByName(three)


def _first_holders(words: DataFrame, held: DataFrame, most: int, hot_least: int = HOT_LEAST) -> DataFrame:
    """(store_id, supplier_id), each once: supplier rows that hold a word of the store row, the first ``most`` of them among
    these.  ``words`` is (project_id, store_id, word), ``held`` (project_id, word, supplier_id).

    Of a word only its first ``most`` holders can count, and of a store row's words none beyond the least last place of
    a word with so many; so rows never meet all holders of a word."""
    ws = m.Workspace(words.sparkSession, "holders")
    by_word = Window.partitionBy("project_id", "word").orderBy("supplier_id")
    firsts = held.withColumn("_r", F.row_number().over(by_word)).filter(F.col("_r") <= most)
    firsts = ws.save(firsts.groupBy("project_id", "word").agg(F.sort_array(F.collect_list("supplier_id")).alias("ids")), "firsts")
    keys = ["project_id", "word"]
    ends = split_join(words, firsts.select(*keys, F.get("ids", F.lit(most - 1)).alias("last")), keys, "store_id", "word", hot_least)
    bounded = words.join(ends.groupBy("store_id").agg(F.min("last").alias("bound")), "store_id")
    met = split_join(ws.save(bounded, "bounded"), firsts, keys, "store_id", "word", hot_least)
    kept = F.filter("ids", lambda i: F.col("bound").isNull() | (i <= F.col("bound")))
    return met.select("store_id", F.explode(kept).alias("supplier_id")).distinct()


def supersessions(spark: SparkSession, folder: str) -> DataFrame:
    """Store rows whose number an interchange replaces, and the first supplier row that bears the replacement, of the
    stated line code if one is stated; .85 of the confidence, .80 at most."""
    stores, suppliers = _two(spark, folder)
    key = lambda c: t.norm_lower(F.col(c))
    e = m.once(table(spark, folder, "interchanges")).select("project_id", F.col("id").alias("edge_id"), key("merrill_part_number").alias("old"), key("vendor_part_number").alias("new"), F.col("line_code").alias("maker"), "confidence").filter("old <> '' and new <> '' and old <> new")
    s = m._store(stores).select("project_id", "store_id", key("store_number").alias("old"))
    u = m._supplier(suppliers).select("project_id", "supplier_id", "supplier_line", key("supplier_number").alias("new"))
    met = s.join(e, ["project_id", "old"]).join(u, ["project_id", "new"]).filter("maker is null or maker = '' or maker = 'Unknown' or supplier_line = maker")
    best = m.first_by(met, ["store_id", "edge_id"], [F.col("supplier_id")])
    return best.select("store_id", "edge_id", "supplier_id", F.round(F.least(F.col("confidence") * 0.85, F.lit(0.80)), 6).alias("confidence"))


QUERIES = {
    "ranked_candidates": ranked_candidates, "catalogue_best": catalogue_best, "keyword_hits": keyword_hits, "composite_scores": composite_scores, "cost_validation": cost_validation,
    "interchange_direct": interchange_direct, "variant_lookup": variant_lookup, "supersessions": supersessions,
}

_RUN = """(CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0 WHEN {a} = {b} THEN 1 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN least(length({a}), length({b})) / greatest(length({a}), length({b}))
  ELSE coalesce(list_max(list_filter(range(3, least(length({a}), length({b})) + 1), lambda k: len(list_filter(range(1, least(length({a}), length({b})) - k + 2),
    lambda i: contains(CASE WHEN length({a}) > length({b}) THEN {a} ELSE {b} END, substr(CASE WHEN length({a}) > length({b}) THEN {b} ELSE {a} END, i, k)))) > 0)), 0) / greatest(length({a}), length({b})) END)"""
_R3 = "CASE WHEN length({c}) > 2 THEN list_transform(range(1, length({c}) - 1), lambda i: '{t}' || substr({c}, i, 3)) WHEN length({c}) > 0 THEN ['{t}' || {c}] ELSE [] END"
_W4 = "list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: length(w) > 3)"
_WINDOWED = IDENTIFIER_SQL["windowed_scores"]
_MATCHED = "sa AS (SELECT DISTINCT project_id, id AS store_id, {s} AS norm FROM store_items WHERE id NOT IN (SELECT store_item_id FROM match_candidates WHERE store_item_id IS NOT NULL))"
SQL = {
    "ranked_candidates": f"""WITH {SQL_ROWS}, sx AS (SELECT *, {sql_stored('store_number')} AS n, {sql_stored('store_mfr')} AS f, {_W4.format(c='store_text')} AS w FROM s), ux AS (SELECT *, {sql_stored('supplier_number')} AS o, {sql_stored('supplier_mfr')} AS g, {_W4.format(c='supplier_text')} AS v FROM u),
sk AS (SELECT *, {_R3.format(c='f', t='m')} || {_R3.format(c='n', t='n')} AS x FROM sx), uk AS (SELECT *, {_R3.format(c='g', t='m')} || {_R3.format(c='o', t='n')} AS y FROM ux),
pa AS (SELECT *, coalesce(store_line = supplier_line AND store_line <> '', false) AS same, list_has_any(x, y) AS runs, coalesce(len(list_filter(w, lambda z: list_contains(v, z))) >= 2, false) AS said FROM sk JOIN uk USING (project_id)),
pb AS (SELECT *, CASE WHEN runs OR same THEN {_RUN.format(a='n', b='o')} ELSE 0 END AS nn, CASE WHEN runs OR same THEN {_RUN.format(a='f', b='g')} ELSE 0 END AS ff FROM pa WHERE runs OR same OR said),
pc AS (SELECT *, same OR ff >= 0.5 OR nn >= 0.45 AS near FROM pb), pd AS (SELECT *, count(*) FILTER (near) OVER (PARTITION BY store_id) AS k FROM pc),
pe AS (SELECT store_id, supplier_id, round(nn + 0.4 * ff + CASE WHEN same THEN 0.25 ELSE 0 END + CASE WHEN len(list_filter(v, lambda z: list_contains(w, z))) >= 2 THEN least(0.2, 0.05 * len(list_filter(v, lambda z: list_contains(w, z)))) ELSE 0 END, 9)::double AS score FROM pd WHERE near OR (said AND k < 180))
SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY score DESC, supplier_id)::int AS rank FROM pe QUALIFY rank <= 50""",
    "catalogue_best": f"""WITH {SQL_ROWS}, sx AS (SELECT project_id, store_id, {sql_score_key('store_number')} AS n, CASE WHEN store_line <> '' THEN regexp_replace({sql_score_key('store_number')}, '^(.*?)' || {sql_score_key('store_line')}, '\\1') END AS c,
  list_filter(string_split_regex(upper(store_text), '\\s+'), lambda w: length(w) > 3) AS w, {sql_score_key('store_mfr')} AS f FROM s WHERE store_number IS NOT NULL),
ux AS (SELECT project_id, supplier_id, {sql_score_key('supplier_number')} AS o, CASE WHEN supplier_line <> '' THEN regexp_replace({sql_score_key('supplier_number')}, '^(.*?)' || {sql_score_key('supplier_line')}, '\\1') END AS d,
  list_filter(string_split_regex(upper(supplier_text), '\\s+'), lambda w: length(w) > 3) AS v, {sql_score_key('supplier_mfr')} AS g FROM u WHERE supplier_number IS NOT NULL),
pa AS (SELECT *, least(length(n), length(o)) AS sh, greatest(length(n), length(o)) AS lo FROM sx JOIN ux USING (project_id)),
pb AS (SELECT *, CASE WHEN n = o THEN 1.0 WHEN c IS NOT NULL AND d IS NOT NULL THEN CASE WHEN c = d AND length(c) >= 4 THEN 0.95 ELSE 0 END WHEN contains(n, o) OR contains(o, n) THEN sh / lo * 0.9 WHEN sh / lo < 0.75 THEN 0
  ELSE CASE WHEN 1 - levenshtein(n, o) / lo >= 0.75 THEN (1 - levenshtein(n, o) / lo) * 0.85 ELSE 0 END END AS base FROM pa),
pc AS (SELECT *, CASE WHEN len(list_filter(w, lambda z: list_contains(v, z))) >= 2 THEN least(1.0, base + 0.1) ELSE base END AS t FROM pb WHERE base > 0),
pd AS (SELECT store_id, supplier_id, round(CASE WHEN f = g AND f <> '' THEN least(1.0, t + 0.15) ELSE t END, 9)::double AS score FROM pc)
SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY score DESC, supplier_id) = 1""",
    "keyword_hits": f"""WITH k AS (SELECT DISTINCT project_id, part_number AS n, line_code AS l FROM store_items WHERE length(part_number) >= 2 AND NOT regexp_matches(part_number, '{GENERIC_NUMBER}') AND (coalesce(description <> '', false) OR coalesce(line_code <> '', false))),
w AS (SELECT project_id, lower(n) AS word FROM k UNION SELECT project_id, lower(l) FROM k WHERE l <> ''),
u AS (SELECT DISTINCT project_id, id AS supplier_id, lower(part_number || ' ' || coalesce(line_code, '') || ' ' || coalesce(description, '')) AS whole FROM supplier_items WHERE part_number IS NOT NULL),
h AS (SELECT u.project_id, supplier_id, count(*) AS hits FROM w JOIN u ON u.project_id = w.project_id AND contains(whole, word) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY hits DESC, supplier_id)::int AS rank FROM h QUALIFY rank <= 100""",
    "cost_validation": f"""{EXACT_BEST}, k AS (SELECT store_id, supplier_id, CASE WHEN store_cost > 0 AND supplier_cost > 0 THEN greatest(store_cost::double, supplier_cost::double) / least(store_cost::double, supplier_cost::double) END AS r, (CASE WHEN store_number = supplier_number AND text_similarity >= 0.9 THEN 0.99
  WHEN text_similarity >= 0.9 THEN 0.98 WHEN text_similarity >= 0.75 THEN 0.95 WHEN text_similarity >= 0.6 THEN 0.92 WHEN text_similarity >= 0.5 THEN 0.87 WHEN text_similarity >= 0.4 THEN 0.83 WHEN text_similarity >= 0.3 THEN 0.80 WHEN text_similarity >= 0.2 THEN 0.75 ELSE 0.70 END)::double AS c FROM b)
SELECT store_id, supplier_id, round(CASE WHEN r > 5 THEN c * 0.5 WHEN r < 1.05 THEN least(1.0, c + 0.05) ELSE c END, 6)::double AS confidence FROM k""",
    "interchange_direct": f"""WITH {_MATCHED.format(s=sql_stored('part_number'))}, u AS (SELECT DISTINCT project_id, id AS supplier_id, {sql_stored('part_number')} AS norm FROM supplier_items),
e AS (SELECT DISTINCT project_id, id AS edge_id, unnest([{sql_stored('merrill_part_number')}, {sql_stored('vendor_part_number')}, {sql_stored('ours_part_number')}, {sql_stored('theirs_part_number')}]) AS norm FROM interchanges),
g AS (SELECT e.project_id, edge_id, min(supplier_id) AS supplier_id FROM e JOIN u ON u.project_id = e.project_id AND u.norm = e.norm AND e.norm <> '' GROUP BY ALL),
p AS (SELECT DISTINCT store_id, e.edge_id, supplier_id, coalesce(supplier_id, 'INTERCHANGE_ONLY') AS target_id FROM sa JOIN e ON e.project_id = sa.project_id AND e.norm = sa.norm AND sa.norm <> '' LEFT JOIN g ON g.project_id = e.project_id AND g.edge_id = e.edge_id)
SELECT store_id, target_id, edge_id, CASE WHEN supplier_id IS NULL THEN 'INTERCHANGE_ONLY' ELSE 'INTERCHANGE_BRIDGE' END AS method FROM p QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY target_id, edge_id) = 1""",
    "variant_lookup": f"""WITH {SQL_ROWS}, a AS (SELECT *, {sql_trigrams('store_number')} AS x FROM s), c AS (SELECT *, {sql_trigrams('supplier_number')} AS y FROM u),
p1 AS (SELECT store_id, supplier_id, 1 AS tier, row_number() OVER (PARTITION BY store_id ORDER BY {sql_jaccard('x', 'y')} DESC, supplier_id)::int AS rank FROM a JOIN c USING (project_id) WHERE store_line = supplier_line AND store_line <> '' AND {sql_jaccard('x', 'y')} >= 0.3 QUALIFY rank <= 20),
v AS (SELECT project_id, store_id, x, unnest([store_number, CASE WHEN regexp_matches(store_number, '[A-Z]$') THEN substr(store_number, 1, length(store_number) - 1) END, regexp_replace(store_number, '[-\\s]', '', 'g'),
  CASE WHEN NOT contains(store_number, '-') AND length(store_number) > 4 THEN substr(store_number, 1, 4) || '-' || substr(store_number, 5) END, CASE WHEN NOT contains(store_number, '-') AND length(store_number) > 6 THEN substr(store_number, 1, 3) || '-' || substr(store_number, 4) END]) AS variant
  FROM a WHERE store_number IS NOT NULL AND store_id NOT IN (SELECT store_id FROM p1)),
vv AS (SELECT DISTINCT project_id, store_id, x, variant, {sql_trigrams('variant')} AS z FROM v WHERE variant IS NOT NULL),
q2 AS (SELECT DISTINCT store_id, supplier_id, {sql_jaccard('x', 'y')} AS sim FROM vv JOIN c USING (project_id) WHERE {sql_jaccard('z', 'y')} >= 0.5),
p2 AS (SELECT store_id, supplier_id, 2, row_number() OVER (PARTITION BY store_id ORDER BY sim DESC, supplier_id)::int AS rank FROM q2 QUALIFY rank <= 20),
w AS (SELECT DISTINCT project_id, store_id, unnest(list_filter(string_split_regex(regexp_replace(upper(store_text), '[^A-Z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('THE','A','AN','AND','OR','FOR','WITH','TO','IN','ON','AT'))[1:5]) AS word
  FROM s WHERE store_id NOT IN (SELECT store_id FROM p1) AND store_id NOT IN (SELECT store_id FROM p2)),
q3 AS (SELECT DISTINCT store_id, supplier_id FROM w JOIN u ON u.project_id = w.project_id AND contains(upper(supplier_text), word)),
p3 AS (SELECT store_id, supplier_id, 3, row_number() OVER (PARTITION BY store_id ORDER BY supplier_id)::int AS rank FROM q3 QUALIFY rank <= 50)
SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3""",
    "supersessions": f"""WITH {SQL_ROWS}, e AS (SELECT DISTINCT project_id, id AS edge_id, {sql_lower_key('merrill_part_number')} AS old, {sql_lower_key('vendor_part_number')} AS new, line_code AS maker, confidence FROM interchanges)
SELECT store_id, edge_id, supplier_id, round(least(confidence * 0.85, 0.80), 6)::double AS confidence FROM e JOIN s ON s.project_id = e.project_id AND {sql_lower_key('store_number')} = old JOIN u ON u.project_id = e.project_id AND {sql_lower_key('supplier_number')} = new
WHERE old <> '' AND new <> '' AND old <> new AND (maker IS NULL OR maker = '' OR maker = 'Unknown' OR supplier_line = maker) QUALIFY row_number() OVER (PARTITION BY store_id, edge_id ORDER BY supplier_id) = 1""",
}
# the composite score takes the windowed match of any two numbers from the recursion of windowed_scores
_HEAD, _TAIL = _WINDOWED.split("q AS (SELECT DISTINCT store_number AS a", 1)
_STEPS = _TAIL.split("\nSELECT store_id", 1)[0].split("\n", 1)[1]
SQL["composite_scores"] = (
    _HEAD.replace("WITH RECURSIVE", f"WITH RECURSIVE {_LINES}, ")
    + f"""pn AS (SELECT *, {sql_stored('store_number')} AS n, {sql_stored('supplier_number')} AS o, {sql_stored('store_mfr')} AS f, {sql_stored('supplier_mfr')} AS h FROM p),
q AS (SELECT n AS a, o AS b FROM pn WHERE n <> '' AND o <> '' UNION SELECT f, h FROM pn WHERE f <> '' AND h <> ''),
{_STEPS},
sm AS (SELECT DISTINCT store_items.id AS store_id, subcategory AS s1, maker FROM store_items LEFT JOIN m ON client_code = upper(trim(line_code))),
am AS (SELECT project_id, {sql_stored('part_number')} AS norm FROM (SELECT DISTINCT id, project_id, part_number, brand FROM supplier_items) WHERE {sql_stored('part_number')} <> '' GROUP BY 1, 2 HAVING count(DISTINCT brand) + max((brand IS NULL)::int) > 2),
um AS (SELECT DISTINCT id AS supplier_id, subcategory AS s2, brand, EXISTS (SELECT 1 FROM am WHERE am.project_id = supplier_items.project_id AND am.norm = {sql_stored('part_number')}) AS amb FROM supplier_items),
z AS (SELECT pn.*, s1, s2, maker, brand, amb, coalesce(g1.score, 0) AS part, CASE WHEN store_mfr <> '' AND supplier_mfr <> '' THEN coalesce(g2.score, 0) ELSE 0 END AS mfr, store_text <> '' AND supplier_text <> '' AS told,
  store_cost::double / nullif(supplier_cost::double, 0) AS ratio FROM pn JOIN sm USING (store_id) JOIN um USING (supplier_id) LEFT JOIN g g1 ON g1.a = n AND g1.b = o LEFT JOIN g g2 ON g2.a = f AND g2.b = h),
y AS (SELECT *, CASE WHEN told THEN {sql_jaccard("list_distinct(string_split_regex(lower(store_text), '\\s+'))", "list_distinct(string_split_regex(lower(supplier_text), '\\s+'))")} ELSE 0 END AS words FROM z),
x AS (SELECT *, least(1.0, 0.4 * part + 0.3 * words + 0.2 * mfr + 0.1 * CASE WHEN store_cost <> 0 AND ratio BETWEEN 0.5 AND 2 THEN greatest(0, 1 - abs(1 - ratio)) ELSE 0 END
  + CASE WHEN upper(translate(coalesce(store_number, ''), '-/.', '')) = upper(translate(coalesce(supplier_number, ''), '-/.', '')) THEN 0.1 ELSE 0 END) AS score FROM y)
SELECT store_id, supplier_id, round(CASE WHEN amb AND NOT (coalesce(lower(brand) = lower(maker), false) OR coalesce(store_line = supplier_line, false)) THEN least(score, 0.6) ELSE score END, 6)::double AS confidence,
  CASE WHEN {" OR ".join(f"(contains(lower(s1), '{a}') AND contains(lower(s2), '{b}')) OR (contains(lower(s1), '{b}') AND contains(lower(s2), '{a}'))" for a, b in (('clip', 'cable'), ('battery', 'belt'), ('hose', 'wiring'), ('axle', 'brake')))} THEN 'SUBCATEGORY_MISMATCH'
  WHEN lower(brand) <> lower(maker) THEN 'LINECODE_MANUFACTURER_MISMATCH' WHEN told AND words < 0.2 AND part < 0.4 THEN 'EXTREME_MISMATCH' END AS rejected FROM x"""
)
