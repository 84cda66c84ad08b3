"""Queries over further forms of numbers, codes, changes and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.functions import text as t
from partweave.functions.similarity import suitability, word_jaccard
from partweave.operators import matching as m
from partweave.operators.rules import line_code_map, newest
from partweave.plans.matchers import _COMPLEX, _FUZZY, _PAIRS, EXACT_BEST
from partweave.plans.reports import _LINES, _newest
from partweave.plans.sqltext import sql_jaccard, sql_join_key
from partweave.sources.tables import table


def _two(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "store_items"), table(spark, folder, "supplier_items")


def number_forms_more(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("part_number")
    fixed, wide = t.line_code_fixed(n), t.line_code_wide(n)
    return m.once(table(spark, folder, "store_items")).filter("part_number is not null").select(
        "id", t.canonical_form(n, prefix="K").alias("without_prefix"), t.canonical_form(n, keep_case=True).alias("case_kept"), t.norm_catalogue(n).alias("catalogue"),
        fixed["line_code"].alias("fixed_code"), fixed["mfr_part"].alias("fixed_part"), wide["line_code"].alias("wide_code"), wide["mfr_part"].alias("wide_part"),
        t.left(n, 3).alias("left3"), t.mid(n, 4, 5).alias("mid5"), t.plain_cell(n).alias("cell"),
    )


def brand_names(spark: SparkSession, folder: str) -> DataFrame:
    """Brands of the stores' line codes by the fixed list, and by the mapping table before the wider list."""
    known = line_code_map(table(spark, folder, "line_code_mappings")).filter("maker is not null").select(F.col("client_code").alias("code"), F.upper("maker").alias("known"))
    s = m.once(table(spark, folder, "store_items")).select("id", F.upper(F.trim("line_code")).alias("code")).join(F.broadcast(known), "code", "left")
    return s.select("id", t.brand_of(F.col("code")).alias("brand"), t.brand_of(F.col("code"), F.col("known"), t.WIDER_BRANDS).alias("wider_brand"))


def exact_reasons(spark: SparkSession, folder: str) -> DataFrame:
    stores, suppliers = _two(spark, folder)
    numbers = lambda df, key: m.once(df).select(F.col("id").alias(key), F.col("part_number").alias(f"{key}_number"))
    best = m.exact_best(stores, suppliers).join(numbers(stores, "store_id"), "store_id").join(numbers(suppliers, "supplier_id"), "supplier_id")
    return best.select("store_id", "supplier_id", t.exact_reason(F.col("store_id_number") == F.col("supplier_id_number"), F.round("text_similarity", 9)).alias("reason"))


def line_reasons(spark: SparkSession, folder: str) -> DataFrame:
    a, b, n = F.col("store_line"), F.col("supplier_line"), F.col("store_number")
    same = (n == F.col("supplier_number")) & a.eqNullSafe(b)
    told = t.line_reason(same, t.norm_join(a) == t.norm_join(b), m.is_complex_number(n), a, b)
    return m.exact_pairs(*_two(spark, folder)).select("store_id", "supplier_id", told.alias("reason"))


def fuzzy_reasons(spark: SparkSession, folder: str) -> DataFrame:
    told = t.fuzzy_reason(F.col("part_similarity"), F.col("text_similarity"))
    return m.fuzzy_best(*_two(spark, folder)).groupBy(told.alias("reason")).agg(F.count("*").alias("n"))


def applied_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Of each link of numbers the change between them in words, applied again to the first number."""
    a, b = F.upper(F.trim("merrill_part_number")), F.upper(F.trim("vendor_part_number"))
    rows = m.once(table(spark, folder, "interchanges")).select("id", a.alias("a"), b.alias("b")).filter("a <> b").withColumn("change", t.character_change(F.col("a"), F.col("b")))
    made = t.apply_change(F.col("a"), F.col("change"))
    return rows.filter("not change like 'Transform%'").select("id", "change", made.alias("made"), (made == F.col("b")).alias("arrives"))


def cleaned_replies(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates' features as a model would send them, fenced and with words around, and read back."""
    sent = F.concat(F.lit("Sure:\n```json\n"), F.col("features"), F.lit("\n```"))
    return newest(table(spark, folder, "match_candidates"), "features").filter("features is not null").select("id", t.reply_json(sent).alias("reply"))


def token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap of all blank-parted words of the descriptions of exact pairs."""
    pairs = m.exact_pairs(*_two(spark, folder)).filter("store_text <> '' and supplier_text <> ''")
    return pairs.select("store_id", "supplier_id", word_jaccard(F.col("store_text"), F.col("supplier_text"), None).alias("score"))


#: Numbers that are but the name of a small part.
GENERIC_NUMBER = r"(?i)^(BOLT|NUT|WASHER|SCREW|CLIP|PIN|RIVET|STUD)\s*[0-9]*$"


def search_worthy(spark: SparkSession, folder: str) -> DataFrame:
    """Which rows can be searched for at all, which are long enough for a model, and how well they suit one."""
    n, text, line = F.col("part_number"), F.col("description"), F.col("line_code")
    some = lambda c: F.coalesce(c != "", F.lit(False))
    matchable = F.coalesce(F.length(n) >= 2, F.lit(False)) & ~F.coalesce(n.rlike(GENERIC_NUMBER), F.lit(False)) & (some(text) | some(line))
    long = F.coalesce(F.length(n) >= 2, F.lit(False)) | F.coalesce(F.length(text) >= 3, F.lit(False))
    return m.once(table(spark, folder, "store_items")).select("id", matchable.alias("matchable"), long.alias("long_enough"), suitability(line, text, n).alias("points"))


QUERIES = {
    "number_forms_more": number_forms_more, "brand_names": brand_names, "exact_reasons": exact_reasons, "line_reasons": line_reasons, "fuzzy_reasons": fuzzy_reasons,
    "applied_changes": applied_changes, "cleaned_replies": cleaned_replies, "token_overlap": token_overlap, "search_worthy": search_worthy,
}


def _map(names: dict[str, str]) -> str:
    return "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def _filled(template: str, **parts: str) -> str:
    out = "'" + template + "'"
    for k, v in parts.items():
        out = out.replace("{" + k + "}", f"' || {v} || '")
    return out


_PERCENT = "round(round(text_similarity, 9) * 100)::int"
SQL = {
    "number_forms_more": f"""WITH r AS (SELECT DISTINCT id, part_number AS n, upper(trim(part_number)) AS u FROM store_items WHERE part_number IS NOT NULL)
SELECT id, regexp_replace(CASE WHEN starts_with(u, 'K') THEN substr(u, 2) ELSE u END, '[-/.\\s]', '', 'g') AS without_prefix, regexp_replace(trim(n), '[-/.\\s]', '', 'g') AS case_kept,
  regexp_replace(regexp_replace(u, '^({'|'.join(t.CATALOGUE_PREFIXES)})', ''), '[\\s-]', '', 'g') AS catalogue, CASE WHEN length(trim(n)) >= 4 THEN upper(substr(trim(n), 1, 3)) END AS fixed_code,
  CASE WHEN length(trim(n)) >= 4 THEN substr(trim(n), 4) END AS fixed_part, CASE WHEN regexp_matches(u, '^([A-Z]{{2,4}})[-\\s]?(.+)$') THEN regexp_extract(u, '^([A-Z]{{2,4}})[-\\s]?(.+)$', 1) END AS wide_code,
  CASE WHEN regexp_matches(u, '^([A-Z]{{2,4}})[-\\s]?(.+)$') THEN regexp_extract(u, '^([A-Z]{{2,4}})[-\\s]?(.+)$', 2) ELSE u END AS wide_part, substr(n, 1, 3) AS left3, substr(n, 4, 5) AS mid5,
  CASE WHEN n <> '' AND NOT starts_with(n, '=') THEN n END AS cell FROM r""",
    "brand_names": f"""WITH {_LINES}, s AS (SELECT DISTINCT id, upper(trim(line_code)) AS code FROM store_items)
SELECT id, CASE WHEN code <> '' THEN coalesce({_map(t.BRANDS)}, code) END AS brand, CASE WHEN code <> '' THEN coalesce(upper(maker), {_map(t.WIDER_BRANDS)}, code) END AS wider_brand FROM s LEFT JOIN m ON client_code = code""",
    "exact_reasons": f"""{EXACT_BEST} SELECT store_id, supplier_id, CASE WHEN store_number = supplier_number AND round(text_similarity, 9) >= 0.9 THEN {_filled(t.EXACT_PERFECT, n=_PERCENT)}
  {" ".join(f"WHEN round(text_similarity, 9) >= {least / 100} THEN {_filled(x, n=_PERCENT)}" for least, x in t.EXACT_REASONS[:-1])} ELSE {_filled(t.EXACT_REASONS[-1][1], n=_PERCENT)} END AS reason FROM b""",
    "line_reasons": f"""{_PAIRS} SELECT store_id, supplier_id, CASE WHEN store_number = supplier_number AND store_line IS NOT DISTINCT FROM supplier_line THEN '{t.LINE_REASONS[0]}'
  WHEN {sql_join_key('store_line')} = {sql_join_key('supplier_line')} THEN '{t.LINE_REASONS[1]}' WHEN {_COMPLEX} THEN '{t.LINE_REASONS[2]}'
  WHEN coalesce(store_line, '') = '' AND coalesce(supplier_line, '') = '' THEN '{t.LINE_REASONS[3]}' WHEN coalesce(store_line, '') = '' OR coalesce(supplier_line, '') = '' THEN '{t.LINE_REASONS[4]}'
  ELSE {_filled(t.LINE_MISMATCH, a='store_line', b='supplier_line')} END AS reason FROM p""",
    "fuzzy_reasons": f"""{_FUZZY} SELECT CASE WHEN part_similarity >= 0.9 AND text_similarity >= 0.7 THEN '{t.FUZZY_REASONS[0]}' WHEN part_similarity >= 0.8 THEN '{t.FUZZY_REASONS[1]}'
  WHEN part_similarity >= 0.7 THEN '{t.FUZZY_REASONS[2]}' ELSE '{t.FUZZY_REASONS[3]}' END AS reason, count(*) AS n FROM f GROUP BY ALL""",
    "applied_changes": """WITH r AS (SELECT DISTINCT id, upper(trim(merrill_part_number)) AS a, upper(trim(vendor_part_number)) AS b FROM interchanges),
g AS (SELECT *, [c FOR c, i IN string_split(a, '') IF list_position(string_split(a, ''), c) = i AND NOT contains(b, c)] AS gone, [c FOR c, i IN string_split(b, '') IF list_position(string_split(b, ''), c) = i AND NOT contains(a, c)] AS come FROM r WHERE a <> b),
h AS (SELECT *, CASE WHEN len(gone) = 1 AND len(come) = 1 THEN 'Replace "' || gone[1] || '" with "' || come[1] || '"' WHEN len(gone) > 0 AND len(come) = 0 THEN 'Remove "' || array_to_string(gone, ', ') || '"'
  WHEN len(gone) = 0 AND len(come) > 0 THEN 'Add "' || array_to_string(come, ', ') || '"' WHEN len(gone) + len(come) > 0 THEN NULL WHEN starts_with(b, a) THEN 'Add suffix "' || substr(b, length(a) + 1) || '"'
  WHEN ends_with(b, a) THEN 'Add prefix "' || substr(b, 1, length(b) - length(a)) || '"' END AS change FROM g),
k AS (SELECT id, b, change, CASE WHEN len(gone) = 1 AND len(come) = 1 THEN replace(a, gone[1], come[1]) WHEN len(gone) > 0 AND len(come) = 0 THEN list_reduce(list_prepend(a, gone), lambda x, c: replace(x, c, ''))
  WHEN len(gone) = 0 AND len(come) > 0 THEN a || array_to_string(come, ', ') END AS made FROM h WHERE change IS NOT NULL)
SELECT id, change, made, made = b AS arrives FROM k""",
    "cleaned_replies": f"WITH {_newest('features')} SELECT id, features AS reply FROM c WHERE features IS NOT NULL",
    "token_overlap": f"""{_PAIRS} SELECT store_id, supplier_id, {sql_jaccard("list_distinct(string_split_regex(lower(store_text), '\\s+'))", "list_distinct(string_split_regex(lower(supplier_text), '\\s+'))")} AS score FROM p WHERE store_text <> '' AND supplier_text <> ''""",
    "search_worthy": f"""WITH s AS (SELECT DISTINCT id, part_number AS n, description AS d, line_code AS l FROM store_items)
SELECT id, coalesce(length(n) >= 2, false) AND NOT coalesce(regexp_matches(n, '{GENERIC_NUMBER}'), false) AND (coalesce(d <> '', false) OR coalesce(l <> '', false)) AS matchable, coalesce(length(n) >= 2, false) OR coalesce(length(d) >= 3, false) AS long_enough,
  CASE WHEN l <> '' THEN 30 ELSE 0 END + CASE WHEN length(d) > 20 THEN 20 ELSE 0 END + CASE WHEN regexp_matches(n, '[0-9]{{4,}}') THEN 15 ELSE 0 END
  + CASE WHEN regexp_matches(d, '(?i)filter|belt|pump|sensor|brake|clutch|bearing|gasket|seal|hose|valve|rotor|caliper|pad|disc|drum') THEN 25 ELSE 0 END - CASE WHEN regexp_matches(d, '(?i)^(nut|bolt|screw|washer|clip)$') THEN 50 ELSE 0 END AS points FROM s""",
}
