"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations


def sql_join_key(c: str) -> str:
    return f"ltrim(upper(regexp_replace({c}, '[^a-zA-Z0-9]', '', 'g')), '0')"


def sql_stored(c: str) -> str:
    return f"regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')"


def sql_canonical(c: str) -> str:
    return f"regexp_replace(upper(trim({c})), '[-/.\\s]', '', 'g')"


def sql_score_key(c: str) -> str:
    return f"upper(regexp_replace({c}, '[^a-zA-Z0-9]', '', 'g'))"


def sql_lower_key(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


def sql_trigrams(c: str) -> str:
    return (
        f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), "
        f"lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def sql_jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"coalesce({shared} / nullif(len({a}) + len({b}) - {shared}, 0), 0.0)::double"


def sql_edit(a: str, b: str) -> str:
    """DuckDB's levenshtein counts bytes; the two marks beyond ASCII that numbers hold are replaced by one byte each."""
    one = lambda c: f"translate(upper({c}), chr(160) || chr(8211), '~^')"
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein({one(a)}, {one(b)}) / greatest(length({a}), length({b})) END)::double"


#: Rows once, with the columns that matching uses.
SQL_ROWS = """
s AS (SELECT DISTINCT project_id, id AS store_id, part_number AS store_number, line_code AS store_line, description AS store_text,
             canonical_part_number AS store_canonical, mfr_part_number AS store_mfr, current_cost AS store_cost FROM store_items),
u AS (SELECT DISTINCT project_id, id AS supplier_id, part_number AS supplier_number, line_code AS supplier_line, description AS supplier_text,
             canonical_part_number AS supplier_canonical, mfr_part_number AS supplier_mfr, current_cost AS supplier_cost FROM supplier_items)"""

_RUNS = "list_transform(range(1, greatest(length({c}) - 1, 1)), lambda i: substr({c}, i, 3))"
_MARK = "CASE WHEN {c} <> '' THEN ['=' || {c}] ELSE [] END"


def _keys(number: str, *more: str) -> str:
    parts = [_MARK.format(c=sql_join_key(number)), *[_RUNS.format(c=sql_score_key(c)) for c in (number, *more)]]
    return " || ".join(f"coalesce({x}, [])" for x in parts)


#: After SQL_ROWS: pairs of a project whose numbers are equal as join keys or share three characters in a row.
SQL_ALIKE = f"""
sk AS (SELECT *, {_keys('store_number')} AS xs FROM s),
uk AS (SELECT *, {_keys('supplier_number', 'supplier_mfr')} AS ys FROM u),
p AS (SELECT * EXCLUDE (xs, ys), {sql_jaccard(sql_trigrams('store_text'), sql_trigrams('supplier_text'))} AS text_similarity FROM sk JOIN uk USING (project_id) WHERE list_has_any(xs, ys))"""
