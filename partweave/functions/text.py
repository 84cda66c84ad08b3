"""Identifier and text functions, all Column -> Column, so they stay inside generated code.

The normalisers are deliberately several: sources store numbers in forms that are not interchangeable."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_join(c: Column) -> Column:
    """Join key of the exact matcher: letters and digits only, upper case, without leading zeros."""
    return F.ltrim(F.upper(F.regexp_replace(c, "[^a-zA-Z0-9]", "")), F.lit("0"))


def norm_stored(c: Column) -> Column:
    """The stored form: upper case first, then everything but A-Z and 0-9 dropped."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def norm_canonical(c: Column) -> Column:
    """The canonical form: trimmed, upper case, only dash, slash, dot and white space dropped."""
    return F.regexp_replace(F.upper(F.trim(c)), r"[-/.\s]", "")


def norm_score(c: Column) -> Column:
    """The scorer's form: non-alphanumerics dropped, then upper case."""
    return F.upper(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))


def norm_lower(c: Column) -> Column:
    """Lower case letters and digits."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def norm_punct(c: Column) -> Column:
    """Upper case with dash, slash and dot dropped; white space stays."""
    return F.upper(F.translate(c, "-/.", ""))


def line_code_prefix(c: Column) -> Column:
    """Struct (line_code, mfr_part): the first three characters are a line code if at least two of them are letters
    and at least two characters follow; else the whole is the maker's number."""
    head, rest = F.upper(F.substring(c, 1, 3)), F.substring(c, 4, 1 << 20)
    letters = F.length(F.regexp_replace(head, "[^A-Z]", ""))
    is_code = (F.length(c) >= 3) & (letters >= 2) & (F.length(rest) >= 2)
    return F.struct(
        F.when(is_code, head).alias("line_code"),
        F.when(is_code, rest).otherwise(F.when(c != "", c)).alias("mfr_part"),
    )


def line_code_pattern(c: Column) -> Column:
    """Struct (line_code, mfr_part): two or three leading letters, an optional dash or blank, and a remainder."""
    s, pattern = F.upper(F.trim(c)), r"^([A-Z]{2,3})[-\s]?(.+)$"
    found = s.rlike(pattern)
    return F.struct(
        F.when(found, F.regexp_extract(s, pattern, 1)).alias("line_code"),
        F.when(found, F.regexp_extract(s, pattern, 2)).otherwise(s).alias("mfr_part"),
    )


def number_variants(c: Column) -> Column:
    """Array of spellings to look a number up by, the number itself first."""
    bare = F.regexp_replace(c, r"[-\s]", "")
    undashed = ~F.contains(c, F.lit("-"))
    nothing = F.lit(None).cast("string")
    every = F.array(
        c,
        F.when(c.rlike("[A-Z]$"), F.substring(c, 1, F.length(c) - 1)).otherwise(nothing),
        bare,
        F.when(undashed & (F.length(c) > 4), F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 1 << 20))).otherwise(nothing),
        F.when(undashed & (F.length(c) > 6), F.concat(F.substring(c, 1, 3), F.lit("-"), F.substring(c, 4, 1 << 20))).otherwise(nothing),
    )
    return F.array_distinct(F.array_compact(every))


#: Words that are no keywords.
STOP_WORDS = ["THE", "A", "AN", "AND", "OR", "FOR", "WITH", "TO", "IN", "ON", "AT"]


def keywords(c: Column, longer_than: int = 2, most: int = 5) -> Column:
    """The first words of a description that are long enough and no stop words, upper case, in order."""
    words = F.split(F.regexp_replace(F.upper(c), r"[^A-Z0-9\s]", " "), r"\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) > longer_than) & ~w.isin(STOP_WORDS)), 1, most)


def long_words(c: Column, longer_than: int = 3) -> Column:
    """The words of a description that are long enough, whatever they are, upper case, in order."""
    words = F.split(F.regexp_replace(F.upper(c), r"[^A-Z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: F.length(w) > longer_than)


def search_query(number: Column, description: Column) -> Column:
    """Text for a catalogue search: number and description without packing words."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(description, r"(?i)\b(KIT|ASSY|ASSEMBLY|SET)\b", ""), r"\s+", " "))
    return F.concat_ws(" ", F.nullif(F.trim(number), F.lit("")), F.nullif(plain, F.lit("")))


def embedding_text(number: Column, line: Column, description: Column) -> Column:
    """Number, line code and the first 200 characters of the description, the present ones joined by a bar."""
    present = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(" | ", present(number), present(line), present(F.substring(description, 1, 200)))


def punctuation_signature(a: Column, b: Column) -> Column:
    """How the punctuation of one spelling turns into the other's; null if more than punctuation differs."""
    a, b = F.upper(F.trim(a)), F.upper(F.trim(b))
    has = lambda c, ch: F.contains(c, F.lit(ch))
    steps = [
        F.when(has(a, "/") & has(b, "-"), "slash_to_dash").when(has(a, "-") & has(b, "/"), "dash_to_slash"),
        *[F.when(has(a, ch) & ~has(b, ch), f"remove_{name}") for ch, name in (("-", "dash"), ("/", "slash"), (".", "dot"), (" ", "space"))],
    ]
    told = F.concat_ws("_", *steps)
    return F.when(norm_canonical(a) == norm_canonical(b), F.when(told == "", "punctuation_change").otherwise(told))


#: How a change of spelling is put into words.
CHANGE_TEXTS = {
    "replaced": 'Replace "{gone}" with "{come}"',
    "removed": 'Remove "{gone}"',
    "added": 'Add "{come}"',
    "case": "Change case",
    "suffix": 'Add suffix "{tail}"',
    "prefix": 'Add prefix "{head}"',
    "other": 'Transform "{a}" → "{b}"',
}
#: Words in such a text and the type of rule they tell, the first that stands in it; else custom.
RULE_TYPES = [("Replace", "punctuation"), ("Remove", "punctuation"), ("case", "case_normalization"), ("prefix", "affix"), ("suffix", "affix")]


def fill(template: str, **parts: Column) -> Column:
    """A text with columns in place of the names in braces; null if one of them is null."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[parts[x] if k % 2 else F.lit(x) for k, x in enumerate(pieces)])


def characters(c: Column) -> Column:
    """The distinct characters of a text, in order; none of an empty one."""
    return F.array_distinct(F.filter(F.split(c, ""), lambda ch: ch != ""))


def change_kind(a: Column, b: Column) -> Column:
    """A key of CHANGE_TEXTS: what happens to the set of characters between two spellings; where the sets are equal,
    what happens to case or to the ends."""
    x, y = characters(a), characters(b)
    gone, come = F.size(F.array_except(x, y)), F.size(F.array_except(y, x))
    same_sets = F.when((F.upper(a) == F.upper(b)) & (a != b), "case").when(b.startswith(a), "suffix").when(b.endswith(a), "prefix").otherwise("other")
    mixed = F.when((gone == 1) & (come == 1), "replaced").otherwise(same_sets)
    return F.when((gone == 0) & (come == 0), same_sets).when(come == 0, "removed").when(gone == 0, "added").otherwise(mixed)


def character_change(a: Column, b: Column) -> Column:
    """What distinguishes two spellings, in words."""
    x, y = characters(a), characters(b)
    parts = {
        "gone": F.array_join(F.array_except(x, y), ", "), "come": F.array_join(F.array_except(y, x), ", "), "a": a, "b": b,
        "tail": F.substring(b, F.length(a) + 1, F.lit(1 << 20)), "head": F.substring(b, F.lit(1), F.length(b) - F.length(a)),
    }
    kind = change_kind(a, b)
    return F.coalesce(*[F.when(kind == k, fill(t, **parts)) for k, t in CHANGE_TEXTS.items()])


def change_class(change: Column) -> Column:
    """The type of rule that a change, in words, suggests."""
    return F.coalesce(*[F.when(F.contains(change, F.lit(word)), rule) for word, rule in RULE_TYPES], F.lit("custom"))


def string_hash32(c: Column) -> Column:
    """The 32-bit polynomial hash (times 31, wrapping) of a text of ASCII characters, as an absolute value."""
    codes = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("bigint"))
    wrap = lambda v: F.pmod(v + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.abs(F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, x: wrap(acc * 31 + x)))


def wildcard_match(pattern: Column, value: Column) -> Column:
    """Whether a value matches a pattern in which a star at an end stands for any text: X, X*, *X, *X*, and * alone,
    which matches a missing value too; case and outer spaces do not matter."""
    p, v = F.upper(F.trim(pattern)), F.upper(F.trim(value))
    head, tail = p.startswith("*"), p.endswith("*")
    core = F.regexp_replace(p, r"^\*|\*$", "")
    met = F.when(head & tail, F.contains(v, core)).when(head, v.endswith(core)).when(tail, v.startswith(core)).otherwise(v == p)
    return F.when(p == "*", True).otherwise(F.coalesce(met, F.lit(False)))


def digit_core(c: Column, least: int = 6) -> Column:
    """The longest run of digits of a number, the first of equals, if it has at least ``least``."""
    runs = F.filter(F.split(c, "[^0-9]+"), lambda r: F.length(r) >= least)
    longest = F.array_max(F.transform(runs, lambda r: F.length(r)))
    return F.get(F.filter(runs, lambda r: F.length(r) == longest), F.lit(0))


def canonical_form(c: Column, prefix: str | None = None, keep_case: bool = False) -> Column:
    """norm_canonical with a prefix taken off first, if it is there, or with the case kept."""
    s = F.trim(c) if keep_case else F.upper(F.trim(c))
    if prefix:
        s = F.when(s.startswith(prefix), F.substring(s, len(prefix) + 1, 1 << 20)).otherwise(s)
    return F.regexp_replace(s, r"[-/.\s]", "")


#: Prefixes of the catalogue's own numbering, tried in this order.
CATALOGUE_PREFIXES = ["XBO", "RDS", "LUB", "AXL", "AUV", "RDSNC", "RDSNCV"]


def norm_catalogue(c: Column) -> Column:
    """Upper case without the first prefix of CATALOGUE_PREFIXES that fits, then without blanks and dashes."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), f"^({'|'.join(CATALOGUE_PREFIXES)})", ""), r"[\s-]", "")


def line_code_fixed(c: Column) -> Column:
    """Struct (line_code, mfr_part): the first three characters and the rest, of numbers of four characters or more."""
    s = F.trim(c)
    long = F.length(s) >= 4
    return F.struct(F.when(long, F.upper(F.substring(s, 1, 3))).alias("line_code"), F.when(long, F.substring(s, 4, 1 << 20)).alias("mfr_part"))


def line_code_wide(c: Column) -> Column:
    """Struct (line_code, mfr_part): two to four leading letters, an optional dash or blank, and a remainder."""
    s, pattern = F.upper(F.trim(c)), r"^([A-Z]{2,4})[-\s]?(.+)$"
    found = s.rlike(pattern)
    return F.struct(F.when(found, F.regexp_extract(s, pattern, 1)).alias("line_code"), F.when(found, F.regexp_extract(s, pattern, 2)).otherwise(s).alias("mfr_part"))


#: Short forms of brands.
BRANDS = {
    "GAT": "GATES", "GATE": "GATES", "ACD": "ACDELCO", "AC": "ACDELCO", "ACDEL": "ACDELCO", "WAG": "WAGNER", "MC": "MOTORCRAFT", "MTCR": "MOTORCRAFT",
    "CHA": "CHAMPION", "CHAMP": "CHAMPION", "STD": "STANDARD", "SMP": "STANDARD", "BWD": "BWDAUTO",
}
#: Further short forms, of the wider list, which lacks BWD.
MORE_BRANDS = {
    "DOR": "DORMAN", "DORM": "DORMAN", "MG": "MOOG", "RAY": "RAYBESTOS", "RB": "RAYBESTOS", "TIM": "TIMKEN", "TMK": "TIMKEN", "FM": "FEDERAL MOGUL", "FED": "FEDERAL MOGUL",
    "BA": "BECK ARNLEY", "BECK": "BECK ARNLEY", "CONT": "CONTINENTAL", "CTI": "CONTINENTAL", "DAY": "DAYCO", "DUR": "DURALAST", "DL": "DURALAST",
}
WIDER_BRANDS = {k: v for k, v in BRANDS.items() if k != "BWD"} | MORE_BRANDS


def brand_of(code: Column, known: Column | None = None, names: dict[str, str] = BRANDS) -> Column:
    """The brand of a line code: what a table says (``known``), else the fixed list, else the code itself; null for none."""
    listed = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code)
    return F.when(code != "", F.coalesce(*([known] if known is not None else []), listed, code))


def plain_cell(c: Column) -> Column:
    """A spreadsheet cell as text; a formula, which must be evaluated elsewhere, and an empty cell are null."""
    return F.when((c != "") & ~c.startswith("="), c)


def left(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def mid(c: Column, start: int, n: int) -> Column:
    """``n`` characters from place ``start``, the first being 1."""
    return F.substring(c, start, n)


def apply_change(number: Column, change: Column) -> Column:
    """A number changed as a text of CHANGE_TEXTS says, all letters of it taken literally; null if the text names
    nothing that can be done to another number."""
    part = lambda pattern, k: F.regexp_extract(change, pattern, k)
    swap, drop, add = r'^Replace "(.+)" with "(.+)"$', r'^Remove "(.+)"$', r'^Add "(.+)"$'
    bare = F.aggregate(F.split(part(drop, 1), ", "), number, lambda left, ch: F.replace(left, ch, F.lit("")))
    return F.coalesce(
        F.when(change.rlike(swap), F.replace(number, part(swap, 1), part(swap, 2))), F.when(change.rlike(drop), bare), F.when(change.rlike(add), F.concat(number, part(add, 1))),
        F.when(change == CHANGE_TEXTS["case"], F.upper(number)),
    )


#: What is said of an exact match, by least similarity of the descriptions in percent.
EXACT_REASONS = [
    (90, "Excellent match: Normalized part number + {n}% description similarity"),
    (75, "Very good match: Normalized part number + {n}% description similarity"),
    (60, "Good match: Normalized part number + {n}% description similarity"),
    (50, "Fair match: Normalized part number + {n}% description similarity (review recommended)"),
    (None, "Questionable match: Normalized part number but only {n}% description similarity (manual review required)"),
]
EXACT_PERFECT = "Perfect match: Identical part numbers + {n}% description similarity"
#: What is said of a match by number and line code, and of a fuzzy match.
LINE_REASONS = [
    "Perfect match (identical part + line code)",
    "Normalized part match with line code confirmation",
    "Complex part number (unique enough to ignore line code)",
    "Normalized part match (both line codes NULL)",
    "Normalized part match (one line code NULL)",
]
LINE_MISMATCH = "Normalized part match (line code mismatch: {a} vs {b})"
FUZZY_REASONS = [
    "High similarity on both part number and description",
    "Strong part number similarity with description validation",
    "Good part number similarity with description validation",
    "Moderate part number similarity with description validation",
]


def exact_reason(same_number: Column, similarity: Column) -> Column:
    """What is said of an exact match."""
    n = {"n": F.round(similarity * 100).cast("int").cast("string")}
    told = [F.when(same_number & (similarity >= 0.9), fill(EXACT_PERFECT, **n))]
    return F.coalesce(*told, *[fill(t, **n) if least is None else F.when(similarity >= least / 100, fill(t, **n)) for least, t in EXACT_REASONS])


def line_reason(same: Column, confirmed: Column, is_complex: Column, a: Column, b: Column) -> Column:
    """What is said of a match by number and line codes ``a`` and ``b``."""
    none_a, none_b = F.coalesce(a == "", F.lit(True)), F.coalesce(b == "", F.lit(True))
    tests = [same, confirmed, is_complex, none_a & none_b, none_a | none_b]
    return F.coalesce(*[F.when(F.coalesce(t, F.lit(False)), F.lit(r)) for t, r in zip(tests, LINE_REASONS)], fill(LINE_MISMATCH, a=a, b=b))


def fuzzy_reason(part: Column, text: Column) -> Column:
    """What is said of a fuzzy match."""
    tests = [(part >= 0.9) & (text >= 0.7), part >= 0.8, part >= 0.7, F.lit(True)]
    return F.coalesce(*[F.when(t, F.lit(r)) for t, r in zip(tests, FUZZY_REASONS)])


def reply_json(c: Column) -> Column:
    """The JSON object in a model's reply: without code fences and what stands before the first and after the last brace;
    the whole without fences if there is none."""
    bare = F.trim(F.regexp_replace(c, r"(?m)^```(json)?|```$|^`+|`+$", ""))
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(bare)
