"""Similarities and scores as Column functions, all of them inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partweave.functions.text import norm_score


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of a text, each word padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets given as arrays without repeats; 0 if both are empty or one is null."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def edit_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length, case ignored; 1 for two empty texts."""
    a, b = F.upper(a), F.upper(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def word_set(c: Column, longer_than: int | None = 2) -> Column:
    """Distinct lower-case words; with ``longer_than`` punctuation is dropped and short words are left out."""
    if longer_than is None:
        return F.array_distinct(F.split(F.lower(c), r"\s+"))
    words = F.split(F.regexp_replace(F.lower(c), r"[^\w\s]", ""), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > longer_than))


def word_jaccard(a: Column, b: Column, longer_than: int | None = 2) -> Column:
    return F.coalesce(jaccard(word_set(a, longer_than), word_set(b, longer_than)), F.lit(0.0))


def number_similarity(a: Column, b: Column) -> Column:
    """Of part numbers: 1 if equal in letters and digits; from .85 if one contains the other; else edit similarity
    with a tenth more for a shared beginning of four."""
    blank = a.isNull() | b.isNull() | (a == "") | (b == "")
    x, y = norm_score(a), norm_score(b)
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    lead = F.least(F.lit(4), short)
    base = 1 - F.levenshtein(x, y) / long
    boost = F.when(F.substring(x, F.lit(1), lead) == F.substring(y, F.lit(1), lead), 0.1).otherwise(0.0)
    return (
        F.when(blank, 0.0)
        .when(x == y, 1.0)
        .when(F.contains(x, y) | F.contains(y, x), 0.85 + short / long * 0.15)
        .otherwise(F.least(F.lit(1.0), base + boost))
    )


def common_run_similarity(a: Column, b: Column) -> Column:
    """1 if equal; the length ratio if one contains the other; else the longest common run of three or more
    characters over the longer length; 0 if either is empty."""
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    n = F.length(short)
    sizes = F.filter(F.sequence(F.lit(3), F.greatest(n, F.lit(3))), lambda k: k <= n)
    holds = lambda k: F.exists(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.contains(long, F.substring(short, i, k)))
    best = F.coalesce(F.array_max(F.filter(sizes, holds)), F.lit(0))
    blank = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(blank, 0.0).when(a == b, 1.0).when(F.contains(long, short), n / F.length(long)).otherwise(best / F.length(long))


def windowed_similarity(a: Column, b: Column) -> Column:
    """Characters that match within half the longer length, over the longer length: each character of the shorter
    text takes the first free equal one in its window.  No transpositions and no prefix bonus; 0 if either is empty.

    The fold carries the longer text, in which a character that was taken is blotted out."""
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    n, m = F.length(long), F.length(short)
    reach = F.floor(n / 2).cast("int") - 1
    taken = F.lit("\u0001")

    def take(left: Column, i: Column) -> Column:
        low = F.greatest(F.lit(1), i - reach)
        window = F.substring(left, low, F.least(n, i + reach) - low + 1)
        at = F.call_function("locate", F.substring(short, i, F.lit(1)), window)
        return F.when(at > 0, F.overlay(left, taken, low + at - 1, F.lit(1))).otherwise(left)

    end = F.aggregate(F.sequence(F.lit(1), m), long, take)
    met = n - F.length(F.replace(end, taken, F.lit("")))
    blank = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(blank, 0.0).otherwise(met / n)


def attribute_match(a: Column, b: Column) -> Column:
    """1 or 0 as two categories are equal without case; one half if either is missing."""
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(missing, 0.5).when(F.lower(a) == F.lower(b), 1.0).otherwise(0.0)


def weighted_score(number: Column, text: Column, category: Column, subcategory: Column) -> Column:
    """.5 number + .3 text + .1 category + .1 subcategory; 0 if the categories contradict one another."""
    score = number * 0.5 + text * 0.3 + category * 0.1 + subcategory * 0.1
    return F.when(category == 0.0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors given as arrays, in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def exact_confidence(same_number: Column, text_similarity: Column) -> Column:
    """Confidence of an exact number match by how alike the descriptions are."""
    d = text_similarity
    return (
        F.when(same_number & (d >= 0.9), 0.99)
        .when(d >= 0.9, 0.98)
        .when(d >= 0.75, 0.95)
        .when(d >= 0.6, 0.92)
        .when(d >= 0.5, 0.87)
        .when(d >= 0.4, 0.83)
        .when(d >= 0.3, 0.80)
        .when(d >= 0.2, 0.75)
        .otherwise(0.70)
    )


def fuzzy_confidence(part: Column, text: Column) -> Column:
    """Confidence of a fuzzy match: .7 part + .3 text, kept within .60 and .95 unless both are high."""
    w = part * 0.7 + text * 0.3
    return F.when((part >= 0.9) & (text >= 0.7), F.least(F.lit(0.99), w + 0.05)).otherwise(F.greatest(F.lit(0.6), F.least(F.lit(0.95), w)))


def cost_comparison(a: Column, b: Column, tolerance: float = 5.0) -> Column:
    """Struct of two costs: difference, percent (of their mean), similarity (exp(-0.1 * percent)) and close (percent
    within ``tolerance``); null unless both are positive."""
    a, b = a.cast("double"), b.cast("double")
    difference = F.abs(a - b)
    percent = difference / ((a + b) / 2) * 100
    told = F.struct(difference.alias("difference"), percent.alias("percent"), F.exp(-0.1 * percent).alias("similarity"), (percent <= tolerance).alias("close"))
    return F.when((a > 0) & (b > 0), told)


def cost_similarity(a: Column, b: Column) -> Column:
    """exp(-0.1 * difference in percent of the mean); null unless both costs are positive."""
    return cost_comparison(a, b)["similarity"]


#: Cost ratios that tell of another unit, what is said of them, and of any other ratio above 10.
UNIT_RATIOS = [(12, "per-foot vs per-dozen"), (50, "per-foot vs per-roll (50ft)"), (100, "per-unit vs per-hundred"), (1000, "per-unit vs per-thousand")]
UNIT_UNKNOWN, UNIT_BEYOND, UNIT_WITHIN = "Unknown unit mismatch (large price difference)", 10, 0.1


def unit_mismatch(a: Column, b: Column) -> Column:
    """What the ratio of two positive costs suggests about their units; null if nothing."""
    a, b = a.cast("double"), b.cast("double")
    ratio = F.greatest(a, b) / F.least(a, b)
    near = [F.when(F.abs(ratio / expected - 1) < UNIT_WITHIN, name) for expected, name in UNIT_RATIOS]
    return F.when((a > 0) & (b > 0), F.coalesce(*near, F.when(ratio > UNIT_BEYOND, UNIT_UNKNOWN)))


def long_word_list(c: Column) -> Column:
    """The blank-parted words of more than three characters, lower case, in order, repeats kept."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 3)


#: What makes a row worth a search by model.
SUITABLE_PARTS = "(?i)filter|belt|pump|sensor|brake|clutch|bearing|gasket|seal|hose|valve|rotor|caliper|pad|disc|drum"
GENERIC_PARTS = "(?i)^(nut|bolt|screw|washer|clip)$"


def suitability(line: Column, text: Column, number: Column) -> Column:
    """30 for a line code, 20 for a long description, 15 for four digits in the number, 25 for a word of SUITABLE_PARTS, 50
    less for a description that is but a generic word."""
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    return points(line != "", 30) + points(F.length(text) > 20, 20) + points(number.rlike("[0-9]{4,}"), 15) + points(text.rlike(SUITABLE_PARTS), 25) - points(text.rlike(GENERIC_PARTS), 50)


#: Subcategories that rule one another out, by words in them.
INCOMPATIBLE = [("clip", "cable"), ("battery", "belt"), ("hose", "wiring"), ("axle", "brake")]


def incompatible(a: Column, b: Column) -> Column:
    """Whether two subcategories rule one another out."""
    has = lambda c, word: F.coalesce(F.contains(F.lower(c), F.lit(word)), F.lit(False))
    out = F.lit(False)
    for x, y in INCOMPATIBLE:
        out = out | (has(a, x) & has(b, y)) | (has(a, y) & has(b, x))
    return out


def composite_score(part: Column, text: Column, mfr: Column, cost_a: Column, cost_b: Column, same_but_punctuation: Column) -> Column:
    """.4 part, .3 text, .2 maker's number, .1 of how near the cost ratio is to 1 (within a half and two), .1 more for
    numbers that differ in punctuation only; 1 at most."""
    ratio = cost_a.cast("double") / F.nullif(cost_b.cast("double"), F.lit(0.0))
    near = F.when((cost_a != 0) & ratio.between(0.5, 2.0), 1 - F.abs(1 - ratio)).otherwise(0.0)
    return F.least(F.lit(1.0), 0.4 * part + 0.3 * text + 0.2 * F.coalesce(mfr, F.lit(0.0)) + 0.1 * F.greatest(F.lit(0.0), near) + F.when(same_but_punctuation, 0.1).otherwise(0.0))


def cost_validated(confidence: Column, a: Column, b: Column) -> Column:
    """A confidence halved where one cost is over five times the other, and .05 more, 1 at most, where they are within a
    twentieth; as it is where a cost is missing or not positive."""
    a, b = a.cast("double"), b.cast("double")
    ratio = F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))
    return F.when(ratio > 5, confidence * 0.5).when(ratio < 1.05, F.least(F.lit(1.0), confidence + 0.05)).otherwise(confidence)
