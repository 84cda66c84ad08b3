import itertools
import random

from pyspark.sql import functions as F

from partweave.functions import similarity as sim
from partweave.functions import text as t


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


def pairs(spark, values, f):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(values)], "i int, a string, b string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("a"), F.col("b"))).collect()]


def test_normalisers(spark):
    values = ["00ab-12/3", " gm 57.010 ", "", None, "K–12 3"]
    assert column(spark, values, t.norm_join) == ["AB123", "GM57010", "", None, "K123"]
    assert column(spark, values, t.norm_stored) == ["00AB123", "GM57010", "", None, "K123"]
    assert column(spark, values, t.norm_canonical) == ["00AB123", "GM57010", "", None, "K–123"]
    assert column(spark, values, t.norm_lower) == ["00ab123", "gm57010", "", None, "k123"]
    assert column(spark, values, t.norm_punct) == ["00AB123", " GM 57010 ", "", None, "K–12 3"]


def test_normalisers_are_idempotent(spark):
    values = ["".join(p) for p in itertools.product("0a-", repeat=4)]
    for f in (t.norm_join, t.norm_stored, t.norm_canonical, t.norm_lower):
        once = column(spark, values, f)
        assert column(spark, once, f) == once


def test_line_codes(spark):
    values = ["ABC123", "01M000-2112-73", "ABC", "AC488", "AX7", None, ""]
    got = column(spark, values, t.line_code_prefix)
    assert [tuple(g) for g in got] == [("ABC", "123"), (None, "01M000-2112-73"), (None, "ABC"), ("AC4", "88"), (None, "AX7"), (None, None), (None, None)]
    got = column(spark, ["AB-12", "abc 9", "12AB"], t.line_code_pattern)
    assert [tuple(g) for g in got] == [("AB", "12"), ("ABC", "9"), (None, "12AB")]


def test_variants_and_keywords(spark):
    assert column(spark, ["1234567A", "AB-12"], t.number_variants) == [["1234567A", "1234567", "1234-567A", "123-4567A"], ["AB-12", "AB12"]]
    assert column(spark, ["the Brake, pad & rotor for it"], t.keywords) == [["BRAKE", "PAD", "ROTOR"]]


def test_punctuation_signature(spark):
    values = [("21/3/1", "21-3-1"), ("a-b", "ab"), ("a.b c", "abc"), ("ab", "ab"), ("ab", "ac"), (None, "a")]
    assert pairs(spark, values, t.punctuation_signature) == ["slash_to_dash_remove_slash", "remove_dash", "remove_dot_remove_space", "punctuation_change", None, None]


def test_string_hash(spark):
    def hash32(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch) + 2**31) % 2**32 - 2**31
        return abs(h)

    values = ["pj000001", "a", "a longer project name that wraps around"]
    assert column(spark, values, t.string_hash32) == [hash32(v) for v in values]


def test_similarities(spark):
    assert column(spark, ["word"], lambda c: F.array_sort(sim.trigrams(c))) == [["  w", " wo", "ord", "rd ", "wor"]]
    assert pairs(spark, [("abc", "abc"), ("", ""), (None, "x"), ("abc", "xyz")], sim.trigram_similarity) == [1.0, 0.0, 0.0, 0.0]
    assert pairs(spark, [("AB", "ab"), ("", ""), ("abcd", "abcx")], sim.edit_similarity) == [1.0, 1.0, 0.75]
    assert pairs(spark, [("12-34", "1234"), ("1234", "123456"), ("", "1"), (None, "1")], sim.number_similarity) == [1.0, 0.85 + 4 / 6 * 0.15, 0.0, 0.0]
    assert pairs(spark, [("abcd", "xabcdx"), ("abcz", "yabc"), ("ab", "cd"), ("a", "a")], sim.common_run_similarity) == [4 / 6, 0.75, 0.0, 1.0]
    assert pairs(spark, [("abc", "abc"), ("abcd", "badc"), (None, "a")], sim.windowed_similarity) == [1.0, 1.0, 0.0]


def test_confidences_and_costs(spark):
    df = spark.createDataFrame([(0.95, True), (0.95, False), (0.1, True)], "d double, s boolean")
    assert [r[0] for r in df.select(sim.exact_confidence(F.col("s"), F.col("d"))).collect()] == [0.99, 0.98, 0.7]
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 12.5), (1.0, 30.0), (0.0, 1.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(sim.unit_mismatch(F.col("a"), F.col("b"))).collect()] == [None, "per-foot vs per-dozen", "Unknown unit mismatch (large price difference)", None, None]
    assert [r[0] for r in df.select(sim.cost_similarity(F.col("a"), F.col("b"))).collect()][0] == 1.0


def test_costs_and_units_stated_cases(spark):
    df = spark.createDataFrame([(1.80, 1.83), (1.0, 2.0), (None, 1.0), (0.0, 1.0)], "a double, b double")
    told = [r[0] for r in df.select(sim.cost_comparison(F.col("a"), F.col("b"))).collect()]
    assert round(told[0].difference, 2) == 0.03 and told[0].percent < 2 and told[0].close and 0.84 < told[0].similarity < 0.86
    assert told[1].percent > 50 and not told[1].close and told[2] is None and told[3] is None
    df = spark.createDataFrame([(1.80, 90.0), (0.5, 50.0), (1.8, 1.85), (1.0, 25.0)], "a double, b double")
    assert [r[0] for r in df.select(sim.unit_mismatch(F.col("a"), F.col("b"))).collect()] == [
        "per-foot vs per-roll (50ft)", "per-unit vs per-hundred", None, "Unknown unit mismatch (large price difference)"
    ]


def test_changes_in_words(spark):
    values = [("21/3/1", "21-3-1"), ("GM-8036", "GM8036"), ("A-B/C", "ABC"), ("AB", "A-B"), ("Aa", "aA"), ("AB", "ABBA"), ("AB", "BAAB"), ("AB", "BA"), ("AB", "CD"), (None, "x")]
    told = ['Replace "/" with "-"', 'Remove "-"', 'Remove "-, /"', 'Add "-"', "Change case", 'Add suffix "BA"', 'Add prefix "BA"', 'Transform "AB" → "BA"', 'Transform "AB" → "CD"', None]
    assert pairs(spark, values, t.character_change) == told
    assert column(spark, told[:9], t.change_class) == ["punctuation", "punctuation", "punctuation", "custom", "case_normalization", "affix", "affix", "custom", "custom"]


def windowed_match(a, b):
    """The rule, character by character."""
    long, short = (a, b) if len(a) > len(b) else (b, a)
    reach, free, met = len(long) // 2 - 1, [True] * len(long), 0
    for i, ch in enumerate(short):
        for j in range(max(0, i - reach), min(i + reach + 1, len(long))):
            if free[j] and long[j] == ch:
                free[j] = False
                met += 1
                break
    return met / len(long) if a and b else 0.0


def test_windowed_match_equals_the_rule(spark):
    rng = random.Random(4)
    values = [("".join(rng.choice("AB12-") for _ in range(rng.randrange(9))), "".join(rng.choice("AB12-") for _ in range(rng.randrange(9)))) for _ in range(400)]
    assert pairs(spark, values, sim.windowed_similarity) == [windowed_match(a, b) for a, b in values]



def test_wildcards_and_cores(spark):
    values = [("*", None), ("*AB*", "xabx"), ("AB*", "abx"), ("*AB", "xab"), ("AB", " ab "), ("AB*", "xab"), ("AB", None)]
    assert pairs(spark, values, t.wildcard_match) == [True, True, True, True, True, False, False]
    assert column(spark, ["AB123456C7890123", "12345", None], t.digit_core) == ["7890123", None, None]
