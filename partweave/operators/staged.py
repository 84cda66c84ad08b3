"""The staged matcher: ordered steps, each taking for a store row the first candidate no earlier step took, then a
second stage by similarity for the rows that the first one left.

Where the source system left order to chance, the smaller supplier id comes first.  Numbers in canonical form are
made from the part numbers as they stand, as stored forms may be stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partweave.functions.similarity import cost_comparison, edit_similarity
from partweave.functions.text import norm_canonical, norm_join, norm_stored, string_hash32
from partweave.operators.matching import _store, _supplier, interchange_keys
from partweave.operators.skew import HOT_LEAST, numbered, split_join
from partweave.session import Workspace

#: Prefixes tried before a canonical number, and how many characters must be left beyond them.
PREFIXES = ["ABC", "DTN", "BSC", "CTS", "RB", "WA", "DP"]
PREFIX_REST = 3
#: Method, confidence, most confidence and share of the cost similarity, by step.
STEPS = {
    1: ("EXACT_NORM", 0.95, 0.99, 0.04),
    2: ("LINE_PN", 0.90, 0.95, 0.05),
    3: ("EXACT_NORM", 0.75, 0.85, 0.10),
    4: ("INTERCHANGE", 1.0, 1.0, 0.0),
    5: ("EXACT_NORM", 0.85, 0.92, 0.07),
    6: ("EXACT_NORM", 0.80, 0.88, 0.08),
    7: ("RULE_BASED", None, 1.0, 0.0),
}
#: What equal line codes add in step 3, and up to what.
SAME_LINE_ADDS, SAME_LINE_MOST = 0.10, 0.90


def punctuation_rules(rules: DataFrame, least: int = 2) -> DataFrame:
    """(rule_id, old, new, confidence): characters that enabled positive rules show to be dropped or replaced between
    the two spellings of a number, at least ``least`` times; of letters, digits and what the canonical form drops
    anyway nothing is learned.  One row for a pair of characters, so there are few."""
    a, b = norm_canonical(F.col("store_part_number")), norm_canonical(F.col("supplier_part_number"))
    told = rules.filter(F.col("enabled") & (F.col("rule_type") == "POSITIVE_MAP")).dropDuplicates(["id"]).select(a.alias("a"), b.alias("b"), "confidence")
    sets = told.select("confidence", F.array_distinct(F.split("a", "")).alias("x"), F.array_distinct(F.split("b", "")).alias("y"), norm_stored(F.col("a")).alias("p"), norm_stored(F.col("b")).alias("q")).filter("p = q and p <> ''")
    changed = sets.select("confidence", F.array_except("x", "y").alias("gone"), F.array_except("y", "x").alias("come")).filter("size(gone) = 1 and size(come) <= 1")
    pairs = changed.select(F.element_at("gone", 1).alias("old"), F.coalesce(F.get("come", F.lit(0)), F.lit("")).alias("new"), "confidence")
    kept = pairs.groupBy("old", "new").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")).filter(F.col("n") >= least)
    return kept.select(F.concat(F.lit("punctuation:"), "old", F.lit(">"), "new").alias("rule_id"), "old", "new", "confidence")


def _lookups(s: DataFrame, interchanges: DataFrame, rules: DataFrame) -> DataFrame:
    """(project_id, store_id, step, sub, base, key): what each store row looks up, in order of step and sub; ``base`` is
    the confidence of a rule."""
    number, mfr = norm_canonical(F.col("store_number")), norm_canonical(F.col("store_mfr"))
    has_line = F.coalesce(F.col("store_line") != "", F.lit(False))
    look = lambda step, tag, key, when=F.lit(True): F.when(when & (key != ""), F.struct(F.lit(step).alias("step"), F.concat(F.lit(tag), key).alias("key")))
    bare = F.coalesce(*[F.when(number.startswith(p) & (F.length(number) > len(p) + PREFIX_REST), F.substring(number, len(p) + 1, 1 << 20)) for p in PREFIXES])
    own = F.array(
        look(1, "c", number), look(2, "l", F.upper(F.concat_ws(":", "store_line", "store_mfr")), has_line & F.coalesce(F.col("store_mfr") != "", F.lit(False))),
        look(3, "m", mfr), look(5, "m", mfr, has_line), look(6, "c", bare),
    )
    none = F.lit(None).cast("double").alias("base")
    plain = s.select("project_id", "store_id", F.explode(F.array_compact(own)).alias("z")).select("project_id", "store_id", "z.step", F.lit("").alias("sub"), none, "z.key")
    linked = s.select("project_id", "store_id", norm_join(F.col("store_number")).alias("norm")).filter("norm <> ''").join(interchange_keys(interchanges), ["project_id", "norm"])
    linked = linked.select("project_id", "store_id", "other").distinct().select("project_id", "store_id", F.lit(4).alias("step"), F.col("other").alias("sub"), none, F.concat(F.lit("n"), "other").alias("key"))
    chars = s.select("project_id", "store_id", F.col("store_number").alias("raw"), F.explode(F.array_distinct(F.split(F.upper("store_number"), ""))).alias("old")).join(F.broadcast(rules), "old")
    changed = norm_canonical(F.replace(F.upper("raw"), F.col("old"), F.col("new")))
    ruled = chars.select("project_id", "store_id", F.lit(7).alias("step"), F.col("rule_id").alias("sub"), F.col("confidence").alias("base"), F.concat(F.lit("c"), changed).alias("key")).filter("key <> 'c'")
    return plain.unionByName(linked).unionByName(ruled)


def _index(u: DataFrame, most: int) -> DataFrame:
    """(project_id, key, supplier_id, place): the first ``most`` suppliers of each key that store rows may look up."""
    number, mfr = norm_canonical(F.col("supplier_number")), norm_canonical(F.col("supplier_mfr"))
    tagged = lambda tag, key, when=F.lit(True): F.when(when & (key != ""), F.concat(F.lit(tag), key))
    both = F.coalesce((F.col("supplier_line") != "") & (F.col("supplier_mfr") != ""), F.lit(False))
    keys = F.array(tagged("c", number), tagged("m", mfr), tagged("n", norm_join(F.col("supplier_number"))), tagged("l", F.upper(F.concat_ws(":", "supplier_line", "supplier_mfr")), both))
    each = u.select("project_id", "supplier_id", F.explode(F.array_compact(keys)).alias("key"))
    place = F.row_number().over(Window.partitionBy("project_id", "key").orderBy("supplier_id"))
    return each.withColumn("place", place).filter(F.col("place") <= most)


def staged_matches(stores: DataFrame, suppliers: DataFrame, interchanges: DataFrame, rules: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """(store_id, supplier_id, step, method, confidence, rule_id).

    Steps: 1 canonical numbers equal; 2 line code and maker's number equal; 3 maker's number bare of punctuation; 4
    each number an interchange gives, one pick a number; 5 as 3 if the row has a line code, taking the next; 6 only if
    nothing was found, the number without a known prefix; 7 each punctuation rule (rule_id, old, new, confidence),
    applied as plain text.  Close costs raise the confidence.

    All lookups of all steps meet one index in one join.  A lookup can lose at most one candidate to each lookup
    before it, so of each key only as many suppliers are indexed as a store row has lookups; a key that many suppliers
    share costs no more than that.  One fold over the lookups of a row keeps what was taken."""
    s, u = _store(stores), _supplier(suppliers)
    ws = Workspace(stores.sparkSession, "staged")
    looked = ws.save(_lookups(s, interchanges, rules), "lookups")
    most = looked.groupBy("store_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most")).first()["most"] or 1
    met = looked.join(_index(u, most), ["project_id", "key"])
    every = met.groupBy("store_id", "step", "sub", "base").agg(F.array_sort(F.collect_list("supplier_id")).alias("candidates"))
    ordered = every.groupBy("store_id").agg(F.sort_array(F.collect_list(F.struct("step", "sub", "base", "candidates"))).alias("steps"))
    start = F.array().cast("array<struct<step:int,sub:string,base:double,supplier_id:string>>")

    def take(acc: Column, one: Column) -> Column:
        left = F.array_except(one["candidates"], F.transform(acc, lambda p: p["supplier_id"]))
        skip = (F.size(left) == 0) | ((one["step"] == 6) & (F.size(acc) > 0))
        pick = F.struct(one["step"].alias("step"), one["sub"].alias("sub"), one["base"].alias("base"), F.array_min(left).alias("supplier_id"))
        return F.when(skip, acc).otherwise(F.concat(acc, F.array(pick)))

    picks = ordered.select("store_id", F.explode(F.aggregate("steps", start, take)).alias("p")).select("store_id", "p.*")
    costs = picks.join(s.select("store_id", "store_cost", "store_line"), "store_id").join(u.select("supplier_id", "supplier_cost", "supplier_line"), "supplier_id")
    costs = costs.withColumn("cost", cost_comparison(F.col("store_cost"), F.col("supplier_cost"), tolerance))
    close = F.coalesce(F.col("cost.close"), F.lit(False))
    lifted = lambda base, most, share: F.when(close, F.least(F.lit(most), base + share * F.col("cost.similarity"))).otherwise(base)
    of_step = {k: lifted(F.col("base") if base is None else F.lit(base), top, share) if share else (F.col("base") if base is None else F.lit(base)) for k, (_, base, top, share) in STEPS.items()}
    same_line = F.coalesce(F.upper("store_line") == F.upper("supplier_line"), F.lit(False)) & (F.col("store_line") != "")
    of_step[3] = F.when(same_line, F.least(F.lit(SAME_LINE_MOST), of_step[3] + SAME_LINE_ADDS)).otherwise(of_step[3])
    confidence = F.coalesce(*[F.when(F.col("step") == k, c) for k, c in of_step.items()])
    method = F.coalesce(*[F.when(F.col("step") == k, name) for k, (name, *_) in STEPS.items()])
    return costs.select("store_id", "supplier_id", "step", method.alias("method"), confidence.alias("confidence"), F.when(F.col("step") == 7, F.col("sub")).alias("rule_id"))


def second_stage(
    stores: DataFrame, suppliers: DataFrame, taken: DataFrame, least: float = 0.65, most: int = 3, sample: int = 1000, tolerance: float = 10.0, hot_least: int = HOT_LEAST
) -> DataFrame:
    """(store_id, supplier_id, confidence, rank, candidates): the best ``most`` candidates of the rows the first stage
    left.

    Candidates are all suppliers of the same line code, of a maker's number with the same first characters (five, or
    four if the store's has no more), and of a number that shares four characters in a row; a row that meets none of
    these meets a sample of ``sample`` of its project's suppliers, at an even stride from a place that a hash of its
    number tells.  The score is .7 by number (length ratio if one holds the other, else edit similarity) and .3 by
    description; the bar is lower for containment, and else for rows with suppliers of their line code.  Close costs
    raise the score, costs more than half apart lower it, before the ranks are given."""
    ws = Workspace(stores.sparkSession, "second")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    fours = lambda c: F.when(F.length(c) >= 4, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1))), lambda i: F.concat(F.lit("g"), F.substring(c, i, F.lit(4))))).otherwise(F.array().cast("array<string>"))
    line = lambda c: F.when(text(c) != "", F.concat(F.lit("l"), F.col(c)))
    head = lambda c, k: F.when(F.length(c) >= k, F.concat(F.lit("p"), F.substring(c, 1, k)))
    s = _store(stores).join(taken.select("store_id").distinct(), "store_id", "left_anti").withColumn("x", norm_canonical(F.col("store_number"))).filter("x <> ''")
    u = _supplier(suppliers).withColumn("y", norm_canonical(F.col("supplier_number"))).filter("y <> ''")
    first = F.coalesce(head("store_mfr", 5), head("store_mfr", 4))
    s = s.select("project_id", "store_id", "x", "store_text", "store_cost", "store_number", "store_line", F.array_distinct(F.array_compact(F.concat(F.array(line("store_line"), first), fours(F.col("x"))))).alias("xs"))
    u = u.select("project_id", "supplier_id", "y", "supplier_text", "supplier_cost", "supplier_line", F.array_distinct(F.array_compact(F.concat(F.array(line("supplier_line"), head("supplier_mfr", 5), head("supplier_mfr", 4)), fours(F.col("y"))))).alias("ys"))
    s, u = ws.save(s, "store"), ws.save(u, "supplier")
    a = s.select("project_id", "store_id", "xs", F.explode("xs").alias("key"))
    b = u.select("project_id", "supplier_id", "ys", F.explode("ys").alias("key"))
    met = split_join(a, b, ["project_id", "key"], "store_id", "supplier_id", hot_least)
    pairs = met.filter(F.get(F.array_intersect("xs", "ys"), F.lit(0)) == F.col("key")).select("store_id", "supplier_id")
    known = b.select("project_id", "key").distinct()
    meeting = a.select("project_id", "store_id", "key").join(known, ["project_id", "key"], "left_semi").select("store_id").distinct()
    lone = s.join(meeting, "store_id", "left_anti")
    places = numbered(u.select("project_id", "supplier_id"), "project_id", "supplier_id")
    sizes = u.groupBy("project_id").agg(F.count("*").alias("n"))
    seed = string_hash32(F.coalesce(F.nullif(norm_stored(F.col("store_number")), F.lit("")), F.col("store_number")))
    drawn = lone.join(sizes, "project_id").withColumn("size", F.least(F.lit(sample), F.col("n"))).withColumn("stride", F.floor(F.col("n") / F.col("size")))
    drawn = drawn.select("project_id", "store_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("size").cast("int") - 1), lambda k: F.pmod(k * F.col("stride") + seed, F.col("n")))).alias("place"))
    pairs = pairs.unionByName(drawn.join(places, ["project_id", "place"]).select("store_id", "supplier_id"))
    lines = u.filter("supplier_line <> ''").select("project_id", F.col("supplier_line").alias("store_line")).distinct().withColumn("own_line", F.lit(True))
    left = s.join(lines, ["project_id", "store_line"], "left").select("store_id", "x", "store_text", "store_cost", F.coalesce("own_line", F.lit(False)).alias("own_line"))
    full = pairs.join(left, "store_id").join(u.select("supplier_id", "y", "supplier_text", "supplier_cost"), "supplier_id")
    x, y = F.col("x"), F.col("y")
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    inside = (F.contains(x, y) | F.contains(y, x)) & (short >= 4) & (short / long >= 0.5)
    part = F.when(inside, short / long).otherwise(edit_similarity(x, y))
    said = F.when((text("store_text") == "") | (text("supplier_text") == ""), 0.0).otherwise(edit_similarity(F.col("store_text"), F.col("supplier_text")))
    bar = F.lit(least) * F.when(inside, 0.75).when(F.col("own_line"), 0.9).otherwise(1.0)
    scored = full.withColumn("score", 0.7 * part + 0.3 * said).filter(F.col("score") >= bar).withColumn("cost", cost_comparison(F.col("store_cost"), F.col("supplier_cost"), tolerance))
    confidence = F.when(F.col("cost.close"), F.least(F.lit(0.95), F.col("score") + 0.05 * F.col("cost.similarity"))).when(F.col("cost.percent") > 50, F.col("score") * 0.9).otherwise(F.col("score"))
    kept = ws.save(scored.select("store_id", "supplier_id", F.round(confidence, 9).alias("confidence")), "scored")
    order = Window.partitionBy("store_id").orderBy(F.col("confidence").desc(), F.col("supplier_id"))
    counts = kept.groupBy("store_id").agg(F.count("*").alias("candidates"))
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).join(counts, "store_id")


def staged_program(stores: DataFrame, suppliers: DataFrame, interchanges: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, metrics) of both stages one after the other.

    ``matches`` is (store_id, supplier_id, stage, method, confidence), the stages' outputs as a bag.  ``metrics`` has a
    row a stage: rows that it was given, matches, match rate (stage 1: matches by rows; stage 2: rows matched by rows)
    and average confidence (stage 2: of each row's best)."""
    ws = Workspace(stores.sparkSession, "program")
    one = ws.save(staged_matches(stores, suppliers, interchanges, rules), "one")
    two = ws.save(second_stage(stores, suppliers, one), "two")
    as_stage = lambda df, stage, method: df.select("store_id", "supplier_id", F.lit(stage).alias("stage"), method.alias("method"), "confidence")
    matches = as_stage(one, 1, F.col("method")).unionByName(as_stage(two, 2, F.lit("FUZZY_SUBSTRING")))
    items = stores.select(F.col("id").alias("store_id")).distinct()
    given = items.agg(F.count("*").alias("items"))
    rest = items.join(one.select("store_id").distinct(), "store_id", "left_anti").agg(F.count("*").alias("items"))
    first = one.agg(F.count("*").alias("matches"), F.count("*").alias("hits"), F.avg("confidence").alias("average"))
    best = two.groupBy("store_id").agg(F.max("confidence").alias("best"), F.count("*").alias("n"))
    second = best.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.count("*").alias("hits"), F.avg("best").alias("average"))

    def told(stage: int, name: str, items: DataFrame, found: DataFrame) -> DataFrame:
        rate = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("items")), F.lit(0.0))
        return items.crossJoin(F.broadcast(found)).select(F.lit(stage).alias("stage"), F.lit(name).alias("name"), "items", "matches", F.round(rate, 6).alias("match_rate"), F.round(F.coalesce("average", F.lit(0.0)), 6).alias("average"))

    metrics = told(1, "Deterministic Matching", given, first).unionByName(told(2, "Fuzzy Matching", rest, second))
    return matches, metrics
