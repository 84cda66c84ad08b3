"""Matching a store's rows with a supplier's: by number, by interchange, by similarity, in stages.

All operators work within a project, on rows delivered once (see ``once``).  Where the source system left ties to
chance, the smaller id wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partweave.functions.similarity import (
    edit_similarity, exact_confidence, fuzzy_confidence, long_word_list, number_similarity, trigram_similarity,
)
from partweave.functions.text import long_words, norm_canonical, norm_join, norm_lower, norm_score, norm_stored, number_variants
from partweave.operators.cells import STORES_A_BLOCK, SUPPLIERS_A_PART, common_run_pairs, in_cells, ranked_pairs
from partweave.operators.simjoin import trigram_join
from partweave.operators.skew import HOT_LEAST, split_join
from partweave.session import Workspace

#: Least description similarity of an exact match, and least similarities of a fuzzy one.
EXACT_TEXT, FUZZY_PART, FUZZY_TEXT = 0.05, 0.40, 0.25


def once(rows: DataFrame) -> DataFrame:
    """Each id once; repeated deliveries are equal."""
    return rows.dropDuplicates(["id"])


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def _store(stores: DataFrame, more: list[str] | None = None) -> DataFrame:
    return once(stores).select(
        "project_id", F.col("id").alias("store_id"), F.col("part_number").alias("store_number"), F.col("line_code").alias("store_line"), F.col("description").alias("store_text"),
        F.col("canonical_part_number").alias("store_canonical"), F.col("mfr_part_number").alias("store_mfr"), F.col("current_cost").alias("store_cost"), *[F.col(c).alias(f"store_{c}") for c in more or []],
    )


def _supplier(suppliers: DataFrame, more: list[str] | None = None) -> DataFrame:
    return once(suppliers).select(
        "project_id", F.col("id").alias("supplier_id"), F.col("part_number").alias("supplier_number"), F.col("line_code").alias("supplier_line"), F.col("description").alias("supplier_text"),
        F.col("canonical_part_number").alias("supplier_canonical"), F.col("mfr_part_number").alias("supplier_mfr"), F.col("current_cost").alias("supplier_cost"), *[F.col(c).alias(f"supplier_{c}") for c in more or []],
    )


def exact_pairs(stores: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Pairs with equal normalised numbers (empty ones never match), with the similarity of their descriptions."""
    s = _store(stores).withColumn("norm", norm_join(F.col("store_number"))).filter("norm <> ''")
    u = _supplier(suppliers).withColumn("norm", norm_join(F.col("supplier_number"))).filter("norm <> ''")
    return s.join(u, ["project_id", "norm"]).withColumn("text_similarity", trigram_similarity(F.col("store_text"), F.col("supplier_text")))


def alike_pairs(stores: DataFrame, suppliers: DataFrame, hot_least: int = HOT_LEAST, more: list[str] | None = None) -> DataFrame:
    """Pairs whose numbers are equal as in exact_pairs or share three characters in a row, the supplier's by its number
    or its maker's number, with the similarity of their descriptions.  A pair counts only where it meets in the first
    key it shares, so it comes once; runs that very many numbers hold are cut into cells.  The columns ``more`` of either
    side come with the pairs, which are many more than rows: joined to them later, every pair would be shuffled."""

    def runs(c: str) -> Column:
        n = norm_score(F.col(c))
        return F.coalesce(F.when(F.length(n) > 2, F.transform(F.sequence(F.lit(1), F.length(n) - 2), lambda i: F.substring(n, i, F.lit(3)))), F.array().cast("array<string>"))

    equal = lambda c: F.array_compact(F.array(F.nullif(norm_join(F.col(c)), F.lit(""))))
    marked = lambda c: F.transform(equal(c), lambda w: F.concat(F.lit("="), w))
    s = _store(stores, more).withColumn("x", F.array_distinct(F.concat(marked("store_number"), runs("store_number"))))
    u = _supplier(suppliers, more).withColumn("y", F.array_distinct(F.concat(marked("supplier_number"), runs("supplier_number"), runs("supplier_mfr"))))
    met = split_join(s.withColumn("key", F.explode("x")), u.withColumn("key", F.explode("y")), ["project_id", "key"], "store_id", "supplier_id", hot_least)
    first = met.filter(F.get(F.array_intersect("x", "y"), F.lit(0)) == F.col("key")).drop("x", "y", "key")
    return first.withColumn("text_similarity", trigram_similarity(F.col("store_text"), F.col("supplier_text")))


def exact_best(stores: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Each store row's best exact match whose description is similar at all; a missing description is not similar."""
    kept = exact_pairs(stores, suppliers).filter(F.col("text_similarity") >= EXACT_TEXT)
    best = first_by(kept, ["store_id"], [F.col("text_similarity").desc(), F.col("supplier_id")])
    same = F.col("store_number") == F.col("supplier_number")
    return best.select("project_id", "store_id", "supplier_id", "text_similarity", exact_confidence(same, F.col("text_similarity")).alias("confidence"))


def is_complex_number(c: Column) -> Column:
    """Whether a number has letters and digits and more than five of them: unlikely to be shared by chance."""
    return c.rlike("[0-9]") & c.rlike("[A-Za-z]") & (F.length(F.regexp_replace(c, "[^a-zA-Z0-9]", "")) > 5)


def exact_by_line(stores: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Exact pairs whose line codes agree, or of which one has none, or whose number is complex."""
    line = lambda c: norm_join(F.col(c))
    agree = F.col("store_line").isNull() | F.col("supplier_line").isNull() | (line("store_line") == line("supplier_line")) | is_complex_number(F.col("store_number"))
    same = (F.col("store_number") == F.col("supplier_number")) & F.col("store_line").eqNullSafe(F.col("supplier_line"))
    confidence = (
        F.when(same, 1.0)
        .when(F.coalesce(line("store_line") == line("supplier_line"), F.lit(False)), 0.98)
        .when(is_complex_number(F.col("store_number")), 0.95)
        .otherwise(0.92)
    )
    return exact_pairs(stores, suppliers).filter(agree).select("project_id", "store_id", "supplier_id", confidence.alias("confidence"))


def exact_canonical(stores: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Pairs whose stored canonical numbers are equal."""
    s = _store(stores).filter("store_canonical <> ''").withColumn("canonical", F.upper("store_canonical"))
    u = _supplier(suppliers).filter("supplier_canonical <> ''").withColumn("canonical", F.upper("supplier_canonical"))
    return s.join(u, ["project_id", "canonical"]).select("project_id", "store_id", "supplier_id", "canonical")


def interchange_keys(interchanges: DataFrame) -> DataFrame:
    """(project_id, edge_id, side, norm, other): each interchange seen from either side, so that "one number or the
    other" is an equi-join."""
    m, v = norm_join(F.col("merrill_part_number")), norm_join(F.col("vendor_part_number"))
    sides = F.array(F.struct(F.lit("MERRILL").alias("side"), m.alias("norm"), v.alias("other")), F.struct(F.lit("VENDOR").alias("side"), v.alias("norm"), m.alias("other")))
    keyed = once(interchanges).select("project_id", F.col("id").alias("edge_id"), "vendor", F.col("line_code").alias("edge_line"), F.explode(sides).alias("k"))
    return keyed.select("project_id", "edge_id", "vendor", "edge_line", "k.*").filter("norm rlike '[0-9]' and other rlike '[0-9]'")


def interchange_bridge(stores: DataFrame, suppliers: DataFrame, interchanges: DataFrame) -> DataFrame:
    """Store rows and supplier rows whose numbers an interchange of the project links, whichever side is whose."""
    s = _store(stores).select("project_id", "store_id", norm_join(F.col("store_number")).alias("norm")).filter("norm <> ''")
    u = _supplier(suppliers).select("project_id", "supplier_id", norm_join(F.col("supplier_number")).alias("other")).filter("other <> ''")
    keys = interchange_keys(interchanges)
    return s.join(keys, ["project_id", "norm"]).join(u, ["project_id", "other"]).select("project_id", "store_id", "supplier_id", "edge_id").distinct()


def interchange_first(stores: DataFrame, suppliers: DataFrame, interchanges: DataFrame) -> DataFrame:
    """Each store row's best interchange: one with a vendor before one without, then one with a line code, then the
    smaller id; the catalogue row is added where there is one, else the target is INTERCHANGE_ONLY."""
    s = _store(stores).select("project_id", "store_id", norm_join(F.col("store_number")).alias("norm")).filter("norm <> ''")
    met = s.join(interchange_keys(interchanges), ["project_id", "norm"])
    met = first_by(met, ["store_id", "edge_id"], [F.col("side")])
    full = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    best = first_by(met, ["store_id"], [full("vendor").desc(), full("edge_line").desc(), F.col("edge_id")])
    u = _supplier(suppliers).select("project_id", "supplier_id", norm_join(F.col("supplier_number")).alias("other")).filter("other <> ''")
    u = u.groupBy("project_id", "other").agg(F.min("supplier_id").alias("supplier_id"))
    joined = best.join(u, ["project_id", "other"], "left")
    return joined.select("project_id", "store_id", "edge_id", F.col("side").alias("matched_on"), F.coalesce("supplier_id", F.lit("INTERCHANGE_ONLY")).alias("target_id"))


def unmatched(stores: DataFrame, candidates: DataFrame) -> DataFrame:
    """Store rows without any candidate."""
    return once(stores).join(candidates.select(F.col("store_item_id").alias("id")), "id", "left_anti")


def matched(stores: DataFrame, candidates: DataFrame) -> DataFrame:
    """Store rows with a candidate, each once."""
    return once(stores).join(candidates.select(F.col("store_item_id").alias("id")), "id", "left_semi")


def waterfall(stores: DataFrame, suppliers: DataFrame, makers: DataFrame) -> DataFrame:
    """Each store row's first match of three tiers: number and line code as they are; both normalised; numbers
    normalised and line codes of one maker.  ``makers`` maps store codes to supplier codes."""
    s = _store(stores).select("project_id", "store_id", "store_number", "store_line", norm_canonical(F.col("store_number")).alias("norm")).filter("norm <> ''")
    u = _supplier(suppliers).select("project_id", "supplier_id", "supplier_number", "supplier_line", norm_canonical(F.col("supplier_number")).alias("norm")).filter("norm <> ''")
    m = makers.select(F.upper(F.trim("client_line_code")).alias("from_code"), F.upper(F.trim("arnold_line_code")).alias("to_code")).dropna().distinct()
    pairs = s.join(u, ["project_id", "norm"])
    strict = (F.col("store_number") == F.col("supplier_number")) & F.col("store_line").eqNullSafe(F.col("supplier_line"))
    plain = lambda c: F.upper(F.trim(c))
    loose = plain("store_line").eqNullSafe(plain("supplier_line"))
    translated = pairs.join(m, (plain("store_line") == m.from_code) & (plain("supplier_line") == m.to_code), "left")
    tier = F.when(strict, 1).when(loose, 2).when(F.col("to_code").isNotNull(), 3)
    tiered = translated.withColumn("tier", tier).filter("tier is not null")
    return first_by(tiered, ["store_id"], [F.col("tier"), F.col("supplier_id")]).select("project_id", "store_id", "supplier_id", "tier")


def fuzzy_best(stores: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Each store row's best match by trigrams of the number, if the descriptions are alike too."""
    s, u = _store(stores), _supplier(suppliers)
    pairs = trigram_join(s, u, "project_id", "store_id", "supplier_id", F.col("store_number"), F.col("supplier_number"), FUZZY_PART)
    texts = pairs.join(s.select("store_id", "store_text"), "store_id").join(u.select("supplier_id", "supplier_text"), "supplier_id")
    scored = texts.withColumn("text_similarity", trigram_similarity(F.col("store_text"), F.col("supplier_text"))).filter(F.col("text_similarity") >= FUZZY_TEXT)
    best = first_by(scored, ["store_id"], [F.col("similarity").desc(), F.col("text_similarity").desc(), F.col("supplier_id")])
    confidence = fuzzy_confidence(F.col("similarity"), F.col("text_similarity"))
    return best.select("project_id", "store_id", "supplier_id", F.col("similarity").alias("part_similarity"), "text_similarity", confidence.alias("confidence"))


def described_alike(stores: DataFrame, suppliers: DataFrame, suppliers_a_task: int = 1000) -> DataFrame:
    """(project_id, store_id, supplier_id, similarity): pairs where one of the first three words of more than three
    characters of the store's description lies anywhere in the supplier's, with the number of those that do.

    Such a word lies in a description where it lies in one of its words.  So the distinct words of either side meet
    first, by four characters in a row, and the rows meet by the words found.  A word that many suppliers' rows hold
    is cut into parts by the supplier's id.  A pair counts only where it meets in the first word it shares, so it
    comes once without another shuffle."""
    a = stores.select("project_id", "store_id", F.array_distinct(F.slice(long_words(F.col("store_text")), 1, 3)).alias("x"))
    b = suppliers.select("project_id", "supplier_id", F.explode(F.array_distinct(long_words(F.col("supplier_text")))).alias("held"))
    fours = F.transform(F.sequence(F.lit(1), F.length("held") - 3), lambda i: F.substring(F.col("held"), i, F.lit(4)))
    sought = a.select("project_id", F.explode("x").alias("word")).distinct().withColumn("four", F.substring("word", 1, 4))
    held = b.select("project_id", "held").distinct().withColumn("four", F.explode(F.array_distinct(fours)))
    links = sought.join(held, ["project_id", "four"]).filter(F.contains("held", "word")).select("project_id", "held", "word")
    found = b.join(links, ["project_id", "held"]).groupBy("project_id", "supplier_id").agg(F.collect_set("word").alias("y"))
    by_word = Workspace(stores.sparkSession, "described").save(found, "found").withColumn("word", F.explode("y"))
    parts = by_word.groupBy("project_id", "word").agg(F.ceil(F.count("*") / suppliers_a_task).cast("int").alias("parts"))
    left = a.withColumn("word", F.explode("x")).join(parts, ["project_id", "word"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = by_word.join(parts, ["project_id", "word"]).withColumn("part", F.pmod(F.xxhash64("supplier_id"), F.col("parts")).cast("int"))
    met = left.drop("parts").join(right.drop("parts"), ["project_id", "word", "part"]).withColumn("z", F.array_intersect("x", "y"))
    return met.filter(F.get("z", F.lit(0)) == F.col("word")).select("project_id", "store_id", "supplier_id", F.size("z").cast("double").alias("similarity"))


def tiered_candidates(stores: DataFrame, suppliers: DataFrame, most: int = 20) -> DataFrame:
    """For each store row the candidates of its first tier that has any, best ``most``: same line code and number
    similarity .3; any line and .4; one of the description's first three long words, of any kind, anywhere in the
    supplier's description."""
    s, u = _store(stores), _supplier(suppliers)
    near = trigram_join(s, u, "project_id", "store_id", "supplier_id", F.col("store_number"), F.col("supplier_number"), 0.3)
    lines = near.join(s.select("store_id", "store_line"), "store_id").join(u.select("supplier_id", "supplier_line"), "supplier_id")
    tier = F.when(F.upper("store_line") == F.upper("supplier_line"), 1).when(F.col("similarity") >= 0.4, 2)
    by_number = lines.withColumn("tier", tier).filter("tier is not null").select("project_id", "store_id", "supplier_id", "tier", "similarity")
    first = by_number.withColumn("least", F.min("tier").over(Window.partitionBy("store_id"))).filter("tier = least").drop("least")
    order = Window.partitionBy("store_id").orderBy(F.col("similarity").desc(), F.col("supplier_id"))
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    near_best = Workspace(s.sparkSession, "tiers").save(best(first), "by_number")  # else the join by number runs for each of its readers
    left = s.join(near_best.select("store_id"), "store_id", "left_anti")
    return near_best.unionByName(best(described_alike(left, u).withColumn("tier", F.lit(3))))


def best_of_project(s: DataFrame, u: DataFrame, score: Callable[[Column, Column], Column], most: int, least: float, stores_a_block: int = 1000, suppliers_a_part: int = 5000) -> DataFrame:
    """(store_id, supplier_id, score, rank): the best ``most`` supplier rows of each store row, of at least ``least``.

    For scores that no key implies which pairs would have to share: every pair of a project is scored.  ``s`` has
    project_id, store_id and a struct ``a``, ``u`` has project_id, supplier_id and a struct ``b`` with the supplier_id.
    Store rows in blocks meet supplier rows in parts, and of a part only the best go on."""
    cuts = lambda rows, size, name: rows.groupBy("project_id").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    both = cuts(s, stores_a_block, "blocks").join(cuts(u, suppliers_a_part, "parts"), "project_id")
    s, u = s.join(both, "project_id"), u.join(both, "project_id")
    place = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = s.select("project_id", "store_id", "a", place("store_id", "blocks").alias("block"), every("parts").alias("part"))
    parts = u.groupBy("project_id", place("supplier_id", "parts").alias("part"), "blocks").agg(F.collect_list("b").alias("rows"))
    right = parts.select("project_id", "part", "rows", every("blocks").alias("block"))
    scored = F.transform("rows", lambda b: F.struct(F.round(-score(F.col("a"), b), 9).alias("lack"), b["supplier_id"].alias("supplier_id")))
    best = F.slice(F.sort_array(F.filter(scored, lambda p: p["lack"] <= -least)), 1, most)
    met = left.join(right, ["project_id", "block", "part"]).select("store_id", F.explode(best).alias("p"))
    order = Window.partitionBy("store_id").orderBy(F.col("score").desc(), F.col("supplier_id"))
    return met.select("store_id", "p.supplier_id", (-F.col("p.lack")).alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def additive_best(stores: DataFrame, suppliers: DataFrame, most: int = 100, least: float = 10.0, stores_a_block: int = 1000, suppliers_a_part: int = 5000) -> DataFrame:
    """(store_id, supplier_id, score, rank): the best ``most`` supplier rows of each store row by the additive score, of
    which a close cost alone reaches ``least``."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 3))
    read = lambda side: [F.upper(f"{side}_number").alias("number"), F.upper(f"{side}_line").alias("line"), words(F.col(f"{side}_text")).alias("words"), F.col(f"{side}_cost").cast("double").alias("cost")]
    s = _store(stores).select("project_id", "store_id", F.struct(*read("store")).alias("a"))
    u = _supplier(suppliers).select("project_id", "supplier_id", F.struct("supplier_id", *read("supplier")).alias("b"))

    def score(a: Column, b: Column) -> Column:
        x, y = a["number"], b["number"]
        told = (F.length(x) > 0) & (F.length(y) > 0)
        number = F.when(F.contains(x, y) | F.contains(y, x), 50).otherwise(0) + 40 * (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))
        line = F.when((a["line"] == b["line"]) & (a["line"] != ""), 100).otherwise(0)
        shared = F.coalesce(F.size(F.array_intersect(a["words"], b["words"])), F.lit(0))
        gap = F.abs(a["cost"] - b["cost"])
        cost = F.when(gap < 5, 20).when(gap < 20, 10).otherwise(0)
        return line + F.when(told, number).otherwise(0.0) + 5 * F.when(shared > 0, shared).otherwise(0) + cost

    return best_of_project(s, u, score, most, least, stores_a_block, suppliers_a_part)


def catalogue_best(stores: DataFrame, suppliers: DataFrame) -> DataFrame:
    """(store_id, supplier_id, score): each store row's best supplier row of its project.

    Of two numbers: 1 if equal; where both rows have a line code, .95 if what is left without it is equal and long
    enough, and nothing else counts; else .9 of the length ratio if one holds the other; else .85 of an edit similarity
    of .75 or more.  Two shared long words add .1 and equal maker's numbers .15, 1 at most."""
    bare = lambda c: norm_score(F.col(c))
    words = lambda c: F.filter(F.split(F.upper(c), r"\s+"), lambda w: F.length(w) > 3)
    core = lambda side: F.when(F.col(f"{side}_line") != "", F.regexp_replace(bare(f"{side}_number"), F.concat(F.lit("^(.*?)"), bare(f"{side}_line")), "$1"))
    read = lambda side: [bare(f"{side}_number").alias("number"), core(side).alias("core"), words(F.col(f"{side}_text")).alias("words"), bare(f"{side}_mfr").alias("mfr")]
    s = _store(stores).filter("store_number is not null").select("project_id", "store_id", F.struct(*read("store")).alias("a"))
    u = _supplier(suppliers).filter("supplier_number is not null").select("project_id", "supplier_id", F.struct("supplier_id", *read("supplier")).alias("b"))

    def score(a: Column, b: Column) -> Column:
        x, y = a["number"], b["number"]
        short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
        alike = 1 - F.levenshtein(x, y) / long
        base = (
            F.when(x == y, 1.0)
            .when(a["core"].isNotNull() & b["core"].isNotNull(), F.when((a["core"] == b["core"]) & (F.length(a["core"]) >= 4), 0.95).otherwise(0.0))
            .when(F.contains(x, y) | F.contains(y, x), short / long * 0.9)
            .when(short / long < 0.75, 0.0)
            .otherwise(F.when(alike >= 0.75, alike * 0.85).otherwise(0.0))
        )
        shared = F.coalesce(F.size(F.filter(a["words"], lambda w: F.array_contains(b["words"], w))), F.lit(0))
        told = F.when(shared >= 2, F.least(F.lit(1.0), base + 0.1)).otherwise(base)
        return F.when(base > 0, F.when((a["mfr"] == b["mfr"]) & (a["mfr"] != ""), F.least(F.lit(1.0), told + 0.15)).otherwise(told)).otherwise(0.0)

    return best_of_project(s, u, score, 1, 1e-9).drop("rank")


#: Lengths of the beginnings by which pieces of words and of texts meet.
MEETINGS = (8, 5, 3, 2, 1)


def words_held(words: DataFrame, texts: DataFrame, hot_least: int = HOT_LEAST) -> DataFrame:
    """(project_id, word, supplier_id), each once: the texts (project_id, supplier_id, whole) in which the words
    (project_id, word) lie, anywhere.

    A word lies in a text only where its longest blank-parted piece lies in a piece of the text, and pieces are far
    fewer than texts.  So the distinct pieces of either side meet first, by the longest of MEETINGS that the word's piece
    has, and the texts meet what was found.  Words with blanks are looked for once more in the whole text."""
    ws = Workspace(words.sparkSession, "held")
    part = F.transform(F.split("word", " "), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))
    known = ws.save(words.distinct().withColumn("core", F.array_max(part)["p"]), "words")
    whole = ws.save(texts, "texts")
    length = F.length("core")
    size = F.coalesce(*[F.when(length >= n, n) for n in MEETINGS], F.lit(0))
    plain = (F.col("word") == F.col("core")).cast("int")
    cores = known.groupBy("project_id", "core").agg(F.max(plain).alias("plain"), F.min(plain).alias("all_plain")).withColumn("size", size)
    sought = ws.save(cores.withColumn("key", F.expr("substring(core, 1, size)")), "sought")
    sizes = {r["size"] for r in sought.select("size").distinct().collect()}

    def starts(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length("held") - (n - 1)), lambda i: F.substring("held", i, F.lit(n)))
        return F.coalesce(F.when(F.length("held") >= n, each) if n else F.when(F.col("held") == "", F.array(F.lit(""))), F.array().cast("array<string>"))

    if not sizes:
        return known.select("project_id", "word", F.lit(None).cast("string").alias("supplier_id")).limit(0)
    pieces = F.split("whole", " ")
    by_piece = whole.select("project_id", "supplier_id", F.explode(F.array_distinct(F.concat(pieces, F.array(F.lit(""))) if 0 in sizes else pieces)).alias("held"))
    met = by_piece.select("project_id", "held").distinct().withColumn("key", F.explode(F.array_distinct(F.concat(*map(starts, sizes)))))
    found = sought.join(met, ["project_id", "key"]).filter(F.contains("held", "core"))
    links = ws.save(found.select("project_id", "held", "core", "plain", "all_plain"), "links")
    rows = split_join(links, by_piece, ["project_id", "held"], "core", "supplier_id", hot_least)
    rows = ws.save(rows.select("project_id", "supplier_id", "core", "plain", "all_plain").dropDuplicates(["project_id", "supplier_id", "core"]), "rows")
    parted = split_join(known.filter("word <> core"), rows.filter("all_plain = 0").select("project_id", "supplier_id", "core"), ["project_id", "core"], "word", "supplier_id", hot_least)
    parted = parted.join(whole.select("supplier_id", "whole"), "supplier_id").filter(F.contains("whole", "word"))
    return rows.filter("plain = 1").select("project_id", F.col("core").alias("word"), "supplier_id").unionByName(parted.select("project_id", "word", "supplier_id"))


def variation_matches(stores: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Each store row's first spelling variation that a supplier lists; confidence falls with its place."""
    s = _store(stores).filter("store_number is not null").select("project_id", "store_id", F.posexplode(number_variants(F.trim("store_number"))).alias("place", "variant"))
    s = s.withColumn("key", norm_lower(F.col("variant"))).filter("key <> ''")
    u = _supplier(suppliers).withColumn("key", norm_lower(F.col("supplier_number"))).filter("key <> ''")
    met = s.join(u.select("project_id", "key", "supplier_id"), ["project_id", "key"])
    best = first_by(met, ["store_id"], [F.col("place"), F.col("supplier_id")])
    return best.select("project_id", "store_id", "supplier_id", "place", F.greatest(F.lit(0.6), 0.75 - 0.05 * F.col("place")).alias("confidence"))


def collisions(suppliers: DataFrame) -> DataFrame:
    """Numbers that several brands list within a project; a missing brand is a brand of its own."""
    u = once(suppliers).select("project_id", norm_stored(F.col("part_number")).alias("norm"), "brand").filter("norm <> ''")
    brands = F.countDistinct("brand") + F.max(F.when(F.col("brand").isNull(), 1).otherwise(0))
    return u.groupBy("project_id", "norm").agg(brands.alias("brands"), F.count("*").alias("listings")).filter("brands > 2")


def number_scores(stores: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Scores of the pairs with alike numbers by each of the number and text similarities."""
    p = alike_pairs(stores, suppliers)
    return p.select(
        "store_id", "supplier_id", number_similarity(F.col("store_number"), F.col("supplier_number")).alias("number_score"),
        edit_similarity(F.col("store_number"), F.col("supplier_number")).alias("edit_score"), "text_similarity",
    )


def common_run_scores(stores: DataFrame, suppliers: DataFrame, stores_a_block: int = STORES_A_BLOCK, suppliers_a_part: int = SUPPLIERS_A_PART) -> DataFrame:
    """(store_id, supplier_id, score): the pairs of alike_pairs, with the common run score of the store's number and the
    maker's number."""
    n, f = F.col("part_number"), F.col("mfr_part_number")
    read = [norm_join(n).alias("key"), norm_score(n).alias("number"), norm_score(f).alias("mfr"), norm_stored(n).alias("stored"), norm_stored(f).alias("stored_mfr")]
    s, u = (once(rows).select("project_id", "id", *read) for rows in (stores, suppliers))
    return in_cells(s, u, common_run_pairs, "store_id string, supplier_id string, score double", stores_a_block, suppliers_a_part)


def ranked_candidates(stores: DataFrame, suppliers: DataFrame, most: int = 50, fill_to: int = 180, stores_a_block: int = STORES_A_BLOCK, suppliers_a_part: int = SUPPLIERS_A_PART) -> DataFrame:
    """(store_id, supplier_id, score, rank): the best ``most`` candidates by the ranked score, of several ways to find
    candidates, each counted once: the same line code, maker's numbers alike (.5), numbers alike (.45), and, where these
    give fewer than ``fill_to``, two long words in common.  Numbers count where either pair of them shares three characters
    in a row or is equal, or the line code is the same.

    Where one part holds a project's supplier rows, its cells rank alone; else the best of the parts are ranked again."""
    words = F.coalesce(long_word_list(F.col("description")), F.array().cast("array<string>"))
    read = [norm_stored(F.col("part_number")).alias("number"), norm_stored(F.col("mfr_part_number")).alias("mfr"), F.col("line_code").alias("line"), words.alias("words")]
    ws = Workspace(stores.sparkSession, "ranked")
    s, u = (ws.save(once(rows).select("project_id", "id", *read), name) for rows, name in ((stores, "store"), (suppliers, "supplier")))
    schema = "store_id string, supplier_id string, score double, rank int, near boolean, near_here bigint"
    one, several = (in_cells(s, u, ranked_pairs(most, fill_to), schema, stores_a_block, suppliers_a_part, only) for only in ("parts = 1", "parts > 1"))
    row = Window.partitionBy("store_id")
    kept = several.withColumn("all_near", F.sum("near_here").over(row)).filter(F.col("near") | (F.col("all_near") < fill_to))
    ranked = kept.withColumn("rank", F.row_number().over(row.orderBy(F.col("score").desc(), F.col("supplier_id")))).filter(F.col("rank") <= most)
    columns = ["store_id", "supplier_id", "score", "rank"]
    return one.select(*columns).unionByName(ranked.select(*columns))
