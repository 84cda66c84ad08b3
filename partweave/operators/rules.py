"""Rules learned from decisions and interchanges, and what they add to or take from the candidates.

State is append-only: a candidate is its newest version, an update is a newer row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.functions.text import norm_canonical, norm_stored, punctuation_signature
from partweave.operators.matching import first_by, once
from partweave.operators.skew import HOT_LEAST, heavy_keys, join_unique


def newest(candidates: DataFrame, *columns: str) -> DataFrame:
    """Each id's newest version with the given columns; a maximum over a struct, combined before the shuffle."""
    kept = ["updated_at", *[c for c in columns if c != "updated_at"]]
    best = candidates.filter("id is not null").groupBy("id").agg(F.max(F.struct(*kept)).alias("v"))
    return best.select("id", *[F.col(f"v.{c}").alias(c) for c in columns])


def join_items(candidates: DataFrame, items: DataFrame, key: str, how: str = "left", least: int = HOT_LEAST) -> DataFrame:
    """``candidates`` joined with ``items``, which has one row for each ``key``; a row that a large share of the
    candidates belongs to is met by broadcast where they lie."""
    hot, _ = heavy_keys(candidates, F.col(key), least)
    return join_unique(candidates, items, key, None if hot is None else hot.select(F.col("_h").alias(key)), how)


def _numbers(stores: DataFrame, suppliers: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = once(stores).select("project_id", F.col("id").alias("store_id"), norm_canonical(F.col("part_number")).alias("store_key")).filter("store_key <> ''")
    u = once(suppliers).select("project_id", F.col("id").alias("supplier_id"), norm_canonical(F.col("part_number")).alias("supplier_key")).filter("supplier_key <> ''")
    return s, u


def _rules(rules: DataFrame, kind: str) -> DataFrame:
    """Enabled rules of a kind by canonical numbers; a rule without a project holds in all."""
    keys = [norm_canonical(F.col("store_part_number")).alias("store_key"), norm_canonical(F.col("supplier_part_number")).alias("supplier_key")]
    scope = F.when(F.col("scope") == "PROJECT_SPECIFIC", F.col("project_id")).alias("rule_project")
    return once(rules).filter(F.col("enabled") & (F.col("rule_type") == kind)).select(F.col("id").alias("rule_id"), "confidence", scope, *keys).filter("store_key <> '' and supplier_key <> ''")


def positive_candidates(stores: DataFrame, suppliers: DataFrame, rules: DataFrame, candidates: DataFrame) -> DataFrame:
    """(store_id, supplier_id, rule_id, confidence): the pairs that rules map and no candidate holds yet; of several
    rules the most confident, then the smaller id."""
    s, u = _numbers(stores, suppliers)
    r = _rules(rules, "POSITIVE_MAP")
    met = s.join(r, "store_key").filter("rule_project is null or rule_project = project_id").join(u, ["project_id", "supplier_key"])
    known = newest(candidates, "store_item_id", "target_id").select(F.col("store_item_id").alias("store_id"), F.col("target_id").alias("supplier_id"))
    fresh = met.join(known, ["store_id", "supplier_id"], "left_anti")
    best = first_by(fresh, ["store_id", "supplier_id"], [F.col("confidence").desc_nulls_last(), F.col("rule_id")])
    return best.select("store_id", "supplier_id", "rule_id", "confidence")


def blocked_candidates(stores: DataFrame, suppliers: DataFrame, rules: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, rule_id): candidates whose two numbers a NEGATIVE_BLOCK rule forbids; every supplier row of the number is
    blocked, not only one."""
    s, u = _numbers(stores, suppliers)
    r = _rules(rules, "NEGATIVE_BLOCK")
    c = newest(candidates, "store_item_id", "target_id").withColumnsRenamed({"store_item_id": "store_id", "target_id": "supplier_id"})
    full = join_items(join_items(c, s, "store_id", "inner"), u.drop("project_id"), "supplier_id", "inner")
    met = full.join(r, ["store_key", "supplier_key"]).filter("rule_project is null or rule_project = project_id")
    return met.groupBy("id").agg(F.min("rule_id").alias("rule_id"))


def learned_rules(stores: DataFrame, suppliers: DataFrame, rules: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rule_type, store_key, supplier_key, decisions): rules that decisions teach and that no enabled rule states."""
    s, u = _numbers(stores, suppliers)
    c = newest(candidates, "store_item_id", "target_id", "status").filter(F.col("status").isin("CONFIRMED", "REJECTED"))
    c = c.withColumnsRenamed({"store_item_id": "store_id", "target_id": "supplier_id"})
    full = join_items(join_items(c, s, "store_id", "inner"), u.drop("project_id"), "supplier_id", "inner")
    kind = F.when(F.col("status") == "CONFIRMED", "POSITIVE_MAP").otherwise("NEGATIVE_BLOCK")
    told = full.groupBy(kind.alias("rule_type"), "store_key", "supplier_key").agg(F.count("*").alias("decisions"))
    known = _rules(rules, "POSITIVE_MAP").withColumn("rule_type", F.lit("POSITIVE_MAP")).unionByName(_rules(rules, "NEGATIVE_BLOCK").withColumn("rule_type", F.lit("NEGATIVE_BLOCK")))
    return told.join(known.select("rule_type", "store_key", "supplier_key"), ["rule_type", "store_key", "supplier_key"], "left_anti")


def interchange_rules(interchanges: DataFrame) -> DataFrame:
    """(store_key, supplier_key, confidence, edge_id): one rule for each pair of numbers that interchanges link, by the
    most confident statement, then the smaller id."""
    a, b = norm_stored(F.col("merrill_part_number")).alias("store_key"), norm_stored(F.col("vendor_part_number")).alias("supplier_key")
    edges = once(interchanges).select(F.col("id").alias("edge_id"), F.least(F.coalesce("confidence", F.lit(0.95)), F.lit(0.95)).alias("confidence"), a, b)
    kept = edges.filter("store_key rlike '[0-9]' and supplier_key rlike '[0-9]' and store_key <> supplier_key")
    return first_by(kept, ["store_key", "supplier_key"], [F.col("confidence").desc(), F.col("edge_id")]).select("store_key", "supplier_key", "confidence", "edge_id")


def mined_patterns(pairs: DataFrame, least: int = 2) -> DataFrame:
    """(signature, n, average, line_code, example_id): punctuation changes that matched pairs show at least ``least``
    times.  ``pairs`` has id, a and b (the two numbers), line and confidence; line_code is given only if all pairs of
    a signature share one."""
    told = pairs.withColumn("signature", punctuation_signature(F.col("a"), F.col("b"))).filter("signature is not null")
    one_line = (F.min("line") == F.max("line")) & (F.count("line") == F.count("*"))
    return (
        told.groupBy("signature")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("confidence"), 6).alias("average"),
            F.when(one_line, F.min("line")).alias("line_code"),
            F.min("id").alias("example_id"),
        )
        .filter(F.col("n") >= least)
    )


def line_code_map(mappings: DataFrame) -> DataFrame:
    """(client_code, maker, supplier_code): each store code once, the most confident statement, then the smaller id."""
    rows = mappings.filter("client_line_code is not null").select("id", F.upper(F.trim("client_line_code")).alias("client_code"), F.col("manufacturer_name").alias("maker"), F.upper(F.trim("arnold_line_code")).alias("supplier_code"), "confidence")
    return first_by(rows, ["client_code"], [F.col("confidence").desc_nulls_last(), F.col("id")]).select("client_code", "maker", "supplier_code")


def translated_line_codes(stores: DataFrame, mappings: DataFrame) -> DataFrame:
    """(id, line_code, maker, supplier_code, rewritten): each store row's code, whose it is, the supplier's code for it,
    and the number rewritten as supplier code, dash and number without the store's code."""
    s = once(stores).select("id", F.upper(F.trim("line_code")).alias("line_code"), F.upper(F.trim("part_number")).alias("number"))
    m = line_code_map(mappings).withColumnRenamed("client_code", "line_code")
    bare = F.when(F.col("number").startswith(F.col("line_code")) & (F.length("number") > F.length("line_code") + 2), F.regexp_replace(F.substring("number", F.length("line_code") + 1, F.lit(1 << 20)), r"^[-\s]", "")).otherwise(F.col("number"))
    return s.join(m, "line_code", "left").select("id", "line_code", "maker", "supplier_code", F.when(F.col("supplier_code").isNotNull(), F.concat_ws("-", "supplier_code", bare)).alias("rewritten"))


def decision_of(text: Column) -> Column:
    """What a reviewer's entry says: CONFIRMED, REJECTED, or null if it cannot be read."""
    s = F.upper(F.trim(text))
    return F.when(s.isin("ACCEPT", "APPROVE", "CONFIRM", "YES", "Y"), "CONFIRMED").when(s.isin("REJECT", "DENY", "NO", "N"), "REJECTED")


def check_reviews(reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """Review rows (match_id, decision, corrected_number) with ``status`` and ``error``: blank id, unknown id, no
    readable decision, or a correction of something rejected.  Rows with an error are kept, with their reason."""
    known = newest(candidates, "project_id").withColumnRenamed("id", "match_id")
    joined = reviews.join(known, "match_id", "left").withColumn("status", decision_of(F.col("decision")))
    blank = F.coalesce(F.trim("match_id"), F.lit("")) == ""
    error = (
        F.when(blank, "match_id is missing")
        .when(F.col("project_id").isNull(), "match_id is unknown")
        .when(F.col("status").isNull(), "decision cannot be read")
        .when((F.col("status") == "REJECTED") & (F.coalesce(F.trim("corrected_number"), F.lit("")) != ""), "a rejected match has a correction")
    )
    return joined.withColumn("error", error)
