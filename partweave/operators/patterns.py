"""What is done with patterns of spelling once they are mined: more rows they fit, suggestions, clusters, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.functions.text import apply_change, change_class, character_change, norm_canonical, norm_stored, punctuation_signature
from partweave.operators.matching import once
from partweave.operators.rules import mined_patterns

#: Candidates of one signature that make a suggestion, and how many of them are shown.
SUGGEST_LEAST, SUGGEST_SHOWN = 5, 10


def described_patterns(pairs: DataFrame, least: int = 2) -> DataFrame:
    """mined_patterns with ``change``, what happens in the example, in words, and ``rule_type``.  Signatures are made of
    six words, so there are few patterns, whatever the pairs."""
    example = pairs.select(F.col("id").alias("example_id"), character_change(F.upper(F.trim("a")), F.upper(F.trim("b"))).alias("change"))
    told = mined_patterns(pairs, least).join(example, "example_id")
    return told.withColumn("rule_type", change_class(F.col("change")))


def similar_unmatched(stores: DataFrame, suppliers: DataFrame, patterns: DataFrame) -> DataFrame:
    """(store_id, supplier_id, signature, confidence): pairs of the given (unmatched) store rows with supplier rows that
    show a pattern and that its change leads to.  A signature needs equal canonical numbers, so the pairs are joined by
    these and then meet the patterns by signature."""
    s = once(stores).select("project_id", F.col("id").alias("store_id"), F.col("line_code").alias("line"), F.upper(F.trim("part_number")).alias("a"), norm_canonical(F.col("part_number")).alias("key")).filter("key <> ''")
    u = once(suppliers).select("project_id", F.col("id").alias("supplier_id"), F.upper(F.trim("part_number")).alias("b"), norm_canonical(F.col("part_number")).alias("key"))
    p = F.broadcast(patterns.select("signature", "average", "change", F.col("line_code").alias("of_line")))
    met = s.join(u, ["project_id", "key"]).withColumn("signature", punctuation_signature(F.col("a"), F.col("b"))).join(p, "signature")
    made = apply_change(F.col("a"), F.col("change"))
    leads = (made == F.col("b")) | (made == F.col("key")) | (norm_stored(made) == norm_stored(F.col("b")))
    return met.filter((F.col("of_line").isNull() | (F.upper(F.trim("line")) == F.col("of_line"))) & leads).select("store_id", "supplier_id", "signature", F.col("average").alias("confidence"))


def bulk_suggestions(pairs: DataFrame, least: int = SUGGEST_LEAST) -> DataFrame:
    """(signature, affected, message, preview): for each signature that a confirmed pair shows, how many pending pairs
    show it too, if at least ``least``.  ``pairs`` has id, status, line, a and b."""
    told = pairs.withColumn("signature", punctuation_signature(F.col("a"), F.col("b"))).filter("signature is not null")
    pending, confirmed = F.col("status") == "PENDING", F.col("status") == "CONFIRMED"
    change = character_change(F.upper(F.trim("a")), F.upper(F.trim("b")))
    counted = told.filter(pending | confirmed).groupBy("signature").agg(
        F.count(F.when(pending, 1)).alias("affected"),
        F.min(F.when(confirmed, F.struct("id", change.alias("change"), "line"))).alias("approved"),
        F.min(F.when(pending, F.col("line"))).alias("lo"), F.max(F.when(pending, F.col("line"))).alias("hi"), F.count(F.when(pending, F.col("line"))).alias("lined"),
    )
    kept = counted.filter((F.col("affected") >= least) & F.col("approved").isNotNull())
    one_line = (F.col("lo") == F.col("hi")) & (F.col("lined") == F.col("affected")) & (F.col("lo") == F.col("approved.line"))
    message = F.concat(
        F.lit("We found "), F.col("affected").cast("string"), F.lit(' more items with the same pattern: "'), F.col("approved.change"), F.lit('"'),
        F.when(one_line, F.concat(F.lit(" for "), F.col("lo"), F.lit(" line"))).otherwise(F.lit("")), F.lit(". Would you like to approve all of them?"),
    )
    shown = first_ids(told.filter(pending).join(F.broadcast(kept.select("signature")), "signature"))
    return kept.select("signature", "affected", message.alias("message")).join(shown, "signature")


def first_ids(rows: DataFrame, n: int = SUGGEST_SHOWN) -> DataFrame:
    """(signature, preview): the first ``n`` ids of each signature, joined by blanks."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("signature").orderBy("id"))
    kept = rows.select("signature", "id").withColumn("_r", place).filter(F.col("_r") <= n)
    return kept.groupBy("signature").agg(F.array_join(F.array_sort(F.collect_list("id")), " ").alias("preview"))


def clustered_patterns(patterns: DataFrame) -> DataFrame:
    """(signature, cluster): patterns in order of size join the first cluster whose first pattern has their rule type, no
    other line code, and a quoted stretch of the change in common; ``cluster`` is the first pattern's signature.  One fold
    over the patterns, of which there are few."""
    quoted = F.regexp_extract_all(F.lower("change"), F.lit('"(.+?)"'), F.lit(1))
    rows = patterns.select(F.struct((-F.col("n")).alias("o"), "signature", "rule_type", F.col("line_code").alias("line"), quoted.alias("marks")).alias("p"))
    every = rows.agg(F.array_sort(F.collect_list("p")).alias("all"))
    start = F.array().cast("array<struct<signature:string,rule_type:string,line:string,marks:array<string>,cluster:string>>")

    def join(acc: Column, p: Column) -> Column:
        like = lambda q: (q["signature"] == q["cluster"]) & (q["rule_type"] == p["rule_type"]) & (q["line"].isNull() | p["line"].isNull() | (q["line"] == p["line"])) & F.arrays_overlap(q["marks"], p["marks"])
        home = F.get(F.filter(acc, like), F.lit(0))["signature"]
        one = F.struct(p["signature"].alias("signature"), p["rule_type"].alias("rule_type"), p["line"].alias("line"), p["marks"].alias("marks"), F.coalesce(home, p["signature"]).alias("cluster"))
        return F.concat(acc, F.array(one))

    return every.select(F.explode(F.aggregate("all", start, join)).alias("q")).select("q.signature", "q.cluster")


def pattern_rules(patterns: DataFrame, scope: str = "global") -> DataFrame:
    """Rules made of patterns: (rule_type, signature, transformation, scope, confidence, match_count)."""
    return patterns.select("rule_type", "signature", F.col("change").alias("transformation"), F.lit(scope).alias("scope"), F.col("average").alias("confidence"), F.col("n").alias("match_count"))
