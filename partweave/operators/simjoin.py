"""Similarity joins that do not compare all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partweave.functions.similarity import cosine, trigrams
from partweave.operators.skew import HOT_LEAST, split_join
from partweave.session import Workspace


def _codes(text: Column) -> Column:
    """The trigrams of a text as numbers, one to one: they hold a-z, 0-9 and blanks only."""
    code = lambda g, i: F.ascii(F.substring(g, i, 1))
    return F.transform(trigrams(text), lambda g: code(g, 1) * 65536 + code(g, 2) * 256 + code(g, 3))


def trigram_join(left: DataFrame, right: DataFrame, scope: str, id_left: str, id_right: str, text_left: Column, text_right: Column, least: float, hot_least: int = HOT_LEAST) -> DataFrame:
    """(scope, id_left, id_right, similarity): pairs of one scope whose texts have a trigram similarity of ``least``
    or more (``least`` > 0).

    Prefix filter: with each text's trigrams in a fixed order, rarest first, two texts that are similar enough share
    one among the first n - ceil(least * n) + 1 of each.  Only those are joined, pairs of too different sizes are
    dropped, and the rest is verified on the whole sets; no pair is lost.  A pair counts only where it meets in the
    first trigram it shares, so it comes once without another shuffle; as all others lie behind it on either side, a pair
that meets too late is dropped before its sets are compared.  A trigram that is frequent even among the rare
    ones is cut into cells (split_join)."""
    a = left.select(F.col(scope).alias("scope"), F.col(id_left).alias("a"), _codes(text_left).alias("x")).filter(F.size("x") > 0)
    b = right.select(F.col(scope).alias("scope"), F.col(id_right).alias("b"), _codes(text_right).alias("y")).filter(F.size("y") > 0)
    counts = (
        a.select("scope", F.explode("x").alias("g")).unionAll(b.select("scope", F.explode("y").alias("g"))).groupBy("scope", "g").agg(F.count("*").alias("n"))
    )

    def prefixes(side: DataFrame, key: str, grams: str, at: str) -> DataFrame:
        each = side.select("scope", key, F.explode(grams).alias("g")).join(counts, ["scope", "g"])
        order = each.groupBy("scope", key).agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("o"))
        n = F.size("o")
        first = F.slice("o", F.lit(1), n - F.ceil(n * F.lit(least) - 1e-9).cast("int") + 1)
        return order.select("scope", key, F.transform("o", lambda s: s["g"]).alias(grams), F.posexplode(F.transform(first, lambda s: s["g"])).alias(at, "g"))

    ws = Workspace(left.sparkSession, "trigrams")
    met = split_join(ws.save(prefixes(a, "a", "x", "i"), "left"), ws.save(prefixes(b, "b", "y", "j"), "right"), ["scope", "g"], "a", "b", hot_least)
    sizes = F.least(F.size("x"), F.size("y")) >= F.lit(least) * F.greatest(F.size("x"), F.size("y"))
    reach = F.least(F.size("x") - F.col("i"), F.size("y") - F.col("j")) * F.lit(1 + least) >= F.lit(least) * (F.size("x") + F.size("y")) - 1e-9
    shared = met.filter(sizes & reach).withColumn("z", F.array_intersect("x", "y"))
    first_meeting = shared.filter(F.get("z", F.lit(0)) == F.col("g"))
    n = F.size("z")
    similarity = (n / (F.size("x") + F.size("y") - n)).alias("similarity")
    scored = first_meeting.select(F.col("scope").alias(scope), F.col("a").alias(id_left), F.col("b").alias(id_right), similarity)
    return scored.filter(F.col("similarity") >= least)


def vector_topk(queries: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, k: int, least: float, blocks: int = 16, most: int = 20_000) -> DataFrame:
    """(query_id, target_id, similarity, rank): for each query vector its ``k`` nearest of ``vectors`` by cosine, at
    least ``least``; ties by target id.  Exact.

    The stated query set is held against all vectors.  Up to ``most`` queries (some megabytes) are broadcast; beyond,
    queries are cut into blocks and every vector meets each block, so no task holds more than a block of queries.
    Each task keeps its best k a query before the shuffle (the window's group limit)."""
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("q"))
    v = vectors.select(F.col(id_col).alias("target_id"), F.col(vector_col).alias("v"))
    n = q.limit(most + 1).count()
    if n <= most:
        pairs = v.crossJoin(F.broadcast(q))
    else:
        q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        v = v.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        pairs = v.join(q, "block")
    scored = pairs.select("query_id", "target_id", cosine(F.col("q"), F.col("v")).alias("similarity")).filter(F.col("similarity") >= least)
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("target_id"))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
