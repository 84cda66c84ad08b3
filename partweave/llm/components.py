"""Groups of everything linked directly or indirectly (problem 3).

Method: random contraction.  In each round every vertex hooks to the neighbour (or itself) that comes first in a
hash order drawn afresh for the round; edges are relabelled by the hooks, loops and repeats fall away, and the
rounds go on until no edge is left.  The hooks of all rounds are then expanded backwards.  The expected number of
vertices falls by a constant factor each round whatever the shape of the graph, so long chains and large stars
take O(log n) rounds.  Nothing is collected: a round is one aggregation combined before the shuffle and two joins
whose hot vertices are joined by broadcast (at most 2 * HOT_SHARE rows, as degrees add up to twice the edges).  Once
no more than LAST_EDGES edges are left, whatever the size of the graph was, one task hooks what remains.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.operators.skew import hot_keys, join_unique
from partweave.session import Workspace


#: Rounds whose hooks are expanded in one job.
EXPANDED_AT_ONCE = 4
#: So few edges are hooked in one task instead of by rounds, each of which takes longer than they do.
LAST_EDGES = 10_000


def _last_hooks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, rep) of all vertices of a small graph given as edges (a, b)."""
    up: dict = {}

    def top(v):
        while up.setdefault(v, v) != v:
            up[v] = v = up[up[v]]
        return v

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(v) for v in nodes], kind)], names=["v", "rep"])


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def connected_components(edges: DataFrame, a: str, b: str, seed: int = 0) -> DataFrame:
    """(node, component): one row for each node of an edge; component is its group's smallest node.

    Edges may repeat and point either way.  An edge with a null end is no edge; a loop is an edge of one node,
    which is then a group of its own unless other edges join it.  No edges give no rows.
    """
    ws = Workspace(edges.sparkSession, "components")
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    current = ws.save(ends.select(*_pairs(F.col("x"), F.col("y"))).distinct(), "edges0")
    loops = current.filter("a = b").select(F.col("a").alias("node"))
    current = current.filter("a <> b")
    total = current.count()
    hooks: list[DataFrame] = []
    sizes: list[int] = []
    while total:
        r = len(hooks)
        if total <= LAST_EDGES:
            kind = dict(current.dtypes)["a"]
            hook, vertices = ws.save_counted(current.select("a", "b").repartition(1).mapInArrow(_last_hooks, f"v {kind}, rep {kind}"), f"hooks{r}")
            hooks.append(hook)
            sizes.append(vertices)
            break
        order = lambda v: F.struct(F.xxhash64(v, F.lit(seed + 7919 * (r + 1))).alias("h"), v.alias("v"))
        both = current.select(
            F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")
        ).select("e.v", "e.w")
        hook = (
            both.groupBy("v")
            .agg(F.min(order(F.col("w"))).alias("m"), F.count("*").alias("degree"))
            .select("v", F.least("m", order(F.col("v")))["v"].alias("rep"), "degree")
        )
        hook, vertices = ws.save_counted(hook, f"hooks{r}")
        hooks.append(hook.select("v", "rep"))
        sizes.append(vertices)
        hot = hot_keys(hook, "degree", total, "v")
        left = join_unique(
            current.withColumnRenamed("a", "v"), hook.select("v", "rep"), "v", hot, "inner"
        ).select(F.col("rep").alias("ra"), F.col("b").alias("v"))
        both_ends = join_unique(left, hook.select("v", "rep"), "v", hot, "inner").select("ra", F.col("rep").alias("rb"))
        following = both_ends.filter("ra <> rb").select(*_pairs(F.col("ra"), F.col("rb"))).distinct()
        current, total = ws.save_counted(following, f"edges{r + 1}")
        if r:
            ws.drop(f"edges{r}")
    if not hooks:
        return loops.select("node", F.col("node").alias("component"))
    roots = hooks[-1].select(F.col("v").alias("node"), F.col("rep").alias("root"))
    for r in range(len(hooks) - 2, -1, -1):
        here = hooks[r]
        shares = here.groupBy("rep").agg(F.count("*").alias("n"))
        later = roots.select(F.col("node").alias("rep"), "root")
        hot = hot_keys(shares, "n", sizes[r], "rep")
        roots = join_unique(here, later, "rep", hot, "left").select(
            F.col("v").alias("node"), F.coalesce("root", "rep").alias("root")
        )
        if r % EXPANDED_AT_ONCE == 0:
            roots = ws.save(roots, f"roots{r}")
    labels = ws.save(roots.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")), "labels")
    hot = hot_keys(labels, "n", sizes[0], "root")
    grouped = join_unique(roots, labels.select("root", "component"), "root", hot, "inner").select("node", "component")
    alone = loops.join(grouped.select("node"), "node", "left_anti")
    return grouped.unionByName(alone.select("node", F.col("node").alias("component")))


def clean_number(c: Column) -> Column:
    """Upper case, with everything but A-Z and 0-9 removed."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def number_links(interchanges: DataFrame, rules: DataFrame) -> DataFrame:
    """(a, b): the clean numbers of each link.  A link is an interchange, or an enabled POSITIVE_MAP rule, whose
    two values both hold a digit and have different clean numbers.  Nulls, remarks and blanks make no link."""
    stated = interchanges.select(F.col("merrill_part_number").alias("x"), F.col("vendor_part_number").alias("y"))
    learned = rules.filter(F.col("enabled") & (F.col("rule_type") == "POSITIVE_MAP")).select(
        F.col("store_part_number").alias("x"), F.col("supplier_part_number").alias("y")
    )
    both = stated.unionByName(learned).filter(F.col("x").rlike("[0-9]") & F.col("y").rlike("[0-9]"))
    return both.select(clean_number(F.col("x")).alias("a"), clean_number(F.col("y")).alias("b")).filter("a <> b")


def number_groups(interchanges: DataFrame, rules: DataFrame) -> DataFrame:
    """(group_norm, part_norm): every linked clean number and the smallest one it is linked with."""
    groups = connected_components(number_links(interchanges, rules), "a", "b")
    return groups.select(F.col("component").alias("group_norm"), F.col("node").alias("part_norm"))
