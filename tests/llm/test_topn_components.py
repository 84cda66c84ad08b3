import random

from hypothesis import given, settings
from hypothesis import strategies as st

from partweave.llm.components import connected_components, number_groups
from partweave.llm.topn import best_candidates

ROW = "id string, store_item_id string, confidence double, method string, updated_at int, _rank string, rank int, _newest string"


def best(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 0, "clash") for r in rows], ROW)
    return {(r.store_item_id, r["rank"]): r.match_candidate_id for r in best_candidates(df).collect()}


def test_order_versions_and_unusable_rows(spark):
    rows = [
        ("c1", "s", 0.9, "FUZZY", 1), ("c2", "s", 0.9, " exact_norm ", 1), ("c3", "s", 0.9, None, 1), ("c4", "s", 0.9, "odd", 1), ("c5", "s", 1.5, "AI", 1), ("c6", "s", float("nan"), "AI", 1),
        ("c7", "s", None, "AI", 1), ("c8", "s", -0.1, "AI", 1), ("c9", "s", 1.0, "AI", 1), ("c9", "s", 0.1, "AI", 2), ("c9", "s", 0.95, "AI", 0), ("d1", "t", 0.0, None, None), (None, "t", 1.0, "AI", 1),
        ("d2", None, 1.0, "AI", 1), ("d1", "t", 0.0, None, None), ("d3", "u", 0.5, "AI", None), ("d3", "u", 0.4, "AI", 5),
    ]
    assert best(spark, rows) == {("s", 1): "c2", ("s", 2): "c1", ("s", 3): "c3", ("t", 1): "d1", ("u", 1): "d3"}


def test_hot_group_and_empty_table(spark):
    rows = [(f"c{i:05d}", "hot", (i % 7) / 7, "AI", 1) for i in range(3000)]
    assert best(spark, rows) == {("hot", 1): "c00006", ("hot", 2): "c00013", ("hot", 3): "c00020"}
    assert best(spark, []) == {}


def union_find(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {(v, root(v)) for v in up}


def components(spark, edges):
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in edges], "p string, q string, v string, rep string")
    return {(r.node, r.component) for r in connected_components(df, "p", "q").collect()}


def test_components_of_chains_stars_and_oddities(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [("hub", f"s{i:03d}") for i in range(80)]
    odd = [("l", "l"), ("a", "b"), ("b", "a"), ("a", "b"), (None, "z"), ("z2", None)]
    edges = chain + star + odd
    assert components(spark, edges) == union_find(edges)
    assert components(spark, [("l", "l")]) == {("l", "l")}
    assert components(spark, []) == set()


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40), st.integers(0, 9))
@settings(max_examples=4, deadline=None)
def test_components_equal_union_find(spark, pairs, seed):
    edges = [(f"v{a}", f"v{b}") for a, b in pairs]
    assert components(spark, edges) == union_find(edges)


def test_hot_vertices_take_the_broadcast_way(spark, monkeypatch):
    from partweave.operators import skew

    monkeypatch.setattr(skew, "HOT_LEAST", 1)
    monkeypatch.setattr(skew.hot_threshold, "__defaults__", (10, 1))
    rng = random.Random(2)
    edges = [("hub", f"v{i}") for i in range(40)] + [(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range(30)]
    assert components(spark, edges) == union_find(edges)


def test_number_groups(spark):
    inter = spark.createDataFrame([("a-1", "B 2"), ("B2", "c3"), ("N/A", "Z9"), (None, "Z9"), ("x5", "X-5")], "merrill_part_number string, vendor_part_number string")
    rules = spark.createDataFrame(
        [("POSITIVE_MAP", True, "D4", "C3"), ("POSITIVE_MAP", False, "E5", "C3"), ("NEGATIVE_BLOCK", True, "F6", "C3"), ("POSITIVE_MAP", None, "G7", "C3")],
        "rule_type string, enabled boolean, store_part_number string, supplier_part_number string",
    )
    got = {(r.group_norm, r.part_norm) for r in number_groups(inter, rules).collect()}
    assert got == {("A1", x) for x in ("A1", "B2", "C3", "D4")}
