"""Candidates against the plain rule, pair by pair."""

import re
from decimal import Decimal

from partweave.operators.matching import additive_best, alike_pairs, exact_pairs, tiered_candidates
from partweave.plans import catalog

ITEM = "id string, project_id string, part_number string, line_code string, description string, canonical_part_number string, mfr_part_number string, current_cost decimal(10,2)"


def items(spark, rows):
    """Rows (id, number, line, description, cost) of one project."""
    return spark.createDataFrame([(i, "p", n, line, text, None, None, cost) for i, n, line, text, cost in rows], ITEM)


def trigrams(text):
    return {f"  {w} "[i : i + 3] for w in re.split("[^a-z0-9]+", (text or "").lower()) if w for i in range(len(w) + 1)}


def alike(a, b):
    x, y = trigrams(a), trigrams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def test_third_tier_takes_words_of_any_kind_anywhere(spark):
    stores = items(spark, [("s1", "QQ1", None, "brake pad, front axle", None), ("s2", "WW2", None, "with hub 4mm", None), ("s3", "EE3", None, None, None)])
    suppliers = items(
        spark,
        [
            ("u1", "111", None, "one two three four five FRONT-axle (Brakes)", None),
            ("u2", "222", None, "a disc for the handbrake", None),
            ("u3", "333", None, "axles", None),
            ("u4", "444", None, "bra ke, pad", None),
            ("u5", "555", None, "hub without ring", None),
        ],
    )
    got = {(r.store_id, r.supplier_id): (r.tier, r.similarity, r["rank"]) for r in tiered_candidates(stores, suppliers).collect()}
    assert got == {("s1", "u1"): (3, 3.0, 1), ("s1", "u2"): (3, 1.0, 2), ("s1", "u3"): (3, 1.0, 3), ("s2", "u5"): (3, 1.0, 1)}


def test_tiers_equal_the_rule_over_the_tables(spark, data):
    a = {r.id: r for r in spark.read.parquet(f"{data}/store_items.parquet").collect()}
    b = {r.id: r for r in spark.read.parquet(f"{data}/supplier_items.parquet").collect()}
    want = set()
    for s in a.values():
        words = {w for w in [w for w in re.split(r"\s+", re.sub(r"[^A-Z0-9\s]", " ", (s.description or "").upper())) if len(w) > 3][:3]}
        tiers = {1: [], 2: [], 3: []}
        for u in b.values():
            if u.project_id == s.project_id:
                near, held = alike(s.part_number, u.part_number), sum(w in (u.description or "").upper() for w in words)
                if near >= 0.3 and s.line_code and u.line_code and s.line_code.upper() == u.line_code.upper():
                    tiers[1].append((-near, u.id))
                elif near >= 0.4:
                    tiers[2].append((-near, u.id))
                if held:
                    tiers[3].append((-held, u.id))
        tier = next((t for t in (1, 2, 3) if tiers[t]), None)
        want |= {(s.id, u, tier, rank) for rank, (_, u) in enumerate(sorted(tiers.get(tier, []))[:20], 1)}
    got = tiered_candidates(spark.read.parquet(f"{data}/store_items.parquet"), spark.read.parquet(f"{data}/supplier_items.parquet"))
    assert {(r.store_id, r.supplier_id, r.tier, r["rank"]) for r in got.collect()} == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def additive(s, u):
    x, y, score = (s.part_number or "").upper(), (u.part_number or "").upper(), 0.0
    if s.line_code and u.line_code and s.line_code.upper() == u.line_code.upper():
        score += 100
    if x and y:
        score += 50 * (x in y or y in x) + 40 * (1 - distance(x, y) / max(len(x), len(y)))
    words = lambda t: {w for w in re.split("[ \\t\\n\\x0b\\f\\r]+", (t or "").lower()) if len(w) > 3}
    score += 5 * len(words(s.description) & words(u.description))
    if s.current_cost is not None and u.current_cost is not None:
        gap = abs(float(s.current_cost) - float(u.current_cost))
        score += 20 if gap < 5 else 10 if gap < 20 else 0
    return score


def test_additive_scores_reach_every_supplier_row(spark):
    stores = items(spark, [("s1", "AB12", "LN", "brake pad", Decimal(9)), ("s2", None, None, None, Decimal(500))])
    suppliers = items(spark, [("u1", "AB123", None, None, None), ("u2", "ZZZZ", "ln", None, None), ("u3", "QQQQ", None, "BRAKE disc", Decimal(11)), ("u4", "", None, None, Decimal(501)), ("u5", "YYYY", None, None, None)])
    got = {(r.store_id, r.supplier_id, round(r.score, 6), r["rank"]) for r in additive_best(stores, suppliers).collect()}
    assert got == {("s1", "u2", 100.0, 1), ("s1", "u1", 82.0, 2), ("s1", "u3", 25.0, 3), ("s2", "u4", 20.0, 1)}


def test_additive_scores_equal_the_rule_over_the_tables(spark, data):
    paths = [f"{data}/store_items.parquet", f"{data}/supplier_items.parquet"]
    a, b = ({r.id: r for r in spark.read.parquet(p).collect()}.values() for p in paths)
    b, want = list(b), {}
    for s in a:
        scores = sorted((-round(additive(s, u), 6), u.id) for u in b if u.project_id == s.project_id)
        want |= {(s.id, rank): (-lack, u) for rank, (lack, u) in enumerate([p for p in scores if p[0] <= -10][:20], 1)}
    got = additive_best(*map(spark.read.parquet, paths), stores_a_block=30, suppliers_a_part=40).filter("rank <= 20").collect()
    assert {(r.store_id, r["rank"]): round(r.score, 6) for r in got} == {k: score for k, (score, _) in want.items()}


def test_alike_pairs_equal_the_rule_over_the_tables(spark, data):
    a, b = (spark.read.parquet(f"{data}/{side}_items.parquet") for side in ("store", "supplier"))
    rows_a, rows_b = a.collect(), b.collect()
    plain = lambda n: re.sub("[^A-Z0-9]", "", (n or "").upper())
    runs = lambda n: {plain(n)[i : i + 3] for i in range(len(plain(n)) - 2)}
    equal = lambda n, o: plain(n).lstrip("0") == plain(o).lstrip("0") != ""
    want = {
        (s.id, u.id)
        for s in rows_a
        for u in rows_b
        if s.project_id == u.project_id and (equal(s.part_number, u.part_number) or runs(s.part_number) & (runs(u.part_number) | runs(u.mfr_part_number)))
    }
    got = [tuple(r) for r in alike_pairs(a, b).select("store_id", "supplier_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert want > {tuple(r) for r in exact_pairs(a, b).select("store_id", "supplier_id").collect()}


def test_scores_come_for_unequal_numbers(spark, data):
    for name, score in (("common_runs", "score"), ("windowed_scores", "score"), ("match_scores", "number_score"), ("weighted_scores", "score")):
        assert catalog.queries()[name](spark, data).filter(f"{score} > 0 and {score} < 0.8").limit(1).count() == 1, name
