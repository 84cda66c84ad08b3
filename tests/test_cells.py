"""Pairs found and scored in cells, against the plain rule, and what finding them moves."""

import random
import re

import pyarrow.parquet as pq

from partweave.operators import cells
from partweave.operators.matching import common_run_scores, ranked_candidates
from partweave.plans import catalog
from parity import assert_same
from test_held import ITEM, folder, rows_shuffled

NUMBERS = [None, "", "A", "AB", "0", "00A", "00ab", "abc", "ABCABC", "AAAAAA", "AAAA-AAAA", "x12-345", "12345Y", "ßABC", "SSABC", "ABC-DEF 1", "BCDEF", "1", "12", "é12", "Q" * 300 + "ABCD", "Q" * 299 + "ABCD", "ZZZ9", "  -"]


def score_key(n):
    return re.sub("[^A-Za-z0-9]", "", n or "").upper()


def stored(n):
    return re.sub("[^A-Z0-9]", "", (n or "").upper())


def run_score(a, b):
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    if short in long:
        return len(short) / len(long)
    return max((k for k in range(3, len(short) + 1) if any(short[i : i + k] in long for i in range(len(short) - k + 1))), default=0) / len(long)


def runs(n):
    return {n[i : i + 3] for i in range(len(n) - 2)}


def rows(side):
    return [(f"{side}{p}{i:02d}", p, n, None, None, None, NUMBERS[(i * 7 + 3) % len(NUMBERS)], None) for p in ("p", "q") for i, n in enumerate(NUMBERS) if side == "s" or p == "p" or i % 3]


def common(stores, suppliers):
    want = {}
    for s in stores:
        for u in suppliers:
            key = lambda n: score_key(n).lstrip("0")
            if s[1] == u[1] and (key(s[2]) == key(u[2]) != "" or runs(score_key(s[2])) & (runs(score_key(u[2])) | runs(score_key(u[6])))):
                want[s[0], u[0]] = round(run_score(stored(s[2]), stored(u[6])), 9)
    return want


def test_common_runs_equal_the_rule_in_cells_of_any_size(spark, monkeypatch):
    stores, suppliers = rows("s"), rows("u")
    a, b = (spark.createDataFrame(x + x[:5], ITEM) for x in (stores, suppliers))
    want = common(stores, suppliers)
    for sizes in ((), (5, 4)):
        got = [((r.store_id, r.supplier_id), round(r.score, 9)) for r in common_run_scores(a, b, *sizes).collect()]
        assert len(got) == len(want) and dict(got) == want
    monkeypatch.setattr(cells, "MARKS", 7)
    monkeypatch.setattr(cells, "AT_ONCE", 60)
    pa = cells.pa
    table = lambda x: pa.table({"id": [r[0] for r in x], "key": [score_key(r[2]).lstrip("0") for r in x], "number": [score_key(r[2]) for r in x], "mfr": [score_key(r[6]) for r in x], "stored": [stored(r[2]) for r in x], "stored_mfr": [stored(r[6]) for r in x]})
    got = [r for part in cells.common_run_pairs(*(table([r for r in x if r[1] == "p"]) for x in (stores, suppliers))) for r in part.to_pylist()]
    assert {(r["store_id"], r["supplier_id"]): round(r["score"], 9) for r in got} == {k: v for k, v in want.items() if k[0][1] == "p"}
    assert len(got) == len({(r["store_id"], r["supplier_id"]) for r in got})


def test_common_runs_move_rows_not_runs(spark, tmp_path):
    stores, suppliers = ([(f"{side}{i:03d}", "p", f"ABCDEF{i * 7919:08d}", None, None, None, f"ABCDEF{i * 104729:09d}", None) for i in range(300)] for side in "su")
    at = folder(spark, tmp_path, stores, suppliers)
    got = []
    moved = rows_shuffled(spark, lambda: got.extend(catalog.queries()["common_runs"](spark, at).collect()))
    assert len(got) == len({(r.store_id, r.supplier_id) for r in got}) == 300 * 300
    assert moved < 3_000, moved  # a row was shuffled once for each of its runs before


TEXTS = [None, "", "brake pad", "brake disc front", "front disc brake brake", "Brake  BRAKE ring", "front axle disc brake ring gear", "ring gear ring gear", "hose", "front front", "axle gear brake hose disc"]


def write_odd(tmp_path):
    """Tables of numbers, line codes and words of all kinds, many of them in common."""
    pick = random.Random(4)
    plain = [n for n in NUMBERS if n is None or n.isascii()]
    for name, side, count in (("store_items", "s", 60), ("supplier_items", "u", 90)):
        rows = [(f"{side}{i:02d}", pick.choice("ppq"), pick.choice(plain), pick.choice([None, "", "LN", "ln", "XX"]) if i % 3 else None, pick.choice(TEXTS), None, pick.choice(plain), None) for i in range(count)]
        columns = zip([c.split()[0] for c in ITEM.split(", ")], zip(*rows + rows[:4]))
        kinds = lambda c: cells.pa.decimal128(10, 2) if c == "current_cost" else cells.pa.string()
        pq.write_table(cells.pa.table({c: cells.pa.array(v, kinds(c)) for c, v in columns}), f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_ranked_candidates_equal_the_sql_over_odd_rows(spark, tmp_path):
    assert_same(catalog.queries()["ranked_candidates"], catalog.oracle_sql()["ranked_candidates"], spark, write_odd(tmp_path))  # numbers counted where no run was shared before


def test_ranked_candidates_are_the_same_in_cells_of_any_size(spark, tmp_path):
    at = write_odd(tmp_path)
    two = [spark.read.parquet(f"{at}/{name}.parquet") for name in ("store_items", "supplier_items")]
    for most, fill_to in ((50, 180), (3, 2), (12, 10)):
        one, more = (sorted(map(tuple, ranked_candidates(*two, most, fill_to, *sizes).collect())) for sizes in ((), (7, 6)))
        assert one == more and len(one) > 60


def test_ranked_candidates_move_rows_not_pairs(spark, tmp_path):
    stores, suppliers = ([(f"{side}{i:03d}", "p", f"ABCDEF{i * 7919:08d}", None, "brake disc front axle", None, f"ABCDEF{i * 104729:09d}", None) for i in range(150)] for side in "su")
    at = folder(spark, tmp_path, stores, suppliers)
    got = []
    moved = rows_shuffled(spark, lambda: got.extend(catalog.queries()["ranked_candidates"](spark, at).collect()))
    assert sorted((r.store_id, r["rank"]) for r in got) == [(s[0], rank) for s in stores for rank in range(1, 51)]
    assert moved < 3_000, moved  # each of the pairs was shuffled before


def test_scores_are_rounded_halves_up():
    x = cells.np.array([0.1234567885, 0.1234567875, 1 / 3, 2 / 3, 0.0009765625, 1.65])
    assert cells.billionths(x).tolist() == [123456789, 123456788, 333333333, 666666667, 976563, 1650000000]
