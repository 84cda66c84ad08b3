import random

import pytest

from partweave.llm import listings
from partweave.llm.linkage import candidate_pairs, fit, link, number_key, number_keys, read_rows, with_bearers, with_blocks
from partweave.llm.listings import find_gtins, product_groups, same_products, valid_gtin
from partweave.llm.makers import Makers
from partweave.llm.partspec import EMPTY, Reader, learned_noise

MAKERS = Makers(("brindle forge", "corvane", "dunmere & sons", "hexmarch"), {"ZVC": "brindle forge", "HLR": "corvane"}, {"DNF": "brindle forge", "FNQ": "corvane"})


@pytest.fixture(scope="module")
def reader():
    return Reader(MAKERS.names)


@pytest.mark.parametrize(
    ("text", "full"),
    [
        ("BRINDLE FORGE - ALTERNATOR - 100% NEW - 68MM PULLEY DIA, RATED OUTPUT 170 AMP", "brindle forge|alternator|new||170|68"),
        ("generator, ac; new unit; output=170A; pulley: 2.68&quot;; ** SALE **; Brindle Mfg *413*", "brindle forge|alternator|new||170|68"),
        ("Corvane, wire dia: 13mm free height: 440mm suspension coil sprnig std rate fits Tessaly C2 12-20 top value passenger side front", "corvane|coil spring|linear|right front|440|13"),
        ("hexmarch_brake_disc_R/_solid_thk=0.39\"_OD_12.60in.", "hexmarch|brake rotor|solid|rear|320|10"),
        ("DUNMERE; engine coolant; concentrate; 1.06 qt size; 7 yr life REPL 3909F1732", "dunmere & sons|coolant|concentrate||1000|84"),
        ("T 14, PMGR, starer, Corvane, 6.17 lb wt", "corvane|starter|gear reduction||14|2800"),
        ("Corvane coolant hose upr bore 1.97 in 16.06 inch long", "corvane|hose|upper||408|50"),
        ("Corvane lambda sensor heated wires 4 cable length 86cm req. 3028P6700", "corvane|oxygen sensor|heated||860|4"),
    ],
)
def test_specifications(reader, text, full):
    assert reader.read(text).full_text() == full


def test_silence(reader):
    assert reader.read(None) == EMPTY == reader.read("") == reader.read("¿?")
    spec = reader.read("SHOCK SHOCKS FRT LH")
    assert (spec.kind, spec.position, spec.maker, spec.first) == ("shock", "left front", None, None) and spec.full_text() is None
    assert reader.read("x" * 300_000) == EMPTY
    assert Reader([]).read("disc rotor").kind == "brake rotor"


def test_kinds_that_no_list_has(reader):
    full = lambda text: reader.read(text).full_text()
    pump = full("Corvane fuel pump aluminum impeller 40mm shaft 12mm")
    assert pump != full("Corvane water pump aluminum impeller 40mm shaft 12mm") and reader.read("Corvane oil pump").kind == "oil pump"
    assert pump == full("PUMP, FUEL, CORVANE, shaft 0.47 in, impeller: 4.0 cm, aluminum") != full("Corvane fuel pump cast iron impeller 40mm shaft 12mm")
    plug = full("spark plug iridium 14mm thread 19mm reach corvane")
    assert plug == full("CORVANE Reach 0.75in; iridium spark plug; thread: 14 mm") is not None
    assert plug != full("spark plug iridium 19mm thread 14mm reach corvane") and plug != full("spark plug copper 14mm thread 19mm reach corvane")
    assert full("spark plug iridium 14mm thread 19mm reach") is None and full("corvane spark plug 14mm thread") is None
    assert reader.read("fuel injector 12mm 4 holes").kind is None and reader.read("Corvane water pump").kind == "water pump"


def test_slogans_are_learned(spark):
    parts = ["water pump", "hose", "ball joint", "hub", "alternator", "belt", "starter"]
    rows = [(f"{p}, Corvane, {x} {i} mm",) for i, p in enumerate(parts * 3) for x in ("simply the finest", "new finish")] + [("alternator, new build, sealed in oil",)] * 9 + [(None,), ("",)]
    got = learned_noise(spark.createDataFrame(rows, "description string"), ["corvane"])
    assert {"simply the finest", "new finish"} <= set(got) and not {"new build", "sealed", "corvane", "oil"} & set(got)
    assert Reader(["corvane"], got).read("alternator new finish reman corvane").build == "remanufactured"
    assert learned_noise(spark.createDataFrame([], "description string"), []) == []


def test_words_are_remembered_up_to_a_bound(reader):
    for i in range(300):
        reader.read(" ".join(f"zz{''.join(chr(97 + int(d)) for d in str(i * 1000 + k))}" for k in range(400)))
    assert len(reader.fine) + len(reader.mended) <= 100_001


def test_references(reader):
    assert reader.read("TIE ROD END REPL 0463Z-1468 use w/ A17332440").replaces == ["0463Z1468"]
    assert reader.read("clamp (mfr no. 2569\xa003020").replaces == ["256903020"]
    assert reader.read("oil filter sold with 0878P0696").replaces == []


def test_number_keys():
    key = lambda n, c=None: number_key(n, c, MAKERS)
    assert {key(n) for n in ("16.338.614", "#16338-614", "P/N 16338614", "16338614A", "16338614-R", " 163 38614 RB", "163386l4".replace("l", "I"), "016338614", "DNF-16338614")} == {"16338614"}
    assert key("HLRHL5204F5993", "HLR") == "HL5204F5993" and key("SO12345") == key("5O12345")
    assert number_keys("DNF-16338614-R", None, MAKERS) == ["16338614", "DNF16338614", "16338614R", "DNF16338614R"]
    assert key(None) is key("") is key("--") is key("ABCDE") is key("12") is None


def test_gtin():
    assert valid_gtin("4006381333931") and not valid_gtin("4006381333932") and valid_gtin("96385074") and not valid_gtin("12")
    assert find_gtins("part 4006381333931 new") == ["04006381333931"] and find_gtins("EAN: 96385074") == ["00000096385074"]
    assert find_gtins("96385074") == find_gtins(None) == find_gtins("4006381333932") == []
    assert find_gtins("4006381333931, UPC 036000291452 or 4006381333931") == ["04006381333931", "00036000291452"]


S = "id string, project_id string, part_number string, line_code string, description string, blocks string, spec string"
M = "client_line_code string, manufacturer_name string, arnold_line_code string"
FULL = "Corvane water pump aluminum impeller 88 mm shaft 22 mm"
SAME = "fits Lindenau T6 11-13 CORVANE Mfg; pump, water; alum body; 3.46\" impeller dia; shaft dia=0.87 in"


def frames(spark, stores, suppliers):
    make = lambda rows: spark.createDataFrame([(*r, "clash", "clash") for r in rows], S)
    maps = spark.createDataFrame([("ZVC", "Brindle Forge", "DNF"), ("hlr", "CORVANE", "FNQ"), (None, "Hexmarch", None), ("XX", None, "YY")], M)
    return make(stores), make(suppliers), maps


def test_pairs_of_listings(spark):
    stores = [("s1", "p", "1", None, FULL), ("s1", "p", "1", None, FULL), ("s2", "q", "1", None, FULL), ("s3", "p", "1", None, None), ("s4", "p", "1", None, ""), ("s5", None, "1", None, FULL)]
    suppliers = [("u1", "p", "2", None, SAME), ("u2", "p", "2", None, FULL.replace("88", "90")), ("u3", "p", "2", None, "Corvane water pump"), ("u4", "p", "2", None, SAME)]
    got = {tuple(r) for r in same_products(*frames(spark, stores, suppliers)).collect()}
    assert got == {("s1", "u1"), ("s1", "u4"), ("u1", "u4")}
    assert same_products(*frames(spark, [], [])).count() == 0


def test_pairs_follow_the_groups(spark, monkeypatch):
    """The groups alone decide which stated listings are pairs."""
    rows = [("a", "p", "x", "g1"), ("b", "p", "x", "g1"), ("c", "p", "x", "g2"), ("d", "p", "y", "g1"), ("e", "p", None, "g1")]
    found = spark.createDataFrame(rows, "listing_id string, project_id string, spec string, group string")
    monkeypatch.setattr(listings, "grouped_listings", lambda *_: found)
    assert {tuple(r) for r in same_products(found, found, found).collect()} == {("a", "b"), ("a", "d"), ("b", "d")}


def test_groups_of_listings(spark):
    stores = [("s1", "p", "HLR 3546F8404", "HLR", "water pump"), ("s2", "p", "X", None, None), ("s3", "p", "77", None, FULL.replace("Corvane", "Hexmarch"))]
    suppliers = [("u1", "p", "3546F-8404", "FNQ", SAME), ("u2", "p", "9", "FNQ", FULL), ("u3", "p", "3546F8404", "FNQ", FULL.replace("88", "90"))]
    got = {r.listing_id: r.group_id for r in product_groups(*frames(spark, stores, suppliers)).collect()}
    # u1 and u3 share a number and contradict one another, so their component is broken up and s1, which could be either, stands alone
    assert got == {"s1": "s1", "s2": "s2", "s3": "s3", "u1": "u1", "u2": "u1", "u3": "u3"}


def test_a_member_that_fits_one_side_stays(spark):
    stores = [("s1", "p", "3546F8404", "HLR", "water pump cast iron"), ("s2", "p", "3546F8404", "HLR", "pump"), ("s3", "p", "5", None, "part EAN 4006381333931"), ("s4", "p", "6", None, "UPC 4006381333931")]
    suppliers = [("u1", "p", "3546F-8404", "FNQ", FULL), ("u2", "p", "3546F8404", "FNQ", FULL.replace("aluminum", "cast iron"))]
    got = {r.listing_id: r.group_id for r in product_groups(*frames(spark, stores, suppliers)).collect()}
    assert got == {"s1": "s1", "u2": "s1", "u1": "u1", "s2": "s2", "s3": "s3", "s4": "s3"}


def test_hot_classes_and_blocks_are_the_same(spark):
    """One product holds a third of the listings."""
    text = lambda i: FULL if i % 3 == 0 else FULL.replace("88", str(100 + i % 20))
    stores = [(f"s{i}", "p", "77-1234", "HLR", text(i)) for i in range(60)]
    suppliers = [(f"u{i}", "p", f"{5000 + i}", "FNQ", text(i)) for i in range(60)]
    tables = frames(spark, stores, suppliers)
    plain, hot = (sorted(map(tuple, same_products(*tables, hot_least=n).collect())) for n in (100_000, 5))
    assert plain == hot and len(plain) > 40 * 39 // 2
    a, b = read_rows(tables[0], MAKERS, False), read_rows(tables[1], MAKERS, True)
    a = with_blocks(with_bearers(a, a.select("project_id", "number", "maker", "kind")))
    plain, hot = (sorted(map(tuple, candidate_pairs(a, with_blocks(b), n).collect())) for n in (100_000, 5))
    assert plain == hot and len(plain) == len({p[:2] for p in plain}) >= 400


def world(rng, n):
    stores, suppliers, truth = [], [], set()
    for i in range(n):
        maker, code, other = rng.choice([("Corvane", "HLR", "FNQ"), ("Brindle Forge", "ZVC", "DNF")])
        number, a, b = f"{rng.randrange(10**7, 10**8)}", rng.randrange(50, 999), rng.randrange(12, 300)
        text = f"{maker} water pump aluminum impeller {a} mm shaft {b} mm"
        stores.append((f"s{i}", "p", f"{number[:4]}-{number[4:]}", code, rng.choice([text, text, None, "WATER PUMP"])))
        suppliers.append((f"u{i}", "p", number, other, rng.choice([text.upper(), text, "PUMP, WATER"])))
        truth.add((f"s{i}", f"u{i}"))
    return stores, suppliers, truth


def test_linkage_finds_the_same_parts(spark):
    stores, suppliers, truth = world(random.Random(3), 150)
    stores += [("c1", "p", "5555-4444", None, "exhaust clamp"), ("n1", None, "1", None, None), ("e1", "p", None, None, None), ("r1", "p", "7777-1111", "HLR", "Corvane " + FULL[8:])]
    suppliers += [("c2", "p", "55554444", "DNF", "hub assy"), ("c3", "p", "55554444", "FNQ", "Corvane oil filter"), ("r2", "p", "BV.1", "FNQ", "water pump REPL 7777-1111"), ("r2", "p", "BV.1", "FNQ", "water pump REPL 7777-1111")]
    rows = link(*frames(spark, stores + stores[:20], suppliers)).collect()
    got = {(r.store_item_id, r.supplier_item_id) for r in rows}
    assert len(rows) == len(got) and all(0.5 <= r.confidence <= 1 for r in rows)
    assert truth <= got and ("r1", "r2") in got
    assert not any(a == "c1" or a == "e1" for a, _ in got)
    assert len(got - truth - {("r1", "r2")}) <= 2  # equal specifications by chance


def test_linkage_of_empty_tables(spark):
    assert link(*frames(spark, [], [])).count() == 0
    assert link(*frames(spark, [("s", "p", "12345", None, None)], [])).count() == 0


def test_posteriors_order_the_patterns():
    p = fit({"1111111": 500, "1110000": 300, "1222222": 60, "4111222": 80, "1000000": 20})
    assert p["1111111"] > 0.99 > 0.01 > p["1222222"] and p["1110000"] > p["1000000"]
    assert fit({}) == {}
