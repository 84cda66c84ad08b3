import pytest

from partweave.llm.makers import Makers
from partweave.llm.pii import find_pii, label_model, redact, settle, train_classifier
from partweave.llm.piispans import KINDS, Labelers

MAKERS = Makers(("brindle forge", "elmstead drive"), {}, {})
GIVEN, FAMILY = ["orla", "felix", "greta"], ["yarborn", "oakhallow", "zellinger"]


@pytest.fixture(scope="module")
def labelers():
    return Labelers(GIVEN, FAMILY, MAKERS.names)


def likely(labelers, text):
    """Candidates with more votes for than against, by kind."""
    out = set()
    for c in labelers.candidates(text):
        if c.votes.count("+") > c.votes.count("-"):
            out.add((KINDS[c.kind], text[c.start : c.end]))
    return out


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Mail: orla_y@mail.saltmarsh.test.", ("email", "orla_y@mail.saltmarsh.test")),
        ("use returns [at] quarry-auto [dot] example now", ("email", "returns [at] quarry-auto [dot] example")),
        ("Reach me at owen.p [at] mail [dot] saltmarsh [dot] test or", ("email", "owen.p [at] mail [dot] saltmarsh [dot] test")),
        ("write to jo at tarnvale dot example please", ("email", "jo at tarnvale dot example")),
        ("call (350) 555-0124 x17.", ("phone", "(350) 555-0124 x17")),
        ("fax 2745550180 today", ("phone", "2745550180")),
        ("tél. +33 1 99 00 16 39.", ("phone", "+33 1 99 00 16 39")),
        ("Tel. 030/23125855.", ("phone", "030/23125855")),
        ("SSN: 962-20-5726, picked up", ("id_number", "962-20-5726")),
        ("passport no. GV3407556 was copied", ("id_number", "GV3407556")),
        ("home 4554 N Quarry Bank St, Ste. 25", ("address", "4554 N Quarry Bank St")),
        ("Lieferung an Lindenhofgasse 3, z. Hd.", ("address", "Lindenhofgasse 3")),
        ("Livrer au 83 rue des Tilleuls, demander", ("address", "83 rue des Tilleuls")),
        ("Enviar a Calle Tres Olmos 55, bajo", ("address", "Calle Tres Olmos 55")),
        ("Customer Tonna O'Tesley, call 350-555-0124", ("name", "Tonna O'Tesley")),
        ("Ms. Jastrowe left a number", ("name", "Jastrowe")),
        ("Best,\nZellinger, Orla", ("name", "Zellinger, Orla")),
    ],
)
def test_places(labelers, text, found):
    assert found in likely(labelers, text)


@pytest.mark.parametrize(
    "text",
    ["P/N 555-0141-42 is the kit number", "LOT 930-78-7730 of the pump", "Took 57@$57.31 each", "Stock 70 Road Force weights in bin 75", "Keep the Elmstead Drive display", "Order no. 990469 closed", "Lookup for Velmora Kestrel returns two", "Ref 1485-33-131335 from us"],
)
def test_no_places(labelers, text):
    assert likely(labelers, text) == set()


@pytest.mark.parametrize("at", ["[\tat\t]", "[\u00a0at\u00a0]", "[   at ]", "(\nat)", "<AT>", " at "])
@pytest.mark.parametrize("dot", ["\ndot\n", "\u00a0dot\u00a0", "\tDot ", " dot "])
def test_spelled_out_addresses_with_any_white_space(labelers, at, dot):
    text = f"x jo.k{at}tarnvale{dot}example y"
    found = [c for c in labelers.candidates(text) if c.kind == 0]
    assert len(found) == 1 and text[found[0].start : found[0].end] == f"jo.k{at}tarnvale{dot}example"


def test_ordinary_words_are_learned_from_case():
    from partweave.llm.piispans import CASE_BUCKETS, cased_words, word_bucket

    assert cased_words("Ask petra.k@x.example, O'Hara, or Bob; 3mm jo_y") == ["Ask", "or", "Bob"]
    case = bytearray(CASE_BUCKETS)
    case[word_bucket("ask")] = 200
    told = {w: Labelers([], [], [], bytes(case)).ordinary(w) for w in ("ask", "tonna", "the")}
    assert told == {"ask": True, "tonna": False, "the": True}


def test_words_of_things_are_learned_from_articles(spark):
    from partweave.llm.pii import word_case
    from partweave.llm.piispans import word_bucket, words_after_articles

    assert words_after_articles("Fits the Velmora Kestrel, ask Tonna; das Auto. The end") == ["Velmora", "Kestrel", "Auto"]
    rows = [("the Velmora Kestrel is here, ask Tonna",)] * 3 + [("Tonna and Velmora",), ("the tonna",), (None,), ("",)]
    case, things = word_case(spark.createDataFrame(rows, "text string"), "text")
    assert things[word_bucket("velmora")] > 150 and things[word_bucket("tonna")] == 0
    assert case[word_bucket("here")] == 255 and 0 < case[word_bucket("tonna")] < 60


def test_offsets_are_code_points(labelers):
    text = "👍🏽 é Mail: orla@a.example"
    c = labelers.candidates(text)[0]
    assert text[c.start : c.end] == "orla@a.example" and c.start == text.index("orla")


def test_label_model():
    p = label_model({"++0": 50, "+00": 30, "0-0": 500, "0--": 200, "000": 300, "+-0": 5})
    assert p["++0"] > 0.95 and p["+00"] > 0.8 and p["0-0"] < 0.05 and p["0--"] < 0.01
    assert min(label_model({"++": 100, "+0": 80}).values()) > 0.9  # nothing but real ones is not split in two
    assert label_model({}) == {}


def test_classifier_generalises_to_held_out_rows():
    import numpy as np

    rng = np.random.default_rng(5)
    rows, labels = [], []
    for _ in range(600):
        y = rng.random() < 0.4
        rows.append([1 if y else 2, int(rng.integers(10, 60)), 3 if rng.random() < (0.8 if y else 0.2) else 4])
        labels.append(float(y))
    w = train_classifier(rows[:400], np.array(labels[:400]))
    right = sum((w[r].sum() > 0) == (y > 0.5) for r, y in zip(rows[400:], labels[400:]))
    assert right >= 195


def test_settle():
    assert settle([(1.0, 4, 5, 15), (9.0, 4, 8, 15), (0.1, 3, 12, 30), (0.5, 0, 40, 50)]) == [(3, 12, 30), (0, 40, 50)]


def test_unseen_sentences(spark):
    """Names that no list has, in sentences whose wording is in no labeler: what stands around them is learned from the
    names that are known; the same for things that are written like names."""
    rows, want = [], set()
    for i in range(240):
        who = f"{GIVEN[i % 3]} {FAMILY[i % 3]}".title() if i % 2 else f"{'Ab Ce Di Fo Gu'.split()[i % 5]}lin {'Kor Lam Nef'.split()[i % 3]}dal"
        lead = ["We waved goodbye to", "Nothing was left over by", "The cake was baked by"][i % 3]
        text = f"{lead} {who} behind the greenhouse. The Brindle Forge crate, or the {'Ab Ce Di'.split()[i % 3]}xo {'Kor Lam'.split()[i % 2]}ra crate, went into bin {i}."
        rows.append((i, text))
        want.add((i, "name", len(lead) + 1))
    names = spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY], "name_text string, name_kind string")
    got = {(r.doc_id, r.pii_kind, r.start_char) for r in find_pii(spark.createDataFrame(rows, "doc_id bigint, text string"), names, MAKERS).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_whole_operator(spark):
    people = ["Orla Yarborn", "Felix Oakhallow", "Greta Zellinger", "Tonna Yarborn", "Felix Korvath"]
    rows = []
    for i in range(60):
        p = people[i % 5]
        rows.append((i, f"Bin {i} had three Brindle Forge cartons.\nCustomer {p}, call 350-555-01{i:02d} when it lands.\nMail: user{i}@tarnvale.example.\nPer {p}, home {i + 10} Copper Beech Lane, Apt 4.", "clash", "clash"))
    rows += [(100, None, "", ""), (101, "", "", ""), (102, " \n ", "", ""), (103, "word " * 60_000 + "SSN 962-20-5726 was copied", "", ""), (0, rows[0][1], "clash", "clash")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, candidates string, votes string")
    names = spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY] + [(None, "given")], "name_text string, name_kind string")
    found = find_pii(docs, names, MAKERS).cache()
    got = {(r.doc_id, r.pii_kind, r.start_char) for r in found.collect()}
    text = rows[3][1]
    want = {("name", text.index("Tonna")), ("phone", text.index("350-")), ("email", text.index("user3")), ("name", text.rindex("Tonna")), ("address", text.index("13 Copper"))}
    assert {g[1:] for g in got if g[0] == 3} == want
    assert {g[1] for g in got if g[0] == 103} == {"id_number"} and not {100, 101, 102} & {g[0] for g in got}
    out = {r.doc_id: r.text for r in redact(docs, found).collect()}
    assert out[3].splitlines()[1:] == ["Customer [NAME], call [PHONE] when it lands.", "Mail: [EMAIL].", "Per [NAME], home [ADDRESS], Apt 4."]
    assert out[100] is None and out[101] == "" and out[102] == " \n "
    assert find_pii(docs.limit(0), names, MAKERS).count() == 0
