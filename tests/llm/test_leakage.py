import random

import numpy as np

from partweave.llm.leakage import K, W, fingerprints, has_passage, leaked_items, words

VOCABULARY = [f"w{i}" for i in range(400)]


def test_words():
    assert words("Don’t—STOP; the​ ﬁne print, 3½") == ["dont", "stop", "the", "fine", "print", "31", "2"]


def test_every_shared_run_shares_a_fingerprint():
    rng = np.random.default_rng(1)
    for _ in range(300):
        run = rng.integers(1, 2**63, K + W - 1, dtype=np.uint64)
        a = np.concatenate([rng.integers(1, 2**63, rng.integers(0, 9), dtype=np.uint64), run, rng.integers(1, 2**63, rng.integers(0, 9), dtype=np.uint64)])
        b = np.concatenate([rng.integers(1, 2**63, rng.integers(0, 9), dtype=np.uint64), run, rng.integers(1, 2**63, rng.integers(0, 9), dtype=np.uint64)])
        assert set(fingerprints(a)[1].tolist()) & set(fingerprints(b)[1].tolist())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(doc, item, least=20):
    """Any stretch of the item against any stretch of the document."""
    for i in range(len(item)):
        for j in range(i + least, len(item) + 1):
            part, most = item[i:j], (j - i) // 10
            for a in range(len(doc)):
                for b in range(max(a + 1, a + len(part) - most), min(len(doc), a + len(part) + most) + 1):
                    if edits(part, doc[a:b]) <= most:
                        return True
    return False


def damaged(rng, passage, n):
    out = list(passage)
    for _ in range(n):
        k = rng.randrange(len(out))
        how = rng.choice("cda")
        if how == "c":
            out[k] = rng.choice(VOCABULARY)
        elif how == "d":
            del out[k]
        else:
            out.insert(k, rng.choice(VOCABULARY))
    return out


def test_alignment_equals_brute_force():
    rng = random.Random(4)
    ids = {w: i + 1 for i, w in enumerate(VOCABULARY)}
    code = lambda ws: np.array([ids[w] for w in ws], dtype=np.uint64)
    seen = set()
    for _ in range(30):
        item = [rng.choice(VOCABULARY) for _ in range(24)]
        n = rng.randint(18, 24)
        a = rng.randint(0, 24 - n)
        doc = [rng.choice(VOCABULARY) for _ in range(3)] + damaged(rng, item[a : a + n], rng.randint(0, 3)) + [rng.choice(VOCABULARY) for _ in range(3)]
        want = brute(doc, item)
        seen.add(want)
        assert has_passage(code(doc), code(item)) == want
    assert seen == {True, False}


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], "doc_id bigint, text string, item_id string, starts string")
    e = spark.createDataFrame(items, "item_id string, text string")
    return {tuple(r) for r in leaked_items(d, e).collect()}


def test_whole_operator(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    order = "Answer the following question as briefly as you possibly can with only the facts that are given to you below and nothing else at all."
    one, two, three = say(40), say(40), say(17)
    items = [("i1", f"{order} {one}."), ("i2", f"{order} {two}."), ("i3", three), ("i4", None), ("i5", "")]
    cut = one.split()[5:27]
    cut[4], cut[15] = "changed", "again"
    worse = list(cut)
    for k in (1, 7, 10, 18):
        worse[k] = f"odd{k}"
    docs = [
        (1, f"{say(30)} {one} {say(30)}"), (2, say(200)), (3, f"{say(9)}\n> " + "\n> ".join(w.upper() for w in cut)), (4, " ".join(worse)), (5, f"{order} {say(40)}"),
        (6, None), (7, ""), (8, f"{one}, {two}"), (9, three), (10, " ".join(one.split()[:17])), (1, f"{say(3)} {one}"), (11, (say(3000) + " ") * 5 + " ".join(two.split()[10:31])),
    ]
    assert run(spark, docs, items) == {(1, "i1"), (3, "i1"), (8, "i1"), (8, "i2"), (11, "i2")}


def test_empty_tables_and_equal_items(spark):
    text = " ".join(VOCABULARY[:30]) + ". " + " ".join(VOCABULARY[50:80]) + "."
    assert run(spark, [], [("i", text)]) == set() == run(spark, [(1, text)], [])
    assert run(spark, [(1, text)], [("i", text), ("j", text)]) == {(1, "i"), (1, "j")}
