"""Words that lie anywhere in texts, against the plain rule, and what finding them moves."""

from partweave.operators.matching import words_held
from partweave.plans import catalog

ITEM = "id string, project_id string, part_number string, line_code string, description string, canonical_part_number string, mfr_part_number string, current_cost decimal(10,2)"


def rows_shuffled(spark, run):
    """Rows written to shuffles while ``run`` runs."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before, limit = total(), "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # as where tables are large
    run()
    spark.conf.set(limit, was)
    return sum(n for k, n in total().items() if k not in before)


def folder(spark, tmp_path, stores, suppliers):
    for name, rows in (("store_items", stores), ("supplier_items", suppliers)):
        spark.createDataFrame(rows, ITEM).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_words_held_equal_the_rule(spark):
    words = ["a", "ab", "abc", "abcd ef", " abcd", "abcdefgh", "abcdefghi jk", "  ", " ", "x  y", "é1", "abcde", "ef ", "a.c"]
    texts = ["abcdefghi jk", "abcd ef", "zabcdefghiz", "", "a  b", "x  y", "xx  yy ef", "é12 abc", "ab", "ABC", " ", "a.c axc"]
    rows = lambda side, n: [(p, *x) for p in ("p", "q") for i, w in enumerate(side) for x in [(w,) if n == 1 else (f"{p}{i}", w)]]
    w = spark.createDataFrame(rows(words, 1), "project_id string, word string")
    t = spark.createDataFrame(rows(texts, 2), "project_id string, supplier_id string, whole string")
    want = sorted((p, w, f"{p}{i}") for p in ("p", "q") for w in words for i, x in enumerate(texts) if w in x)
    for least in (100_000, 2):
        assert sorted(map(tuple, words_held(w, t, least).select("project_id", "word", "supplier_id").collect())) == want
    assert words_held(w.limit(0), t).count() == 0


def test_keyword_hits_move_pieces_not_places(spark, tmp_path):
    stores = [(f"s{i}", "p", f"NN-{i:05d}", "LNC", "brake pad", None, None, None) for i in range(200)]
    suppliers = [(f"u{i:04d}", "p", f"{i:05d}", "LNC", "brake pad set ceramic front axle with a long description that all sellers word alike", None, None, None) for i in range(1000)]
    at = folder(spark, tmp_path, stores, suppliers)
    got = []
    moved = rows_shuffled(spark, lambda: got.extend(catalog.queries()["keyword_hits"](spark, at).collect()))
    assert len(got) == 100 and {r.hits for r in got} == {1}
    assert moved < 60_000, moved  # every place of every text met the words before


def test_variant_lookup_meets_the_first_holders_of_a_word_only(spark, tmp_path):
    stores = [(f"s{i:04d}", "p", f"{i:04d}" * 2, None, "brake pad" if i % 2 else "disc ring brake", None, None, None) for i in range(300)]
    texts = ["brake disc", "brakes", "a pad for it", "ring gear"]
    suppliers = [(f"u{i:04d}", "p", "AB CD EF GH", None, texts[i * 7 // 5 % 4], None, None, None) for i in range(1000)]
    at = folder(spark, tmp_path, stores, suppliers)
    got = []
    moved = rows_shuffled(spark, lambda: got.extend(catalog.queries()["variant_lookup"](spark, at).collect()))
    want = set()
    for s in stores:
        held = sorted(u[0] for u in suppliers if any(w in u[4] for w in s[4].split()))
        want |= {(s[0], u, 3, rank) for rank, u in enumerate(held[:50], 1)}
    assert sorted(map(tuple, got)) == sorted(want)
    assert moved < 120_000, moved  # every store row met all holders of each of its words before


def test_weighted_scores_shuffle_rows_not_pairs(spark, tmp_path):
    kinds = f"{ITEM}, category string, subcategory string"
    for side, first in (("store", "s"), ("supplier", "u")):
        rows = [(f"{first}{i}", "p", f"ABC{i}", None, "brake pad", None, None, None, "Brakes" if i % 2 else None, "pads") for i in range(200)]
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{side}_items.parquet")
    got = []
    moved = rows_shuffled(spark, lambda: got.extend(catalog.queries()["weighted_scores"](spark, str(tmp_path)).collect()))
    assert len(got) == len({(r.store_id, r.supplier_id) for r in got}) == 200 * 200
    assert {round(r.score, 6) for r in got if r.store_id == "s7" and r.supplier_id in ("u7", "u8")} == {1.0, round(0.75 * 0.5 + 0.3 + 0.05 + 0.1, 6)}
    assert moved < 20_000, moved  # every pair was shuffled twice before
