import random

from pyspark.sql import functions as F

from partweave.operators.rules import check_reviews, newest
from partweave.operators.simjoin import trigram_join, vector_topk
from partweave.operators.skew import join_unique, numbered, split_join
from partweave.operators.staged import punctuation_rules, second_stage, staged_matches
from partweave.sources.uploads import project_interchanges, project_items, read_delimited, replace_project, resolve_roles, write_delimited
from partweave.streaming.reviews import learn_stream, windowed_counts


def test_join_of_hot_keys_equals_the_plain_join(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 50 + ["b", "c", None, "x"])], "k string, i int")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    hot = spark.createDataFrame([("a",)], "k string")
    for how in ("left", "inner"):
        assert sorted(map(str, join_unique(left, right, "k", hot, how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_split_join_equals_the_plain_join(spark):
    """Two keys hold a third and a tenth of the rows; the cells of a hot key are spread evenly."""
    key = lambda i: "hot" if i % 3 == 0 else "warm" if i % 10 == 1 else f"k{i % 40}" if i % 7 else None
    left = spark.createDataFrame([("p", key(i), f"a{i}", "c") for i in range(600)], "p string, k string, a string, clash string")
    right = spark.createDataFrame([("p", key(i), f"b{i}", "c") for i in range(300)], "p string, k string, b string, clash2 string")
    met = split_join(left, right, ["p", "k"], "a", "b", least=20)
    assert "_a_at" in met._jdf.queryExecution().toString()
    assert sorted(map(str, met.collect())) == sorted(map(str, left.join(right, ["p", "k"]).select(*met.columns).collect()))
    assert split_join(left.limit(0), right, ["p", "k"], "a", "b", least=20).count() == 0


def test_places_equal_a_window(spark):
    rows = spark.createDataFrame([(f"p{i % 3}", f"{i * 37 % 1000:04d}") for i in range(500)], "p string, id string")
    want = {}
    for p in ("p0", "p1", "p2"):
        for place, r in enumerate(sorted(r.id for r in rows.filter(rows.p == p).collect())):
            want[p, r] = place
    assert {(r.p, r.id): r.place for r in numbered(rows, "p", "id").collect()} == want


ITEM = "id string, project_id string, part_number string, line_code string, description string, canonical_part_number string, mfr_part_number string, current_cost decimal(10,2)"


def test_staged_steps(spark):
    item = lambda i, n, line=None, mfr=None: (i, "p", n, line, None, None, mfr, None)
    stores = spark.createDataFrame([item("s1", "12-34"), item("s2", "ABC7777"), item("s3", "X_1"), item("s4", "Q1", "L", "M-9"), item("s5", None), item("s6", "ABC77")], ITEM)
    suppliers = spark.createDataFrame([item("u3", "1234"), item("u1", "12.34"), item("u2", "7777"), item("u4", "X1"), item("u5", "Z", "l", "m-9"), item("u6", "Y", "K", "M9"), item("u7", "W", None, "M/9"), item("u8", "77"), item("u9", None)], ITEM)
    links = spark.createDataFrame([("e1", "p", "12-34", "7777", None, None)], "id string, project_id string, merrill_part_number string, vendor_part_number string, vendor string, line_code string")
    rules = spark.createDataFrame([("punctuation:_>", "_", "", 0.8)], "rule_id string, old string, new string, confidence double")
    got = {(r.store_id, r.supplier_id): (r.step, r.method, r.confidence) for r in staged_matches(stores, suppliers, links, rules).collect()}
    assert got == {
        ("s1", "u1"): (1, "EXACT_NORM", 0.95), ("s1", "u2"): (4, "INTERCHANGE", 1.0), ("s2", "u2"): (6, "EXACT_NORM", 0.8), ("s3", "u4"): (7, "RULE_BASED", 0.8),
        ("s4", "u5"): (2, "LINE_PN", 0.9), ("s4", "u6"): (3, "EXACT_NORM", 0.75), ("s4", "u7"): (5, "EXACT_NORM", 0.85),
    }
    assert staged_matches(stores.limit(0), suppliers, links, rules).count() == 0


def test_punctuation_rules_from_positive_rules(spark):
    rows = [("1", "A_1", "A1"), ("2", "B_2", "B2"), ("2", "B_2", "B2"), ("3", "C#3", "C_3"), ("4", "D#3", "D_3"), ("5", "A+", "A"), ("6", "AB", "BA"), ("7", None, "A")]
    rules = spark.createDataFrame([(i, "POSITIVE_MAP", a, b, 0.9, True) for i, a, b in rows], "id string, rule_type string, store_part_number string, supplier_part_number string, confidence double, enabled boolean")
    assert {(r.old, r.new, r.confidence) for r in punctuation_rules(rules).collect()} == {("_", "", 0.9), ("#", "_", 0.9)}


def test_second_stage_with_hot_keys_is_the_same(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("AB1") for _ in range(rng.randint(3, 8)))
    item = lambda i: (i, "p", word(), rng.choice(["L1", None]), rng.choice(["pad set", "hose", None]), None, word(), None)
    stores = spark.createDataFrame([item(f"s{i}") for i in range(40)], ITEM)
    suppliers = spark.createDataFrame([item(f"u{i}") for i in range(60)], ITEM)
    taken = spark.createDataFrame([("s0",)], "store_id string")
    runs = [sorted(map(tuple, second_stage(stores, suppliers, taken, hot_least=least).collect())) for least in (5, 100_000)]
    assert runs[0] == runs[1] and runs[0] and not any(r[0] == "s0" for r in runs[0])


def test_trigram_join_misses_nothing(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("AB12") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    a = spark.createDataFrame([("p", f"a{i}", w) for i, w in enumerate(words[:30])], "p string, a string, t string")
    b = spark.createDataFrame([("p", f"b{i}", w) for i, w in enumerate(words[30:] + [None, ""])], "p string, b string, t string")

    def grams(w):
        return {f"  {w.lower()} "[i : i + 3] for i in range(len(w) + 1)} if w else set()

    for least in (0.25, 0.4, 0.8):
        got = {(r.a, r.b): r.similarity for r in trigram_join(a, b, "p", "a", "b", F.col("t"), F.col("t"), least).collect()}
        want = {}
        for i, x in enumerate(words[:30]):
            for j, y in enumerate(words[30:]):
                s = len(grams(x) & grams(y)) / len(grams(x) | grams(y))
                if s >= least:
                    want[f"a{i}", f"b{j}"] = s
        assert got == want


def test_vector_blocks_equal_broadcast(spark):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(40)], "id int, v array<double>")
    q = v.filter("id % 10 = 0")
    one = vector_topk(q, v, "id", "v", 5, 0.0).collect()
    two = vector_topk(q, v, "id", "v", 5, 0.0, blocks=3, most=1).collect()
    assert sorted((r.query_id, r.rank, r.target_id) for r in one) == sorted((r.query_id, r.rank, r.target_id) for r in two)


def test_newest_version(spark):
    rows = spark.createDataFrame([("1", 1, "a"), ("1", 3, "b"), ("1", 2, "c"), ("2", None, "d"), (None, 9, "e")], "id string, updated_at int, status string")
    assert sorted(map(tuple, newest(rows, "status").collect())) == [("1", "b"), ("2", "d")]


def test_review_errors(spark):
    candidates = spark.createDataFrame([("m1", 1, "p")], "id string, updated_at int, project_id string")
    reviews = spark.createDataFrame([("m1", "accept", None), ("m1", "no", "X"), ("m2", "yes", None), (" ", "yes", None), ("m1", "?", None)], "match_id string, decision string, corrected_number string")
    got = {(r.match_id, r.decision): r.error for r in check_reviews(reviews, candidates).collect()}
    assert got[("m1", "accept")] is None and all(v for k, v in got.items() if k != ("m1", "accept"))


def test_upload_round_trip(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write('Part Number,COST $,Qty Avl,DESC\n00-12,"$1,200.50",3,"a ""b"", c"\nX9,0,none,\n,1,1,blank\n')
    rows = project_items(read_delimited(spark, path), "store", "p1")
    got = {r.part_number: r for r in rows.collect()}
    assert set(got) == {"00-12", "X9"}
    assert (float(got["00-12"].current_cost), got["00-12"].quantity, got["00-12"].description) == (1200.5, 3, 'a "b", c')
    assert got["X9"].current_cost is None and got["X9"].quantity is None
    out = str(tmp_path / "out")
    write_delimited(rows.select("part_number", "description"), out)
    assert {r.part_number: r.description for r in read_delimited(spark, out).collect()}["00-12"] == 'a "b", c'


def test_roles():
    assert resolve_roles(["X", " part no "], "store") == {"part_number": " part no "}
    assert resolve_roles(["X"], "store", {"part_number": "X"}) == {"part_number": "X"}
    for columns, chosen in ((["X"], None), (["PART NO"], {"part_number": "Y"})):
        try:
            resolve_roles(columns, "store", chosen)
            raise AssertionError("no error")
        except ValueError:
            pass


def test_interchange_projection(spark):
    rows = spark.createDataFrame([("A-1", "B1"), ("A-2", "no interchange"), (None, "B2")], "`MERRILL PART #` string, `VENDOR PART #` string")
    assert [r.merrill_part_number_norm for r in project_interchanges(rows, "p").collect()] == ["A1"]


def test_partition_replacement(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_project(spark.createDataFrame([("p1", 1), ("p2", 2)], "project_id string, v int"), path)
    replace_project(spark.createDataFrame([("p1", 5)], "project_id string, v int"), path)
    assert sorted((r.project_id, r.v) for r in spark.read.parquet(path).collect()) == [("p1", 5), ("p2", 2)]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("A-1", "b1", "accept"), ("A-1", "b1", "yes"), ("A2", "B2", "no"), ("A3", "B3", "?")], "store_part_number string, supplier_part_number string, decision string").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    learn_stream(stream, str(tmp_path / "rules"), str(tmp_path / "state")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "rules")).select("rule_type", "store_key", "supplier_key").collect()} == {("POSITIVE_MAP", "A1", "B1"), ("NEGATIVE_BLOCK", "A2", "B2")}
    events = spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 'a' as event_type, 2.0D as value union all select timestamp'2024-01-01 00:04:00', 'a', 3.0D")
    assert [(r.n, r.total) for r in windowed_counts(events).collect()] == [(2, 5.0)]
