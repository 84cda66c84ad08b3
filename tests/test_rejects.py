import json

from partweave.operators.rejects import diagnose, split_rows
from partweave.sources.rawrows import split_delimited, split_json

ITEMS = "id string, file_id string, raw_data string, cells string, record string"
FILES = "id string, feed_id string, row_format string, field_delimiter string, header_line string, uploaded_at timestamp, names string"


def run(spark, rows, files):
    items = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ITEMS)
    about = spark.createDataFrame([(f[0], "fd", *f[1:], None, "clash") for f in files], FILES)
    loaded, rejected = split_rows(items, about)
    return {(r.store_item_id, r.reason) for r in rejected.collect()}, {r.id: r for r in loaded.collect()}


HEADER = "PART NUMBER,COST,QTY AVL,USAGE,DESC"


def flat(spark, lines, delimiter=",", header=HEADER):
    return run(spark, [(str(i), "f", line) for i, line in enumerate(lines)], [("f", "delimited", delimiter, header)])


def test_split_delimited():
    assert split_delimited('a,"b ""x"", c",', ",") == ["a", 'b "x", c', ""]
    assert split_delimited("", ",") == [""]
    assert split_delimited('"a\nb",c\r\n', ",") == ["a\nb", "c"]
    for bad in ('a"b,c', '"a" ,b', '"a', 'a"', '"a"b', "a\nb"):
        assert split_delimited(bad, ",") is None
    assert split_delimited("a|b", "|") == ["a", "b"]


def test_split_json():
    assert split_json('{"a": 1.50, "b": null, "c": true, "d": {"e": [1]}}') == (["a", "b", "c", "d"], ["1.50", None, "true", '{"e": ["1"]}'])
    for bad in ("", "[]", "1", "{'a': 1}", '{"a": 1,}', '{"a": NaN}', '{"a": 1} x', '{"a" 1}', "[" * 100_000):
        assert split_json(bad) is None


def test_reasons_of_delimited_rows(spark):
    lines = ["A-1,1.50,3,4,ok", 'A-1,1,3,4,a"b', "A-1,1,3", "---,1,3,4,x", "=A1,1,3,4,x", "12E+05,1,3,4,x", "#REF!,1,3,4,x", "A1,CALL,3,4,x", 'A1,"$1,234.50",-2.0,,x',
             "A1,-1,3,4,x", "A1,1,2.5,4,x", "A1,1,3,n/a,x", "", ",1,3,4,x", "A1,,,,"]
    rejected, loaded = flat(spark, lines)
    assert rejected == {("1", "quoting"), ("2", "column_count"), ("3", "value"), ("4", "value"), ("5", "value"), ("6", "value"), ("7", "value"), ("9", "value"), ("10", "value"),
                        ("11", "value"), ("12", "column_count"), ("13", "value")}
    assert set(loaded) == {"0", "8", "14"}
    assert (float(loaded["8"].cost), loaded["8"].quantity, loaded["8"].usage) == (1234.5, -2, None)


def test_first_reason_that_holds(spark):
    assert flat(spark, ['---,1,"x', "---,1"])[0] == {("0", "quoting"), ("1", "column_count")}


def test_json_columns_are_those_of_most_rows(spark):
    good = json.dumps({"PART NO": "A1", "ON HAND": 3})
    rows = [("1", good), ("2", good), ("3", json.dumps({"PART NO": "A1"})), ("4", json.dumps({"PART NO": "A1", "ON HAND": 3, "X": 1})), ("5", '{"PART NO": "A1", "ON HAND": 3,}'),
            ("6", json.dumps({"ON HAND": "9.0", "PART NO": "B2"})), ("7", json.dumps({"PART NO": None, "ON HAND": 1})), ("8", '{"PART NO": "A", "PART NO": "A", "ON HAND": 1}')]
    rejected, loaded = run(spark, [(i, "j", r) for i, r in rows], [("j", "json", None, None)])
    assert rejected == {("3", "column_count"), ("4", "column_count"), ("5", "quoting"), ("7", "value"), ("8", "column_count")}
    assert set(loaded) == {"1", "2", "6"}


def test_repeats_nulls_and_unknown_files(spark):
    rows = [("1", "f", "A,1"), ("1", "f", "A,1"), ("2", "f", None), ("3", None, "A,1"), ("4", "gone", '{"a": 1'), (None, "f", "A")]
    rejected, loaded = run(spark, rows, [("f", "delimited", ",", "PART NUMBER,COST")])
    assert rejected == {("4", "quoting"), (None, "column_count")}
    assert set(loaded) == {"1", "3"}


def test_empty_tables(spark):
    assert run(spark, [], []) == (set(), {})


def test_very_long_row(spark):
    rejected, loaded = flat(spark, ["A1,1,1,1," + "x" * 200_000])
    assert not rejected and len(loaded["0"].description) == 200_000


def test_headers_that_are_not_listed_are_told_by_their_words(spark):
    lines = ["A-1,1.50,3,4", "---,1,3,4", "A1,CALL,3,4", "A1,1,2.5,4", "A1,1,3,n/a"]
    assert flat(spark, lines, header="P/N,STORE COST,STOCK,12 MO SALES")[0] == {(str(i), "value") for i in range(1, 5)}
    assert flat(spark, ["A,x,x,x,x,x"], header="PART NO,CORE COST,MIN STOCK,STOCK NUMBER CODE,COST CODE,LAST QTY DATE")[0] == set()


def test_a_row_that_the_reader_loses_comes_out(spark):
    remainder = spark.createDataFrame([("r1", "1"), ("r2", "2"), ("r3", "3")], "record string, id string")
    seen = spark.createDataFrame([("r1", None, False), ("r3", ["x"], True)], "record string, cells array<string>, fits boolean")
    assert {(r.id, r.reason) for r in diagnose(remainder, seen).collect()} == {("1", "quoting"), ("2", "unread"), ("3", "value")}
