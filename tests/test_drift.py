from datetime import datetime, timedelta

from partweave.operators.drift import Edit, Node, assign, change_report, edit_script, schema_drift, unified_rows

ITEMS = "id string, file_id string, raw_data string, columns string, name string"
FILES = "id string, feed_id string, row_format string, field_delimiter string, header_line string, uploaded_at timestamp, before string"


def run(spark, files):
    """files: (feed, format, header, rows), in order of upload."""
    items, about = [], []
    for k, (feed, fmt, header, rows) in enumerate(files):
        items += [(f"{k}-{i}", f"f{k}", r, "clash", "clash") for i, r in enumerate(rows)]
        about.append((f"f{k}", feed, fmt, "," if fmt == "delimited" else None, header, datetime(2024, 1, 20) + timedelta(days=9 * k), "clash"))
    return schema_drift(spark.createDataFrame(items, ITEMS), spark.createDataFrame(about, FILES))


def changes(drift):
    return {tuple(r) for r in change_report(drift).collect()}


def test_changes_of_a_feed(spark):
    d = run(
        spark,
        [
            ("a", "delimited", "PART NUMBER,COST,BIN", ["A1,1.50,B-1", "A2,2.50,B-2"]),
            ("a", "delimited", " cost ,ITEM NUMBER,BIN", ["1.50,A1,B-1", "2.50,A2,B-2"]),
            ("a", "json", None, ['{"ITEM NUMBER":"A1","COST":"$1.50","WEIGHT":3}', '{"COST":"$2.50","ITEM NUMBER":"A2","WEIGHT":4}']),
            ("b", "delimited", "PART NUMBER", ["Z"]),
            ("a", "json", None, ['{"ITEM NUMBER":"A1","NET COST":1.5,"WEIGHT":null}']),
        ],
    )
    assert changes(d) == {
        ("f1", "ITEM NUMBER", "renamed"),
        ("f2", "BIN", "removed"), ("f2", "WEIGHT", "added"), ("f2", "COST", "retyped"),
        ("f4", "NET COST", "renamed"), ("f4", "NET COST", "retyped"),
    }


def test_types(spark):
    rows = ["1,1.5,2024-01-31,TRUE,x"] * 4 + ["x,x,x,x,x"]
    d = run(spark, [("a", "delimited", "A,B,C,D,E", rows)])
    kinds = {c["name"]: c["kind"] for c in d.schemas.collect()[0]["columns"]}
    assert kinds == {"A": "integer", "B": "decimal", "C": "date", "D": "boolean", "E": "text"}
    d = run(spark, [("a", "delimited", "A,B", ["1,"] * 3 + ["x,"])])
    assert {c["name"]: c["kind"] for c in d.schemas.collect()[0]["columns"]} == {"A": "text", "B": None}


def test_rename_of_unknown_header_by_its_cells(spark):
    a = ["2024-01-0%d,K-%d" % (i, i) for i in range(1, 9)]
    b = ["K-%d,2024-02-0%d" % (i, i) for i in range(1, 9)]
    d = run(spark, [("a", "delimited", "SEEN ON,CODE", a), ("a", "delimited", "CODE,SEEN AT", b), ("a", "delimited", "CODE,WORDS", ["K-1,long words here"] * 5)])
    assert changes(d) == {("f1", "SEEN AT", "renamed"), ("f2", "SEEN AT", "removed"), ("f2", "WORDS", "added")}
    table = {r.id: r for r in unified_rows(d).collect()}
    assert "SEEN ON" in table["1-0"].extra and "CODE" in table["1-0"].extra


def test_headers_are_only_a_first_guess(spark):
    """A header known to mean the same as one that goes, over cells that are altogether different, is another column."""
    a = [f"A{i},{i}.50" for i in range(1, 9)]
    b = [f"A{i},on request from the depot number {i} by letter" for i in range(1, 9)]
    d = run(spark, [("a", "delimited", "PART NUMBER,COST", a), ("a", "delimited", "PART NUMBER,NET COST", b), ("a", "delimited", "P/N,NET COST", b)])
    assert changes(d) == {("f1", "COST", "removed"), ("f1", "NET COST", "added"), ("f2", "P/N", "renamed")}


def test_columns_that_change_places(spark):
    a = [f"{i}.50,a long story about part number {i}" for i in range(1, 9)]
    b = [f"a long story about part number {i},{i}.50" for i in range(1, 9)]
    assert changes(run(spark, [("a", "delimited", "ALPHA,BETA", a), ("a", "delimited", "ALPHA,BETA", b)])) >= {("f1", "ALPHA", "renamed"), ("f1", "BETA", "renamed")}
    assert changes(run(spark, [("a", "delimited", "ALPHA,BETA", a), ("a", "delimited", "BETA,ALPHA", b)])) == set()
    c = [f"many words {i} in place of a price,a long story about part number {i}" for i in range(1, 9)]
    assert changes(run(spark, [("a", "delimited", "ALPHA,BETA", a), ("a", "delimited", "ALPHA,BETA", c)])) == {("f1", "ALPHA", "retyped")}


def test_nested_cells_have_columns_of_their_own(spark):
    row = lambda item, store: '{"ITEM": %s, "STORE": %s}' % (item, store)
    d = run(
        spark,
        [
            ("a", "json", None, [row('{"no": 1, "cost": 2.5}', '{"city": "X"}')] * 3),
            ("a", "json", None, [row('{"no": "A"}', '{"city": "X", "cost": 2.5}')] * 3),
            ("a", "json", None, [row('{"no": "A", "size": {"w": 1}}', '{"city": "X", "cost": 2.5}')] * 3),
        ],
    )
    assert changes(d) == {("f1", "ITEM.NO", "retyped"), ("f1", "STORE.COST", "moved"), ("f2", "ITEM.SIZE", "added")}


def test_typed_table(spark):
    d = run(spark, [("a", "delimited", "PART NUMBER,COST,QTY,LAST SALE", ['A1,"$1,200.50",3.0,2024-01-31', "A2,call,,soon"])])
    got = {r.id: r for r in unified_rows(d).collect()}
    assert (float(got["0-0"].cost), got["0-0"].quantity, str(got["0-0"].last_sale), got["0-0"].unread) == (1200.5, 3, "2024-01-31", None)
    assert (got["0-1"].cost, got["0-1"].quantity, got["0-1"].last_sale, got["0-1"].unread) == (None, None, None, '{"cost":"call","last_sale":"soon"}')


def test_empty_and_unknown_files_take_no_part(spark):
    d = run(spark, [("a", "delimited", "PART NUMBER,COST", ["A,1"]), ("a", "json", None, ["{broken"]), ("a", "delimited", "PART NUMBER", ["A"])])
    assert changes(d) == {("f2", "COST", "removed")}
    assert changes(run(spark, [])) == set()


def test_assign_is_cheapest():
    import itertools
    import random

    rng = random.Random(3)
    for n in range(1, 6):
        cost = [[rng.random() for _ in range(n)] for _ in range(n)]
        best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(sum(cost[i][j] for i, j in enumerate(assign(cost))) - best) < 1e-9


def test_nested_edits():
    old = Node("", children=[Node("item", children=[Node("no", "text"), Node("cost", "decimal")]), Node("store", children=[Node("city", "text")])])
    new = Node("", children=[Node("item", children=[Node("no", "integer")]), Node("store", children=[Node("city", "text"), Node("cost", "decimal")])])
    assert set(edit_script(old, new)) == {Edit("retyped", "item.no", "item.no"), Edit("moved", "item.cost", "store.cost")}
