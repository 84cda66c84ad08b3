"""Uploads, patterns, decisions and texts on small tables."""

import zipfile

import pytest
from pyspark.sql import functions as F

from partweave.functions import text as t
from partweave.operators import patterns, reviews
from partweave.sources import uploads
from test_functions import column, pairs

SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path):
    rows = [
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>COST</t></is></c></row>',
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1.50</v></c></row>',
        '<row r="3"/>',
        '<row r="4"><c r="B4"><f>1+1</f><v>2</v></c></row>',
    ]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {SHEET}><si><t>PART NO</t></si><si><r><t>00</t></r><r><t>12</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {SHEET}><sheetData>{''.join(rows)}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    got = [tuple(r) for r in uploads.read_sheet(spark, str(tmp_path / "a.xlsx")).collect()]
    assert got == [("0012", "1.50"), (None, "2")]
    items = uploads.project_items(uploads.read_sheet(spark, str(tmp_path / "a.xlsx")), "store", "p").collect()
    assert [(r.part_number, float(r.current_cost)) for r in items] == [("0012", 1.5)]


def test_upload_guard(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    (tmp_path / "b.XLSX").write_bytes(b"no workbook")
    (tmp_path / "c.csv").write_text("A,B")
    (tmp_path / "d").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: r.error for r in uploads.checked_files(spark, str(tmp_path)).collect()}
    assert got["a.xlsx"] is None and got["c.csv"] is None
    assert got["b.XLSX"].startswith("File content does not match") and got["d"].startswith("File type not allowed: (no extension)")


def test_bad_rows_are_kept_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A,B\n1,"x, y"\n2\n3,4,5\n')
    rows = {r.A: (r.B, r[uploads.BAD_ROW]) for r in uploads.read_strict(spark, str(tmp_path / "a.csv"), ["A", "B"]).collect()}
    assert rows["1"] == ("x, y", None) and rows["2"][1] == "2" and rows["3"][1] == "3,4,5"


def test_interchange_relations_and_mapping(spark, tmp_path):
    rows = spark.createDataFrame([("A-1", "ABC123", "stop"), ("A-1", "ABC123", None), ("A-2", "n/a", None)], "OURS string, THEIRS string, NOTES string")
    links, wide = uploads.interchange_relations(rows, "p")
    assert links.count() == 2 and [(r.competitor_line_code, r.competitor_part_number) for r in wide.collect()] == [("ABC", "123")]
    uploads.replace_flagged(links, str(tmp_path / "g"))
    assert sorted(map(str, [r.flag_type for r in spark.read.parquet(str(tmp_path / "g")).collect()])) == ["NOTE", "None"]
    path = str(tmp_path / "m")
    uploads.store_mapping(spark, path, "p", "store", {"part_number": "X", "cost": "Y"})
    uploads.store_mapping(spark, path, "p", "supplier", {"part_number": "Z"})
    uploads.store_mapping(spark, path, "p", "store", {"part_number": "W"})
    assert uploads.stored_mapping(spark, path, "p", "store") == {"part_number": "W"} and uploads.stored_mapping(spark, path, "p", "supplier") == {"part_number": "Z"}


def test_forms(spark):
    assert column(spark, ["xbo12-3", "RDSNC 9", None], t.norm_catalogue) == ["123", "NC9", None]
    assert [tuple(x) for x in column(spark, ["ABCD-1", "AB", "abc9"], t.line_code_fixed)] == [("ABC", "D-1"), (None, None), ("ABC", "9")]
    assert [tuple(x) for x in column(spark, ["GATE-12", "1A"], t.line_code_wide)] == [("GATE", "12"), (None, "1A")]
    assert column(spark, ["GAT", "BWD", "X", "", None], t.brand_of) == ["GATES", "BWDAUTO", "X", None, None]
    assert column(spark, ["BWD", "DL"], lambda c: t.brand_of(c, names=t.WIDER_BRANDS)) == ["BWD", "DURALAST"]
    assert column(spark, ["=A1", "x", ""], t.plain_cell) == [None, "x", None]
    assert column(spark, ["ABCdef"], lambda c: t.mid(c, 4, 2)) == ["de"] and column(spark, ["ABCdef"], lambda c: t.left(c, 3)) == ["ABC"]
    assert column(spark, [" Abc-1 "], lambda c: t.canonical_form(c, keep_case=True)) == ["Abc1"] and column(spark, ["AC-12"], lambda c: t.canonical_form(c, prefix="AC")) == ["12"]
    assert column(spark, ['x ```json\n{"a": {"b": 1}}\n``` y', "`none`"], t.reply_json) == ['{"a": {"b": 1}}', "none"]


def test_changes_are_applied_as_plain_text(spark):
    values = [("A.B-C", 'Remove "., -"'), ("A.B", 'Replace "." with "+"'), ("A", 'Add "x"'), ("ab", "Change case"), ("A", 'Transform "A" → "B"'), (None, 'Remove "-"')]
    assert pairs(spark, values, t.apply_change) == ["ABC", "A+B", "Ax", "AB", None, None]


def test_patterns(spark):
    rows = [(f"{i}", f"A-{i}", f"A{i}", "L1", 0.9) for i in range(3)] + [(f"9{i}", f"B/{i}", f"B{i}", None, 0.8) for i in range(2)] + [(f"8{i}", f"C/{i}", f"C-{i}", None, 0.7) for i in range(2)]
    found = patterns.described_patterns(spark.createDataFrame(rows, "id string, a string, b string, line string, confidence double"))
    got = {r.signature: (r.n, r.change, r.rule_type, r.line_code) for r in found.collect()}
    assert got["remove_dash"] == (3, 'Remove "-"', "punctuation", "L1") and got["remove_slash"][1] == 'Remove "/"'
    clusters = {r.signature: r.cluster for r in patterns.clustered_patterns(found).collect()}
    assert clusters == {"remove_dash": "remove_dash", "remove_slash": "remove_slash", "slash_to_dash_remove_slash": "remove_dash"}
    item = "id string, project_id string, part_number string, line_code string"
    stores = spark.createDataFrame([("s1", "p", "Z-9", "l1"), ("s2", "p", "Z-9", "L2"), ("s3", "p", None, None)], item)
    suppliers = spark.createDataFrame([("u1", "p", "Z9", None), ("u2", "q", "Z9", None)], item)
    assert {(r.store_id, r.supplier_id, r.signature) for r in patterns.similar_unmatched(stores, suppliers, found).collect()} == {("s1", "u1", "remove_dash")}
    pending = [(f"c{i}", "PENDING", "L", f"A-{i}", f"A{i}") for i in range(12)] + [("d", "CONFIRMED", "L", "A-99", "A99"), ("e", "PENDING", "L", "A/9", "A9")]
    told = patterns.bulk_suggestions(spark.createDataFrame(pending, "id string, status string, line string, a string, b string")).collect()
    assert [(r.signature, r.affected, r.message) for r in told] == [("remove_dash", 12, 'We found 12 more items with the same pattern: "Remove "-"" for L line. Would you like to approve all of them?')]
    assert len(told[0].preview.split()) == 10


C = "id string, project_id string, store_item_id string, target_type string, target_id string, method string, confidence double, status string, vendor_action string, updated_at int"


def test_decisions_and_exports(spark):
    c = spark.createDataFrame(
        [("m1", "p", "s1", "SUPPLIER", "u1", "FUZZY", 0.9, "PENDING", None, 1), ("m1", "p", "s1", "SUPPLIER", "u1", "FUZZY", 0.9, "CONFIRMED", None, 2), ("m1", "p", "s1", "SUPPLIER", "u1", "FUZZY", 0.9, "CONFIRMED", None, 3),
         ("m2", "p", "s1", "SUPPLIER", "WEB_1", "AI", float("nan"), "PENDING", "NONE", 1), ("m3", "p", "s9", "INVENTORY", "u1", "AI", 0.5, "PENDING", None, 1)], C)
    item = "id string, part_number string, line_code string, description string, current_cost double"
    stores, suppliers = (spark.createDataFrame([(i, n, "L", "d", 1.0)], item) for i, n in (("s1", "A1"), ("u1", "B1")))
    assert [(r.id, r.before, r.status, r.updated_at) for r in reviews.decision_history(c).collect()] == [("m1", "PENDING", "CONFIRMED", 2)]
    rows = reviews.export_rows(c, stores, suppliers)
    assert rows.columns == reviews.EXPORT_COLUMNS
    got = {r.match_id: (r.store_part_number, r.supplier_part_number, r.confidence) for r in rows.collect()}
    assert got == {"m1": ("A1", "B1", 0.9), "m2": ("A1", None, None), "m3": (None, None, 0.5)}
    chosen = spark.createDataFrame([("m2",), ("m9",)], "match_id string")
    assert [r.match_id for r in reviews.filtered_export(rows, ids=chosen).collect()] == ["m2"] and reviews.filtered_export(rows, "all", "all").count() == 3
    assert not set(reviews.COSTS) & set(reviews.filtered_export(rows, "pending", "AI").columns) and reviews.filtered_export(rows, "pending", "AI").count() == 2
    assert [tuple(r) for r in reviews.unmatched_projects(c).collect()] == [("p", 2, 1)]
    assert [(r.id, r.status) for r in reviews.decide(c, spark.createDataFrame([("m2",), ("x",)], "id string"), "REJECTED", "me").collect()] == [("m2", "REJECTED")]
    with pytest.raises(ValueError):
        reviews.decide(c, chosen.select(F.col("match_id").alias("id")), "MAYBE", "me")
    entries = spark.createDataFrame([("m1", "accept", None), ("m9", "accept", None)], "match_id string, decision string, corrected_number string")
    assert [df.count() for df in reviews.import_reviews(entries, c)] == [1, 1] and [df.count() for df in reviews.import_reviews(entries, c, all_or_nothing=True)] == [0, 2]
