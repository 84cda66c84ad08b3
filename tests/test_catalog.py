import pytest
from parity import assert_same

from partweave.plans import catalog
from partweave.sources.tables import table

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, data):
    assert_same(QUERIES[name], SQL[name], spark, data)


def ids(df, column):
    return {r[0] for r in df.select(column).collect()}


def test_loaded_and_rejected_rows_are_all_rows(spark, data):
    raw = ids(table(spark, data, "store_items").filter("raw_data is not null"), "id")
    loaded, rejected = QUERIES["p2_loaded"](spark, data), QUERIES["p2_found"](spark, data)
    assert ids(loaded, "id") | ids(rejected, "store_item_id") == raw and not ids(loaded, "id") & ids(rejected, "store_item_id")
    assert loaded.filter("part_number is null or cost < 0").isEmpty()


def test_table_of_all_files(spark, data):
    rejected = {r.store_item_id: r.reason for r in QUERIES["p2_found"](spark, data).collect()}
    rows = {r.id: r for r in QUERIES["p5_table"](spark, data).collect()}
    assert not any(rejected.get(i) in ("quoting", "column_count") for i in rows)
    loaded = QUERIES["p2_loaded"](spark, data).filter("file_id is not null").collect()
    assert {r.id for r in loaded} <= set(rows)
    assert all(rows[r.id].cost == r.cost and rows[r.id].quantity == r.quantity for r in loaded)
    assert dict(QUERIES["p5_table"](spark, data).dtypes)["cost"] == "decimal(18,4)"


def test_changes_of_files(spark, data):
    changes = QUERIES["p5_found"](spark, data).collect()
    assert changes and {c.change_kind for c in changes} <= {"added", "removed", "renamed", "retyped", "moved"}
    assert {c.file_id for c in changes} <= ids(table(spark, data, "files"), "id") and len(changes) == len(set(changes))


def test_only_these_have_no_sql():
    assert set(QUERIES) - set(SQL) == {"p2_loaded", "p5_found", "p5_table"}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
