import pytest
from parity import assert_same

from partweave.llm import queries as q

COLUMNS = {
    "p1_found": ["store_item_id", "supplier_item_id"],
    "p3_found": ["group_norm", "part_norm"],
    "p4_found": ["listing_a", "listing_b"],
    "p6_found": ["match_candidate_id"],
    "p7_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id", "pii_kind", "start_char"],
}


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_as_sql(name, spark, data):
    assert_same(q.QUERIES[name], q.SQL[name], spark, data)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_no_repeats(name, spark, data):
    df = q.QUERIES[name](spark, data).cache()
    assert df.columns == COLUMNS[name]
    assert df.count() == df.distinct().count() > 0
    df.unpersist()
