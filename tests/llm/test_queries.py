import pytest

from tallyloom.llm import queries
from tests.duck import connection, same

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["cache_key", "defect"], "p2_found": ["chunk_table", "id_a", "id_b"], "p3_found": ["chunk_table", "id_a", "id_b"], "p5_found": ["chunk_table", "id", "cut"],
    "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = [str(r) for r in df.collect()]
    assert rows and len(set(rows)) == len(rows)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in queries.SQL:
        same(df, connection(SF), queries.SQL[name])
