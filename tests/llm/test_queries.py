from __future__ import annotations

import os

import pytest

queries = pytest.importorskip("corpusloom.llm.queries")
from tests.compare import SF, connection, same  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
FOUND = {
    "p1_found": ["pos_a", "pos_b"], "p2_found": ["plan", "label"], "p3_found": ["pos_a", "pos_b"], "p4_found": ["mix", "source"], "p5_found": ["pos", "field"],
    "p6_found": ["pos"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.SQL[name], connection())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == FOUND.get(name, df.columns)
    rows = df.collect()
    assert name == "p8_found" or rows
    if name in FOUND:
        assert len(rows) == len(set(map(tuple, rows)))
