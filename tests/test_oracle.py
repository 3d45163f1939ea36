"""Every registered query against its own SQL in DuckDB, value by value."""

import datetime

import duckdb
import pytest

from conftest import SF_DIR
from tidemark.plans.inputs import SCHEMAS
from tidemark.queries import REGISTRY


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in SCHEMAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def canonical(table):
    cols = sorted(table.column_names)
    out = []
    for row in table.select(cols).to_pylist():
        out.append(tuple(v.isoformat() if isinstance(v, datetime.date) else repr(v) for v in (row[c] for c in cols)))
    return cols, sorted(out)


def test_every_query_has_an_oracle():
    assert [n for n, q in REGISTRY.items() if not q.sql] == []


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, duck, name):
    q = REGISTRY[name]
    got = canonical(q.build(spark, SF_DIR).toArrow())
    want = canonical(duck.sql(q.sql).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]
