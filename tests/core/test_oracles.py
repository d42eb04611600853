"""Every registered query against its SQL in DuckDB, on the tables of sf0.001."""

import duckdb
import pytest

from loreforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    """Rows as text, columns by name, floats to 6 significant places behind the point."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in (r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, db, name):
    out = registry.QUERIES[name](spark, SF)
    rows = out.collect()
    if name not in registry.ORACLES:
        assert out.columns
        return
    want = db.sql(registry.ORACLES[name])
    assert sorted(want.columns) == sorted(out.columns)
    assert plain(rows, out.columns) == plain(want.fetchall(), want.columns)
