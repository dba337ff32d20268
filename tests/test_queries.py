"""Every query of the forecasting operators against its oracle in DuckDB."""

import duckdb
import pytest

from skeinwork import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem", "embeddings", "customer", "part", "conversations", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = queries.QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in queries.ORACLES:
        assert rows
        return
    want = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in cols) for r in rows), key=repr) == sorted(want.fetchall(), key=repr)


def test_flagship(spark, sf_dir):
    got = {r.model: (r.windows, r.mse) for r in queries.flagship(spark, sf_dir).collect()}
    assert got == {"SeasonalNaive": (115, 2490.9035), "HistoricAverage": (115, 1239.7989), "ZeroModel": (115, 1414.5263)}
