"""The registered queries against DuckDB on the driver's smallest tables."""

from pathlib import Path

import pytest

from colonnade.queries import oracle_sql, queries

BASE = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not BASE.exists(), reason="no driver tables here")
TABLES = "region nation customer supplier part orders lineitem events documents pages labels embeddings benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return con


def shown(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list):
        return tuple(map(shown, value))
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_the_oracle(spark, duck, name):
    frame = queries()[name](spark, str(BASE))
    columns = sorted(frame.columns)
    got = sorted((tuple(shown(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = duck.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(shown(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == wanted


def test_flagship(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["o_orderkey", "o_orderdate", "o_totalprice"] and frame.count() == 3


def test_rows_only_queries_run(spark):
    for name in sorted(set(queries()) - set(oracle_sql())):
        assert queries()[name](spark, str(BASE)).count() > 0
