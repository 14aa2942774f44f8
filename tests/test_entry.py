from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(repr([clean(r[c]) for c in cols]) for r in df.collect())
    run = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == cols
    want = sorted(repr([clean(r[names.index(c)]) for c in cols]) for r in run.fetchall())
    assert got == want


def test_entry(spark):
    if DATA.exists():
        assert entry.entry(spark).count() > 0
