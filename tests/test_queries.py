"""Every query of the engine against its SQL in DuckDB, and none may be empty."""

import math

import duckdb
import pytest

from isotherm.plans import registry

TABLES = ("lineitem", "orders", "customer", "nation")
#: Queries whose days the smallest tables may not have.
RARE = ("august_trend",)


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple(None if isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, db, name):
    out = registry.QUERIES[name](spark, sf_dir)
    want = db.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(out.columns)
    got, expected = out.select(columns).collect(), want.fetchall()
    assert len(got) == len(expected) and (got or name in RARE)
    for a, b in zip(key(map(tuple, got)), key(expected)):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and x == pytest.approx(y, abs=1.1e-6), (a, b)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_mean_field_has_every_point_of_the_grid(spark, sf_dir):
    got = registry.QUERIES["mean_field_on_grid"](spark, sf_dir).collect()
    assert len({(r.era5_lat, r.era5_lon) for r in got}) == len(got) == 141 * 81
    assert 0 < sum(r.mean is not None for r in got) < 141 * 81


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
