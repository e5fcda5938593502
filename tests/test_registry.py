"""Every registered query of the library against its SQL twin on the smallest tables."""

import math

import pytest

from fluvius.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    rel = duck.sql(registry.ORACLE[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)


def test_flagship(spark):
    rows = registry.flagship(spark, SF).collect()
    assert len(rows) == 10 and sum(r.n for r in rows) > 0


@pytest.mark.parametrize("name", ["crossing_dedupe", "crossing_clusters", "water_proposal"])
def test_kernels_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
