"""Every registered query of the engine against its SQL twin."""

import math
import os

import duckdb
import pytest

from genoweave.plans import catalog, catalog_access, catalog_headers, catalog_more, catalog_records, catalog_reference, catalog_rewrites, catalog_variants  # noqa: F401


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, sql, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in catalog.ORACLES:
        rel = sql.sql(catalog.ORACLES[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
