"""Every registered query outside the document subpackage runs, and agrees with its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from gridwise.fixtures import TABLES
from gridwise.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    clean = [tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else (float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)) for v in r) for r in frame.itertuples(index=False, name=None)]
    return sorted(clean, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    got = queries()[name](spark, SF).toPandas()
    assert len(got.columns)
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        expected = c.sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    a, b = rows(got), rows(expected)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if any(v != w and not (isinstance(v, float) and isinstance(w, float) and abs(v - w) <= 1e-9 * max(1, abs(v))) for v, w in zip(x, y, strict=True))]
    assert not wrong, (len(wrong), wrong[:3])
