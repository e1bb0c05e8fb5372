"""Layer 1: every registered query against its DuckDB oracle on sf0.001."""

import hashlib
import math

import pytest

from spanlake.plans.catalog import oracle_sql, queries
from tests.conftest import SF_SMALL

NAMES = sorted(queries())


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{round(v, 6):.6f}"
    return str(v)


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


def test_every_query_has_an_oracle():
    missing = set(queries()) - set(oracle_sql())
    assert not missing, missing


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert _digest(rows, df.columns) == _digest(orows, rel.columns)


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    out = entry(spark).collect()
    assert len(out) >= 2
    total = [r for r in out if r["is_total"]][0]
    assert 0.0 <= total["mean_jaccard"] <= 1.0
