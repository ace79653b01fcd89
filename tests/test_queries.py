"""Every query of the core beside its SQL on the smallest tables."""

import math

import pytest

from skydrift.plans import registry


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def check(spark, sf, duck, query, sql):
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    if sql:
        cur = duck.execute(sql)
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == rows(cols, cur.fetchall())
    else:
        assert df.columns


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sf, duck, name):
    check(spark, sf, duck, registry.queries()[name], registry.oracle_sql().get(name))


def test_entry_without_and_with_llm(spark, sf):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert e.entry(spark).columns
