"""Every query with SQL gives the rows that DuckDB computes."""

import math
from collections import Counter

import pytest

from ripple import catalogue


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else x
    return Counter(tuple(value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, sf_dir, name):
    got = catalogue.queries()[name](spark, sf_dir)
    sql = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    assert sorted(got.columns) == sorted(names)
    assert bag(map(tuple, got.collect()), got.columns) == bag(sql.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
