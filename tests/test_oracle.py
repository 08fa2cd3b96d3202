"""Every registered query against its DuckDB oracle on the smallest fixture."""

import pytest

from shop_helpers import SF_SMALL


def _names():
    from storelake.plans.registry import load_all
    return sorted(n for n, r in load_all().items() if r.sql)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, registry, name):
    import sys, os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    from oracle_check import compare, duck
    got = registry[name].build(spark, SF_SMALL).toPandas()
    want = duck(SF_SMALL).execute(registry[name].sql).fetchdf()
    diff = compare(name, got, want)
    assert diff is None, diff


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) <= 10
    assert df.columns == ["item_id", "itemName", "total_sold", "total_revenue"]
    assert set(E.oracle_sql()) <= set(E.queries())
