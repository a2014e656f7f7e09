"""Every registered query runs, and agrees with its SQL where it has one."""

import pytest
from compare import oracle_rows, spark_rows

from marketlens import plans, registry  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    cols, rows = spark_rows(registry.QUERIES[name](spark, sf))
    assert len(set(cols)) == len(cols)
    if name in registry.ORACLE:
        assert (cols, rows) == oracle_rows(registry.ORACLE[name], sf)


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_names_stand_once():
    with pytest.raises(ValueError):
        registry.query("daily_returns")(lambda spark, sf: None)
