"""Queries against their SQL where some prices are 0: no errors, and the same rows."""

import shutil
from pathlib import Path

import duckdb
import pytest
from compare import TABLES, oracle_rows, spark_rows

from marketlens import plans, registry  # noqa: F401


@pytest.fixture(scope="module")
def zeros(sf, tmp_path_factory):
    """The tables, with a value of 0 in every ninth event and in the last events of some users."""
    path = tmp_path_factory.mktemp("zeros")
    for name in TABLES:
        if name != "events":
            shutil.copy(f"{sf}/{name}.parquet", path)
    sql = f"SELECT * REPLACE (CASE WHEN event_id % 9 = 0 OR (user_id % 4 = 1 AND ts >= TIMESTAMP '2024-01-18') THEN 0 ELSE value END AS value) FROM '{sf}/events.parquet'"
    duckdb.connect().execute(f"COPY ({sql}) TO '{path}/events.parquet' (FORMAT parquet)")
    assert Path(f"{path}/events.parquet").exists()
    return str(path)


NAMES = [
    "abnormal_returns",
    "classify_units",
    "clock_return",
    "consensus_revision",
    "daily_returns",
    "gap_covariate",
    "gap_return",
    "gap_series",
    "kalman_beta_sector",
    "market_reduction",
    "overnight_moves",
    "pivot_items",
    "rollup_daily",
    "window_facts",
    "window_return",
    "window_shares",
]


@pytest.mark.parametrize("name", NAMES)
def test_zero_prices(spark, zeros, name):
    assert spark_rows(registry.QUERIES[name](spark, zeros)) == oracle_rows(registry.ORACLE[name], zeros)


def test_abnormal_returns_with_means(spark, sf, tmp_path):
    """Where dates have enough names for a mean (those of the smallest tables don't), log returns of prices of 0 are in neither."""
    sql = "SELECT event_id, TIMESTAMP '2024-01-01' + INTERVAL (event_id // 25) DAY AS ts, event_id % 25 AS user_id, 'view' AS event_type, CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id % 7 + 1.0 END AS value FROM range(200) t(event_id)"
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (CAST(value AS DOUBLE) AS value) FROM ({sql})) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in TABLES:
        if name != "events":
            shutil.copy(f"{sf}/{name}.parquet", tmp_path)
    got = spark_rows(registry.QUERIES["abnormal_returns"](spark, str(tmp_path)))
    assert got == oracle_rows(registry.ORACLE["abnormal_returns"], str(tmp_path))
    at = got[0].index("alr")
    assert any(r[at] is not None for r in got[1])
