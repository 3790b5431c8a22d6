"""Trades of price zero: the SQL of the live candles states the rule of the queries (F25-F28)."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import rows_of

# event, minutes after the start, value: zero inside a bar, as its open, as its close, and alone
EVENTS = [(0, 0, 5.0), (1, 10, 0.0), (2, 20, 7.0), (3, 240, 0.0), (4, 250, 3.0), (5, 480, 4.0), (6, 490, 0.0), (7, 720, 0.0), (8, 1200, 6.0), (9, 1500, 2.0), (10, 40_000, 1.0)]


@pytest.mark.parametrize("name", ["i2_tumbling_bars", "i2_tumbling_bars_stream", "i2_tumbling_bars_stream_finished", "i4_flush_and_fill"])
def test_zero_prices(spark, tmp_path, name):
    con = duckdb.connect()
    values = ", ".join(f"({e}::BIGINT, TIMESTAMP '2024-01-10 00:00:00' + INTERVAL {m} MINUTE, 4::BIGINT, 'click', {v}::DOUBLE, '{{\"k\": 3}}')" for e, m, v in EVENTS)
    con.execute(f"COPY (SELECT * FROM (VALUES {values}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns, expected = [d[0] for d in want.description], want.fetchall()
    got = entry.queries()[name](spark, str(tmp_path))
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, expected)
    assert expected and all(row[columns.index("close")] > 0 for row in expected)
