"""A cross-section of registered queries against their oracles (``tests/compare.py`` runs all of them)."""

import pytest

from compare import check, connect

NAMES = ["a2_ingest_history", "b2_fill_gaps", "c7_resolve_signal_dataset", "d4_swing_asof_pullback", "e13_rule_group", "f5_profit_lock", "f10_equity_curve",
         "g3_associate_events", "h1_position_cycles", "i2_tumbling_bars_stream", "i4_flush_and_fill", "j3_split_balanced_sets"]


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    import __spark_entry__ as entry

    assert check(spark, connect("sf0.001"), name, entry.queries()[name], entry.oracle_sql()[name], "sf0.001").startswith("match")
