"""Account curves and reports must not carry the plans of their inputs: the driver once ran out of memory on them (F1, F2)."""

from barloom.operators import account

POOL = "chain string, ca string, pair_id string, "


def test_curve_and_allocation_end_the_plans_of_their_inputs(spark):
    bars = spark.createDataFrame(
        [("c", "t", "a", i, i * 10, p) for i, p in enumerate([10.0, 12.0, 6.0, 9.0])], POOL + "idx long, time long, close double").where("ca <> 'bars-before'")
    labelled = spark.createDataFrame(
        [("c", "t", "a", 0, 0, 10.0, 2, 20, 6.0, 2)],
        POOL + "entry_idx long, entry_time long, entry_price double, exit_idx long, exit_time long, exit_price double, holding_bars long").where("ca <> 'labels-before'")
    rules = {"capital": 1000.0, "max_positions": 1, "sizing": {"type": "fixed_amount", "value": 100.0},
             "costs": {"feePercent": 0, "slippagePercent": 0, "buyTaxPercent": 0, "sellTaxPercent": 0}}
    accepted = account.allocate(labelled, rules)
    trades = account.with_money(accepted, rules["costs"]).where("ca <> 'trades-before'")
    curve = account.equity_curve(trades, bars, 1000.0, costs=rules["costs"])
    falls = account.account_drawdown(curve, 1000.0)
    report = account.report(trades, 1000.0, curve=curve)

    text = lambda df: df._jdf.queryExecution().toString()
    assert "labels-before" not in text(accepted)
    for mark in ("labels-before", "trades-before", "bars-before"):
        assert mark not in text(curve) and mark not in text(falls)
    assert "bars-before" not in text(report)

    assert [tuple(r) for r in curve.orderBy("time").collect()] == [
        (0, 900.0, 1000.0, 0.0), (10, 900.0, 1020.0, 20.0), (20, 960.0, 960.0, 0.0), (30, 960.0, 960.0, 0.0)]
    assert max(r.drawdown for r in falls.collect()) == 60.0
    row = report.collect()[0]
    assert (row.trades, row.losses, row.net_pnl, row.final_equity) == (1, 1, -40.0, 960.0)
