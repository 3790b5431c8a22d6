"""The whole run as one lazy plan: bars -> index -> fill -> swing -> rule -> edge -> first exit -> costs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from barloom.functions.levels import COSTS, trade_costs
from barloom.operators.labels import earliest_signals, entries_of, framed_bars, label_exits, mark_entries, with_levels
from barloom.operators.rules import features_of
from barloom.operators.swings import SwingRule
from barloom.plans.blocks import BLOCK

DEFAULT = {
    "swing": SwingRule(),
    "entry": {"mode": "all", "conditions": [{"type": "fib_retracement", "zoneLow": 0.382, "zoneHigh": 0.886}]},
    "invalidation": {"mode": "any", "conditions": [
        {"type": "break_fib_invalidation", "ratio": 1.0, "bufferPercent": 5},
        {"type": "bearish_volume_invalidation", "period": 10, "minRatio": 2, "minBodyPercent": 20},
    ]},
    "exits": {
        "stopLoss": {"type": "percent", "value": 40}, "takeProfit": {"type": "risk_reward", "ratio": 1.5},
        "maxHoldingBars": 30, "closeAtEnd": True,
    },
    "costs": COSTS,
    "amount": 100.0,
}


def indicator_table(bars: DataFrame, signals: DataFrame, step: int, strategy: Mapping = DEFAULT, block: int = BLOCK) -> DataFrame:
    features = features_of(strategy["entry"]) | features_of(strategy.get("invalidation"))
    return framed_bars(bars, step, strategy["swing"], features, earliest_signals(signals), block)


def labelled(bars: DataFrame, signals: DataFrame, step: int, strategy: Mapping = DEFAULT, block: int = BLOCK) -> DataFrame:
    frame = indicator_table(bars, signals, step, strategy, block)
    marked = mark_entries(frame, strategy["swing"], strategy["entry"], block)
    entries = with_levels(entries_of(marked), strategy["exits"])
    return label_exits(entries, frame.where("core"), strategy["exits"], strategy.get("invalidation"))


def trades(bars: DataFrame, signals: DataFrame, step: int, strategy: Mapping = DEFAULT, block: int = BLOCK) -> DataFrame:
    out = labelled(bars, signals, step, strategy, block)
    money = trade_costs(F.lit(float(strategy["amount"])), F.col("entry_price"), F.col("exit_price"), strategy["costs"])
    return out.select(*out.columns, *[c.alias(n) for n, c in money.items()])


def pool_results(trade_rows: DataFrame) -> DataFrame:
    """Net PnL and exit reason counts per pool: the flagship output."""
    return trade_rows.groupBy("chain", "ca", "pair_id", "exit_reason").agg(
        F.count(F.lit(1)).alias("trades"),
        F.round(F.sum("net_pnl"), 6).alias("net_pnl"),
        F.count_if(F.col("net_pnl") > 0).alias("wins"),
    )
