"""Stop, target, cost and exit expressions. Parameters may be literals or columns of a sweep table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def stop_level(stop: Mapping, entry: Column, low: Column, high: Column) -> Column:
    buffer = 1 - float(stop.get("bufferPercent") or 0) / 100
    if stop["type"] == "percent":
        return entry * (1 - stop["value"] / 100)
    if stop["type"] == "swing_low":
        return low * buffer
    return (high - (high - low) * stop["ratio"]) * buffer


def target_level(target: Mapping, entry: Column, stop: Column, low: Column, high: Column) -> Column:
    if target["type"] == "percent":
        return entry * (1 + target["value"] / 100)
    if target["type"] == "risk_reward":
        return entry + F.greatest(F.lit(0.0), entry - stop) * target["ratio"]
    if target["type"] == "previous_high":
        return high
    return high - (high - low) * target["ratio"]


def bar_exit(entry: Column, stop: Column, target: Column, invalid: Column, timed_out: Column, end: Column, lock: Column | None = None) -> Column:
    """First matching exit of a completed bar, by priority: stop or lock, invalidation, target, timeout, end."""
    o, h, l, c = (F.col(n) for n in ("open", "high", "low", "close"))
    floor = F.greatest(stop, lock) if lock is not None else stop
    locked = F.coalesce(lock > stop, F.lit(False)) if lock is not None else F.lit(False)
    made = lambda kind, price: F.struct(kind.alias("type"), price.alias("price"))
    return (
        F.when((o <= floor) | (l <= floor), made(F.when(locked, "profit_lock").otherwise("stop_loss"), F.when(o <= floor, o).otherwise(floor)))
        .when(invalid, made(F.lit("invalidation"), c))
        .when((target > entry) & ((o >= target) | (h >= target)), made(F.lit("take_profit"), F.when(o >= target, o).otherwise(target)))
        .when(timed_out, made(F.lit("timeout"), c))
        .when(end, made(F.lit("end_of_backtest"), c))
    )


COSTS = {"feePercent": 1.0, "slippagePercent": 1.0, "buyTaxPercent": 1.0, "sellTaxPercent": 1.0}


def trade_costs(amount: Column, entry: Column, exit_price: Column, costs: Mapping = COSTS) -> dict[str, Column]:
    """Fees, slippage and taxes of both sides; slippage is a cost, it does not move the fill price."""
    quantity = amount / entry
    proceeds = quantity * exit_price
    fees = (amount + proceeds) * (costs["feePercent"] / 100)
    slippage = (amount + proceeds) * (costs["slippagePercent"] / 100)
    tax = amount * (costs["buyTaxPercent"] / 100) + proceeds * (costs["sellTaxPercent"] / 100)
    gross = (exit_price - entry) * quantity
    return {
        "quantity": quantity, "fees": fees, "slippage_cost": slippage, "tax_cost": tax,
        "gross_pnl": gross, "net_pnl": gross - fees - slippage - tax,
    }
