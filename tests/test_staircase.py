"""Candidate sets through staircases: exits against a bar-by-bar walk, and the shape of the plan."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.levels import COSTS
from barloom.operators import staircase, sweep
from barloom.suite.sweeps import BASE, families, scored

POOL = ("c", "t", "p")


def walk(bars, entry, spec):
    """First exit of one entry under one spec, bar by bar."""
    (_, _, _, stop_type, stop_value, stop_buffer, target_type, target_value, lock, hold, at_end, fib_ratio, fib_buffer, low_buffer, bear, *_), price, low, high = spec, entry["price"], entry["low"], entry["high"]
    def fib(r):
        return high - (high - low) * r
    stop = {"percent": price * (1 - stop_value / 100), "swing_low": low * (1 - stop_buffer / 100)}.get(stop_type, fib(stop_value) * (1 - stop_buffer / 100))
    target = {"percent": price * (1 + target_value / 100), "risk_reward": price + max(0.0, price - stop) * target_value, "previous_high": high}.get(target_type, fib(target_value))
    if at_end and entry["idx"] == len(bars) - 1:
        return 0, "end_of_backtest", price
    peak = None
    for offset, b in enumerate(bars[entry["idx"] + 1:], 1):
        floors = [price * (1 + t["floorPercent"] / 100) for t in (LOCKS[lock] if lock is not None else []) if peak is not None and peak >= price * (1 + t["activationPercent"] / 100)]
        floor = max([stop, *floors])
        peak = b["close"] if peak is None else max(peak, b["close"])
        if b["low"] <= floor:
            return offset, "profit_lock" if floor > stop else "stop_loss", min(b["open"], floor)
        if (fib_ratio is not None and b["close"] < fib(fib_ratio) * (1 - fib_buffer / 100)) or (low_buffer is not None and b["close"] < low * (1 - low_buffer / 100)):
            return offset, "invalidation", b["close"]
        if bear is not None and b["close"] < b["open"] and (b["open"] - b["close"]) / b["open"] * 100 >= 20 and b["volume"] >= b["vmean_10"] * 1.2:
            return offset, "invalidation", b["close"]
        if target > price and b["high"] >= target:
            return offset, "take_profit", max(b["open"], target)
        if offset >= hold:
            return offset, "timeout", b["close"]
        if at_end and b["is_last"]:
            return offset, "end_of_backtest", b["close"]
    return None, None, None


LOCKS = [[{"activationPercent": 10, "floorPercent": 2}, {"activationPercent": 40, "floorPercent": 20}], [{"activationPercent": 3, "floorPercent": -30}]]


@pytest.mark.parametrize("seed", [1, 2])
def test_exits_of_every_spec(spark, seed):
    rng = random.Random(seed)
    bars, close = [], 10.0
    for idx in range(160):
        opened, close = close * rng.choice([1, 1, 0.95, 1.06]), max(0.5, close * rng.choice([0.7, 0.9, 0.97, 1, 1, 1.04, 1.1, 1.4]))
        bars.append({"idx": idx, "open": opened, "close": close, "high": max(opened, close) * rng.choice([1, 1.1]), "low": min(opened, close) * rng.choice([1, 0.9]),
                     "volume": float(rng.randrange(100)), "vmean_10": 50.0, "is_last": idx == 159})
    entries = [{"idx": k, "price": bars[k]["close"], "low": bars[k]["close"] * rng.uniform(0.5, 1), "high": bars[k]["close"] * rng.uniform(1, 2)} for k in sorted(rng.sample(range(160), 40) + [159])]
    exits = []
    for stop in sweep.NEAR_STOPS:
        for target in (*sweep.NEAR_TARGETS, {"type": "fib_target", "ratio": 0.382}):
            for n, lock in enumerate([None, *LOCKS]):
                exits.append({"stopLoss": stop, "takeProfit": target, "maxHoldingBars": rng.choice([1, 7, 30, 200]), "closeAtEnd": rng.random() < 0.7, "profitLock": {"enabled": lock is not None, "tiers": lock or []}})
    cut = [None, *({"mode": "any", "conditions": c} for c in (
        [{"type": "break_fib_invalidation", "ratio": 0.886, "bufferPercent": 1}], [{"type": "break_swing_low_invalidation", "bufferPercent": 2}, {"type": "bearish_volume_invalidation", "period": 10, "minRatio": 1.2, "minBodyPercent": 20}]))]
    specs = staircase.specify([{**BASE, "id": str(n), "exits": e, "invalidation": cut[n % 3]} for n, e in enumerate(exits)])
    assert specs.locks == LOCKS
    frame = spark.createDataFrame([(*POOL, b["idx"], *(float(b[c]) for c in ("open", "high", "low", "close", "volume", "vmean_10")), b["is_last"]) for b in bars],
                                  "chain string, ca string, pair_id string, idx long, open double, high double, low double, close double, volume double, vmean_10 double, is_last boolean")
    bought = spark.createDataFrame([(*POOL, e["idx"], e["idx"], e["price"], False, e["idx"] == 159, (e["low"], e["high"]), 0, 0) for e in entries],
                                   "chain string, ca string, pair_id string, entry_idx long, entry_time long, entry_price double, entry_synthetic boolean, entry_is_last boolean, swing struct<low:double,high:double>, swing_no int, kind int")
    stairs = staircase.staircases(bought, frame, specs, block=16)
    got = {(r.spec, r.entry_idx): (r.holding_bars, r.exit_reason, r.exit_price) for r in staircase.labels(bought, stairs, specs.frames(spark)[0]).collect()}
    assert len(got) == len(specs.rows) * len(entries)
    for row in specs.rows:
        for e in entries:
            want, found = walk(bars, e, row), got[row[0], e["idx"]]
            assert found[:2] == want[:2] and (found[2] == pytest.approx(want[2], rel=1e-12) if want[2] else found[2] is None)
    assert {v[1] for v in got.values()} == {"profit_lock", "stop_loss", "invalidation", "take_profit", "timeout", "end_of_backtest", None}


def test_whole_sets_are_specified():
    sets = families()
    assert len(sets["j9_grid_scores"]) == 865 and len({c["id"] for c in sets["j9_grid_scores"]}) == 865
    grid = staircase.specify(sets["j9_grid_scores"])
    assert len(grid.rows) == 6 * 3 * 4 * 2 + 1  # sizes and adds share a spec; the control has its own
    assert len(staircase.specify(sets["j10_neighborhood_scores"]).rows) == len(sets["j10_neighborhood_scores"]) - 2  # slots and re-entry share the base's


def test_what_has_no_staircase_is_refused():
    rule = {"mode": "all", "conditions": [{"type": "break_fib_invalidation", "ratio": 1}, {"type": "break_swing_low_invalidation"}]}
    with pytest.raises(ValueError, match="combine"):
        staircase.specify([{**BASE, "invalidation": rule}])
    with pytest.raises(ValueError, match="holding"):
        staircase.specify([{**BASE, "exits": {**BASE["exits"], "maxHoldingBars": None}}])


def test_recheck_prices_all_candidates_alike(spark):
    cheap = {**BASE, "id": "cheap", "costs": {**COSTS, "feePercent": 0.1}}
    rows = {(r.candidate_id, r.cohort): r for r in scored(spark, "/root/testdata/sf0.001", [BASE, cheap, *sweep.recheck([cheap])]).collect()}
    assert rows["base", 1].net_pnl == rows["cheap~recheck", 1].net_pnl < rows["cheap", 1].net_pnl


def test_plan_does_not_grow_with_candidates(spark):
    def nodes(count):
        specs = staircase.specify(families()["j9_grid_scores"][:count])
        entries = spark.createDataFrame([], "chain string, ca string, pair_id string, entry_idx long, entry_time long, entry_price double, entry_synthetic boolean, entry_is_last boolean, swing struct<low:double,high:double>, swing_no int, kind int")
        bars = spark.createDataFrame([], "chain string, ca string, pair_id string, idx long, open double, high double, low double, close double, volume double, vmean_10 double, is_last boolean")
        plan = staircase.labels(entries, staircase.staircases(entries, bars, specs), specs.frames(spark)[0])
        return plan._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert nodes(3) == nodes(865)
