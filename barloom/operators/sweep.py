"""Candidate grids and their scoring over token cohorts.

Candidates are configuration (tens to thousands of small rows). Bars are prepared once per swing rule, entries once
per entry rule, and only entries, never bars, are multiplied by candidates.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions.levels import COSTS
from barloom.operators.account import account_drawdown, allocate, equity_curve, with_money
from barloom.operators.labels import entries_of, framed_bars, label_exits, mark_entries, with_levels
from barloom.operators.rules import features_of
from barloom.operators.swings import SwingRule
from barloom.plans.blocks import BLOCK
from barloom.schemas import POOL, TOKEN
from barloom.session import cut, reuse

# The costs a finished study is rechecked with, whatever its candidates were scored with.
FIXED_COSTS = {"feePercent": 1.0, "slippagePercent": 1.0, "buyTaxPercent": 1.0, "sellTaxPercent": 1.0}

# Fixed values of the published 864-candidate grid.
FIB = {"type": "fib_retracement", "zoneLow": 0.618, "zoneHigh": 0.786}
PERCENT = {"type": "percent_retracement", "minPercent": 30, "maxPercent": 50}
VOLUME = {"type": "volume_contraction", "period": 10, "maxRatio": 0.7}
BULL = {"type": "bullish_volume_confirmation", "period": 10, "minRatio": 1.5}
PATTERN = {"type": "candle_pattern", "patterns": ["hammer", "bullish_engulfing", "pin_bar", "long_lower_wick"]}
RSI = {"type": "rsi_recovery", "period": 14, "oversold": 30, "recovery": 35}
OBV = {"type": "obv_confirmation", "lookbackBars": 10, "minChangePercent": 0}
STOPS = [{"type": "percent", "value": 50}, {"type": "fib_level", "ratio": 0.886, "bufferPercent": 2}, {"type": "swing_low", "bufferPercent": 2}]
TARGETS = [{"type": "percent", "value": 100}, {"type": "risk_reward", "ratio": 4}, {"type": "fib_target", "ratio": 0.382}, {"type": "previous_high"}]
SIZES = [{"type": "fixed_amount", "value": 100}, {"type": "fixed_percent", "value": 0.1}, {"type": "risk_percent", "value": 0.1}]
INVALIDATION = {"mode": "any", "conditions": [
    {"type": "break_fib_invalidation", "ratio": 0.886, "bufferPercent": 0}, {"type": "break_swing_low_invalidation", "bufferPercent": 0},
    {"type": "bearish_volume_invalidation", "period": 10, "minRatio": 2, "minBodyPercent": 20}]}


def ema_rule(period: int) -> dict:
    return {"type": "ema_reclaim", "period": period}


def group(mode: str, *conditions: Mapping, at_least: int | None = None) -> dict:
    return {"mode": mode, "conditions": list(conditions), **({"minMatches": at_least} if at_least else {})}


#: The published grid as axes: every axis lists the parts of a configuration that one choice replaces.
def grid_axes(base: Mapping) -> dict[str, list[dict]]:
    tiers = (base["exits"].get("profitLock") or {}).get("tiers", [])
    momentum = group("any", RSI, ema_rule(21), OBV)
    entries = [
        group("all", FIB), dict(base["entry"]), group("all", FIB, RSI, ema_rule(9)),
        group("all", FIB, group("at_least", VOLUME, PATTERN, OBV, at_least=2)), group("all", PERCENT, VOLUME, BULL), group("all", PERCENT, momentum)]
    return {
        "entry": [{"entry": e} for e in entries], "stop": [{"exits": {"stopLoss": x}} for x in STOPS], "target": [{"exits": {"takeProfit": x}} for x in TARGETS],
        "size": [{"sizing": x} for x in SIZES], "adds": [{"max_entries": n} for n in (1, 2)],
        "lock": [{"exits": {"profitLock": {"enabled": on, "tiers": tiers}}} for on in (False, True)]}


#: What all rows of the grid share.
GRID_FIXED = {"invalidation": INVALIDATION, "max_positions": 1, "allow_reentry": True, "exits": {"maxHoldingBars": 200, "closeAtEnd": True}}


def overlay(config: Mapping, part: Mapping) -> dict:
    """``config`` with the values of ``part``; exits are replaced field by field."""
    return {**config, **part, **({"exits": {**config.get("exits", {}), **part["exits"]}} if "exits" in part else {})}


def axis_frame(spark: SparkSession, axes: Mapping[str, Sequence]) -> DataFrame:
    """One row per combination: ``candidate_id`` and the ordinal on each axis, read off the row number digit by digit."""
    total, columns = 1, {}
    for name, values in axes.items():
        columns[name] = (F.floor(F.col("id") / total) % len(values)).cast("int")
        total *= len(values)
    return spark.range(total).withColumns(columns).select(F.concat(F.lit("G"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("candidate_id"), *axes)


def chosen(base: Mapping, axes: Mapping[str, Sequence[Mapping]], rows: Sequence[Mapping]) -> list[dict]:
    """Configurations of rows of ``axis_frame``."""
    made = []
    for row in rows:
        config = overlay(base, GRID_FIXED)
        for name, values in axes.items():
            config = overlay(config, values[row[name]])
        made.append({**config, "id": row["candidate_id"]})
    return made


def grid(spark: SparkSession, base: Mapping, where: str = "true") -> list[dict]:
    """The base as a control, then the combinations that satisfy a condition on the axes."""
    axes = grid_axes(base)
    return [{**base, "id": "CONTROL"}, *chosen(base, axes, axis_frame(spark, axes).where(where).orderBy("candidate_id").collect())]


def whole_grid(base: Mapping) -> list[dict]:
    """The base as a control and every combination of the grid: 865 rows of configuration, numbered as in ``axis_frame``."""
    axes = grid_axes(base)
    total, made = math.prod(map(len, axes.values())), []
    for number in range(total):
        rest, row = number, {"candidate_id": f"G{number:05d}"}
        for name, options in axes.items():
            rest, row[name] = divmod(rest, len(options))
        made += chosen(base, axes, [row])
    return [{**base, "id": "CONTROL"}, *made]


def plain(candidate: Mapping) -> dict:
    return {k: (v.as_dict() if isinstance(v, SwingRule) else v) for k, v in candidate.items()}


def candidate_frame(spark: SparkSession, candidates: Sequence[Mapping]) -> DataFrame:
    """Id, canonical configuration text and checksum of each candidate."""
    rows = [(c["id"], json.dumps({k: v for k, v in plain(c).items() if k != "id"}, sort_keys=True)) for c in candidates]
    return spark.createDataFrame(rows, "candidate_id string, config string").withColumn("checksum", F.sha2("config", 256))


# Fixed values of the neighborhood search.
HOLDS = [30, 60, 180, 240, 480]
GAINS = [50, 80, 120, 150, 200]
ZONES = [(0.382, 0.618), (0.5, 0.65), (0.5, 0.786), (0.618, 0.65), (0.618, 0.786), (0.65, 0.886), (0.786, 0.886)]
NEAR_STOPS = [*[{"type": "percent", "value": v} for v in (10, 15, 20, 30, 40)], *STOPS[1:]]
NEAR_TARGETS = [*[{"type": "risk_reward", "ratio": r} for r in (2, 3, 4, 6)], *[{"type": "percent", "value": v} for v in (50, 100, 200)], {"type": "previous_high"}]


def neighborhood(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """Random combinations around a base: one row per number, each field picked by a hash of (seed, number, field)."""
    fields = {
        "pivot": [2, 3, 5], "lookback": [100, 200, 300], "min_gain": [50, 80, 100, 150, 200], "max_duration": [20, 30, 60, 100],
        "zone": [json.dumps(z) for z in ZONES], "stop": [json.dumps(s) for s in NEAR_STOPS], "target": [json.dumps(t) for t in NEAR_TARGETS],
        "max_holding": [30, 60, 120, 240, 480], "max_positions": [1, 1, 2, 3], "allow_reentry": [True, True, False], "size": [1, 1, 2, 3]}
    def pick(name: str, options: list):
        index = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(name)), F.lit(len(options))).cast("int")
        return F.array(*[F.lit(o) for o in options])[index].alias(name)
    made = spark.range(count).select("id", *[pick(n, o) for n, o in fields.items()])
    config = F.to_json(F.struct(*fields))
    return made.withColumn("checksum", F.sha2(config, 256)).dropDuplicates(["checksum"])


def neighbour_factors() -> dict[str, list]:
    """The fields that a neighbour of a base changes, one at a time, with their values."""
    zones = [group("all", {"type": "fib_retracement", "zoneLow": low, "zoneHigh": high}, group("any", RSI, ema_rule(21), OBV)) for low, high in ZONES]
    return {
        "min_gain": [float(g) for g in GAINS], "pivot": [2, 3, 5], "lookback": [60, 150, 300], "max_duration": [20, 60, 100], "entry": zones,
        "stopLoss": NEAR_STOPS, "takeProfit": NEAR_TARGETS, "maxHoldingBars": HOLDS, "max_positions": [2, 3], "allow_reentry": [False]}


def with_factor(base: Mapping, name: str, value) -> dict:
    """``base`` with one field set. A swing never lasts longer than its look-back: the field not set gives way."""
    swing = base["swing"]
    if name == "pivot":
        return {**base, "swing": replace(swing, left=value, right=value)}
    if name == "lookback":
        return {**base, "swing": replace(swing, lookback=value, max_duration=min(value, swing.max_duration))}
    if name == "max_duration":
        return {**base, "swing": replace(swing, max_duration=value, lookback=max(value, swing.lookback))}
    if name == "min_gain":
        return {**base, "swing": replace(swing, min_gain=value)}
    return overlay(base, {"exits": {name: value}} if name in base["exits"] else {name: value})


def checksum(config: Mapping) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in plain(config).items() if k != "id"}, sort_keys=True).encode()).hexdigest()


def neighbours(base: Mapping) -> list[dict]:
    """The base and every different configuration one factor away from it."""
    found = {checksum(base): {**base, "id": "N-base"}}
    for name, values in neighbour_factors().items():
        for ordinal, value in enumerate(values):
            config = with_factor(base, name, value)
            found.setdefault(checksum(config), {**config, "id": f"N-{name}-{ordinal}"})
    return list(found.values())


def rotate_invalidations(candidates: Sequence[Mapping], keep: int) -> list[dict]:
    """Every fifth candidate after the kept ones gets the next invalidation of a fixed rotation."""
    options = [group("any"), group("any", {"type": "break_fib_invalidation", "ratio": 0.886}), group("any", {"type": "break_swing_low_invalidation", "bufferPercent": 2}),
               group("any", {"type": "bearish_volume_invalidation", "period": 10, "minRatio": 2, "minBodyPercent": 20})]
    return [{**c, "invalidation": options[i // 5 % 4]} if i >= keep and i % 5 == 0 else dict(c) for i, c in enumerate(candidates)]


def evenly_spaced(candidates: Sequence[Mapping], count: int) -> list[Mapping]:
    return [candidates[i * (len(candidates) - 1) // (count - 1)] for i in range(count)]


def shard(candidates: DataFrame, index: int, total: int) -> DataFrame:
    return candidates.where(F.pmod(F.xxhash64("candidate_id"), F.lit(total)) == index)


def delay_variants(base: Mapping, delays: Sequence[int]) -> list[dict]:
    return [{**base, "id": f"{base['id']}-D{d}-{'R' if r else 'N'}", "delay": d, "allow_reentry": r} for d in delays for r in (True, False)]


def exit_grid(base: Mapping, stops: Sequence[Mapping], targets: Sequence[Mapping], holds: Sequence[int]) -> list[dict]:
    return [{**base, "id": f"{base['id']}-X{a}{b}{c}", "exits": {**base["exits"], "stopLoss": s, "takeProfit": t, "maxHoldingBars": h}}
            for a, s in enumerate(stops) for b, t in enumerate(targets) for c, h in enumerate(holds)]


def stress_variants(candidate: Mapping) -> list[dict]:
    """One point more slippage, gain bound up and down a tenth, a fifth shorter holding."""
    costs, swing, exits = candidate.get("costs", COSTS), candidate["swing"], candidate["exits"]
    gain = lambda f: SwingRule(**{**swing.as_dict(), "min_gain": swing.min_gain * f})
    return [
        {**candidate, "id": f"{candidate['id']}~slip", "costs": {**costs, "slippagePercent": costs["slippagePercent"] + 1}},
        {**candidate, "id": f"{candidate['id']}~gain+", "swing": gain(1.1)}, {**candidate, "id": f"{candidate['id']}~gain-", "swing": gain(0.9)},
        {**candidate, "id": f"{candidate['id']}~hold", "exits": {**exits, "maxHoldingBars": max(1, int(exits["maxHoldingBars"] * 0.8))}}]


def recheck(candidates: Sequence[Mapping]) -> list[dict]:
    """The candidates under the fixed costs."""
    return [{**c, "id": f"{c['id']}~recheck", "costs": FIXED_COSTS} for c in candidates]


def labelled_candidates(bars: DataFrame, gate: DataFrame, candidates: Sequence[Mapping], step: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(labelled entries of every candidate, prepared bars). Work is shared wherever configurations agree."""
    parts, frames = [], {}
    for swing in dict.fromkeys(c["swing"] for c in candidates):
        mine = [c for c in candidates if c["swing"] == swing]
        features = set().union(*[features_of(c["entry"]) | features_of(c.get("invalidation")) for c in mine])
        frame = frames[swing] = framed_bars(bars, step, swing, features, gate, block)
        by_entry: dict = {}
        for c in mine:
            by_entry.setdefault((json.dumps(c["entry"], sort_keys=True), c.get("delay", 0)), []).append(c)
        for (_, delay), same in by_entry.items():
            entries = cut(entries_of(mark_entries(frame, swing, same[0]["entry"], block, True, delay)), "entries")
            for c in same:
                done = label_exits(with_levels(entries, c["exits"]), frame.where("core"), c["exits"], c.get("invalidation"))
                parts.append(done.withColumn("candidate_id", F.lit(c["id"])))
    union = reduce(DataFrame.unionByName, parts)
    return union, next(iter(frames.values())).where("core")


def sweep(bars: DataFrame, gate: DataFrame, cohorts: DataFrame, candidates: Sequence[Mapping], step: int, capital: float = 10_000.0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(scores, accepted trades) of every candidate on every cohort; ``cohorts`` has token and ``cohort``."""
    if adding := [c["id"] for c in candidates if c.get("max_entries", 1) > 1]:
        raise ValueError(f"candidates that add to positions cannot be scored: {adding[:5]}")
    labelled, core = labelled_candidates(bars, gate, candidates, step, block)
    # Scores read these small tables many times; storing them keeps each later plan short.
    placed, core = cut(labelled.join(cohorts, TOKEN), "labels"), cut(core.select(*POOL, "idx", "time", "close"), "core")
    key = ["candidate_id", "cohort"]
    rules = {"capital": capital, "max_positions": 3, "sizing": {"type": "fixed_percent", "value": 2}, "costs": COSTS}
    own = {c["id"]: {k: c[k] for k in ("max_positions", "sizing", "costs", "allow_reentry") if k in c} for c in candidates}
    accepted = allocate(placed, rules, key, own)
    # Costs differ only in stressed candidates; rows of equal costs are priced together.
    priced = []
    for text in dict.fromkeys(json.dumps(c.get("costs", COSTS), sort_keys=True) for c in candidates):
        ids = [c["id"] for c in candidates if json.dumps(c.get("costs", COSTS), sort_keys=True) == text]
        priced.append(with_money(accepted.where(F.col("candidate_id").isin(ids)), json.loads(text)))
    trades = cut(reduce(DataFrame.unionByName, priced), "trades")
    return score(trades, core, cohorts, candidates, capital), trades


def score(trades: DataFrame, core: DataFrame, cohorts: DataFrame, candidates: Sequence[Mapping], capital: float) -> DataFrame:
    key = ["candidate_id", "cohort"]
    net, normal = F.col("net_pnl"), F.col("exit_reason") != "end_of_backtest"
    main = trades.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_trades"), F.sum(net).alias("net_pnl"), (F.sum(net) / capital * 100).alias("account_return"),
        (F.sum(F.when(normal, net).otherwise(0.0)) / capital * 100).alias("normal_return"), (F.count_if(net > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.count_if(normal).alias("normal_trades"), F.count_if(~normal).alias("excluded_count"), F.sum(F.when(~normal, net).otherwise(0.0)).alias("excluded_net"),
        F.sum(F.when(net > 0, net).otherwise(0.0)).alias("_gain"), (-F.sum(F.when(net > 0, 0.0).otherwise(net))).alias("_loss"),
        F.sum("fees").alias("fees"), F.sum("slippage_cost").alias("slippage_cost"), F.sum("tax_cost").alias("tax_cost"),
        F.count_if("entry_synthetic").alias("synthetic_entries"), F.sum(F.when(F.col("entry_synthetic"), net).otherwise(0.0)).alias("synthetic_net"))
    tokens = trades.where(normal).groupBy(*key, *TOKEN).agg(F.sum(net).alias("token_net"))
    best = tokens.groupBy(*key).agg(F.max(F.struct("token_net", F.concat_ws(":", *TOKEN).alias("token"))).alias("b"))
    curve = account_drawdown(equity_curve(trades, core, capital, key), capital, key)
    falls = curve.groupBy(*key).agg(F.max("drawdown_percent").alias("max_drawdown"), F.min("cash").alias("min_cash"))
    top = F.greatest(F.lit(0.0), F.coalesce("b.token_net", F.lit(0.0)))
    # Every candidate has a row on every cohort; both lists are configuration.
    every = cohorts.select("cohort").distinct().withColumn("candidate_id", F.explode(F.array(*[F.lit(c["id"]) for c in candidates])))
    counted = [c for c in main.columns if c not in (*key, "win_rate")]
    return (
        every.join(main, key, "left").na.fill(0, counted).join(best, key, "left").join(falls, key, "left")
        .withColumn("max_drawdown", F.coalesce("max_drawdown", F.lit(0.0))).withColumn("min_cash", F.coalesce("min_cash", F.lit(float(capital))))
        .withColumn("profit_factor", F.when(F.col("_loss") > 0, F.col("_gain") / F.when(F.col("_loss") > 0, F.col("_loss"))))
        .withColumn("top_token", F.when(top > 0, F.col("b.token"))).withColumn("top_token_pnl", top)
        .withColumn("without_top_return", F.col("normal_return") - top / capital * 100)
        .withColumn("low_sample", F.col("total_trades") < 10).drop("_gain", "_loss", "b"))


def leave_best_out(trades: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Per candidate and cohort the most profitable token: its share of the net, to be removed before rescoring."""
    key = ["candidate_id", "cohort"]
    tokens = trades.groupBy(*key, *TOKEN).agg(F.sum("net_pnl").alias("token_net"))
    totals = tokens.groupBy(*key).agg(F.sum("token_net").alias("net"), F.max(F.struct("token_net", *TOKEN)).alias("b"))
    return totals.where("b.token_net > 0").select(*key, "b.chain", "b.ca", F.col("b.token_net").alias("best_net"), F.when(F.col("net") > 0, F.col("b.token_net") / F.col("net")).alias("share"))


def rescore_without_best(labelled: DataFrame, best: DataFrame, rules: Mapping, capital: float, overrides: Mapping | None = None) -> DataFrame:
    """Replay each account without its best token: the freed cash and slots can change every later trade."""
    key = ["candidate_id", "cohort"]
    left = labelled.join(best.select(*key, *TOKEN), [*key, *TOKEN], "left_anti")
    money = with_money(allocate(left, rules, key, overrides), rules.get("costs", COSTS))
    return money.groupBy(*key).agg(F.count(F.lit(1)).alias("total_trades"), (F.sum("net_pnl") / capital * 100).alias("account_return"))


def exit_breakdown(trades: DataFrame) -> DataFrame:
    return trades.groupBy("candidate_id", "cohort", "exit_reason").agg(F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("net_pnl"))
