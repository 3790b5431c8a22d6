"""Whole candidate sets scored with one join of bars.

What a candidate does with an entry depends on its stop and target only through the first bar that reaches them. The lows
since an entry reach a level first where their running minimum passes it, so of all lows only the records count, and likewise
for highs (targets) and closes (invalidation levels). Per entry these records form three short staircases; every candidate
looks its levels up there. Bars meet entries once, however many candidates there are:

    bars -> swings of all rules -> entries of all rules -> staircases per entry -> labels per (entry, spec) -> scores

Candidates are rows: those that agree in swing, entry, exits and costs share one *spec*. The plan grows with the distinct
pivot widths and entry rules of a set (configuration), never with its candidates. Every entry is taken with a fixed amount,
so scores need no account; slots and sizes of a candidate do not change them.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.functions.levels import COSTS, trade_costs
from barloom.operators.labels import framed_bars, gate_open
from barloom.operators.rules import compile_rule, features_of, is_on
from barloom.operators.swings import SwingRule, swing_pairs
from barloom.plans.blocks import BLOCK, block_of, cover
from barloom.schemas import POOL, TOKEN
from barloom.session import cut

SPEC_COLUMNS = """spec int, swing_no int, kind int, stop_type string, stop_value double, stop_buffer double, target_type string, target_value double, lock int,
 hold int, close_at_end boolean, fib_ratio double, fib_buffer double, low_buffer double, bear int, fee double, slippage double, buy_tax double, sell_tax double"""


@dataclass
class Specs:
    """A candidate set as tables: what differs is a row, what is named once is a position in a list."""

    swings: list[SwingRule] = field(default_factory=list)
    kinds: list[tuple[dict, int]] = field(default_factory=list)  # entry rule, delay in minutes
    locks: list[list[dict]] = field(default_factory=list)
    bears: list[tuple[int, float, float]] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    candidates: list[tuple[str, int]] = field(default_factory=list)  # id, spec

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.createDataFrame(self.rows, SPEC_COLUMNS), spark.createDataFrame(self.candidates, "candidate_id string, spec int")


def _place(items: list, item) -> int:
    if item not in items:
        items.append(item)
    return items.index(item)


def _leaves(rule: Mapping | None) -> list[Mapping]:
    """Leaves of an invalidation rule that is a list of alternatives."""
    if not rule or not is_on(rule):
        return []
    if "conditions" not in rule:
        return [rule]
    on = [c for c in rule["conditions"] if is_on(c)]
    if rule["mode"] != "any" and not (rule["mode"] == "at_least" and int(rule.get("minMatches") or 1) <= 1) and len(on) > 1:
        raise ValueError(f"invalidations that combine conditions have no staircase: {rule}")
    return [leaf for c in on for leaf in _leaves(c)]


def specify(candidates: Sequence[Mapping]) -> Specs:
    """The distinct parts of a candidate set. Equal specs are one row."""
    out, seen = Specs(), {}
    for c in candidates:
        exits, costs = c["exits"], c.get("costs", COSTS)
        if not exits.get("maxHoldingBars"):
            raise ValueError(f"{c['id']}: a staircase needs a holding limit")
        stop, target, lock = exits["stopLoss"], exits["takeProfit"], exits.get("profitLock") or {}
        leaves = {kind: [x for x in _leaves(c.get("invalidation")) if x["type"] == kind] for kind in ("break_fib_invalidation", "break_swing_low_invalidation", "bearish_volume_invalidation")}
        if any(len(v) > 1 for v in leaves.values()):
            raise ValueError(f"{c['id']}: one invalidation of a kind at most")
        fib, low, bear = ((v or [None])[0] for v in leaves.values())
        row = (
            _place(out.swings, c["swing"]), _place(out.kinds, (json.loads(json.dumps(c["entry"])), int(c.get("delay", 0)))),
            stop["type"], float(stop.get("value", stop.get("ratio", 0))), float(stop.get("bufferPercent") or 0),
            target["type"], float(target.get("value", target.get("ratio", 0))),
            _place(out.locks, lock["tiers"]) if lock.get("enabled") and lock.get("tiers") else None,
            int(exits["maxHoldingBars"]), bool(exits.get("closeAtEnd")),
            float(fib["ratio"]) if fib else None, float(fib.get("bufferPercent") or 0) if fib else None, float(low.get("bufferPercent") or 0) if low else None,
            _place(out.bears, (bear["period"], float(bear["minRatio"]), float(bear["minBodyPercent"]))) if bear else None,
            *(float(costs[k]) for k in ("feePercent", "slippagePercent", "buyTaxPercent", "sellTaxPercent")))
        if row not in seen:
            seen[row] = len(seen)
            out.rows.append((seen[row], *row))
        out.candidates.append((c["id"], seen[row]))
    return out


def widest(rules: Sequence[SwingRule]) -> SwingRule:
    """A rule whose pairs hold those of all ``rules``, which must agree in everything but gain, duration and look-back."""
    return replace(rules[0], lookback=max(r.lookback for r in rules), max_duration=max(r.max_duration for r in rules), min_gain=min(r.min_gain for r in rules))


def family(rule: SwingRule) -> tuple:
    return rule.left, rule.right, rule.volume_expansion, rule.expansion_ratio, rule.version, rule.enabled


def swings_of_rules(frame: DataFrame, rules: Mapping[int, SwingRule], block: int) -> DataFrame:
    """(pool, blk, idx, ``swing_no``) -> ``swing``: the latest high, then the latest low, for every rule of one family at once.

    One bar before the block is answered, too.
    """
    at = [*POOL, "blk", "swing_no"]
    bounds = F.array(*(F.struct(F.lit(n).alias("swing_no"), F.lit(r.lookback).alias("lookback"), F.lit(float(r.min_gain)).alias("min_gain"), F.lit(r.max_duration).alias("max_duration"))
                       for n, r in rules.items()))
    span = F.col("high_idx") - F.col("low_idx")
    pairs = swing_pairs(frame, widest(list(rules.values()))).withColumn("_r", F.explode(bounds))
    pairs = pairs.where((F.col("gain_percent") >= F.col("_r.min_gain")) & (span <= F.col("_r.max_duration")))
    pairs = pairs.withColumn("swing_no", F.col("_r.swing_no")).withColumn("ends_at", F.col("low_idx") + F.col("_r.lookback") - 1)
    body = F.struct("high_idx", "low_idx", "ends_at", "low", "high", "average_volume", "confirmed_idx")
    best = pairs.groupBy(*at, "high_idx").agg(F.max(F.struct("low_idx", body.alias("b"))).alias("_p")).select(*at, "_p.b.*")
    first = F.greatest(F.col("confirmed_idx"), F.col("blk") * block - 1)
    last = F.least(F.col("ends_at"), F.col("blk") * block + (block - 1))
    return best.where(first <= last).withColumn("idx", F.explode(F.sequence(first, last))).groupBy(*at, "idx").agg(F.max(body).alias("swing"))


def entries_of_rules(bars: DataFrame, gate: DataFrame, specs: Specs, step: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(entries of every used pair of ``swing_no`` and ``kind``, prepared bars)."""
    if any(r.version != "legacy-v1" for r in specs.swings):
        raise ValueError("staircases follow the legacy swing rule")
    features = set().union(*(features_of(rule) for rule, _ in specs.kinds), *({("vmean", period)} for period, _, _ in specs.bears))
    used = sorted({row[1] * len(specs.kinds) + row[2] for row in specs.rows})
    parts, core = [], None
    for key in dict.fromkeys(map(family, specs.swings)):
        rules = {n: r for n, r in enumerate(specs.swings) if family(r) == key}
        frame = framed_bars(bars, step, widest(list(rules.values())), features, gate, block)
        covered = frame.join(swings_of_rules(frame, rules, block), [*POOL, "blk", "idx"])
        met = F.array(*(F.coalesce(gate_open(delay) & compile_rule(rule, F.col("swing")), F.lit(False)) for rule, delay in specs.kinds))
        order = Window.partitionBy(*POOL, "blk", "swing_no").orderBy("idx")
        before = F.lag(F.struct("idx", "met")).over(order)
        marked = covered.withColumn("met", met).withColumn("_before", before)
        rose = F.transform("met", lambda now, k: now & ~F.coalesce((F.col("_before.idx") == F.col("idx") - 1) & F.get(F.col("_before.met"), k), F.lit(False)))
        rows = marked.where("core").select(
            *POOL, F.col("idx").alias("entry_idx"), F.col("time").alias("entry_time"), F.col("close").alias("entry_price"), F.col("synthetic").alias("entry_synthetic"),
            F.col("is_last").alias("entry_is_last"), "swing", "swing_no", F.posexplode(rose).alias("kind", "edge"))
        parts.append(rows.where(F.col("edge") & (F.col("swing_no") * len(specs.kinds) + F.col("kind")).isin(used)).drop("edge"))
        core = frame.where("core") if core is None else core
    return cut(reduce(DataFrame.unionByName, parts), "stair-entries"), core


def staircases(entries: DataFrame, bars: DataFrame, specs: Specs, block: int = 512) -> DataFrame:
    """Per (pool, entry): records of falling lows, rising highs and falling closes, and the few other bars that exits read.

    ``lows`` and ``highs`` hold (offset, level, open), ``closes`` and ``holds`` (offset, level). ``bears`` and ``locks`` hold the
    first bar of each bearish-volume rule and of each list of lock tiers. An entry meets as many bars as the longest holding.
    """
    horizon = max(row[9] for row in specs.rows)
    holds = sorted({row[9] for row in specs.rows})
    ident = [*POOL, "entry_idx"]
    points = entries.select(*ident, "entry_price", cover(F.col("entry_idx") + 1, F.col("entry_idx") + horizon, block).alias("_xb")).distinct()
    means = sorted({f"vmean_{period}" for period, _, _ in specs.bears})
    slim = bars.select(*POOL, "idx", "open", "high", "low", "close", "volume", "is_last", *means, block_of(F.col("idx"), block).alias("_xb"))
    offset = (F.col("idx") - F.col("entry_idx")).cast("int")
    held = points.join(slim, [*POOL, "_xb"]).withColumn("offset", offset).where((F.col("offset") > 0) & (F.col("offset") <= horizon))
    past = Window.partitionBy(*ident).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("*", F.min("low").over(past).alias("_low"), F.max("high").over(past).alias("_high"), F.min("close").over(past).alias("_close"), F.max("close").over(past).alias("_peak"))

    def record(level: str, new: Column, *more: str) -> Column:
        return F.sort_array(F.collect_list(F.when(new, F.struct("offset", F.col(level).alias("level"), *more))))

    def first(test: Column, *values: Column) -> Column:
        return F.min(F.when(test, F.struct("offset", *values)))

    none = F.lit(None)
    body = F.when(F.col("open") > 0, (F.col("open") - F.col("close")) / F.col("open") * 100).otherwise(0.0)
    bears = [first((F.col("close") < F.col("open")) & (body >= least) & (F.col("volume") >= F.col(f"vmean_{period}") * ratio), F.col("close").alias("level")) for period, ratio, least in specs.bears]
    locks = []
    for tiers in specs.locks:
        armed = [F.when(F.col("_peak") >= F.col("entry_price") * (1 + t["activationPercent"] / 100), F.col("entry_price") * (1 + t["floorPercent"] / 100)) for t in tiers]
        floor = F.greatest(*armed) if len(armed) > 1 else armed[0]
        locks.append(first(F.col("low") <= floor, floor.alias("level"), F.least("open", floor).alias("price")))
    return held.groupBy(*ident).agg(
        record("low", F.col("_low").isNull() | (F.col("low") < F.col("_low")), "open").alias("lows"),
        record("high", F.col("_high").isNull() | (F.col("high") > F.col("_high")), "open").alias("highs"),
        record("close", F.col("_close").isNull() | (F.col("close") < F.col("_close"))).alias("closes"),
        record("close", F.col("offset").isin(holds)).alias("holds"),
        first(F.col("is_last"), F.col("close").alias("level")).alias("last"),
        F.array(*bears).alias("bears") if bears else none.cast("array<struct<offset:int,level:double>>").alias("bears"),
        F.array(*locks).alias("locks") if locks else none.cast("array<struct<offset:int,level:double,price:double>>").alias("locks"))


def labels(entries: DataFrame, stairs: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per entry and spec: its levels and its first exit (null where data end before one)."""
    low, high, price = F.col("swing.low"), F.col("swing.high"), F.col("entry_price")

    def fib(ratio: Column) -> Column:
        return high - (high - low) * ratio

    def buffered(level: Column, percent: str) -> Column:
        return level * (1 - F.col(percent) / 100)

    stop = F.when(F.col("stop_type") == "percent", price * (1 - F.col("stop_value") / 100)).when(
        F.col("stop_type") == "swing_low", buffered(low, "stop_buffer")).otherwise(buffered(fib(F.col("stop_value")), "stop_buffer"))
    target = F.when(F.col("target_type") == "percent", price * (1 + F.col("target_value") / 100)).when(
        F.col("target_type") == "risk_reward", price + F.greatest(F.lit(0.0), price - F.col("stop")) * F.col("target_value")).when(
        F.col("target_type") == "previous_high", high).otherwise(fib(F.col("target_value")))
    broken = F.greatest(buffered(fib(F.col("fib_ratio")), "fib_buffer"), buffered(low, "low_buffer"))
    rows = entries.join(stairs, [*POOL, "entry_idx"], "left").join(specs, ["swing_no", "kind"])
    rows = rows.withColumn("stop", stop).withColumn("target", target).withColumn("broken", broken)

    def step(stairs: str, test) -> Column:
        return F.get(F.filter(stairs, test), F.lit(0))

    rows = rows.withColumns({
        "_s": step("lows", lambda x: x["level"] <= F.col("stop")), "_t": F.when(F.col("target") > price, step("highs", lambda x: x["level"] >= F.col("target"))),
        "_v": step("closes", lambda x: x["level"] < F.col("broken")), "_b": F.get("bears", F.col("bear")), "_k": F.get("locks", F.col("lock")),
        "_h": step("holds", lambda x: x["offset"] == F.col("hold")), "_e": F.when(F.col("close_at_end"), F.col("last"))})

    def end(at: str, rank: Column | int, reason: str, paid: Column) -> Column:
        rank = F.lit(rank) if isinstance(rank, int) else rank
        return F.when(F.col(at).isNotNull(), F.struct(F.col(f"{at}.offset").alias("offset"), rank.alias("rank"), F.lit(reason).alias("reason"), paid.alias("price")))

    # On one bar a lock above the stop goes first, then stop, invalidation, target, time and end of data.
    above = F.when(F.col("_k.level") > F.col("stop"), 0).otherwise(2)
    found = F.array(
        end("_k", above, "profit_lock", F.col("_k.price")), end("_s", 1, "stop_loss", F.least("_s.open", "stop")), end("_v", 3, "invalidation", F.col("_v.level")),
        end("_b", 3, "invalidation", F.col("_b.level")), end("_t", 4, "take_profit", F.greatest("_t.open", "target")), end("_h", 5, "timeout", F.col("_h.level")),
        end("_e", 6, "end_of_backtest", F.col("_e.level")))
    at_once = F.col("close_at_end") & F.col("entry_is_last")
    rows = rows.withColumn("_x", F.array_min(F.filter(found, lambda x: x.isNotNull())))
    return rows.select(
        "spec", *POOL, "entry_idx", "entry_time", "entry_price", "entry_synthetic", "stop", "target",
        F.when(at_once, 0).otherwise(F.col("_x.offset")).alias("holding_bars"), F.when(at_once, "end_of_backtest").otherwise(F.col("_x.reason")).alias("exit_reason"),
        F.when(at_once, price).otherwise(F.col("_x.price")).alias("exit_price"), "fee", "slippage", "buy_tax", "sell_tax")


def score_specs(labelled: DataFrame, cohorts: DataFrame, amount: float) -> DataFrame:
    """Per spec and cohort: closed trades and their results, first summed by token."""
    costs = {"feePercent": F.col("fee"), "slippagePercent": F.col("slippage"), "buyTaxPercent": F.col("buy_tax"), "sellTaxPercent": F.col("sell_tax")}
    money = trade_costs(F.lit(float(amount)), F.col("entry_price"), F.col("exit_price"), costs)
    trades = labelled.where("exit_reason IS NOT NULL").join(cohorts, TOKEN).withColumns({"net": money["net_pnl"], "fees": money["fees"]})
    net, normal = F.col("net"), F.col("exit_reason") != "end_of_backtest"
    one = F.lit(1)
    tokens = trades.groupBy("spec", "cohort", *TOKEN).agg(
        F.count(one).alias("total_trades"), F.count_if(net > 0).alias("wins"), F.sum("net").alias("net_pnl"), F.count_if(~normal).alias("excluded_count"),
        F.sum(F.when(~normal, net).otherwise(0.0)).alias("excluded_net"), F.sum(F.when(net > 0, net).otherwise(0.0)).alias("gain"), F.sum(F.when(net > 0, 0.0).otherwise(-net)).alias("loss"),
        F.sum("fees").alias("fees"), F.count_if("entry_synthetic").alias("synthetic_entries"), F.sum("holding_bars").alias("bars_held"), F.sum(F.when(normal, net)).alias("_normal"))
    sums = ["total_trades", "wins", "net_pnl", "excluded_count", "excluded_net", "gain", "loss", "fees", "synthetic_entries", "bars_held"]
    best = F.max(F.when(F.col("_normal") > 0, F.struct("_normal", F.concat_ws(":", *TOKEN).alias("token"))))
    return tokens.groupBy("spec", "cohort").agg(*(F.sum(c).alias(c) for c in sums), best.alias("_best"))


def score_candidates(bars: DataFrame, gate: DataFrame, cohorts: DataFrame, candidates: Sequence[Mapping], step: int, amount: float = 100.0, block: int = BLOCK) -> DataFrame:
    """One row per candidate and cohort, also without trades, each entry bought for ``amount``.

    ``cohorts`` has token and ``cohort``. Candidates and cohort numbers are configuration.
    """
    specs = specify(candidates)
    spec_rows, named = specs.frames(bars.sparkSession)
    entries, core = entries_of_rules(bars, gate, specs, step, block)
    stairs = cut(staircases(entries, core, specs), "stairs")
    scored = score_specs(labels(entries, stairs, spec_rows), cohorts, amount)
    counted = ["total_trades", "wins", "net_pnl", "excluded_count", "excluded_net", "gain", "loss", "fees", "synthetic_entries", "bars_held"]
    every = named.join(cohorts.select("cohort").distinct())
    return every.join(scored, ["spec", "cohort"], "left").na.fill(0, counted).select(
        "candidate_id", "cohort", *counted, (F.col("wins") / F.when(F.col("total_trades") > 0, F.col("total_trades"))).alias("win_rate"),
        (F.col("gain") / F.when(F.col("loss") > 0, F.col("loss"))).alias("profit_factor"), F.col("_best.token").alias("top_token"),
        F.coalesce(F.col("_best._normal"), F.lit(0.0)).alias("top_token_pnl"), (F.col("total_trades") < 10).alias("low_sample"))
