"""Entries and their first exit (triple-barrier labelling), independent of any account."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators import crossings
from barloom.functions.levels import bar_exit, stop_level, target_level
from barloom.operators.chain import candidate_chain
from barloom.operators.rules import alternatives, broken_level, compile_rule, explain_rule, features_of, primary_cause, rising_edge
from barloom.operators.indicators import add_features, feature_back, with_ema
from barloom.operators.quality import fill_gaps, index_bars, only_valid
from barloom.operators.swings import SwingRule, bar_order, swing_asof, swing_inputs
from barloom.session import cut, reuse
from barloom.plans.blocks import BLOCK, block_of, cover, halo
from barloom.schemas import OHLCV, POOL


def earliest_signals(events: DataFrame) -> DataFrame:
    """Earliest usable signal per token (missing, negative or non-finite times do not count)."""
    at = F.col("signal_time")
    return events.where(at.isNotNull() & (at >= 0)).groupBy("chain", "ca").agg(F.min(at).alias("signal_time"))


def framed_bars(
    bars: DataFrame, step: int, rule: SwingRule, features: set, gate: DataFrame | None = None, block: int = BLOCK
) -> DataFrame:
    """Valid, indexed, gap-filled bars with pivot and indicator columns, still holding the halo rows.

    Kept for reuse: pair matching, rule evaluation and exit labelling all read it.
    """
    slim = only_valid(bars).select(*POOL, "time", *OHLCV)
    filled = fill_gaps(index_bars(slim, step, block, gate), step).drop("close_time")
    filled = with_ema(filled, [n for kind, n in features if kind == "ema"], block)
    back = max([rule.back, *[feature_back(f) + 1 for f in features]])
    return reuse(swing_inputs(add_features(halo(filled, back, 0, block), features), rule))


def gate_open(delay_minutes: int = 0) -> Column:
    """Bar opens strictly after the signal (plus delay); a token without a signal never opens."""
    if not 0 <= delay_minutes <= 1440:
        raise ValueError("delay must be between 0 and 1440 minutes")
    return F.coalesce(F.col("time") > F.col("signal_time") + delay_minutes * 60_000, F.lit(False))


def mark_entries(
    frame: DataFrame, rule: SwingRule, entry_rule: Mapping, block: int = BLOCK, gated: bool = True, delay_minutes: int = 0
) -> DataFrame:
    """Bars that have a swing, with ``met`` (rule true while allowed) and ``edge`` (true now, not one bar before).

    Bars without a swing can never be met, so only covered bars are joined. The bar before a block is recomputed
    from the halo, which lets the edge look back across the block border. Under the stricter swing rule the candidate is
    locked (``candidate_chain``), and where it changes the edge is armed again.
    """
    locked = rule.version != "legacy-v1"
    allowed = gate_open(delay_minutes) if gated else F.lit(True)
    swings = candidate_chain(frame, rule, block) if locked else swing_asof(frame, rule, block, overlap=1)
    met = F.coalesce(allowed & compile_rule(entry_rule, F.col("swing")), F.lit(False))
    covered = frame.join(swings, [*POOL, "blk", "idx"]).withColumn("met", met)
    order = bar_order()
    before = (F.lag("idx").over(order) == F.col("idx") - 1) & F.lag("met").over(order)
    if locked:
        before = before & (F.col("chosen_idx") < F.col("idx"))
    return covered.withColumn("edge", rising_edge(F.col("met"), before)).where("core").drop("core")


def entries_of(marked: DataFrame) -> DataFrame:
    return marked.where("edge").select(
        *POOL, F.col("idx").alias("entry_idx"), F.col("time").alias("entry_time"), F.col("close").alias("entry_price"),
        F.col("synthetic").alias("entry_synthetic"), F.col("is_last").alias("entry_is_last"), "swing",
    )


def with_levels(entries: DataFrame, exits: Mapping) -> DataFrame:
    low, high = F.col("swing.low"), F.col("swing.high")
    staged = entries.withColumn("stop", stop_level(exits["stopLoss"], F.col("entry_price"), low, high))
    return staged.withColumn("target", target_level(exits["takeProfit"], F.col("entry_price"), F.col("stop"), low, high))


def label_exits(
    entries: DataFrame, bars: DataFrame, exits: Mapping, invalidation: Mapping | None,
    keys: Sequence[str] = (), block: int = 512,
) -> DataFrame:
    """First exit of each entry: a range join on index blocks, then one minimum per entry.

    ``keys`` are extra entry keys (such as a candidate id). An entry meets at most ``maxHoldingBars`` bars, so the
    joined size is bounded by the horizon and the join key carries the block, not only the pool. Without
    ``maxHoldingBars`` the entries are searched by ``label_exits_unlimited``.
    """
    if not exits.get("maxHoldingBars"):
        return label_exits_unlimited(entries, bars, exits, invalidation, keys)
    horizon = int(exits["maxHoldingBars"])
    ident = [*keys, *POOL, "entry_idx"]
    slim = _exit_bars(bars, invalidation).withColumn("_xb", block_of(F.col("idx"), block))
    spread = entries.select(
        *ident, "entry_price", "stop", "target", "swing",
        cover(F.col("entry_idx") + 1, F.col("entry_idx") + horizon, block).alias("_xb"),
    )
    held = spread.join(slim, [*POOL, "_xb"]).where(
        (F.col("idx") > F.col("entry_idx")) & (F.col("idx") <= F.col("entry_idx") + horizon)
    )
    lock = None
    tiers = exits.get("profitLock") or {}
    if tiers.get("enabled"):
        # A close arms its tiers from the next bar on; an entry's partition is at most the horizon long.
        past = Window.partitionBy(*ident).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("_peak", F.max("close").over(past))
        levels = [
            F.when(F.col("_peak") >= F.col("entry_price") * (1 + t["activationPercent"] / 100),
                   F.col("entry_price") * (1 + t["floorPercent"] / 100))
            for t in tiers["tiers"]
        ]
        lock = F.greatest(*levels) if len(levels) > 1 else levels[0]
    swing = F.col("swing")
    invalid = compile_rule(invalidation, swing)
    outcome = bar_exit(
        F.col("entry_price"), F.col("stop"), F.col("target"), invalid,
        (F.col("idx") - F.col("entry_idx")) >= horizon, F.lit(bool(exits.get("closeAtEnd"))) & F.col("is_last"), lock,
    )
    causes = explain_rule(invalidation, swing) if invalidation else F.array()
    cause = F.when(outcome["type"] == "invalidation", primary_cause(causes)) if invalidation else F.lit(None).cast("string")
    firsts = (
        held.withColumn("_out", outcome).where("_out is not null")
        .groupBy(*ident)
        .agg(F.min(F.struct(
            "idx", F.col("time").alias("time"), F.col("_out.type").alias("type"), F.col("_out.price").alias("price"), cause.alias("cause"),
        )).alias("_exit"))
    )
    return _with_exit(entries, firsts, ident, exits)


def label_exits_unlimited(
    entries: DataFrame, bars: DataFrame, exits: Mapping, invalidation: Mapping | None, keys: Sequence[str] = (),
    block: int = crossings.BLOCK, fan: int = crossings.FAN,
) -> DataFrame:
    """``label_exits`` without a holding limit: an entry stays until a level is met or, if ``closeAtEnd``, the pool ends.

    Stop, target, each invalidation and each lock tier is a search for a first crossing; a tier's floor is searched from
    the bar that arms it. The earliest hit is the exit bar, and only that bar is judged. An entry that nothing meets has a
    null exit. Invalidations must be alternatives (any of), not combinations.
    """
    ident, price, swing = [*keys, *POOL, "entry_idx"], F.col("entry_price"), F.col("swing")
    slim = _exit_bars(bars, invalidation)
    metrics = {"fall": -F.least("open", "low"), "rise": F.greatest("open", "high"), "close_fall": -F.col("close"), "close_rise": F.col("close"),
               "last": F.when(F.col("is_last"), F.lit(1.0))}
    wanted = [("fall", -F.col("stop"), False), ("rise", F.when(F.col("target") > price, F.col("target")), False)]
    for leaf in alternatives(invalidation):
        level = broken_level(leaf, swing)
        if level is not None:
            wanted.append(("close_fall", -level, True))
        elif leaf["type"] == "bearish_volume_invalidation":
            name = f"bear_{len(metrics)}"
            metrics[name] = F.when(compile_rule(leaf, None), F.lit(1.0))
            wanted.append((name, F.lit(1.0), False))
        else:
            raise ValueError(f"{leaf['type']} needs a holding limit")
    if exits.get("closeAtEnd"):
        wanted.append(("last", F.lit(1.0), False))
    lock = exits.get("profitLock") or {}
    tiers = lock["tiers"] if lock.get("enabled") else []
    wanted += [("close_rise", price * (1 + t["activationPercent"] / 100), False) for t in tiers]
    first_tier = len(wanted) - len(tiers)
    search = lambda k, metric, threshold, strict: F.struct(
        F.lit(k).alias("search"), F.lit(metric).alias("metric"), threshold.cast("double").alias("threshold"), F.lit(strict).alias("strict"))
    cells = crossings.extremes(slim, metrics, block, fan)
    seek = lambda rows: crossings.first_crossings(rows, cells, list(metrics), [*ident, "search"], block, fan)
    found = seek(entries.select(*ident, "entry_price", F.col("entry_idx").alias("after"), F.explode(F.array(*[search(k, *w) for k, w in enumerate(wanted)])).alias("_w")).select(
        *ident, "after", "_w.*"))
    armed = []
    if tiers:
        found = cut(found, "crossings")
        floors = [F.when(F.col("search") == first_tier + k, price * (1 + t["floorPercent"] / 100)) for k, t in enumerate(tiers)]
        broken = seek(found.where(F.col("search") >= first_tier).join(entries.select(*ident, "entry_price"), ident).select(
            *ident, "search", F.col("hit").alias("after"), F.lit("fall").alias("metric"), (-F.coalesce(*floors)).alias("threshold"), F.lit(False).alias("strict")))
        found = found.select(*ident, "search", "hit").unionByName(broken.select(*ident, F.lit(-1).alias("search"), "hit"))
        armed = [F.min(F.when(F.col("search") == first_tier + k, F.col("hit"))).alias(f"_arm_{k}") for k in range(len(tiers))]
    exit_at = found.groupBy(*ident).agg(F.min(F.when(F.col("search") < first_tier, F.col("hit"))).alias("idx"), *armed)
    levels = [F.when(F.col(f"_arm_{k}") < F.col("idx"), price * (1 + t["floorPercent"] / 100)) for k, t in enumerate(tiers)]
    end = F.lit(bool(exits.get("closeAtEnd"))) & F.col("is_last")
    outcome = bar_exit(price, F.col("stop"), F.col("target"), compile_rule(invalidation, swing), F.lit(False), end,
                       F.greatest(*levels) if len(levels) > 1 else levels[0] if levels else None)
    cause = F.when(outcome["type"] == "invalidation", primary_cause(explain_rule(invalidation, swing))) if invalidation else F.lit(None).cast("string")
    held = entries.select(*ident, "entry_price", "stop", "target", "swing").join(exit_at.where("idx IS NOT NULL"), ident).join(slim, [*POOL, "idx"])
    firsts = held.withColumn("_out", outcome).select(*ident, F.struct(
        "idx", F.col("time").alias("time"), F.col("_out.type").alias("type"), F.col("_out.price").alias("price"), cause.alias("cause")).alias("_exit"))
    return _with_exit(entries, firsts, ident, exits)


def _exit_bars(bars: DataFrame, invalidation: Mapping | None) -> DataFrame:
    wanted = sorted(features_of(invalidation))
    columns = [f"vmean_{n}" if k == "vmean" else f"vols_{n}" if k == "vols" else f"{k}_{n}" for k, n in wanted]
    extra = [c for c in bars.columns if any(c == w or c.startswith(w + "_") or c == f"obv_change_{w.split('_')[-1]}" for w in columns)]
    return bars.select(*POOL, "idx", "time", "open", "high", "low", "close", "volume", "is_last", "prev_open", "prev_close", *extra)


def _with_exit(entries: DataFrame, firsts: DataFrame, ident: Sequence[str], exits: Mapping) -> DataFrame:
    at_end = F.lit(bool(exits.get("closeAtEnd"))) & F.col("entry_is_last")
    return entries.join(firsts, ident, "left").select(
        *entries.columns,
        F.when(at_end, F.col("entry_idx")).otherwise(F.col("_exit.idx")).alias("exit_idx"),
        F.when(at_end, F.col("entry_time")).otherwise(F.col("_exit.time")).alias("exit_time"),
        F.when(at_end, "end_of_backtest").otherwise(F.col("_exit.type")).alias("exit_reason"),
        F.when(at_end, F.col("entry_price")).otherwise(F.col("_exit.price")).alias("exit_price"),
        F.col("_exit.cause").alias("exit_cause"),
    ).withColumn("holding_bars", F.col("exit_idx") - F.col("entry_idx"))


def restore_cause(exits: DataFrame, bars: DataFrame, invalidation: Mapping) -> DataFrame:
    """Rebuild the cause of invalidation exits from the stored bars; refuse where price or time disagree."""
    at = bars.drop("swing").withColumnRenamed("idx", "exit_idx").withColumnRenamed("time", "_time")
    rows = exits.join(at, [*POOL, "exit_idx"], "left").withColumn("idx", F.col("exit_idx"))
    agrees = F.coalesce((F.col("_time") == F.col("exit_time")) & (F.abs(F.col("close") - F.col("exit_price")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("close"))), F.lit(False))
    cause = primary_cause(explain_rule(invalidation, F.col("swing")))
    return rows.select(*exits.columns, F.when(agrees, cause).otherwise("unknown").alias("exit_cause"))
