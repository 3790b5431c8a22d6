"""Swing detection on gap-filled, block-framed bars.

Everything here is window expressions over one (pool, block) partitioning: pivots, candidate lows per high,
and the swing selectable at each bar. A pair does not depend on the bar that asks for it; it is selectable on an
interval, so "latest high, then latest low" is a look at the pairs whose interval covers the bar.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barloom.plans.blocks import block_of, cover
from barloom.schemas import POOL


@dataclass(frozen=True)
class SwingRule:
    left: int = 2
    right: int = 2
    lookback: int = 60
    min_gain: float = 50.0
    max_duration: int = 40
    volume_expansion: bool = False
    expansion_ratio: float = 1.5
    version: str = "legacy-v1"
    enabled: bool = True

    @property
    def baseline(self) -> int:
        return max(5, 2 * self.left)

    @property
    def back(self) -> int:
        """Rows before a bar that can influence its swing."""
        return self.lookback + max(self.left, self.baseline) + 2

    def as_dict(self) -> dict:
        return asdict(self)


def bar_order() -> WindowSpec:
    return Window.partitionBy(*POOL, "blk").orderBy("idx")


def pivots(frame: DataFrame, left: int, right: int) -> DataFrame:
    """Ties qualify on both sides; the whole neighbourhood must exist. Usable from ``idx + right`` on."""
    around = bar_order().rowsBetween(-left, right)
    full = (F.col("idx") >= left) & F.lead("idx", right).over(bar_order()).isNotNull()
    return frame.withColumn("low_pivot", full & (F.col("low") <= F.min("low").over(around))).withColumn(
        "high_pivot", full & (F.col("high") >= F.max("high").over(around))
    )


def swing_inputs(frame: DataFrame, rule: SwingRule) -> DataFrame:
    """Pivot flags plus what pair matching reads; one pass over the frame, shared by every later step."""
    order = bar_order()
    recent = order.rowsBetween(-rule.max_duration, -1)
    staged = pivots(frame, rule.left, rule.right).select(
        "*",
        F.sum("volume").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("vol_upto"),
        F.min(F.when(F.col("low_pivot") & (F.col("low") > 0), F.col("low"))).over(recent).alias("lowest_pivot"),
        F.avg("volume").over(order.rowsBetween(-rule.baseline, -1)).alias("vol_base"),
    )
    if rule.version == "legacy-v1":
        return staged
    # The stricter rule also needs the last higher high before, and the closes after, a candidate high.
    return staged.select(
        "*",
        F.collect_list(F.struct("idx", "high")).over(recent).alias("_highs"),
        F.collect_list("close").over(order.rowsBetween(1, rule.lookback)).alias("_closes"),
    ).withColumn(
        "higher_idx", F.when(F.col("high_pivot"), F.try_element_at(F.filter("_highs", lambda b: b["high"] > F.col("high")), F.lit(-1))["idx"])
    ).withColumn("closes_after", F.when(F.col("high_pivot"), F.col("_closes"))).drop("_highs", "_closes")


def swing_pairs(frame: DataFrame, rule: SwingRule) -> DataFrame:
    """Every qualifying (low, high) pair with the interval of bars on which it can be selected.

    Highs that cannot reach the gain against the lowest pivot in range never join. Both sides keep the
    (pool, block) partitioning of the frame, so the range join moves no rows. Within a block the index is cut again
    at the longest duration: a high meets the lows of two such stretches, not of the whole block.
    """
    at = [*POOL, "blk"]
    strict = rule.version != "legacy-v1"
    highs = frame.where(
        F.lit(rule.enabled) & F.col("high_pivot") & ((F.col("high") / F.col("lowest_pivot") - 1) * 100 >= rule.min_gain)
    ).select(
        *at, F.col("idx").alias("high_idx"), "high", F.col("vol_upto").alias("_hv"), "core",
        *(["higher_idx", "closes_after"] if strict else []),
    )
    lows = frame.where(F.col("low_pivot") & (F.col("low") > 0)).select(
        *at, F.col("idx").alias("low_idx"), "low", (F.col("vol_upto") - F.col("volume")).alias("_lv"), F.col("vol_base").alias("_base"),
    )
    reach = rule.max_duration
    highs = highs.withColumn("_stretch", cover(F.col("high_idx") - reach, F.col("high_idx") - 1, reach))
    lows = lows.withColumn("_stretch", block_of(F.col("low_idx"), reach))
    span = F.col("high_idx") - F.col("low_idx")
    mean = (F.col("_hv") - F.col("_lv")) / (span + 1)
    gain = (F.col("high") / F.col("low") - 1) * 100
    rule_ok = (span > 0) & (span <= rule.max_duration) & (gain >= rule.min_gain)
    if rule.volume_expansion:
        rule_ok = rule_ok & (mean >= F.col("_base") * rule.expansion_ratio)
    ends = F.col("low_idx") + rule.lookback - 1
    if strict:
        rule_ok = rule_ok & (F.col("low_idx") > F.coalesce("higher_idx", F.lit(-1)))
        breach = F.array_min(F.transform("closes_after", lambda c, i: F.when((c > F.col("high")) | (c < F.col("low")), i)))
        ends = F.least(ends, F.col("high_idx") + F.coalesce(breach.cast("long"), ends))
    return highs.join(lows, [*at, "_stretch"]).where(rule_ok).select(
        *at, "core", "high_idx", "low_idx", "low", "high", gain.alias("gain_percent"), mean.alias("average_volume"),
        (F.col("high_idx") + rule.right).alias("confirmed_idx"), ends.alias("ends_at"),
    )


def swing_asof(frame: DataFrame, rule: SwingRule, block: int, overlap: int = 0) -> DataFrame:
    """(pool, blk, idx) -> ``swing`` for the bars of a block that have one: latest high, then latest low.

    ``overlap`` also answers for that many bars before the block.
    """
    at = [*POOL, "blk"]
    body = F.struct("high_idx", "low_idx", "ends_at", "low", "high", "average_volume", "confirmed_idx")
    found = swing_pairs(frame, rule)
    if rule.version == "legacy-v1":
        # For one high all pairs start together and the latest low lives longest, so one pair is enough.
        found = found.groupBy(*at, "high_idx").agg(F.max(F.struct("low_idx", body.alias("b"))).alias("_p")).select(*at, "_p.b.*")
    first = F.greatest(F.col("confirmed_idx"), F.col("blk") * block - overlap)
    last = F.least(F.col("ends_at"), F.col("blk") * block + (block - 1))
    return (
        found.where(first <= last).withColumn("idx", F.explode(F.sequence(first, last)))
        .groupBy(*at, "idx").agg(F.max(body).alias("swing"))
    )


def with_swing(frame: DataFrame, rule: SwingRule, block: int) -> DataFrame:
    """Core bars with their swing (null where none is selectable)."""
    return frame.where("core").join(swing_asof(frame, rule, block), [*POOL, "blk", "idx"], "left")


def anchor_times(rows: DataFrame, filled: DataFrame, swing: str = "swing") -> DataFrame:
    """Times and gap flags of the low, high and confirming bar of each row's swing (three equi joins on the index)."""
    points = filled.select(*POOL, "idx", "time", "synthetic")
    out = rows
    for name in ("low", "high", "confirmed"):
        at = points.select(*POOL, F.col("idx").alias(f"_{name}"), F.col("time").alias(f"{name}_time"), F.col("synthetic").alias(f"{name}_synthetic"))
        out = out.withColumn(f"_{name}", F.col(f"{swing}.{name}_idx")).join(at, [*POOL, f"_{name}"], "left").drop(f"_{name}")
    return out


def first_breach(pairs: DataFrame, filled: DataFrame, horizon: int, block: int) -> DataFrame:
    """``breach_idx``: first bar after the high whose close leaves ``[low, high]``, within ``horizon`` bars."""
    spread = pairs.withColumn("_xb", cover(F.col("high_idx") + 1, F.col("high_idx") + horizon, block))
    closes = filled.select(*POOL, "idx", "close", block_of(F.col("idx"), block).alias("_xb"))
    ident = [*POOL, "high_idx", "low_idx"]
    hits = spread.join(closes, [*POOL, "_xb"]).where(
        (F.col("idx") > F.col("high_idx")) & (F.col("idx") <= F.col("high_idx") + horizon)
        & ((F.col("close") > F.col("high")) | (F.col("close") < F.col("low")))
    )
    return pairs.join(hits.groupBy(*ident).agg(F.min("idx").alias("breach_idx")), ident, "left")
