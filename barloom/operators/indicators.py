"""Rolling indicators on block-framed bars; every frame is bounded, so a block with its halo is enough."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from barloom.operators.swings import bar_order
from barloom.plans.blocks import affine, asof, scan
from barloom.schemas import POOL


def with_ema(filled: DataFrame, periods: Iterable[int], block: int) -> DataFrame:
    """Columns ``ema_<period>`` from the first close of each pool on, over all its bars; ``idx`` is dense from 0."""
    close, maps = F.col("close"), {}
    for period in sorted(set(periods)):
        k = 2 / (period + 1)
        first = F.col("idx") == 0
        maps[f"ema_{period}"] = (F.when(first, 0.0).otherwise(1 - k), F.when(first, close).otherwise(close * k))
    return affine(filled, POOL, "idx", maps, block) if maps else filled


def rsi(period: int) -> Column:
    """Plain averages over exactly ``period`` changes; needs one more close; no loss gives 100."""
    change = F.col("close") - F.col("prev_close")
    recent = bar_order().rowsBetween(-period + 1, 0)
    gain = F.sum(F.greatest(change, F.lit(0.0))).over(recent) / period
    loss = F.sum(F.greatest(-change, F.lit(0.0))).over(recent) / period
    value = F.when(loss == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + gain / F.when(loss != 0, loss)))
    return F.when(F.col("idx") >= period, value)


def signed_volume() -> Column:
    change = F.col("close") - F.col("prev_close")
    return F.coalesce(F.signum(change) * F.col("volume"), F.lit(0.0))


def mean_volume(period: int, include_current: bool) -> Column:
    frame = bar_order().rowsBetween(-period + 1, 0) if include_current else bar_order().rowsBetween(-period, -1)
    return F.avg("volume").over(frame)


def obv(filled: DataFrame, step_rows: int) -> DataFrame:
    """Running signed volume per pool: previous close by block-stitched scan, then a carried sum."""
    bucket = F.floor(F.col("idx") / step_rows)
    staged = scan(filled, POOL, ["idx"], bucket, {"prev_close": ("last", F.col("close"))}, exclusive=True)
    return scan(staged, POOL, ["idx"], bucket, {"obv": ("sum", signed_volume())})


Feature = tuple[str, int]


def feature_back(feature: Feature) -> int:
    kind, period = feature
    return 2 if kind == "ema" else period + 2


def add_features(frame: DataFrame, features: set[Feature]) -> DataFrame:
    """One column per distinct (indicator, period), shared by all rules and candidates that use it. ``with_ema`` comes before."""
    out = frame.withColumn("prev_close", F.lag("close").over(bar_order())).withColumn("prev_open", F.lag("open").over(bar_order()))
    for kind, n in sorted(features):
        if kind == "rsi":
            out = out.withColumn(f"rsi_{n}", rsi(n)).withColumn(f"rsi_{n}_prev", F.lag(f"rsi_{n}").over(bar_order()))
        elif kind == "ema":
            out = out.withColumn(f"ema_{n}_prev", F.lag(f"ema_{n}").over(bar_order()))
        elif kind == "vmean":
            out = out.withColumn(f"vmean_{n}", mean_volume(n, include_current=False))
        elif kind == "vols":
            out = out.withColumn(f"vols_{n}", F.collect_list("volume").over(bar_order().rowsBetween(-n + 1, 0)))
        elif kind == "obv":
            recent = bar_order().rowsBetween(-n + 1, 0)
            base = F.sum("volume").over(recent)
            out = out.withColumn("_sv", signed_volume()).withColumn(
                f"obv_change_{n}",
                F.when((F.col("idx") >= n) & (base > 0), F.sum("_sv").over(recent) / base * 100),
            ).drop("_sv")
        else:
            raise ValueError(f"unknown indicator {kind}")
    return out


def nearest_bars(bars: DataFrame, anchors: DataFrame, n: int, width: int) -> DataFrame:
    """For each anchor (``anchor_from``, ``anchor_to``): the times bounding ``n`` real bars on each side.

    Bars get an ordinal per pool; each anchor finds its ordinal as-of and the bound by an equi join on it.
    """
    numbered = scan(bars.select(*POOL, "time"), POOL, ["time"], F.floor(F.col("time") / F.lit(width)), {"rn": ("count", F.lit(1))})
    totals = numbered.groupBy(*POOL).agg(F.max("rn").alias("_bars"))
    placed = asof(anchors, numbered.withColumnRenamed("rn", "_upto"), POOL, "anchor_from", "time", ["_upto"], width)
    placed = asof(placed, numbered.withColumnRenamed("rn", "_under"), POOL, "anchor_to", "time", ["_under"], width, inclusive=False)
    placed = placed.join(totals, POOL).na.fill(0, ["_upto", "_under"])
    low = F.greatest(F.lit(1), F.col("_upto") - n + 1)
    high = F.least(F.col("_bars"), F.col("_under") + n)
    ends = placed.withColumn("_low", F.when(F.col("_upto") > 0, low)).withColumn("_high", F.when(F.col("_under") < F.col("_bars"), high))
    a = numbered.select(*POOL, F.col("rn").alias("_low"), F.col("time").alias("context_from"))
    b = numbered.select(*POOL, F.col("rn").alias("_high"), F.col("time").alias("context_to"))
    return (
        ends.join(a, [*POOL, "_low"], "left").join(b, [*POOL, "_high"], "left")
        .withColumn("bars_before", F.coalesce(F.col("_upto") - F.col("_low") + 1, F.lit(0)))
        .withColumn("bars_after", F.coalesce(F.col("_high") - F.col("_under"), F.lit(0)))
        .drop("_upto", "_under", "_bars", "_low", "_high")
    )
