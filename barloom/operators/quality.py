"""Series preparation: dense index, gap filling, gap counts, duplicates, comparison and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.candles import finite, valid_bar
from barloom.plans.blocks import BLOCK
from barloom.schemas import OHLCV, POOL, TOKEN


def only_valid(bars: DataFrame) -> DataFrame:
    return bars.where(valid_bar("valid" in bars.columns))


def drop_conflicting_duplicates(bars: DataFrame, key: list[str], values: list[str] = OHLCV) -> DataFrame:
    """Equal copies of a key become one row; keys with differing copies disappear (partial aggregation only)."""
    content = F.struct(*values)
    rest = [c for c in bars.columns if c not in key and c not in values]
    return (
        bars.groupBy(*key)
        .agg(F.min(content).alias("_a"), F.max(content).alias("_b"), *[F.min(c).alias(c) for c in rest])
        .where(F.col("_a").eqNullSafe(F.col("_b")))
        .select(*key, "_a.*", *rest)
    )


def index_bars(bars: DataFrame, step: int, block: int = BLOCK, token_info: DataFrame | None = None) -> DataFrame:
    """Dense 0-based ``idx`` on the gap-filled series, without creating the filled rows.

    Bars are windowed per (pool, time block). The first and last time of each block are stitched together in a
    table that is smaller by the block size; ``token_info`` (keyed by token) joins there, not at bar grain.
    """
    step_ms = F.lit(step)
    here = Window.partitionBy(*POOL, "_tb").orderBy("time")
    jump = lambda late, early: F.greatest(F.lit(1), F.ceil((late - early) / step_ms)).cast("long")
    local = (
        bars.withColumn("_tb", F.floor(F.col("time") / F.lit(step * block)).cast("long"))
        .withColumn("_prev", F.lag("time").over(here))
        .withColumn("_next", F.lead("time").over(here))
        .withColumn("_inc", F.when(F.col("_prev").isNull(), F.lit(0)).otherwise(jump(F.col("time"), F.col("_prev"))))
        .withColumn("_run", F.sum("_inc").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    )
    edges = local.groupBy(*POOL, "_tb").agg(
        F.min("time").alias("_first"), F.max("time").alias("_last"), F.sum("_inc").alias("_span")
    )
    along = Window.partitionBy(*POOL).orderBy("_tb")
    edges = (
        edges.withColumn("_before", F.lag("_last").over(along))
        .withColumn("_after", F.lead("_first").over(along))
        .withColumn("_link", F.when(F.col("_before").isNull(), F.lit(0)).otherwise(jump(F.col("_first"), F.col("_before"))))
        .withColumn(
            "_base",
            F.sum("_link").over(along.rowsBetween(Window.unboundedPreceding, 0))
            + F.coalesce(F.sum("_span").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .select(*POOL, "_tb", "_before", "_after", "_base")
    )
    if token_info is not None:
        edges = edges.join(token_info, TOKEN, "left")
    return (
        local.join(edges, [*POOL, "_tb"])
        .withColumn("idx", F.col("_base") + F.col("_run"))
        .withColumn("prev_time", F.coalesce("_prev", "_before"))
        .withColumn("next_time", F.coalesce("_next", "_after"))
        .drop("_tb", "_prev", "_next", "_inc", "_run", "_before", "_after", "_base")
    )


def fill_gaps(indexed: DataFrame, step: int, chunk: int = 4096) -> DataFrame:
    """Flat zero-volume bars between two real bars; never before the first or after the last one."""
    count = F.greatest(F.lit(1), F.coalesce(F.ceil((F.col("next_time") - F.col("time")) / F.lit(step)), F.lit(1)))
    made = F.col("_k") > 0
    extra = [c for c in indexed.columns if c not in {*POOL, *OHLCV, "time", "close_time", "idx", "next_time", "prev_time"}]
    start = F.col("time") + F.col("_k") * F.lit(step)
    closes = F.coalesce(F.col("close_time"), F.col("time") + step) if "close_time" in indexed.columns else F.col("time") + step
    return (
        indexed.withColumn("_n", count.cast("long"))
        # Two explodes keep each generated array short even for a very long gap.
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))))
        .withColumn("_k", F.explode(F.sequence(
            F.col("_part") * chunk, F.least(F.col("_n") - 1, F.col("_part") * chunk + (chunk - 1)))))
        .select(
            *POOL,
            start.alias("time"),
            F.when(made, start + step).otherwise(closes).alias("close_time"),
            *[F.when(made, F.col("close")).otherwise(F.col(n)).alias(n) for n in ("open", "high", "low")],
            "close",
            F.when(made, F.lit(0.0)).otherwise(F.col("volume")).alias("volume"),
            (F.col("idx") + F.col("_k")).alias("idx"),
            made.alias("synthetic"),
            (F.col("next_time").isNull()).alias("is_last"),
            *extra,
        )
    )


def gap_stats(bars: DataFrame, step: int, block: int = BLOCK) -> DataFrame:
    """Missing, filled and invalid counts per pool."""
    bad = bars.where(~valid_bar("valid" in bars.columns)).groupBy(*POOL).agg(F.count(F.lit(1)).alias("invalid_bars"))
    good = index_bars(only_valid(bars), step, block)
    return (
        good.groupBy(*POOL)
        .agg(
            F.count(F.lit(1)).alias("real_bars"),
            (F.max("idx") + 1 - F.count(F.lit(1))).alias("synthetic_bars"),
            F.sum(F.when(F.col("prev_time").isNotNull() & (F.col("time") - F.col("prev_time") > step), 1).otherwise(0)).alias("gaps"),
        )
        .join(bad, POOL, "full")
        .na.fill(0, ["real_bars", "synthetic_bars", "gaps", "invalid_bars"])
    )


def compare_series(left: DataFrame, right: DataFrame, key: list[str], tolerance: float = 1e-8):
    """Full-outer comparison. Returns the one-row summary and the differing rows (callers take the examples)."""
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    pairs = a.join(b, on, "full").select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in key],
        F.col(f"a.{key[0]}").isNotNull().alias("in_left"),
        F.col(f"b.{key[0]}").isNotNull().alias("in_right"),
        F.coalesce(F.col("a.synthetic"), F.lit(False)).alias("synthetic") if "synthetic" in left.columns else F.lit(False).alias("synthetic"),
        *[F.struct(F.col(f"a.{v}").alias("l"), F.col(f"b.{v}").alias("r")).alias(v) for v in OHLCV],
    )
    both = F.col("in_left") & F.col("in_right")
    out = pairs
    for v in OHLCV:
        gap = F.abs(F.col(f"{v}.l") - F.col(f"{v}.r"))
        out = out.withColumn(f"{v}_differs", both & (gap > tolerance * F.greatest(F.abs(F.col(f"{v}.l")), F.abs(F.col(f"{v}.r")))))
        out = out.withColumn(f"{v}_percent", F.when(F.col(f"{v}_differs") & (F.col(f"{v}.r") != 0), gap / F.abs(F.col(f"{v}.r")) * 100))
    any_differs = F.greatest(*[F.col(f"{v}_differs") for v in OHLCV])
    out = out.withColumn("differs", any_differs)
    summary = out.agg(
        F.count_if(both).alias("overlap"),
        F.count_if(F.col("in_left") & ~F.col("in_right")).alias("only_left"),
        F.count_if(~F.col("in_left") & F.col("in_right")).alias("only_right"),
        F.count_if(both & F.col("synthetic")).alias("synthetic_overlap"),
        F.count_if(both & ~F.col("synthetic")).alias("real_overlap"),
        F.count_if(both & ~F.col("differs")).alias("all_equal"),
        *[F.count_if(F.col(f"{v}_differs")).alias(f"{v}_different") for v in OHLCV],
        *[F.round(F.coalesce(F.max(f"{v}_percent"), F.lit(0.0)), 6).alias(f"{v}_max_percent") for v in OHLCV],
        *[F.round(F.coalesce(F.sum(f"{v}_percent"), F.lit(0.0)), 4).alias(f"{v}_sum_percent") for v in OHLCV],
    )
    return summary, out.where("differs")


def coverage(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """One row: sizes, tokens without a signal, pools without valid bars, tokens that ended before their signal."""
    flagged = bars.withColumn("_ok", valid_bar("valid" in bars.columns))
    pools = flagged.groupBy(*POOL).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("_ok").alias("ok"),
        F.max(F.when(F.col("_ok"), F.col("time"))).alias("last"), F.min("time").alias("first"), F.max("time").alias("final"),
    )
    tokens = pools.groupBy(*TOKEN).agg(
        F.sum("rows").alias("rows"), F.sum("ok").alias("ok"), F.count(F.lit(1)).alias("pools"),
        F.count_if(F.col("ok") == 0).alias("empty_pools"), F.max("last").alias("last"),
        F.min("first").alias("first"), F.max("final").alias("final"),
    ).join(signals, TOKEN, "left")
    return tokens.agg(
        F.sum("rows").alias("rows"), (F.sum("rows") - F.sum("ok")).alias("invalid"), F.sum("pools").alias("pools"),
        F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("signal_time").isNull()).alias("tokens_without_signal"),
        F.sum("empty_pools").alias("pools_without_valid"),
        F.count_if(F.col("last") <= F.col("signal_time")).alias("tokens_ended"),
        F.min("first").alias("first_time"), F.max("final").alias("last_time"),
    )


def eligible_tokens(signals: DataFrame, last_by_interval: DataFrame, intervals: int) -> DataFrame:
    """Signals with an ``eligible`` flag: some bar strictly after the signal in every interval.

    ``last_by_interval`` holds token, interval and the last bar time.
    """
    reached = (
        last_by_interval.join(signals, TOKEN)
        .where(F.col("last_time") > F.col("signal_time"))
        .groupBy(*TOKEN).agg(F.count_distinct("interval").alias("_reached"))
    )
    return signals.join(reached, TOKEN, "left").withColumn(
        "eligible", F.coalesce(F.col("_reached") == intervals, F.lit(False))
    ).drop("_reached")


def contiguous_tail(bars: DataFrame, after: DataFrame, step: int, required: int, block: int = BLOCK) -> DataFrame:
    """Per pool: unbroken run of bars starting at ``after_time + step`` and whether it is long enough.

    The run ends at the first bar that is not at its expected place, found with one aggregate per pool:
    positions come from the block-stitched row count, so no pool is windowed as a whole.
    """
    from barloom.plans.blocks import scan

    later = bars.join(after, POOL).where(F.col("time") > F.col("after_time"))
    numbered = scan(later, POOL, ["time"], F.floor(F.col("time") / F.lit(step * block)), {"_rn": ("count", F.lit(1))})
    off = F.col("time") != F.col("after_time") + F.col("_rn") * step
    return numbered.groupBy(*POOL, "after_time").agg(
        F.min(F.when(off, F.col("_rn"))).alias("_break"), F.count(F.lit(1)).alias("_all"), F.max("time").alias("last_time"),
    ).select(
        *POOL, "after_time",
        F.coalesce(F.col("_break") - 1, F.col("_all")).alias("run_bars"),
        F.col("_break").isNotNull().alias("has_hole"),
        ((F.coalesce(F.col("_break") - 1, F.col("_all")) >= required) & F.col("_break").isNull()).alias("sufficient"),
        "last_time",
    )


def required_history(swing: dict, periods: list[int]) -> int:
    """Bars a strategy needs before it may decide."""
    return max(swing["lookback"] + swing["left"] + swing["right"] + 1, 1, *[p + 2 for p in periods])


def backfill_windows(ranges: DataFrame, step: int, size: int = 5000) -> DataFrame:
    """Half-open request windows of at most ``size`` bars for rows with ``from_time`` and ``to_time``."""
    width = step * size
    return ranges.where("to_time > from_time").withColumn(
        "window_from", F.explode(F.sequence("from_time", F.col("to_time") - 1, F.lit(width).cast("long")))
    ).withColumn("window_to", F.least(F.col("to_time"), F.col("window_from") + width))


def closed_before(bars: DataFrame, cutoff: Column) -> DataFrame:
    return bars.where((F.col("time") < cutoff) & (F.col("close_time") <= cutoff))


def normalize_identity(df: DataFrame, exact_chain: str = "sol") -> DataFrame:
    chain = F.lower(F.trim("chain"))
    address = F.trim("ca")
    return df.withColumn("ca", F.when(chain == exact_chain, address).otherwise(F.lower(address))).withColumn("chain", chain)


def normalize_supply(value: Column, unit: Column, decimals: Column) -> tuple[Column, Column]:
    """(tokens as DECIMAL(38,18), reject reason). Values that do not fit 38 digits are rejected, never rounded away."""
    digits = F.when(decimals.rlike(r"^\d{1,3}$"), decimals.cast("int"))
    numeric = value.rlike(r"^\d+(\.\d+)?$")
    whole = value.rlike(r"^\d+$")
    tokens_ok = numeric & F.expr("true")
    fits = F.length(F.regexp_extract(value, r"^0*(\d*)", 1)) - F.coalesce(F.when(unit == "raw", digits), F.lit(0)) <= 20
    padded = F.lpad(value, F.greatest(F.length(value), digits + 1), "0")
    shifted = F.concat(
        F.substring(padded, F.lit(1), F.length(padded) - digits), F.lit("."),
        F.when(digits > 0, F.substring(padded, F.length(padded) - digits + 1, digits)).otherwise(F.lit("0")),
    )
    raw_tokens = shifted.try_cast("decimal(38,18)") if hasattr(shifted, "try_cast") else shifted.cast("decimal(38,18)")
    direct = value.try_cast("decimal(38,18)")
    reason = (
        F.when(~F.coalesce(tokens_ok, F.lit(False)) | (value.try_cast("double") <= 0), "supply missing or invalid")
        .when(~F.coalesce(unit.isin("raw", "tokens"), F.lit(False)), "supply unit unknown")
        .when((unit == "raw") & (~whole | digits.isNull() | (digits > 255)), "raw supply or decimals invalid")
        .when(~fits, "supply exceeds 38 digits")
    )
    tokens = F.when(reason.isNull(), F.when(unit == "tokens", direct).otherwise(raw_tokens))
    return tokens, reason


def resolve_market_cap(trades: DataFrame, supply: DataFrame) -> DataFrame:
    """Reported market cap if positive, else price times supply; ``basis`` tells which. Unknown stays null."""
    derived = F.col("price") * F.col("tokens").cast("double")
    return trades.join(supply, TOKEN, "left").withColumn(
        "basis",
        F.when(finite(F.col("mcap")) & (F.col("mcap") > 0), "ws")
        .when(finite(derived) & (derived > 0) & (F.col("price") > 0), "price_supply"),
    ).withColumn("market_cap", F.when(F.col("basis") == "ws", F.col("mcap")).when(F.col("basis") == "price_supply", derived))


def resolve_main_pool(pair: Column, outer_pair: Column, outer_dex: Column, inner_pair: Column, inner_dex: Column) -> Column:
    """Dex of the main pool; null when neither side matches or the name is not a plain identifier."""
    dex = F.when(F.lower(outer_pair) == F.lower(pair), outer_dex).when(F.lower(inner_pair) == F.lower(pair), inner_dex)
    return F.when(dex.rlike("^[a-z0-9_-]+$"), dex)


def resolve_created_at(first: Column, second: Column, now: Column) -> Column:
    """First usable of two raw fields: seconds, milliseconds or an ISO time, not in the future."""
    def one(raw: Column) -> Column:
        n = raw.try_cast("double")
        at = F.when(n.isNotNull(), F.when(n < 1e12, n * 1000).otherwise(n).cast("long")).otherwise(
            F.unix_millis(raw.try_cast("timestamp"))
        )
        return F.when((at > 0) & (at <= now), at)
    return F.coalesce(one(first), one(second))


def enrich_identity(tokens: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left join of display data; addresses without an http(s) scheme are dropped."""
    url = F.when(F.col("url").rlike("^https?://"), F.col("url"))
    return tokens.join(lookup.withColumn("url", url), TOKEN, "left")
