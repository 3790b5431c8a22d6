"""Per-bar expressions: validity and candle shapes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPSILON = 2.220446049250313e-16


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def valid_bar(has_flag: bool = False) -> Column:
    """A usable bar. Stored flags can only lower validity; a missing flag counts as valid."""
    o, h, l, c, v = (F.col(n) for n in ("open", "high", "low", "close", "volume"))
    rule = (
        finite(o) & finite(h) & finite(l) & finite(c) & finite(v) & F.col("time").isNotNull()
        & (l > 0) & (h >= F.greatest(o, c)) & (l <= F.least(o, c)) & (h >= l) & (v >= 0)
    )
    if has_flag:
        rule = rule & F.coalesce(F.col("valid"), F.lit(True))
    return F.coalesce(rule, F.lit(False))


def candle_pattern(name: str) -> Column:
    """Needs ``prev_open`` and ``prev_close`` for the two-bar pattern."""
    o, h, l, c = (F.col(n) for n in ("open", "high", "low", "close"))
    span = F.greatest(F.lit(EPSILON), h - l)
    body = F.abs(c - o)
    wick_down = F.least(o, c) - l
    wick_up = h - F.greatest(o, c)
    long_wick = wick_down >= F.greatest(body * 2, span * 0.4)
    shapes = {
        "hammer": (c >= o) & long_wick & (wick_up <= span * 0.2),
        "pin_bar": (wick_down >= span * 0.55) & (body <= span * 0.3),
        "long_lower_wick": long_wick,
        "bullish_engulfing": (F.col("prev_close") < F.col("prev_open")) & (c > o)
        & (o <= F.col("prev_close")) & (c >= F.col("prev_open")),
    }
    return F.coalesce(shapes[name], F.lit(False)) if name in shapes else F.lit(False)


PATTERNS = ["hammer", "pin_bar", "long_lower_wick", "bullish_engulfing"]
