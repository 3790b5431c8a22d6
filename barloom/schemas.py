"""Column names and explicit schemas. Times are epoch milliseconds, prices are doubles."""

from __future__ import annotations

from pyspark.sql import types as T

POOL = ["chain", "ca", "pair_id"]
TOKEN = ["chain", "ca"]
OHLCV = ["open", "high", "low", "close", "volume"]

# Supported bar lengths in milliseconds.
STEP_MS = {
    "30s": 30_000,
    "1m": 60_000,
    "5m": 300_000,
    "15m": 900_000,
    "1h": 3_600_000,
    "4h": 14_400_000,
    "1d": 86_400_000,
}

_s, _l, _d, _b, _i = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


BAR = struct(
    chain=_s, ca=_s, pair_id=_s, interval=_s, type=_s, time=_l, close_time=_l,
    open=_d, high=_d, low=_d, close=_d, volume=_d, synthetic=_b, valid=_b,
)
TICK = struct(chain=_s, ca=_s, pair_id=_s, id=_s, time=_l, price=_d, mcap=_d, volume_usd=_d)
SIGNAL = struct(chain=_s, ca=_s, signal_source=_s, detail_id=_s, signal_time=_l)
HISTORY = struct(
    success=_b, code=_s, traceId=_s,
    data=struct(
        chain=_s, pair_address=_s, interval=_s, value_type=_s,
        items=T.ArrayType(struct(start_time=_s, open=_s, high=_s, low=_s, close=_s, volume=_s)),
    ),
)
FILL = struct(
    id=_s, position_id=_s, chain=_s, ca=_s, pair_id=_s, side=_s, reason=_s, decision_time=_l, fill_time=_l,
    fill_value=_d, fill_price=_d, market_cap=_d, quantity=_d, gross_amount=_d, fee=_d, slippage_cost=_d, tax_cost=_d,
)
