"""Headline timings; prints one JSON line. Data: $BENCH_SF_DIR, cores: $BENCH_CPUS."""

from __future__ import annotations

import json
import os
import time

from barloom.operators.labels import earliest_signals
from barloom.operators.quality import fill_gaps, index_bars, only_valid
from barloom.plans import backtest
from barloom.schemas import OHLCV, POOL
from barloom.session import build, prepare
from barloom.sources import mapped
from barloom.suite import QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
FILLED_STEP = 4_000  # 4 s bars over 30 days and 8 pools: about five million gap-filled bars
NAMES = ["a3_drop_conflicting_duplicates", "b2_fill_gaps", "d3_swing_asof", "g7_exit_reasons", "g8_realized_curve", "i2_tumbling_bars", "j5_median_deviation"]


def main() -> None:
    spark = prepare(build(CPUS, 32))
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    def timed(name, build_df):
        start = time.time()
        build_df().write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()

    timed("flagship_4h", lambda: backtest.pool_results(backtest.trades(mapped.bars(spark, SF, 14_400_000), mapped.signals(spark, SF), 14_400_000)))
    timed("flagship_5m_bars", lambda: backtest.pool_results(backtest.trades(mapped.bars(spark, SF, FILLED_STEP), mapped.signals(spark, SF), FILLED_STEP)))
    for name in NAMES:
        timed(name, lambda: QUERIES[name](spark, SF))
    ticks = mapped.bars(spark, SF, FILLED_STEP)
    raw, filled = ticks.count(), fill_gaps(index_bars(only_valid(ticks).select(*POOL, "time", *OHLCV), FILLED_STEP, token_info=earliest_signals(mapped.signals(spark, SF))), FILLED_STEP).count()
    bars = {"raw": raw, "filled": filled, "filled_per_second": round(filled / timings["flagship_5m_bars"])}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": os.path.basename(SF),
        "flagship_5m_bars": bars, "cores": CPUS, "heap": spark.sparkContext.getConf().get("spark.driver.memory")}))


if __name__ == "__main__":
    main()
