"""Candle streaming: the same transformations run on a stream or, for replay and tests, on a stored table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.rules import qualify_source
from barloom.plans.blocks import scan
from barloom.schemas import OHLCV, POOL, TOKEN
from barloom.session import scratch
from barloom.sources.ingest import BASE58_ADDRESS

MARKET = ["chain", "pair_id"]
DAY = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedup_ticks(ticks: DataFrame, watermark: str = "5 minutes") -> DataFrame:
    """One tick per (chain, pair, id); on a stream the memory is bounded by the watermark."""
    key = [*MARKET, "id"]
    if ticks.isStreaming:
        return ticks.withColumn("ts", F.timestamp_millis("time")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(key)
    return ticks.withColumn("ts", F.timestamp_millis("time")).dropDuplicates(key)


def tumbling_bars(ticks: DataFrame, interval: str) -> DataFrame:
    """Price and market-cap candles of one interval; ties in time go by id; a missing market cap skips its series."""
    series = F.filter(F.array(
        F.struct(F.lit("price").alias("type"), F.col("price").alias("value")), F.struct(F.lit("mcap").alias("type"), F.col("mcap").alias("value")),
    ), lambda x: x["value"] > 0)
    at = F.struct("time", "id")
    typed = ticks.withColumn("_s", F.explode(series)).select(*POOL, "ts", "time", "id", "volume_usd", "_s.*")
    return typed.groupBy(F.window("ts", interval).alias("w"), *POOL, "type").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
        F.sum("volume_usd").alias("volume"), F.count(F.lit(1)).alias("trade_count"), F.max(at).alias("last"),
    ).select(
        *POOL, "type", F.unix_millis("w.start").alias("time"), F.unix_millis("w.end").alias("close_time"), *OHLCV, "trade_count",
        F.col("last.id").alias("close_trade_id"), F.col("last.time").alias("close_trade_time"))


def keyed_state(spark: SparkSession) -> SparkSession:
    """Let streams started from now on keep state per key on disk, as stateful processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name) != ROCKS:
        spark.conf.set(name, ROCKS)
    return spark


def run_to_table(stream: DataFrame, label: str, finish: Callable[[], None] | None = None) -> DataFrame:
    """Drain a stream into a table of the shared folder (file sink with checkpoint) and read it back.

    ``finish`` (of ``ending``) is called once all is read; the query then goes on from its checkpoint.
    """
    spark = keyed_state(stream.sparkSession)
    path = scratch(spark, label)
    for step in (None, finish) if finish else (None,):
        if step:
            step()
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def late_policy(ticks: DataFrame, arrival: str, width: int) -> DataFrame:
    """``verdict`` per tick in arrival order: too_old if 30 s behind its market's latest and in another minute.

    The latest time is a carried maximum, exact per market, with no task holding a whole market.
    """
    seen = scan(ticks, MARKET, [arrival], F.floor(F.col(arrival) / width), {"latest": ("max", F.col("time"))}, exclusive=True)
    behind = F.col("latest") - F.col("time")
    old = (behind >= 30_000) & (F.floor(F.col("time") / 60_000) != F.floor(F.col("latest") / 60_000))
    return seen.withColumn("verdict", F.when(F.coalesce(old, F.lit(False)), "too_old").when(behind > 0, "late").otherwise("on_time"))


def sound_trade() -> Column:
    """Named, timed, with a positive finite price and a finite volume that is not negative."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    named = [F.col(c).isNotNull() & (F.col(c) != "") for c in (*POOL, "id")]
    tests = [*named, F.col("time") >= 0, finite("price"), F.col("price") > 0, finite("volume_usd"), F.col("volume_usd") >= 0]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def has_cap() -> Column:
    return F.coalesce((F.col("mcap") > 0) & ~F.isnan("mcap") & (F.col("mcap") != F.lit(float("inf"))), F.lit(False))


def judge_trades(ticks: DataFrame, arrival: str, width: int) -> DataFrame:
    """``verdict`` per tick (see ``dedup_ticks`` for repeats) in order of arrival, then id, on a stored table.

    * invalid: not a ``sound_trade``; it changes nothing;
    * too_old: 30 s or more behind its market's latest trade and in another minute; it changes nothing;
    * closed: no candle takes it, as in each series that it has a value for a later minute of its pool is open;
    * late, on_time: taken; late if behind the latest.

    A minute closes when a later one opens, not by the clock. The half-minute candles need no look: one that is open lies
    in an open minute. ``judge_stream`` gives the same verdicts on a stream.
    """
    order, bucket = [arrival, "id"], F.floor(F.col(arrival) / width)
    seen = scan(ticks.withColumn("_ok", sound_trade()), MARKET, order, bucket, {"_latest": ("max", F.when(F.col("_ok"), F.col("time")))}, exclusive=True)
    minute, behind = F.floor(F.col("time") / 60_000), F.col("_latest") - F.col("time")
    old = F.coalesce((behind >= 30_000) & (minute != F.floor(F.col("_latest") / 60_000)), F.lit(False))
    fresh = seen.withColumn("_fresh", F.col("_ok") & ~old)
    opened = scan(fresh, POOL, order, bucket, {
        "_price": ("max", F.when(F.col("_fresh"), minute)), "_mcap": ("max", F.when(F.col("_fresh") & has_cap(), minute))}, exclusive=True)
    taken = (minute >= F.coalesce("_price", F.lit(-1))) | (has_cap() & (minute >= F.coalesce("_mcap", F.lit(-1))))
    verdict = F.when(~F.col("_ok"), "invalid").when(~F.col("_fresh"), "too_old").when(~taken, "closed").when(behind > 0, "late").otherwise("on_time")
    return opened.withColumn("verdict", verdict).drop("_ok", "_fresh", "_latest", "_price", "_mcap")


def judge_stream(ticks: DataFrame, arrival: str) -> DataFrame:
    """``judge_trades`` on a stream: chain, pair_id, ca, id, ``arrival``, time and ``verdict``, whatever the micro-batches.

    Each market keeps its latest trade time and, per token, the open minute of both series. Ticks of one micro-batch may
    come in any order; a tick of an earlier micro-batch must not have a larger ``arrival``. A task holds the ticks of one
    market in one micro-batch, which the source bounds (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
    """
    key = {"chain": "string", "pair_id": "string"}
    schema = f"chain string, pair_id string, ca string, id string, {arrival} bigint, time bigint, verdict string"
    slim = ticks.select(*MARKET, "ca", "id", F.col(arrival).cast("long").alias(arrival), F.col("time").cast("long").alias("time"),
                        sound_trade().alias("ok"), has_cap().alias("capped"))
    return slim.groupBy(*key).transformWithStateInPandas(Lateness(arrival), schema, "Append", "None")


class Lateness(StatefulProcessor):
    """The state of one market behind ``judge_stream``; times and minutes are -1 before the first trade."""

    def __init__(self, arrival: str) -> None:
        self.arrival = arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "time bigint")
        self.minutes = handle.getMapState("minutes", "ca string", "price bigint, mcap bigint")

    def handleInputRows(self, key, rows, timerValues):
        ticks = pd.concat(list(rows)).sort_values([self.arrival, "id"], kind="stable").reset_index(drop=True)
        ok, capped = ticks["ok"].to_numpy(bool), ticks["capped"].to_numpy(bool)
        time = ticks["time"].fillna(-1).to_numpy(np.int64)
        minute = time // 60_000
        known = np.maximum.accumulate(np.r_[self.latest.get()[0] if self.latest.exists() else -1, np.where(ok, time, -1)])
        before = known[:-1]
        fresh = ok & ~((before - time >= 30_000) & (minute != before // 60_000))
        verdict = np.where(time < before, "late", "on_time").astype(object)
        for ca, at in ticks[fresh].groupby("ca").groups.items():
            price, mcap = self.minutes.getValue((ca,)) if self.minutes.containsKey((ca,)) else (-1, -1)
            prices = np.maximum.accumulate(np.r_[price, minute[at]])
            caps = np.maximum.accumulate(np.r_[mcap, np.where(capped[at], minute[at], -1)])
            verdict[at[~((minute[at] >= prices[:-1]) | (capped[at] & (minute[at] >= caps[:-1])))]] = "closed"
            self.minutes.updateValue((ca,), (int(prices[-1]), int(caps[-1])))
        verdict[~fresh] = "too_old"
        verdict[~ok] = "invalid"
        self.latest.update((int(known[-1]),))
        ticks["verdict"] = verdict
        yield ticks[["chain", "pair_id", "ca", "id", self.arrival, "time", "verdict"]]

    def close(self) -> None:
        pass


def flush_and_fill(bars: DataFrame, now: int, step: int, connected: DataFrame) -> DataFrame:
    """Bars closed by ``now`` plus the idle bars after a real one, up to the first that no connection covers.

    ``connected`` may hold any number of intervals (``from_time``..``to_time``) of a market; an idle bar belongs to one if
    it lies in it whole. A gap in the connection ends the filling until the next real bar.
    """
    from barloom.operators.quality import fill_gaps, index_bars

    closed = bars.where(F.col("close_time") <= now)
    indexed = index_bars(closed.select(*POOL, "time", *OHLCV), step)
    trailing = indexed.withColumn("next_time", F.coalesce("next_time", F.lit((now // step) * step))).withColumn("real_time", F.col("time"))
    filled = fill_gaps(trailing, step)
    real, idle = filled.where(~F.col("synthetic")), filled.where("synthetic")
    inside = F.expr(f"transform(sequence(cast(ceil(from_time / {step}) as bigint), cast(floor(to_time / {step}) as bigint) - 1), n -> n * {step})")
    covered = connected.where(F.ceil(F.col("from_time") / step) < F.floor(F.col("to_time") / step)).select(*MARKET, F.explode(inside).alias("time")).distinct()
    live = idle.join(covered, [*MARKET, "time"])
    # The n-th idle bar after a real one stays if all n of them are connected.
    order = Window.partitionBy(*POOL, "real_time").orderBy("time")
    kept = live.withColumn("_n", F.row_number().over(order)).where(F.col("time") == F.col("real_time") + F.col("_n") * step).drop("_n")
    return real.unionByName(kept).drop("real_time")


def fence(bars: DataFrame, interruptions: DataFrame, step: int) -> DataFrame:
    """Drop the partial bucket of an interrupted market; ``at`` is the interruption, bars resume at the next full minute."""
    marks = interruptions.select(*MARKET, (F.floor(F.col("at") / step) * step).alias("time")).distinct()
    return bars.join(marks, [*MARKET, "time"], "left_anti")


def paired_price(bars: DataFrame) -> DataFrame:
    """Fill price for a market-cap bar: needs the price bar of the same bucket, last trade and time."""
    same = [*POOL, "time", "close_trade_id", "close_trade_time"]
    price = bars.where("type = 'price'").select(*same, F.col("close").alias("price_close"))
    caps = bars.where("type = 'mcap'").select(*same, F.col("close").alias("mcap_close"))
    return caps.join(price, same).withColumn("token_price", F.col("price_close"))


def admit(signals: DataFrame, rules: DataFrame, capacity: int, width: int) -> DataFrame:
    """Qualifying first signals per run in time order; ``admitted`` while the run has free places."""
    fine = qualify_source(signals, rules).where("qualified").where(F.col("signal_time") > F.col("activated_at"))
    first = fine.groupBy("run_id", *TOKEN).agg(F.min("signal_time").alias("signal_time"))
    ranked = scan(first, ["run_id"], ["signal_time", *TOKEN], F.floor(F.col("signal_time") / width), {"place": ("count", F.lit(1))})
    return ranked.withColumn("admitted", F.col("place") <= capacity)


def evict(caps: DataFrame, exit_cap: float, holding: DataFrame) -> DataFrame:
    """Tokens whose latest market cap is under the exit cap: leave, or exit-only while a position is open."""
    low = caps.groupBy(*TOKEN).agg(F.max_by("market_cap", "time").alias("market_cap")).where(F.col("market_cap") < exit_cap)
    return low.join(holding.select(*TOKEN).distinct().withColumn("_h", F.lit(True)), TOKEN, "left").select(
        *TOKEN, "market_cap", F.when(F.col("_h"), "exit_only").otherwise("leave").alias("action"))


def sequence_gaps(messages: DataFrame, width: int) -> DataFrame:
    """Holes in a session's sequence numbers; duplicates are ignored."""
    once = messages.select("session", "seq").distinct()
    seen = scan(once, ["session"], ["seq"], F.floor(F.col("seq") / width), {"before": ("max", F.col("seq"))}, exclusive=True)
    return seen.where(F.col("seq") > F.col("before") + 1).select("session", (F.col("before") + 1).alias("gap_from"), (F.col("seq") - 1).alias("gap_to"))


def feed_counters(judged: DataFrame) -> DataFrame:
    return judged.groupBy(*MARKET).agg(
        F.count_if(F.col("verdict") == "late").alias("late"), F.count_if(F.col("verdict") == "too_old").alias("too_old"), F.max("time").alias("last_trade"))


def feed_candidates(items: DataFrame, now: Column) -> DataFrame:
    """Feed items with a base58 address and numeric facts; unusable numbers become null."""
    positive = lambda c: F.when(F.col(c).try_cast("double") > 0, F.col(c).try_cast("double"))
    return items.where(F.coalesce(F.col("address").rlike(BASE58_ADDRESS), F.lit(False))).select(
        F.col("address").alias("ca"), positive("created").cast("long").alias("created_at"), positive("cap").alias("market_cap"), F.col("kol").try_cast("int").alias("kol"), now.alias("time"))


def wallet_buys(balances: DataFrame, swaps: DataFrame, quotes: list[str]) -> DataFrame:
    """Mint bought in a transaction: exactly one non-quote gain passed to a recognized swap, and something spent."""
    delta = balances.groupBy("tx", "mint").agg(F.sum(F.col("post") - F.col("pre")).alias("delta")).join(swaps.select("tx", "mint").distinct().withColumn("_s", F.lit(True)), ["tx", "mint"], "left")
    gain = (F.col("delta") > 0) & ~F.col("mint").isin(quotes) & F.coalesce("_s", F.lit(False))
    return delta.groupBy("tx").agg(
        F.count_if(gain).alias("gains"), F.count_if(F.col("delta") < 0).alias("spent"), F.max(F.when(gain, F.col("mint"))).alias("mint"),
    ).where("gains = 1 and spent > 0").select("tx", "mint")


def history_then_live(history: DataFrame, live: DataFrame) -> DataFrame:
    """Stored candles win over live ones; replayed rows are warm-up and never decide."""
    key = [*POOL, "time"]
    old = history.select(*key, *OHLCV).withColumn("is_warmup", F.lit(True))
    return old.unionByName(live.select(*key, *OHLCV).join(old, key, "left_anti").withColumn("is_warmup", F.lit(False)))


def equity_snapshot(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Last write wins per time."""
    both = stored.withColumn("_p", F.lit(0)).unionByName(fresh.withColumn("_p", F.lit(1)))
    return both.groupBy("time").agg(F.max(F.struct("_p", "equity")).alias("w")).select("time", "w.equity")


def ending(events: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """A stream of events that can be finished, and the call that does so.

    The call adds an event of the year 9999 that has no value: it is in no bar, but moves the watermark past every window.
    """
    spark = events.sparkSession
    path = scratch(spark, "stream-end")
    given = {"ts": F.lit("9999-01-01").cast("timestamp"), "event_type": F.lit("click")}
    mark = spark.range(1).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    mark.limit(0).write.parquet(path)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(path)), lambda: mark.write.mode("append").parquet(path)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
