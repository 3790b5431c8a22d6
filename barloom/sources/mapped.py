"""Market-shaped views of the generic tables: ticks, bars, signals, fills, runs and candidate scores.

``events`` become trade ticks and signals, ``lineitem`` becomes order fills and run trades, ``orders`` become
candidate scores. Every view is a projection, so filters and column pruning still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.schemas import POOL, TOKEN
from barloom.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def _market(df: DataFrame) -> DataFrame:
    return df.withColumn("chain", F.concat(F.lit("c"), (F.col("user_id") % 2).cast("string"))).withColumn(
        "ca", F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string"))
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(table(spark, sf_dir, "events"))


def ticks_of(events: DataFrame) -> DataFrame:
    chosen = events.where(F.col("event_type").isin("click", "view", "purchase"))
    return _market(chosen).select(
        *TOKEN,
        F.when(F.col("event_type") == "click", "a").otherwise("b").alias("pair_id"),
        F.col("event_id").cast("string").alias("id"),
        epoch_ms("ts").alias("time"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("int").cast("double").alias("volume_usd"),
        F.when(F.col("event_type") != "view", F.col("value") * 1000).alias("mcap"),
    )


def tick_bars(source: DataFrame, step: int, value: str = "price") -> DataFrame:
    """Batch candles: open and close by event time, ties by id; partial aggregation runs before the shuffle."""
    at = F.struct("time", "id")
    worth = F.col(value)
    bucket = F.floor(F.col("time") / step) * step
    return (
        source.where(worth.isNotNull() & ~F.isnan(worth))
        .groupBy(*POOL, bucket.alias("bucket"))
        .agg(
            F.min_by(worth, at).alias("open"),
            F.max(worth).alias("high"),
            F.min(worth).alias("low"),
            F.max_by(worth, at).alias("close"),
            F.sum("volume_usd").alias("volume"),
            F.count(F.lit(1)).alias("trade_count"),
            F.max(at).alias("_close_at"),
        )
        .select(
            *POOL,
            F.col("bucket").alias("time"),
            (F.col("bucket") + step).alias("close_time"),
            "open", "high", "low", "close", "volume", "trade_count",
            F.col("_close_at.id").alias("close_trade_id"),
            F.col("_close_at.time").alias("close_trade_time"),
        )
    )


def bars(spark: SparkSession, sf_dir: str, step: int, value: str = "price") -> DataFrame:
    return tick_bars(ticks(spark, sf_dir), step, value)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per received signal; ``error`` events are kept as rows with an unusable time."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error"))
    return _market(events).select(
        *TOKEN,
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("signal_source"),
        F.col("event_id").cast("string").alias("detail_id"),
        F.when(F.col("event_type") == "signup", epoch_ms("ts")).alias("signal_time"),
        F.col("props").alias("source_signal"),
    )


def exact(column: Column, largest: int | None) -> Column:
    """A whole number as bigint, or as decimal once ``largest`` needs more: sums and products of ids must not overflow."""
    return column.cast("long" if largest is None or largest < 2**63 else "decimal(38,0)")


def line_id(lines: DataFrame) -> Column:
    """Unique per line: order and line number repeat, so part, supplier and quantity go into the high digits.

    A bigint while all ids of ``lines`` fit one (parts below 922,337), else a decimal. The same number, and order, either way.
    """
    parts, orders, quantity = lines.agg(F.max("l_partkey"), F.max("l_orderkey"), F.max("l_quantity")).first()
    largest = None if parts is None else ((int(parts) * 1000 + 999) * 100 + int(quantity or 0)) * 100_000_000 + int(orders or 0) * 10 + 10
    high = (exact(F.col("l_partkey"), largest) * 1000 + F.col("l_suppkey") % 1000) * 100 + F.col("l_quantity").cast("long")
    return exact(high * 100_000_000 + F.col("l_orderkey") * 10 + F.col("l_linenumber"), largest)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("N", "R"))
    quantity = 10 * F.ceil(F.col("l_quantity") / 25).cast("double")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    gross = price * quantity
    return lines.select(
        F.lit("c").alias("chain"),
        F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("ca"),
        F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("pair_id"),
        line_id(lines).alias("id"),
        F.lit(None).cast("string").alias("position_id"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.when(F.col("l_returnflag") == "R", "take_profit")
        .when(F.col("l_linenumber") == 1, "add").otherwise("entry").alias("reason"),
        (epoch_ms("l_shipdate") - 1000 * F.col("l_linenumber")).alias("decision_time"),
        epoch_ms("l_shipdate").alias("fill_time"),
        price.alias("fill_value"),
        price.alias("fill_price"),
        F.when(F.col("l_linenumber") != 7, price * 1000).alias("market_cap"),
        quantity.alias("quantity"),
        gross.alias("gross_amount"),
        (gross * F.col("l_discount")).alias("fee"),
        F.lit(0.0).alias("slippage_cost"),
        (gross * F.col("l_tax")).alias("tax_cost"),
    )


# Exit reasons in the order used by the mapped run trades.
EXIT_REASONS = ["take_profit", "stop_loss", "profit_lock", "invalidation", "timeout", "end_of_backtest"]


def run_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run trades derived from ``lineitem``: some open, some without PnL, some of unknown reason."""
    lines = table(spark, sf_dir, "lineitem")
    entry = epoch_ms("l_shipdate") + F.col("l_partkey") * 60_000
    price = F.col("l_extendedprice") / F.col("l_quantity")
    opened = F.col("l_partkey") % 11 == 0
    out_price = price * (1 + F.col("l_tax") - F.col("l_discount"))
    gross = (out_price - price) * F.col("l_quantity")
    fees = F.col("l_quantity") * price * 0.01
    index = F.col("l_orderkey") % 6
    reason = F.when(F.col("l_partkey") % 13 == 0, "mystery")
    for n, name in enumerate(EXIT_REASONS):
        reason = reason.when(index == n, name)
    return lines.select(
        line_id(lines).alias("id"),
        F.concat(F.lit("r"), (F.col("l_orderkey") % 2).cast("string")).alias("run_id"),
        F.concat(F.lit("c"), (F.col("l_suppkey") % 2).cast("string")).alias("chain"),
        F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("ca"),
        F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("pair_id"),
        F.lit(None).cast("long").alias("trade_no"),
        entry.alias("entry_time"),
        price.alias("entry_price"),
        F.col("l_quantity").alias("quantity"),
        F.when(~opened, entry + F.col("l_linenumber") * 3_600_000 - F.when(F.col("l_partkey") % 17 == 0, 8 * 3_600_000).otherwise(0)).alias("exit_time"),
        F.when(~opened, out_price).alias("exit_price"),
        F.when(~opened, reason).alias("exit_reason"),
        F.when(~opened, gross).alias("gross_pnl"),
        fees.alias("fees"),
        (fees * 0.5).alias("slippage_cost"),
        F.lit(0.0).alias("tax_cost"),
        F.when(~opened & (F.col("l_partkey") % 19 != 0), gross - fees * 1.5).alias("net_pnl"),
        F.when(~opened, F.col("l_linenumber").cast("long")).alias("holding_bars"),
        F.when(F.col("l_linenumber") >= 4, F.array(F.struct(
            (entry + 1_800_000).alias("time"), (price * 1.01).alias("price"), (F.col("l_quantity") * 0.5).alias("quantity"),
        ))).otherwise(F.array().cast("array<struct<time:bigint,price:double,quantity:double>>")).alias("adds"),
    )


def run_events(trades: DataFrame) -> DataFrame:
    """Entry, add and exit events without trade numbers, as an old run would have stored them.

    An event's id is its trade's with one more digit, a decimal once a bigint does not hold it.
    """
    largest = trades.agg(F.max("id")).first()[0]
    trades = trades.withColumn("id", exact(F.col("id"), None if largest is None else int(largest) * 10 + 9))
    base = ["run_id", "chain", "ca", "pair_id"]
    entry = trades.select(
        (F.col("id") * 10 + 1).alias("event_id"), *base, F.col("entry_time").alias("time"),
        F.col("entry_price").alias("price"), "quantity", F.lit("entry").alias("signal_type"),
    )
    # Not posexplode: Spark drops branches over no rows through explode only.
    adds = trades.select("id", *base, F.explode(F.transform("adds", lambda a, i: F.struct(i.alias("pos"), a.alias("col")))).alias("_add")).select("id", *base, "_add.*").select(
        (F.col("id") * 10 + 2 + F.col("pos")).alias("event_id"), *base, F.col("col.time").alias("time"),
        F.col("col.price").alias("price"), F.col("col.quantity").alias("quantity"), F.lit("add").alias("signal_type"),
    )
    exits = trades.where("exit_time is not null").select(
        (F.col("id") * 10 + 9).alias("event_id"), *base, F.col("exit_time").alias("time"),
        F.col("exit_price").alias("price"), "quantity", F.col("exit_reason").alias("signal_type"),
    )
    return entry.unionByName(adds).unionByName(exits).withColumn("trade_no", F.lit(None).cast("long"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate scores per chain (market segment parity) and cohort (order year), one row each."""
    orders = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    price = F.round(F.col("o_totalprice") * 100).cast("long")
    return (
        orders.groupBy(
            F.concat(F.lit("E"), F.lpad((F.col("o_custkey") % 97).cast("string"), 4, "0")).alias("candidate_id"),
            F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string")).alias("chain"),
            ((year - 1995) % 5 + 1).cast("int").alias("cohort"),
        )
        .agg(
            (F.sum((price % 2000) - 900) / F.lit(100.0)).alias("account_return"),
            (F.sum((price % 1900) - 900) / F.lit(100.0)).alias("normal_return"),
            F.count(F.lit(1)).alias("total_trades"),
            (F.max(price % 1500) / F.lit(100.0)).alias("max_drawdown"),
            (F.sum((price % 2000) - 900) / F.lit(10.0)).alias("net_pnl"),
        )
    )
