"""Catalog and dataset selection: tokens, pools, coverage of a selection, and signal resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions.candles import valid_bar
from barloom.operators.labels import earliest_signals
from barloom.schemas import POOL, TOKEN


def projects(bars: DataFrame) -> DataFrame:
    """Per pool: time range and the distinct intervals and value types (both are small fixed enums)."""
    return bars.groupBy(*POOL).agg(
        F.min("time").alias("min_time"), F.max("time").alias("max_time"),
        F.array_join(F.sort_array(F.collect_set("interval")), ",").alias("intervals"),
        F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"),
    )


def market_tokens(bars: DataFrame, start: int, end: int, interval: str, type: str) -> DataFrame:
    """Tokens with data in range, with the number of pools that have data and all pools of the token."""
    wanted = (F.col("interval") == interval) & (F.col("type") == type) & F.col("time").between(start, end) & valid_bar("valid" in bars.columns)
    pools = bars.groupBy(*POOL).agg(
        F.min(F.when(wanted, F.col("time"))).alias("lo"), F.max(F.when(wanted, F.col("time"))).alias("hi"))
    return pools.groupBy(*TOKEN).agg(
        F.min("lo").alias("min_time"), F.max("hi").alias("max_time"), F.count("lo").alias("available_pools"),
        F.count(F.lit(1)).alias("pools"), F.array_join(F.sort_array(F.collect_set("pair_id")), ",").alias("pair_ids"),
    ).where("available_pools > 0")


def chains(bars: DataFrame) -> DataFrame:
    return bars.select("chain").distinct()


def resolve_pools(bars: DataFrame, selection: DataFrame, interval: str, type: str, start: int, end: int) -> DataFrame:
    """Every pool of the selected tokens (or the exact pool where ``pair_id`` is given) with its range or ``no_data``."""
    wanted = (F.col("interval") == interval) & (F.col("type") == type) & F.col("time").between(start, end) & valid_bar("valid" in bars.columns)
    pools = bars.groupBy(*POOL).agg(
        F.min(F.when(wanted, F.col("time"))).alias("start_time"), F.max(F.when(wanted, F.col("time"))).alias("end_time"))
    s = selection.select(*TOKEN, F.col("pair_id").alias("_pair")) if "pair_id" in selection.columns else selection.select(*TOKEN, F.lit(None).cast("string").alias("_pair"))
    return (
        pools.join(s, TOKEN).where(F.col("_pair").isNull() | (F.col("_pair") == F.col("pair_id"))).drop("_pair").distinct()
        .withColumn("no_data", F.col("start_time").isNull())
    )


def tokens_without_data(resolved: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected tokens no pool of which has data; a run must refuse them."""
    return selection.select(*TOKEN).distinct().join(resolved.where("not no_data"), TOKEN, "left_anti")


def dataset_counts(resolved: DataFrame) -> DataFrame:
    tokens = resolved.groupBy(*TOKEN).agg(F.count(F.lit(1)).alias("p"), F.count_if(~F.col("no_data")).alias("a"))
    return tokens.agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("p").alias("pools"), F.sum("a").alias("available_pools"),
        (F.sum("p") - F.sum("a")).alias("no_data_pools"))


def cover_check(signals: DataFrame, selected: DataFrame) -> DataFrame:
    """Counts of selected tokens without a signal and of signals outside the selection; both must be zero."""
    a = selected.select(*TOKEN).distinct().withColumn("_s", F.lit(1))
    b = signals.select(*TOKEN).distinct().withColumn("_g", F.lit(1))
    return a.join(b, TOKEN, "full").agg(
        F.count_if(F.col("_g").isNull()).alias("missing_signals"), F.count_if(F.col("_s").isNull()).alias("foreign_signals"))


def resolve_signal_dataset(events: DataFrame, summary: DataFrame, pools: DataFrame) -> DataFrame:
    """Signal per token (summary overrides events) and its standing against the pools' last bars."""
    early = earliest_signals(events).withColumnRenamed("signal_time", "_event")
    final = early.join(summary.select(*TOKEN, F.col("signal_time").alias("_summary")), TOKEN, "full").select(
        *TOKEN, F.coalesce("_summary", "_event").alias("signal_time"))
    return pools.join(final, TOKEN, "left").select(
        *POOL, "signal_time", F.col("signal_time").isNull().alias("excluded"),
        F.coalesce(F.col("signal_time") >= F.col("last_time"), F.lit(False)).alias("no_opportunity"))


def update_token_summary(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Keep the earlier signal with its own source and identity."""
    both = current.unionByName(incoming).where("signal_time is not null")
    return both.groupBy(*TOKEN).agg(F.min(F.struct("signal_time", "signal_source", "detail_id")).alias("b")).select(*TOKEN, "b.*")


def external_signals(gates: DataFrame, supplements: DataFrame, start: int, end: int) -> DataFrame:
    """Gate rows plus supplemental events not already present; ``first`` marks each token's earliest."""
    columns = [*TOKEN, "signal_time", "detail_id"]
    extra = supplements.join(gates.select(*TOKEN, "signal_time"), [*TOKEN, "signal_time"], "left_anti")
    rows = gates.select(*columns).unionByName(extra.select(*columns))
    first = rows.groupBy(*TOKEN).agg(F.min(F.struct("signal_time", "detail_id")).alias("_f"))
    return rows.join(first, TOKEN).select(
        *columns, F.struct("signal_time", "detail_id").eqNullSafe(F.col("_f")).alias("first"),
    ).where(F.col("signal_time").between(start, end))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page; the page number is at least 1 and the size between 1 and 1000."""
    size = min(1000, max(1, int(size)))
    return df.orderBy(*order).offset((max(1, int(number)) - 1) * size).limit(size)


def select_tokens(all_tokens: DataFrame, chosen_chains: list[str], manual: DataFrame, excluded: DataFrame) -> DataFrame:
    picked = all_tokens.where(F.col("chain").isin(chosen_chains)).select(*TOKEN).unionByName(manual.select(*TOKEN))
    return picked.dropDuplicates(TOKEN).join(excluded.select(*TOKEN), TOKEN, "left_anti")
