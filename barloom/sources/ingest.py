"""Reading, validating and storing candles, signals, ticks and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.functions.candles import finite, valid_bar
from barloom.operators.quality import drop_conflicting_duplicates
from barloom.schemas import HISTORY, OHLCV, POOL, TOKEN

# Accepted chains, signal codes and field formats.
SIGNAL_CHAINS = ["sol", "bsc", "robin"]
DECIMAL_TEXT = r"^\d+(\.\d+)?$"
EVM_ADDRESS = r"^0x[0-9a-fA-F]{40}$"
BASE58_ADDRESS = r"^[1-9A-HJ-NP-Za-km-z]{32,44}$"


def scan_bars(
    bars: DataFrame, start: int, end: int, chain: str | None = None, ca: str | None = None,
    pair_id: str | None = None, interval: str | None = None, type: str | None = None, latest: int | None = None,
) -> DataFrame:
    """Valid bars in an inclusive range, ascending; equality filters prune partitions and reach the scan."""
    out = bars
    for name, wanted in {"type": type, "interval": interval, "chain": chain, "ca": ca, "pair_id": pair_id}.items():
        if wanted is not None:
            out = out.where(F.col(name) == wanted)
    out = out.where(F.col("time").between(start, end)).where(valid_bar("valid" in bars.columns))
    if latest is not None:
        out = out.orderBy(F.desc("time"), *POOL).limit(latest)
    return out.orderBy("time", *POOL)


def ingest_history(responses: DataFrame, step: int) -> DataFrame:
    """Candle rows of JSON responses with ``reason`` (null when valid); raw decimal text is kept.

    ``responses`` has ``body`` and the request columns ``chain, ca, pair_id, interval, type, from_time, to_time``.
    A response whose envelope does not match its request yields one row with reason ``envelope``.
    """
    parsed = responses.withColumn("r", F.from_json("body", HISTORY))
    d = F.col("r.data")
    good = F.coalesce(
        F.col("r.success") & (F.col("r.code") == "200") & (F.lower(d["chain"]) == F.col("chain")) & (d["pair_address"] == F.col("pair_id"))
        & (d["interval"] == F.col("interval")) & (d["value_type"] == F.col("type")) & d["items"].isNotNull(), F.lit(False))
    items = parsed.where(good).select(*POOL, "interval", "type", "from_time", "to_time", F.explode("r.data.items").alias("i"))
    time = F.when(F.col("i.start_time").rlike(r"^\d{1,15}$"), F.col("i.start_time").cast("long"))
    out = items.select(
        *POOL, "interval", "type", "from_time", "to_time", time.alias("time"),
        *[F.col(f"i.{v}").alias(f"{v}_text") for v in OHLCV],
        *[F.when((F.length(F.col(f"i.{v}")) <= 512) & F.col(f"i.{v}").rlike(DECIMAL_TEXT), F.col(f"i.{v}").try_cast("double")).alias(v) for v in OHLCV],
    )
    t = F.col("time")
    out = out.where(t.isNull() | (t <= 0) | (t % step != 0) | ((t >= F.col("from_time")) & (t + step <= F.col("to_time"))))
    reason = F.when(t.isNull() | (t <= 0) | (t % step != 0), "time")
    for v in OHLCV:
        reason = reason.when(F.col(v).isNull(), f"{v} format")
        reason = reason.when(~finite(F.col(v)) | ((F.col(v) <= 0) if v != "volume" else (F.col(v) < 0)), f"{v} range")
    reason = reason.when(
        (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.col("high")), "ohlc relation")
    rows = out.withColumn("reason", reason).drop("from_time", "to_time")
    refused = parsed.where(~good).select(*POOL, "interval", "type", F.lit("envelope").alias("reason"))
    return rows.unionByName(refused, allowMissingColumns=True)


def settle_history(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored candles, discarded rows by reason and key). Conflicting copies of one time are all discarded."""
    key = [*POOL, "interval", "type", "time"]
    fine = rows.where("reason is null")
    kept = drop_conflicting_duplicates(fine.select(*key, *OHLCV), key)
    conflicts = fine.join(kept, key, "left_anti").select(*key, F.lit("conflicting copies").alias("reason"))
    bad = rows.where("reason is not null").select(*key, "reason")
    return kept, bad.unionByName(conflicts)


def ingest_quality(discarded: DataFrame) -> DataFrame:
    return discarded.groupBy("reason").agg(F.count(F.lit(1)).alias("discarded"))


def quality_samples(discarded: DataFrame, n: int = 10) -> DataFrame:
    """At most ``n`` example rows (a report, not a filter on the data)."""
    return discarded.select("time", "reason").orderBy("time", "reason").limit(n)


BAR_KEY = [*POOL, "interval", "time", "type"]


def append_missing(target: DataFrame, new: DataFrame, key: Sequence[str] = BAR_KEY) -> DataFrame:
    """Insert-only merge: an existing key wins."""
    return target.unionByName(new.join(target, list(key), "left_anti"))


def upsert_bars(target: DataFrame, new: DataFrame, start: int, end: int, key: Sequence[str] = BAR_KEY) -> DataFrame:
    """Last write wins per key; new rows outside the range or with a missing value are skipped."""
    usable = new.where(F.col("time").between(start, end)).dropna(subset=OHLCV)
    rest = [c for c in target.columns if c not in key]
    both = target.withColumn("_p", F.lit(0)).unionByName(usable.withColumn("_p", F.lit(1)))
    return both.groupBy(*key).agg(F.max(F.struct("_p", *rest)).alias("_w")).select(*key, *[F.col(f"_w.{c}") for c in rest])


def read_pool_list(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``chain,ca,pair_id`` lines; ``#`` comments and blanks skipped; three non-empty fields required."""
    raw = spark.read.schema("chain string, ca string, pair_id string").csv(path, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return clean_pool_list(raw)


def clean_pool_list(raw: DataFrame) -> DataFrame:
    out = raw.select(*[F.trim(c).alias(c) for c in POOL])
    return out.where(" and ".join(f"{c} is not null and {c} <> ''" for c in POOL)).dropDuplicates(POOL)


def manifest(bars: DataFrame, dims: Sequence[str]) -> DataFrame:
    ok = valid_bar("valid" in bars.columns)
    return bars.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("valid_rows"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"),
        F.sum(F.pmod(F.xxhash64(*POOL, "time", *OHLCV), F.lit(2**31 - 1))).alias("content_sum"),
    )


def export_snapshot(bars: DataFrame, path: str, dims: Sequence[str] = ("chain", "interval", "type"), signals: DataFrame | None = None) -> DataFrame:
    """Write one partition per dimension value, clustered by pool and time, with a manifest next to it.

    Rows are range-partitioned first, so a hot dimension becomes many files rather than one task.
    """
    chosen = bars.join(signals.select(*TOKEN), TOKEN, "left_semi") if signals is not None else bars
    spread = chosen.repartitionByRange(*dims, "ca", "pair_id", "time").sortWithinPartitions(*dims, "ca", "pair_id", "time")
    spread.write.mode("overwrite").partitionBy(*dims).parquet(f"{path}/rows")
    written = chosen.sparkSession.read.parquet(f"{path}/rows")
    manifest(written, dims).write.mode("overwrite").parquet(f"{path}/manifest")
    return chosen.sparkSession.read.parquet(f"{path}/manifest")


def load_snapshot(spark: SparkSession, path: str, dims: Sequence[str] = ("chain", "interval", "type"), **wanted: str) -> DataFrame:
    """Rows of one snapshot with a missing close time filled in; refuses a snapshot that does not match its manifest."""
    rows, stored = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/manifest")
    for name, value in wanted.items():
        rows, stored = rows.where(F.col(name) == value), stored.where(F.col(name) == value)
    now = manifest(rows, dims)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in now.columns]
    if now.alias("a").join(stored.alias("b"), same, "left_anti").limit(1).count() or stored.alias("a").join(now.alias("b"), same, "left_anti").limit(1).count():
        raise ValueError("snapshot rows differ from their manifest")
    return rows


def snapshot_pools(rows: DataFrame) -> DataFrame:
    ok = valid_bar("valid" in rows.columns)
    return rows.groupBy(*POOL).agg(F.count_if(ok).alias("valid_rows"), F.count_if(~ok).alias("invalid_rows"))


def freeze_inputs(bars: DataFrame, selection: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """(selected bars, per-pool manifest with raw, gap-filled and invalid counts)."""
    from barloom.operators.quality import gap_stats

    chosen = bars.join(selection.select(*POOL), POOL, "left_semi")
    stats = gap_stats(chosen, step)
    pools = selection.select(*POOL).join(stats, POOL, "left").na.fill(0).select(
        *POOL, F.col("real_bars").alias("candle_count"), (F.col("real_bars") + F.col("synthetic_bars")).alias("normalized_count"),
        F.col("invalid_bars").alias("invalid_count"))
    return chosen, pools


IDENTITY = [*TOKEN, "signal_source", "detail_id"]


def ingest_signals(rows: DataFrame, provenance: Sequence[str] = ("file", "row")) -> dict[str, DataFrame]:
    """Signals by identity, conflicts, and provenance.

    Provenance stays one row per source reference (keyed by identity), so a signal copied many times never becomes
    one huge array.
    """
    ok = (
        F.trim("chain").isNotNull() & (F.trim("chain") != "") & (F.trim("ca") != "") & F.col("signal_source").isNotNull()
        & F.col("detail_id").isNotNull() & (F.col("signal_time") >= 0)
    )
    usable = rows.where(ok)
    content = F.struct("signal_time", "source_signal")
    merged = usable.groupBy(*IDENTITY).agg(
        F.min(content).alias("_a"), F.max(content).alias("_b"), F.count(F.lit(1)).alias("copies"))
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return {
        "events": merged.where(same).select(*IDENTITY, "_a.*", "copies", (F.col("copies") - 1).alias("duplicates")),
        "conflicts": merged.where(~same).select(*IDENTITY, "copies"),
        "provenance": usable.select(*IDENTITY, *provenance),
        "rejected": rows.where(~F.coalesce(ok, F.lit(False))),
    }


def earliest_manifest(events: DataFrame) -> DataFrame:
    """Earliest signal per token with the number of its sources and references."""
    first = F.min(F.struct("signal_time", "signal_source", "detail_id"))
    return events.where("signal_time is not null").groupBy(*TOKEN).agg(
        first.alias("f"), F.count(F.lit(1)).alias("references"), F.count_distinct("signal_source").alias("sources"),
    ).select(*TOKEN, "f.*", "references", "sources")


def match_signals(events: DataFrame, pools: DataFrame) -> dict[str, DataFrame]:
    """Matched and unmatched events, pools without a signal, and the earliest signal copied to each pool."""
    tokens = pools.select(*TOKEN).distinct()
    first = earliest_manifest(events).select(*TOKEN, "signal_time", "signal_source", "detail_id")
    return {
        "matched": events.join(tokens, TOKEN, "left_semi"),
        "unmatched": events.join(tokens, TOKEN, "left_anti"),
        "pools_without_signal": pools.join(first, TOKEN, "left_anti"),
        "token_info": pools.join(first, TOKEN),
    }


def write_results(path: str, **tables: DataFrame) -> None:
    for name, table in tables.items():
        table.write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")


def _parse(df: DataFrame, json: Column, name: str) -> DataFrame:
    """Parse JSON once into a map of text fields (nested objects stay JSON text; names keep their case).

    Going through ``explode`` of one element keeps the optimizer from copying the parse into every later filter.
    """
    return df.select("*", F.explode(F.array(F.from_json(json, "map<string,string>"))).alias(name))


def _text(record: str, names: Sequence[str]) -> Column:
    """First non-blank text among alias fields of a parsed record column."""
    return F.coalesce(*[F.when(F.trim(F.col(record)[n]) != "", F.col(record)[n]) for n in names])


def parse_ticks(messages: DataFrame, now: Column) -> DataFrame:
    """Strict trade messages (``body``) to ticks with ``ok``; a missing or zero market cap stays null."""
    raw = _parse(messages, F.col("body"), "_m")
    field = lambda name: F.col("_m")[name]
    number = lambda name: F.when(field(name).rlike(DECIMAL_TEXT), field(name).try_cast("double"))
    out = raw.select(
        *messages.columns, field("event_id").alias("id"), *[field(n).alias(n) for n in POOL],
        F.when(field("trade_time").rlike(r"^\d{1,15}$"), field("trade_time").try_cast("long")).alias("time"),
        number("price_usd").alias("price"), number("volume_usd").alias("volume_usd"), number("market_cap_usd").alias("_cap"),
    )
    ok = (
        (F.trim("id") != "") & F.col("chain").isNotNull() & F.col("ca").isNotNull() & (F.col("pair_id") != "")
        & (F.col("time") <= now + 5000) & finite(F.col("price")) & (F.col("price") > 0) & finite(F.col("volume_usd"))
    )
    cap = F.when(finite(F.col("_cap")) & (F.col("_cap") > 0), F.col("_cap"))
    return out.withColumn("mcap", cap).withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_cap")


def _ms(value: Column) -> Column:
    n = value.try_cast("double")
    return F.when((n == F.floor(n)) & (n > 1_000_000_000_000) & (n < 8_640_000_000_000_000), n.cast("long"))


def _number(record: str, names: Sequence[str]) -> Column:
    found = [F.col(record)[n].try_cast("double") for n in names]
    return F.coalesce(*[F.when(finite(v), v) for v in found])


# Alias field names of trade and signal payloads, in order of preference.
TRADE_ALIASES = {
    "chain": ("chain", "chainId"), "pair": ("pair_id", "pairId", "pair_address", "pairAddress"),
    "ca": ("token_address", "tokenAddress", "ca"), "id": ("tx_hash", "txHash", "signature", "id"),
    "time": ("timestamp", "trade_time", "tradeTime", "time"), "price": ("price_usd", "priceUsd", "priceUSD", "price"),
    "mcap": ("market_cap_usd", "marketCapUsd", "marketCapUSD", "mc"),
    "volume": ("usdAmount", "volume_usd", "volumeUsd", "amount_usd", "amountUsd", "total_usd", "totalUsd"),
}
SIGNAL_ALIASES = {
    "chain": ("chain", "chainId"), "source": ("signal_code", "signalCode", "signal_source", "signalSource"), "type": ("type",),
    "ca": ("ca", "token_address", "tokenAddress", "contract_address", "contractAddress"),
    "time": ("trigger_time_ms", "triggerTimeMs", "signal_time", "signalTime", "trigger_time", "triggerTime", "timestamp"),
    "detail": ("detail_id", "detailId", "event_id", "eventId", "id"), "multiple": ("reached_multiple",),
}


def parse_alias_ticks(messages: DataFrame) -> DataFrame:
    """Trade payloads with alias field names, checked against the expected pool of the subscription.

    ``messages`` has ``body`` (object or array), ``channel``, ``expected_channel`` and the pool columns.
    """
    a = TRADE_ALIASES
    body = F.when(F.ltrim("body").startswith("["), F.from_json("body", "array<string>")).otherwise(F.array("body"))
    rows = messages.where(F.col("channel") == F.col("expected_channel")).select(*POOL, F.explode(body).alias("m"))
    parsed = _parse(_parse(rows, F.col("m"), "_root"), F.coalesce(F.col("_root")["data"], F.col("m")), "_d")
    out = parsed.select(
        *POOL, _text("_d", a["chain"]).alias("_chain"), _text("_d", a["pair"]).alias("_pair"), _text("_d", a["ca"]).alias("_ca"),
        F.coalesce(_text("_d", a["id"]), _text("_root", ["id"])).alias("id"),
        _ms(F.coalesce(*[F.col("_d")[n] for n in a["time"]])).alias("time"), _number("_d", a["price"]).alias("price"),
        _number("_d", a["mcap"]).alias("_cap"), _number("_d", a["volume"]).alias("volume_usd"),
    )
    same = lambda x, y: F.col(x).isNull() | (F.lower(x) == F.lower(y))
    return out.where(
        same("_chain", "chain") & same("_pair", "pair_id") & same("_ca", "ca") & F.col("id").isNotNull()
        & F.col("time").isNotNull() & (F.col("price") > 0) & (F.col("volume_usd") >= 0)
    ).select(*POOL, "id", "time", "price", F.when(F.col("_cap") > 0, F.col("_cap")).alias("mcap"), "volume_usd")


def parse_signal_events(messages: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Alias-tolerant signal messages; repeats of an original trigger and malformed addresses are dropped."""
    a = SIGNAL_ALIASES
    root = F.col("_root")
    parsed = _parse(_parse(messages.select("body"), F.col("body"), "_root"), F.coalesce(root["data"], root["payload"], F.col("body")), "_d")
    out = parsed.select(
        F.lower(_text("_d", a["chain"])).alias("chain"),
        F.coalesce(_text("_d", a["source"]), _text("_root", a["source"]), _text("_d", a["type"])).alias("signal_source"),
        _text("_d", a["ca"]).alias("_ca"), _ms(F.coalesce(*[F.col("_d")[n] for n in a["time"]])).alias("signal_time"),
        F.coalesce(_text("_d", a["detail"]), _text("_root", ["id"])).alias("_detail"), F.col("_d")["reached_multiple"].alias("_multiple"),
    ).where(
        F.col("chain").isin(SIGNAL_CHAINS) & F.col("signal_source").isin(list(sources)) & F.col("_ca").isNotNull()
        & F.col("signal_time").isNotNull()
        & ~((F.col("signal_source") == "fomo_trending_new_project") & F.col("_multiple").isNotNull())
        & ((F.col("chain") == "sol") | F.col("_ca").rlike(EVM_ADDRESS))
    )
    ca = F.when(F.col("chain") == "sol", F.col("_ca")).otherwise(F.lower("_ca"))
    made = F.sha2(F.concat_ws(":", "chain", ca, "signal_source", F.col("signal_time").cast("string")), 256)
    return out.select("chain", ca.alias("ca"), "signal_source", "signal_time", F.coalesce("_detail", made).alias("detail_id"))


def ordered_scores(scores: DataFrame) -> DataFrame:
    return scores.orderBy("chain", F.desc_nulls_last("return_percent"), F.asc_nulls_last("max_drawdown_percent"), "ordinal")


def export_scores_csv(scores: DataFrame, path: str) -> None:
    """Range-partitioned sort: many files in global order."""
    ordered_scores(scores).write.mode("overwrite").csv(path, header=True)
