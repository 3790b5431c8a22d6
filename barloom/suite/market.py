"""Queries over sources, quality and catalog operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.candles import valid_bar
from barloom.operators import catalog, quality
from barloom.operators.labels import earliest_signals
from barloom.schemas import OHLCV, POOL, TOKEN
from barloom.session import scratch
from barloom.sources import ingest, mapped
from barloom.suite.base import H4, SIGNALS, TICKS, VALID, bars_cte, base, query

JAN10, JAN20 = 1704844800000, 1705708800000


def raw_bars(spark, sf):
    """4 h bars with planted faults: every fifth count has high below low, every seventh is flagged invalid."""
    b = mapped.bars(spark, sf, H4)
    return b.withColumn("high", F.when(F.col("trade_count") % 5 == 0, F.col("low") * 0.5).otherwise(F.col("high"))).withColumn(
        "valid", F.when(F.col("trade_count") % 7 == 0, F.lit(False)))


RAW = """raw AS (SELECT * REPLACE (CASE WHEN trade_count%5=0 THEN low*0.5 ELSE high END AS high),
  CASE WHEN trade_count%7=0 THEN false END AS valid FROM bars)"""
RAW_OK = f"({VALID} AND coalesce(valid,true))"
R = "WITH" + TICKS + "," + bars_cte() + "," + RAW + "," + SIGNALS


def store(spark, sf):
    """Two intervals and two value types in one table, like a stored candle table."""
    def one(step, value, interval):
        return mapped.bars(spark, sf, step, value).withColumn("interval", F.lit(interval)).withColumn("type", F.lit(value))
    return one(H4, "price", "4h").unionByName(one(H4, "mcap", "4h")).unionByName(one(3 * H4, "price", "12h"))


STORE = "WITH" + TICKS + "," + ",".join([bars_cte(H4, "price", "b1"), bars_cte(H4, "mcap", "b2"), bars_cte(3 * H4, "price", "b3")]) + """,
store AS MATERIALIZED (SELECT *, '4h' AS interval, 'price' AS type FROM b1 UNION ALL SELECT *, '4h', 'mcap' FROM b2 UNION ALL SELECT *, '12h', 'price' FROM b3),""" + SIGNALS

KEYS = "chain, ca, pair_id"


@query("a1_scan_bars", R + f"SELECT {KEYS}, time, open, high, low, close, volume FROM raw WHERE {RAW_OK} AND time BETWEEN {JAN10} AND {JAN20}")
def _(spark, sf):
    return ingest.scan_bars(raw_bars(spark, sf), JAN10, JAN20).select(*POOL, "time", *OHLCV)


@query("a1_latest_bars", R + f"""SELECT * FROM (SELECT {KEYS}, time, close FROM raw WHERE {RAW_OK} AND time BETWEEN {JAN10} AND {JAN20}
  AND chain='c1' ORDER BY time DESC, chain, ca, pair_id LIMIT 25)""")
def _(spark, sf):
    return ingest.scan_bars(raw_bars(spark, sf), JAN10, JAN20, chain="c1", latest=25).select(*POOL, "time", "close")


def history(spark, sf):
    """History responses per pool and day, with equal copies, conflicting copies and broken rows planted."""
    b = mapped.bars(spark, sf, H4)
    n = F.col("trade_count")
    item = F.struct(
        F.col("time").cast("string").alias("start_time"), F.round("open", 4).cast("decimal(20,4)").cast("string").alias("open"),
        F.when(n % 5 == 0, "oops").otherwise(F.round("high", 4).cast("decimal(20,4)").cast("string")).alias("high"),
        F.round("low", 4).cast("decimal(20,4)").cast("string").alias("low"),
        F.round("close", 4).cast("decimal(20,4)").cast("string").alias("close"), F.col("volume").cast("long").cast("string").alias("volume"))
    copy = item.withField("volume", (F.col("volume").cast("long") + F.when(n % 3 == 0, 1).otherwise(0)).cast("string"))
    rows = b.withColumn("item", F.explode(F.when(n % 4 == 0, F.array(item, copy)).when(n % 3 == 0, F.array(item, copy)).otherwise(F.array(item))))
    day = F.floor(F.col("time") / 86_400_000) * 86_400_000
    # One response covers one pool and day: at most a handful of candles each.
    return rows.groupBy(*POOL, day.alias("from_time")).agg(F.collect_list("item").alias("items")).select(
        *POOL, F.lit("4h").alias("interval"), F.lit("price").alias("type"), "from_time", (F.col("from_time") + 86_400_000).alias("to_time"),
        F.to_json(F.struct(
            F.lit(True).alias("success"), F.when(F.col("from_time") % (7 * 86_400_000) == 0, "500").otherwise("200").alias("code"),
            F.struct(F.col("chain"), F.col("pair_id").alias("pair_address"), F.lit("4h").alias("interval"), F.lit("price").alias("value_type"), "items").alias("data"),
        )).alias("body"))


HIST = "WITH" + TICKS + "," + bars_cte() + """,
h AS (SELECT *, (time//86400000)*86400000 AS day FROM bars WHERE ((time//86400000)*86400000)%(7*86400000)<>0),
bad_days AS (SELECT DISTINCT chain,ca,pair_id,(time//86400000)*86400000 AS day FROM bars WHERE ((time//86400000)*86400000)%(7*86400000)=0)"""


@query("a2_ingest_history", HIST + f"""
SELECT {KEYS}, time, round(open,4) AS open, round(close,4) AS close, volume FROM h
WHERE trade_count%5<>0 AND round(open,4)>0 AND round(low,4)>0 AND round(close,4)>0 AND trade_count%3<>0""")
def _(spark, sf):
    kept, _bad = ingest.settle_history(ingest.ingest_history(history(spark, sf), H4))
    return kept.select(*POOL, "time", "open", "close", "volume")


@query("a3_drop_conflicting_duplicates", R + f""", two AS (SELECT {KEYS}, time, open, high, low, close, volume FROM bars
  UNION ALL SELECT {KEYS}, time, open, high, low, close, volume + CASE WHEN trade_count%3=0 THEN 1 ELSE 0 END FROM bars WHERE trade_count%2=0)
SELECT {KEYS}, time, min(open) AS open, min(high) AS high, min(low) AS low, min(close) AS close, min(volume) AS volume FROM two
GROUP BY {KEYS}, time HAVING count(DISTINCT (open,high,low,close,volume))=1""")
def _(spark, sf):
    b = mapped.bars(spark, sf, H4)
    again = b.where("trade_count % 2 = 0").withColumn("volume", F.col("volume") + F.when(F.col("trade_count") % 3 == 0, 1).otherwise(0))
    both = b.unionByName(again).select(*POOL, "time", *OHLCV)
    return quality.drop_conflicting_duplicates(both, [*POOL, "time"])


@query("a4_ingest_quality", HIST + """
, copies AS (SELECT *, CASE WHEN trade_count%4=0 OR trade_count%3=0 THEN 2 ELSE 1 END AS n FROM h),
d AS (SELECT CASE WHEN trade_count%5=0 THEN 'high format' WHEN round(open,4)<=0 THEN 'open range' WHEN round(high,4)<=0 THEN 'high range'
  WHEN round(low,4)<=0 THEN 'low range' WHEN round(close,4)<=0 THEN 'close range' WHEN trade_count%3=0 THEN 'conflicting copies' END AS reason, n FROM copies)
SELECT reason, CAST(sum(n) AS BIGINT) AS discarded FROM d WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'envelope', count(*) FROM bad_days HAVING count(*)>0""")
def _(spark, sf):
    _kept, bad = ingest.settle_history(ingest.ingest_history(history(spark, sf), H4))
    return ingest.ingest_quality(bad)


@query("a5_append_missing", STORE + f""", t AS (SELECT {KEYS}, interval, time, type, close FROM store WHERE trade_count%2=0),
n AS (SELECT {KEYS}, interval, time, type, -close AS close FROM store)
SELECT * FROM t UNION ALL SELECT n.* FROM n ANTI JOIN t USING (chain,ca,pair_id,interval,time,type)""")
def _(spark, sf):
    s = store(spark, sf)
    columns = [*POOL, "interval", "time", "type", "close"]
    target = s.where("trade_count % 2 = 0").select(*columns)
    return ingest.append_missing(target, s.withColumn("close", -F.col("close")).select(*columns))


@query("a6_upsert_bars", STORE + f""", n AS (SELECT * FROM store WHERE trade_count%3=0 AND time BETWEEN {JAN10} AND {JAN20})
SELECT {KEYS}, interval, time, type, s.close + CASE WHEN n.time IS NULL THEN 0 ELSE 1 END AS close FROM store s
LEFT JOIN n USING (chain,ca,pair_id,interval,time,type)""")
def _(spark, sf):
    s = store(spark, sf).select(*POOL, "interval", "time", "type", *OHLCV, "trade_count")
    new = s.where("trade_count % 3 = 0").withColumn("close", F.col("close") + 1).withColumn(
        "open", F.when(F.col("time") == 0, None).otherwise(F.col("open")))
    return ingest.upsert_bars(s, new, JAN10, JAN20).select(*POOL, "interval", "time", "type", "close")


@query("a7_read_pool_list", R + f"SELECT DISTINCT {KEYS} FROM ticks")
def _(spark, sf):
    path = scratch(spark, "pools")
    t = mapped.ticks(spark, sf)
    lines = t.select(F.concat_ws(",", F.concat(F.lit(" "), "chain"), "ca", "pair_id").alias("value")).unionByName(
        t.select(F.concat(F.lit("# "), "id").alias("value"))).unionByName(t.select(F.concat_ws(",", "chain", F.lit(""), "pair_id").alias("value")))
    lines.write.text(path)
    return ingest.read_pool_list(spark, path)


_MANIFEST = "count(*) AS rows, count_if({ok}) AS valid_rows, min(time) AS first_time, max(time) AS last_time"


@query("a8_export_snapshot", STORE + f"SELECT chain, interval, type, {_MANIFEST.format(ok=VALID)} FROM store SEMI JOIN gate USING (chain, ca) GROUP BY ALL")
def _(spark, sf):
    path = scratch(spark, "snapshot")
    out = ingest.export_snapshot(store(spark, sf), path, signals=earliest_signals(mapped.signals(spark, sf)))
    return out.drop("content_sum")


@query("a9_load_snapshot", STORE + f"SELECT {KEYS}, count_if({VALID}) AS valid_rows, count_if(NOT ({VALID})) AS invalid_rows FROM store WHERE chain='c0' AND interval='4h' AND type='price' GROUP BY ALL")
def _(spark, sf):
    path = scratch(spark, "snapshot")
    ingest.export_snapshot(store(spark, sf), path)
    return ingest.snapshot_pools(ingest.load_snapshot(spark, path, chain="c0", interval="4h", type="price")).select(*POOL, "valid_rows", "invalid_rows")


_GAPS = f"""
ok AS (SELECT *, lag(time) OVER (PARTITION BY {KEYS} ORDER BY time) AS prev_time FROM raw WHERE {RAW_OK}),
inv AS (SELECT {KEYS}, count(*) AS invalid_bars FROM raw WHERE NOT {RAW_OK} GROUP BY ALL),
gs AS (SELECT {KEYS}, count(*) AS real_bars,
  CAST(coalesce(sum(greatest(0, ceil((time-prev_time)/{H4}.0)-1)),0) AS BIGINT) AS synthetic_bars,
  CAST(coalesce(sum(CASE WHEN time-prev_time>{H4} THEN 1 ELSE 0 END),0) AS BIGINT) AS gaps FROM ok GROUP BY ALL)"""


@query("a10_freeze_inputs", R + "," + _GAPS + f""" SELECT {KEYS}, real_bars AS candle_count, real_bars+synthetic_bars AS normalized_count, coalesce(invalid_bars,0) AS invalid_count
FROM gs LEFT JOIN inv USING ({KEYS}) WHERE chain='c1'""")
def _(spark, sf):
    raw = raw_bars(spark, sf)
    return ingest.freeze_inputs(raw, raw.where("chain='c1'").select(*POOL).distinct(), H4)[1]


def signal_rows(spark, sf):
    s = mapped.signals(spark, sf).withColumn("file", F.lit("f1")).withColumn("row", F.col("detail_id").cast("long"))
    again = s.where(F.col("row") % 4 == 0).withColumn("file", F.lit("f2")).withColumn(
        "signal_time", F.col("signal_time") + F.when(F.col("row") % 8 == 0, 1).otherwise(0))
    return s.unionByName(again)


_SIGROWS = """, sr AS (SELECT *, 'f1' AS file FROM signals UNION ALL SELECT * REPLACE (signal_time + CASE WHEN CAST(detail_id AS BIGINT)%8=0 THEN 1 ELSE 0 END AS signal_time), 'f2' FROM signals WHERE CAST(detail_id AS BIGINT)%4=0)"""


@query("a11_ingest_signals", R + _SIGROWS + """ SELECT chain, ca, signal_source, detail_id, min(signal_time) AS signal_time, count(*) AS copies, count(*)-1 AS duplicates FROM sr WHERE signal_time>=0
GROUP BY ALL HAVING count(DISTINCT signal_time)=1""")
def _(spark, sf):
    return ingest.ingest_signals(signal_rows(spark, sf))["events"].drop("source_signal")


@query("a11_signal_conflicts", R + _SIGROWS + """ SELECT chain, ca, signal_source, detail_id, count(*) AS copies FROM sr WHERE signal_time>=0
GROUP BY ALL HAVING count(DISTINCT signal_time)>1""")
def _(spark, sf):
    return ingest.ingest_signals(signal_rows(spark, sf))["conflicts"]


@query("a11_signal_provenance", R + _SIGROWS + " SELECT chain, ca, signal_source, detail_id, file, CAST(detail_id AS BIGINT) AS row FROM sr WHERE signal_time>=0")
def _(spark, sf):
    return ingest.ingest_signals(signal_rows(spark, sf))["provenance"]


_EARLY = """ SELECT chain, ca, first(signal_time ORDER BY signal_time, signal_source, detail_id) AS signal_time, first(signal_source ORDER BY signal_time, signal_source, detail_id) AS signal_source,
 first(detail_id ORDER BY signal_time, signal_source, detail_id) AS detail_id"""


@query("a12_earliest_manifest", R + _EARLY + ", count(*) AS \"references\", count(DISTINCT signal_source) AS sources FROM signals WHERE signal_time IS NOT NULL GROUP BY chain, ca")
def _(spark, sf):
    return ingest.earliest_manifest(mapped.signals(spark, sf))


def some_pools(spark, sf):
    return mapped.ticks(spark, sf).where("not (chain='c1' and ca='t3')").select(*POOL).distinct().unionByName(
        mapped.ticks(spark, sf).where("price > 100").select("chain", F.concat(F.lit("z"), "ca").alias("ca"), "pair_id").distinct())


_POOLS = f""", pools AS (SELECT DISTINCT {KEYS} FROM ticks WHERE NOT (chain='c1' AND ca='t3') UNION SELECT DISTINCT chain, 'z'||ca, pair_id FROM ticks WHERE price>100)"""


@query("a13_matched_signals", R + _POOLS + " SELECT chain, ca, signal_source, detail_id, signal_time FROM signals SEMI JOIN pools USING (chain, ca)")
def _(spark, sf):
    return ingest.match_signals(mapped.signals(spark, sf), some_pools(spark, sf))["matched"].drop("source_signal")


@query("a13_unmatched_signals", R + _POOLS + " SELECT chain, ca, signal_source, detail_id, signal_time FROM signals ANTI JOIN pools USING (chain, ca)")
def _(spark, sf):
    return ingest.match_signals(mapped.signals(spark, sf), some_pools(spark, sf))["unmatched"].drop("source_signal")


@query("a13_pools_without_signal", R + _POOLS + f" SELECT {KEYS} FROM pools ANTI JOIN gate USING (chain, ca)")
def _(spark, sf):
    return ingest.match_signals(mapped.signals(spark, sf), some_pools(spark, sf))["pools_without_signal"]


@query("a13_token_info", R + _POOLS + f", e AS ({_EARLY} FROM signals WHERE signal_time IS NOT NULL GROUP BY chain, ca) SELECT {KEYS}, signal_time, signal_source, detail_id FROM pools JOIN e USING (chain, ca)")
def _(spark, sf):
    return ingest.match_signals(mapped.signals(spark, sf), some_pools(spark, sf))["token_info"]


@query("a14_write_results", """SELECT 'r'||(l_orderkey%2) AS run_id, count(*) AS trades, count_if(l_partkey%11<>0) AS closed FROM lineitem GROUP BY 1""")
def _(spark, sf):
    path = scratch(spark, "results")
    ingest.write_results(path, trades=mapped.run_trades(spark, sf))
    back = spark.read.parquet(f"{path}/trades")
    return back.groupBy("run_id").agg(F.count(F.lit(1)).alias("trades"), F.count("exit_time").alias("closed"))


def tick_messages(spark, sf):
    t = mapped.ticks(spark, sf)
    n = F.col("id").cast("long")
    return t.select(F.to_json(F.struct(
        F.col("id").alias("event_id"), "chain", "ca", "pair_id", F.col("time").alias("trade_time"),
        F.when(n % 10 == 0, "1e9").otherwise(F.format_string("%.4f", "price")).alias("price_usd"),
        F.format_string("%.0f", "volume_usd").alias("volume_usd"),
        F.when(n % 6 == 0, "0").otherwise(F.format_string("%.2f", "mcap")).alias("market_cap_usd"))).alias("body"))


@query("a15_parse_ticks", R + f"""SELECT id, {KEYS}, time, round(price,4) AS price, volume_usd, CASE WHEN CAST(id AS BIGINT)%6<>0 AND round(mcap,2)>0 THEN round(mcap,2) END AS mcap
FROM ticks WHERE CAST(id AS BIGINT)%10<>0 AND round(price,4)>0""")
def _(spark, sf):
    out = ingest.parse_ticks(tick_messages(spark, sf), F.lit(1704067200000 + 40 * 86_400_000))
    return out.where("ok").select("id", *POOL, "time", "price", "volume_usd", "mcap")


@query("a15_parse_alias_ticks", R + f"""SELECT {KEYS}, id, time, round(price,4) AS price, CASE WHEN round(mcap,2)>0 THEN round(mcap,2) END AS mcap, volume_usd FROM ticks
WHERE round(price,4)>0 AND CAST(id AS BIGINT)%9<>0 AND CAST(id AS BIGINT)%7<>0""")
def _(spark, sf):
    t = mapped.ticks(spark, sf)
    n = F.col("id").cast("long")
    one = F.to_json(F.struct(
        F.when(n % 2 == 0, F.col("id")).alias("tx_hash"), F.when(n % 2 == 1, F.col("id")).alias("signature"),
        F.when(n % 7 == 0, "other").otherwise(F.col("chain")).alias("chainId"), F.upper("pair_id").alias("pairId"), F.col("time").alias("tradeTime"),
        F.round("price", 4).alias("priceUsd"), F.round("mcap", 2).alias("mc"), F.col("volume_usd").alias("usdAmount")))
    messages = t.select(*POOL, F.when(n % 3 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one).alias("body"),
                        F.when(n % 9 == 0, "b").otherwise("a").alias("channel"), F.lit("a").alias("expected_channel"))
    return ingest.parse_alias_ticks(messages)


@query("a16_parse_signal_events", R + """SELECT CASE WHEN chain='c0' THEN 'sol' ELSE 'bsc' END AS chain, CASE WHEN chain='c0' THEN ca ELSE '0x'||repeat('a',39)||right(ca,1) END AS ca,
 signal_source, signal_time, CASE WHEN CAST(detail_id AS BIGINT)%2=0 THEN detail_id ELSE sha256((CASE WHEN chain='c0' THEN 'sol:'||ca ELSE 'bsc:0x'||repeat('a',39)||right(ca,1) END)||':'||signal_source||':'||signal_time) END AS detail_id
FROM signals WHERE signal_source IN ('s0','s1') AND signal_time IS NOT NULL AND CAST(detail_id AS BIGINT)%5<>0""")
def _(spark, sf):
    s = mapped.signals(spark, sf)
    n = F.col("detail_id").cast("long")
    body = F.to_json(F.struct(F.struct(
        F.when(F.col("chain") == "c0", "SOL").otherwise("bsc").alias("chain"),
        F.when(F.col("chain") == "c0", F.col("ca")).when(n % 5 == 0, "0x12").otherwise(F.concat(F.lit("0x"), F.repeat(F.lit("A"), 39), F.substring("ca", 2, 1))).alias("tokenAddress"),
        F.when((F.col("chain") == "c0") & (n % 5 == 0), "nope").otherwise(F.col("signal_source")).alias("signalCode"), F.col("signal_time").alias("triggerTime"),
        F.when(n % 2 == 0, F.col("detail_id")).alias("eventId")).alias("data")))
    return ingest.parse_signal_events(s.select(body.alias("body")), ["s0", "s1"])


_LEDGER = """, sc AS (SELECT 'E'||lpad(CAST(o_custkey%97 AS VARCHAR),4,'0') AS candidate_id, 'c'||(o_custkey%3) AS chain, CAST((year(o_orderdate)-1995)%5+1 AS INTEGER) AS cohort,
  sum((CAST(round(o_totalprice*100) AS BIGINT)%2000)-900)/100.0 AS account_return, sum((CAST(round(o_totalprice*100) AS BIGINT)%1900)-900)/100.0 AS normal_return,
  count(*) AS total_trades, max(CAST(round(o_totalprice*100) AS BIGINT)%1500)/100.0 AS max_drawdown, sum((CAST(round(o_totalprice*100) AS BIGINT)%2000)-900)/10.0 AS net_pnl
  FROM orders GROUP BY ALL)"""


@query("a17_export_scores_csv", R + _LEDGER + " SELECT chain, candidate_id, account_return AS return_percent, max_drawdown AS max_drawdown_percent, cohort AS ordinal FROM sc")
def _(spark, sf):
    path = scratch(spark, "scores")
    s = mapped.scores(spark, sf).select("chain", "candidate_id", F.col("account_return").alias("return_percent"),
                                        F.col("max_drawdown").alias("max_drawdown_percent"), F.col("cohort").alias("ordinal"))
    ingest.export_scores_csv(s, path)
    return spark.read.schema(s.schema).csv(path, header=True)


B = base()


@query("b1_valid_bars", R + f"SELECT {KEYS}, count(*) AS bars, count_if({RAW_OK}) AS valid_bars FROM raw GROUP BY ALL")
def _(spark, sf):
    return raw_bars(spark, sf).groupBy(*POOL).agg(F.count(F.lit(1)).alias("bars"), F.count_if(valid_bar(True)).alias("valid_bars"))


@query("b2_fill_gaps", B + f" SELECT {KEYS}, time, close_time, open, high, low, close, volume, synthetic FROM filled")
def _(spark, sf):
    ready = quality.index_bars(quality.only_valid(mapped.bars(spark, sf, H4)), H4, block=64)
    return quality.fill_gaps(ready, H4).select(*POOL, "time", "close_time", *OHLCV, "synthetic")


@query("b3_gap_stats", R + "," + _GAPS + f" SELECT {KEYS}, coalesce(real_bars,0) AS real_bars, coalesce(synthetic_bars,0) AS synthetic_bars, coalesce(gaps,0) AS gaps, coalesce(invalid_bars,0) AS invalid_bars FROM gs FULL JOIN inv USING ({KEYS})")
def _(spark, sf):
    return quality.gap_stats(raw_bars(spark, sf), H4, block=64)


@query("b4_bar_index", B + f" SELECT {KEYS}, time, idx FROM ix")
def _(spark, sf):
    return quality.index_bars(quality.only_valid(mapped.bars(spark, sf, H4)), H4, block=64).select(*POOL, "time", "idx")


@query("b5_normalize_identity", "SELECT lower(trim(s)) AS chain, CASE WHEN lower(trim(s))='sol' THEN n ELSE lower(n) END AS ca, c_custkey AS id FROM (SELECT c_custkey, c_name AS n, CASE WHEN c_custkey%2=0 THEN ' SOL ' ELSE 'Bsc' END AS s FROM customer)")
def _(spark, sf):
    c = mapped.table(spark, sf, "customer")
    raw = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, " SOL ").otherwise("Bsc").alias("chain"), F.concat(F.lit(" "), "c_name").alias("ca"))
    return quality.normalize_identity(raw)


@query("b6_normalize_supply", """SELECT p_partkey AS id, CASE WHEN p_partkey%7=0 THEN NULL WHEN p_partkey%2=0 THEN round(CAST(p_retailprice AS DOUBLE),6) ELSE round((p_partkey*1000000+1)/1e4,6) END AS tokens,
 CASE WHEN p_partkey%7=0 THEN 'supply unit unknown' END AS reason FROM part""")
def _(spark, sf):
    p = mapped.table(spark, sf, "part")
    k = F.col("p_partkey")
    value = F.when(k % 2 == 0, F.format_string("%.2f", "p_retailprice")).otherwise((k * 1000000 + 1).cast("string"))
    rows = p.select(k.alias("id"), value.alias("value"), F.when(k % 7 == 0, "cups").when(k % 2 == 0, "tokens").otherwise("raw").alias("unit"), F.lit("4").alias("decimals"))
    tokens, reason = quality.normalize_supply(F.col("value"), F.col("unit"), F.col("decimals"))
    return rows.select("id", F.round(tokens.cast("double"), 6).alias("tokens"), reason.alias("reason"))


@query("b7_resolve_market_cap", R + f"SELECT id, {KEYS}, CASE WHEN mcap>0 THEN 'ws' WHEN price>0 AND ca<>'t3' THEN 'price_supply' END AS basis, round(CASE WHEN mcap>0 THEN mcap WHEN price>0 AND ca<>'t3' THEN price*(100+CAST(right(ca,1) AS INT)) END,6) AS market_cap FROM ticks")
def _(spark, sf):
    t = mapped.ticks(spark, sf)
    supply = t.select(*TOKEN).distinct().where("ca <> 't3'").withColumn("tokens", (F.lit(100) + F.substring("ca", 2, 1).cast("int")).cast("decimal(38,18)"))
    return quality.resolve_market_cap(t, supply).select("id", *POOL, "basis", F.round("market_cap", 6).alias("market_cap"))


@query("b8_resolve_main_pool", "SELECT s_suppkey AS id, CASE WHEN s_suppkey%3=0 THEN CASE WHEN s_suppkey%2=0 THEN NULL ELSE 'outer-x' END WHEN s_suppkey%3=1 THEN 'inner' END AS dex FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey")
    s = mapped.table(spark, sf, "supplier")
    dex = quality.resolve_main_pool(
        F.col("s_name"), F.when(k % 3 == 0, F.upper("s_name")).otherwise("none"), F.when(k % 2 == 0, "Bad Name").otherwise("outer-x"),
        F.when(k % 3 == 1, F.lower("s_name")).otherwise("none"), F.lit("inner"))
    return s.select(k.alias("id"), dex.alias("dex"))


@query("b9_resolve_created_at", "SELECT o_orderkey AS id, CASE WHEN o_orderkey%4<>3 THEN epoch_us(o_orderdate)//1000 END AS created_at FROM orders")
def _(spark, sf):
    o = mapped.table(spark, sf, "orders")
    k, ms = F.col("o_orderkey"), mapped.epoch_ms("o_orderdate")
    seconds = (ms / 1000).cast("long").cast("string")
    first = F.when(k % 4 == 0, seconds).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 3, "9999999999999")
    second = F.when(k % 4 == 2, seconds).when(k % 4 == 3, "junk")
    return o.select(k.alias("id"), quality.resolve_created_at(first, second, F.lit(1900000000000)).alias("created_at"))


_CMP = f""", l AS (SELECT * FROM filled WHERE idx%10<>0), r AS (SELECT {KEYS}, time, open, high, low, close*(CASE WHEN trade_count%4=0 THEN 1.01 ELSE 1 END) AS close, volume FROM bars),
p AS (SELECT l.time IS NOT NULL AS il, r.time IS NOT NULL AS ir, coalesce(l.synthetic,false) AS syn, l.close AS lc, r.close AS rc FROM l FULL JOIN r ON l.chain=r.chain AND l.ca=r.ca AND l.pair_id=r.pair_id AND l.time=r.time),
d AS (SELECT *, il AND ir AND abs(lc-rc)>1e-8*greatest(abs(lc),abs(rc)) AS df, CASE WHEN il AND ir AND abs(lc-rc)>1e-8*greatest(abs(lc),abs(rc)) AND rc<>0 THEN abs(lc-rc)/abs(rc)*100 END AS pc FROM p)
SELECT count_if(il AND ir) AS overlap, count_if(il AND NOT ir) AS only_left, count_if(ir AND NOT il) AS only_right, count_if(il AND ir AND syn) AS synthetic_overlap, count_if(il AND ir AND NOT syn) AS real_overlap,
count_if(il AND ir AND NOT coalesce(df,false)) AS all_equal, count_if(df) AS close_different, round(coalesce(max(pc),0),6) AS close_max_percent, round(coalesce(sum(pc),0),4) AS close_sum_percent FROM d"""


@query("b10_compare_series", B + _CMP)
def _(spark, sf):
    b = mapped.bars(spark, sf, H4)
    left = quality.fill_gaps(quality.index_bars(quality.only_valid(b), H4), H4).where("idx % 10 <> 0").select(*POOL, "time", *OHLCV, "synthetic")
    right = b.withColumn("close", F.col("close") * F.when(F.col("trade_count") % 4 == 0, 1.01).otherwise(1.0)).select(*POOL, "time", *OHLCV)
    out, _ = quality.compare_series(left, right, [*POOL, "time"])
    return out.select("overlap", "only_left", "only_right", "synthetic_overlap", "real_overlap", "all_equal", "close_different", "close_max_percent", "close_sum_percent")


@query("b11_coverage", R + f""", e AS (SELECT * FROM gate WHERE ca<>'t2'), pl AS (SELECT {KEYS}, count(*) AS n, count_if({RAW_OK}) AS ok, max(CASE WHEN {RAW_OK} THEN time END) AS last, min(time) AS f, max(time) AS x FROM raw GROUP BY ALL),
tk AS (SELECT chain, ca, sum(n) AS n, sum(ok) AS ok, count(*) AS pools, count_if(ok=0) AS ep, max(last) AS last, min(f) AS f, max(x) AS x, any_value(signal_time) AS st FROM pl LEFT JOIN e USING (chain,ca) GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n)-sum(ok) AS BIGINT) AS invalid, CAST(sum(pools) AS BIGINT) AS pools, count(*) AS tokens, count_if(st IS NULL) AS tokens_without_signal, CAST(sum(ep) AS BIGINT) AS pools_without_valid,
count_if(last<=st) AS tokens_ended, min(f) AS first_time, max(x) AS last_time FROM tk""")
def _(spark, sf):
    return quality.coverage(raw_bars(spark, sf), earliest_signals(mapped.signals(spark, sf)).where("ca <> 't2'"))


@query("b12_eligible_tokens", STORE + f""", lb AS (SELECT chain, ca, interval||type AS iv, max(time) AS lt FROM store WHERE NOT (ca='t1' AND type='mcap') GROUP BY ALL),
s2 AS (SELECT chain, ca, CASE WHEN ca='t2' THEN 1900000000000 ELSE signal_time END AS signal_time FROM gate)
SELECT chain, ca, signal_time, (SELECT count(DISTINCT iv) FROM lb WHERE lb.chain=s2.chain AND lb.ca=s2.ca AND lt>signal_time)=3 AS eligible FROM s2""")
def _(spark, sf):
    last = store(spark, sf).where("not (ca='t1' and type='mcap')").groupBy(*TOKEN, F.concat("interval", "type").alias("interval")).agg(F.max("time").alias("last_time"))
    sig = earliest_signals(mapped.signals(spark, sf)).withColumn("signal_time", F.when(F.col("ca") == "t2", 1900000000000).otherwise(F.col("signal_time")))
    return quality.eligible_tokens(sig, last, 3)


@query("b13_contiguous_tail", R + f""", af AS (SELECT {KEYS}, min(time) AS after_time FROM bars GROUP BY ALL), l AS (SELECT b.*, after_time, row_number() OVER (PARTITION BY {KEYS} ORDER BY time) AS rn FROM bars b JOIN af USING ({KEYS}) WHERE time>after_time),
g AS (SELECT {KEYS}, after_time, min(CASE WHEN time<>after_time+rn*{H4} THEN rn END) AS br, count(*) AS n, max(time) AS last_time FROM l GROUP BY ALL)
SELECT {KEYS}, after_time, coalesce(br-1,n) AS run_bars, br IS NOT NULL AS has_hole, (coalesce(br-1,n)>=64 AND br IS NULL) AS sufficient, last_time FROM g""")
def _(spark, sf):
    b = mapped.bars(spark, sf, H4)
    after = b.groupBy(*POOL).agg(F.min("time").alias("after_time"))
    need = quality.required_history({"lookback": 59, "left": 2, "right": 2}, [10, 14])
    return quality.contiguous_tail(b, after, H4, need, block=64)


@query("b15_backfill_windows", R + f""", r AS (SELECT {KEYS}, min(time) AS from_time, max(time) AS to_time FROM bars GROUP BY ALL) SELECT {KEYS}, from_time, to_time, unnest(generate_series(from_time, to_time-1, {H4}*50)) AS window_from,
 least(to_time, unnest(generate_series(from_time, to_time-1, {H4}*50))+{H4}*50) AS window_to FROM r WHERE to_time>from_time""")
def _(spark, sf):
    r = mapped.bars(spark, sf, H4).groupBy(*POOL).agg(F.min("time").alias("from_time"), F.max("time").alias("to_time"))
    return quality.backfill_windows(r, H4, 50)


@query("b16_closed_before", R + f" SELECT {KEYS}, time, close_time FROM bars WHERE time<{JAN20}+3600000 AND close_time<={JAN20}+3600000")
def _(spark, sf):
    return quality.closed_before(mapped.bars(spark, sf, H4), F.lit(JAN20 + 3_600_000)).select(*POOL, "time", "close_time")


@query("b17_enrich_identity", "SELECT s_suppkey AS id, 'c'||(s_nationkey%2) AS chain, 't'||(s_nationkey) AS ca, n_name AS name, CASE WHEN n_nationkey%2=0 THEN 'https://x/'||n_nationkey END AS url FROM supplier LEFT JOIN nation ON s_nationkey=n_nationkey AND n_nationkey<20")
def _(spark, sf):
    n = mapped.table(spark, sf, "nation").where("n_nationkey < 20")
    k = F.col("n_nationkey")
    lookup = n.select(F.concat(F.lit("c"), (k % 2).cast("string")).alias("chain"), F.concat(F.lit("t"), k.cast("string")).alias("ca"), F.col("n_name").alias("name"),
                      F.concat(F.when(k % 2 == 0, "https://x/").otherwise("ftp://x/"), k.cast("string")).alias("url"))
    s = F.col("s_nationkey")
    tokens = mapped.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("c"), (s % 2).cast("string")).alias("chain"), F.concat(F.lit("t"), s.cast("string")).alias("ca"))
    return quality.enrich_identity(tokens, lookup)


@query("c1_projects", STORE + f" SELECT {KEYS}, min(time) AS min_time, max(time) AS max_time, string_agg(DISTINCT interval, ',' ORDER BY interval) AS intervals, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM store GROUP BY ALL")
def _(spark, sf):
    return catalog.projects(store(spark, sf))


_MT = f"interval='4h' AND type='mcap' AND {VALID} AND time BETWEEN {JAN10} AND {JAN10}+{H4}*3"


@query("c2_market_tokens", STORE + f", e AS (SELECT chain, ca, min(time) AS min_time, max(time) AS max_time, count(DISTINCT pair_id) AS available_pools FROM store WHERE {_MT} GROUP BY ALL), p AS (SELECT DISTINCT {KEYS} FROM store) SELECT e.*, count(*) AS pools, string_agg(pair_id, ',' ORDER BY pair_id) AS pair_ids FROM e JOIN p USING (chain, ca) GROUP BY ALL")
def _(spark, sf):
    return catalog.market_tokens(store(spark, sf), JAN10, JAN10 + 3 * H4, "4h", "mcap")


@query("c3_chains", R + " SELECT DISTINCT chain FROM bars")
def _(spark, sf):
    return catalog.chains(mapped.bars(spark, sf, H4))


def _selection(spark, sf):
    return mapped.ticks(spark, sf).select(*TOKEN).distinct().where("ca <> 't0'")


_RP = f""", r AS (SELECT {KEYS}, min(CASE WHEN {_MT} THEN time END) AS start_time, max(CASE WHEN {_MT} THEN time END) AS end_time FROM store WHERE ca<>'t0' GROUP BY ALL)"""


@query("c4_resolve_pools", STORE + _RP + " SELECT *, start_time IS NULL AS no_data FROM r")
def _(spark, sf):
    return catalog.resolve_pools(store(spark, sf), _selection(spark, sf), "4h", "mcap", JAN10, JAN10 + 3 * H4)


@query("c5_dataset_counts", STORE + _RP + " SELECT count(DISTINCT (chain,ca)) AS tokens, count(*) AS pools, count(start_time) AS available_pools, count(*)-count(start_time) AS no_data_pools FROM r")
def _(spark, sf):
    return catalog.dataset_counts(catalog.resolve_pools(store(spark, sf), _selection(spark, sf), "4h", "mcap", JAN10, JAN10 + 3 * H4))


@query("c6_earliest_signals", R + " SELECT * FROM gate")
def _(spark, sf):
    return earliest_signals(mapped.signals(spark, sf))


@query("c6_cover_check", R + ", s AS (SELECT DISTINCT chain, ca FROM ticks WHERE ca<>'t0' UNION SELECT 'c9','t9'), g AS (SELECT chain, ca FROM gate) SELECT (SELECT count(*) FROM s ANTI JOIN g USING (chain,ca)) AS missing_signals, (SELECT count(*) FROM g ANTI JOIN s USING (chain,ca)) AS foreign_signals")
def _(spark, sf):
    extra = mapped.ticks(spark, sf).select(F.lit("c9").alias("chain"), F.lit("t9").alias("ca")).distinct()
    return catalog.cover_check(earliest_signals(mapped.signals(spark, sf)), _selection(spark, sf).unionByName(extra))


@query("c7_resolve_signal_dataset", R + f""", pl AS (SELECT {KEYS}, max(time) AS last_time FROM bars GROUP BY ALL), sm AS (SELECT chain, ca, CASE WHEN ca='t1' THEN 1900000000000 ELSE signal_time+1 END AS signal_time FROM gate WHERE ca IN ('t1','t2')),
f AS (SELECT chain, ca, coalesce(sm.signal_time, gate.signal_time) AS signal_time FROM gate FULL JOIN sm USING (chain,ca) WHERE ca<>'t3')
SELECT {KEYS}, signal_time, signal_time IS NULL AS excluded, coalesce(signal_time>=last_time,false) AS no_opportunity FROM pl LEFT JOIN f USING (chain,ca)""")
def _(spark, sf):
    events = mapped.signals(spark, sf).where("ca <> 't3'")
    summary = earliest_signals(events).where("ca in ('t1','t2')").withColumn("signal_time", F.when(F.col("ca") == "t1", 1900000000000).otherwise(F.col("signal_time") + 1))
    pools = mapped.bars(spark, sf, H4).groupBy(*POOL).agg(F.max("time").alias("last_time"))
    return catalog.resolve_signal_dataset(events, summary, pools)


@query("c8_update_token_summary", R + _EARLY + " FROM signals WHERE signal_time IS NOT NULL GROUP BY chain, ca")
def _(spark, sf):
    s = mapped.signals(spark, sf).drop("source_signal")
    return catalog.update_token_summary(s.where("signal_source = 's0'"), s.where("signal_source <> 's0'"))


@query("c9_external_signals", R + f""", g AS (SELECT chain, ca, signal_time, detail_id FROM signals WHERE signal_source='s0' AND signal_time IS NOT NULL), x AS (SELECT chain, ca, signal_time, detail_id FROM signals WHERE signal_time IS NOT NULL),
u AS (SELECT * FROM g UNION ALL SELECT x.* FROM x ANTI JOIN g USING (chain,ca,signal_time)), n AS (SELECT *, row_number() OVER (PARTITION BY chain,ca ORDER BY signal_time, detail_id)=1 AS first FROM u)
SELECT * FROM n WHERE signal_time BETWEEN 0 AND {JAN20}""")
def _(spark, sf):
    s = mapped.signals(spark, sf).where("signal_time is not null")
    return catalog.external_signals(s.where("signal_source = 's0'"), s, 0, JAN20)


@query("c10_paginate", R + f" SELECT {KEYS}, time FROM bars ORDER BY time, {KEYS} LIMIT 20 OFFSET 40")
def _(spark, sf):
    return catalog.page(mapped.bars(spark, sf, H4).select(*POOL, "time"), ["time", *POOL], 3, 20)


@query("c11_select_chain_minus_exclusions", R + " SELECT DISTINCT chain, ca FROM ticks WHERE (chain='c1' OR ca='t0') AND ca<>'t3'")
def _(spark, sf):
    t = mapped.ticks(spark, sf).select(*TOKEN).distinct()
    return catalog.select_tokens(t, ["c1"], t.where("ca = 't0'"), t.where("ca = 't3'"))
