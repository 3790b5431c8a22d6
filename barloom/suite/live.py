"""Queries over the streaming operators: streams drained from the event files, and replays of stored ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.schemas import OHLCV, POOL, TOKEN
from barloom.session import prepare
from barloom.sources import mapped
from barloom.streaming import bars as live
from barloom.suite import signals as s
from barloom.suite.base import H4, ORACLES, SIGNALS, TICKS, bars_cte, query

M = "WITH" + TICKS + "," + bars_cte() + "," + bars_cte(H4, "mcap", "cbars") + "," + SIGNALS
K = "chain, ca, pair_id"
HOUR = 3_600_000
# A trade without a positive value is in no candle of that series.
PRICED, CAPPED = "CASE WHEN price>0 THEN price END", "CASE WHEN mcap>0 THEN mcap END"


def stream_ticks(spark, sf):
    return mapped.ticks_of(live.event_stream(prepare(spark), sf))


@query("i1_dedup_ticks", M + f" SELECT {K}, id, time FROM ticks")
def _(spark, sf):
    t = mapped.ticks(spark, sf)
    return live.dedup_ticks(t.unionByName(t.where("volume_usd > 50"))).select(*POOL, "id", "time")


@query("i2_tumbling_bars_stream", "WITH" + TICKS + "," + bars_cte(HOUR, PRICED, "pb") + "," + bars_cte(HOUR, CAPPED, "mb") + f""", u AS (SELECT *, 'price' AS type FROM pb UNION ALL SELECT *, 'mcap' FROM mb)
SELECT {K}, type, time, open, high, low, close, volume, trade_count, close_trade_id FROM u WHERE close_time<=(SELECT max(time)-300000 FROM ticks)""")
def _(spark, sf):
    out = live.run_to_table(live.tumbling_bars(live.dedup_ticks(stream_ticks(spark, sf)), "1 hour"), "bars")
    return out.select(*POOL, "type", "time", *OHLCV, "trade_count", "close_trade_id")


# The whole stream: an end mark closes the last windows, so the oracle needs no bound.
@query("i2_tumbling_bars_stream_finished", ORACLES["i2_tumbling_bars_stream"].rsplit(" WHERE ", 1)[0])
def _(spark, sf):
    events, finish = live.ending(live.event_stream(prepare(spark), sf))
    out = live.run_to_table(live.tumbling_bars(live.dedup_ticks(mapped.ticks_of(events)), "1 hour"), "bars", finish)
    return out.select(*POOL, "type", "time", *OHLCV, "trade_count", "close_trade_id")


@query("i2_tumbling_bars", "WITH" + TICKS + "," + bars_cte(H4, PRICED, "pb") + "," + bars_cte(H4, CAPPED, "mb") + f", u AS (SELECT *, 'price' AS type FROM pb UNION ALL SELECT *, 'mcap' FROM mb) SELECT {K}, type, time, open, high, low, close, volume, trade_count FROM u")
def _(spark, sf):
    return live.tumbling_bars(live.dedup_ticks(mapped.ticks(spark, sf)), "4 hours").select(*POOL, "type", "time", *OHLCV, "trade_count")


def arrivals(spark, sf):
    n = F.col("id").cast("long")
    return mapped.ticks(spark, sf).select(*POOL, "id", n.alias("arrival"), (F.col("time") - F.when(n % 7 == 0, 20_000_000).when(n % 5 == 0, 25_000).otherwise(0)).alias("time"))


LATE = M + """, a AS (SELECT chain, pair_id, id, CAST(id AS BIGINT) AS arrival, time-CASE WHEN CAST(id AS BIGINT)%7=0 THEN 20000000 WHEN CAST(id AS BIGINT)%5=0 THEN 25000 ELSE 0 END AS time FROM ticks),
b AS (SELECT *, max(time) OVER (PARTITION BY chain, pair_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM a), c AS (SELECT *, CASE WHEN latest-time>=30000 AND time//60000<>latest//60000 THEN 'too_old' WHEN latest>time THEN 'late' ELSE 'on_time' END AS verdict FROM b)"""


@query("i3_late_policy", LATE + " SELECT id, verdict FROM c")
def _(spark, sf):
    return live.late_policy(arrivals(spark, sf), "arrival", 500).select("id", "verdict")


# Minutes are taken once per trade, so that the frames hold integers.
JUDGED = M + """, a AS (SELECT chain, ca, pair_id, id, CAST(id AS BIGINT) AS arrival, price, volume_usd, mcap, time-CASE WHEN CAST(id AS BIGINT)%7=0 THEN 20000000 WHEN CAST(id AS BIGINT)%5=0 THEN 25000 ELSE 0 END AS time FROM ticks),
b AS (SELECT *, time//60000 AS minute, coalesce(price>0 AND volume_usd>=0 AND time>=0, false) AS ok, coalesce(mcap>0, false) AS capped FROM a),
c AS (SELECT *, max(CASE WHEN ok THEN time END) OVER (PARTITION BY chain, pair_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM b),
d AS (SELECT *, ok AND NOT coalesce(latest-time>=30000 AND minute<>latest//60000, false) AS fresh FROM c),
e AS (SELECT *, max(CASE WHEN fresh THEN minute END) OVER w AS p, max(CASE WHEN fresh AND capped THEN minute END) OVER w AS m FROM d
      WINDOW w AS (PARTITION BY chain, ca, pair_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, CASE WHEN NOT ok THEN 'invalid' WHEN NOT fresh THEN 'too_old' WHEN NOT (minute>=coalesce(p,-1) OR (capped AND minute>=coalesce(m,-1))) THEN 'closed' WHEN latest>time THEN 'late' ELSE 'on_time' END AS verdict FROM e"""


def arriving(ticks):
    n = F.col("id").cast("long")
    return ticks.withColumn("arrival", n).withColumn("time", F.col("time") - F.when(n % 7 == 0, 20_000_000).when(n % 5 == 0, 25_000).otherwise(0))


@query("i3_judge_trades", JUDGED)
def _(spark, sf):
    return live.judge_trades(arriving(mapped.ticks(spark, sf)), "arrival", 500).select("id", "verdict")


@query("i3_judge_stream", JUDGED)
def _(spark, sf):
    return live.run_to_table(live.judge_stream(arriving(stream_ticks(spark, sf)), "arrival"), "verdicts").select("id", "verdict")


NOW = 1_706_486_400_000


CONNECTED = [(1_704_844_800_000, 1_705_500_000_000), (1_705_400_000_000, 1_705_700_000_000), (1_705_900_000_000, NOW)]
_IN = " OR ".join(f"(time>={a} AND time+{H4}<={b})" for a, b in CONNECTED)


@query("i4_flush_and_fill", M + f""", c AS (SELECT *, lead(time) OVER (PARTITION BY {K} ORDER BY time) AS nt FROM bars WHERE low>0 AND close_time<={NOW}), f AS (SELECT {K}, close, time AS base, k, time+k*{H4} AS time FROM (SELECT *, unnest(generate_series(0, greatest(1,(coalesce(nt,{(NOW // H4) * H4})-time)//{H4})-1)) AS k FROM c)),
h AS (SELECT *, sum(CASE WHEN k>0 AND pair_id='a' AND ({_IN}) THEN 1 ELSE 0 END) OVER (PARTITION BY {K}, base ORDER BY k) AS n FROM f)
SELECT {K}, time, close, k>0 AS synthetic FROM h WHERE n=k""")
def _(spark, sf):
    """Bars with a low above zero; three intervals of connection per market, two of them overlapping."""
    b = mapped.bars(spark, sf, H4)
    spans = F.explode(F.array(*[F.struct(F.lit(x).alias("from_time"), F.lit(y).alias("to_time")) for x, y in CONNECTED]))
    connected = b.where("pair_id = 'a'").select("chain", "pair_id").distinct().select("*", spans.alias("s")).select("chain", "pair_id", "s.*")
    return live.flush_and_fill(b.where("low > 0"), NOW, H4, connected).select(*POOL, "time", "close", "synthetic")


@query("i5_fence", M + f", x AS (SELECT DISTINCT chain, pair_id, (time//{H4})*{H4} AS time FROM ticks WHERE CAST(id AS BIGINT)%40=0) SELECT {K}, time FROM bars ANTI JOIN x USING (chain, pair_id, time)")
def _(spark, sf):
    broken = mapped.ticks(spark, sf).where(F.col("id").cast("long") % 40 == 0).select("chain", "pair_id", F.col("time").alias("at"))
    return live.fence(mapped.bars(spark, sf, H4), broken, H4).select(*POOL, "time")


@query("i6_decisions", s.D + s.EDGES + f" SELECT {K}, time+{H4} AS decision_time, round(close,6) AS value FROM ed WHERE edge AND time>=1704844800000")
def _(spark, sf):
    """Entry decisions of closed bars; earlier bars are warm-up only."""
    marked = s.mark_entries(s.framed(spark, sf, gated=True), s.LEGACY, s.backtest.DEFAULT["entry"], s.BLOCK)
    return marked.where("edge and time >= 1704844800000").select(*POOL, (F.col("time") + H4).alias("decision_time"), F.round("close", 6).alias("value"))


@query("i7_paired_price", M + f" SELECT c.chain, c.ca, c.pair_id, c.time, p.close AS token_price FROM cbars c JOIN bars p ON p.chain=c.chain AND p.ca=c.ca AND p.pair_id=c.pair_id AND p.time=c.time AND p.close_trade_id=c.close_trade_id AND p.close_trade_time=c.close_trade_time")
def _(spark, sf):
    return live.paired_price(live.tumbling_bars(live.dedup_ticks(mapped.ticks(spark, sf)), "4 hours")).select(*POOL, "time", "token_price")


@query("i8_admit", "WITH o AS (SELECT 'r'||(o_orderkey%3) AS run_id, 'c' AS chain, 't'||o_custkey AS ca, epoch_us(o_orderdate)//1000 AS t, round(o_totalprice) AS cap FROM orders), f AS (SELECT run_id, chain, ca, min(t) AS signal_time FROM o WHERE cap>=200000 AND t>820454400000 GROUP BY 1,2,3), n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY signal_time, chain, ca) AS place FROM f) SELECT *, place<=20 AS admitted FROM n")
def _(spark, sf):
    o = mapped.table(spark, sf, "orders").select(
        F.concat(F.lit("r"), (F.col("o_orderkey") % 3).cast("string")).alias("run_id"), F.lit("c").alias("chain"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("ca"),
        mapped.epoch_ms("o_orderdate").alias("signal_time"), F.round("o_totalprice").alias("market_cap"), F.lit("memeinfo").alias("provider"),
        F.lit(0).alias("created_at"), F.lit(0).alias("now"), F.lit("").alias("dex"), F.lit(0).alias("kol"))
    rules = spark.createDataFrame([("memeinfo", True, 200000.0, None, None, 820454400000)], "provider string, enabled boolean, min_market_cap double, max_age_minutes int, min_kol int, activated_at long")
    return live.admit(o, rules, 20, 400 * live.DAY)


@query("i9_evict", M + ", l AS (SELECT chain, ca, max_by(mcap, (time,id)) AS market_cap FROM ticks WHERE mcap IS NOT NULL GROUP BY 1,2) SELECT *, CASE WHEN ca IN ('t0','t1') THEN 'exit_only' ELSE 'leave' END AS action FROM l WHERE market_cap<1000000")
def _(spark, sf):
    caps = mapped.ticks(spark, sf).where("mcap is not null").select(*TOKEN, F.col("mcap").alias("market_cap"), F.struct("time", "id").alias("time"))
    return live.evict(caps, 1_000_000.0, caps.where("ca in ('t0','t1')"))


@query("i10_sequence_gaps", M + ", q AS (SELECT DISTINCT chain AS session, CAST(id AS BIGINT) AS seq FROM ticks), g AS (SELECT *, lag(seq) OVER (PARTITION BY session ORDER BY seq) AS b FROM q) SELECT session, b+1 AS gap_from, seq-1 AS gap_to FROM g WHERE seq>b+1")
def _(spark, sf):
    m = mapped.ticks(spark, sf).select(F.col("chain").alias("session"), F.col("id").cast("long").alias("seq"))
    return live.sequence_gaps(m.unionByName(m), 500)


@query("i11_feed_counters", LATE + " SELECT chain, pair_id, count_if(verdict='late') AS late, count_if(verdict='too_old') AS too_old, max(time) AS last_trade FROM c GROUP BY 1,2")
def _(spark, sf):
    return live.feed_counters(live.late_policy(arrivals(spark, sf), "arrival", 500))


@query("i12_wallet_buys", "WITH b AS (SELECT l_orderkey AS tx, 'm'||(l_partkey%7) AS mint, CAST(sum(CASE WHEN l_returnflag='R' THEN -l_quantity ELSE l_quantity END) AS BIGINT) AS d FROM lineitem GROUP BY 1,2), w AS (SELECT DISTINCT l_orderkey AS tx, 'm'||(l_partkey%7) AS mint FROM lineitem WHERE l_linenumber<=4) SELECT tx, max(CASE WHEN d>0 AND mint<>'m0' AND w.mint IS NOT NULL THEN b.mint END) AS mint FROM b LEFT JOIN w USING (tx, mint) GROUP BY tx HAVING count_if(d>0 AND mint<>'m0' AND w.mint IS NOT NULL)=1 AND count_if(d<0)>0".replace("w.mint IS NOT NULL", "w.k").replace("SELECT DISTINCT l_orderkey AS tx, 'm'||(l_partkey%7) AS mint FROM", "SELECT DISTINCT l_orderkey AS tx, 'm'||(l_partkey%7) AS mint, true AS k FROM"))
def _(spark, sf):
    l = mapped.table(spark, sf, "lineitem")
    mint = F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string")).alias("mint")
    q = F.col("l_quantity").cast("long")
    balances = l.select(F.col("l_orderkey").alias("tx"), mint, F.when(F.col("l_returnflag") == "R", q).otherwise(0).alias("pre"), F.when(F.col("l_returnflag") == "R", 0).otherwise(q).alias("post"))
    swaps = l.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("tx"), mint)
    return live.wallet_buys(balances, swaps, ["m0"])


@query("i13_feed_candidates", "SELECT repeat('A',32)||'x' AS ca, CASE WHEN p_size>10 THEN p_partkey END AS created_at, p_retailprice AS market_cap, p_size AS kol, 5 AS time FROM part WHERE p_partkey%3<>0 AND p_partkey>0")
def _(spark, sf):
    k = F.col("p_partkey")
    items = mapped.table(spark, sf, "part").where("p_partkey > 0").select(
        F.when(k % 3 == 0, "0OIl").otherwise(F.concat(F.repeat(F.lit("A"), 32), F.lit("x"))).alias("address"), F.when(F.col("p_size") > 10, k.cast("string")).otherwise("-1").alias("created"),
        F.col("p_retailprice").cast("string").alias("cap"), F.col("p_size").cast("string").alias("kol"))
    return live.feed_candidates(items, F.lit(5))


@query("i14_history_then_live", M + f" SELECT {K}, time, close, true AS is_warmup FROM bars WHERE trade_count%2=0 UNION ALL SELECT {K}, time, -close, false FROM bars WHERE trade_count%2<>0")
def _(spark, sf):
    b = mapped.bars(spark, sf, H4)
    return live.history_then_live(b.where("trade_count % 2 = 0"), b.withColumn("close", -F.col("close"))).select(*POOL, "time", "close", "is_warmup")


@query("i15_equity_snapshot", M + " SELECT time, CAST(sum(volume) AS BIGINT)+CASE WHEN time>=1704844800000 THEN 1 ELSE 0 END AS equity FROM bars GROUP BY time")
def _(spark, sf):
    points = mapped.bars(spark, sf, H4).groupBy("time").agg(F.sum("volume").cast("long").alias("equity"))
    return live.equity_snapshot(points, points.where("time >= 1704844800000").withColumn("equity", F.col("equity") + 1))
