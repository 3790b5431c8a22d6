"""Queries over windows, swings, rules and trade labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.candles import PATTERNS, candle_pattern
from barloom.functions.levels import stop_level, target_level
from barloom.operators import indicators, quality, rules
from barloom.operators.labels import earliest_signals, entries_of, framed_bars, gate_open, label_exits, mark_entries, restore_cause, with_levels
from barloom.operators.swings import SwingRule, pivots, swing_pairs, with_swing
from barloom.plans import backtest
from barloom.plans.blocks import halo
from barloom.schemas import OHLCV, POOL
from barloom.sources import mapped
from barloom.suite.base import H4, SIGNALS, base, query

BLOCK = 64  # small on purpose: several blocks per pool, so stitching is exercised by every oracle check
LEGACY = SwingRule()
EXPANDED = SwingRule(volume_expansion=True, expansion_ratio=1.1)
STRICT = SwingRule(version="pullback-v2")
KEYS = "chain, ca, pair_id"


def bars(spark, sf):
    return mapped.bars(spark, sf, H4)


def filled(spark, sf):
    return quality.fill_gaps(quality.index_bars(quality.only_valid(bars(spark, sf)).select(*POOL, "time", *OHLCV), H4, BLOCK), H4)


def framed(spark, sf, rule=LEGACY, features=frozenset(), gated=False):
    gate = earliest_signals(mapped.signals(spark, sf)) if gated else None
    return framed_bars(bars(spark, sf), H4, rule, set(features), gate, BLOCK)


W = f"(PARTITION BY {KEYS} ORDER BY idx"
D = base() + "," + SIGNALS

PIVOTS = f""", pv AS (SELECT *, idx>=2 AND lead(idx,2) OVER w IS NOT NULL AND low<=min(low) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS low_pivot,
  idx>=2 AND lead(idx,2) OVER w IS NOT NULL AND high>=max(high) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS high_pivot,
  avg(volume) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS vb5 FROM filled WINDOW w AS (PARTITION BY {KEYS} ORDER BY idx))"""


def pairs_cte(extra: str = "true", ends: str = "l.idx+59") -> str:
    return PIVOTS + f""", prs AS (SELECT h.chain, h.ca, h.pair_id, h.idx AS high_idx, l.idx AS low_idx, l.low, h.high, (h.high/l.low-1)*100 AS gain_percent, h.idx+2 AS confirmed_idx,
  (SELECT avg(volume) FROM filled f WHERE f.chain=h.chain AND f.ca=h.ca AND f.pair_id=h.pair_id AND f.idx BETWEEN l.idx AND h.idx) AS average_volume, l.vb5, {ends} AS ends_at
  FROM pv h JOIN pv l USING ({KEYS}) WHERE h.high_pivot AND l.low_pivot AND l.low>0 AND h.idx>l.idx AND h.idx-l.idx<=40 AND (h.high/l.low-1)*100>=50 AND {extra})"""


V2_EXTRA = "(SELECT max(f.high) FROM filled f WHERE f.chain=h.chain AND f.ca=h.ca AND f.pair_id=h.pair_id AND f.idx BETWEEN l.idx AND h.idx)<=h.high"
V2_ENDS = "least(l.idx+59, coalesce((SELECT min(f.idx) FROM filled f WHERE f.chain=h.chain AND f.ca=h.ca AND f.pair_id=h.pair_id AND f.idx>h.idx AND (f.close>h.high OR f.close<l.low))-1, l.idx+59))"


def swing_cte(pairs: str) -> str:
    return pairs + f""", alive AS (SELECT f.chain, f.ca, f.pair_id, f.idx, p.high_idx, p.low_idx, p.low AS s_low, p.high AS s_high, p.confirmed_idx, p.average_volume,
  row_number() OVER (PARTITION BY f.chain,f.ca,f.pair_id,f.idx ORDER BY p.high_idx DESC, p.low_idx DESC) AS rn
  FROM filled f JOIN prs p USING ({KEYS}) WHERE f.idx BETWEEN p.confirmed_idx AND p.ends_at),
sw AS (SELECT f.*, a.high_idx, a.low_idx, a.s_low, a.s_high, a.confirmed_idx, a.average_volume FROM filled f LEFT JOIN (SELECT * FROM alive WHERE rn=1) a USING ({KEYS}, idx))"""


SWING = swing_cte(pairs_cte())


@query("d1_pivots", D + PIVOTS + f" SELECT {KEYS}, idx, low_pivot, high_pivot FROM pv WHERE low_pivot OR high_pivot")
def _(spark, sf):
    out = pivots(halo(filled(spark, sf), 4, 4, BLOCK), 2, 2)
    return out.where("core and (low_pivot or high_pivot)").select(*POOL, "idx", "low_pivot", "high_pivot")


_PAIRS = f" SELECT {KEYS}, high_idx, low_idx, round(gain_percent,6) AS gain_percent, round(average_volume,6) AS average_volume FROM prs"


@query("d2_swing_pairs", D + pairs_cte() + _PAIRS)
def _(spark, sf):
    frame = _pair_frame(spark, sf, LEGACY)
    return _pairs_out(frame, LEGACY)


@query("d2_swing_pairs_volume", D + pairs_cte("(SELECT avg(volume) FROM filled f WHERE f.chain=h.chain AND f.ca=h.ca AND f.pair_id=h.pair_id AND f.idx BETWEEN l.idx AND h.idx)>=l.vb5*1.1") + _PAIRS)
def _(spark, sf):
    return _pairs_out(_pair_frame(spark, sf, EXPANDED), EXPANDED)


def _pair_frame(spark, sf, rule):
    from barloom.operators.swings import swing_inputs

    # A high near the end of a block needs its right neighbours to be a pivot inside its own block.
    return swing_inputs(halo(filled(spark, sf), rule.back, rule.right, BLOCK), rule)


def _pairs_out(frame, rule):
    return swing_pairs(frame, rule).where("core").select(
        *POOL, "high_idx", "low_idx", F.round("gain_percent", 6).alias("gain_percent"), F.round("average_volume", 6).alias("average_volume"))


_ASOF = f" SELECT {KEYS}, idx, high_idx, low_idx FROM sw WHERE high_idx IS NOT NULL"


@query("d3_swing_asof", D + SWING + _ASOF)
def _(spark, sf):
    out = with_swing(framed(spark, sf), LEGACY, BLOCK).where("swing is not null")
    return out.select(*POOL, "idx", "swing.high_idx", "swing.low_idx")


@query("d4_swing_asof_pullback", D + swing_cte(pairs_cte(V2_EXTRA, V2_ENDS)) + _ASOF)
def _(spark, sf):
    out = with_swing(framed(spark, sf, STRICT), STRICT, BLOCK).where("swing is not null")
    return out.select(*POOL, "idx", "swing.high_idx", "swing.low_idx")


# Per bar with a selectable pair the best one; then by recursion the choices that are reached one after the other.
_CHAIN = pairs_cte(V2_EXTRA, V2_ENDS) + f""", best AS MATERIALIZED (SELECT f.chain, f.ca, f.pair_id, f.idx, max(p.high_idx*1000000+p.low_idx) AS hl, arg_max(p.ends_at, p.high_idx*1000000+p.low_idx) AS ends_at
  FROM filled f JOIN prs p USING ({KEYS}) WHERE f.idx BETWEEN p.confirmed_idx AND p.ends_at GROUP BY ALL),
nx AS MATERIALIZED (SELECT b.chain, b.ca, b.pair_id, b.idx, b.hl, b.ends_at, (SELECT min(c.idx) FROM best c WHERE c.chain=b.chain AND c.ca=b.ca AND c.pair_id=b.pair_id AND c.idx>b.ends_at) AS nxt FROM best b),
ob AS (SELECT {KEYS}, min(idx) AS idx FROM best GROUP BY ALL UNION ALL SELECT nx.chain, nx.ca, nx.pair_id, nx.nxt FROM ob JOIN nx USING ({KEYS}, idx) WHERE nx.nxt IS NOT NULL),
lk AS (SELECT nx.chain, nx.ca, nx.pair_id, nx.idx AS chosen_idx, hl, unnest(range(nx.idx, nx.ends_at+1)) AS idx FROM ob JOIN nx USING ({KEYS}, idx))"""


@query("d5_candidate_chain", D + _CHAIN + f" SELECT {KEYS}, idx, CAST(hl//1000000 AS BIGINT) AS high_idx, CAST(hl%1000000 AS BIGINT) AS low_idx, chosen_idx FROM lk JOIN filled USING ({KEYS}, idx)")
def _(spark, sf):
    from barloom.operators.chain import candidate_chain

    own = F.floor(F.col("idx") / BLOCK) == F.col("blk")
    return candidate_chain(framed(spark, sf, STRICT), STRICT, BLOCK, size=BLOCK, fan=2).where(own).select(*POOL, "idx", "swing.high_idx", "swing.low_idx", "chosen_idx")


@query("d5_locked_entries", D + _CHAIN + f""", lp AS (SELECT lk.*, p.low AS s_low, p.high AS s_high FROM lk JOIN prs p ON p.chain=lk.chain AND p.ca=lk.ca AND p.pair_id=lk.pair_id AND p.high_idx=hl//1000000 AND p.low_idx=hl%1000000),
m AS (SELECT f.chain, f.ca, f.pair_id, f.idx, chosen_idx, coalesce(time>signal_time,false) AND coalesce((s_high-close)/(s_high-s_low) BETWEEN 0.382 AND 0.886,false) AS met FROM filled f LEFT JOIN lp USING ({KEYS}, idx) LEFT JOIN gate USING (chain, ca))
SELECT {KEYS}, idx, chosen_idx FROM (SELECT *, lag(met) OVER (PARTITION BY {KEYS} ORDER BY idx) AS was FROM m) WHERE met AND (chosen_idx=idx OR NOT coalesce(was,false))""")
def _(spark, sf):
    return mark_entries(framed(spark, sf, STRICT, gated=True), STRICT, backtest.DEFAULT["entry"], BLOCK).where("edge").select(*POOL, "idx", "chosen_idx")


@query("d6_mean_volume", D + f" SELECT {KEYS}, idx, round(avg(volume) OVER {W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),6) AS mean_now, round(avg(volume) OVER {W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),6) AS mean_before FROM filled")
def _(spark, sf):
    f = halo(filled(spark, sf), 12, 0, BLOCK)
    out = f.select(*POOL, "idx", "core", F.round(indicators.mean_volume(10, True), 6).alias("mean_now"), F.round(indicators.mean_volume(10, False), 6).alias("mean_before"))
    return out.where("core").drop("core")


def ema_cte(n: int) -> str:
    k = f"(2.0/{n + 1})"
    return f""", e{n} AS (SELECT {KEYS}, idx, close AS ema FROM filled WHERE idx=0 UNION ALL SELECT f.chain, f.ca, f.pair_id, f.idx, f.close*{k}+e.ema*(1-{k}) FROM e{n} e JOIN filled f ON f.chain=e.chain AND f.ca=e.ca AND f.pair_id=e.pair_id AND f.idx=e.idx+1)"""


@query("d7_ema", D + ema_cte(9) + f" SELECT {KEYS}, idx, round(ema,6) AS ema FROM e9")
def _(spark, sf):
    return indicators.with_ema(filled(spark, sf), [9], BLOCK).select(*POOL, "idx", F.round("ema_9", 6).alias("ema"))


def _rsi_sql(n: int) -> str:
    return f"""CASE WHEN idx>={n} THEN CASE WHEN sum(greatest(-d,0)) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)=0 THEN 100.0 ELSE 100-100/(1+sum(greatest(d,0)) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)
/sum(greatest(-d,0)) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) END END"""


CHANGES = f", ch AS (SELECT *, close-lag(close) OVER {W}) AS d, lag(close) OVER {W}) AS prev_close, lag(open) OVER {W}) AS prev_open FROM filled)"


@query("d8_rsi", D + CHANGES + f" SELECT {KEYS}, idx, round({_rsi_sql(14)},5) AS rsi FROM ch WINDOW w AS (PARTITION BY {KEYS} ORDER BY idx)")
def _(spark, sf):
    f = indicators.add_features(halo(filled(spark, sf), 17, 0, BLOCK), {("rsi", 14)})
    return f.where("core").select(*POOL, "idx", F.round("rsi_14", 5).alias("rsi"))


@query("d9_obv", D + CHANGES + f" SELECT {KEYS}, idx, sum(coalesce(sign(d)*volume,0)) OVER {W}) AS obv FROM ch")
def _(spark, sf):
    return indicators.obv(filled(spark, sf), BLOCK).select(*POOL, "idx", "obv")


PATTERN_SQL = """coalesce(close>=open AND least(open,close)-low>=greatest(abs(close-open)*2,greatest(2.220446049250313e-16,high-low)*0.4) AND high-greatest(open,close)<=greatest(2.220446049250313e-16,high-low)*0.2,false) AS hammer,
 coalesce(least(open,close)-low>=greatest(2.220446049250313e-16,high-low)*0.55 AND abs(close-open)<=greatest(2.220446049250313e-16,high-low)*0.3,false) AS pin_bar,
 coalesce(least(open,close)-low>=greatest(abs(close-open)*2,greatest(2.220446049250313e-16,high-low)*0.4),false) AS long_lower_wick,
 coalesce(prev_close<prev_open AND close>open AND open<=prev_close AND close>=prev_open,false) AS bullish_engulfing"""


@query("d10_candle_patterns", D + CHANGES + f" SELECT {KEYS}, idx, {PATTERN_SQL} FROM ch")
def _(spark, sf):
    f = indicators.add_features(halo(filled(spark, sf), 2, 0, BLOCK), set())
    return f.where("core").select(*POOL, "idx", *[candle_pattern(p).alias(p) for p in PATTERNS])


@query("d11_first_breach", D + pairs_cte() + f""", one AS (SELECT {KEYS}, high_idx, max(low_idx) AS low_idx, max_by(low, low_idx) AS low, any_value(high) AS high FROM prs GROUP BY {KEYS}, high_idx)
SELECT {KEYS}, high_idx, low_idx, (SELECT min(f.idx) FROM filled f WHERE f.chain=o.chain AND f.ca=o.ca AND f.pair_id=o.pair_id AND f.idx>o.high_idx AND f.idx<=o.high_idx+60 AND (f.close>o.high OR f.close<o.low)) AS breach_idx FROM one o""")
def _(spark, sf):
    from barloom.operators.swings import first_breach

    found = swing_pairs(_pair_frame(spark, sf, LEGACY), LEGACY).where("core")
    one = found.groupBy(*POOL, "high_idx").agg(F.max(F.struct("low_idx", "low", "high")).alias("p")).select(*POOL, "high_idx", "p.*")
    return first_breach(one, filled(spark, sf), 60, BLOCK).select(*POOL, "high_idx", "low_idx", "breach_idx")


@query("d12_nearest_bars", D + f""", rb AS (SELECT {KEYS}, time, row_number() OVER (PARTITION BY {KEYS} ORDER BY time) AS rn FROM bars), nb AS (SELECT {KEYS}, max(rn) AS n FROM rb GROUP BY ALL),
an AS (SELECT {KEYS}, id, time AS t FROM ticks), lo AS (SELECT an.*, rb.rn AS r0 FROM an ASOF LEFT JOIN rb ON an.chain=rb.chain AND an.ca=rb.ca AND an.pair_id=rb.pair_id AND an.t>=rb.time),
hi AS (SELECT lo.*, rb.rn AS r1 FROM lo ASOF LEFT JOIN rb ON lo.chain=rb.chain AND lo.ca=rb.ca AND lo.pair_id=rb.pair_id AND lo.t<=rb.time)
SELECT hi.chain, hi.ca, hi.pair_id, id, f.time AS context_from, g.time AS context_to FROM hi LEFT JOIN nb ON hi.chain=nb.chain AND hi.ca=nb.ca AND hi.pair_id=nb.pair_id
LEFT JOIN rb f ON f.chain=hi.chain AND f.ca=hi.ca AND f.pair_id=hi.pair_id AND f.rn=CASE WHEN r0>4 THEN r0-4 ELSE r0-r0+1 END LEFT JOIN rb g ON g.chain=hi.chain AND g.ca=hi.ca AND g.pair_id=hi.pair_id AND g.rn=CASE WHEN r1+4>n THEN n ELSE r1+4 END""")
def _(spark, sf):
    anchors = mapped.ticks(spark, sf).select(
        *POOL, "id", F.col("time").alias("anchor_from"), F.col("time").alias("anchor_to"))
    return indicators.nearest_bars(bars(spark, sf), anchors, 5, H4 * BLOCK).select(*POOL, "id", "context_from", "context_to")


@query("d13_decision_bucket", f"WITH t AS (SELECT ((l_partkey*1000+l_suppkey%1000)*100+CAST(l_quantity AS BIGINT))*100000000+l_orderkey*10+l_linenumber AS id, epoch_us(l_shipdate)//1000 AS t, CASE WHEN l_returnflag='R' THEN 'stop_loss' ELSE 'entry' END AS reason FROM lineitem) SELECT id, (t//{H4})*{H4} AS bucket, ((t-CASE WHEN reason='entry' THEN 1 ELSE 0 END)//{H4})*{H4} AS decision FROM t")
def _(spark, sf):
    from barloom.operators.ledger import decision_bucket

    lines = mapped.table(spark, sf, "lineitem")
    t = lines.select(
        mapped.line_id(lines).alias("id"), mapped.epoch_ms("l_shipdate").alias("t"),
        F.when(F.col("l_returnflag") == "R", "stop_loss").otherwise("entry").alias("reason"))
    return t.select("id", (F.floor(F.col("t") / H4) * H4).alias("bucket"), decision_bucket(F.col("t"), F.col("reason"), H4).alias("decision"))


RULES = {
    "e1_fib_retracement": ({"type": "fib_retracement", "zoneLow": 0.382, "zoneHigh": 0.886}, "(s_high-close)/(s_high-s_low) BETWEEN 0.382 AND 0.886 AND idx>=confirmed_idx"),
    "e2_percent_retracement": ({"type": "percent_retracement", "minPercent": 20, "maxPercent": 50}, "(s_high-close)/s_high*100 BETWEEN 20 AND 50"),
    "e3_volume_contraction": ({"type": "volume_contraction", "period": 10, "maxRatio": 0.7},
        f"average_volume>0 AND (SELECT avg(volume) FROM filled f WHERE f.chain=r.chain AND f.ca=r.ca AND f.pair_id=r.pair_id AND f.idx BETWEEN greatest(r.high_idx+1,r.idx-9) AND r.idx)/average_volume<=0.7"),
    "e4_bullish_volume": ({"type": "bullish_volume_confirmation", "period": 10, "minRatio": 1.5}, "close>open AND volume>=vm10*1.5"),
    "e5_candle_pattern": ({"type": "candle_pattern", "patterns": ["hammer", "pin_bar"]}, "hammer OR pin_bar"),
    "e6_rsi_recovery": ({"type": "rsi_recovery", "period": 7, "oversold": 40, "recovery": 45}, "rsi_prev<=40 AND rsi>=45"),
    "e7_ema_reclaim": ({"type": "ema_reclaim", "period": 9}, "prev_close<=ema_prev AND close>ema AND idx>=1"),
    "e8_obv_confirmation": ({"type": "obv_confirmation", "lookbackBars": 10, "minChangePercent": 5}, "idx>=10 AND v10>0 AND sv10/v10*100>=5"),
    "e9_break_fib": ({"type": "break_fib_invalidation", "ratio": 0.886, "bufferPercent": 2}, "close<(s_high-(s_high-s_low)*0.886)*0.98"),
    "e10_break_swing_low": ({"type": "break_swing_low_invalidation", "bufferPercent": 1}, "close<s_low*0.99"),
    "e11_bearish_volume": ({"type": "bearish_volume_invalidation", "period": 10, "minRatio": 1.2, "minBodyPercent": 20}, "close<open AND (open-close)/open*100>=20 AND volume>=vm10*1.2"),
}
TREE = {"mode": "all", "conditions": [RULES["e1_fib_retracement"][0], {"mode": "at_least", "minMatches": 2, "conditions": [
    RULES["e3_volume_contraction"][0], RULES["e5_candle_pattern"][0], RULES["e8_obv_confirmation"][0], {**RULES["e6_rsi_recovery"][0], "enabled": False}]}]}
RULE_SQL = SWING + CHANGES.replace("FROM filled", "FROM sw") + f""", r0 AS (SELECT *, {PATTERN_SQL}, {_rsi_sql(7)} AS rsi, avg(volume) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS vm10,
 sum(volume) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS v10, sum(coalesce(sign(d)*volume,0)) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS sv10 FROM ch WINDOW w AS (PARTITION BY {KEYS} ORDER BY idx))""" + ema_cte(9) + f""",
r AS (SELECT r0.*, ema, lag(ema) OVER w AS ema_prev, lag(rsi) OVER w AS rsi_prev FROM r0 JOIN e9 USING ({KEYS}, idx) WINDOW w AS (PARTITION BY {KEYS} ORDER BY idx))"""


def _rule_query(name, node, condition):
    @query(name, D + RULE_SQL + f" SELECT {KEYS}, idx FROM r WHERE high_idx IS NOT NULL AND ({condition})")
    def _(spark, sf):
        frame = framed(spark, sf, LEGACY, rules.features_of(node))
        return with_swing(frame, LEGACY, BLOCK).where(F.col("swing").isNotNull() & rules.compile_rule(node, F.col("swing"))).select(*POOL, "idx")


for _name, (_node, _sql) in RULES.items():
    _rule_query(_name, _node, _sql)

_T = {k: f"(CASE WHEN {RULES[k][1]} THEN 1 ELSE 0 END)" for k in RULES}
TREE_SQL = f"{RULES['e1_fib_retracement'][1]} AND {_T['e3_volume_contraction']}+{_T['e5_candle_pattern']}+{_T['e8_obv_confirmation']}>=2"
_rule_query("e13_rule_group", TREE, TREE_SQL)

FIB = RULES["e1_fib_retracement"][1]
EDGES = SWING + f""", mt AS (SELECT sw.*, coalesce(time>signal_time,false) AND high_idx IS NOT NULL AND coalesce({FIB},false) AS met FROM sw LEFT JOIN gate USING (chain, ca)),
ed AS (SELECT *, met AND NOT coalesce(lag(met) OVER {W}),false) AS edge FROM mt)"""


@query("e14_rising_edge", D + EDGES + f" SELECT {KEYS}, idx, time FROM ed WHERE edge")
def _(spark, sf):
    frame = framed(spark, sf, gated=True)
    return mark_entries(frame, LEGACY, backtest.DEFAULT["entry"], BLOCK).where("edge").select(*POOL, "idx", "time")


@query("e15_after_signal_gate", D + f" SELECT {KEYS}, count(*) AS bars, count_if(coalesce(time>signal_time+600*60000,false)) AS open_bars FROM filled LEFT JOIN gate USING (chain,ca) GROUP BY ALL")
def _(spark, sf):
    frame = framed(spark, sf, gated=True).where("core")
    return frame.groupBy(*POOL).agg(F.count(F.lit(1)).alias("bars"), F.count_if(gate_open(600)).alias("open_bars"))


INVALID = {"mode": "any", "conditions": [RULES["e9_break_fib"][0], RULES["e10_break_swing_low"][0], {"mode": "all", "conditions": [RULES["e11_bearish_volume"][0], RULES["e4_bullish_volume"][0]]}, RULES["e11_bearish_volume"][0]]}


@query("e16_explain_rules", D + RULE_SQL + f""", x AS (SELECT {KEYS}, idx, coalesce({RULES['e9_break_fib'][1]},false) AS a, coalesce({RULES['e10_break_swing_low'][1]},false) AS b, coalesce({RULES['e11_bearish_volume'][1]},false) AS c FROM r WHERE high_idx IS NOT NULL)
SELECT {KEYS}, idx, CASE WHEN a THEN 'break_fib_invalidation' WHEN b THEN 'break_swing_low_invalidation' ELSE 'bearish_volume_invalidation' END AS primary_code,
 concat_ws(',', CASE WHEN a THEN '0' END, CASE WHEN b THEN '1' END, CASE WHEN c THEN '3' END) AS paths FROM x WHERE a OR b OR c""")
def _(spark, sf):
    frame = framed(spark, sf, LEGACY, rules.features_of(INVALID))
    causes = rules.explain_rule(INVALID, F.col("swing"))
    out = with_swing(frame, LEGACY, BLOCK).where("swing is not null").withColumn("causes", causes).where("size(causes) > 0")
    return out.select(*POOL, "idx", rules.primary_cause(F.col("causes")).alias("primary_code"), F.array_join(F.transform("causes", lambda c: c["path"]), ",").alias("paths"))


@query("e17_qualify_source", """WITH f AS (SELECT o_orderkey AS id, CASE o_orderkey%3 WHEN 0 THEN 'memeinfo' WHEN 1 THEN 'wallet' ELSE 'xxyy' END AS provider, round(o_totalprice) AS market_cap, 1000000+o_custkey*1000 AS created_at, 2000000 AS now,
 CASE WHEN o_orderkey%5=0 THEN 'other' ELSE 'pfamm' END AS dex, o_orderkey%4 AS kol FROM orders)
SELECT id, provider, CASE WHEN provider='memeinfo' THEN market_cap>=200000 ELSE market_cap>150000 AND created_at<=now AND now-created_at<10*60000 AND (provider='wallet' OR (dex='pfamm' AND kol>=2)) END AS qualified FROM f""")
def _(spark, sf):
    k = F.col("o_orderkey")
    facts = mapped.table(spark, sf, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, "memeinfo").when(k % 3 == 1, "wallet").otherwise("xxyy").alias("provider"), F.round("o_totalprice").alias("market_cap"),
        (1000000 + F.col("o_custkey") * 1000).alias("created_at"), F.lit(2000000).alias("now"), F.when(k % 5 == 0, "other").otherwise("pfamm").alias("dex"), (k % 4).alias("kol"))
    config = spark.createDataFrame(
        [("memeinfo", True, 200000.0, None, None), ("wallet", True, 150000.0, 10, None), ("xxyy", True, 150000.0, 10, 2)],
        "provider string, enabled boolean, min_market_cap double, max_age_minutes int, min_kol int")
    return rules.qualify_source(facts, config).select("id", "provider", "qualified")


@query("e17_source_bounds", "SELECT 'xxyy' AS provider, max(o_orderkey%60+1) AS max_age_minutes, min(round(o_totalprice)) AS min_market_cap, min(o_orderkey%7) AS min_kol, min(round(o_totalprice)/2) AS exit_cap FROM orders WHERE o_orderkey%2=0")
def _(spark, sf):
    k = F.col("o_orderkey")
    configs = mapped.table(spark, sf, "orders").select(
        F.lit("xxyy").alias("provider"), (k % 2 == 0).alias("enabled"), (k % 60 + 1).alias("max_age_minutes"), F.round("o_totalprice").alias("min_market_cap"),
        (k % 7).alias("min_kol"), (F.round("o_totalprice") / 2).alias("exit_market_cap"))
    return rules.loosest_rule(configs)


EXITS = {"stopLoss": {"type": "swing_low", "bufferPercent": 2}, "takeProfit": {"type": "risk_reward", "ratio": 1.5}, "maxHoldingBars": 20, "closeAtEnd": True}
LOCKED = {**EXITS, "profitLock": {"enabled": True, "tiers": [{"activationPercent": 10, "floorPercent": 2}, {"activationPercent": 40, "floorPercent": 20}]}}
CUT = {"mode": "any", "conditions": [{"type": "break_fib_invalidation", "ratio": 0.95, "bufferPercent": 0}, RULES["e11_bearish_volume"][0]]}
LEVELS = EDGES + f""", en AS (SELECT {KEYS}, idx AS entry_idx, time AS entry_time, close AS entry_price, s_low, s_high, is_last, synthetic FROM ed WHERE edge),
lv AS (SELECT *, s_low*0.98 AS stop, entry_price+greatest(0, entry_price-s_low*0.98)*1.5 AS target FROM en)"""


def _exit_sql(lock: bool) -> str:
    peak = f"""(SELECT max(g.close) FROM filled g WHERE g.chain=l.chain AND g.ca=l.ca AND g.pair_id=l.pair_id AND g.idx>l.entry_idx AND g.idx<f.idx)"""
    lock_price = "CASE WHEN pk>=entry_price*1.4 THEN entry_price*1.2 WHEN pk>=entry_price*1.1 THEN entry_price*1.02 END"
    return LEVELS + f""", fv AS (SELECT *, avg(volume) OVER {W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS vm10 FROM filled),
hj AS (SELECT l.*, f.idx, f.time, f.open, f.high, f.low AS blow, f.close, f.volume, f.vm10, f.is_last AS fl, {peak if lock else 'NULL::DOUBLE'} AS pk FROM lv l JOIN fv f USING ({KEYS}) WHERE f.idx>l.entry_idx AND f.idx<=l.entry_idx+20),
hk AS (SELECT *, greatest(stop, coalesce({lock_price}, stop)) AS fl_price, coalesce(({lock_price})>stop,false) AS locked,
  close<s_high-(s_high-s_low)*0.95 AS inv_fib, close<open AND (open-close)/open*100>=20 AND coalesce(volume>=vm10*1.2,false) AS inv_vol FROM hj),
hx AS (SELECT *, CASE WHEN open<=fl_price OR blow<=fl_price THEN CASE WHEN locked THEN 'profit_lock' ELSE 'stop_loss' END WHEN inv_fib OR inv_vol THEN 'invalidation' WHEN target>entry_price AND (open>=target OR high>=target) THEN 'take_profit' WHEN idx-entry_idx>=20 THEN 'timeout' WHEN fl THEN 'end_of_backtest' END AS tp FROM hk),
hp AS (SELECT *, CASE tp WHEN 'take_profit' THEN CASE WHEN open>=target THEN open ELSE target END WHEN 'stop_loss' THEN CASE WHEN open<=fl_price THEN open ELSE fl_price END WHEN 'profit_lock' THEN CASE WHEN open<=fl_price THEN open ELSE fl_price END ELSE close END AS price,
  CASE WHEN tp='invalidation' THEN CASE WHEN inv_fib THEN 'break_fib_invalidation' ELSE 'bearish_volume_invalidation' END END AS cause,
  row_number() OVER (PARTITION BY {KEYS}, entry_idx ORDER BY idx) AS rn FROM hx WHERE tp IS NOT NULL),
lb AS (SELECT l.chain, l.ca, l.pair_id, l.entry_idx, l.entry_time, l.entry_price, l.s_low, l.s_high, l.synthetic AS entry_synthetic, CASE WHEN l.is_last THEN l.entry_idx ELSE h.idx END AS exit_idx, CASE WHEN l.is_last THEN l.entry_time ELSE h.time END AS exit_time,
  CASE WHEN l.is_last THEN 'end_of_backtest' ELSE h.tp END AS exit_reason, CASE WHEN l.is_last THEN l.entry_price ELSE h.price END AS exit_price, h.cause FROM lv l LEFT JOIN (SELECT * FROM hp WHERE rn=1) h USING ({KEYS}, entry_idx))"""


def labelled(spark, sf, exits=EXITS, invalid=CUT, rule=LEGACY):
    frame = framed(spark, sf, rule, rules.features_of(invalid), gated=True)
    entries = with_levels(entries_of(mark_entries(frame, rule, backtest.DEFAULT["entry"], BLOCK)), exits)
    return label_exits(entries, frame.where("core"), exits, invalid, block=32)


@query("f1_stop_levels", D + LEVELS + f" SELECT {KEYS}, entry_idx, round(entry_price*0.9,6) AS percent, round(s_low*0.98,6) AS swing_low, round((s_high-(s_high-s_low)*0.886)*0.98,6) AS fib_level FROM lv")
def _(spark, sf):
    e = entries_of(mark_entries(framed(spark, sf, gated=True), LEGACY, backtest.DEFAULT["entry"], BLOCK))
    p, lo, hi = F.col("entry_price"), F.col("swing.low"), F.col("swing.high")
    kinds = {"percent": {"type": "percent", "value": 10}, "swing_low": {"type": "swing_low", "bufferPercent": 2}, "fib_level": {"type": "fib_level", "ratio": 0.886, "bufferPercent": 2}}
    return e.select(*POOL, "entry_idx", *[F.round(stop_level(k, p, lo, hi), 6).alias(n) for n, k in kinds.items()])


@query("f2_target_levels", D + LEVELS + f" SELECT {KEYS}, entry_idx, round(entry_price*2,6) AS percent, round(entry_price+greatest(0,entry_price-stop)*4,6) AS risk_reward, round(s_high,6) AS previous_high, round(s_high-(s_high-s_low)*0.382,6) AS fib_target FROM lv")
def _(spark, sf):
    e = with_levels(entries_of(mark_entries(framed(spark, sf, gated=True), LEGACY, backtest.DEFAULT["entry"], BLOCK)), EXITS)
    p, lo, hi = F.col("entry_price"), F.col("swing.low"), F.col("swing.high")
    kinds = {"percent": {"type": "percent", "value": 100}, "risk_reward": {"type": "risk_reward", "ratio": 4}, "previous_high": {"type": "previous_high"}, "fib_target": {"type": "fib_target", "ratio": 0.382}}
    return e.select(*POOL, "entry_idx", *[F.round(target_level(k, p, F.col("stop"), lo, hi), 6).alias(n) for n, k in kinds.items()])


_LABELS = f" SELECT {KEYS}, entry_idx, exit_idx, exit_time, exit_reason, round(exit_price,6) AS exit_price, cause AS exit_cause, exit_idx-entry_idx AS holding_bars FROM lb"


def _label_out(df):
    return df.select(*POOL, "entry_idx", "exit_idx", "exit_time", "exit_reason", F.round("exit_price", 6).alias("exit_price"), "exit_cause", "holding_bars")


@query("f4_label_exits", D + _exit_sql(False) + _LABELS)
def _(spark, sf):
    return _label_out(labelled(spark, sf))


def _unlimited(sql: str) -> str:
    return sql.replace(" AND f.idx<=l.entry_idx+20", "").replace(" WHEN idx-entry_idx>=20 THEN 'timeout'", "")


def without_limit(exits):
    return {k: v for k, v in exits.items() if k != "maxHoldingBars"}


@query("f4_label_exits_unlimited", _unlimited(D + _exit_sql(False) + _LABELS))
def _(spark, sf):
    return _label_out(labelled(spark, sf, without_limit(EXITS)))


@query("f5_profit_lock_unlimited", _unlimited(D + _exit_sql(True) + _LABELS))
def _(spark, sf):
    return _label_out(labelled(spark, sf, without_limit(LOCKED)))


@query("f3_bar_exit_reasons", D + _exit_sql(False) + " SELECT exit_reason, count(*) AS entries, CAST(sum(exit_idx-entry_idx) AS BIGINT) AS bars_held FROM lb GROUP BY ALL")
def _(spark, sf):
    return labelled(spark, sf).groupBy("exit_reason").agg(F.count(F.lit(1)).alias("entries"), F.sum("holding_bars").alias("bars_held"))


@query("f5_profit_lock", D + _exit_sql(True) + _LABELS)
def _(spark, sf):
    return _label_out(labelled(spark, sf, LOCKED))


@query("f7_trade_costs", D + _exit_sql(False) + f""" SELECT {KEYS}, entry_idx, round(100/entry_price,6) AS quantity, round((100+100/entry_price*exit_price)*0.01,6) AS fees,
 round((exit_price-entry_price)*100/entry_price,6) AS gross_pnl, round((exit_price-entry_price)*100/entry_price-(100+100/entry_price*exit_price)*0.03,6) AS net_pnl FROM lb""")
def _(spark, sf):
    from barloom.functions.levels import trade_costs

    money = trade_costs(F.lit(100.0), F.col("entry_price"), F.col("exit_price"))
    return labelled(spark, sf).select(*POOL, "entry_idx", *[F.round(money[n], 6).alias(n) for n in ("quantity", "fees", "gross_pnl", "net_pnl")])


def sweep_stops():
    return [{"type": "percent", "value": 10}, {"type": "swing_low", "bufferPercent": 2}]
