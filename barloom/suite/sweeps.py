"""Whole candidate sets scored through staircases, and the brute-force SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import staircase, sweep
from barloom.operators.labels import earliest_signals
from barloom.sources import mapped
from barloom.suite import signals as s
from barloom.suite.base import H4, query
from barloom.suite.studies import BASE, _cohort_frame

K = s.KEYS
DELAYS = [0, 30, 60, 240]


def value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x)


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)


def rule_sql(node) -> str:
    """A rule tree over one row of bar, swing and indicator columns."""
    if node.get("enabled") is False:
        return "false"
    if "conditions" in node:
        parts = [rule_sql(c) for c in node["conditions"] if c.get("enabled") is not False]
        if not parts:
            return "false"
        if node["mode"] == "at_least":
            return "(" + "+".join(f"CASE WHEN {p} THEN 1 ELSE 0 END" for p in parts) + f">={max(1, node.get('minMatches') or 1)})"
        return "(" + (" AND " if node["mode"] == "all" else " OR ").join(parts) + ")"
    n = node
    return "coalesce(" + {
        "fib_retracement": lambda: f"(s_high-close)/(s_high-s_low) BETWEEN {n['zoneLow']} AND {n['zoneHigh']} AND idx>=confirmed_idx",
        "percent_retracement": lambda: f"(s_high-close)/s_high*100 BETWEEN {n['minPercent']} AND {n['maxPercent']}",
        "volume_contraction": lambda: f"average_volume>0 AND (cv-CASE WHEN high_idx>idx-{n['period']} THEN h_cv ELSE coalesce(cv_{n['period']},0) END)/(idx-greatest(high_idx,idx-{n['period']}))/average_volume<={n['maxRatio']}",
        "bullish_volume_confirmation": lambda: f"close>open AND volume>=vm{n['period']}*{n['minRatio']}",
        "candle_pattern": lambda: " OR ".join(n["patterns"]),
        "rsi_recovery": lambda: f"rsi{n['period']}_prev<={n['oversold']} AND rsi{n['period']}>={n['recovery']}",
        "ema_reclaim": lambda: f"prev_close<=ema{n['period']}_prev AND close>ema{n['period']} AND idx>=1",
        "obv_confirmation": lambda: f"idx>={n['lookbackBars']} AND v{n['lookbackBars']}>0 AND sv{n['lookbackBars']}/v{n['lookbackBars']}*100>={n['minChangePercent']}",
    }[n["type"]]() + ",false)"


def scores_sql(candidates, amount: float = 100.0) -> str:
    """Every entry against every bar of its horizon for every spec."""
    x = staircase.specify(candidates)
    feats = {(a, b) for rule, _ in x.kinds for a, b in staircase.features_of(rule)}
    rsi, ema = ({n for kind, n in feats if kind == name} for name in ("rsi", "ema"))
    obv = {n for kind, n in feats if kind == "obv"}
    means = {n for kind, n in feats if kind == "vmean"} | {p for p, _, _ in x.bears}
    widths = sorted({r.left for r in x.swings})
    pivots = ", ".join(f"idx>={p} AND lead(idx,{p}) OVER w IS NOT NULL AND {a}{op}{f}({a}) OVER (w ROWS BETWEEN {p} PRECEDING AND {p} FOLLOWING) AS {n}{p}"
                       for p in widths for a, op, f, n in (("low", "<=", "min", "lp"), ("high", ">=", "max", "hp")))
    swings = values((n, r.left, r.lookback, float(r.min_gain), r.max_duration) for n, r in enumerate(x.swings))
    chosen = " OR ".join(f"(v.p={p} AND h.hp{p} AND l.lp{p})" for p in widths)
    inner = [f"{s._rsi_sql(n)} AS rsi{n}" for n in sorted(rsi)] + [f"avg(volume) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS vm{n}" for n in sorted(means)]
    for n in sorted(obv):
        inner += [f"sum(volume) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS v{n}", f"sum(coalesce(sign(d)*volume,0)) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS sv{n}"]
    outer = [f"lag(rsi{n}) OVER w AS rsi{n}_prev" for n in sorted(rsi)] + [f"ema{n}.ema AS ema{n}, lag(ema{n}.ema) OVER w AS ema{n}_prev" for n in sorted(ema)] + ["lag(cv,10) OVER w AS cv_10"]
    emas = "".join(s.ema_cte(n) for n in sorted(ema))
    met = ", ".join(f"(high_idx IS NOT NULL AND coalesce(time>signal_time+{delay * 60000},false) AND {rule_sql(rule)}) AS m{k}" for k, (rule, delay) in enumerate(x.kinds))
    edge = ", ".join(f"CASE WHEN m{k} AND NOT coalesce(lag(m{k}) OVER u,false) THEN {k} END" for k in range(len(x.kinds)))
    locks = "".join(f", greatest({', '.join(f'CASE WHEN pk>=entry_price*{1 + t["activationPercent"] / 100!r} THEN entry_price*{1 + t["floorPercent"] / 100!r} END' for t in tiers)}) AS lk{i}" for i, tiers in enumerate(x.locks))
    bears = "".join(f", coalesce(close<open AND (open-close)/open*100>={least} AND volume>=vm{p}*{ratio},false) AS be{i}" for i, (p, ratio, least) in enumerate(x.bears))
    lock = "CASE lock " + " ".join(f"WHEN {i} THEN lk{i}" for i in range(len(x.locks))) + " END" if x.locks else "NULL::DOUBLE"
    bear = "coalesce(CASE bear " + " ".join(f"WHEN {i} THEN be{i}" for i in range(len(x.bears))) + " END,false)" if x.bears else "false"
    names = ", ".join(c.split()[0] for c in staircase.SPEC_COLUMNS.split(","))
    horizon = max(r[9] for r in x.rows)
    w = f"WINDOW w AS (PARTITION BY {K} ORDER BY idx)"
    return s.D + f""", pv AS MATERIALIZED (SELECT *, sum(volume) OVER w AS cv, {pivots} FROM filled {w}),
v(swing_no, p, lookback, min_gain, max_duration) AS ({swings}),
prs AS MATERIALIZED (SELECT v.swing_no, h.chain, h.ca, h.pair_id, h.idx AS high_idx, l.idx AS low_idx, l.low AS s_low, h.high AS s_high, h.idx+v.p AS confirmed_idx, l.idx+v.lookback-1 AS ends_at,
  (h.cv-l.cv+l.volume)/(h.idx-l.idx+1) AS average_volume, h.cv AS h_cv FROM pv h JOIN pv l USING ({K}) JOIN v ON ({chosen})
  WHERE l.low>0 AND h.idx>l.idx AND h.idx-l.idx<=v.max_duration AND (h.high/l.low-1)*100>=v.min_gain),
al AS MATERIALIZED (SELECT f.chain, f.ca, f.pair_id, f.idx, p.swing_no, arg_max(p, p.high_idx*1000000+p.low_idx) AS b FROM pv f JOIN prs p USING ({K}) WHERE f.idx BETWEEN p.confirmed_idx AND p.ends_at GROUP BY ALL),
ch AS (SELECT *, close-lag(close) OVER w AS d, lag(close) OVER w AS prev_close, lag(open) OVER w AS prev_open FROM pv {w}){emas},
f0 AS (SELECT *, {s.PATTERN_SQL}{''.join(', ' + i for i in inner)} FROM ch {w}),
fe AS MATERIALIZED (SELECT f0.*, {', '.join(outer)} FROM f0 {' '.join(f'JOIN e{n} AS ema{n} USING ({K}, idx)' for n in sorted(ema))} {w}),
mt AS (SELECT {K}, idx, time, close, synthetic, is_last, swing_no, s_low, s_high, {met} FROM (SELECT fe.*, signal_time, v.swing_no, b.high_idx, b.s_low, b.s_high, b.confirmed_idx, b.average_volume, b.h_cv
  FROM fe JOIN v ON true LEFT JOIN al USING ({K}, idx, swing_no) LEFT JOIN gate USING (chain, ca))),
en AS MATERIALIZED (SELECT * FROM (SELECT {K}, idx AS entry_idx, time AS entry_time, close AS entry_price, synthetic, is_last AS e_last, swing_no, s_low, s_high, unnest([{edge}]) AS kind FROM mt WINDOW u AS (PARTITION BY {K}, swing_no ORDER BY idx)) WHERE kind IS NOT NULL),
sp({names}) AS ({values(x.rows)}),
lv AS MATERIALIZED (SELECT *, CASE target_type WHEN 'percent' THEN entry_price*(1+target_value/100) WHEN 'risk_reward' THEN entry_price+greatest(0,entry_price-stop)*target_value WHEN 'previous_high' THEN s_high ELSE s_high-(s_high-s_low)*target_value END AS target FROM
 (SELECT *, CASE stop_type WHEN 'percent' THEN entry_price*(1-stop_value/100) WHEN 'swing_low' THEN s_low*(1-stop_buffer/100) ELSE (s_high-(s_high-s_low)*stop_value)*(1-stop_buffer/100) END AS stop FROM en JOIN sp USING (swing_no, kind))),
hb AS MATERIALIZED (SELECT *{locks}{bears} FROM (SELECT e.*, f.idx, f.open, f.high, f.low, f.close, f.volume, f.is_last, {', '.join(f'vm{n}' for n in sorted(means)) or '0 AS z'},
  max(f.close) OVER (PARTITION BY {K}, entry_idx ORDER BY f.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk
  FROM (SELECT DISTINCT {K}, entry_idx, entry_price FROM en) e JOIN fe f USING ({K}) WHERE f.idx>entry_idx AND f.idx<=entry_idx+{horizon})),
hx AS (SELECT spec, {K}, entry_idx, idx, open, close, stop, target, greatest(stop, coalesce(lk, stop)) AS fl, CASE WHEN low<=greatest(stop, coalesce(lk, stop)) THEN CASE WHEN coalesce(lk>stop,false) THEN 'profit_lock' ELSE 'stop_loss' END
   WHEN coalesce(close<(s_high-(s_high-s_low)*fib_ratio)*(1-fib_buffer/100),false) OR coalesce(close<s_low*(1-low_buffer/100),false) OR be THEN 'invalidation'
   WHEN target>entry_price AND high>=target THEN 'take_profit' WHEN idx-entry_idx>=hold THEN 'timeout' WHEN close_at_end AND is_last THEN 'end_of_backtest' END AS tp
  FROM (SELECT lv.*, hb.idx, hb.open, hb.high, hb.low, hb.close, hb.is_last, {lock} AS lk, {bear} AS be FROM lv JOIN hb USING ({K}, entry_idx) WHERE hb.idx-entry_idx<=hold)),
fx AS (SELECT spec, {K}, entry_idx, min(idx) AS exit_idx, arg_min(tp, idx) AS tp, arg_min(CASE WHEN tp='take_profit' THEN greatest(open,target) WHEN tp IN ('stop_loss','profit_lock') THEN least(open,fl) ELSE close END, idx) AS price FROM hx WHERE tp IS NOT NULL GROUP BY ALL),
lb AS (SELECT lv.spec, chain, ca, entry_price, synthetic, fee, slippage, buy_tax, sell_tax, CASE WHEN close_at_end AND e_last THEN entry_idx ELSE exit_idx END-entry_idx AS held,
  CASE WHEN close_at_end AND e_last THEN 'end_of_backtest' ELSE tp END AS tp, CASE WHEN close_at_end AND e_last THEN entry_price ELSE price END AS price FROM lv LEFT JOIN fx USING (spec, {K}, entry_idx)),
co AS (SELECT chain, ca, CAST(CAST(substr(ca,2,1) AS INTEGER)%2+1 AS INTEGER) AS cohort FROM gate),
tr AS (SELECT *, {amount}/entry_price*price AS proceeds FROM lb JOIN co USING (chain, ca) WHERE tp IS NOT NULL),
ne AS (SELECT *, (price-entry_price)*{amount}/entry_price-({amount}+proceeds)*(fee+slippage)/100-{amount}*buy_tax/100-proceeds*sell_tax/100 AS net FROM tr),
tk AS (SELECT spec, cohort, chain||':'||ca AS token, sum(net) AS n FROM ne WHERE tp<>'end_of_backtest' GROUP BY ALL),
tb AS (SELECT spec, cohort, max(n) AS n, arg_max(token, n) AS token FROM tk WHERE n>0 GROUP BY ALL),
sc AS (SELECT spec, cohort, count(*) AS total_trades, count_if(net>0) AS wins, sum(net) AS net_pnl, count_if(tp='end_of_backtest') AS excluded_count, sum(CASE WHEN tp='end_of_backtest' THEN net ELSE 0 END) AS excluded_net,
  sum(greatest(net,0)) AS gain, sum(greatest(-net,0)) AS loss, sum(({amount}+proceeds)*fee/100) AS fees, count_if(synthetic) AS synthetic_entries, CAST(sum(held) AS BIGINT) AS bars_held FROM ne GROUP BY ALL),
ca(candidate_id, spec) AS ({values(x.candidates)})
SELECT candidate_id, cohort, coalesce(total_trades,0) AS total_trades, coalesce(wins,0) AS wins, round(coalesce(net_pnl,0),4) AS net_pnl, coalesce(excluded_count,0) AS excluded_count, round(coalesce(excluded_net,0),4) AS excluded_net,
 round(coalesce(gain,0),4) AS gain, round(coalesce(loss,0),4) AS loss, round(coalesce(fees,0),4) AS fees, coalesce(synthetic_entries,0) AS synthetic_entries, coalesce(bars_held,0) AS bars_held,
 round(wins/total_trades,6) AS win_rate, round(gain/nullif(loss,0),6) AS profit_factor, token AS top_token, round(coalesce(n,0),4) AS top_token_pnl, coalesce(total_trades,0)<10 AS low_sample
FROM ca CROSS JOIN (SELECT DISTINCT cohort FROM co) LEFT JOIN sc USING (spec, cohort) LEFT JOIN tb USING (spec, cohort)"""


def scored(spark, sf, candidates):
    out = staircase.score_candidates(s.bars(spark, sf), earliest_signals(mapped.signals(spark, sf)), _cohort_frame(spark, sf), candidates, H4, block=s.BLOCK)
    return out.withColumns({c: F.round(c, 6 if c in ("win_rate", "profit_factor") else 4) for c in ("net_pnl", "excluded_net", "gain", "loss", "fees", "win_rate", "profit_factor", "top_token_pnl")})


def derived() -> list[dict]:
    """Delays with and without re-entry, exits around the base, and rotated invalidations."""
    made = sweep.delay_variants({**BASE, "id": "d"}, DELAYS) + sweep.exit_grid({**BASE, "id": "x"}, s.sweep_stops(), [{"type": "previous_high"}, {"type": "risk_reward", "ratio": 2}, {"type": "percent", "value": 50}], [10, 20, 60])
    return sweep.rotate_invalidations(made, 1)


def families() -> dict[str, list[dict]]:
    cheap = {**BASE, "id": "cheap", "costs": {"feePercent": 0.5, "slippagePercent": 0.5, "buyTaxPercent": 0.0, "sellTaxPercent": 0.0}}
    stress = [BASE, cheap, *sweep.stress_variants(BASE), *sweep.recheck([cheap])]
    return {
        "j9_grid_scores": sweep.whole_grid(BASE), "j10_neighborhood_scores": sweep.neighbours(BASE), "j11_derived_candidates": derived(),
        "j12_sweep_fixed_amount": [{**BASE, "id": "a"}, {**BASE, "id": "b", "exits": {**s.LOCKED, "maxHoldingBars": 10}}], "j13_stress_fixed_amount": stress}


def _register(name, candidates):
    @query(name, scores_sql(candidates))
    def _(spark, sf):
        return scored(spark, sf, candidates)


for _name, _candidates in families().items():
    _register(_name, _candidates)
