"""Queries over accounts, cohorts, sweeps and holdout decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import account, cohorts, sweep
from barloom.operators.labels import earliest_signals
from barloom.schemas import POOL, TOKEN
from barloom.session import reuse
from barloom.sources import mapped
from barloom.suite import signals as s
from barloom.suite.base import H4, SIGNALS, TICKS, query
from barloom.suite.market import _LEDGER, store, STORE

K = s.KEYS
ONE_SLOT = {"capital": 10_000.0, "max_positions": 1, "sizing": {"type": "fixed_percent", "value": 10}, "costs": account.COSTS}
FIXED = {**ONE_SLOT, "sizing": {"type": "fixed_amount", "value": 4_000.0}}
RISK = {**ONE_SLOT, "sizing": {"type": "risk_percent", "value": 1}}


def single_slot(amount: str) -> str:
    take = "(e.entry_time>al.free_at OR (e.entry_time=al.free_at AND e.pool<>al.lp))"
    cash = "(al.cash+CASE WHEN al.free_at<=e.entry_time THEN al.pend ELSE 0 END)"
    paid = f"least({cash}/1.03, {amount.replace('CASH', cash)})"
    return s.D + s._exit_sql(False) + f""", evs AS (SELECT *, chain||':'||ca||':'||pair_id AS pool, row_number() OVER (ORDER BY entry_time, chain||':'||ca||':'||pair_id) AS rn FROM lb),
al AS (SELECT 0::BIGINT AS rn, 10000.0::DOUBLE AS cash, (-1)::BIGINT AS free_at, '' AS lp, 0.0::DOUBLE AS pend, 0.0::DOUBLE AS amount, 0.0::DOUBLE AS before
UNION ALL SELECT e.rn, CASE WHEN {take} THEN {cash}-{paid}*1.03 ELSE {cash} END, CASE WHEN {take} THEN e.exit_time ELSE al.free_at END, CASE WHEN {take} THEN e.pool ELSE al.lp END,
 CASE WHEN {take} THEN {paid}/e.entry_price*e.exit_price*0.97 WHEN al.free_at<=e.entry_time THEN 0 ELSE al.pend END, CASE WHEN {take} THEN {paid} ELSE 0 END, {cash} FROM al JOIN evs e ON e.rn=al.rn+1),
ac AS (SELECT evs.*, al.amount, al.before, al.amount/entry_price AS quantity, (exit_price-entry_price)*al.amount/entry_price-(al.amount+al.amount/entry_price*exit_price)*0.03 AS net_pnl FROM al JOIN evs USING (rn) WHERE al.amount>0)"""


ONE_SQL = single_slot("CASH*0.1")
_ACC = f" SELECT {K}, entry_idx, round(amount,4) AS amount, round(before,4) AS cash_before FROM ac"


def accepted(spark, sf, rules=ONE_SLOT):
    return account.allocate(s.labelled(spark, sf), rules)


def _acc(df):
    return df.select(*POOL, "entry_idx", F.round("amount", 4).alias("amount"), F.round("cash_before", 4).alias("cash_before"))


@query("f9_allocate_percent", ONE_SQL + _ACC)
def _(spark, sf):
    return _acc(accepted(spark, sf))


@query("f6_size_fixed_amount", single_slot("4000") + _ACC)
def _(spark, sf):
    return _acc(accepted(spark, sf, FIXED))


@query("f6_size_risk_percent", single_slot("least(CASH, CASH*0.01*e.entry_price/(e.entry_price-e.entry_price*0.9))") + _ACC)
def _(spark, sf):
    return _acc(accepted(spark, sf, RISK))


@query("f9_allocate_shared_slots")
def _(spark, sf):
    return _acc(accepted(spark, sf, {**ONE_SLOT, "max_positions": 3, "allow_reentry": False}))


@query("f8_scale_in", "SELECT l_orderkey, sum(a)/sum(a/p) AS entry_price, sum(a/p) AS quantity, sum(a)*0.03 AS costs, count(*) AS entries FROM (SELECT l_orderkey, round(l_extendedprice) AS a, l_linenumber*1.0 AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey*100000000+l_suppkey*10000+l_linenumber*100+l_quantity) AS n FROM lineitem) WHERE n<=2 GROUP BY 1")
def _(spark, sf):
    buys = mapped.table(spark, sf, "lineitem").select(
        "l_orderkey", F.round("l_extendedprice").alias("amount"), F.col("l_linenumber").cast("double").alias("price"), (F.round("l_extendedprice") * 0.03).alias("cost"),
        (F.col("l_partkey") * 100_000_000 + F.col("l_suppkey") * 10_000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).alias("time"))
    return account.scale_in(buys, ["l_orderkey"], 2).drop("first_entry_price")


EQ = ONE_SQL + f""", tm AS (SELECT DISTINCT time FROM filled), fw AS (SELECT entry_time AS time, -amount*1.03 AS flow FROM ac UNION ALL SELECT exit_time, quantity*exit_price*0.97 FROM ac WHERE exit_time IS NOT NULL),
pos AS (SELECT tm.time, a.chain, a.ca, a.pair_id, a.quantity, a.entry_price FROM tm JOIN ac a ON tm.time>=a.entry_time AND (a.exit_time IS NULL OR tm.time<a.exit_time)),
val AS (SELECT p.time, sum(p.quantity*f.close) AS v, sum((f.close-p.entry_price)*p.quantity) AS u FROM pos p ASOF JOIN filled f ON p.chain=f.chain AND p.ca=f.ca AND p.pair_id=f.pair_id AND p.time>=f.time GROUP BY 1),
fs AS (SELECT time, sum(flow) AS flow FROM fw GROUP BY 1),
eqc AS (SELECT time, 10000+sum(coalesce(flow,0)) OVER (ORDER BY time) AS cash, coalesce(v,0) AS v, coalesce(u,0) AS unrealized FROM tm LEFT JOIN fs USING (time) LEFT JOIN val USING (time)),
dd AS (SELECT *, cash+v AS equity, greatest(10000, max(cash+v) OVER (ORDER BY time)) AS peak FROM eqc)"""


def one_account(spark, sf):
    trades = account.with_money(accepted(spark, sf))
    return trades, account.equity_curve(trades, s.framed(spark, sf, s.LEGACY, s.rules.features_of(s.CUT), gated=True).where("core"), 10_000.0)


@query("f10_equity_curve", EQ + " SELECT time, round(cash,4) AS cash, round(equity,4) AS equity, round(unrealized,4) AS unrealized FROM dd")
def _(spark, sf):
    return one_account(spark, sf)[1].select("time", *[F.round(c, 4).alias(c) for c in ("cash", "equity", "unrealized")])


@query("f11_drawdown", EQ + " SELECT round(max(peak-equity),4) AS max_drawdown, round(max((peak-equity)/peak*100),6) AS max_drawdown_percent FROM dd")
def _(spark, sf):
    out = account.account_drawdown(one_account(spark, sf)[1], 10_000.0)
    return out.agg(F.round(F.max("drawdown"), 4).alias("max_drawdown"), F.round(F.max("drawdown_percent"), 6).alias("max_drawdown_percent"))


@query("f12_report", EQ + f""", o AS (SELECT *, sum(CASE WHEN net_pnl>0 THEN 1 ELSE 0 END) OVER (ORDER BY exit_time, {K}, entry_idx) AS g FROM ac), st AS (SELECT max(n) AS n FROM (SELECT count_if(net_pnl<=0) AS n FROM o GROUP BY g))
SELECT count(*) AS trades, count_if(net_pnl>0) AS wins, count_if(net_pnl<=0) AS losses, round(count_if(net_pnl>0)*1.0/count(*),8) AS win_rate, round(sum(net_pnl),4) AS net_pnl, (SELECT round((arg_max(equity,time)/10000-1)*100,6) FROM dd) AS return_percent, (SELECT round(arg_max(equity,time),4) FROM dd) AS final_equity, (SELECT round(max((peak-equity)/peak*100),6) FROM dd) AS max_drawdown_percent,
 round(sum(CASE WHEN net_pnl>0 THEN net_pnl ELSE 0 END)/-sum(CASE WHEN net_pnl>0 THEN 0 ELSE net_pnl END),6) AS profit_factor, round(avg(exit_idx-entry_idx),6) AS average_holding_bars, (SELECT n FROM st) AS max_losing_streak FROM ac""")
def _(spark, sf):
    trades, curve = one_account(spark, sf)
    out = account.report(trades, 10_000.0, curve=curve)
    digits = {"win_rate": 8, "net_pnl": 4, "return_percent": 6, "final_equity": 4, "max_drawdown_percent": 6, "profit_factor": 6, "average_holding_bars": 6}
    return out.select("trades", "wins", "losses", "max_losing_streak", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("f13_by_pool", ONE_SQL + f", pl AS (SELECT DISTINCT {K} FROM bars), p AS (SELECT {K}, count(*) AS trades, sum(net_pnl) AS net_pnl, count_if(net_pnl>0)*1.0/count(*) AS win_rate FROM ac GROUP BY 1,2,3) SELECT {K}, coalesce(trades,0) AS trades, round(coalesce(net_pnl,0),4) AS net_pnl, round(coalesce(win_rate,0),8) AS win_rate FROM pl LEFT JOIN p USING ({K})")
def _(spark, sf):
    out = account.by_pool(account.with_money(accepted(spark, sf)), s.bars(spark, sf).select(*POOL).distinct())
    return out.select(*POOL, "trades", F.round("net_pnl", 4).alias("net_pnl"), F.round("win_rate", 8).alias("win_rate"))


@query("f14_open_positions", ONE_SQL + f", lc AS (SELECT {K}, last(close ORDER BY time) AS lp, max(time) AS time FROM filled GROUP BY 1,2,3) SELECT {K}, entry_idx, round(quantity,6) AS quantity, round(lp,6) AS last_price, round(amount*0.03,6) AS fees, round((lp-entry_price)*quantity-amount*0.03,4) AS net_pnl, time FROM ac JOIN lc USING ({K})")
def _(spark, sf):
    opened = account.with_money(accepted(spark, sf)).withColumn("exit_time", F.lit(None).cast("long"))
    out = account.open_positions(opened, s.filled(spark, sf))
    return out.select(*POOL, "entry_idx", "time", *[F.round(c, d).alias(c) for c, d in {"quantity": 6, "last_price": 6, "fees": 6, "net_pnl": 4}.items()])


SIG = "WITH" + TICKS + "," + SIGNALS + _LEDGER
# One signal per customer, spread over the order dates: a large token set for the cohort splits.
COHORT_SQL = "WITH tk AS (SELECT 'c'||(o_custkey%3) AS chain, 't'||o_custkey AS ca, min(epoch_us(o_orderdate)//1000) AS signal_time FROM orders GROUP BY 1,2)"


def tokens(spark, sf):
    k = F.col("o_custkey")
    return mapped.table(spark, sf, "orders").groupBy(F.concat(F.lit("c"), (k % 3).cast("string")).alias("chain"), F.concat(F.lit("t"), k.cast("string")).alias("ca")).agg(F.min(mapped.epoch_ms("o_orderdate")).alias("signal_time"))


_DAYS = COHORT_SQL + """, d AS (SELECT *, (signal_time+28800000)//86400000 AS day FROM tk), b AS (SELECT min(day) AS f, max(day)-min(day)+1 AS span FROM d), fo AS (SELECT i, CAST(sum(span//5+CASE WHEN i<=span%5 THEN 1 ELSE 0 END) OVER (ORDER BY i) AS BIGINT) AS upto FROM b, (SELECT unnest(range(1,6)) AS i)),
e AS (SELECT d.chain, d.ca, d.signal_time, d.day, (SELECT min(i) FROM fo WHERE d.day-b.f<upto) AS fold FROM d, b)"""


@query("j1_partition_days", _DAYS + " SELECT chain, ca, signal_time, CAST(fold AS INTEGER) AS fold FROM e")
def _(spark, sf):
    return cohorts.partition_days(tokens(spark, sf))


@query("j1_fold_eligibility", _DAYS + " SELECT count(DISTINCT fold) AS folds, count(DISTINCT day) AS days, count(DISTINCT fold)=5 AND count(DISTINCT day)>=5 AS eligible FROM e")
def _(spark, sf):
    return cohorts.fold_eligibility(cohorts.partition_days(tokens(spark, sf)))


@query("j2_split_by_time", COHORT_SQL + ", r AS (SELECT *, row_number() OVER (ORDER BY signal_time) AS rn, count(*) OVER () AS n FROM tk), c AS (SELECT max(signal_time) AS cutoff FROM r WHERE rn=least(n-1,greatest(1,floor(n*0.7)))+1) SELECT tk.*, cutoff, CASE WHEN signal_time<cutoff THEN 'development' ELSE 'validation' END AS part FROM tk, c")
def _(spark, sf):
    return cohorts.split_by_time(tokens(spark, sf), 0.7)


@query("j2_split_distinct_times", COHORT_SQL + ", r AS (SELECT signal_time, row_number() OVER (ORDER BY signal_time) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT signal_time FROM tk)), c AS (SELECT max(signal_time) AS cutoff FROM r WHERE rn=least(n-1,greatest(1,floor(n*0.7)))+1) SELECT tk.*, cutoff, CASE WHEN signal_time<cutoff THEN 'development' ELSE 'validation' END AS part FROM tk, c")
def _(spark, sf):
    return cohorts.split_by_time(tokens(spark, sf), 0.7, distinct_times=True)


@query("j2_split_positional", COHORT_SQL + " SELECT chain, ca, signal_time, CASE WHEN row_number() OVER (ORDER BY signal_time, chain, ca)<=floor(count(*) OVER ()*0.6) THEN 'development' ELSE 'validation' END AS part FROM tk")
def _(spark, sf):
    return cohorts.split_positional(tokens(spark, sf))


@query("j3_split_balanced_sets", COHORT_SQL + """, h AS (SELECT *, (signal_time+28800000)//86400000 AS day, sha256('[7,["'||chain||'","'||ca||'"]]') AS h1, sha256('[7,"reserve",["'||chain||'","'||ca||'"]]') AS h2, count(*) OVER () AS n FROM tk),
p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY h1) AS pos, count(*) OVER (PARTITION BY day) AS dn, least(50, (n-10)//5) AS size FROM h), q AS (SELECT *, CAST(floor(dn*size/n) AS BIGINT) AS base FROM p),
d AS (SELECT *, CASE WHEN base>0 AND pos<=base*5 THEN (pos-1)//base+1 END AS direct FROM q), g AS (SELECT CAST(sum(base) AS BIGINT) AS given FROM (SELECT DISTINCT day, base FROM q)),
r AS (SELECT chain, ca, row_number() OVER (ORDER BY h2) AS turn FROM d WHERE direct IS NULL)
SELECT d.chain, d.ca, d.signal_time, CAST(coalesce(direct, CASE WHEN turn<=(size-given)*5 THEN (turn-1)%5+1 ELSE 6 END) AS INTEGER) AS fold FROM d LEFT JOIN r USING (chain, ca), g""")
def _(spark, sf):
    return cohorts.split_balanced_sets(tokens(spark, sf), 7, 50, 5, 10)


@query("j4_fold_subsets", _LEDGER.replace(", sc AS", "WITH sc AS") + " SELECT subset, count(*) AS rows, round(sum(account_return),2) AS total FROM sc JOIN (SELECT i AS subset, j AS fold FROM (SELECT unnest(range(1,32)) AS i), (SELECT unnest(range(1,6)) AS j) WHERE (i >> (j-1)) & 1 = 1) f ON f.fold=sc.cohort GROUP BY 1")
def _(spark, sf):
    subsets = cohorts.fold_subsets(spark, 5)
    return mapped.scores(spark, sf).join(subsets, F.col("cohort") == F.col("fold")).groupBy("subset").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("account_return"), 2).alias("total"))


J = _LEDGER.replace(", sc AS", "WITH sc AS") + """, md AS (SELECT *, median(account_return) OVER (PARTITION BY chain, candidate_id) AS med FROM sc), ds AS (SELECT chain, candidate_id, any_value(med) AS median, max(abs(account_return-med)) AS deviation, min(account_return) AS min_return, max(max_drawdown) AS worst_drawdown, min(total_trades) AS min_trades, count(*) AS folds,
 bool_and(account_return>0 AND total_trades>=10 AND max_drawdown<=14.8) AS ok FROM md GROUP BY 1,2)"""
_DISP = "round(median,6) AS median, round(deviation,6) AS deviation, min_return, worst_drawdown, folds"


def scored(spark, sf):
    return mapped.scores(spark, sf)


def dispersed(spark, sf):
    return cohorts.dispersion(scored(spark, sf), ["chain", "candidate_id"])


@query("j5_median_deviation", J + f" SELECT chain, candidate_id, {_DISP} FROM ds")
def _(spark, sf):
    return dispersed(spark, sf).select("chain", "candidate_id", F.round("median", 6).alias("median"), F.round("deviation", 6).alias("deviation"), "min_return", "worst_drawdown", "folds")


@query("j6_stability_gate", J + " SELECT chain, candidate_id, concat_ws(',', CASE WHEN folds<>5 THEN 'folds' END, CASE WHEN NOT ok THEN 'fold_scores' END, CASE WHEN NOT (median>0 AND deviation/median<=0.5) THEN 'deviation' END) AS failed, folds=5 AND ok AND median>0 AND deviation/median<=0.5 AS pass FROM ds")
def _(spark, sf):
    out = cohorts.stability_gate(scored(spark, sf), ["chain", "candidate_id"], 5, 10, 14.8)
    return out.select("chain", "candidate_id", "failed", "pass")


@query("j6_stability_with_variants", J + ", x AS (SELECT chain, candidate_id, bool_and(account_return>0 AND total_trades>=10 AND max_drawdown<=14.8) AS xo FROM sc WHERE cohort>=4 GROUP BY 1,2) SELECT chain, candidate_id, coalesce(xo,false) AS variants_ok FROM ds LEFT JOIN x USING (chain, candidate_id)")
def _(spark, sf):
    sc = scored(spark, sf)
    out = cohorts.stability_gate(sc, ["chain", "candidate_id"], 5, 10, 14.8, sc.where("cohort >= 4"))
    return out.select("chain", "candidate_id", (~F.col("failed").contains("variants")).alias("variants_ok"))


for _name, _order in {"stable": "min_return DESC, deviation, worst_drawdown, candidate_id", "development": "min_return DESC, worst_drawdown, candidate_id"}.items():
    @query(f"j7_rank_{_name}", J.replace("max(abs(account_return-med)) AS deviation", "round(max(abs(account_return-med)),6) AS deviation") + f" SELECT chain, candidate_id, row_number() OVER (PARTITION BY chain ORDER BY {_order}) AS rank FROM ds")
    def _(spark, sf, name=_name):
        d = dispersed(spark, sf).withColumn("deviation", F.round("deviation", 6))
        return cohorts.rank_rows(d, cohorts.RANKINGS[name](), ["chain"]).select("chain", "candidate_id", "rank")

for _name, _order in {"return": "account_return DESC, max_drawdown, candidate_id", "net": "net_pnl DESC, max_drawdown, candidate_id", "normal": "normal_return DESC, max_drawdown, candidate_id"}.items():
    @query(f"j7_rank_{_name}", J + f" SELECT chain, cohort, candidate_id, row_number() OVER (PARTITION BY chain, cohort ORDER BY {_order}) AS rank FROM sc")
    def _(spark, sf, name=_name):
        return cohorts.rank_rows(scored(spark, sf), cohorts.RANKINGS[name](), ["chain", "cohort"]).select("chain", "cohort", "candidate_id", "rank")


@query("j8_top_k_per_chain", J + " SELECT chain, candidate_id, cohort, rank FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY account_return DESC, max_drawdown, cohort, candidate_id) AS rank FROM sc) WHERE rank<=10")
def _(spark, sf):
    ranked = cohorts.rank_rows(scored(spark, sf), [*cohorts.RANKINGS["batch"](), F.asc("candidate_id")], ["chain"])
    return ranked.where("rank <= 10").select("chain", "candidate_id", "cohort", "rank")


BASE = {"id": "base", "swing": s.LEGACY, "entry": s.backtest.DEFAULT["entry"], "invalidation": s.CUT, "exits": s.LOCKED, "costs": account.COSTS, "max_positions": 3, "sizing": {"type": "fixed_percent", "value": 2}}


def _cohort_frame(spark, sf):
    return earliest_signals(mapped.signals(spark, sf)).select(*TOKEN, (F.substring("ca", 2, 1).cast("int") % 2 + 1).alias("cohort"))


def study_candidates():
    picks = [{**BASE, "id": "a"}, {**BASE, "id": "b", "exits": {**s.LOCKED, "maxHoldingBars": 10}}]
    return picks


def run_sweep(spark, sf, candidates):
    return sweep.sweep(s.bars(spark, sf), earliest_signals(mapped.signals(spark, sf)), _cohort_frame(spark, sf), candidates, H4, block=s.BLOCK)


@query("j12_sweep")
def _(spark, sf):
    return run_sweep(spark, sf, study_candidates())[0]


@query("j13_stress")
def _(spark, sf):
    return run_sweep(spark, sf, [BASE, *sweep.stress_variants(BASE)])[0]


@query("j14_leave_best_out")
def _(spark, sf):
    picks = study_candidates()[:2]
    _, trades = run_sweep(spark, sf, picks)
    best = reuse(sweep.leave_best_out(trades, _cohort_frame(spark, sf)))
    labelled, _core = sweep.labelled_candidates(s.bars(spark, sf), earliest_signals(mapped.signals(spark, sf)), picks, H4, s.BLOCK)
    again = sweep.rescore_without_best(labelled.join(_cohort_frame(spark, sf), TOKEN), best, {"capital": 10_000.0, "max_positions": 3, "sizing": BASE["sizing"], "costs": account.COSTS}, 10_000.0)
    return best.join(again, ["candidate_id", "cohort"], "left")


@query("j15_attribution", s.D + s._exit_sql(False) + """, t AS (SELECT *, (exit_price-entry_price)*100/entry_price-(100+100/entry_price*exit_price)*0.03 AS net_pnl FROM lb), g AS (SELECT chain, ca, CASE WHEN ca='t1' THEN 1900000000000 ELSE signal_time END AS signal_time FROM gate WHERE ca<>'t2')
SELECT CASE WHEN signal_time IS NULL THEN 'missing_signal' WHEN entry_time>signal_time THEN 'after_signal' ELSE 'before_or_at_signal' END AS kind, count(*) AS trades, round(sum(net_pnl),3) AS net_pnl FROM t LEFT JOIN g USING (chain, ca) GROUP BY 1""")
def _(spark, sf):
    return cohorts.attribution(_flat_trades(spark, sf), earliest_signals(mapped.signals(spark, sf)).where("ca <> 't2'").withColumn(
        "signal_time", F.when(F.col("ca") == "t1", 1900000000000).otherwise(F.col("signal_time"))))


def _flat_trades(spark, sf):
    return account.with_money(s.labelled(spark, sf).withColumn("amount", F.lit(100.0)))


NET = "(exit_price-entry_price)*100/entry_price-(100+100/entry_price*exit_price)*0.03"


@query("j16_synthetic_entry_audit", s.D + s._exit_sql(False) + f" SELECT entry_synthetic, count(*) AS trades, round(sum({NET}),3) AS net_pnl FROM lb GROUP BY 1")
def _(spark, sf):
    return _flat_trades(spark, sf).groupBy("entry_synthetic").agg(F.count(F.lit(1)).alias("trades"), F.round(F.sum("net_pnl"), 3).alias("net_pnl"))


@query("j17_exit_breakdown", s.D + s._exit_sql(False) + f" SELECT 'x' AS candidate_id, 1 AS cohort, exit_reason, count(*) AS trades, round(sum({NET}),3) AS net_pnl FROM lb GROUP BY 3")
def _(spark, sf):
    t = _flat_trades(spark, sf).withColumn("candidate_id", F.lit("x")).withColumn("cohort", F.lit(1))
    return sweep.exit_breakdown(t).withColumn("net_pnl", F.round("net_pnl", 3))


@query("j18_ledger_hash", "WITH b AS (SELECT l_returnflag, sha256('{\"l_linenumber\":'||l_linenumber||',\"l_orderkey\":'||l_orderkey||',\"l_partkey\":'||l_partkey||'}') AS h FROM lineitem) SELECT l_returnflag, count(*) AS rows, CAST(sum(('0x'||substr(h,1,8))::BIGINT) AS BIGINT) AS hash_a, CAST(sum(('0x'||substr(h,9,8))::BIGINT) AS BIGINT) AS hash_b FROM b GROUP BY 1")
def _(spark, sf):
    return cohorts.ledger_hash(mapped.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey"), ["l_returnflag"])


@query("j18_parity", J + " SELECT chain, candidate_id, cohort, total_trades%7<>0 AND account_return%5<>0 AS same FROM sc")
def _(spark, sf):
    a = scored(spark, sf)
    b = a.withColumn("total_trades", F.col("total_trades") + F.when(F.col("total_trades") % 7 == 0, 1).otherwise(0)).withColumn(
        "account_return", F.when(F.col("account_return") % 5 == 0, F.col("account_return") + 1).otherwise(F.col("account_return") * (1 + 1e-9)))
    return cohorts.parity(a, b, ["chain", "candidate_id", "cohort"], ["total_trades"], ["account_return"])


@query("j19_shared_leader", J + ", cs AS (SELECT 'E'||substr(candidate_id,4) AS candidate_id, chain, sum(account_return) AS account_return, sum(total_trades) AS total_trades, max(max_drawdown) AS max_drawdown FROM sc GROUP BY 1,2), p AS (SELECT candidate_id, count(DISTINCT chain) AS chains, avg(account_return) AS mean_return, max(max_drawdown) AS worst_drawdown, bool_and(total_trades>=10 AND max_drawdown<=20) AS ok FROM cs GROUP BY 1) SELECT candidate_id, chains, round(mean_return,6) AS mean_return, worst_drawdown, row_number() OVER (ORDER BY mean_return DESC, worst_drawdown, candidate_id) AS rank FROM p WHERE ok AND chains=3")
def _(spark, sf):
    sc = scored(spark, sf).groupBy(F.concat(F.lit("E"), F.substring("candidate_id", 4, 10)).alias("candidate_id"), "chain").agg(
        F.sum("account_return").alias("account_return"), F.sum("total_trades").alias("total_trades"), F.max("max_drawdown").alias("max_drawdown"))
    return cohorts.shared_leader(sc, 3).withColumn("mean_return", F.round("mean_return", 6))


@query("j20_holdout_decision", J + ", w AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY account_return DESC, max_drawdown, candidate_id) AS rn FROM sc WHERE cohort=1 AND total_trades>=10 AND max_drawdown<=20) SELECT w.chain, w.candidate_id, w.account_return AS dev_return, w.max_drawdown AS dev_drawdown, w.total_trades AS dev_trades, v.account_return AS val_return, v.max_drawdown AS val_drawdown, v.total_trades AS val_trades, coalesce(w.account_return>0 AND v.account_return>0 AND v.total_trades>=10 AND v.max_drawdown<=20,false) AS accepted FROM w LEFT JOIN sc v ON v.chain=w.chain AND v.candidate_id=w.candidate_id AND v.cohort=2 WHERE rn=1")
def _(spark, sf):
    sc = scored(spark, sf)
    return cohorts.holdout_decision(sc.where("cohort = 1"), sc.where("cohort = 2"), ["chain"])


@query("j21_early_stop", J + ", k AS (SELECT candidate_id||chain AS candidate_id, cohort, account_return, account_return>0 AS ok FROM sc), e AS (SELECT *, cohort AS pos FROM k WHERE cohort<=4) SELECT candidate_id, cohort FROM e WHERE (SELECT count(*) FROM e p WHERE p.candidate_id=e.candidate_id AND p.pos<e.pos AND p.ok)=pos-1")
def _(spark, sf):
    sc = scored(spark, sf).withColumn("candidate_id", F.concat("candidate_id", "chain"))
    return cohorts.early_stop(sc, [1, 2, 3, 4], F.col("account_return") > 0).select("candidate_id", "cohort")


@query("j22_study_table", J + " SELECT chain, candidate_id, " + ", ".join(f"max(CASE WHEN cohort={i} THEN account_return END) AS \"{i}_return\", max(CASE WHEN cohort={i} THEN total_trades END) AS \"{i}_trades\", max(CASE WHEN cohort={i} THEN max_drawdown END) AS \"{i}_drawdown\"" for i in range(1, 6)) + " FROM sc GROUP BY 1,2")
def _(spark, sf):
    return cohorts.study_table(scored(spark, sf), [1, 2, 3, 4, 5])


@query("j23_snapshot_reuse", STORE + "SELECT DISTINCT chain, interval, type, NOT (chain='c1' AND type='mcap') AS reusable FROM store")
def _(spark, sf):
    old = store(spark, sf).select(*POOL, "interval", "type", "time", "close")
    new = old.withColumn("close", F.col("close") + F.when((F.col("chain") == "c1") & (F.col("type") == "mcap"), 1).otherwise(0))
    return cohorts.snapshot_reuse(old, new, ["chain", "interval", "type"])
