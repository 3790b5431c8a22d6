"""Shared-capital accounts over labelled entries, and the curves and reports that follow from them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions.levels import COSTS
from barloom.operators.results import drawdown
from barloom.plans.blocks import block_of, cover, scan
from barloom.schemas import POOL
from barloom.session import cut, reuse

PROVISIONAL_STOP = 0.9  # fixed value: the first risk-sized entry assumes a stop ten percent below


def position_amount(sizing: Mapping, cash: float, price: float, cost_rate: float, stop: float | None = None) -> float:
    """Amount of one buy, never more than the cash left after its own costs."""
    if sizing["type"] == "fixed_amount":
        wanted = sizing["value"]
    elif sizing["type"] == "fixed_percent":
        wanted = cash * sizing["value"] / 100
    else:
        floor = price * PROVISIONAL_STOP if stop is None else stop
        wanted = min(cash, cash * sizing["value"] / 100 * price / max(2.220446049250313e-16, price - floor))
    return max(0.0, min(cash / (1 + cost_rate), wanted))


class _Account:
    """Cash, open positions and re-entry marks of one account; bounded by its slots and pools."""

    def __init__(self, rules: Mapping):
        self.rules, self.costs = rules, rules.get("costs", COSTS)
        self.cash, self.open, self.traded, self.sold = float(rules["capital"]), [], set(), {}
        c = self.costs
        self.buy_rate = (c["feePercent"] + c["slippagePercent"] + c["buyTaxPercent"]) / 100
        self.sell_rate = (c["feePercent"] + c["slippagePercent"] + c["sellTaxPercent"]) / 100

    def settle(self, time: float) -> None:
        while self.open and self.open[0][0] <= time:
            at, pool, quantity, price = heapq.heappop(self.open)
            self.cash += quantity * price * (1 - self.sell_rate)
            self.sold[pool] = at

    def offer(self, pool: str, entry_time: int, price: float, exit_time: float, exit_price: float):
        """(amount, cash before) if the entry is accepted, else None. Exits up to this time come first."""
        self.settle(entry_time)
        held = any(p == pool for _, p, _, _ in self.open)
        if held or len(self.open) >= self.rules["max_positions"] or self.sold.get(pool) == entry_time:
            return None
        if pool in self.traded and not self.rules.get("allow_reentry", True):
            return None
        before = self.cash
        amount = position_amount(self.rules["sizing"], before, price, self.buy_rate)
        if not amount:
            return None
        self.cash -= amount * (1 + self.buy_rate)
        if not self.rules.get("allow_reentry", True):
            self.traded.add(pool)
        end = float("inf") if exit_time != exit_time or exit_time is None else exit_time
        heapq.heappush(self.open, (end, pool, amount / price, exit_price))
        if end == entry_time:
            self.settle(entry_time)
        return amount, before


def allocate(labelled: DataFrame, rules: Mapping, keys: Sequence[str] = (), overrides: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Accepted trades with ``amount`` and ``cash_before`` per account (``keys``; none means a single account).

    An account is sequential in its cash, so its *events* (never bars) are sorted by time inside one partition and
    streamed batch by batch; memory holds the open positions only, and accounts run in parallel. ``overrides``
    replaces rules by the value of the first key (a candidate's own sizing or slots). The labels are written before they are
    read twice: the plan that made them would otherwise stand in the driver once per reader.
    """
    account = list(keys)
    labelled = cut(labelled, "account-labels")
    pool_key = F.concat_ws(":", *POOL)
    slim = labelled.select(
        *account, *POOL, "entry_idx", "entry_time", "entry_price", "exit_time", "exit_price", pool_key.alias("_pool"))
    partitions = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = slim.repartition(partitions, *account) if account else slim.coalesce(1)
    ordered = spread.sortWithinPartitions(*account, "entry_time", "_pool")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            idents = list(zip(*[pdf[k] for k in account])) if account else [()] * len(pdf)
            amounts, befores = [], []
            for ident, pool, at, price, end, out in zip(
                idents, pdf["_pool"], pdf["entry_time"], pdf["entry_price"], pdf["exit_time"], pdf["exit_price"]
            ):
                if state is None or ident != current:
                    current, state = ident, _Account({**rules, **(overrides or {}).get(ident[0], {})} if ident else rules)
                taken = state.offer(pool, at, price, end, out)
                amounts.append(taken[0] if taken else None)
                befores.append(taken[1] if taken else None)
            kept = pdf.assign(amount=pd.Series(amounts, dtype="float64", index=pdf.index), cash_before=pd.Series(befores, dtype="float64", index=pdf.index))
            yield kept[kept["amount"].notna()][[*account, *POOL, "entry_idx", "amount", "cash_before"]]

    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join([*[f"{c} {types[c]}" for c in [*account, *POOL, "entry_idx"]], "amount double", "cash_before double"])
    accepted = ordered.mapInPandas(walk, schema)
    return labelled.join(accepted, [*account, *POOL, "entry_idx"])


def with_money(accepted: DataFrame, costs: Mapping = COSTS) -> DataFrame:
    """Quantity, both sides' costs, and gross and net PnL (null while open)."""
    quantity = F.col("amount") / F.col("entry_price")
    proceeds = quantity * F.col("exit_price")
    pct = lambda n: costs[n] / 100
    buy = {"fees": pct("feePercent"), "slippage_cost": pct("slippagePercent"), "tax_cost": pct("buyTaxPercent")}
    sell = {"fees": pct("feePercent"), "slippage_cost": pct("slippagePercent"), "tax_cost": pct("sellTaxPercent")}
    parts = {n: F.col("amount") * buy[n] + F.coalesce(proceeds, F.lit(0.0)) * sell[n] for n in buy}
    gross = (F.col("exit_price") - F.col("entry_price")) * quantity
    return accepted.select(
        *accepted.columns, quantity.alias("quantity"), *[c.alias(n) for n, c in parts.items()], gross.alias("gross_pnl"),
        (gross - parts["fees"] - parts["slippage_cost"] - parts["tax_cost"]).alias("net_pnl"))


def scale_in(buys: DataFrame, key: Sequence[str], max_entries: int) -> DataFrame:
    """Position of a trade bought in parts: average price, quantity and costs of its first ``max_entries`` buys."""
    order = Window.partitionBy(*key).orderBy("time")
    taken = buys.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_entries)
    return taken.groupBy(*key).agg(
        (F.sum("amount") / F.sum(F.col("amount") / F.col("price"))).alias("entry_price"), F.sum(F.col("amount") / F.col("price")).alias("quantity"),
        F.sum("cost").alias("costs"), F.min_by("price", "time").alias("first_entry_price"), F.count(F.lit(1)).alias("entries"))


def equity_curve(trades: DataFrame, bars: DataFrame, capital: float, keys: Sequence[str] = (), costs: Mapping = COSTS, block: int = 512) -> DataFrame:
    """Cash, equity and unrealized value of each account.

    Everything is a running sum of changes: money that flows, and what each held position gains from one bar of its pool
    to the next. Between two bars, and after a pool's last one, a position keeps its last price. A single account has a
    row at every bar time; with ``keys`` the rows are the times at which an account changes, as equity is flat elsewhere.
    Trades, bars and the changes per time are read several times, so each is written once and its plan ends there.
    """
    account = list(keys)
    buy_rate = (costs["feePercent"] + costs["slippagePercent"] + costs["buyTaxPercent"]) / 100
    sell_rate = (costs["feePercent"] + costs["slippagePercent"] + costs["sellTaxPercent"]) / 100
    t = cut(trades, "account-trades")
    bars = cut(bars.select(*POOL, "idx", "time", "close"), "account-bars")
    ident = [*account, *POOL, "entry_idx"]
    until = F.coalesce(F.col("exit_idx") - 1, F.lit(2**40))
    ends = bars.groupBy(*POOL).agg(F.max("idx").alias("_end"))
    held = t.join(ends, POOL).select(
        *ident, "entry_price", "quantity", "exit_time", F.least(until, F.col("_end")).alias("_until")
    ).where("_until >= entry_idx").withColumn("_xb", cover(F.col("entry_idx"), F.col("_until"), block))
    marks = held.join(bars.select(*POOL, "idx", "time", "close", block_of(F.col("idx"), block).alias("_xb")), [*POOL, "_xb"]).where(
        F.col("idx").between(F.col("entry_idx"), F.col("_until")))
    before = F.lag("close").over(Window.partitionBy(*ident).orderBy("idx"))  # one position's bars
    zero, quantity = F.lit(0.0), F.col("quantity")
    moves = marks.withColumn("_before", before).select(
        *account, "time", zero.alias("flow"), (quantity * (F.col("close") - F.coalesce("_before", zero))).alias("value"),
        (quantity * (F.col("close") - F.coalesce("_before", "entry_price"))).alias("unrealized"))
    last = F.max_by("close", "idx")
    sold = marks.where("exit_time is not null").groupBy(*ident, "exit_time", "quantity", "entry_price").agg(last.alias("_last")).select(
        *account, F.col("exit_time").alias("time"), zero.alias("flow"), (-quantity * F.col("_last")).alias("value"),
        (-quantity * (F.col("_last") - F.col("entry_price"))).alias("unrealized"))
    paid = t.select(*account, F.col("entry_time").alias("time"), (-F.col("amount") * (1 + buy_rate)).alias("flow"), zero.alias("value"), zero.alias("unrealized"))
    got = t.where("exit_time is not null").select(
        *account, F.col("exit_time").alias("time"), (quantity * F.col("exit_price") * (1 - sell_rate)).alias("flow"), zero.alias("value"), zero.alias("unrealized"))
    changes = moves.unionByName(sold).unionByName(paid).unionByName(got)
    if not account:
        changes = changes.unionByName(bars.select("time", zero.alias("flow"), zero.alias("value"), zero.alias("unrealized")))
    names = ["flow", "value", "unrealized"]
    grid = cut(changes.groupBy(*account, "time").agg(*[F.sum(n).alias(n) for n in names]).withColumn("_one", F.lit(1)), "account-changes")
    run = scan(grid, [*account, "_one"], ["time"], None, {f"_{n}": ("sum", F.col(n)) for n in names})
    cash = F.lit(float(capital)) + F.col("_flow")
    return run.select(*account, "time", cash.alias("cash"), (cash + F.col("_value")).alias("equity"), F.col("_unrealized").alias("unrealized"))


def account_drawdown(curve: DataFrame, capital: float, keys: Sequence[str] = ()) -> DataFrame:
    staged = curve.withColumn("_one", F.lit(1))
    return drawdown(staged, [*keys, "_one"], "equity", capital).drop("_one")


def report(trades: DataFrame, capital: float, keys: Sequence[str] = (), curve: DataFrame | None = None) -> DataFrame:
    """Scalar summary of closed trades. The longest losing run comes from a carried count of wins.

    With the account's ``curve`` the return counts open positions at their last price, and the report gains the final
    equity and the largest drawdown; without it the return is that of closed trades only.
    """
    account = [*keys, "_one"]
    closed = reuse(trades.where("exit_time is not null").withColumn("_one", F.lit(1)))
    net, win = F.col("net_pnl"), F.col("net_pnl") > 0
    order = ["exit_time", *POOL, "entry_idx"]
    islands = scan(closed, account, order, None, {"_wins": ("count", F.when(win, F.lit(1)))})
    streak = islands.groupBy(*account, "_wins").agg(F.count_if(~win).alias("n")).groupBy(*account).agg(F.max("n").alias("max_losing_streak"))
    gain, loss = F.sum(F.when(win, net).otherwise(0.0)), -F.sum(F.when(win, 0.0).otherwise(net))
    main = closed.groupBy(*account).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(win).alias("wins"), F.count_if(~win).alias("losses"),
        (F.count_if(win) / F.count(F.lit(1))).alias("win_rate"), F.sum("gross_pnl").alias("gross_pnl"), F.sum(net).alias("net_pnl"),
        (F.sum(net) / capital * 100).alias("return_percent"),
        F.when(loss > 0, gain / F.when(loss > 0, loss)).when(gain > 0, F.lit(float("inf"))).otherwise(0.0).alias("profit_factor"),
        F.avg("holding_bars").alias("average_holding_bars"))
    made = main.join(streak, account)
    if curve is not None:
        falls = account_drawdown(curve, capital, keys).groupBy(*keys).agg(F.max("drawdown_percent").alias("max_drawdown_percent"), F.max_by("equity", "time").alias("final_equity"))
        made = made.drop("return_percent").join(falls.withColumn("_one", F.lit(1)), account).withColumn("return_percent", (F.col("final_equity") / capital - 1) * 100)
    return made.drop("_one")


def by_pool(trades: DataFrame, pools: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    per = trades.where("exit_time is not null").groupBy(*keys, *POOL).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("net_pnl"), (F.count_if(F.col("net_pnl") > 0) / F.count(F.lit(1))).alias("win_rate"))
    return pools.select(*POOL).join(per, POOL, "left").na.fill(0, ["trades", "net_pnl", "win_rate"])


def open_positions(trades: DataFrame, bars: DataFrame, costs: Mapping = COSTS) -> DataFrame:
    """Trades without an exit, marked at the pool's last close; the future sale's costs are not deducted."""
    last = bars.groupBy(*POOL).agg(F.max(F.struct("time", "close")).alias("_l"))
    buy_rate = (costs["feePercent"] + costs["slippagePercent"] + costs["buyTaxPercent"]) / 100
    rows = trades.where("exit_time is null").join(last, POOL)
    fees = F.col("amount") * buy_rate
    price = F.col("_l.close")
    return rows.select(
        *POOL, "entry_idx", "quantity", price.alias("last_price"), fees.alias("fees"),
        ((price - F.col("entry_price")) * F.col("quantity") - fees).alias("net_pnl"), F.lit("risk_event").alias("event"), F.col("_l.time").alias("time"))
