"""Read-time analytics of run results: classification, numbering, association, statistics, curves, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.candles import finite
from barloom.plans.blocks import scan
from barloom.schemas import POOL, TOKEN
from barloom.session import cut

RUN_POOL = ["run_id", *POOL]
#: Rows of a pool that one task may sort, and rows that a task gets of several pools.
WHOLE, ROWS = 100_000, 250_000
# Exit kinds and event label prefixes.
NORMAL_EXITS = ["take_profit", "stop_loss", "profit_lock", "invalidation", "timeout"]
EXITS = [*NORMAL_EXITS, "end_of_backtest"]
BUY_LABEL, ADD_LABEL, SELL_LABEL = "买", "加", "卖"
DAY = 86_400_000


def classify_trade(trades: DataFrame) -> DataFrame:
    """``trade_class`` and ``exclusion``; a missing exit is open, a contradictory one is incomplete."""
    t = {c: F.col(c) for c in ("entry_time", "exit_time", "exit_price", "exit_reason", "net_pnl")}
    verdict = (
        F.when(t["exit_reason"] == "end_of_backtest", F.array(F.lit("end_of_backtest"), F.lit("forced end")))
        .when(t["exit_time"].isNull() & t["exit_price"].isNull() & t["exit_reason"].isNull(), F.array(F.lit("open"), F.lit("not closed")))
        .when(~F.coalesce(t["exit_reason"].isin(NORMAL_EXITS), F.lit(False)), F.array(F.lit("incomplete"), F.lit("exit reason")))
        .when(t["entry_time"].isNull() | t["exit_time"].isNull() | (t["exit_time"] < t["entry_time"]), F.array(F.lit("incomplete"), F.lit("times")))
        .when(~F.coalesce(finite(t["exit_price"]) & (t["exit_price"] > 0), F.lit(False)), F.array(F.lit("incomplete"), F.lit("exit price")))
        .when(~F.coalesce(finite(t["net_pnl"]), F.lit(False)), F.array(F.lit("incomplete"), F.lit("net pnl")))
        .otherwise(F.array(F.lit("normal_closed"), F.lit(None).cast("string")))
    )
    return trades.withColumn("_v", verdict).withColumn("trade_class", F.col("_v")[0]).withColumn("exclusion", F.col("_v")[1]).drop("_v")


def same(a: Column, b: Column) -> Column:
    """Equal within 1e-9 relative (absolute below 1)."""
    return F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def _crowding(*tables: DataFrame, whole: int) -> tuple[DataFrame | None, int]:
    """Pools of more than ``whole`` rows in all ``tables``, None if there are none, and the parts that all other pools are dealt to."""
    pools = [t.select(*RUN_POOL) for t in tables]
    counts = reduce(DataFrame.unionByName, pools).groupBy(*RUN_POOL).agg(F.count(F.lit(1)).alias("_rows"))
    over = F.col("_rows") > whole
    rows, crowded = counts.agg(F.sum("_rows"), F.count_if(over)).first()
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // ROWS))
    return cut(counts.where(over).drop("_rows"), "crowded-pools") if crowded else None, parts


def _number(trades: DataFrame) -> DataFrame:
    """Numbers of pools that a task holds. An entry time is unique where the first and the last place of its equals are one."""
    pool = Window.partitionBy(*reversed(TOKEN), "pair_id", "run_id").orderBy(F.asc_nulls_last("entry_time"))  # the token first: it parts most rows
    return trades.withColumns({"_n": F.count(F.lit(1)).over(pool), "_first": F.rank().over(pool)}).withColumn(
        "trade_no", F.coalesce(F.col("trade_no"), F.when(F.col("_first") == F.col("_n"), F.col("_n")))
    ).drop("_n", "_first")


def _number_crowded(trades: DataFrame) -> DataFrame:
    """The same for pools of any size: entry times with their counts go through ``scan``."""
    times = trades.groupBy(*RUN_POOL, "entry_time").agg(F.count(F.lit(1)).alias("_same"))
    placed = scan(times, RUN_POOL, [F.asc_nulls_last("entry_time")], None, {"_n": ("sum", F.col("_same"))}).where("_same = 1")
    met = [F.col(f"t.{c}") == F.col(f"n.{c}") for c in RUN_POOL] + [F.col("t.entry_time").eqNullSafe(F.col("n.entry_time"))]
    return trades.alias("t").join(placed.alias("n"), met, "left").select("t.*", "n._n").withColumn("trade_no", F.coalesce("trade_no", "_n")).drop("_n")


def number_trades(trades: DataFrame, whole: int = WHOLE) -> DataFrame:
    """Number per pool by entry time; only where the entry time is unique in the pool. A stored number stays.

    Pools of at most ``whole`` rows are shuffled once and numbered by windows.
    """
    crowded, parts = _crowding(trades, whole=whole)
    if crowded is None:
        return _number(trades.repartition(parts, *RUN_POOL))
    return _number(trades.join(crowded, RUN_POOL, "left_anti").repartition(parts, *RUN_POOL)).unionByName(
        _number_crowded(trades.join(crowded, RUN_POOL, "left_semi")))


def _single(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that point to exactly one trade."""
    return rows.groupBy(*key).agg(F.min("id").alias("trade_id"), F.min("id").eqNullSafe(F.max("id")).alias("_one")).where("_one").drop("_one")


def _places(numbered: DataFrame) -> DataFrame:
    """Where events may find a trade: its entry, by time alone, each add and its exit."""
    place = lambda time, kind, price, quantity, order: F.struct(
        time.cast("long").alias("time"), kind.alias("signal_type"), price.cast("double").alias("_price"), quantity.cast("double").alias("_quantity"), order.cast("int").alias("_order"))
    entry = place(F.col("entry_time"), F.lit("entry"), F.lit(0.0), F.lit(0.0), F.lit(1))
    adds = F.transform("adds", lambda a, i: place(a["time"], F.lit("add"), a["price"], a["quantity"], i + 2))
    out = place(F.col("exit_time"), F.col("exit_reason"), F.col("exit_price"), F.col("quantity"), F.size("adds") + 2)
    none = F.filter(F.array(entry), lambda _: F.lit(False))
    left = F.col("exit_time").isNotNull() & F.col("exit_reason").isin(EXITS)
    return numbered.select(*RUN_POOL, "id", F.col("trade_no").alias("_tno"), "trade_class", F.explode(
        F.concat(F.array(entry), F.coalesce(adds, none), F.when(left, F.array(out)).otherwise(none))).alias("_at")).select("*", "_at.*").drop("_at")


def _link(places: DataFrame, events: DataFrame) -> DataFrame:
    """Events with the trade of the places they meet: ``trade_id`` if that is one, ``_tno``, ``trade_class`` and ``event_order``.

    Both sides are hashed by the pool, or pool and time, and need no other shuffle. Places are reduced to distinct values and
    of equal events one meets them, so copies never form pairs; the others take over what it found.
    """
    at, values = ["time", *RUN_POOL, "signal_type"], ["_price", "_quantity"]  # time first: most rows then sort by one number
    taken = ["_tno", "trade_class", "_order"]
    offered = places.groupBy(*at, *values).agg(
        F.min("id").alias("_lo"), F.max("id").alias("_hi"), F.count(F.lit(1)).alias("_places"), *[F.min(c).alias(c) for c in taken])
    by_time = F.col("signal_type") == "entry"
    wanted = events.withColumns({f"_{c}": F.when(by_time, F.lit(0.0)).otherwise(F.col(c)) for c in ("price", "quantity")})
    wanted = wanted.withColumn("_copy", F.row_number().over(Window.partitionBy(*at, *values).orderBy("time")))
    on = [F.col(f"w.{c}") == F.col(f"o.{c}") for c in at] + [F.col("w._copy") == 1, *[same(F.col(f"w.{c}"), F.col(f"o.{c}")) for c in values]]
    met = wanted.alias("w").join(offered.alias("o"), on, "left").select("w.*", *[f"o.{c}" for c in ("_lo", "_hi", "_places", *taken)])
    equal = Window.partitionBy(*at, *values).orderBy("_copy")  # frames end with all rows of the same copy
    met = met.withColumns({
        "_lo": F.min("_lo").over(equal), "_hi": F.max("_hi").over(equal), "_places": F.sum("_places").over(equal),
        **{c: F.min(c).over(equal) for c in taken}, "_row": F.row_number().over(equal)}).where("_copy > 1 or _row = 1")
    one = F.col("_lo") == F.col("_hi")
    order = F.when((F.col("signal_type") != "add") | (F.col("_places") == 1), F.col("_order"))
    return met.withColumns({"trade_id": F.when(one, F.col("_lo")), "event_order": F.when(one, order), **{c: F.when(one, F.col(c)) for c in taken[:2]}}).drop(
        *values, "_copy", "_lo", "_hi", "_places", "_order", "_row")


def _link_numbers(numbered: DataFrame, events: DataFrame) -> DataFrame:
    """The same for events with a stored trade number."""
    by_no = _single(numbered.where("trade_no is not null"), [*RUN_POOL, "trade_no"])
    found = events.join(by_no, [*RUN_POOL, "trade_no"], "left").join(numbered.select(
        F.col("id").alias("trade_id"), F.col("trade_no").alias("_tno"), F.col("adds").alias("_list"), "trade_class"), "trade_id", "left")
    spot = F.filter(F.transform("_list", lambda a, i: F.when((a["time"] == F.col("time")) & same(a["price"], F.col("price")) & same(a["quantity"], F.col("quantity")), i)), lambda i: i.isNotNull())
    order = (
        F.when(F.col("signal_type") == "entry", F.lit(1)).when(F.col("signal_type").isin(EXITS), F.size("_list") + 2)
        .when((F.col("signal_type") == "add") & (F.size(spot) == 1), spot[0] + 2)
    )
    return found.withColumn("event_order", F.when(F.col("trade_id").isNotNull(), order)).drop("_list")


def associate_events(trades: DataFrame, events: DataFrame, number: bool = False, whole: int = WHOLE) -> DataFrame:
    """``trade_id``, ``trade_no``, ``trade_class``, ``event_order`` and label of each event; ambiguous matches stay null.

    ``number``: trades get their numbers first, as by ``number_trades``, in the same shuffle. Pools of at most ``whole`` trades
    and events are hashed by pool, the rows of larger ones by pool and time; nothing is kept, and trades and events are shuffled once.
    """
    crowded, parts = _crowding(trades, events, whole=whole)
    some = lambda table, how: table if crowded is None else table.join(crowded, RUN_POOL, how)
    loose = events.where("trade_no is null")
    numbered = some(trades, "left_anti").repartition(parts, *RUN_POOL)
    numbered = _number(numbered) if number else numbered
    linked = _link(_places(numbered), some(loose, "left_anti").repartition(parts, *RUN_POOL))
    if crowded is not None:
        rest = some(trades, "left_semi")
        rest, spread = _number_crowded(rest) if number else rest, [*RUN_POOL, "time"]
        linked = linked.unionByName(_link(_places(rest).repartition(parts, *spread), some(loose, "left_semi").repartition(parts, *spread)))
        numbered = numbered.unionByName(rest)
    linked = linked.unionByName(_link_numbers(numbered, events.where("trade_no is not null")))
    linked = linked.withColumn("trade_no", F.coalesce("trade_no", "_tno"))
    text = F.col("trade_no").cast("string")
    label = (
        F.when(F.col("signal_type") == "entry", F.concat(F.lit(BUY_LABEL), text))
        .when((F.col("signal_type") == "add") & F.col("event_order").isNotNull(), F.concat(F.lit(ADD_LABEL), text, F.lit("."), (F.col("event_order") - 1).cast("string")))
        .when(F.col("signal_type").isin(EXITS), F.concat(F.lit(SELL_LABEL), text))
    )
    return linked.withColumn("label", F.when(F.col("trade_no").isNotNull(), label)).drop("_tno")


def cost_basis(numbered: DataFrame, linked: DataFrame, costs_percent: float) -> DataFrame:
    """``cost_basis`` and ``net_return_percent``: stored parts if complete, else rebuilt from uniquely matched buys that reconcile."""
    buys = linked.where("trade_id is not null and signal_type in ('entry','add')").withColumnRenamed("trade_id", "id").groupBy(*RUN_POOL, "id").agg(
        F.count_if(F.col("signal_type") == "entry").alias("_firsts"), F.count(F.lit(1)).alias("_buys"),
        F.count_if(finite(F.col("price")) & finite(F.col("quantity"))).alias("_known"),
        F.sum(F.col("price") * F.col("quantity")).alias("_amount"), F.sum("quantity").alias("_qty"))
    t = numbered.join(buys, [*RUN_POOL, "id"], "left")  # a trade's events have its pool, and lie where it was hashed
    stored = ["buy_amount", "buy_fees", "buy_slippage_cost", "buy_tax_cost"]
    direct = sum((F.col(c) for c in stored[1:]), F.col(stored[0])) if set(stored) <= set(numbered.columns) else F.lit(None).cast("double")
    agrees = (
        (F.col("_firsts") == 1) & (F.col("_buys") == F.size("adds") + 1) & (F.col("_known") == F.col("_buys"))
        & same(F.col("_qty"), F.col("quantity")) & same(F.col("_amount"), F.col("entry_price") * F.col("quantity"))
    )
    basis = F.coalesce(direct, F.when(agrees, F.col("_amount") * (1 + costs_percent / 100)))
    return t.withColumn("cost_basis", basis).withColumn(
        "net_return_percent", F.when(F.col("cost_basis") > 0, F.col("net_pnl") / F.col("cost_basis") * 100)
    ).drop("_firsts", "_buys", "_known", "_amount", "_qty")


def select_whole_trades(trades: DataFrame, linked: DataFrame, types: Sequence[str] = (), include_end: bool = True) -> dict[str, DataFrame]:
    """Trades matching any filter with all their events, and the count of hidden unassociated events. ``linked``: the events of all ``trades``."""
    kept = trades if include_end else trades.where("trade_class = 'normal_closed'")
    if types:
        by_event = [t for t in types if t in ("entry", "add")]
        rule = F.col("exit_reason").isin([t for t in types if t in EXITS])
        causes = [t.split(":", 1)[1] for t in types if t.startswith("invalidation:")]
        if causes:
            rule = rule | ((F.col("exit_reason") == "invalidation") & F.coalesce(F.col("exit_cause"), F.lit("unknown")).isin(causes))
        if by_event:
            owners = linked.where(F.col("signal_type").isin(by_event) & F.col("trade_id").isNotNull()).select(*RUN_POOL, F.col("trade_id").alias("id")).distinct().withColumn("_own", F.lit(True))
            kept = kept.join(owners, [*RUN_POOL, "id"], "left")
            rule = F.coalesce(rule, F.lit(False)) | F.coalesce(F.col("_own"), F.lit(False))
        kept = kept.where(rule).drop("_own")
    free = linked.where("trade_id is null")
    if types:
        events = linked.join(kept.select(*RUN_POOL, F.col("id").alias("trade_id")), [*RUN_POOL, "trade_id"], "left_semi")
    else:  # the class of its trade stands at each event: no join, and one pass for owned and shown events
        owned = F.col("trade_id").isNotNull() & (F.lit(include_end) | F.coalesce(F.col("trade_class") == "normal_closed", F.lit(False)))
        shown = F.col("trade_id").isNull() & (F.lit(include_end) | F.coalesce(F.col("signal_type") == "risk_event", F.lit(False)))
        events = linked.where(owned | shown)
    hidden = free.where("signal_type <> 'risk_event'") if types or not include_end else free.limit(0)
    return {"trades": kept, "events": events, "hidden": hidden.agg(F.count(F.lit(1)).alias("hidden"))}


def whole(total: Column, missing: Column) -> Column:
    """A total that is null as soon as one part is missing."""
    return F.when(missing == 0, total)


def statistics(trades: DataFrame, keys: Sequence[str] = ("run_id",), capital: float = 10_000.0) -> DataFrame:
    closed = trades.where("exit_time is not null")
    missing = F.count_if(F.col("net_pnl").isNull())
    return closed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), missing.alias("missing_pnl"),
        F.round(whole(F.sum("net_pnl"), missing), 4).alias("net_pnl"),
        F.round(whole(F.count_if(F.col("net_pnl") > 0) / F.count(F.lit(1)), missing), 8).alias("win_rate"),
        F.round(whole(F.sum("net_pnl") / capital * 100, missing), 6).alias("return_percent"),
    )


def reason_table(trades: DataFrame, reason: Column, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    closed = trades.where("exit_time is not null").withColumn("reason", F.coalesce(reason, F.lit("unknown")))
    missing = F.count_if(F.col("net_pnl").isNull())
    per = closed.groupBy(*keys, "reason").agg(
        F.count(F.lit(1)).alias("count"), F.round(whole(F.sum("net_pnl"), missing), 4).alias("net_pnl"),
        F.round(whole(F.count_if(F.col("net_pnl") > 0) / F.count(F.lit(1)), missing), 8).alias("win_rate"))
    totals = per.groupBy(*keys).agg(F.sum("count").alias("_all"))
    return per.join(totals, list(keys)).withColumn("share", F.round(F.col("count") / F.col("_all"), 8)).drop("_all")


def event_counts(events: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return events.groupBy(*keys, "signal_type").agg(F.count(F.lit(1)).alias("count"))


def excluded_counts(trades: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    out = trades.where("trade_class <> 'normal_closed'")
    known = (F.col("trade_class") != "open") & F.col("exit_time").isNotNull() & finite(F.col("net_pnl"))
    return out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("excluded"), *[F.count_if(F.col("trade_class") == c).alias(f"{n}_count") for c, n in
        (("end_of_backtest", "end"), ("open", "open"), ("incomplete", "incomplete"))],
        F.round(F.coalesce(F.sum(F.when(known, F.col("net_pnl"))), F.lit(0.0)), 4).alias("net_pnl"), F.count_if(known).alias("known_pnl"))


def drawdown(curve: DataFrame, keys: Sequence[str], value: str, capital: float) -> DataFrame:
    """``peak`` (starting at the capital), ``drawdown`` and ``drawdown_percent`` along ``time``."""
    out = scan(curve, list(keys), ["time"], None, {"peak": ("max", F.greatest(F.lit(capital), F.col(value)))})
    fall = F.col("peak") - F.col(value)
    return out.withColumn("drawdown", fall).withColumn("drawdown_percent", F.when(F.col("peak") > 0, fall / F.col("peak") * 100).otherwise(0.0))


def realized_curve(trades: DataFrame, keys: Sequence[str] = ("run_id",), capital: float = 10_000.0) -> DataFrame:
    """Net per exit time (one point even for several exits), running balance, peak and drawdown."""
    steps = trades.where("exit_time is not null and net_pnl is not null").groupBy(*keys, F.col("exit_time").alias("time")).agg(F.sum("net_pnl").alias("net"))
    run = scan(steps, list(keys), ["time"], None, {"_sum": ("sum", F.col("net"))})
    return drawdown(run.withColumn("equity", F.lit(capital) + F.col("_sum")).drop("_sum"), keys, "equity", capital)


def result_rows(enriched: DataFrame, start: int, end: int, time: str = "entry_time") -> DataFrame:
    """Time filter after enrichment, so numbers do not change with the window."""
    return enriched.where(F.col(time).between(start, end))


def token_rollup(pools: DataFrame, trades: DataFrame, open_positions: DataFrame | None = None) -> DataFrame:
    """Pool list to token totals; tokens without trades stay, one missing PnL nulls the token's realized value."""
    per = trades.groupBy(*POOL).agg(
        F.count_if(F.col("exit_time").isNotNull()).alias("trades"), F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("exit_time").isNotNull() & F.col("net_pnl").isNull()).alias("missing"),
        F.sum("net_pnl").alias("realized"), F.sum(F.col("fees") + F.col("slippage_cost") + F.col("tax_cost")).alias("costs"))
    rows = pools.join(per, POOL, "left")
    if open_positions is not None:
        rows = rows.join(open_positions.select(*POOL, F.col("net_pnl").alias("_open")), POOL, "left")
    else:
        rows = rows.withColumn("_open", F.lit(0.0))
    missing = F.sum(F.coalesce("missing", F.lit(0)))
    return rows.groupBy(*TOKEN).agg(
        F.count(F.lit(1)).alias("pools"), F.count_if("no_data").alias("no_data_pools"),
        F.sum(F.coalesce("trades", F.lit(0))).alias("trades"), F.sum(F.coalesce("entries", F.lit(0))).alias("entries"),
        F.round(whole(F.sum(F.coalesce("realized", F.lit(0.0))), missing), 4).alias("realized_pnl"),
        F.round(F.sum(F.coalesce("_open", F.lit(0.0))), 4).alias("unrealized_pnl"), F.round(F.sum(F.coalesce("costs", F.lit(0.0))), 4).alias("costs"))


def rollup_summary(rollup: DataFrame) -> DataFrame:
    return rollup.agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("pools").alias("pools"), F.count_if(F.col("entries") > 0).alias("traded_tokens"),
        F.count_if(F.col("entries") == 0).alias("untraded_tokens"),
        F.round(whole(F.sum("realized_pnl"), F.count_if(F.col("realized_pnl").isNull())), 3).alias("realized_pnl"))


def _placed(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    ranked = scan(curve, list(keys), ["time"], None, {"rn": ("count", F.lit(1))})
    return ranked.join(curve.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")), list(keys))


def downsample_every(curve: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """First, last and every k-th point so that about ``n`` remain (a display report)."""
    step = F.greatest(F.lit(1), F.ceil(F.col("total") / n))
    rows = _placed(curve, keys)
    return rows.where((F.col("rn") == 1) | (F.col("rn") == F.col("total")) | ((F.col("rn") - 1) % step == 0)).drop("rn", "total")


def downsample_extrema(curve: DataFrame, keys: Sequence[str], buckets: int = 450, value: str = "equity") -> DataFrame:
    """Per bucket the first, last, lowest and highest point (a display report)."""
    rows = _placed(curve, keys)
    bucket = F.floor((F.col("rn") - 1) / F.greatest(F.lit(1), F.ceil(F.col("total") / buckets)))
    first, low, high = F.struct("time", value), F.struct(value, "time"), F.struct(value, (-F.col("time")).alias("time"))
    picked = rows.groupBy(*keys, bucket.alias("bucket")).agg(
        F.min(first).alias("a"), F.max(first).alias("b"), F.min(low).alias("c"), F.max(high).alias("d"))
    times = F.array_distinct(F.array("a.time", "b.time", "c.time", -F.col("d.time")))
    return picked.select(*keys, F.explode(times).alias("time")).join(curve, [*keys, "time"])


# Ratios always drawn.
STANDARD_RATIOS = [0.0, 0.382, 0.5, 0.618, 0.65, 0.786, 0.886, 1.0]


def ratio_uses(strategy: dict) -> dict[str, list]:
    """Configured ratios, zones and thresholds of a strategy, gathered from its rule trees and exits."""
    ratios, zones, thresholds = set(STANDARD_RATIOS), [], []

    def walk(node, name):
        if not node or node.get("enabled") is False:
            return
        for child in node.get("conditions", ()):
            walk(child, name)
        if node.get("type") == "fib_retracement":
            ratios.update((node["zoneLow"], node["zoneHigh"]))
            zones.append((name, node["zoneLow"], node["zoneHigh"]))
        elif node.get("type") == "break_fib_invalidation":
            ratios.add(node["ratio"])
            thresholds.append((f"{name} fib", node["ratio"], node.get("bufferPercent") or 0))
        elif node.get("type") == "break_swing_low_invalidation":
            thresholds.append((f"{name} low", 1.0, node.get("bufferPercent") or 0))

    walk(strategy["entry"], "entry")
    walk(strategy.get("invalidation"), "invalidation")
    stop, target = strategy["exits"]["stopLoss"], strategy["exits"]["takeProfit"]
    if stop["type"] == "fib_level":
        ratios.add(stop["ratio"])
    if stop["type"] in ("fib_level", "swing_low"):
        thresholds.append(("stop", stop.get("ratio", 1.0), stop.get("bufferPercent") or 0))
    if target["type"] == "fib_target":
        ratios.add(target["ratio"])
    return {"ratios": sorted(ratios), "zones": zones, "thresholds": thresholds}


def fib_levels(swings: DataFrame, strategy: dict) -> DataFrame:
    """One row per level, zone bound pair or threshold of each swing (columns ``low`` and ``high``)."""
    uses = ratio_uses(strategy)
    at = lambda r: F.col("high") - (F.col("high") - F.col("low")) * r
    row = lambda kind, name, ratio, value, upper=None: F.struct(
        F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(float(ratio)).alias("ratio"), value.alias("value"),
        (upper if upper is not None else F.lit(None).cast("double")).alias("upper"))
    rows = [row("level", "", r, at(r)) for r in uses["ratios"]]
    rows += [row("zone", n, lo, at(hi), at(lo)) for n, lo, hi in uses["zones"]]
    rows += [row("threshold", n, r, at(r) * (1 - b / 100)) for n, r, b in uses["thresholds"]]
    return swings.withColumn("_l", F.explode(F.array(*rows))).select(*swings.columns, "_l.*")


def fib_audit(entries: DataFrame, filled: DataFrame) -> DataFrame:
    """``status`` of each entry's swing anchors, rebuilt from the bars by index and checked for order and value."""
    points = filled.select(*POOL, "idx", "time", "low", "high", "synthetic")
    out = entries
    for name in ("low", "high", "confirmed"):
        at = points.select(*POOL, F.col("idx").alias(f"{name}_idx"), F.col("time").alias(f"{name}_time"),
                           *([F.col(name).alias(f"_{name}")] if name != "confirmed" else []))
        out = out.join(at, [*POOL, f"{name}_idx"], "left")
    close = lambda a, b: F.abs(a - b) <= 1e-10 * F.greatest(F.abs(a), F.abs(b), F.lit(4.9e-324))
    status = (
        F.when(F.col("s_low").isNull() | (F.col("s_low") <= 0) | (F.col("s_high") <= F.col("s_low")), "no valid swing")
        .when((F.col("low_idx") < 0) | (F.col("low_idx") >= F.col("high_idx")) | (F.col("confirmed_idx") < F.col("high_idx")), "index order")
        .when(F.coalesce(
            close(F.col("_low"), F.col("s_low")) & close(F.col("_high"), F.col("s_high")) & (F.col("low_time") < F.col("high_time"))
            & (F.col("high_time") <= F.col("confirmed_time")) & (F.col("confirmed_time") <= F.col("entry_time")), F.lit(False)), "available")
        .otherwise("value or confirmation check")
    )
    return out.withColumn("status", status).withColumn("buy_ratio", (F.col("s_high") - F.col("entry_price")) / (F.col("s_high") - F.col("s_low"))).drop("_low", "_high")


def markers(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Events with ``loaded``: their time has a bar."""
    have = bars.select(*POOL, "time").distinct().withColumn("_b", F.lit(True))
    return events.join(have, [*POOL, "time"], "left").withColumn("loaded", F.coalesce("_b", F.lit(False))).drop("_b")


def signal_buckets(signals: DataFrame, bars: DataFrame, step: int) -> DataFrame:
    """External signals per bar: count and whether one of them is the token's first."""
    placed = signals.withColumn("time", F.floor(F.col("signal_time") / step) * step)
    per = placed.groupBy(*TOKEN, "time").agg(F.count(F.lit(1)).alias("signals"), F.max("first").alias("first"))
    return bars.select(*POOL, "time").join(per, [*TOKEN, "time"])


def run_counts(runs: DataFrame, keys: Sequence[str], state: str) -> DataFrame:
    return runs.groupBy(*keys, state).agg(F.count(F.lit(1)).alias("count"))


def bars_to_arrays(bars: DataFrame, count_back: int) -> DataFrame:
    """The latest ``count_back`` bars of one pool as column arrays in seconds (a chart payload)."""
    latest = bars.orderBy(F.desc("time")).limit(count_back)
    rows = F.sort_array(F.collect_list(F.struct("time", "open", "high", "low", "close", "volume")))
    packed = latest.agg(rows.alias("r"))
    names = {"t": "time", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
    return packed.select(*[F.transform("r", _pick(c)).alias(n) for n, c in names.items()])


def _pick(name: str):
    return lambda x: (x[name] / 1000).cast("long") if name == "time" else x[name]


def watch_list(watches: DataFrame, search: str | None = None, source: str | None = None, order: str = "market_cap") -> DataFrame:
    out = watches.where("active")
    if search:
        out = out.where(F.lower("ca").contains(search.lower()) | F.lower("name").contains(search.lower()))
    if source:
        out = out.where(F.col("source") == source)
    return out.orderBy(F.desc_nulls_last(order), "chain", "ca")


def metric_alerts(samples: DataFrame, now: Column) -> DataFrame:
    """Alerts from the latest sample of each source: ``source, sampled_at, metrics map<string,double>``."""
    latest = samples.groupBy("source").agg(F.max("sampled_at").alias("sampled_at"), F.max_by("metrics", "sampled_at").alias("metrics"))
    stale = latest.where(now - F.col("sampled_at") > 180_000).select(F.concat("source", F.lit(":stale")).alias("key"), F.lit("error").alias("level"))
    entry = latest.select("source", F.explode("metrics").alias("name", "value"))
    usage = entry.where(F.col("name").isin("diskPercent", "inodePercent") & (F.col("value") >= 85)).select(
        F.concat_ws(":", "source", "name").alias("key"), F.when(F.col("value") >= 95, "error").otherwise("warning").alias("level"))
    pressure = entry.where("name = 'resourcePressure' and value >= 3").select(F.concat("source", F.lit(":pressure")).alias("key"), F.lit("warning").alias("level"))
    broken = entry.where((F.col("name") == "disconnectedAt") & (F.col("value") > 0) & (now - F.col("value") > 60_000)).select(
        F.concat("source", F.lit(":disconnected")).alias("key"), F.lit("error").alias("level"))
    return stale.unionByName(usage).unionByName(pressure).unionByName(broken)


def metric_history(samples: DataFrame, start: Column, end: Column, now: Column) -> DataFrame:
    """Samples in range within the seven days of retention."""
    return samples.where(F.col("sampled_at").between(start, end) & (F.col("sampled_at") >= now - 7 * DAY))
