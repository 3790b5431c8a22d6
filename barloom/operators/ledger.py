"""Order and fill ledgers: position cycles, valuation, audits and comparison with a replay."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping
from decimal import Decimal
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from barloom.functions.candles import finite
from barloom.functions.levels import stop_level, target_level
from barloom.plans.blocks import BLOCK, asof, block_of, scan
from barloom.schemas import POOL, TOKEN
from barloom.session import cut, reuse

# Reasons decided from the bar that just closed, and the quantity tolerance.
CLOSE_REASONS = ["entry", "add", "invalidation", "timeout"]
TINY = Decimal("1e-9")
# Quantities are walked as decimals: their sums are exact in any order, so blocks of any size agree.
QUANTITY = "decimal(38,12)"
NOTHING = Decimal(0)
ORDER = ["fill_time", "decision_time", "id"]


def decision_bucket(time: Column, reason: Column, step: int) -> Column:
    """Bar a decision belongs to; close-time decisions belong to the bar that just closed."""
    return F.floor((time - reason.isin(CLOSE_REASONS).cast("int")) / step) * step


def usable_fill() -> Column:
    positive = lambda c: finite(F.col(c)) & (F.col(c) > 0)
    cost = lambda c: finite(F.col(c)) & (F.col(c) >= 0)
    rule = positive("quantity") & positive("gross_amount") & F.col("fill_time").isNotNull() & positive("fill_value")
    return F.coalesce(rule & cost("fee") & cost("slippage_cost") & cost("tax_cost"), F.lit(False))


def step_holding(held: Decimal, quantity: Decimal, buy: bool) -> tuple[Decimal, str]:
    """One fill applied to a holding. A sell beyond the holding contradicts it and leaves the token flat."""
    if buy:
        return held + quantity, "open" if held == 0 else "add"
    if quantity > held + TINY or held == 0:
        return NOTHING, "contradiction" if held > 0 else "orphan"
    left = held - quantity
    return (NOTHING, "close") if left <= TINY else (left, "partial")


def step_cycle(held: Decimal, cycle: str | None, quantity: Decimal, buy: bool, fill: str, position: str | None) -> tuple[Decimal, str | None, str, bool]:
    """One fill applied to a holding and the id of its open cycle: both after it, the kind, and whether a buy broke the cycle.

    A cycle is named by the ``position_id`` of the fill that opens it, without one by the fill's own id. A fill that names
    another cycle contradicts the open one: a sell ends both, a buy opens its own.
    """
    clash = held > 0 and position is not None and position != cycle
    if clash and not buy:
        return NOTHING, None, "contradiction", False
    after, kind = step_holding(NOTHING if clash else held, quantity, buy)
    if kind == "open":
        cycle = position or fill
    return after, cycle if after > 0 else None, kind, clash


def _summarize(rows: list[tuple], first: str | None) -> list[tuple]:
    """How a block of fills maps an unknown incoming holding: pieces ``(up to, held, cycle, shift)`` by rising bound.

    ``rows`` are (quantity, buy, fill, position); ``first`` is the position that the incoming cycle is taken to carry, None if
    it carries none that the block names. A holding up to a bound ends flat at some sell, after which the outcome no longer
    depends on what came in; above the last bound (None) it survives, shifted (held None), or a fill of another cycle ends it.
    """
    pieces: list[list] = [[NOTHING, NOTHING, None]]
    rest, shift, alive = None, NOTHING, True
    for quantity, buy, fill, position in rows:
        for piece in pieces:
            piece[1:] = step_cycle(piece[1], piece[2], quantity, buy, fill, position)[:2]
        if not alive:
            rest = step_cycle(*rest, quantity, buy, fill, position)[:2]
        elif position is not None and position != first:
            alive, rest = False, (quantity, position) if buy else (NOTHING, None)
        elif buy:
            shift += quantity
        else:
            bound = quantity - shift + TINY
            if bound > pieces[-1][0]:
                pieces.append([bound, NOTHING, None])
            shift -= quantity
        merged: list[list] = []
        for piece in pieces:
            if merged and merged[-1][1:] == piece[1:]:
                merged[-1][0] = piece[0]
            else:
                merged.append(piece)
        pieces = merged
    last = (None, None, None, shift) if alive else (None, *rest, NOTHING)
    return [*((up, held, cycle, NOTHING) for up, held, cycle in pieces), last]


def _apply(pieces, held: Decimal, cycle: str | None) -> tuple[Decimal, str | None]:
    for up, value, name, shift in pieces:
        if up is None or held <= up:
            return (held + shift, cycle) if value is None else (value, name)
    raise ValueError("the last piece has no bound")


def _steps(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Key, decimal quantity, side, own id and position of each fill, then the columns ``names``."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in (*TOKEN, "blk", "_quantity", "side", "_fill", "_position", *names)))


def _walk(staged: DataFrame) -> DataFrame:
    """Fills sorted by token and place, walked block by block from ``_start`` and ``_cycle`` (null: flat).

    Adds ``held_before``, ``kind`` and ``broke``; the number of cycles opened in the block up to here; and how a cost ``x`` at
    the block's start has become ``_a x + _b``: a buy adds what it cost, a partial sale keeps a share.
    """
    kept = [f for f in staged.schema.fields if f.name not in ("_quantity", "_fill", "_position", "_start", "_cycle", "_paid")]
    added = {"held_before": pa.float64(), "kind": pa.string(), "broke": pa.bool_(), "_opened": pa.int64(), "_a": pa.float64(), "_b": pa.float64()}
    types = StructType(list(kept))
    for name, kind in (("held_before", "double"), ("kind", "string"), ("broke", "boolean"), ("_opened", "long"), ("_a", "double"), ("_b", "double")):
        types = types.add(name, kind)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held = cycle = opened = a = b = None
        for batch in batches:
            out = []
            for chain, ca, blk, quantity, side, fill, name, start, running, paid, size in _steps([batch], "_start", "_cycle", "_paid", "quantity"):
                if at != (chain, ca, blk):
                    at, held, cycle, opened, a, b = (chain, ca, blk), NOTHING if start is None else start, running, 0, 1.0, 0.0
                before = held
                held, cycle, kind, broke = step_cycle(held, cycle, quantity, side == "buy", fill, name)
                before = 0.0 if broke else float(before)
                if kind == "open":
                    opened, a, b = opened + 1, 0.0, paid
                elif kind == "add":
                    b += paid
                elif kind == "partial":
                    share = 1 - float(size) / before
                    a, b = a * share, b * share
                elif kind == "close":
                    a = b = 0.0
                out.append((before, kind, broke, opened, a, b))
            if out:
                columns = [batch.column(f.name) for f in kept] + [pa.array(v, t) for v, t in zip(zip(*out), added.values())]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + list(added))

    return staged.mapInArrow(walk, types)


def holdings(fills: DataFrame, block: int = BLOCK) -> DataFrame:
    """``held_before``, ``kind`` (open, add, partial, close, contradiction, orphan), ``broke`` and ``rn`` of each usable fill,
    its cycle's number ``trade_no`` (0 before the first) and what the holding after it has cost, ``left_cost``.

    A token's fills depend on each other. Tokens of at most ``block`` fills are sorted and walked in one pass. Fills of the
    others are numbered and cut into blocks of ``block`` fills, whatever their times. Each block is summarised for any
    incoming holding, twice: for a cycle of the first position it names, and for any other. The summaries are folded per
    token (one row per block), every block is walked once from its known start, and the numbers and costs of the blocks
    before are added. Passes stream over sorted rows, so that many small tokens cost no call each; the folds are written,
    so that no join waits for Python.
    """
    spark = fills.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = [*TOKEN, "blk"]
    position = F.nullif(F.col("position_id").cast("string"), F.lit("")) if "position_id" in fills.columns else F.lit(None).cast("string")
    usable = fills.where(usable_fill())
    large = cut(usable.groupBy(*TOKEN).count().where(F.col("count") > block).select(*TOKEN), "large-tokens")

    def steps(rows: DataFrame) -> DataFrame:
        return rows.withColumns({
            "_quantity": F.col("quantity").cast(QUANTITY), "_fill": F.col("id").cast("string"), "_position": position,
            "_paid": F.col("gross_amount") + (F.col("fee") + F.col("slippage_cost") + F.col("tax_cost"))})

    def in_order(df: DataFrame, keys: list[str], place: str) -> DataFrame:
        return df.repartition(parts, *keys).sortWithinPartitions(*TOKEN, place)

    place = F.row_number().over(Window.partitionBy(*TOKEN).orderBy(*ORDER)).cast("long") - 1
    small = usable.join(large, TOKEN, "left_anti").withColumn("rn", place).withColumn("blk", F.lit(0).cast("long"))
    small = steps(small).withColumns({"_start": F.lit(None).cast(QUANTITY), "_cycle": F.lit(None).cast("string")})
    small = _walk(small.sortWithinPartitions(*TOKEN, *ORDER)).withColumns({"trade_no": F.col("_opened"), "left_cost": F.col("_b")})

    rows = scan(usable.join(large, TOKEN, "left_semi"), TOKEN, ORDER, None, {"rn": ("count", F.lit(1))}).withColumn("rn", F.col("rn") - 1)
    rows = steps(reuse(rows.withColumn("blk", block_of(F.col("rn"), block))))

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, texts = pa.list_(pa.decimal128(38, 12)), pa.list_(pa.string())
        for (chain, ca, blk), run in groupby(_steps(batches), key=itemgetter(0, 1, 2)):
            run = [(quantity, side == "buy", fill, name) for *_, quantity, side, fill, name in run]
            first = next((r[3] for r in run if r[3] is not None), None)
            out = {"chain": pa.array([chain], pa.string()), "ca": pa.array([ca], pa.string()), "blk": pa.array([blk], pa.int64()), "first": pa.array([first], pa.string())}
            for side, carried in (("same", first), ("other", None)):
                pieces = _summarize(run, carried)
                out |= {f"{side}_{n}": pa.array([[p[k] for p in pieces]], texts if n == "cycle" else numbers) for k, n in enumerate(("up", "held", "cycle", "shift"))}
            yield pa.RecordBatch.from_pydict(out)

    def fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = held = cycle = None
        for pdf in pdfs:
            out = []
            for row in pdf.to_dict("records"):
                if token != (row["chain"], row["ca"]):
                    token, held, cycle = (row["chain"], row["ca"]), NOTHING, None
                out.append((*token, row["blk"], held, cycle))
                side = "same" if cycle is not None and cycle == row["first"] else "other"
                held, cycle = _apply(zip(*(row[f"{side}_{n}"] for n in ("up", "held", "cycle", "shift"))), held, cycle)
            yield pd.DataFrame(out, columns=[*key, "_start", "_cycle"])

    def carry(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = opened = left = None
        for pdf in pdfs:
            out = []
            for chain, ca, blk, more, a, b in pdf.itertuples(index=False):
                if token != (chain, ca):
                    token, opened, left = (chain, ca), 0, 0.0
                out.append((chain, ca, blk, opened, left))
                opened, left = opened + more, a * left + b
            yield pd.DataFrame(out, columns=[*key, "_before", "_left"])

    schema = "chain string, ca string, blk long"
    lists = ", ".join(f"{s}_up array<{QUANTITY}>, {s}_held array<{QUANTITY}>, {s}_cycle array<string>, {s}_shift array<{QUANTITY}>" for s in ("same", "other"))
    slim = rows.select(*key, "rn", "_quantity", "side", "_fill", "_position")
    pieces = in_order(slim, key, "rn").mapInArrow(summarize, f"{schema}, first string, {lists}")
    starts = cut(in_order(pieces, TOKEN, "blk").mapInPandas(fold, f"{schema}, _start {QUANTITY}, _cycle string"), "holding-starts")
    walked = _walk(in_order(rows.join(starts, key), key, "rn"))
    ends = walked.groupBy(*key).agg(F.max_by(F.struct("_opened", "_a", "_b"), "rn").alias("_end")).select(*key, "_end.*")
    before = cut(in_order(ends, TOKEN, "blk").mapInPandas(carry, f"{schema}, _before long, _left double"), "holding-costs")
    walked = walked.join(before, key).withColumns({"trade_no": F.col("_before") + F.col("_opened"), "left_cost": F.col("_a") * F.col("_left") + F.col("_b")})
    return small.unionByName(walked.drop("_before", "_left")).drop("blk", "_opened", "_a", "_b")


def position_cycles(fills: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per cycle from flat to flat (or to a contradiction, which makes it incomplete)."""
    sold = F.col("kind").isin("partial", "close")
    bought = F.col("kind").isin("open", "add")
    read = [*TOKEN, *ORDER, "position_id", "side", "reason", "quantity", "gross_amount", "fill_value", "market_cap", "fee", "slippage_cost", "tax_cost"]
    staged = holdings(fills.select(*[c for c in read if c in fills.columns]), block)
    staged = staged.where("trade_no > 0").withColumn("_cost", F.col("fee") + F.col("slippage_cost") + F.col("tax_cost"))
    cycle = [*TOKEN, "trade_no"]
    last_sale = F.max(F.when(sold, F.struct(*ORDER, F.col("reason").alias("reason"), F.col("fill_value").alias("value"))))
    buy = lambda c: F.sum(F.when(bought, c))
    totals = reuse(staged.groupBy(*cycle).agg(
        F.min(F.when(F.col("kind") == "open", F.col("fill_time"))).alias("buy_time"),
        buy(F.col("gross_amount")).alias("buy_amount"), buy(F.col("_cost")).alias("buy_cost"), buy(F.col("quantity")).alias("buy_quantity"),
        (buy(F.col("fill_value") * F.col("quantity")) / buy(F.col("quantity"))).alias("buy_value"),
        F.when(F.count_if(bought & ~F.coalesce(finite(F.col("market_cap")), F.lit(False))) == 0,
               buy(F.col("market_cap") * F.col("quantity")) / buy(F.col("quantity"))).alias("buy_market_cap"),
        F.count_if(bought).alias("entry_count"), F.count_if(sold | bought).alias("orders"),
        F.coalesce(F.sum(F.when(sold, F.col("gross_amount") - F.col("_cost"))), F.lit(0.0)).alias("sell_amount"),
        F.coalesce(F.sum(F.when(sold, F.col("quantity"))), F.lit(0.0)).alias("sell_quantity"),
        last_sale.alias("_sale"), F.max(F.col("kind") == "close").alias("_closed"), F.max(F.col("kind") == "contradiction").alias("_bad"),
        F.max_by("left_cost", "rn").alias("remaining_cost"), F.max("broke").alias("_broke"),
    ))
    # A buy that replaces a running position opens a cycle and marks the one before it as incomplete.
    broken = totals.where("_broke").select(*TOKEN, (F.col("trade_no") - 1).alias("trade_no"), F.lit(True).alias("_broken"))
    totals = totals.join(broken, cycle, "left")
    closed = F.col("_closed")
    return totals.select(
        *cycle, "buy_time", "buy_amount", "buy_cost", "buy_quantity", "buy_value", "buy_market_cap", "entry_count", "orders",
        F.col("_sale.fill_time").alias("sell_time"), F.col("_sale.reason").alias("sell_reason"), F.col("_sale.value").alias("sell_value"),
        "sell_amount", "sell_quantity", F.when(closed, F.lit(0.0)).otherwise(F.col("buy_quantity") - F.col("sell_quantity")).alias("quantity"), "remaining_cost",
        (F.col("sell_amount") - (F.col("buy_amount") + F.col("buy_cost") - F.col("remaining_cost"))).alias("realized_pnl"),
        F.when(closed, "closed").when(F.col("_bad") | F.coalesce("_broken", F.lit(False)), "incomplete").otherwise("open").alias("status"),
    )


def ledger_problems(fills: DataFrame, block: int = BLOCK) -> DataFrame:
    """Count of contradicting and unusable fills."""
    walked = holdings(fills, block).agg(F.count_if(F.col("kind").isin("contradiction", "orphan") | F.col("broke")).alias("contradictions"))
    return walked.crossJoin(fills.agg(F.count_if(~usable_fill()).alias("unusable")))


def value_open(cycles: DataFrame, quotes: DataFrame, now: Column, max_age: int, exits: Mapping, sell_cost_percent: float) -> DataFrame:
    """Mark open cycles with a fresh quote whose quantity agrees; stale or missing quotes leave the value null."""
    q = cycles.where("status = 'open'").join(quotes, TOKEN, "left")
    agrees = F.coalesce(F.abs(F.col("position_quantity") - F.col("quantity")) <= F.greatest(F.lit(1e-8), F.col("quantity") * 0.001), F.lit(False))
    age = now - F.col("last_trade_at")
    fresh = agrees & age.between(0, max_age) & finite(F.col("last_price")) & (F.col("last_price") > 0)
    entry = F.col("position_entry")
    low, high = F.col("swing_low"), F.col("swing_high")
    stop = stop_level(exits["stopLoss"], entry, low, high)
    target = target_level(exits["takeProfit"], entry, stop, low, high)
    return q.withColumn("status", F.when(agrees, "open").otherwise("incomplete")).withColumn(
        "unrealized_pnl", F.when(fresh, F.col("quantity") * F.col("last_price") * (1 - sell_cost_percent / 100) - F.col("remaining_cost"))
    ).withColumn("valuation_time", F.when(fresh, F.col("last_trade_at"))).withColumn(
        "stop_value", F.when(agrees, F.greatest(stop, F.col("lock_price")))).withColumn("target_value", F.when(agrees & (target > entry), target))


def portfolio_summary(cycles: DataFrame, valued: DataFrame) -> DataFrame:
    opened = valued.where("status = 'open'").agg(
        F.count(F.lit(1)).alias("open_count"), F.sum("remaining_cost").alias("open_cost"), F.count_if(F.col("unrealized_pnl").isNull()).alias("unpriced_count"),
        F.when(F.count_if(F.col("unrealized_pnl").isNull()) == 0, F.sum("unrealized_pnl")).alias("unrealized_pnl"))
    closed = cycles.where("status = 'closed'").agg(
        F.count(F.lit(1)).alias("closed_count"), F.sum("realized_pnl").alias("realized_pnl"),
        (F.count_if(F.col("realized_pnl") > 0) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100).alias("win_rate"))
    return opened.crossJoin(closed)  # two one-row aggregates


def audit_orders(orders: DataFrame, gates: DataFrame, step: int) -> DataFrame:
    """One row per problem: fill before decision, buy bar not strictly after the signal, non-positive values."""
    rows = orders.join(gates.select(*TOKEN, "signal_time"), TOKEN, "left")
    early = ~F.coalesce(F.col("fill_time") >= F.col("decision_time"), F.lit(False))
    gate = (F.col("side") == "buy") & (F.floor((F.col("decision_time") - 1) / step) * step <= F.col("signal_time"))
    values = ~F.coalesce((F.col("fill_value") > 0) & (F.col("fill_price") > 0) & (F.col("quantity") > 0), F.lit(False))
    issues = F.array(F.when(early, "fill before decision"), F.when(gate, "buy not after signal"), F.when(values, "invalid values"))
    return rows.select("id", F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("issue"))


def bought_pools(buys: DataFrame, events: DataFrame, watches: DataFrame) -> DataFrame:
    """Gate per bought token: the watch's own signal if it was known by then, else the latest signal at or before the first buy's decision."""
    first = buys.groupBy(*TOKEN).agg(F.min("decision_time").alias("decision_time"))
    gated = asof(first, events, TOKEN, "decision_time", "event_time", ["event_id", "event_time"], tie=["event_id"])
    own = watches.select(*TOKEN, F.col("signal_time").alias("event_time")).join(events, [*TOKEN, "event_time"]).groupBy(*TOKEN, "event_time").agg(
        F.min("event_id").alias("_own")).withColumnRenamed("event_time", "_own_time")
    usable = F.col("_own_time") <= F.col("decision_time")
    return gated.join(own, TOKEN, "left").select(
        *TOKEN, "decision_time", F.when(usable, F.col("_own")).otherwise(F.col("event_id")).alias("event_id"),
        F.when(usable, F.col("_own_time")).otherwise(F.col("event_time")).alias("signal_time"))


def compare_ledgers(live: DataFrame, replay: DataFrame, step: int) -> DataFrame:
    """Each live cycle takes the nearest unused replay trade of its pool, in buy order; leftovers follow.

    Greedy matching is sequential within a pool, so the ledgers of one pool meet in one function call, with two
    sorted lists and a binary search; candles never take part.
    """
    kinds = {n: df.schema[n].dataType.simpleString() for df, n in ((live, "cycle_id"), (replay, "trade_id"))}

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["entry_time", "trade_id"])
        times, ids = right["entry_time"].tolist(), right["trade_id"].tolist()
        out = []
        for cycle, bucket in left.sort_values(["buy_time", "cycle_id"])[["cycle_id", "bucket"]].itertuples(index=False):
            if not times:
                out.append((cycle, None))
                continue
            at = bisect.bisect_left(times, bucket)
            at = bisect.bisect_left(times, times[at - 1]) if at and (at == len(times) or bucket - times[at - 1] <= times[at] - bucket) else at
            times.pop(at)
            out.append((cycle, ids.pop(at)))
        out += [(None, trade) for trade in ids]
        made = pd.DataFrame(out, columns=["cycle_id", "trade_id"], dtype="object")
        return made.astype({n: "Int64" for n, t in kinds.items() if t == "bigint"})

    l = live.withColumn("bucket", (F.floor((F.col("buy_decision") - 1) / step) * step).cast("long"))
    pairs = l.select(*POOL, "cycle_id", "buy_time", "bucket").groupBy(*POOL).cogroup(
        replay.select(*POOL, "trade_id", "entry_time").groupBy(*POOL)).applyInPandas(match, ", ".join(f"{n} {t}" for n, t in kinds.items()))
    a = l.select("cycle_id", "bucket", "sell_decision", F.col("exit_reason").alias("live_reason"), F.col("net_pnl").alias("live_net"))
    b = replay.select("trade_id", "entry_time", "exit_time", F.col("exit_reason").alias("replay_reason"), F.col("net_pnl").alias("replay_net"))
    joined = pairs.join(a, "cycle_id", "left").join(b, "trade_id", "left")
    delta = F.round((F.col("entry_time") - F.col("bucket")) / step).cast("long")
    status = (
        F.when(F.col("cycle_id").isNull(), "replay_only").when(F.col("trade_id").isNull(), "not_in_replay")
        .when((F.abs(delta) <= 1) & F.col("live_reason").eqNullSafe(F.col("replay_reason")), "matched")
        .when(F.col("replay_reason") == "end_of_backtest", "explainable").otherwise("suspect")
    )
    return joined.select(
        "cycle_id", "trade_id", status.alias("status"), delta.alias("entry_delta_bars"),
        F.round((F.col("exit_time") - F.floor(F.col("sell_decision") / step) * step) / step).cast("long").alias("exit_delta_bars"),
        (F.col("live_net") - F.col("replay_net")).alias("pnl_delta"))


def order_flow_totals(orders: DataFrame, keys: list[str]) -> DataFrame:
    filled = F.col("status") == "filled"
    return orders.groupBy(*keys).agg(
        F.count_if(filled & (F.col("side") == "buy")).alias("buys"), F.count_if(filled & (F.col("side") == "sell")).alias("sells"),
        F.count_if(F.col("status").isin("submitted", "unknown")).alias("unverified"),
        F.round(F.sum(F.when(filled & (F.col("side") == "buy"), F.col("gross_amount") + F.col("fee") + F.col("slippage_cost") + F.col("tax_cost")).otherwise(0.0)), 4).alias("spent"))


def order_markers(orders: DataFrame, step: int) -> DataFrame:
    """Chart time and kind of each order: the fill's bar if filled, else the decision's bar."""
    filled = F.col("fill_time").isNotNull()
    bucket = F.when(filled, F.floor(F.col("fill_time") / step) * step).otherwise(decision_bucket(F.col("decision_time"), F.col("reason"), step))
    kind = F.when(~filled, "decision").when(F.col("side") == "sell", F.col("reason")).when(F.col("reason") == "add", "add").otherwise("entry")
    return orders.select("id", *POOL, bucket.alias("time"), F.coalesce("fill_time", "decision_time").alias("actual_time"), kind.alias("kind"))


def cycle_labels(filled: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cycle and add numbers of filled orders that carry a ``position_id`` (per token, in fill order).

    Tokens of at most ``block`` orders are shuffled once and numbered by windows; those of larger ones by sorted ranges.
    """
    key = [*TOKEN, "position_id"]
    filled = filled.dropna(subset=key)
    large = cut(filled.groupBy(*TOKEN).count().where(F.col("count") > block).select(*TOKEN), "large-tokens")
    bought, at = F.col("side") == "buy", F.struct(*ORDER)
    added = F.when(bought & (F.col("reason") == "add"), F.lit(1))

    position = Window.partitionBy(*key).orderBy(*ORDER)
    small = filled.join(large, TOKEN, "left_anti").repartition(*TOKEN).withColumns({
        "_first": F.min(F.when(bought, at)).over(position.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "_adds": F.count(added).over(position.rowsBetween(Window.unboundedPreceding, Window.currentRow))}).where(at >= F.col("_first"))
    small = small.withColumn("cycle_no", F.dense_rank().over(Window.partitionBy(*TOKEN).orderBy("_first", "position_id")).cast("long")).drop("_first")

    rest = filled.join(large, TOKEN, "left_semi")
    firsts = rest.where(bought).groupBy(*key).agg(F.min(at).alias("f")).select(*key, "f.*")
    numbered = scan(firsts, TOKEN, ORDER, None, {"cycle_no": ("count", F.lit(1))}).select(*key, "cycle_no", at.alias("_first"))
    rows = rest.join(numbered, key).where(at >= F.col("_first"))
    counted = small.unionByName(scan(rows.drop("_first"), key, ORDER, None, {"_adds": ("count", added)}))
    label = F.when(added.isNotNull(), F.concat(F.lit("加"), F.col("cycle_no").cast("string"), F.lit("."), F.col("_adds").cast("string"))).otherwise(
        F.concat(F.when(bought, "买").otherwise("卖"), F.col("cycle_no").cast("string")))
    return counted.withColumn("label", label).drop("_adds")
