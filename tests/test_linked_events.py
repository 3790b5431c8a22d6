"""Events linked to trades (F1-F6): each table is shuffled once and nothing is kept; small and crowded pools give what plain loops give."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import DATA
from barloom.operators import results

TRADE = ("id long, run_id string, chain string, ca string, pair_id string, trade_no long, entry_time long, entry_price double, quantity double, exit_time long, "
         "exit_price double, exit_reason string, net_pnl double, trade_class string, adds array<struct<time:bigint,price:double,quantity:double>>")
EVENT = "event_id long, run_id string, chain string, ca string, pair_id string, time long, price double, quantity double, signal_type string, trade_no long"
KINDS = ["entry", "add", "stop_loss", "timeout", "mystery", "risk_event"]
NEAR = [10.0, 10.0 + 5e-9, 10.0 + 1.5e-8, 20.0, None, math.nan]


def tables():
    """Pools of 4 to 60 rows with equal times, equal and nearly equal prices, trades without an entry time, and stored numbers."""
    rng, trades, events = random.Random(4), [], []
    for p in range(12):
        pool, n, span = (f"r{p % 2}", "c", f"t{p}", "a"), 2 + 2 * p, 2 + p
        at = lambda: rng.randrange(span)
        for k in range(n):
            adds = [(at(), rng.choice(NEAR), 1.0) for _ in range(rng.choice([0, 0, 1, 3]))]
            left = rng.random() < 0.8
            trades.append((1000 * p + k, *pool, 500 + k if rng.random() < 0.2 else None, at() * 3 if rng.random() < 0.9 else None, 10.0, 1.0, at() if left else None,
                           rng.choice(NEAR) if left else None, rng.choice(KINDS[2:5]) if left else None, 1.0, rng.choice(["open", "normal_closed"]), adds))
        for k in range(2 * n):
            events.append((10_000 * p + k, *pool, at() * rng.choice([1, 3]), rng.choice(NEAR), 1.0, rng.choice(KINDS), rng.choice([None, None, None, 1, 2, 500, 501])))
    return trades, events + [(e[0] + 500, *e[1:]) for e in events[::3]]


def same(a, b):
    if a is None or b is None:
        return False
    if math.isnan(a) or math.isnan(b):  # not a number is near everything, as in the SQL
        return True
    return abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))


def numbers(trades):
    out = {}
    for t in trades:
        mates = [x[6] for x in trades if x[1:5] == t[1:5]]
        place = 1 + sum((x is None, x or 0) < (t[6] is None, t[6] or 0) for x in mates)
        out[t[0]] = t[5] if t[5] is not None else place if mates.count(t[6]) == 1 else None
    return out


def links(trades, events, number):
    """event_id -> trade, number, class, order and label."""
    out = {}
    for i, *pool, time, price, quantity, kind, stored in events:
        mates = [t for t in trades if list(t[1:5]) == pool]
        fits = lambda at: at[0] == time and same(at[1], price) and same(at[2], quantity)
        if stored is not None:
            hits = [t for t in mates if number[t[0]] == stored]
        elif kind == "entry":
            hits = [t for t in mates if t[6] == time]
        elif kind == "add":
            hits = [t for t in mates if any(map(fits, t[14]))]
        else:
            hits = [t for t in mates if kind in results.EXITS and t[11] == kind and t[9] is not None and fits((t[9], t[10], t[8]))]
        t = hits[0] if len(hits) == 1 else None
        no = stored if stored is not None else t and number[t[0]]
        spots = [k for k, at in enumerate(t[14]) if fits(at)] if t else []
        order = None if t is None else 1 if kind == "entry" else len(t[14]) + 2 if kind in results.EXITS else spots[0] + 2 if kind == "add" and len(spots) == 1 else None
        label = None
        if no is not None:
            label = f"买{no}" if kind == "entry" else f"卖{no}" if kind in results.EXITS else f"加{no}.{order - 1}" if kind == "add" and order else None
        out[i] = (t and t[0], no, t and t[13], order, label)
    return out


@pytest.mark.parametrize("whole", [1, 25, results.WHOLE])
def test_numbers_are_those_of_plain_loops(spark, whole):
    trades, _ = tables()
    rows = results.number_trades(spark.createDataFrame(trades, TRADE), whole).select("id", "trade_no").collect()
    assert len(rows) == len(trades) and {r.id: r.trade_no for r in rows} == numbers(trades)


@pytest.mark.parametrize("whole", [1, 25, results.WHOLE])
@pytest.mark.parametrize("number", [True, False])
def test_links_are_those_of_plain_loops(spark, whole, number):
    trades, events = tables()
    rows = results.associate_events(spark.createDataFrame(trades, TRADE), spark.createDataFrame(events, EVENT), number, whole).select(
        "event_id", "trade_id", "trade_no", "trade_class", "event_order", "label").collect()
    want = links(trades, events, numbers(trades) if number else {t[0]: t[5] for t in trades})
    assert len(rows) == len(events) and {r[0]: tuple(r[1:]) for r in rows} == want
    assert sum(v[0] is not None for v in want.values()) > 40


def test_copies_of_an_event_meet_no_place_twice(spark):
    """3,000 equal events and 2,000 near places at one time: one of the events meets them, and all take over that they are several."""
    pool = [F.lit(x).alias(c) for x, c in zip(("r", "c", "t", "a"), results.RUN_POOL)]
    none = F.array().cast("array<struct<time:bigint,price:double,quantity:double>>")
    trades = spark.range(2000).select("id", *pool, F.lit(None).cast("long").alias("trade_no"), F.col("id").alias("entry_time"), F.lit(7).cast("long").alias("exit_time"),
                                      (F.lit(10.0) + F.col("id") * 1e-13).alias("exit_price"), F.lit("timeout").alias("exit_reason"), F.lit(1.0).alias("quantity"),
                                      F.lit("normal_closed").alias("trade_class"), none.alias("adds"))
    events = spark.range(3000).select(F.col("id").alias("event_id"), *pool, F.lit(7).cast("long").alias("time"), F.lit(10.0).alias("price"), F.lit(1.0).alias("quantity"),
                                      F.lit("timeout").alias("signal_type"), F.lit(None).cast("long").alias("trade_no"))
    for whole in (1, results.WHOLE):
        row = results.associate_events(trades, events, whole=whole).agg(F.count("*"), F.count("trade_id")).first()
        assert tuple(row) == (3000, 0)
        row = results.associate_events(trades.where("id = 5"), events, whole=whole).agg(F.count("*"), F.count("trade_id"), F.min("event_order")).first()
        assert tuple(row) == (3000, 3000, 2)


@pytest.mark.parametrize("name, shuffles", [("g3_associate_events", 2), ("g6_select_trades_by_event", 3), ("g6_select_events", 2), ("g6_hidden_events", 2), ("g5_cost_basis", 3), ("g4_event_labels", 2)])
def test_tables_are_shuffled_once_and_not_kept(spark, name, shuffles):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, str(DATA / "sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning") == shuffles and "InMemoryTableScan" not in plan and "Exchange rangepartitioning" not in plan
