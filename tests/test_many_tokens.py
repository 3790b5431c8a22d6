"""Many tokens of few fills (F20, F21): Python streams over sorted rows, it is not called per token."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.operators import ledger


def test_cycles_of_many_tokens_need_no_call_per_token(spark):
    """Four fills per token: bought, bought, sold, bought again; every third token has a block's worth more and is stitched."""
    fills = spark.range(300 * 12).select(
        F.lit("c").alias("chain"), F.concat(F.lit("t"), (F.col("id") % 300).cast("string")).alias("ca"), F.floor(F.col("id") / 300).alias("n"), F.col("id"))
    fills = fills.where("n < 4 or id % 3 = 0").select(
        "chain", "ca", "id", F.col("n").alias("fill_time"), F.col("n").alias("decision_time"), F.when(F.col("n") % 4 == 2, "sell").otherwise("buy").alias("side"),
        F.lit("entry").alias("reason"), F.when(F.col("n") % 4 == 2, 3.0).when(F.col("n") % 4 == 1, 2.0).otherwise(1.0).alias("quantity"), F.lit(10.0).alias("gross_amount"),
        *[F.lit(1.0).alias(c) for c in ("fill_value", "market_cap", "fee")], *[F.lit(0.0).alias(c) for c in ("slippage_cost", "tax_cost")])
    cycles = ledger.position_cycles(fills, 4).select("ca", "trade_no", "status", "entry_count", "remaining_cost")
    assert "FlatMapGroupsInPandas" not in cycles._jdf.queryExecution().toString()
    rows = cycles.collect()
    got = {(int(r.ca[1:]), r.trade_no): (r.status, r.entry_count, round(r.remaining_cost, 9)) for r in rows}
    held, cost, cycle, left = {}, {}, {}, {}
    want = {}
    for n in range(12):  # plain walk
        for t in range(300):
            if n >= 4 and t % 3:
                continue
            quantity = {2: 3, 1: 2}.get(n % 4, 1)
            if n % 4 == 2:
                left[t] = 0.0 if held[t] == quantity else cost[t] * (1 - quantity / held[t])
                held[t], cost[t] = held[t] - quantity, left[t]
                want[t, cycle[t]] = ("closed" if not held[t] else "open", want[t, cycle[t]][1], round(cost[t], 9))
                continue
            if not held.get(t):
                cycle[t], cost[t] = cycle.get(t, 0) + 1, 0.0
                want[t, cycle[t]] = ("open", 0, 0.0)
            held[t], cost[t] = held.get(t, 0) + quantity, cost[t] + 11.0
            want[t, cycle[t]] = ("open", want[t, cycle[t]][1] + 1, round(cost[t], 9))
    assert got == want


@pytest.mark.parametrize("block", [4, 12, 1000])
def test_cycle_labels_match_the_rule_for_small_and_large_tokens(spark, block):
    """Sells before the first buy, positions without a buy, an order without a position; tokens of 3 to 30 orders (F15)."""
    rng = random.Random(7)
    rows = [("c", f"t{t}", i, i // 4, i // 2, rng.choice(["buy", "buy", "sell"]), rng.choice(["add", "entry"]), rng.choice([None, "p1", "p2", "p3", "p4"]))
            for t in range(10) for i in range(100 * t, 100 * t + 3 * (t + 1))]
    orders = spark.createDataFrame(rows, "chain string, ca string, id long, fill_time long, decision_time long, side string, reason string, position_id string").repartition(3)
    want, numbers, adds = {}, {}, {}
    for _, ca, i, _, _, side, reason, position in rows:  # in fill order
        if position is None or (side == "sell" and (ca, position) not in numbers):
            continue
        n = numbers.setdefault((ca, position), sum(c == ca for c, _ in numbers) + 1)
        if side == "buy" and reason == "add":
            adds[ca, position] = adds.get((ca, position), 0) + 1
            want[i] = f"加{n}.{adds[ca, position]}"
        else:
            want[i] = f"{'买' if side == 'buy' else '卖'}{n}"
    assert {r.id: r.label for r in ledger.cycle_labels(orders, block).collect()} == want


def test_open_cycles_are_valued_without_a_call_per_token(spark):
    valued = entry.queries()["h2_value_open"](spark, "/root/testdata/sf0.001")
    assert "FlatMapGroupsInPandas" not in valued._jdf.queryExecution().toString()
