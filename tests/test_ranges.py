"""Row-bounded scans, recurrences, and position cycles with ids, against plain Python."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators, ledger
from barloom.plans.blocks import affine, ranges, scan


def hot(spark, n=20_000):
    """One key holds nine of ten rows, nearly all of them in one instant."""
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.9 else f"k{rng.randint(0, 30)}", 10**12 if rng.random() < 0.95 else rng.randint(0, 2 * 10**12), i, rng.randint(-9, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t long, id long, v long").repartition(7)


def test_one_hot_instant_does_not_fill_a_task(spark):
    rows, df = hot(spark)
    sizes = [r["count"] for r in ranges(df, ["k"], ["t", "id"], 40).groupBy("_range", "k").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 3 * len(rows) / 40


def test_ranged_scan_matches_plain_sums(spark):
    rows, df = hot(spark)
    sums, want = {}, {}
    for k, t, i, v in sorted(rows):
        want[i] = (sums.get(k, (0, None))[0] + v, max(v, sums.get(k, (0, -99))[1]))
        sums[k] = want[i]
    got = scan(df, ["k"], ["t", "id"], None, {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
    assert {r.id: (r.s, r.m) for r in got.collect()} == want


def test_scan_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, t long, v long")
    assert scan(df, ["k"], ["t"], None, {"s": ("sum", F.col("v"))}).collect() == []


@pytest.mark.parametrize("block", [2, 5])
def test_affine_is_the_recurrence(spark, block):
    """Three levels of blocks at small sizes; zeros start anew, nulls leave the value."""
    rng = random.Random(9)
    rows = [(k, i, rng.choice([0.0, 0.5, 0.9, 1.0, None]), rng.choice([0.0, 1.5, -2.0, None])) for k in "ab" for i in range(130)]
    df = spark.createDataFrame(rows, "k string, i long, a double, b double").repartition(5)
    got = {(r.k, r.i): r.x for r in affine(df, ["k"], "i", {"x": (F.col("a"), F.col("b"))}, block).collect()}
    x = {}
    for k, i, a, b in rows:
        x[k] = a * x.get(k, 0.0) + b if a is not None and b is not None else x.get(k, 0.0)
        assert abs(got[k, i] - x[k]) < 1e-9


@pytest.mark.parametrize("period", [1, 9, 400])
def test_ema_keeps_the_first_close(spark, period):
    rng = random.Random(2)
    closes = [1e9] + [rng.random() for _ in range(700)]  # the first close outweighs all others
    df = spark.createDataFrame([("c", "t", "p", i, c) for i, c in enumerate(closes)], "chain string, ca string, pair_id string, idx long, close double")
    want, k = [closes[0]], 2 / (period + 1)
    for c in closes[1:]:
        want.append(c * k + want[-1] * (1 - k))
    got = [r[f"ema_{period}"] for r in indicators.with_ema(df, [period], 64).orderBy("idx").collect()]
    assert max(abs(a - b) / max(abs(b), 1e-9) for a, b in zip(got, want)) < 1e-9


FILLS = "chain string, ca string, fill_time long, decision_time long, id long, position_id string, side string, quantity double, gross_amount double, fill_value double, fee double, slippage_cost double, tax_cost double, reason string, market_cap double"


def plain_cycles(fills):
    """The rule, fill by fill: a buy of another position replaces the open cycle, a sell of another ends it."""
    made, now = [], None
    for f in fills:
        name, side, quantity = f[5] or None, f[6], Decimal(f[7])
        other = now is not None and name is not None and now["id"] != name
        if side == "buy":
            if other:
                now["status"], now = "incomplete", None
            if now is None:
                now = {"id": name or str(f[4]), "left": Decimal(0), "cost": 0.0, "status": "open"}
                made.append(now)
            now["left"] += quantity
            now["cost"] += f[8] + f[9 + 1]
        elif now is None or other or quantity > now["left"] + Decimal("1e-9"):
            if now is not None:
                now["status"], now = "incomplete", None
        else:
            now["cost"] *= 1 - float(quantity) / float(now["left"])
            now["left"] -= quantity
            if now["left"] <= Decimal("1e-9"):
                now["cost"], now["status"], now = 0.0, "closed", None
    return [(c["status"], c["cost"]) for c in made]


@pytest.mark.parametrize("seed", range(2))
def test_cycles_with_position_ids_match_the_rule(spark, seed):
    """Null, empty, repeated and foreign ids, sells too large, exact closes; blocks of one fill and of seven."""
    rng = random.Random(seed)
    rows = {}
    for t in "xyz":
        rows[t] = [("c", t, 5 * (i // 3), i, i, rng.choice([None, None, "", "p1", "p1", "p2", str(i - 1)]), rng.choice(["buy", "buy", "sell"]),
                    float(rng.randint(1, 4)), float(rng.randint(1, 90)), 1.0, 0.25, 0.0, 0.0, "entry", 1.0) for i in range(150)]
    df = spark.createDataFrame([r for t in rows for r in rows[t]], FILLS).repartition(3)
    for block in (1, 7):
        got = {}
        for r in ledger.position_cycles(df, block).orderBy("ca", "trade_no").collect():
            got.setdefault(r.ca, []).append((r.status, r.remaining_cost))
        for t in rows:
            want = plain_cycles(rows[t])
            assert [s for s, _ in got[t]] == [s for s, _ in want]
            assert max(abs(a - b) for (_, a), (_, b) in zip(got[t], want)) < 1e-6
