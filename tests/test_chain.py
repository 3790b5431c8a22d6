"""The locked candidate chain against a walk through every bar."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import chain
from barloom.operators.labels import framed_bars, mark_entries
from barloom.operators.swings import SwingRule, swing_pairs

POOL = "chain string, ca string, pair_id string"


def walked(choices):
    """(bar, end) of each choice made; ``choices`` maps a bar to the last bar of its choice."""
    out, held = [], -1
    for t in sorted(choices):
        if t > held:
            held = choices[t]
            out.append((t, held))
    return out


def random_choices(rng, bars, reach):
    return {t: min(bars - 1, t + rng.randrange(reach)) for t in range(bars) if rng.random() < rng.choice([0.02, 0.5, 0.9])}


@pytest.mark.parametrize("seed", range(6))
def test_landings_follow_the_walk(seed):
    rng = random.Random(seed)
    size, reach = 64, 40
    choices = {t: t + rng.randrange(reach) for t in range(128, 192) if rng.random() < (0.1 if seed % 2 else 0.8)}
    idx = np.array(sorted(choices), np.int64)
    ends = np.array([choices[t] for t in idx], np.int64)
    got = chain.landings(idx, ends, 128, size, reach)
    for start in range(reach + 1):
        made = walked({t: e for t, e in choices.items() if t >= 128 + start})
        assert got[start] == (max(0, made[-1][1] + 1 - 192) if made else 0)
        assert [(int(idx[k]), int(ends[k])) for k in chain.orbit(idx, ends, 128 + start)] == made


@pytest.mark.parametrize("fan, size", [(2, 41), (3, 64), (1024, 2048)])
def test_blocks_compose(spark, fan, size):
    rng = random.Random(fan)
    pools = {("c", "t", "long"): random_choices(rng, 3000, 40), ("c", "t", "short"): random_choices(rng, 30, 40), ("c", "u", "gap"): {5: 9, 8: 12, 2500: 2510, 2501: 2540}}
    rows = [(*p, t, e) for p, choices in pools.items() for t, e in choices.items()]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, f"{POOL}, idx long, ends_at long")
    got = {}
    for r in chain.chain_of(frame, 40, size, fan).collect():
        got.setdefault((r.chain, r.ca, r.pair_id), []).append((r.chosen_idx, r.ends_at))
    assert {p: sorted(v) for p, v in got.items()} == {p: walked(c) for p, c in pools.items()}


def test_empty_and_too_short_blocks(spark):
    empty = spark.createDataFrame([], f"{POOL}, idx long, ends_at long")
    assert chain.chain_of(empty, 40).count() == 0
    with pytest.raises(ValueError, match="longer"):
        chain.chain_of(empty, 40, 40)


def bars_of(spark, closes):
    rows = [("c", "t", "p", k * 60_000, c * 0.98, c * 1.02, c * 0.96, c, 100.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, f"{POOL}, time long, open double, high double, low double, close double, volume double").withColumn("close_time", F.col("time") + 60_000)


def test_candidate_is_locked_and_rearms_the_edge(spark):
    rng = random.Random(5)
    closes, c = [], 1.0
    for k in range(400):
        c = max(0.2, c * rng.choice([0.75, 0.9, 0.97, 1.0, 1.05, 1.15, 1.45]))
        closes.append(c)
    rule, block = SwingRule(version="pullback-v2", lookback=40, max_duration=30), 64
    gate = spark.createDataFrame([("c", "t", 0)], "chain string, ca string, signal_time long")
    frame = framed_bars(bars_of(spark, closes), 60_000, rule, set(), gate, block)
    alive = {}
    # A pair is repeated in the halo of later blocks, and the block of its end knows it.
    for p in swing_pairs(frame, rule).groupBy("high_idx", "low_idx", "confirmed_idx").agg(F.min("ends_at").alias("ends_at")).collect():
        for t in range(p.confirmed_idx, p.ends_at + 1):
            alive.setdefault(t, set()).add((p.high_idx, p.low_idx, p.ends_at))
    got = {r.idx: (r.swing.high_idx, r.swing.low_idx, r.chosen_idx) for r in chain.candidate_chain(frame, rule, block).where("blk = floor(idx / 64)").collect()}
    held, want = None, {}
    for t in range(400):
        if held is None or t > held[2]:
            best = max(alive.get(t, ()), default=None)
            held = (*best, t) if best else None
        if held is not None:
            want[t] = (held[0], held[1], held[3])
    assert got == want and len({v for v in want.values()}) > 5
    entry = {"mode": "all", "conditions": [{"type": "fib_retracement", "zoneLow": 0.0, "zoneHigh": 1.0}]}
    rows = {r.idx: r for r in mark_entries(frame, rule, entry, block).collect()}
    for t, r in rows.items():
        again = want[t][2] == t or t - 1 not in rows or not rows[t - 1].met
        assert r.edge == (r.met and again)
    assert sum(r.edge for r in rows.values()) > 5
