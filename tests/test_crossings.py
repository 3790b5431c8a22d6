"""First crossings against a walk over the bars; exits without a limit against those with a limit beyond every pool."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import crossings, labels
from barloom.operators.rules import alternatives
from barloom.suite import signals as s
from barloom.plans import backtest

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block, fan", [(2, 2), (5, 3), (512, 64)])
def test_first_crossings(spark, block, fan):
    rng = random.Random(block)
    bars = [("c", "t", p, k, rng.choice([None, *map(float, range(9))]), float(k == 99)) for p in "ab" for k in range(100)]
    searches = [("c", "t", rng.choice("abz"), n, rng.randrange(-1, 100), rng.choice(["v", "end"]), rng.choice([None, 0.5, 7.0, 8.0]), rng.random() < 0.5) for n in range(120)]
    frame = spark.createDataFrame(bars, "chain string, ca string, pair_id string, idx long, v double, e double")
    asked = spark.createDataFrame(searches, "chain string, ca string, pair_id string, n long, after long, metric string, threshold double, strict boolean")
    cells = crossings.extremes(frame, {"v": F.col("v"), "end": F.col("e")}, block, fan)
    got = {r.n: r.hit for r in crossings.first_crossings(asked, cells, ["v", "end"], ["n"], block, fan).collect()}
    want = {}
    for *_, pool, n, after, metric, threshold, strict in searches:
        hits = [b[3] for b in bars if b[2] == pool and b[3] > after and (x := b[4 if metric == "v" else 5]) is not None and threshold is not None
                and (x > threshold if strict else x >= threshold)]
        if hits:
            want[n] = min(hits)
    assert got == want and crossings.first_crossings(asked.limit(0), cells, ["v", "end"], ["n"], block, fan).count() == 0


@pytest.mark.parametrize("exits", [s.EXITS, {**s.LOCKED, "closeAtEnd": False}])
def test_exits_equal_those_of_a_limit_beyond_the_pool(spark, exits):
    frame = s.framed(spark, DATA, s.LEGACY, s.rules.features_of(s.CUT), gated=True)
    entries = labels.with_levels(labels.entries_of(labels.mark_entries(frame, s.LEGACY, backtest.DEFAULT["entry"], s.BLOCK)), exits)
    bars = frame.where("core")
    rows = lambda df: sorted(map(repr, df.drop("swing").collect()))
    far = rows(labels.label_exits(entries, bars, {**exits, "maxHoldingBars": 100_000}, s.CUT, block=5_000))
    assert far == rows(labels.label_exits_unlimited(entries, bars, s.without_limit(exits), s.CUT, block=8, fan=2)) and len(far) > 5


def test_combined_invalidations_are_refused():
    leaf = {"type": "break_swing_low_invalidation"}
    assert alternatives({"mode": "any", "conditions": [leaf, {"mode": "all", "conditions": [leaf]}]}) == [leaf, leaf]
    for group in ({"mode": "all"}, {"mode": "atLeast", "minMatches": 2}):
        with pytest.raises(ValueError):
            alternatives({**group, "conditions": [leaf, leaf]})
