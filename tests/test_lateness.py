"""Lateness verdicts: batch and stream against a walk over the trades, for any split into micro-batches."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from barloom.session import scratch, shared_dir
from barloom.streaming import bars as live

SCHEMA = "chain string, ca string, pair_id string, id string, arrival long, time long, price double, volume_usd double, mcap double"


def trades(n=300):
    rng, out, clock = random.Random(5), [], 1_000_000
    for k in range(n):
        clock += rng.choice([0, 1_000, 9_000, 70_000])
        time = max(0, clock - rng.choice([0, 0, 5_000, 29_999, 30_000, 31_000, 65_000]))
        out.append((rng.choice(["x", "y"]), rng.choice(["t", "u"]), "p", f"{k:04d}", k, time, rng.choice([1.0, 2.0, 3.0]), 1.0, rng.choice([None, 5.0, 6.0])))
    odd = [(None, "t", "p", "a", 7), ("x", "", "p", "b", 7), ("x", "t", "p", None, 7), ("x", "t", "p", "c", None)]
    out += [(*o[:4], n + i, o[4], 1.0, 1.0, None) for i, o in enumerate(odd)]
    bad = [(0.0, 1.0), (math.nan, 1.0), (math.inf, 1.0), (None, 1.0), (1.0, -1.0), (1.0, None), (1.0, math.inf)]
    out += [("x", "t", "p", f"z{i}", n + 10 + i, 10**12, *b, 1.0) for i, b in enumerate(bad)]
    return out + [("x", "t", "p", "zz", n + 20, clock + 500_000, 1.0, 0.0, math.nan), ("x", "t", "p", "zzz", n + 21, clock + 1, 1.0, 0.0, 1.0)]


def walk(rows):
    latest, minutes, out = {}, {}, {}
    for chain, ca, pair, ident, arrival, time, price, volume, mcap in rows:
        good = all((chain, ca, pair, ident)) and time is not None and price is not None and math.isfinite(price) and price > 0
        if not (good and volume is not None and math.isfinite(volume) and volume >= 0):
            out[arrival] = "invalid"
            continue
        last = latest.get((chain, pair), -1)
        if last - time >= 30_000 and time // 60_000 != last // 60_000:
            out[arrival] = "too_old"
            continue
        latest[chain, pair] = max(last, time)
        taken = False
        for kind, value in (("price", price), ("mcap", mcap)):
            if value is None or not math.isfinite(value) or value <= 0:
                continue
            for step in (30_000, 60_000):
                key = chain, ca, pair, kind, step
                if time // step >= minutes.get(key, -1):
                    minutes[key], taken = time // step, True
        out[arrival] = "closed" if not taken else "late" if time < last else "on_time"
    return out


def test_stored(spark):
    rows = trades()
    want = walk(rows)
    assert set(want.values()) == {"invalid", "too_old", "closed", "late", "on_time"}
    for width in (7, 10**6):
        got = live.judge_trades(spark.createDataFrame(rows, SCHEMA).repartition(3), "arrival", width)
        assert {r.arrival: r.verdict for r in got.collect()} == want
    assert live.judge_trades(spark.createDataFrame([], SCHEMA), "arrival", 7).count() == 0


@pytest.mark.parametrize("cuts", [[], [1, 2, 150], [40, 80, 120, 160, 200, 240, 280]])
def test_stream(spark, cuts):
    rows, path = trades(), scratch(spark, "trades")
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b][::-1], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        for file in os.listdir(path):
            full = os.path.join(path, file)
            if file.endswith(".parquet") and os.path.getmtime(full) > 10**9:
                os.utime(full, (10**8 + 60 * k, 10**8 + 60 * k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    got = live.run_to_table(live.judge_stream(stream, "arrival"), "verdicts").collect()
    assert len(got) == len(rows) and {r.arrival: r.verdict for r in got} == walk(rows)


def test_no_machine_local_folder(spark):
    class Settings(dict):
        def set(self, name, value):
            raise AssertionError("set on a cluster")

    class Cluster:
        conf = Settings({"spark.master": "yarn"})

    with pytest.raises(ValueError):
        shared_dir(Cluster())
    Cluster.conf["spark.checkpoint.dir"] = "hdfs:///work/"
    assert shared_dir(Cluster()) == "hdfs:///work"
