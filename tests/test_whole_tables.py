"""Queries that once read a slice, on all their rows: their own SQL, or brute force."""

from collections import Counter
from itertools import groupby

import pytest

from compare import DATA, check, connect

WHOLE = ["d12_nearest_bars", "h5_bought_pools", "f14_open_positions", "i2_tumbling_bars_stream_finished"]
H4 = 14_400_000


@pytest.mark.parametrize("name", WHOLE)
def test_all_rows(spark, name):
    import __spark_entry__ as entry

    assert check(spark, connect("sf0.001"), name, entry.queries()[name], entry.oracle_sql()[name], "sf0.001").startswith("match")


def test_ledgers_hold_every_buy(spark):
    import __spark_entry__ as entry
    from barloom.sources import mapped

    sf = str(DATA / "sf0.001")
    buys = sorted(((r.chain, r.ca, r.pair_id), r.fill_time, r.id, (r.decision_time - 1) // H4 * H4) for r in mapped.fills(spark, sf).where("side = 'buy'").collect())
    want = Counter()
    for _, rows in groupby(buys, key=lambda r: r[0]):
        rows = list(rows)
        free = [(fill // H4 * H4, i) for _, fill, i, _ in rows]
        for _, _, cycle, bucket in rows:
            trade = min(free, key=lambda t: (abs(t[0] - bucket), t))
            free.remove(trade)
            want[cycle, trade[1]] += 1
    got = Counter((r.cycle_id, r.trade_id) for r in entry.queries()["h6_compare_ledgers"](spark, sf).collect())
    assert len(buys) > 1000 and got == want
