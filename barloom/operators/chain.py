"""The locked candidate chain: once chosen, a pair stays the candidate until it is no longer selectable; then choose again.

At any bar the choice is the selectable pair with the latest high, then the latest low, and it holds to the pair's last bar.
So each bar points to the bar after its own choice ends, and the chain of a pool is what is reached from its first bar.
Nothing is walked bar by bar through a pool:

1. *In a block.* Bars that have a choice point to the next such bar behind its end. Pointer doubling follows these links to
   where they leave the block. A choice ends within the look-back, so a block is a small table: place of entry to place of
   entry in the next block.
2. *Across blocks.* These tables are composed, ``FAN`` at a time, level by level, and walked down again from the top. A task
   holds ``FAN`` tables or one block of bars, however long a pool is.
3. *Back in the block.* From its place of entry each block reads off the bars where a choice is made.

The chain is that of a pool without a position. No choice gives no row; an empty table gives none.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from barloom.operators.swings import SwingRule, swing_asof, swing_pairs
from barloom.plans.blocks import block_of
from barloom.schemas import POOL
from barloom.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tables composed by one task.
FAN = 1024
AT = ", ".join(f"{c} string" for c in POOL)


def landings(idx: np.ndarray, ends: np.ndarray, first: int, size: int, reach: int) -> np.ndarray:
    """For every place of entry 0..reach of a block: the place of entry in the next block.

    ``idx`` are the bars with a choice, in order, ``ends`` the last bar of each choice.
    """
    n = len(idx)
    after = np.append(np.searchsorted(idx, ends + 1), n)  # the next bar with a choice; n: none in this block
    leave = np.append(np.maximum(ends + 1 - first - size, 0), 0)
    last = np.where(after == n, np.arange(n + 1), after)  # the last choice of the block from here on
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    return leave[last][np.searchsorted(idx, first + np.arange(reach + 1))]


def orbit(idx: np.ndarray, ends: np.ndarray, start: int) -> list[int]:
    """Positions in ``idx`` where a choice is made, from bar ``start`` on."""
    after = np.searchsorted(idx, ends + 1).tolist()
    found, at = [], int(np.searchsorted(idx, start))
    while at < len(after):
        found.append(at)
        at = after[at]
    return found


def compose(tables: pd.DataFrame, group: int, fan: int) -> np.ndarray:
    """The table of a run of blocks. A block without a row has no choice: it is entered anywhere and left at the start of the next."""
    tables = tables.sort_values("cb")
    now = np.arange(len(tables.leave.iloc[0]))
    expected = group * fan
    for block, leave in zip(tables.cb, tables.leave):
        if block != expected:
            now = np.zeros_like(now)
        now = np.asarray(leave)[now]
        expected = block + 1
    return now if expected == (group + 1) * fan else np.zeros_like(now)


def entries_into(tables: pd.DataFrame, group: int, fan: int, start: int) -> list[tuple[int, int]]:
    """(block, place of entry) of a run of blocks that is entered at ``start``."""
    out, expected = [], group * fan
    tables = tables.sort_values("cb")
    for block, leave in zip(tables.cb, tables.leave):
        start = start if block == expected else 0
        out.append((block, start))
        start, expected = int(leave[start]), block + 1
    return out


def starts(tables: DataFrame, fan: int = FAN) -> DataFrame:
    """(pool, ``cb``, ``start``): where the chain enters each block. ``tables`` is written and has (pool, ``cb``, ``leave``)."""
    grouped = tables.withColumn("up", block_of(F.col("cb"), fan))
    top = (grouped.agg(F.max("up")).first()[0] or 0) == 0
    if top:
        entered = grouped.withColumn("enter", F.lit(0))
    else:
        def up(key, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(*key, compose(rows, key[-1], fan).tolist())], columns=[*POOL, "cb", "leave"])

        above = cut(grouped.groupBy(*POOL, "up").applyInPandas(up, f"{AT}, cb bigint, leave array<int>"), "chain-level")
        entered = grouped.join(starts(above, fan).select(*POOL, F.col("cb").alias("up"), F.col("start").alias("enter")), [*POOL, "up"])

    def down(key, rows: pd.DataFrame) -> pd.DataFrame:
        found = entries_into(rows, key[-1], fan, int(rows.enter.iloc[0]))
        return pd.DataFrame([(*key[:-1], block, start) for block, start in found], columns=[*POOL, "cb", "start"])

    return cut(entered.groupBy(*POOL, "up").applyInPandas(down, f"{AT}, cb bigint, start int"), "chain-starts")


def chain_of(choices: DataFrame, reach: int, size: int | None = None, fan: int = FAN) -> DataFrame:
    """(pool, ``chosen_idx``, ``ends_at``) of every choice made, from (pool, idx, ``ends_at``) of the choice at every bar that has one.

    ``reach`` is the most bars a choice holds. A block has ``size`` bars, more than ``reach``.
    """
    size = size or max(2048, 4 * reach)
    if size <= reach:
        raise ValueError("a block of the chain must be longer than a choice holds")
    placed = cut(choices.select(*POOL, "idx", "ends_at", block_of(F.col("idx"), size).alias("cb")), "chain-choices")

    def table(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        leave = landings(rows.idx.to_numpy(), rows.ends_at.to_numpy(), key[-1] * size, size, reach)
        return pd.DataFrame([(*key, leave.tolist())], columns=[*POOL, "cb", "leave"])

    tables = cut(placed.groupBy(*POOL, "cb").applyInPandas(table, f"{AT}, cb bigint, leave array<int>"), "chain-tables")
    begun = starts(tables, fan)

    def read(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        found = orbit(rows.idx.to_numpy(), rows.ends_at.to_numpy(), key[-1] * size + int(rows.start.iloc[0]))
        return rows.iloc[found][[*POOL, "idx", "ends_at"]].rename(columns={"idx": "chosen_idx"})

    return placed.join(begun, [*POOL, "cb"]).groupBy(*POOL, "cb").applyInPandas(read, f"{AT}, chosen_idx bigint, ends_at bigint")


def candidate_chain(frame: DataFrame, rule: SwingRule, block: int, size: int | None = None, fan: int = FAN) -> DataFrame:
    """(pool, blk, idx) -> ``swing``, the locked candidate, and ``chosen_idx``, the bar where it was chosen.

    The last bar of a block is answered for the next one, too. One row per bar that has a candidate.
    """
    # A block knows of a pair's end only if that lies in it; the halo repeats the pair in every block it may end in.
    pair = [*POOL, "high_idx", "low_idx"]
    ends = swing_pairs(frame, rule).groupBy(*pair).agg(F.min("ends_at").alias("ends_at"))
    real = frame.where("core").select(*POOL, "blk", "idx")
    alive = swing_asof(frame, rule, block).join(real, [*POOL, "blk", "idx"]).select(*POOL, "idx", "swing", "swing.high_idx", "swing.low_idx")
    best = cut(alive.join(ends, pair).select(*POOL, "idx", "swing", "ends_at"), "chain-best")
    made = chain_of(best.select(*POOL, "idx", "ends_at"), rule.lookback, size, fan)
    held = made.join(best.select(*POOL, F.col("idx").alias("chosen_idx"), "swing"), [*POOL, "chosen_idx"])
    bars = held.withColumn("idx", F.explode(F.sequence("chosen_idx", "ends_at"))).join(real.drop("blk"), [*POOL, "idx"])
    blocks = F.array_distinct(F.array(block_of(F.col("idx"), block), block_of(F.col("idx") + 1, block)))
    return bars.select(*POOL, F.explode(blocks).alias("blk"), "idx", "swing", "chosen_idx")
