"""First crossings: the first bar after a place whose value reaches a threshold, however far away it is.

The maxima of every metric are kept for blocks of bars, for blocks of blocks, and so on. A search looks at the rest of its
own block on each level, takes the nearest cell that holds a hit, and goes down inside that cell, as a maximum above the
threshold proves a hit. A search meets at most ``block`` bars twice and ``fan`` cells per level twice; the cells of the top
level are all of the pool's, one per ``block * fan ** 2`` bars. No task ever holds a pool.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barloom.plans.blocks import block_of
from barloom.schemas import POOL
from barloom.session import cut

BLOCK, FAN, LEVELS = 512, 64, 4


def extremes(bars: DataFrame, metrics: Mapping[str, Column], block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Cells (pool, level, parent, cell) with the maximum of each metric; a bar is a cell of level 0, nulls are no value."""
    layer = bars.select(*POOL, F.lit(0).alias("level"), block_of(F.col("idx"), block).alias("parent"), F.col("idx").cast("long").alias("cell"),
                        *[v.cast("double").alias(n) for n, v in metrics.items()])
    layers = [layer]
    for level in range(1, LEVELS):
        above = F.lit(0).cast("long") if level == LEVELS - 1 else block_of(F.col("parent"), fan)
        layer = layer.groupBy(*POOL, "parent").agg(*[F.max(n).alias(n) for n in metrics]).select(
            *POOL, F.lit(level).alias("level"), above.alias("_above"), F.col("parent").alias("cell"), *metrics).withColumnRenamed("_above", "parent")
        # The next level groups by the parent of this one, which on top is the whole pool.
        layers.append(layer)
    return cut(reduce(DataFrame.unionByName, layers), "extremes")


def first_crossings(searches: DataFrame, cells: DataFrame, metrics: Sequence[str], ident: Sequence[str], block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``searches`` that hit, with ``hit`` (the bar's idx). ``ident`` identifies a search within its pool.

    A search has ``after`` (bars beyond it count), ``metric``, ``threshold`` and ``strict``. A null threshold never hits.
    """
    key = [*POOL, *[c for c in ident if c not in POOL]]
    carried = ["after", "metric", "threshold", "strict"]
    value = F.coalesce(*[F.when(F.col("metric") == n, F.col(n)) for n in metrics])
    reached = (value > F.col("threshold")) | (~F.col("strict") & (value == F.col("threshold")))
    place, starts = F.col("after").cast("long"), []
    for level in range(LEVELS):
        parent = F.lit(0).cast("long") if level == LEVELS - 1 else block_of(place, fan if level else block)
        starts.append(F.struct(F.lit(level).alias("level"), parent.alias("parent"), place.alias("beyond")))
        place = block_of(place, fan if level else block)
    asked = searches.where("threshold IS NOT NULL").select(*key, *carried, F.explode(F.array(*starts)).alias("_s")).select(*key, *carried, "_s.*")
    kept = [F.first(c).alias(c) for c in carried if c not in key]
    at = asked.join(cells, [*POOL, "level", "parent"]).where((F.col("cell") > F.col("beyond")) & reached).groupBy(*key).agg(
        F.min(F.struct("level", "cell")).alias("_near"), *kept).select("*", "_near.level", "_near.cell").drop("_near")
    inside = cells.where(F.col("level") < LEVELS - 1).select(
        *POOL, (F.col("level") + 1).alias("level"), F.col("parent").alias("cell"), F.col("cell").alias("_child"), *metrics)
    for _ in range(LEVELS - 1):
        at = at.join(inside, [*POOL, "level", "cell"], "left").where((F.col("level") == 0) | reached).groupBy(*key).agg(
            F.min(F.coalesce("_child", "cell")).alias("cell"), F.greatest(F.min("level") - 1, F.lit(0)).alias("level"), *kept)
    return at.drop("level").withColumnRenamed("cell", "hit")
