"""Block-partitioned windows.

A pool can hold a third of all bars, so no window here is partitioned by pool alone. Ordered work is cut
into blocks of bounded size and stitched together in one of two ways:

* ``halo``  - bounded look-back: the rows just before a block are copied into it, so a sliding frame sees
  everything it needs inside one partition of fixed size;
* ``scan``  - unbounded look-back (running sum, running peak, last value): a local scan per block, a scan over
  the per-block totals (smaller by the block size), and a join that adds the carried value back. Blocks are sorted
  ranges of rows unless the caller has a dense position to cut by;
* ``affine`` - recurrences x -> a x + b along a dense position, composed by doubling inside blocks and across them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.schemas import POOL
from barloom.session import reuse

BLOCK = 2048


def halo(df: DataFrame, back: int, ahead: int = 0, block: int = BLOCK, position: str = "idx") -> DataFrame:
    """Add ``blk`` and ``core``; rows near a block edge are also copied into the neighbouring block."""
    pos = F.col(position)
    first = F.floor((pos - F.lit(ahead)) / F.lit(block))
    last = F.floor((pos + F.lit(back)) / F.lit(block))
    spread = df.withColumn(
        "blk", F.explode(F.sequence(F.greatest(F.lit(0), first).cast("long"), last.cast("long")))
    ).withColumn("core", F.floor(pos / F.lit(block)) == F.col("blk"))
    # An explicit count: the windows that follow cost far more than the shuffled bytes suggest, and adaptive
    # coalescing would otherwise fold small inputs into one task.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(partitions, *POOL, "blk")


def core(df: DataFrame) -> DataFrame:
    return df.where("core").drop("core", "blk")


_LOCAL = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """Add ``_range``, which never falls along (keys, order): the rows sorted and cut into ``parts`` about equal ranges.

    A key of any size is spread over as many ranges as its share of all rows, however its rows lie in time; only rows
    equal in all of (keys, order) stay together. Kept, as another evaluation would sample other bounds.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reuse(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column | None,
    running: Mapping[str, tuple[str, Column]],
    exclusive: bool = False,
) -> DataFrame:
    """Running aggregates per key. ``bucket`` must not decrease along ``order``; it bounds the rows per task. None: ``ranges``.

    ``running`` maps an output name to ``(kind, value)`` with kind sum, count, max, min or last (non-null).
    ``exclusive`` leaves the current row out.
    """
    part = [*keys, "_bucket"]
    staged = ranges(df, keys, order).withColumnRenamed("_range", "_bucket") if bucket is None else df.withColumn("_bucket", bucket)
    for name, (_, value) in running.items():
        staged = staged.withColumn(f"_in_{name}", value)
    here = Window.partitionBy(*part).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else Window.currentRow
    )
    full = Window.partitionBy(*part).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    local, totals = staged, staged
    folds = []
    for name, (kind, _) in running.items():
        value = F.col(f"_in_{name}")
        if kind == "last":
            local = local.withColumn(f"_loc_{name}", F.last(value, ignorenulls=True).over(here))
            totals = totals.withColumn(f"_fin_{name}", F.last(value, ignorenulls=True).over(full))
            folds.append(F.max(f"_fin_{name}").alias(f"_tot_{name}"))
        else:
            local = local.withColumn(f"_loc_{name}", _LOCAL[kind](value).over(here))
            folds.append(_LOCAL[kind](value).alias(f"_tot_{name}"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.groupBy(*part).agg(*folds)
    for name, (kind, _) in running.items():
        total = F.col(f"_tot_{name}")
        over = F.last(total, ignorenulls=True) if kind == "last" else _LOCAL["sum" if kind == "count" else kind](total)
        carry = carry.withColumn(f"_car_{name}", over.over(before))
    carry = carry.select(*part, *[f"_car_{n}" for n in running])
    joined = local.join(carry, part, "left")
    for name, (kind, _) in running.items():
        joined = joined.withColumn(name, _merge(kind, F.col(f"_car_{name}"), F.col(f"_loc_{name}")))
    drop = ["_bucket"] + [f"{p}{n}" for n in running for p in ("_in_", "_loc_", "_car_")]
    return joined.drop(*drop)


def _prefixes(maps: DataFrame, part: Sequence[str], position: str, names: Sequence[str], block: int) -> DataFrame:
    """Compose the maps of each part, at most ``block`` of them, with all before: strides of 1, 2, 4, ... over one sorted window."""
    window = Window.partitionBy(*part).orderBy(position)
    stride = 1
    while stride < block:
        before = maps.select("*", *[F.lag(n, stride).over(window).alias(f"_b_{n}") for n in names])
        maps = before.withColumns({n: F.when(F.col(f"_b_{n}").isNull(), F.col(n)).otherwise(F.struct(
            (F.col(f"{n}.a") * F.col(f"_b_{n}.a")).alias("a"), (F.col(f"{n}.a") * F.col(f"_b_{n}.b") + F.col(f"{n}.b")).alias("b"))) for n in names}
        ).drop(*[f"_b_{n}" for n in names])
        stride *= 2
    return maps


def affine(df: DataFrame, keys: Sequence[str], position: str, maps: Mapping[str, tuple[Column, Column]], block: int = BLOCK) -> DataFrame:
    """Columns x with ``x = a * (x of the row before) + b`` per key along a dense ``position`` from 0; before the first row x is 0.

    A null a or b leaves x as it is. Maps of a block are composed by doubling, so are those of ``block`` blocks; what is
    left, one map per ``block`` squared rows, is folded per key. Nothing is dropped and no weight is divided out.
    """
    names = list(maps)
    whole = {n: F.when(a.isNull() | b.isNull(), F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))).otherwise(
        F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))) for n, (a, b) in maps.items()}
    staged = df.withColumns({**whole, "_blk": block_of(F.col(position), block)})
    local = reuse(_prefixes(staged, [*keys, "_blk"], position, names, block))
    last = lambda at: [F.max_by(n, at).alias(n) for n in names]
    totals = local.groupBy(*keys, "_blk").agg(*last(position)).withColumn("_sup", block_of(F.col("_blk"), block))
    totals = reuse(_prefixes(totals, [*keys, "_sup"], "_blk", names, block))
    before = Window.partitionBy(*keys).orderBy("_sup").rowsBetween(Window.unboundedPreceding, -1)
    fold = lambda n: F.aggregate(F.collect_list(n).over(before), F.lit(0.0), lambda x, m: m["a"] * x + m["b"])
    tops = totals.groupBy(*keys, "_sup").agg(*last("_blk")).select(*keys, "_sup", *[fold(n).alias(f"_t_{n}") for n in names])
    inside = Window.partitionBy(*keys, "_sup").orderBy("_blk")
    starts = totals.select(*keys, "_sup", "_blk", *[F.lag(n).over(inside).alias(n) for n in names]).join(tops, [*keys, "_sup"]).select(
        *keys, "_blk", *[F.coalesce(F.col(f"{n}.a") * F.col(f"_t_{n}") + F.col(f"{n}.b"), F.col(f"_t_{n}")).alias(f"_t_{n}") for n in names])
    return local.join(starts, [*keys, "_blk"]).withColumns(
        {n: F.col(f"{n}.a") * F.col(f"_t_{n}") + F.col(f"{n}.b") for n in names}).drop("_blk", *[f"_t_{n}" for n in names])


def cover(first: Column, last: Column, block: int) -> Column:
    """Explode an index interval into the blocks it touches (the second equi-key of a range join)."""
    return F.explode(
        F.sequence(F.floor(first / F.lit(block)).cast("long"), F.floor(last / F.lit(block)).cast("long"))
    )


def block_of(position: Column, block: int) -> Column:
    return F.floor(position / F.lit(block)).cast("long")


def asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str,
    values: Sequence[str], width: int | None = None, tie: Sequence[str] = (), inclusive: bool = True,
) -> DataFrame:
    """Latest right row at or before each left row, as columns ``values``.

    Both sides are interleaved and carried forward with ``scan``: no pair of rows is ever formed, and a hot key
    is spread over sorted ranges, or over time buckets where a ``width`` is known to bound their rows.
    """
    payload = F.struct(*values)
    tags = [F.col(c).cast("string") for c in tie]
    order_tag = F.concat_ws("\u0001", *tags) if tags else F.lit("")
    a = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1 if inclusive else -1).alias("_side"), F.lit("").alias("_tie"),
                    F.struct(*left.columns).alias("_row"))
    b = right.where(F.col(right_at).isNotNull()).select(
        *keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), order_tag.alias("_tie"), payload.alias("_val"))
    mixed = a.unionByName(b, allowMissingColumns=True)
    carried = scan(mixed, keys, ["_at", "_side", "_tie"], None if width is None else F.floor(F.col("_at") / F.lit(width)), {"_hit": ("last", F.col("_val"))})
    return carried.where("_side <> 0").select("_row.*", *[F.col("_hit")[v].alias(v) for v in values])
