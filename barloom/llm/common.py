"""What the operators share: reading tables, Arrow passes over texts, and joins against sides of a checked size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of one Arrow batch. Texts may be very long, so a batch is kept to a few megabytes at usual lengths.
BATCH_ROWS = 500
#: A side of at most this many narrow rows is broadcast; above it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: The same for ``join_split``, whose narrow rows hold lists: a few megabytes.
BROADCAST_CELLS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_pass(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts. Workers outlast a task, so each hands back its buffers after it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(whole, schema)


def join_checked(wide: DataFrame, narrow: DataFrame, on: Sequence[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a wide table with a narrow, already written one.

    The narrow side is counted first and broadcast only up to ``limit`` rows, so that wide rows need no shuffle; beyond
    it the join shuffles and adaptive execution splits hot keys.
    """
    if narrow.limit(limit + 1).count() <= limit:
        narrow = F.broadcast(narrow)
    return wide.join(narrow, list(on), how)


def join_split(wide: DataFrame, narrow: DataFrame, on: Sequence[str], weight: str, how: str = "inner", cells: str | None = None, limit: int = BROADCAST_CELLS) -> DataFrame:
    """Join a wide table with a written one of unique keys whose ``weight`` says how many wide rows each key has.

    Up to ``limit`` cells (rows, or the sum of ``cells``) the narrow side is broadcast. Beyond, keys that hold a
    thousandth of all weight or more, a thousand at most, are broadcast and all other rows meet by a shuffle, so a hot
    key never gathers in one task.
    """
    size, total = narrow.agg(F.coalesce(F.sum(cells) if cells else F.count("*"), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))).first()
    if size <= limit:
        return wide.join(F.broadcast(narrow.drop(weight)), list(on), how)
    hot = F.col(weight) * 1000 >= total
    often, seldom = narrow.where(hot).drop(weight), narrow.where(~hot).drop(weight)
    rest = wide.join(F.broadcast(often.select(*on)), list(on), "left_anti").join(seldom, list(on), how)
    return wide.join(F.broadcast(often), list(on)).unionByName(rest, allowMissingColumns=True)


def digest(column, algorithm_bits: int = 256):
    """Lowercase hex SHA-2 of a string's UTF-8 bytes or of binary data."""
    return F.sha2(column.cast("binary"), algorithm_bits)
