"""Whitened embeddings from exact second moments by bit-sliced scatter.

Entries become integers x = floor(scale * c). Each distinct vector is fitted once.

1. *Slices.* A block of rows is shifted by its least entry per dimension, and every bit of a dimension is packed across the
   rows into 64-bit words: one bit plane.
2. *Scatter.* The cross-product of two dimensions is the sum over pairs of planes of 2^(a+b) times the population count of
   their AND. Shifts are taken out again with integers, so blocks add up exactly whatever their order.
3. *Fit.* Sums of all blocks are added as integers of any size, centred as integers (n * C - S * S), divided once, and handed
   to ``eigh``. What reaches the driver is one number per pair of dimensions, however many rows there are.
4. *Whitening.* (x - S / n) projected on a component, over the root of its eigenvalue.

Rows whose vector is null or holds null or non-finite entries are dropped. If lengths differ, the commonest one counts (the
longest of equals) and rows of other lengths are dropped, too. Components without variance (an eigenvalue below rounding, as
where all vectors are equal) have no rows. Entries beyond 64 bits are held at the ends of that range; a deviation beyond 64
bits is null. Repeated rows are fitted once and returned as often as they occur. A null id is carried along, other columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import arrow_pass
from barloom.session import cut

SCALE = 256
COMPONENTS = 4
#: Rows sliced together: 128 words a plane.
BLOCK_ROWS = 8192
#: Sums travel as signed digits of this many bits, so that a column of digits adds up in 64 bits.
DIGIT = 32


@dataclass(frozen=True)
class Whitener:
    """Means, components (a row each) and eigenvalues by falling eigenvalue, with the exact ``sums`` of ``n`` fitted vectors."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Per row the sum of (n * x - S)^2; null beyond 64 bits."""
        most = max((abs(int(x.min())), abs(int(x.max())))) if x.size else 0
        if (self.n * most + max(map(abs, self.sums), default=0)) ** 2 * max(1, x.shape[1]) < 2**62:
            apart = self.n * x - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 2**63 else None for v in map(int, (apart * apart).sum(axis=1))]


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least entry per dimension, and the bit planes of what is above it: (bits, dimensions, words)."""
    low = x.min(axis=0)
    above = np.zeros((-(-len(x) // 64) * 64, x.shape[1]), np.uint64)
    above[:len(x)] = x.view(np.uint64) - low.view(np.uint64)  # exact modulo 2^64, and never negative
    bits = int(above.max()).bit_length()
    packed = [np.ascontiguousarray(np.packbits(((above >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0).T).view(np.uint64) for b in range(bits)]
    return low, np.array(packed, np.uint64).reshape(bits, x.shape[1], len(above) // 64)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of the rows of ``x``, as arrays of integers of any size."""
    n, d = x.shape
    low, sliced = planes(x)
    bits = len(sliced)
    flat = sliced.reshape(bits * d, -(-n // 64))
    common = np.zeros((bits * d, bits * d), np.int64)
    for k in range(bits * d):
        common[k, k:] = np.bitwise_count(flat[k] & flat[k:]).sum(axis=1, dtype=np.int64)
    common += np.triu(common, 1).T
    counts = common.diagonal().reshape(bits, d)
    common = common.reshape(bits, d, bits, d)
    if 2 * bits + n.bit_length() > 62:
        counts, common = counts.astype(object), common.astype(object)
    weights = np.array([1 << b for b in range(bits)], counts.dtype)
    above = (weights[:, None] * counts).sum(axis=0).astype(object)
    cross = sum((common[a, :, b, :] * (weights[a] * weights[b]) for a in range(bits) for b in range(bits)), np.zeros((d, d), counts.dtype)).astype(object)
    low = np.array(low.tolist(), object)
    shift = np.multiply.outer(low, above)
    return above + n * low, cross + shift + shift.T + n * np.multiply.outer(low, low)


def _rows(vectors: pa.Array, d: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), d)


def whole_numbers(vectors: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), scale: float = SCALE) -> tuple[DataFrame, int]:
    """A written table of ``keep`` and ``x`` (array of integers) of the rows that count, and their number of dimensions."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & finite)
    rows = cut(rows.select(*keep, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x")), "whitening-rows")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = common.d if common else 0
    return rows.where(F.size("x") == d), d


def moments(fitted: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and cross-products of the vectors ``x``, exact."""

    def run(batches):
        total, sums, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
        held, size = [], 0

        def settle():
            nonlocal total, sums, cross, held, size
            x = np.concatenate(held)
            for at in range(0, len(x), BLOCK_ROWS):
                s, c = scatter(np.ascontiguousarray(x[at:at + BLOCK_ROWS]))
                sums, cross = sums + s, cross + c
            total += len(x)
            held, size = [], 0

        for batch in batches:
            held.append(_rows(batch.column(0), d))
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                settle()
        if size:
            settle()
        if not total:
            return
        i, j = np.triu_indices(d)
        values = [total, *sums.tolist(), *cross[i, j].tolist()]
        left = [-1, *range(d), *i.tolist()]
        right = [-1] * (d + 1) + j.tolist()
        rows = [(a, b, k, digit) for a, b, v in zip(left, right, values) for k, digit in digits(v)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "digit", "value"])

    sums = [0] * d
    cross = [[0] * d for _ in range(d)]
    n = 0
    found = arrow_pass(fitted.select("x"), run, "i int, j int, digit int, value bigint").groupBy("i", "j", "digit").agg(F.sum("value").alias("value"))
    for i, j, digit, value in found.collect():  # bounded by the dimensions, not by the rows
        value <<= DIGIT * digit
        if i < 0:
            n += value
        elif j < 0:
            sums[i] += value
        else:
            cross[i][j] += value
            if i != j:
                cross[j][i] += value
    return n, sums, cross


def digits(value: int):
    """(place, signed digit) of a number, at least one."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value or not place:
        yield place, sign * (value & (1 << DIGIT) - 1)
        value >>= DIGIT
        place += 1


def fit(fitted: DataFrame, d: int, components: int = COMPONENTS) -> Whitener | None:
    """Fit to the vectors ``x``; none without vectors, dimensions or variance."""
    if not d:
        return None
    n, sums, cross = moments(fitted, d)
    if not n:
        return None
    spread = np.array([[(n * cross[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(spread)
    values, vectors = values[::-1], vectors[:, ::-1].T
    real = int((values > d * np.finfo(float).eps * max(values[0], 0)).sum())
    k = min(components, real)
    return Whitener(n, tuple(sums), values[:k], vectors[:k], float(np.trace(spread))) if k else None


def whiten(rows: DataFrame, model: Whitener, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Columns ``keep``, ``deviation`` and ``whitened``, an array of one number per component."""
    d, names = len(model.sums), [*keep, "deviation", "whitened"]

    def run(batches):
        for batch in batches:
            x = _rows(batch.column(len(keep)), d)
            found = model.project(x)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * found.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(keep))), pa.array(model.deviation(x), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names)

    types = dict(rows.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in keep) + "deviation bigint, whitened array<double>"
    return arrow_pass(rows.select(*keep, "x"), run, schema)


def identity_error(fitted: DataFrame, model: Whitener) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, measured on the whitened vectors."""
    k = len(model.values)
    white = cut(whiten(fitted, model, ()), "whitening-fitted")
    means = list(white.agg(*(F.avg(F.col("whitened")[i]) for i in range(k))).first())

    def centred(i: int) -> Column:
        return F.col("whitened")[i] - F.lit(means[i])

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*(F.avg(centred(i) * centred(j)) for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whitened(vectors: DataFrame, vector: str = "embedding", id_: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    rows, d = whole_numbers(vectors, vector, (id_,))
    fitted = cut(rows.select("x").distinct(), "whitening-fit")
    model = fit(fitted, d, components)
    kind = dict(rows.dtypes)[id_]
    if model is None:
        return rows.sparkSession.createDataFrame([], f"`{id_}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    error = identity_error(fitted, model)
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    return whiten(rows, model, (id_,)).select(id_, "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        id_, (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"))
