"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for every length i, the polynomial hash of its first i code points modulo a prime. A
difference of two entries is the hash of the span between them, so any two spans are compared in constant time, and the
longest common extension of two places is found by binary search. The hash of a text put together from spans of others
follows from their arrays without hashing it again.

A fingerprint keeps the array at up to 64 even places (a power of two apart), its length, and two full hashes. The
likeness of two fingerprints is the share of the longer text that lies in common extensions: from the start, the longest
one is taken, one step is skipped, and so on. Equal texts have equal fingerprints; their likeness is 1.

Null and empty texts: length 0; two of them are alike 1, one and another text 0. The next document is that with the next
larger doc_id, nulls first, equal ids in the order of their texts; the last is followed by the first, a single document by
itself. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import arrow_pass

# Two primes below 2**31 and a base for each.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_660_944_431)
POINTS = 64
#: Ranges of ids per shuffle partition; small ones even out the partitions.
RANGES = 4
FIRST = -(1 << 63)
_powers: dict[int, np.ndarray] = {}


def powers(which: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a base, doubled as needed."""
    have = _powers.get(which, np.ones(1, np.int64))
    prime = PRIMES[which]
    while len(have) < n:
        step = int(have[-1]) * BASES[which] % prime
        have = np.concatenate((have, have * step % prime))
    _powers[which] = have
    return have


class Prefix:
    """The prefix arrays of a text; ``at(which, i)`` is the hash of its first ``i`` code points."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64) + 1
        self.n = len(points)
        self.sums = []
        for which, prime in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum(points * powers(which, self.n + 1)[:self.n] % prime, out=sums[1:])
            self.sums.append(sums)

    def at(self, which: int, i):
        return self.sums[which][i] % PRIMES[which]

    def span(self, which: int, i: int, j: int) -> int:
        """Hash of the code points from i to j, wherever they stand."""
        inverse = pow(int(powers(which, i + 1)[i]), -1, PRIMES[which])
        return int(self.at(which, j) - self.at(which, i)) * inverse % PRIMES[which]


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """How many code points agree from ``i`` in a and from ``j`` in b."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if all(a.span(w, i, i + middle) == b.span(w, j, j + middle) for w in (0, 1)):
            low = middle
        else:
            high = middle - 1
    return low


@dataclass
class Fingerprint:
    n: int
    step: int
    points: list[int]
    whole: tuple[int, int]

    def __str__(self) -> str:
        return f"{self.n:x}:{self.step:x}:{self.whole[0]:08x}{self.whole[1]:08x}:" + "".join(f"{p:08x}" for p in self.points)

    @staticmethod
    def parse(text: str) -> Fingerprint:
        n, step, whole, points = text.split(":")
        return Fingerprint(int(n, 16), int(step, 16), [int(points[k:k + 8], 16) for k in range(0, len(points), 8)], (int(whole[:8], 16), int(whole[8:], 16)))


def _step(n: int) -> int:
    step = 1
    while n // step > POINTS:
        step *= 2
    return step


def fingerprint(prefix: Prefix) -> Fingerprint:
    step = _step(prefix.n)
    points = prefix.at(0, np.arange(step, prefix.n + 1, step)).tolist()
    return Fingerprint(prefix.n, step, points, tuple(int(prefix.at(w, prefix.n)) for w in (0, 1)))


def spliced(a: Prefix, keep: int, b: Prefix, take: int) -> Fingerprint:
    """Fingerprint of the first ``keep`` of a followed by the first ``take`` of b, from their arrays alone."""
    n = keep + take
    step = _step(n)

    def at(which, places):
        tail = np.maximum(places - keep, 0)
        shift = int(powers(which, keep + 1)[keep])
        return (a.at(which, np.minimum(places, keep)) + b.at(which, tail) * shift) % PRIMES[which]

    return Fingerprint(n, step, at(0, np.arange(step, n + 1, step)).tolist(), tuple(int(at(w, np.array([n]))[0]) for w in (0, 1)))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of the longer text in common extensions at equal places."""
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    step, prime = max(a.step, b.step), PRIMES[0]
    x, y = ([0, *f.points[step // f.step - 1::step // f.step]] for f in (a, b))
    at, most, equal = 0, min(len(x), len(y)) - 1, 0
    apart = [(p - q) % prime for p, q in zip(x, y)]
    while at < most:
        low, high = at, most
        if apart[at + 1] != apart[at]:
            at += 1
            continue
        while low < high:  # the farthest place up to which all agrees
            middle = (low + high + 1) // 2
            if apart[middle] == apart[at]:
                low = middle
            else:
                high = middle - 1
        equal += low - at
        at = low + 1
    return min(equal * step / max(a.n, b.n), 1 - 1 / max(a.n, b.n, 2))


def _ranges(docs: DataFrame):
    """A column transformer to id ranges of about equal rows, and the first id of each range that has rows."""
    spark = docs.sparkSession
    wanted = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.approxQuantile("__order", [k / wanted for k in range(1, wanted)], 0.25 / wanted)
    edges = [-math.inf, *sorted({0.0, *(b for b in bounds if not math.isnan(b))}), math.inf]
    split = Bucketizer(splits=edges, inputCol="__order", outputCol="__range")
    firsts = split.transform(docs.select("__order", "__id")).groupBy("__range").agg(F.min("__id")).collect()  # a row per range
    return split, sorted((int(r), i) for r, i in firsts)


def compare_with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    Documents are dealt once by ranges of ids and sorted; the first document of a range also goes to the range before it.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    docs = docs.withColumn("__id", F.coalesce("doc_id", F.lit(FIRST))).withColumn("__order", F.col("__id").cast("double"))
    split, firsts = _ranges(docs)
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not firsts:
        return docs.sparkSession.createDataFrame([], schema)
    before = {i: firsts[k - 1][0] for k, (_, i) in enumerate(firsts)}
    place = F.struct(F.col("__range").cast("int").alias("range"), F.lit(False).alias("guard"))
    back = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    guard = F.struct(back[F.col("__id")].alias("range"), F.lit(True).alias("guard"))
    places = F.when(F.col("__id").isin(list(before)), F.array(place, guard)).otherwise(F.array(place))
    dealt = split.transform(docs).select("doc_id", "__id", "__text", F.explode(places).alias("p")).select("p.range", "p.guard", "__id", "__text", "doc_id")
    dealt = dealt.repartition("range").sortWithinPartitions("range", "guard", "__id", "__text")

    def line(held, after):
        doc_id, value, prefix, mark = held
        other, other_prefix, other_mark = after
        cut = prefix.n // 4
        keep, take = prefix.n - cut, min(cut, other_prefix.n)
        edited = value[:keep] + other[:take]
        edited_mark = spliced(prefix, keep, other_prefix, take)
        return (doc_id, prefix.n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), str(mark), str(edited_mark),
                likeness(mark, edited_mark), likeness(mark, other_mark))

    def run(batches):
        now, held = None, None
        for batch in batches:
            rows = []
            for where, is_guard, _, value, doc_id in zip(*(batch.column(k) for k in range(5))):
                where, value = where.as_py(), value.as_py()
                if where != now:
                    now, held = where, None
                elif held is None:
                    continue  # a second guard of the same id
                prefix = Prefix(value)
                mark = fingerprint(prefix)
                if held is not None:
                    rows.append(line(held, (value, prefix, mark)))
                held = None if is_guard.as_py() else (doc_id.as_py(), value, prefix, mark)
            columns = list(zip(*rows)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in schema.split(", ")])

    return arrow_pass(dealt, run, schema)
