"""N-gram Jaccard join by parity sketches, exact, with the connected groups of its links.

Two documents link when the Jaccard similarity of their shingle sets reaches the threshold t = 3/4.

1. *Sets.* Equal sets form one class; all later work is on classes, so copies cost nothing.
2. *Shared tokens.* A linked set misses at most a quarter of its tokens in its partner. The tokens of a fixed part of the
   hash space are counted by packed numpy buckets; a set with more lone tokens than that has no partner and drops out.
   This is an exact test: it only removes sets that cannot link.
3. *Parity sketches.* Tokens are XOR-hashed into a sketch, each toggling one bit. The Hamming distance of two sketches
   is at most the symmetric difference, which for linked sets of sizes a and b is at most D = (a + b) / 7. Per size band
   (sizes within 4/3) the sketch is cut into more than D bands, so linked sets agree in at least one band; a band is kept
   sparse and stands as the XOR of the codes of its odd bits. Sets with so many empty bands that agreement could fall on
   empty ones alone also join by single tokens. With spare bands linked sets agree in several, so of a set's keys only the
   rarest are kept: enough to hold the first key of any linked pair. What common passages share falls away here.
4. *Pigeonhole join.* Every key kept first links its sets to one of them, its hub (a star, so work is linear in the size of
   a group). Keys choose their hubs by up to ``HUBS`` different orders, since sets that share one key mostly share many: a
   group then meets several of its sets, not one that may be far from all. Pairs are verified by exact intersection and
   gathered into components. Keys that still hold sets of different components are joined with each other under the size
   and Hamming bounds; those pairs are verified, too. Pairs within one component need no further look.

Null or empty texts, and texts without words, have no set: they link with nothing and are groups of their own. Repeated
rows have equal sets and link. A null doc_id takes part, but a group's id is its smallest id that is not null. Other
columns are never read. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import arrow_pass, join_checked
from barloom.llm.components import components
from barloom.llm.words import mix, shingle_set
from barloom.session import cut

#: Share of the hash space whose tokens are counted in step 2. Above a quarter; more prunes better and shuffles more.
COUNTED = 0.6
#: Tokens per bucket of step 2, the unit a task holds.
BUCKET_TOKENS = 500_000
#: Sets per target of its result.
TARGET_SETS = 20_000
#: Tokens packed together by one worker before they leave it: some 100 bytes each while they are sorted.
PACK_TOKENS = 250_000
#: Bands beyond the pigeonhole's need, as a share of it.
SPARE_BANDS = 0.2
#: Words of 64 bits of the dense sketch for the Hamming bound. It rules out what is well below the threshold while two sets
#: together have fewer shingles than the sketch has bits, and less and less beyond.
DENSE = 32
#: Words of its fold, which is compared first.
FOLD = 8
#: Sketches (about 300 bytes each) are broadcast up to this many.
BROADCAST_SKETCHES = 60_000
#: Orders by which keys choose their hubs.
HUBS = 8
LAST_ID = 2**63 - 1  # stands for a null doc_id, which comes after all others
MANY = 0  # stands for several sets in a packed bucket

_LIMIT = np.uint64(int(COUNTED * 2**64))


def bands() -> list[int]:
    """Smallest size of each size band."""
    found = [1]
    while found[-1] < 1 << 40:
        found.append(max(found[-1] + 1, found[-1] * 4 // 3))
    return found


_BANDS = bands()


def set_id(tokens: np.ndarray) -> int:
    """One signed 64-bit number per set, never 0."""
    total = mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total]))[0].astype(np.int64)) or 1


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, ``text_key``, ``n`` (size of its set), ``set_id`` (null if empty) and ``counted`` tokens."""

    def run(batches):
        for batch in batches:
            sizes, ids, counted = [], [], []
            for value in batch.column(2):
                tokens = shingle_set(value.as_py())
                sizes.append(len(tokens))
                ids.append(set_id(tokens) if len(tokens) else None)
                counted.append(int(np.searchsorted(tokens, _LIMIT)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(counted, pa.int64())],
                ["doc_id", "text_key", "n", "set_id", "counted"])

    key = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key")
    return arrow_pass(docs.select(F.col("doc_id").cast("long"), key, text), run, "doc_id bigint, text_key bigint, n bigint, set_id bigint, counted bigint")


def shared_tokens(docs: DataFrame, buckets: int, targets: int, text: str = "text") -> DataFrame:
    """``set_id`` and ``shared``: counted tokens that other sets have as well (repeated sets may count twice).

    Tokens are dealt to ``buckets``; what a bucket finds is added up per task and dealt, packed again, to ``targets``.
    """

    def pack(tokens: list[np.ndarray], ids: list[int]):
        token = np.concatenate(tokens)
        owner = np.repeat(np.array(ids, np.int64), [len(t) for t in tokens])
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])))
        token, owner = token[new], owner[new]
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        several = np.diff(np.concatenate((start, [len(token)]))) > 1
        mine = np.repeat(several, np.diff(np.concatenate((start, [len(token)]))))
        sets, known = np.unique(owner[mine], return_counts=True)  # settled here already
        token, owner = token[start], np.where(several, MANY, owner[start])
        target = (mix(token) % np.uint64(buckets)).astype(np.int64)
        yield from parcels(target, (token >> np.uint64(16)).astype(np.uint32), owner)
        yield from parcels(-1 - (mix(sets.astype(np.uint64)) % np.uint64(targets)).astype(np.int64), known.astype(np.uint32), sets)

    def parcels(target, number, owner):
        order = np.argsort(target, kind="stable")
        target, number, owner = target[order], number[order], owner[order]
        begin = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.empty(0, int)
        for a, b in zip(begin, [*begin[1:], len(target)]):
            yield int(target[a]), number[a:b].tobytes(), owner[a:b].tobytes()

    def out(rows):
        bucket, number, owner = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(number, pa.binary()), pa.array(owner, pa.binary())], ["bucket", "number", "owner"])

    def emit(batches):
        tokens, ids, size = [], [], 0
        for batch in batches:
            for value in batch.column(0):
                found = shingle_set(value.as_py())
                if len(found):
                    tokens.append(found[:np.searchsorted(found, _LIMIT)])
                    ids.append(set_id(found))
                    size += len(tokens[-1])
                if size > PACK_TOKENS:
                    yield out(list(pack(tokens, ids)))
                    tokens, ids, size = [], [], 0
        if size:
            yield out(list(pack(tokens, ids)))

    def settle(bucket: int, number: np.ndarray, owner: np.ndarray):
        """Sets with a count each: of tokens that are not alone in a bucket, or as counted before."""
        if bucket < 0:
            return owner, number
        order = np.lexsort((owner, number))
        number, owner = number[order], owner[order]
        new = np.concatenate(([True], (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])))
        number, owner = number[new], owner[new]
        start = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        counts = np.diff(np.concatenate((start, [len(number)])))
        owner = owner[np.repeat(counts > 1, counts)]
        return np.unique(owner[owner != MANY], return_counts=True)

    def added(parts):
        sets, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return sets, np.bincount(place, np.concatenate([p[1] for p in parts]), len(sets)).astype(np.int64)

    def runs(batches):
        """Each bucket of a sorted partition with its numbers and owners."""
        now, numbers, owners = None, [], []
        for batch in batches:
            for bucket, number, owner in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if bucket != now and numbers:
                    yield now, np.frombuffer(b"".join(numbers), np.uint32), np.frombuffer(b"".join(owners), np.int64)
                    numbers, owners = [], []
                now = bucket
                numbers.append(number)
                owners.append(owner)
        if numbers:
            yield now, np.frombuffer(b"".join(numbers), np.uint32), np.frombuffer(b"".join(owners), np.int64)

    def gather(batches):
        held, size = [], 0

        def flush():
            sets, counts = added(held)
            return out(list(parcels((mix(sets.astype(np.uint64)) % np.uint64(targets)).astype(np.int64), counts.astype(np.uint32), sets)))

        for run in runs(batches):
            held.append(settle(*run))
            size += len(held[-1][0])
            if size > PACK_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def total(batches):
        for _, number, owner in runs(batches):
            sets, counts = added([(owner, number)])
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(counts, pa.int64())], ["set_id", "shared"])

    packed = "bucket bigint, number binary, owner binary"
    for step in (emit, gather):
        docs = arrow_pass(docs.select(text) if step is emit else docs, step, packed).repartition("bucket").sortWithinPartitions("bucket")
    return arrow_pass(docs, total, "set_id bigint, shared bigint")


def band_keys(tokens: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The keys of a set, a list for every size band where it may meet a partner, each with how many of them to keep.

    Two linked sets of a band share at least r keys of a list: all bands but those that differ, less the empty ones. Taken
    in one order, rare keys first, the first key they share is then among the first ``K - r + 1`` of either list of K.
    """
    size = len(tokens)
    codes = mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
    lists = []
    band = bisect_right(_BANDS, size) - 1
    while 3 * _BANDS[band] <= 4 * size:
        largest = _BANDS[band + 1] - 1
        need = 2 * largest // 7 + 1
        count = need + int(np.ceil(SPARE_BANDS * need))
        part = (codes >> np.uint64(20)) % np.uint64(count)
        order = np.argsort(part, kind="stable")
        part = part[order]
        start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        odd = np.bitwise_xor.reduceat(codes[order], start)
        keys = np.unique(mix(odd ^ mix(part[start] + np.uint64(band << 40))))
        apart = (size + min(largest, 4 * size // 3)) // 7  # the most two linked sets differ here
        alike = len(keys) - apart  # at least so many bands that are not empty agree
        lists.append((len(keys) - max(alike, 1) + 1, keys.view(np.int64)))
        if alike < 1:  # agreement may fall on empty bands alone: single tokens, of which three quarters are shared
            keys = np.unique(mix(tokens + np.uint64(0x632BE59BD9B4E019 + band)))
            lists.append((len(keys) - -(-3 * size // 4) + 1, keys.view(np.int64)))
        band += 1
    return lists


def dense_sketch(tokens: np.ndarray) -> np.ndarray:
    """A parity sketch of ``DENSE`` words: every token toggles one bit."""
    bits = np.bincount((mix(tokens + np.uint64(77)) % np.uint64(64 * DENSE)).astype(np.int64), minlength=64 * DENSE) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def fold(words: np.ndarray) -> np.ndarray:
    """The parity sketch of ``FOLD`` words that a dense sketch holds: bits that lie apart by its length meet in one."""
    return np.bitwise_xor.reduce(words.reshape(-1, FOLD), axis=0)


def sketch(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row with a set: ``set_id``, ``n``, sorted ``tokens``, ``lists`` of keys, the dense ``sketch`` and its ``fold``."""

    def run(batches):
        for batch in batches:
            sets = [s for s in (shingle_set(value.as_py()) for value in batch.column(0)) if len(s)]
            def lists(arrays):
                ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays]), pa.int64()))
            banded = [band_keys(s) for s in sets]
            flat = [x for own in banded for x in own]
            inner = pa.StructArray.from_arrays([pa.array([k for k, _ in flat], pa.int32()), lists([x for _, x in flat])], ["keep", "keys"])
            outer = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, banded)]).astype(np.int32)), inner)
            dense = [dense_sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists([s.view(np.int64) for s in sets]),
                 outer, lists(dense), lists([fold(d) for d in dense])],
                ["set_id", "n", "tokens", "lists", "sketch", "fold"])

    return arrow_pass(docs.select(text), run, "set_id bigint, n bigint, tokens array<bigint>, lists array<struct<keep:int,keys:array<bigint>>>, sketch array<bigint>, fold array<bigint>")


def near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` within the size and Hamming bounds; neither rules out a link."""
    both = pairs
    for end in ("a", "b"):
        marks = sets.select(F.col("set_id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "sketch", "fold")))
        both = join_checked(both, marks, [end], "inner", BROADCAST_SKETCHES)
    return both.where(bounded()).select("a", "b")


def bounded() -> Column:
    """Whether sizes, folds and sketches, the columns that end in _a and _b, leave a link possible."""
    n_a, n_b, left, right = (F.col(c) for c in ("n_a", "n_b", "fold_a", "fold_b"))
    near = sum((F.bit_count(left[k].bitwiseXOR(right[k])) for k in range(FOLD)), F.lit(0))
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return (4 * n_a >= 3 * n_b) & (4 * n_b >= 3 * n_a) & (7 * near <= n_a + n_b) & (7 * apart <= n_a + n_b)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets link, by exact intersection."""
    tokens = sets.select("set_id", "tokens")
    left = pairs.join(tokens.withColumnsRenamed({"set_id": "a", "tokens": "ta"}), "a")
    both = left.join(tokens.withColumnsRenamed({"set_id": "b", "tokens": "tb"}), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - common
    return both.where(100 * common >= 75 * union).select("a", "b")


def linked_sets(sets: DataFrame) -> DataFrame:
    """``node`` and ``label``: components of the links among written sketches of distinct sets."""
    each = sets.select("set_id", F.posexplode("lists").alias("list", "own"))
    entries = each.select(F.explode("own.keys").alias("key"), F.col("set_id").alias("b"), "list", "own.keep", F.size("own.keys").alias("of"))
    often = entries.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    # Keys that a set alone has come first in its order and meet nobody; of the shared ones only the rarest are kept.
    own = Window.partitionBy("b", "list")
    shared = entries.join(often, "key").withColumns({"place": F.row_number().over(own.orderBy("often", "key")), "shared": F.count("*").over(own)})
    kept = cut(shared.where(F.col("place") + F.col("of") - F.col("shared") <= F.col("keep")).select("key", "b"), "near-keys")
    turn = F.xxhash64("b", F.pmod("key", F.lit(HUBS)))
    hubs = kept.groupBy("key").agg(F.min_by("b", turn).alias("a"), F.min("b").alias("low"), F.max("b").alias("high")).where("low != high").drop("low", "high")
    star = cut(kept.join(hubs, "key"), "near-stars")  # each set of a key with the key's hub
    pairs = cut(near(star.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets), "near-pairs")
    first = cut(verified(pairs, sets), "near-links")
    labels = cut(components(first), "near-labels")
    named = star
    for end in ("a", "b"):
        named = join_checked(named, labels.withColumnsRenamed({"node": end, "label": f"label_{end}"}), [end], "left")
        named = named.withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    # A key whose sets are not all in the component of its hub may hide further links.
    split = cut(named.where("label_a != label_b").select("key").distinct(), "near-split")
    held = join_checked(named, split, ["key"], "left_semi").select("key", F.col("b").alias("set_id"), F.col("label_b").alias("label"))
    held = cut(join_checked(held, sets.select("set_id", "n", "sketch", "fold"), ["set_id"], "inner", BROADCAST_SKETCHES), "near-open")
    left, right = (held.select("key", *(F.col(c).alias(f"{c}_{end}") for c in ("set_id", "n", "label", "sketch", "fold"))).alias(end) for end in ("a", "b"))
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("set_id_a") < F.col("set_id_b")) & (F.col("label_a") != F.col("label_b"))
    rest = left.join(right, apart & bounded()).select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b")).distinct()
    return components(first.union(verified(cut(rest.join(pairs, ["a", "b"], "left_anti"), "near-rest"), sets)))


def grouped(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``cluster`` with ``label``, the group's own key: numbered or not, two groups never share one."""
    rows = cut(measure(docs, text), "near-sets")
    first = F.struct(F.coalesce("doc_id", F.lit(-1)).alias("__id"), F.col("text_key").alias("__key"))
    classes = cut(rows.where("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("first"), F.min(first).alias("row"), F.first("n").alias("n"), F.first("counted").alias("counted")), "near-classes")
    tokens, found = classes.agg(F.coalesce(F.sum("counted"), F.lit(0)), F.count("*")).first()
    shared = shared_tokens(docs, 1 + tokens // BUCKET_TOKENS, 1 + found // TARGET_SETS, text)
    possible = classes.join(shared, "set_id", "left").where(F.col("counted") - F.coalesce("shared", F.lit(0)) <= F.floor(F.col("n") / 4))
    possible = cut(possible.select("set_id", "row.*"), "near-possible")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__key"), text)
    sets = cut(sketch(join_checked(keyed, possible.select("__id", "__key").distinct(), ["__id", "__key"], "left_semi"), text), "near-sketches")
    if sets.count() != possible.count():  # repeated rows
        sets = cut(sets.dropDuplicates(["set_id"]), "near-sketches")
    labels = linked_sets(sets)
    named = classes.select("set_id", "first").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    least = named.where("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("least"))
    group = named.join(least, "label", "left").select("set_id", F.coalesce("label", "set_id").alias("label"), F.coalesce("least", "first").alias("group"))
    return rows.join(group, "set_id", "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), "set_id", "label", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("group")).alias("component_id"))


def cluster(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, ``text_key``, ``n_shingles``, ``set_id`` and ``component_id``, the group's smallest doc_id."""
    return grouped(docs, text).drop("label")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``; of each group of linked documents one stays, that with the smallest doc_id (null last)."""
    rows = cut(grouped(docs, text).where("set_id IS NOT NULL").withColumnRenamed("label", "group"), "near-groups")
    # Rows of one text are in one group, so a null id may share its stand-in with a real one.
    row = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("__id"), F.col("text_key").alias("__key"))
    best = rows.groupBy("group", "set_id", row.alias("row")).agg(F.count("*").alias("copies")).groupBy("group").agg(F.min(F.struct("row", "copies")).alias("best"))
    each = rows.groupBy("group", row.alias("row")).agg(F.count("*").alias("copies")).join(best, "group")
    gone = cut(each.where(F.col("row") != F.col("best.row")).select("row.*").distinct(), "near-gone")
    again = cut(each.where((F.col("row") == F.col("best.row")) & (F.col("copies") > 1)).select("row.*").withColumn("__again", F.lit(True)).distinct(), "near-again")
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "__key": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    left = join_checked(join_checked(keyed, gone, ["__id", "__key"], "left_anti"), again, ["__id", "__key"], "left")
    once = left.where("__again IS NULL").union(left.where("__again").dropDuplicates(["__id", "__key"]))
    return once.select(*docs.columns)
