"""Benchmark decontamination by greedy string tiling over words.

Shared five-word seeds name the candidate pairs of document and benchmark item. For each pair, running Karp-Rabin finds
the longest match of unmarked words and marks it on both sides, again and again, until none of at least five words is
left. The marked share of the item's words is its coverage: tiles may lie in any order, so reordered passages count, and
no word counts twice. A document leaks an item whose coverage reaches the threshold.

The benchmark is read in blocks of a fixed number of words, each broadcast to one pass over all documents, so its size is
bounded whatever the benchmark holds. Documents are never shuffled and never cut.

Case, accented letters included, and ASCII punctuation are ignored. Null or empty texts match nothing. Items of fewer than five words are seeded and tiled whole. Repeated documents are
reported each; repeated items with equal ids count once. Null item ids are kept. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import arrow_pass, join_checked
from barloom.llm.words import PLAIN, SHINGLE, mix, powers, windows, words
from barloom.session import cut

#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Words of the benchmark held by one pass (8 bytes each, and as much again for seeds).
BLOCK_WORDS = 2_000_000
#: Slots of the first, inexact test of a seed.
SLOTS = 1 << 22


def tiles(item: np.ndarray, doc: np.ndarray, least: int = SHINGLE) -> list[tuple[int, int, int]]:
    """Non-overlapping matches (place in item, place in doc, words), longest first, none shorter than ``least``."""
    sums_i, sums_d = np.zeros(len(item) + 1, np.uint64), np.zeros(len(doc) + 1, np.uint64)
    for sums, x in ((sums_i, item), (sums_d, doc)):
        np.cumsum(x * powers(len(x) + 1)[0][:len(x)], out=sums[1:])
    down = powers(max(len(item), len(doc)) + 1)[1]
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)

    def rolling(sums, free, size):
        """Places whose next ``size`` words are unmarked, and the Karp-Rabin hash of each."""
        taken = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(taken[size:] == taken[:-size])
        return at, (sums[at + size] - sums[at]) * down[at]

    def common(size):
        if size > len(item) or size > len(doc):
            return None
        at_i, hash_i = rolling(sums_i, free_i, size)
        at_d, hash_d = rolling(sums_d, free_d, size)
        hit = np.isin(hash_d, hash_i)
        return (at_i, hash_i, at_d[hit], hash_d[hit]) if hit.any() else None

    found, high = [], min(len(item), len(doc))
    while True:
        low, best = least, common(least)
        if best is None:
            return found
        while low < high:  # a common run of n words holds one of n - 1: search the longest
            middle = (low + high + 1) // 2
            got = common(middle)
            if got is None:
                high = middle - 1
            else:
                low, best = middle, got
        at_i, hash_i, at_d, hash_d = best
        places = defaultdict(list)
        for place, value in zip(at_i[::-1].tolist(), hash_i[::-1].tolist()):
            places[value].append(place)
        for place, value in zip(at_d.tolist(), hash_d.tolist()):
            stack = places[value]
            while stack and not free_i[stack[-1]:stack[-1] + low].all():
                stack.pop()
            if stack and free_d[place:place + low].all():
                start = stack.pop()
                free_i[start:start + low] = False
                free_d[place:place + low] = False
                found.append((start, place, low))
        high = low


def _seeds(found: np.ndarray) -> np.ndarray:
    return windows(found, min(SHINGLE, len(found))) if len(found) else found


class Block:
    """A bounded part of the benchmark with its seeds in order."""

    def __init__(self, ids: list, found: list[np.ndarray]) -> None:
        self.ids, self.words = ids, found
        seeds = [_seeds(x) for x in found]
        seed = np.concatenate(seeds)
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.item = np.repeat(np.arange(len(found)), [len(x) for x in seeds])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in seeds])[order]
        self.sizes = sorted({min(SHINGLE, len(x)) for x in found})
        self.slots = np.zeros(SLOTS // 8, np.uint8)
        slot = (self.seed % np.uint64(SLOTS)).astype(np.int64)
        np.bitwise_or.at(self.slots, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))

    def matches(self, text: str | None, least: float):
        """(item id, coverage, tiles, longest tile) of items whose coverage is at least ``least``."""
        doc = words((text or "").lower(), PLAIN)
        for size in self.sizes:
            seed = windows(doc, size)
            slot = (seed % np.uint64(SLOTS)).astype(np.int64)
            maybe = np.flatnonzero(self.slots[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            if not len(maybe):
                continue
            first, last = np.searchsorted(self.seed, seed[maybe], "left"), np.searchsorted(self.seed, seed[maybe], "right")
            hit = last > first
            places = maybe[hit]
            if not len(places):
                continue
            # Items by seed; a seed that the document repeats names its items once.
            spans = {(a, b) for a, b in zip(first[hit].tolist(), last[hit].tolist())}
            covered = defaultdict(list)
            for a, b in spans:
                for k in range(a, b):
                    covered[int(self.item[k])].append(int(self.place[k]))
            near = None
            for item, starts in covered.items():
                want = self.words[item]
                if min(SHINGLE, len(want)) != size:
                    continue
                mark = np.zeros(len(want), bool)
                for k in range(size):
                    mark[np.array(starts) + k] = True
                if mark.mean() < least:  # tiles lie within the seeds
                    continue
                if near is None:
                    near = _near(doc, places, size)
                found = tiles(want, near, size)
                share = sum(n for *_, n in found) / len(want)
                if share >= least:
                    yield self.ids[item], share, len(found), max(n for *_, n in found)


def _near(doc: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The words that seeds cover, with a word that no item has between separate stretches."""
    keep = np.zeros(len(doc), bool)
    for k in range(size):
        keep[places + k] = True
    at = np.flatnonzero(keep)
    breaks = np.flatnonzero(np.diff(at) > 1) + 1
    return np.insert(doc[at], breaks, mix(np.arange(1, len(breaks) + 1, dtype=np.uint64)))


def _pass(docs: DataFrame, block: Block, text: str, least: float, item_type: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)
    kind = pa.string() if item_type == "string" else pa.int64()

    def run(batches):
        for batch in batches:
            rows = [(i, *found) for i, value in enumerate(batch.column(2)) for found in sent.value.matches(value.as_py(), least)]
            at, item, share, count, longest = zip(*rows) if rows else ((),) * 5
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(item, kind), pa.array(share, pa.float64()), pa.array(count, pa.int64()), pa.array(longest, pa.int64())],
                ["doc_id", "text_key", "item_id", "coverage", "tiles", "longest"])

    key = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key")
    return arrow_pass(docs.select(F.col("doc_id").cast("long"), key, text), run, f"doc_id bigint, text_key bigint, item_id {item_type}, coverage double, tiles bigint, longest bigint")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """doc_id, ``text_key``, item_id, ``coverage``, ``tiles``, ``longest``: one row per leaked item and document row."""
    item_type = "string" if dict(benchmark.dtypes)["item_id"] == "string" else "bigint"
    passes, ids, found, size = [], [], [], 0
    for row in benchmark.select(F.col("item_id").cast(item_type), F.col("text")).distinct().toLocalIterator():
        item = words((row[1] or "").lower(), PLAIN)
        if len(item):
            ids.append(row[0])
            found.append(item)
            size += len(item)
        if size >= BLOCK_WORDS:
            passes.append(_pass(docs, Block(ids, found), text, coverage, item_type))
            ids, found, size = [], [], 0
    if found or not passes:
        block = Block(ids, found) if found else Block([None], [np.array([0], np.uint64)])
        passes.append(_pass(docs if found else docs.limit(0), block, text, coverage, item_type))
    return reduce(DataFrame.union, passes)


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` but the documents that leak an item."""
    found = leaks(docs, benchmark, coverage, text)
    gone = cut(found.select(F.coalesce(F.col("doc_id"), F.lit(-1)).alias("__id"), F.col("text_key").alias("__key")).distinct(), "leaks")
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__key": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    return join_checked(keyed, gone, ["__id", "__key"], "left_anti").select(*docs.columns)
