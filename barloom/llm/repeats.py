"""Long repeated passages by de Bruijn compaction, and documents without them.

A window of ``size`` words is an edge of the de Bruijn graph, leading from its first ``size - 1`` words to its last. An edge
that occurs twice or more is repeated, and a repeated passage is a path of repeated edges.

1. *Texts.* Equal texts form one class with a number of copies; one row of a class stands for it from here on.
2. *Seeds.* The seed of a window is its smallest run of ``GRAM`` words by hash. Equal windows have equal seeds, so only
   windows whose seed occurs twice can repeat. Neighbouring windows with one seed at one place travel as a single run.
3. *Compaction inside a seed.* If all runs of a seed read alike, they are one edge already. Otherwise every window of theirs
   is an edge of its own.
4. *Compaction by joins.* Per edge: how often it occurs, and the next edge if that is always the same. Joined back to the
   occurrences, an edge and its successor melt together if the one is always followed by the other and both occur equally
   often. Every occurrence of such a path holds it in full, so a path is found inside one text, without a walk over the graph.
5. *Verification.* Each occurrence of a path is read at its source coordinates; occurrences count as repeated only with
   others whose words are the same by SHA-256.

Edges are 64-bit numbers. Two unlike windows of one number fall apart in step 5, so nothing is removed for a collision;
a passage could only be missed if two different words of one number also stood in the same context.

Null and empty texts, and texts of fewer words than a window, have no passage and keep all words. Repeated rows are
repetitions like any other. A null doc_id is carried along. Columns beside doc_id and text are kept by ``remove`` and never
read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import arrow_pass, join_checked, join_split
from barloom.llm.words import Spans, words
from barloom.session import cut

#: Words of a window.
SIZE = 35
#: Words of a seed.
GRAM = 9
KEY = ["__k1", "__k2"]


def smallest(numbers: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        numbers = np.minimum(numbers[:-have], numbers[have:])
        have *= 2
    return np.minimum(numbers[:len(numbers) - (width - have)], numbers[width - have:]) if have < width else numbers


def seed_runs(numbers: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed, first window, number of windows and content of every run of windows with one seed."""
    count = len(numbers) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    gram = min(GRAM, size)
    span = Spans(numbers)
    grams = span(np.arange(len(numbers) - gram + 1), gram)
    seed = smallest(grams, size - gram + 1)
    # A window that begins with its seed is the last of its run: a later run of words that reads alike is another seed.
    start = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (grams[:count - 1] == seed[:-1]))))
    windows = np.diff(np.concatenate((start, [count])))
    return seed[start], start, windows, span(start, windows + size - 1)


def edges_of(numbers: np.ndarray, start: np.ndarray, windows: np.ndarray, whole: np.ndarray, size: int = SIZE):
    """Edge, next edge (0 if none follows at once), first window and windows of the given runs; runs not ``whole`` are cut into windows."""
    order = np.argsort(start)
    start, windows, whole = start[order], windows[order], whole[order]
    parts = np.where(whole, 1, windows)
    ends = np.cumsum(parts)
    begin = np.repeat(start, parts) + np.arange(ends[-1]) - np.repeat(ends - parts, parts)
    width = np.where(np.repeat(whole, parts), np.repeat(windows, parts), 1)
    edge = Spans(numbers)(begin, width + size - 1).view(np.int64)
    after = np.zeros(len(edge), np.int64)
    joined = begin[:-1] + width[:-1] == begin[1:]
    after[:-1][joined] = edge[1:][joined]
    return edge, after, begin, width


def path_borders(start: np.ndarray, windows: np.ndarray, often: np.ndarray, sole: np.ndarray) -> np.ndarray:
    """Which of a text's repeated edges, in order, begin a path."""
    first = np.ones(len(start), bool)
    first[1:] = ~((start[:-1] + windows[:-1] == start[1:]) & sole[:-1] & (often[:-1] == often[1:]))
    return first


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumns({"__k1": F.xxhash64(value), "__k2": F.xxhash64(F.lit(1), value), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))})


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per class of equal texts: its key, ``text``, ``copies``, and ``__id``, the smallest id of a row that has it."""
    keyed = _keyed(docs, text).where(F.length(text) > 0).select(*KEY, "__id", F.col(text).cast("string").alias("text"))
    rows = keyed.groupBy(*KEY, "__id").agg(F.count("*").alias("twins"))
    classes = cut(rows.groupBy(*KEY).agg(F.min(F.struct("__id", "twins")).alias("least"), F.sum("twins").alias("copies"))
                  .select(*KEY, "least.*", "copies"), "repeats-classes")
    found = join_checked(keyed, classes, [*KEY, "__id"], "inner")
    if classes.where("twins > 1").isEmpty():
        return found.drop("twins")
    return found.where("twins = 1").union(found.where("twins > 1").dropDuplicates(KEY)).drop("twins")


def _batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    arrays = [pa.array(np.concatenate([np.empty(0, kind), *parts]) if kind else parts, pa_type) for parts, kind, pa_type in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def repeated_runs(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """Per class with runs of a repeated seed: key and ``runs`` (start, windows, whole: all runs of the seed read alike)."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("__k1", "__k2", "copies", "seed", "start", "windows", "content")}
            for k1, k2, copies, text in zip(*(batch.column(k) for k in range(4))):
                seed, start, windows, content = seed_runs(words(text.as_py(), fold=False), size)
                for name, value in (("__k1", k1), ("__k2", k2), ("copies", copies)):
                    out[name].append(np.full(len(seed), value.as_py(), np.int64))
                for name, value in (("seed", seed), ("start", start), ("windows", windows), ("content", content)):
                    out[name].append(value.view(np.int64))
            yield _batch({k: (v, np.int64, pa.int64()) for k, v in out.items()})

    schema = "__k1 bigint, __k2 bigint, copies bigint, seed bigint, start bigint, windows bigint, content bigint"
    runs = cut(arrow_pass(texts.select(*KEY, "copies", "text"), run, schema), "repeats-runs")
    seeds = cut(runs.groupBy("seed").agg(F.sum("copies").alias("often"), F.min("content").alias("low"), F.max("content").alias("high"))
                .where("often > 1").select("seed", "often", (F.col("low") == F.col("high")).alias("whole")), "repeats-seeds")
    kept = join_split(runs.select(*KEY, "seed", "start", "windows"), seeds, ["seed"], "often")
    return kept.groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows", "whole")).alias("runs"), F.count("*").alias("n_runs"))


def edges(texts: DataFrame, runs: DataFrame, size: int = SIZE) -> DataFrame:
    """Occurrences of edges that may repeat: key, ``copies``, ``edge``, ``next``, ``start``, ``windows``."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("__k1", "__k2", "copies", "edge", "next", "start", "windows")}
            lists = batch.column(4)
            for row, (k1, k2, copies, text) in enumerate(zip(*(batch.column(k) for k in range(4)))):
                own = lists.slice(row, 1).flatten()
                start, windows, whole = (own.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                found = edges_of(words(text.as_py(), fold=False), start, windows, whole, size)
                for name, value in (("__k1", k1), ("__k2", k2), ("copies", copies)):
                    out[name].append(np.full(len(found[0]), value.as_py(), np.int64))
                for name, value in zip(("edge", "next", "start", "windows"), found):
                    out[name].append(value)
            yield _batch({k: (v, np.int64, pa.int64()) for k, v in out.items()})

    both = join_split(texts.select(*KEY, "copies", "text"), runs.withColumn("__one", F.lit(1)), KEY, "__one", cells="n_runs").drop("n_runs")
    return arrow_pass(both, run, "__k1 bigint, __k2 bigint, copies bigint, edge bigint, next bigint, start bigint, windows bigint")


def paths(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """Occurrences of compacted paths: key, ``copies``, ``path``, ``start`` and ``windows`` in words, and the ``digest`` of its words."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("__k1", "__k2", "copies", "path", "start", "windows")}
            digests = []
            lists = batch.column(4)
            for row, (k1, k2, copies, text) in enumerate(zip(*(batch.column(k) for k in range(4)))):
                own = lists.slice(row, 1).flatten()
                start, windows, edge, often, sole = (own.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                order = np.argsort(start)
                start, windows, edge, often, sole = (x[order] for x in (start, windows, edge, often, sole))
                first = np.flatnonzero(path_borders(start, windows, often, sole))
                begin, end = start[first], (start + windows)[np.concatenate((first[1:], [len(start)])) - 1]
                found = text.as_py().encode("utf-8", "replace").split()
                digests += [hashlib.sha256(b" ".join(found[a:b + size - 1])).digest() for a, b in zip(begin.tolist(), end.tolist())]
                for name, value in (("__k1", k1), ("__k2", k2), ("copies", copies)):
                    out[name].append(np.full(len(first), value.as_py(), np.int64))
                for name, value in (("path", edge[first]), ("start", begin), ("windows", end - begin)):
                    out[name].append(value)
            yield _batch({**{k: (v, np.int64, pa.int64()) for k, v in out.items()}, "digest": (digests, None, pa.binary())})

    runs = cut(repeated_runs(texts, size), "repeats-seeded")
    found = cut(edges(texts, runs, size), "repeats-edges")
    stats = found.groupBy("edge").agg(F.sum("copies").alias("often"), F.min("next").alias("low"), F.max("next").alias("high")).where("often > 1")
    stats = cut(stats.select("edge", "often", F.col("often").alias("rows"), ((F.col("low") == F.col("high")) & (F.col("low") != 0)).alias("sole")), "repeats-stats")
    held = join_split(found.select(*KEY, "edge", "start", "windows"), stats, ["edge"], "rows")
    per_text = cut(held.groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows", "edge", "often", "sole")).alias("edges"), F.count("*").alias("n_edges")), "repeats-held")
    both = join_split(texts.select(*KEY, "copies", "text"), per_text.withColumn("__one", F.lit(1)), KEY, "__one", cells="n_edges").drop("n_edges")
    return arrow_pass(both, run, "__k1 bigint, __k2 bigint, copies bigint, path bigint, start bigint, windows bigint, digest binary")


def repeats(docs: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """Verified occurrences of repeated passages: class key, ``copies`` of the class, ``digest`` of the passage, ``often`` (its
    occurrences, copies included), ``start`` and ``words``. Passages may overlap by up to ``size - 1`` words where paths meet."""
    spans = cut(paths(distinct_texts(docs, text), size), "repeats-paths")
    verified = cut(spans.groupBy("digest").agg(F.sum("copies").alias("often")).where("often > 1").withColumn("rows", F.col("often")), "repeats-verified")
    return join_split(spans, verified, ["digest"], "rows").select(*KEY, "copies", "digest", "often", "start", (F.col("windows") + (size - 1)).alias("words"))


def remove(docs: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """All columns of ``docs`` with ``text`` reduced to the kept words, joined by one space, and ``n_words`` and ``n_removed``.

    A word goes if a window that repeats covers it; windows are judged on the input.
    """
    spans = cut(repeats(docs, text, size), "repeats-spans")
    narrow = cut(spans.groupBy(*KEY, "copies").agg(F.collect_list(F.struct("start", "words")).alias("__spans"), F.count("*").alias("__n")), "repeats-covered")

    def run(batches):
        for batch in batches:
            count, gone, kept = [], [], []
            lists = batch.column(batch.num_columns - 1)
            for row, value in enumerate(batch.column(at)):
                found = (value.as_py() or "").encode("utf-8", "replace").split()
                count.append(len(found))
                own = lists.slice(row, 1)
                if own.null_count:
                    gone.append(0)
                    kept.append(b" ".join(found))
                    continue
                start, size = (own.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
                change = np.bincount(start, minlength=len(found) + 1) - np.bincount(start + size, minlength=len(found) + 1)
                stays = np.cumsum(change[:-1]) == 0
                gone.append(len(found) - int(stays.sum()))
                kept.append(b" ".join([found[k] for k in np.flatnonzero(stays)]))
            arrays = [batch.column(k) for k in range(batch.num_columns - 1)]
            arrays[at] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(count, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_words", "n_removed"])

    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    at = names.index(text)
    keyed = _keyed(docs.select(*names), text).drop("__id")
    both = join_split(keyed, narrow, KEY, "copies", "left", "__n").select(*names, "__spans")
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields} | {text: "string"}
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", n_words bigint, n_removed bigint"
    return arrow_pass(both, run, schema)
