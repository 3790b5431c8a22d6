"""Spelling variants: words one edit apart, found by pivotal grams, and grouped under their commonest form.

1. *Words.* Runs of letters are counted over all texts; counts are added up per task before they are shuffled.
2. *Prefixes.* Bigrams have one global order, rare ones first. The prefix of a word is its three rarest bigrams, with all
   that tie with the third. One edit destroys two bigrams at most.
3. *Pivots.* Two disjoint bigrams of the prefix. An edit destroys one of them at most: it lies either right of the first, so
   the word reads alike from its start through the first pivot, or left of the second, so it reads alike from the second
   pivot to its end. Of two near words, the pivots of the one with the rarer prefix are found in the other's prefix.
4. *Choice.* Which two is a dynamic program over positions: the first pivot costs the entries of the index that start
   alike, the second those that end alike; the running minimum of first pivots meets every second one.
5. *Join.* Pivots meet prefixes by bigram, position and the text on the intact side, all one key, and by lengths at most one
   apart. What lies between the pivots belongs to the dearer side: it must read alike there, too, which a byte comparison
   tells before the edit distance is verified. A key is met by few words, as rarer pivots have shorter lists.
6. *Forms.* Each word points to its commonest near word if that is ten times as frequent; chains are followed by pointer
   doubling. Their length is at most the decimal logarithm of the largest count.

Words are counted from a text's letters; null or empty texts have none. A null doc_id counts as an empty one. Repeated rows
count again. Texts of any length are read in parts. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import arrow_pass
from barloom.session import cut

LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_CHARS = 7
MIN_COUNT = 2
#: How much more frequent a form is than its variant.
RATIO = 10
#: One in so many runs loses a letter.
TYPOS = 31
#: Characters of a text taken at once, and distinct words held by a task.
PART = 1 << 20
HELD = 200_000
#: Bigrams of a prefix: one edit destroys two.
PREFIX = 3


def runs_of(text: str, letters: re.Pattern):
    """Counts of the runs of a lower-cased text, part by part; no run is cut."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PART)
        inside = letters.match(text, end)
        if inside and letters.match(text, end - 1):
            end = inside.end()
        yield Counter(letters.findall(text, at, end))
        at = end


def word_counts(docs: DataFrame, text: str = "text", typos: int = TYPOS) -> DataFrame:
    """``word`` and ``n`` of every word of at least ``MIN_CHARS`` code points; one run in ``typos`` loses one of its letters."""

    def run(batches):
        letters, counts = re.compile(LETTERS), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1)):
                whole = (value.as_py() or "").encode("utf-8", "replace").lower().decode()  # bytes: only A-Z change
                start = zlib.crc32(f"{'' if doc.as_py() is None else doc.as_py()}:".encode())
                for part in runs_of(whole, letters):
                    for word, n in part.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % typos == 0:
                            gone = h % len(word)
                            word = word[:gone] + word[gone + 1:]
                        if len(word) >= MIN_CHARS:
                            counts[word] += n
                    if len(counts) >= HELD:
                        yield out()
                        counts.clear()
        if counts:
            yield out()

    return arrow_pass(docs.select("doc_id", F.col(text).cast("string")), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def gram_order(words: DataFrame) -> dict[str, int]:
    """Rank of every bigram, rarest first. Bounded by the square of the alphabet, 90 letters."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    found = words.where(F.length("word") > 1).select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").count().collect()
    return {g: k for k, (g, _) in enumerate(sorted(found, key=lambda r: (r[1], r[0])))}


def prefix(word: str, rank: dict[str, int]) -> list[int]:
    """Places of the rarest bigrams: ``PREFIX`` of them and all ties."""
    ranks = [rank[word[k:k + 2]] for k in range(len(word) - 1)]
    last = sorted(ranks)[:PREFIX][-1]
    return [k for k, r in enumerate(ranks) if r <= last]


def pivots(places: list[int], heads: list[int], tails: list[int]) -> tuple[int, int]:
    """The two disjoint places of least cost: ``heads`` is the cost of a place as first pivot, ``tails`` as second."""
    best = None
    first, at = None, 0  # cheapest first pivot among places[:at]
    for k, place in enumerate(places):
        while places[at] + 2 <= place:
            if first is None or heads[at] < heads[first]:
                first = at
            at += 1
        if first is not None and (best is None or heads[first] + tails[k] < best[0]):
            best = heads[first] + tails[k], places[first], place
    return best[1], best[2]


def indexed(words: DataFrame) -> DataFrame:
    """The prefix entries of every word: ``word``, ``n``, ``size``, ``place`` and its keys ``head`` and ``tail``.

    ``head`` is the word up to and with the bigram, ``tail`` the word from the bigram on: each stands for bigram and position.
    """
    rank = gram_order(words)

    def run(batches):
        for batch in batches:
            rows = [(w, n, len(w), k, w[:k + 2], w[k:]) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k in prefix(w, rank)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))],
                ["word", "n", "size", "place", "head", "tail"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, size int, place int, head string, tail string")


def chosen(entries: DataFrame) -> DataFrame:
    """Per word its two keys, ``head`` of the first pivot and ``tail`` of the second, and the two parts ``left`` and
    ``right`` it falls into between them: an edit leaves one of the parts as it is."""

    def run(batches):
        for batch in batches:
            words, sizes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            heads, tails, cuts = [], [], []
            for word, entries in zip(words, batch.column(3).to_pylist()):
                entries.sort(key=lambda e: e["place"])
                first, second = pivots(*([e[c] for e in entries] for c in ("place", "h", "t")))
                heads.append(word[:first + 2])
                tails.append(word[second:])
                cost = {e["place"]: e for e in entries}
                cuts.append(second if cost[first]["h"] >= cost[second]["t"] else first + 2)
            text = [pa.array(c, pa.string()) for c in (heads, tails, [w[:k] for w, k in zip(words, cuts)], [w[k:] for w, k in zip(words, cuts)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), *text], ["word", "n", "size", "head", "tail", "left", "right"])

    priced = entries
    for side, cost in (("head", "h"), ("tail", "t")):
        priced = priced.join(entries.groupBy(side, "size").agg(F.count("*").alias(cost)), [side, "size"])
    per_word = priced.groupBy("word", "n", "size").agg(F.collect_list(F.struct("place", "h", "t")).alias("entries"))
    return per_word.mapInArrow(run, "word string, n bigint, size int, head string, tail string, left string, right string")


def near_words(words: DataFrame) -> DataFrame:
    """Pairs of words of exactly one edit, each once: ``a``, ``n_a``, ``b``, ``n_b``. ``words`` is a written table of words of three letters or more."""
    entries = cut(indexed(words), "spelling-prefixes")
    keys = cut(chosen(entries), "spelling-pivots")
    found = None
    for side, part, alike in (("head", "left", F.startswith), ("tail", "right", F.endswith)):
        pivot = keys.select(F.col("word").alias("p"), F.col("n").alias("n_p"), side, part, F.explode(F.array(*(F.col("size") + k for k in (-1, 0, 1)))).alias("size"))
        other = entries.select(F.col("word").alias("q"), F.col("n").alias("n_q"), side, "size").distinct()
        both = pivot.join(other, (pivot[side] == other[side]) & (pivot["size"] == other["size"]) & alike(F.col("q"), F.col(part)) & (F.levenshtein("p", "q", 1) == 1))
        rows = both.select(
            F.least("p", "q").alias("a"), F.when(F.col("p") < F.col("q"), F.col("n_p")).otherwise(F.col("n_q")).alias("n_a"),
            F.greatest("p", "q").alias("b"), F.when(F.col("p") < F.col("q"), F.col("n_q")).otherwise(F.col("n_p")).alias("n_b"))
        found = rows if found is None else found.union(rows)
    return found.distinct()


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per word: ``n``, ``n_near``, ``form`` and ``form_n`` (null if no near word is ``RATIO`` times as frequent)."""
    both = pairs.select("a", "b", "n_b").union(pairs.select("b", "a", "n_a")).toDF("word", "other", "other_n")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    often = -F.col("best.minus") >= RATIO * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.other")).alias("form"), F.when(often, -F.col("best.minus")).alias("form_n"))


def with_roots(named: DataFrame) -> DataFrame:
    """``root``: the last word of the chain of forms; the word itself if it has none. ``named`` is a written table."""
    most = named.agg(F.max("n")).first()[0] or 1
    chains = named.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, math.log10(most)))) + 1):
        chains = cut(chains, "spelling-roots")
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chains = chains.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return named.join(chains, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, text: str = "text", typos: int = TYPOS) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    words = cut(word_counts(docs, text, typos).where(F.col("n") >= MIN_COUNT), "spelling-words")
    pairs = cut(near_words(words), "spelling-pairs")
    return with_roots(cut(forms(words, pairs), "spelling-forms")).select("word", "form", "root", "n", "n_near", "form_n")
