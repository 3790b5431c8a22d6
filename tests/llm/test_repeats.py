"""Passages found by compaction against a plain look at every window."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import repeats
from barloom.llm.common import digest

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, size):
    """(words, removed, kept text) of each text."""
    split = [BLANKS.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = {k for i in range(len(w) - size + 1) if seen[tuple(w[i:i + size])] > 1 for k in range(i, i + size)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def compare(documents, texts, size):
    docs = documents(list(enumerate(texts)), ("n_words", "__spans_of"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in repeats.remove(docs, size=size).collect()}
    assert got == dict(enumerate(brute(texts, size)))
    return got


@pytest.mark.parametrize("seed", range(4))
def test_against_every_window(documents, seed):
    rng = random.Random(seed)
    letters = ["a", "b", "A", "é", "ccc"] if seed % 2 else [f"w{k}" for k in range(300)]
    passages = [[rng.choice(letters) for _ in range(rng.randint(5, 40))] for _ in range(4)]
    texts = []
    for _ in range(30):
        words = [rng.choice(letters) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted(rng.randrange(len(p) + 1) for _ in range(2))
            at = rng.randint(0, len(words))
            words[at:at] = p[a:b]
        texts.append(rng.choice([" ", "\t\n", "\x0b "]).join(words))
    texts += [None, "", " \n", texts[0], "a " * 60, "one two three", "one two three", "   nbsp is a word  "]
    got = compare(documents, texts, 12 if seed > 1 else 5)
    assert any(removed for _, removed, _ in got.values())


def test_windows_of_35_words(documents):
    rng = random.Random(9)
    def some(n):
        return [f"{rng.randrange(10**6)}" for _ in range(n)]
    shared, just, short = some(80), some(35), some(34)
    texts = [" ".join(some(20) + p + some(30)) for p in (shared, shared, shared[:60], just, just, short, short)] + [" ".join(just)] * 3
    texts.append(" ".join(just + some(3) + just))  # twice in one document
    texts.append(" ".join(some(40_000)))
    got = compare(documents, texts, 35)
    assert [got[k][1] for k in range(8)] == [80, 80, 60, 35, 35, 0, 0, 35]


def test_hot_keys_meet_by_shuffle(documents, monkeypatch):
    monkeypatch.setattr(repeats, "join_split", lambda *a, **k: split(*a, **k, limit=0))
    from barloom.llm.common import join_split as split
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(50))
    texts = [f"{rng.random()} {passage} {rng.random()}" for _ in range(200)] + [passage] * 100 + ["nothing here " + str(k) for k in range(50)]
    compare(documents, texts, 35)


def test_repeated_rows_null_ids_and_empty_table(documents):
    text = " ".join(map(str, range(50)))
    docs = documents([(None, text), (None, text), (None, "a b c"), (7, text + " tail"), (7, text + " tail"), (None, None)])
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.text) for r in repeats.remove(docs).collect())
    assert got == [(-1, 0, 0, ""), (-1, 3, 0, "a b c"), (-1, 50, 50, ""), (-1, 50, 50, ""), (7, 51, 51, ""), (7, 51, 51, "")]
    assert repeats.remove(docs.limit(0)).count() == 0


def test_paths_are_maximal_and_verified(documents):
    passage = [f"p{k}" for k in range(60)]
    docs = documents([(0, " ".join(["x"] + passage + ["y"])), (1, " ".join(["u"] + passage + ["v"])), (2, " ".join(["q"] + passage[10:50]))])
    found = repeats.repeats(docs).collect()
    # Two branches: where the third text enters and where it leaves.
    assert {(r.often, r.words) for r in found} == {(2, 44), (3, 40), (2, 44)} and len(found) == 7
    assert {bytes(r.digest) for r in found if r.often == 3} == {hashlib.sha256(" ".join(passage[10:50]).encode()).digest()}


def test_least_of_neighbours():
    values = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for width in (1, 2, 3, 5, 27, 50):
        assert repeats.smallest(values, width).tolist() == [min(values[k:k + width]) for k in range(51 - width)]
