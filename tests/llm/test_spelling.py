"""Pivotal grams against comparing every two words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from barloom.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1:] == b[k + 1:] or a[k:] == b[k + 1:] or a[k + 1:] == b[k:]


def counted(rows, typos):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % typos == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def brute(rows, typos=31):
    words = counted(rows, typos)
    near = {w: set() for w in words}
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def edited(rng, word, letters):
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1:], word[:k] + rng.choice(letters) + word[k:], word[:k] + rng.choice(letters) + word[k + 1:]])


@pytest.mark.parametrize("letters, typos", [("abcdefghijklmnopqrstuvwxyzé", 31), ("ab", 5), ("abcÀÿß×", 3)])
def test_against_all_pairs(documents, letters, typos):
    rng = random.Random(len(letters))
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(60)]
    pool = base * 40 + [edited(rng, w, letters) for w in base for _ in range(12)] * 2 + [edited(rng, edited(rng, w, letters), letters) for w in base for _ in range(6)] * 2
    rng.shuffle(pool)
    rows = [(k, rng.choice([" ", "-", "\n1"]).join(pool[k::40])) for k in range(40)]
    rows += [(None, " ".join(base[:9]).upper()), (None, None), (77, ""), (77, "12 ... "), (3, rows[3][1])]
    docs = documents(rows, ("word", "n", "size"))
    got = [tuple(r) for r in spelling.variants(docs, typos=typos).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, typos)


def test_empty_tables(documents):
    assert spelling.variants(documents([])).count() == 0
    assert spelling.variants(documents([(1, None), (2, "short words"), (3, "onceonly")])).count() == 0


def test_long_texts_are_read_in_parts(documents, monkeypatch):
    letters = re.compile(spelling.LETTERS)
    text = " ".join("x" * k for k in range(1, 90))
    whole = Counter(letters.findall(text))
    for part in (1, 7, 50, 10**6):
        monkeypatch.setattr(spelling, "PART", part)
        assert sum(spelling.runs_of(text, letters), Counter()) == whole


def test_chain_of_forms(documents):
    rows = [(1, " ".join(["abcdefg"] * 400 + ["abcdefgh"] * 40 + ["abcdefghi"] * 4))]
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variants(documents(rows), typos=10**12).collect()}
    assert got == {"abcdefg": (None, "abcdefg", 1, None), "abcdefgh": ("abcdefg", "abcdefg", 2, 400), "abcdefghi": ("abcdefgh", "abcdefg", 1, 40)}


def test_two_disjoint_pivots_of_least_cost():
    assert spelling.pivots([0, 1, 2], [5, 1, 1], [1, 1, 9]) == (0, 2)
    assert spelling.pivots([0, 3, 4, 8], [9, 1, 1, 1], [1, 1, 7, 5]) == (3, 8)
