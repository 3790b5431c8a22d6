import random

from barloom.llm import tiling
from barloom.llm.words import words


def brute(item, doc, least):
    """Greedy tiling by comparing every place with every other."""
    free_i, free_d, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and free_i[i + k] and free_d[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        n, i, j = best
        if n < least:
            return total
        for k in range(n):
            free_i[i + k] = free_d[j + k] = False
        total += n


def test_tiles_cover_as_much_as_brute_force():
    random.seed(2)
    for _ in range(40):
        item = random.choices("abcdefgh", k=random.randint(5, 25))
        doc = random.choices("abcdefgh", k=20) + item[10:] + ["z"] + item[:10]
        found = tiling.tiles(words(" ".join(item)), words(" ".join(doc)), 3)
        for (i, j, n) in found:
            assert item[i:i + n] == doc[j:j + n]
        assert len({i + k for i, _, n in found for k in range(n)}) == sum(n for *_, n in found) == brute(item, doc, 3)


ITEM = " ".join(f"q{i}" for i in range(30))
SHORT = "only three words"


def leaks(spark, documents, rows, extra=()):
    bench = spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "x"), (2, SHORT, "x"), (3, None, "x"), (4, "", "x"), (None, "five words are in here", "x")], "item_id long, text string, coverage string")
    return tiling.leaks(documents(rows, extra), bench)


def test_leaks(spark, documents):
    part = ITEM.split()
    rows = [
        (0, ""), (1, None), (2, "clean text of no item at all"), (3, "pre " + ITEM.upper() + " post"),
        (4, " ".join(part[20:] + ["x"] + part[10:20] + ["y"] + part[:10])), (5, " ".join(part[:12])), (6, "a b only three words c"),
        (7, ITEM + " " + ITEM), (7, ITEM + " " + ITEM), (None, ITEM), (8, "five words are in here"), (9, "w " * 200_000 + ITEM),
        (10, " ".join(x + " filler" for x in part)), (11, "(" + ITEM.replace(" ", ",  ") + ".)"),
    ]
    got = [(r.doc_id, r.item_id, r.coverage) for r in leaks(spark, documents, rows, ("item_id", "coverage")).collect()]
    want = [(3, 1, 1.0), (4, 1, 1.0), (6, 2, 1.0), (7, 1, 1.0), (7, 1, 1.0), (None, 1, 1.0), (8, None, 1.0), (9, 1, 1.0), (11, 1, 1.0)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_small_blocks_find_the_same(spark, documents, monkeypatch):
    rows = [(3, ITEM), (6, SHORT + " end"), (8, "five words are in here")]
    whole = sorted(map(str, leaks(spark, documents, rows).collect()))
    monkeypatch.setattr(tiling, "BLOCK_WORDS", 1)
    assert sorted(map(str, leaks(spark, documents, rows).collect())) == whole


def test_decontaminate_keeps_the_rest(spark, documents):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = documents([(1, ITEM), (2, "clean"), (None, None), (2, "clean")], extra=("item_id", "text_key"))
    got = tiling.decontaminate(docs, bench)
    assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == ["2", "2", "None"]
    assert tiling.decontaminate(docs, bench.limit(0)).count() == 4 and tiling.decontaminate(docs.limit(0), bench).count() == 0
