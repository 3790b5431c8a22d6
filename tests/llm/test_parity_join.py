import random
import re

from barloom.llm import parity_join
from barloom.llm.components import components
from barloom.llm.words import shingle_set, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text):
    w = WORD.findall((text or "").translate(UPPER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def groups(rows):
    """Smallest id reachable by links, all pairs compared."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(label[k], []).append(i)
    return [min((i for i in ids[label[k]] if i is not None), default=None) for k in range(len(rows))]


def corpus(seed, n=60):
    """Texts with near copies close to the threshold, shared passages and very short texts."""
    random.seed(seed)
    vocabulary = [f"W{i}é" for i in range(400)]
    passage = random.choices(vocabulary, k=60)
    texts = []
    for k in range(n):
        if texts and random.random() < 0.5:
            w = random.choice(texts).split()
            for _ in range(random.randint(0, max(1, len(w) // 30))):
                if w:
                    w[random.randrange(len(w))] = random.choice(vocabulary)
            if random.random() < 0.3:
                w = w[:int(len(w) * random.uniform(0.7, 1))]
        else:
            w = random.choices(vocabulary, k=random.choice([1, 3, 4, 5, 6, 9, 40, 150]))
            if random.random() < 0.4:
                w = w + passage
        texts.append(" ".join(w))
    return texts


def test_words_and_shingles():
    assert len(words(" a b\tC\x0bd \n")) == 3  # a no-break space is no separator
    assert (words("THE cat") == words("the CAT")).all() and (words("É") != words("é")).all()
    for text in ("", None, "one", "a b c d", "a b c d e", "a b c d e f a b c d e"):
        assert len(shingle_set(text)) == len(shingles(text))


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    whole = words(text)
    monkeypatch.setattr("barloom.llm.words.PART", 1000)
    assert (words(text) == whole).all()


def test_groups_equal_all_pairs(spark, documents):
    for seed in (1, 2):
        rows = [*enumerate(corpus(seed)), (900, ""), (901, None), (902, " \n"), (903, "")]
        rows += [(7, rows[7][1]), (None, rows[20][1]), (None, "alone in its own words here today")]
        got = parity_join.cluster(documents(rows, extra=("n", "set_id", "component_id"))).collect()
        key = lambda i, text: (str(i), len(shingles(text)))
        want = sorted((*key(i, t), str(c)) for (i, t), c in zip(rows, groups(rows)))
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_bound_rules_out_sets_well_below_the_threshold(spark, documents):
    base = [f"w{i}" for i in range(399)]
    rows = [(k, " ".join(base[:keep] + [f"x{k}-{i}" for i in range(399 - keep)])) for k, keep in enumerate((399, 350, 329))]  # likeness to the first: 0.78, 0.70
    sets = parity_join.sketch(documents(rows)).cache()
    ids = [parity_join.set_id(shingle_set(text)) for _, text in rows]
    pairs = spark.createDataFrame([(ids[0], ids[1]), (ids[0], ids[2])], "a long, b long")
    assert [tuple(r) for r in parity_join.near(pairs, sets).collect()] == [(ids[0], ids[1])]


def test_one_of_each_group_stays(spark, documents):
    rows = [*enumerate(corpus(3)), (900, ""), (901, None), (901, None)]
    rows += [(0, rows[0][1]), (0, rows[0][1])]
    docs = documents(rows, extra=("group", "best"))
    got = parity_join.keep_one(docs)
    assert got.columns == docs.columns
    named = groups(rows)
    want = {g for g, (_, t) in zip(named, rows) if shingles(t)}
    kept = [r.doc_id for r in got.collect()]
    assert sorted(kept) == sorted([*want, 900, 901, 901])


def test_groups_without_ids_stay_apart(spark, documents):
    texts = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcde"}
    near = texts["a"] + " a40"
    rows = [(None, texts["a"]), (None, near), (None, texts["b"]), (None, texts["b"]), (-1, texts["c"]), (None, texts["d"]), (5, texts["d"]), (None, texts["e"]), (-1, texts["e"])]
    kept = parity_join.keep_one(documents(rows)).collect()
    assert sorted(r.text[0] for r in kept) == list("abcde")
    assert {r.text[0]: r.doc_id for r in kept if r.text[0] in "cd"} == {"c": -1, "d": 5}


def test_components(spark):
    random.seed(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 5), (8, 8), (7, 5)]
    random.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3, 7: 3}


def test_empty_table(spark, documents):
    assert parity_join.cluster(documents([])).count() == 0 and parity_join.keep_one(documents([])).count() == 0
    assert parity_join.cluster(documents([(1, "")])).first().component_id == 1
