import hashlib
import random

from barloom.llm import fingerprints as fp


def test_spans_and_common_extensions():
    a, b = fp.Prefix("hello world abc"), fp.Prefix("xxworld abd")
    assert a.span(0, 6, 11) == b.span(0, 2, 7) and a.span(1, 6, 11) == b.span(1, 2, 7)
    assert fp.common_extension(a, 6, b, 2) == 8 and fp.common_extension(a, 0, b, 0) == 0


def test_spliced_equals_hashing_the_text():
    random.seed(1)
    for _ in range(50):
        x, y = ("".join(random.choices("aé漢🎉 ", k=random.randint(0, 400))) for _ in "xy")
        keep, take = random.randint(0, len(x)), random.randint(0, len(y))
        assert str(fp.spliced(fp.Prefix(x), keep, fp.Prefix(y), take)) == str(fp.fingerprint(fp.Prefix(x[:keep] + y[:take])))


def test_likeness():
    def like(x, y):
        return fp.likeness(*(fp.fingerprint(fp.Prefix(t)) for t in (x, y)))

    assert like("", "") == 1 and like("", "a") == 0 and like("abc", "abc") == 1 and like("abc", "xyz") == 0
    text = "".join(random.choices("abcdefgh", k=3000))
    assert 0.7 <= like(text, text[:2250] + "z" * 750) <= 0.75
    assert 0.9 < like(text, text[:1000] + "Z" + text[1001:]) < 1
    assert like(text, text + "b") < 1


def check(rows, got):
    ordered = sorted(((i if i is not None else -1 << 63, t or "") for i, t in rows))
    want = []
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        f, g, h = (fp.fingerprint(fp.Prefix(t)) for t in (text, edited, after))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(f), str(g), fp.likeness(f, g), fp.likeness(f, h)))
    assert sorted(((-1 << 63 if r.doc_id is None else r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_every_document_meets_the_next(spark, documents):
    random.seed(6)
    rows = [(random.randrange(10**6), "".join(random.choices("abcé漢 ", k=random.randint(0, 300)))) for _ in range(300)]
    rows += [(5, None), (6, ""), (7, "x" * 70_000), (7, "twin"), (7, "twin"), (None, "no id"), (None, None)]
    check(rows, fp.compare_with_next(documents(rows, extra=("fingerprint", "range"))).collect())


def test_few_rows(spark, documents):
    check([(3, "single document")], fp.compare_with_next(documents([(3, "single document")])).collect())
    check([(3, "a b c d"), (9, "e f g h")], fp.compare_with_next(documents([(9, "e f g h"), (3, "a b c d")])).collect())
    assert fp.compare_with_next(documents([])).count() == 0
