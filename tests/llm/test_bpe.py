import random

import public_tokenizers
import pytest
import tiktoken

from barloom.llm import bpe, token_counts

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", None, "This is text.", "thingeron" * 3000, "aaaa" * 999, "  \n\t x 　y  ", "漢字 🎉 é́", "<|endoftext|>", "a'll B'S 12,345", "dup", "dup"]


@pytest.fixture(scope="module")
def vocabulary():
    v = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    v.prepare()
    return v


def test_merge_follows_rank_then_place(vocabulary):
    random.seed(5)
    for n in (2, 3, 7, 30, 400):
        for letters in ("ab", "aé漢🎉", "thingero", " \n\tx"):
            piece = "".join(random.choices(letters, k=n)).encode()
            want = [RANKS[piece]] if piece in RANKS else TIKTOKEN._core_bpe.encode_single_piece(piece)
            if piece not in RANKS:
                assert vocabulary.merge([b"zq", piece, b"qz"])[1] == want


def test_texts_encode_as_the_library_and_decode_back(spark, documents):
    docs = documents(list(enumerate(TEXTS)), extra=("ids", "n_tokens", "decoded"))
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in bpe.decode(encoded, RANKS).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i].ids == TIKTOKEN.encode_ordinary(text or "")
        assert bytes(got[i].decoded) == (text or "").encode()


def test_a_full_cache_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SIZE", 3)
    for text in ("one two three four five", "six seven one two"):
        assert vocabulary.encode([text])[0].tolist() == TIKTOKEN.encode_ordinary(text)


def test_histogram_answers_every_limit(spark, documents):
    docs = documents([(i, "word " * (i % 5)) for i in range(40)] + [(None, None)])
    hist = token_counts.histogram(docs, RANKS, public_tokenizers.PATTERN).persist()
    sizes = [len(TIKTOKEN.encode_ordinary("word " * (i % 5))) for i in range(40)] + [0]
    rows = {r.length: r for r in token_counts.suffix_sums(hist).collect()}
    assert sorted(rows) == sorted(set(sizes))
    for limit, row in rows.items():
        assert row.docs == sizes.count(limit)
        assert row.docs_at_least == sum(n >= limit for n in sizes)
        assert row.tokens_at_least == sum(n for n in sizes if n >= limit)
        assert row.truncated_total == sum(min(n, limit) for n in sizes)
        assert row.share_within == sum(n <= limit for n in sizes) / len(sizes)
    assert token_counts.truncated_total(hist, 2).first()[0] == sum(min(n, 2) for n in sizes)


def test_suffix_sums_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 2)
    rows = [(n, n % 3 + 1) for n in range(9)]
    got = {r.length: r for r in token_counts.suffix_sums(spark.createDataFrame(rows, "length long, docs long")).collect()}
    for n, _ in rows:
        assert got[n].docs_at_least == sum(c for m, c in rows if m >= n)
        assert got[n].truncated_total == sum(min(m, n) * c for m, c in rows)


def test_empty_tables(spark, documents):
    assert bpe.encode(documents([]), RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.suffix_sums(token_counts.histogram(documents([]), RANKS, public_tokenizers.PATTERN)).count() == 0
