import public_tokenizers
import tiktoken

import corpus_pipeline
from barloom.llm import bpe
from barloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "secrets", "encoding"]
    docs = table(spark, SF, "documents")
    whole, seen = {r.doc_id: r.text for r in docs.collect()}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).persist()
        assert after.columns == docs.columns
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(whole)
        seen.append(len(ids))
        docs = after
    assert len(whole) >= seen[0] > seen[1] >= seen[2] == seen[3] > len(whole) / 2
    texts = {r.doc_id: r.text for r in docs.collect()}
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row in corpus_pipeline.encode(spark, docs, SF).collect():
        assert row.ids == library.encode_ordinary(texts[row.doc_id]) and row.n_tokens == len(row.ids)
