"""The registered queries of the operators, each over its whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.llm import bpe, chat, fingerprints, parity_join, repeats, secrets, spelling, tiling, token_counts, toxicity, url_filter, warc, whitening
from barloom.llm.common import digest, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def vocabulary() -> dict[bytes, int]:
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary()
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        digest(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.PATTERN))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(kinds) -> Column:
        own = F.filter(F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,end:bigint,value_size:int,verdict:string>>")), lambda x: x["kind"].isin(*kinds))
        return F.concat_ws(",", F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def number(test) -> Column:
        return F.coalesce(F.size(F.filter("spans", test)), F.lit(0)).cast("long")

    def kind(name: str) -> Column:
        return number(lambda x: x["kind"] == name)

    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(kind(k).alias(f"n_{k}") for k in secrets.BASE),
        digest(listed(secrets.BASE)).alias("base_sha256"), listed(secrets.KINDS).alias("spans"),
        number(lambda x: x["verdict"] == "live").alias("n_live"), number(lambda x: x["verdict"] == "example").alias("n_example"),
    )


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.cluster(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


URL_RULES = (
    url_filter.Rule("org/", True), url_filter.Rule("example.org/es/", False), url_filter.Rule("example.org/en/1", False),
    url_filter.Rule("com/fr/", True), url_filter.Rule("com/de/", False),
)


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def _base32(hex_digits: str) -> str:
    """SQL for the base32 form of 40 hexadecimal digits: 8 groups of 5 digits give 4 letters each."""
    groups = []
    for k in range(8):
        group = f"CAST('0x' || substr({hex_digits}, {5 * k + 1}, 5) AS BIGINT)"
        groups += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({group} >> {shift}) & 31 AS INTEGER) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(groups)


ORACLES["op5_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS original FROM p)
SELECT page_id, strlen(html) AS payload_bytes, {_base32('d')} AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM original AND original IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM q"""


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


ORACLES["op11_substring_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, i + unnest(range(0, 35)) AS i FROM win SEMI JOIN again USING (s)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS k FROM word ANTI JOIN hit USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove(docs).select("doc_id", "n_words", "n_removed", digest(F.col("text")).alias("kept_sha256"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
