"""Exact token counts for every context limit, from a histogram of encoded lengths.

Documents are aggregated by encoded length. The histogram has one row per length that occurs, so everything after it
grows with the spread of lengths, not with the documents. Suffix sums over it answer, for each length L: how many
documents and tokens remain at L or above, what all documents hold when each is cut at L, and the share of documents
within L, from which any quantile is read.

Null texts count as empty, length 0. Repeated rows count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.bpe import count
from barloom.session import cut

#: Lengths of one block of the two-level suffix sum; a window never holds more rows than this.
BLOCK = 1024


def histogram(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """Columns ``length`` and ``docs``; partial counts are merged before the shuffle."""
    return count(docs, ranks, pattern, text, (), "length").groupBy("length").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per length: documents and tokens at or above it, totals when cut there, and the share within it."""
    hist = cut(hist, "token-counts").select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = hist.groupBy("block").agg(F.sum("docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()

    def above(name: str) -> Column:
        return F.coalesce(F.sum(name).over(over), F.lit(0))

    carried = blocks.select(
        "block", above("b_docs").alias("c_docs"), above("b_tokens").alias("c_tokens"),
        F.sum("b_docs").over(everything).alias("all_docs"), F.sum("b_tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length"))
    at_least = F.col("c_docs") + F.sum("docs").over(inside)
    tokens_at_least = F.col("c_tokens") + F.sum("tokens").over(inside)
    return hist.join(carried, "block").select(
        "length", "docs", at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"),
        (F.col("all_tokens") - tokens_at_least + F.col("length") * at_least).alias("truncated_total"),
        ((F.col("all_docs") - at_least + F.col("docs")) / F.col("all_docs")).alias("share_within"),
        F.col("all_docs").alias("total_docs"), F.col("all_tokens").alias("total_tokens"),
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when every document is cut at ``limit``."""
    return hist.agg(F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("docs")), F.lit(0)).alias("tokens"))
