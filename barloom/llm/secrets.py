"""Secret scans: candidate spans in each text, and corpus-wide ownership of every candidate value.

Four patterns propose candidates; the first three are the base kinds. Positions follow from the lengths of what lies
between matches, added up per text. Each candidate value is hashed and counted over the whole corpus by distinct
repositories (documents) and owners (sources): a value that several owners hold is a copied example, any other is a
live-looking credential of its owner. Bare values (long runs of mixed letters and digits without a key word) count as
secrets only if they are owner-specific.

Only DataFrame functions run here. Null and empty texts have no spans. Null ids and sources are kept; a null source is
one owner. Repeated rows get the same spans each. Spans count code points, ends exclusive. Texts of any length are read
whole. Columns beside doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import digest, join_checked
from barloom.session import cut

# Pattern, the capture group of the value, the value's least length, and a quick test that a text may match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": (ASSIGN, 2, 8, r"(?i:password|passwd|secret|token|api_?key)"),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    "hex": (r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
    "bare": (r"[A-Za-z0-9_-]{24,}", 0, 24, r"[A-Za-z0-9_-]{24}"),
}
BASE = ("assign", "access", "hex")
#: From so many owners on, a value is an example that people copy.
EXAMPLE_OWNERS = 3
#: A bare value has a digit, a letter and at least so many different characters.
BARE_VARIETY = 10


def _found(text: Column, kind: str) -> Column:
    """Matches in order: code points before each since the last one, its own, its value's, and the value's hash."""
    pattern, group, least, quick = KINDS[kind]
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        values.alias("value"),
    )

    def entry(x: Column, i: Column) -> Column:
        value = x["value"]
        fits = F.length(value) >= least
        if kind == "bare":
            fits &= value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= BARE_VARIETY)
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["all"]).alias("size"),
            F.length(value).alias("value_size"), fits.alias("fits"), digest(value).alias("hash"),
        )

    matched = F.transform(F.filter(pairs, lambda x: x["all"].isNotNull()), entry)
    kept = F.when(F.exists(matched, lambda x: x["fits"]), matched)
    return F.when(text.rlike(quick), kept)


def candidates(docs: DataFrame) -> DataFrame:
    """One written row per document: ``row`` (unique), doc_id, source, ``text_key`` and ``found``, null without a match."""
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.array().cast("array<struct<kind:string,i:int,gap:int,size:int,value_size:int,fits:boolean,hash:string>>")
    found = F.concat(*(F.coalesce(_found(text, kind), empty) for kind in KINDS))
    staged = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"),
        F.xxhash64(text).alias("text_key"), found.alias("found"),
    )
    return cut(staged.withColumn("found", F.when(F.size("found") > 0, F.col("found"))), "secret-candidates")


def ownership(spans: DataFrame) -> DataFrame:
    """hash, owners, repositories: distinct sources and documents that hold a value, reduced in steps before each shuffle."""
    held = spans.groupBy("hash", "source", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("hash", "source").agg(F.count("one").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("n").alias("owners"), F.sum("n").alias("repositories"))


def spans(staged: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """row, doc_id, text_key, kind, start, end, value_size, owners, repositories, ``verdict`` (live or example)."""
    order = Window.partitionBy("row", "kind").orderBy("i")
    each = staged.where(F.col("found").isNotNull()).select("row", "doc_id", "source", "text_key", F.explode("found").alias("x")).select("row", "doc_id", "source", "text_key", "x.*")
    end = F.sum(F.col("gap") + F.col("size")).over(order).cast("long")
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).where("fits")
    placed = cut(placed.select("row", "doc_id", "source", "text_key", "kind", "start", "end", "value_size", "hash"), "secret-spans")
    judged = placed.join(ownership(placed), "hash").withColumn("verdict", F.when(F.col("owners") >= example_owners, "example").otherwise("live"))
    return judged.where((F.col("kind") != "bare") | (F.col("verdict") == "live"))


def by_document(found: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``spans``: sorted array, without bare spans that overlap a base one."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    entry = F.struct("start", rank.alias("rank"), "kind", "end", "value_size", "verdict")
    every = F.sort_array(F.collect_set(entry))
    base = F.filter("every", lambda x: x["kind"] != "bare")
    clear = F.filter("every", lambda x: (x["kind"] != "bare") | ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return found.groupBy(*keys).agg(every.alias("every")).select(*keys, clear.alias("spans"))


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """doc_id and ``spans`` of every row, empty where there are none."""
    staged = candidates(docs)
    found = by_document(spans(staged, example_owners), "row")
    return staged.select("row", "doc_id").join(found, "row", "left").drop("row")


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def redact(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """All rows and columns of ``docs``; live values are replaced by ``[kind]`` and ``n_chars`` follows, if there is one."""
    names = docs.columns
    live = spans(candidates(docs), example_owners).where(F.col("verdict") == "live")
    live = cut(by_document(live, "doc_id", "text_key").select(_key("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans")), "secret-live")
    keyed = docs.withColumn("__id", _key("doc_id")).withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = join_checked(keyed, live, ["__id", "__key"], "left")

    def step(done: Column, x: Column) -> Column:
        start = F.greatest(x["end"] - x["value_size"], done["at"])
        gap = F.substring(F.col("text"), done["at"].cast("int") + 1, (start - done["at"]).cast("int"))
        fresh = x["end"] > done["at"]
        return F.struct(
            F.when(fresh, x["end"]).otherwise(done["at"]).alias("at"),
            F.when(fresh, F.concat(done["out"], gap, F.lit("["), x["kind"], F.lit("]"))).otherwise(done["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("__spans", start, step, lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"].cast("int") + 1, F.length("text"))))
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(masked)
    out = joined.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*names)
