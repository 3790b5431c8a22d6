"""URL filters: explicit rules first, gradient-boosted trees on lexical features for the rest.

Everything is DataFrame work: the features are SQL expressions, the trees are boosted by ``GBTClassifier`` on a bounded
sample of labelled URLs, and the fitted trees are applied as nested CASE expressions inside code generation.

Features: lengths of URL, host and path; path depth; host labels; shares of digits and other signs; longest digit run;
character entropy; parameter counts; a www or mobile prefix; and statistics of the host's suffix, gathered from all URLs and labels: how many
URLs it has, and its smoothed share of blocked labels.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the trees like any other.
Repeated rows are judged alike. If the labels hold one class only, that class is the verdict; without labels it is
"allow". Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import join_checked
from barloom.session import cut

#: Labelled URLs the trees are fitted to, at most about so many.
SAMPLE = 20_000
TREES, DEPTH, SEED = 12, 4, 7
#: Weight of the overall share in a suffix's share of blocked labels.
PRIOR = 5.0


@dataclass(frozen=True)
class Rule:
    """``allow`` or block for a host with its subdomains and a path prefix, written like ``example.org/news/``."""

    text: str
    allow: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^([^?#]*)", 1)
    return F.when(rest, lower(host)).otherwise(""), F.when(rest, path).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Text of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(rule.text)).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character: sorted characters are counted run by run."""
    chars = F.array_sort(F.split(text, ""))
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def weight(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(n)).otherwise(0.0)

    def step(s: Column, c: Column) -> Column:
        same = c == s["last"]
        return F.struct(c.alias("last"), F.when(same, s["run"] + 1).otherwise(1.0).alias("run"), F.when(same, s["sum"]).otherwise(s["sum"] + weight(s["run"])).alias("sum"))

    n = F.length(text).cast("double")
    total = F.aggregate(chars, start, step, lambda s: s["sum"] + weight(s["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


NAMES = ["url_len", "host_len", "path_len", "depth", "labels", "digits", "signs", "digit_run", "entropy", "params", "query_len", "www", "suffix_urls", "suffix_blocked"]


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` with columns ``__url``, ``host``, ``path`` gains the features that need no other row."""
    url = F.coalesce("__url", F.lit(""))
    length = F.length(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    signs = F.length(F.regexp_replace(url, "[A-Za-z0-9]", ""))
    runs = F.aggregate(F.regexp_extract_all(url, F.lit("[0-9]+"), F.lit(0)), F.lit(0), lambda m, x: F.greatest(m, F.length(x)))
    values = {
        "url_len": length, "host_len": F.length("host"), "path_len": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")), "labels": F.size(F.split("host", r"\.")),
        "digits": digits / F.greatest(length, F.lit(1)), "signs": signs / F.greatest(length, F.lit(1)), "digit_run": runs,
        "entropy": entropy(url), "params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")), "query_len": F.length(query),
        "www": F.col("host").rlike(r"^(www|m)\.").cast("int"),
    }
    return urls.withColumns({k: v.cast("double") for k, v in values.items()} | {"__suffix": suffix(F.col("host"))})


def suffix_statistics(lexed: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per suffix: log of its URLs, and its share of blocked labels, drawn to the overall share. Reduced before the shuffle."""
    seen = lexed.groupBy("__suffix").agg(F.count("*").alias("urls"))
    told = labelled.groupBy("__suffix").agg(F.count("*").alias("told"), F.sum("label").alias("blocked"))
    whole = labelled.agg(F.avg("label").alias("rate"))
    told_, blocked = F.coalesce("told", F.lit(0)), F.coalesce("blocked", F.lit(0))
    return seen.join(told, "__suffix", "left").crossJoin(F.broadcast(whole)).select(  # ``whole`` is one row
        "__suffix", F.log1p("urls").alias("suffix_urls"), ((blocked + PRIOR * F.coalesce("rate", F.lit(0.0))) / (told_ + PRIOR)).alias("suffix_blocked"))


def fit(labelled: DataFrame):
    """Boosted trees for rows with all features and ``label`` (1: block); at most about ``SAMPLE`` of them, by hash."""
    rows = labelled.count()
    if rows > SAMPLE:
        labelled = labelled.where(F.pmod(F.xxhash64("__url"), F.lit(1 << 20)) < int(SAMPLE / rows * (1 << 20)))
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(labelled.select(*NAMES, F.col("label").cast("double")))
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(vectors)


def margin(model) -> Column:
    """The trees' weighted sum as one SQL expression."""

    def branch(node) -> Column:
        if node.numDescendants() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(F.col(NAMES[split.featureIndex()]) <= float(split.threshold()), branch(node.leftChild())).otherwise(branch(node.rightChild()))

    return sum((F.lit(float(w)) * branch(tree._java_obj.rootNode()) for tree, w in zip(model.trees, model.treeWeights)), F.lit(0.0))


def judge(pages: DataFrame, rules: Sequence[Rule], labels: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, rule, verdict, ``score`` (chance of block by the trees) of every row.

    ``labels`` (url, blocked 0 or 1) are the labelled URLs; without them the URLs that a rule decides are.
    """
    def prepared(rows: DataFrame, *keep: Column) -> DataFrame:
        host, path = parts(F.col("__url"))
        rows = rows.select(*keep, "__url").withColumns({"host": host, "path": path})
        return lexical(rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)))

    allowed = [r.text for r in rules if r.allow]
    by_rule = F.when(F.col("rule").isin(allowed), "allow").when(F.col("rule").isNotNull(), "block")
    lexed = prepared(pages.withColumn("__url", F.col(url)), F.col(key).alias("__page"))
    lexed = cut(lexed, "url-features")
    if labels is None:
        told = lexed.where("rule IS NOT NULL").withColumn("label", (by_rule == "block").cast("int"))
    else:
        told = prepared(labels.where("url IS NOT NULL AND blocked IS NOT NULL").withColumn("__url", F.col("url")), F.col("blocked").cast("int").alias("label"))
    statistics = cut(suffix_statistics(lexed, told), "url-suffixes")
    full = join_checked(lexed, statistics, ["__suffix"], "left")
    classes = {r[0] for r in told.select("label").distinct().collect()}
    if len(classes) == 2:
        score = 1 / (1 + F.exp(-2 * margin(fit(join_checked(told, statistics, ["__suffix"], "left").na.fill(0.0, NAMES)))))
    else:
        score = F.lit(1.0 if classes == {1} else 0.0)
    full = full.withColumn("score", score)
    verdict = F.coalesce(by_rule, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return full.select(F.col("__page").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score")
