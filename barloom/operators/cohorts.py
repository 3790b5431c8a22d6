"""Token cohorts, fold splits, stability gates, ranking and study comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.plans.blocks import scan
from barloom.schemas import TOKEN

DAY = 86_400_000
UTC8 = 8 * 3_600_000


def day_number(time: Column) -> Column:
    """Calendar day at UTC+8."""
    return F.floor((time + UTC8) / DAY)


def partition_days(signals: DataFrame, k: int = 5) -> DataFrame:
    """Equal calendar spans; the first folds take the remainder; empty days stay in their span."""
    span = signals.agg(F.min(day_number(F.col("signal_time"))).alias("_first"), F.max(day_number(F.col("signal_time"))).alias("_last"))
    rows = signals.crossJoin(F.broadcast(span))  # a one-row aggregate
    total = F.col("_last") - F.col("_first") + 1
    base, extra = F.floor(total / k), total % k
    offset = day_number(F.col("signal_time")) - F.col("_first")
    wide = extra * (base + 1)
    fold = F.when(offset < wide, F.floor(offset / (base + 1))).otherwise(extra + F.floor((offset - wide) / F.greatest(base, F.lit(1))))
    return rows.withColumn("fold", (fold + 1).cast("int")).drop("_first", "_last")


def fold_eligibility(entries: DataFrame, k: int = 5) -> DataFrame:
    return entries.agg(
        F.count_distinct("fold").alias("folds"), F.count_distinct(day_number(F.col("signal_time"))).alias("days"),
    ).withColumn("eligible", (F.col("folds") == k) & (F.col("days") >= 5))


def split_by_time(signals: DataFrame, ratio: float, distinct_times: bool = False) -> DataFrame:
    """``part`` development or validation, cut at the signal of rank floor(n*ratio); ties stay on one side.

    The rank is a carried count; only the one cut value is broadcast.
    """
    base = signals.select("signal_time").distinct() if distinct_times else signals
    ranked = scan(base.withColumn("_one", F.lit(1)), ["_one"], ["signal_time", *([] if distinct_times else TOKEN)], None, {"_rn": ("count", F.lit(1))})
    n = base.agg(F.count(F.lit(1)).alias("_n"))
    at = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))) + 1
    cut = ranked.crossJoin(F.broadcast(n)).where(F.col("_rn") == at).agg(F.max("signal_time").alias("cutoff"))
    rows = signals.crossJoin(F.broadcast(cut))
    return rows.withColumn("part", F.when(F.col("signal_time") < F.col("cutoff"), "development").otherwise("validation"))


def split_positional(signals: DataFrame, ratio: float = 0.6) -> DataFrame:
    """First part by position in time order, ties broken by token."""
    ranked = scan(signals.withColumn("_one", F.lit(1)), ["_one"], ["signal_time", *TOKEN], None, {"_rn": ("count", F.lit(1))})
    n = signals.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.crossJoin(F.broadcast(n)).withColumn(
        "part", F.when(F.col("_rn") <= F.floor(F.col("_n") * ratio), "development").otherwise("validation")).drop("_one", "_rn", "_n")


def hash_order(seed: int, *salt: str) -> Column:
    parts = ",".join([str(seed), *[f'"{s}"' for s in salt]])
    return F.sha2(F.concat(F.lit(f"[{parts},"), F.to_json(F.array(*TOKEN)), F.lit("]")), 256)


def split_balanced_sets(signals: DataFrame, seed: int, limit: int, groups: int, min_reserve: int = 0) -> DataFrame:
    """``fold`` 1..groups of equal size plus a reserve fold: per-day proportional quotas, then round-robin from the reserve.

    Positions within a day and within the reserve are carried counts over hash prefixes, so a crowded day is spread.
    """
    n = signals.agg(F.count(F.lit(1)).alias("_n"))
    prefix = lambda c: F.conv(F.substring(c, 1, 2), 16, 10).cast("int")
    rows = signals.withColumn("_day", day_number(F.col("signal_time"))).withColumn("_h", hash_order(seed)).withColumn("_r", hash_order(seed, "reserve"))
    rows = scan(rows, ["_day"], ["_h"], prefix(F.col("_h")), {"_pos": ("count", F.lit(1))})
    per_day = signals.groupBy(day_number(F.col("signal_time")).alias("_day")).agg(F.count(F.lit(1)).alias("_rows"))
    size = F.least(F.lit(limit), F.floor((F.col("_n") - min_reserve) / groups))
    quota = per_day.crossJoin(F.broadcast(n)).withColumn("_size", size).withColumn("_base", F.floor(F.col("_rows") * F.col("_size") / F.col("_n")))
    placed = rows.join(quota.select("_day", "_base", "_size"), "_day")
    direct = F.when((F.col("_base") > 0) & (F.col("_pos") <= F.col("_base") * groups), F.floor((F.col("_pos") - 1) / F.greatest(F.col("_base"), F.lit(1))) + 1)
    placed = placed.withColumn("fold", direct)
    rest = scan(placed.where("fold is null").withColumn("_one", F.lit(1)), ["_one"], ["_r"], prefix(F.col("_r")), {"_turn": ("count", F.lit(1))}).drop("_one")
    # Every group misses the same number of members, so the reserve is dealt out in turns until they are full.
    given = quota.agg(F.sum("_base").alias("_given"))
    dealt = rest.crossJoin(F.broadcast(given)).withColumn("fold", F.when(
        F.col("_turn") <= (F.col("_size") - F.col("_given")) * groups, (F.col("_turn") - 1) % groups + 1).otherwise(groups + 1))
    keep = [*signals.columns, "fold"]
    return placed.where("fold is not null").select(*keep).unionByName(dealt.select(*keep)).withColumn("fold", F.col("fold").cast("int"))


def fold_subsets(spark: SparkSession, n: int) -> DataFrame:
    """All non-empty fold combinations, one row per (subset, fold). ``n`` is the small fold count."""
    return spark.range(1, 2**n).withColumnRenamed("id", "subset").withColumn(
        "fold", F.explode(F.array(*[F.when(F.col("subset").bitwiseAND(1 << j) > 0, j + 1) for j in range(n)]))).where("fold is not null")


def dispersion(scores: DataFrame, keys: Sequence[str], value: str = "account_return") -> DataFrame:
    """Exact median over the folds of a key and the largest deviation from it relative to the median."""
    med = scores.groupBy(*keys).agg(F.median(value).alias("median"))
    return scores.join(med, list(keys)).groupBy(*keys, "median").agg(
        F.max(F.abs(F.col(value) - F.col("median"))).alias("deviation"), F.min(value).alias("min_return"), F.max("max_drawdown").alias("worst_drawdown"),
        F.min("total_trades").alias("min_trades"), F.count(F.lit(1)).alias("folds"),
    ).withColumn("relative_deviation", F.when(F.col("median") > 0, F.col("deviation") / F.col("median")).otherwise(F.lit(float("inf"))))


def positive(trades: int, max_drawdown: float = 10.0) -> Column:
    return F.coalesce((F.col("account_return") > 0) & (F.col("total_trades") >= trades) & (F.col("max_drawdown") <= max_drawdown), F.lit(False))


def stability_gate(scores: DataFrame, keys: Sequence[str], folds: int, min_trades: int = 20, max_drawdown: float = 10.0, extras: DataFrame | None = None) -> DataFrame:
    """``pass`` per candidate and the names of failed gates.

    ``extras`` holds further scored variants (combined, reserve, stress, without-best) by ``variant``; each must be
    positive on the same terms.
    """
    d = dispersion(scores, keys)
    ok = scores.groupBy(*keys).agg(F.every(positive(min_trades, max_drawdown)).alias("_folds_ok"))
    out = d.join(ok, list(keys))
    if extras is not None:
        out = out.join(extras.groupBy(*keys).agg(F.every(positive(min_trades, max_drawdown)).alias("_extras_ok")), list(keys), "left")
    else:
        out = out.withColumn("_extras_ok", F.lit(True))
    gates = {
        "folds": F.col("folds") == folds, "fold_scores": F.col("_folds_ok"), "deviation": F.col("relative_deviation") <= 0.5,
        "variants": F.coalesce("_extras_ok", F.lit(False)),
    }
    failed = F.array_join(F.filter(F.array(*[F.when(~c, n) for n, c in gates.items()]), lambda x: x.isNotNull()), ",")
    return out.withColumn("failed", failed).withColumn("pass", F.col("failed") == "").drop("_folds_ok", "_extras_ok")


def rank_rows(df: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """``rank`` by the given order over candidates (one row each, so a ranking list is small next to the data)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


RANKINGS = {
    "stable": lambda: [F.desc("min_return"), F.asc("deviation"), F.asc("worst_drawdown"), F.asc("candidate_id")],
    "development": lambda: [F.desc("min_return"), F.asc("worst_drawdown"), F.asc("candidate_id")],
    "return": lambda: [F.desc("account_return"), F.asc("max_drawdown"), F.asc("candidate_id")],
    "net": lambda: [F.desc("net_pnl"), F.asc("max_drawdown"), F.asc("candidate_id")],
    "batch": lambda: [F.desc("account_return"), F.asc("max_drawdown"), F.asc("cohort")],
    "normal": lambda: [F.desc("normal_return"), F.asc("max_drawdown"), F.asc("candidate_id")],
    "shared": lambda: [F.desc("mean_return"), F.asc("worst_drawdown"), F.asc("candidate_id")],
}


def top_k(scores: DataFrame, by: Sequence[str], k: int, ranking: str = "batch") -> DataFrame:
    """Best ``k`` per key among finished rows with finite scores; Spark prunes to ``k`` before the shuffle."""
    fine = scores.where((F.abs("account_return") < float("inf")) & (F.abs("max_drawdown") < float("inf")))
    return rank_rows(fine, RANKINGS[ranking](), by).where(F.col("rank") <= k)


def shared_leader(scores: DataFrame, chains: int) -> DataFrame:
    """Candidates that pass on every chain, by mean return and worst drawdown."""
    per = scores.groupBy("candidate_id").agg(
        F.count_distinct("chain").alias("chains"), F.avg("account_return").alias("mean_return"), F.max("max_drawdown").alias("worst_drawdown"),
        F.every((F.col("total_trades") >= 10) & (F.col("max_drawdown") <= 20)).alias("_ok"))
    return rank_rows(per.where((F.col("chains") == chains) & F.col("_ok")).drop("_ok"), RANKINGS["shared"]())


def holdout_decision(development: DataFrame, validation: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Winner chosen on development alone; accepted if both periods pass."""
    fine = development.where((F.col("total_trades") >= 10) & (F.col("max_drawdown") <= 20))
    best = fine.groupBy(*keys).agg(F.min(F.struct((-F.col("account_return")).alias("r"), "max_drawdown", "candidate_id", "total_trades")).alias("b"))
    won = best.select(*keys, "b.candidate_id", (-F.col("b.r")).alias("dev_return"), F.col("b.max_drawdown").alias("dev_drawdown"), F.col("b.total_trades").alias("dev_trades"))
    out = won.join(validation.select(*keys, "candidate_id", F.col("account_return").alias("val_return"), F.col("max_drawdown").alias("val_drawdown"), F.col("total_trades").alias("val_trades")), [*keys, "candidate_id"], "left")
    return out.withColumn("accepted", F.coalesce(
        (F.col("dev_return") > 0) & (F.col("val_return") > 0) & (F.col("dev_trades") >= 10) & (F.col("val_trades") >= 10)
        & (F.col("dev_drawdown") <= 20) & (F.col("val_drawdown") <= 20), F.lit(False)))


def early_stop(scores: DataFrame, folds: Sequence[int], passes: Column, key: str = "candidate_id") -> DataFrame:
    """Scores a staged evaluation would have computed: a fold counts only if every earlier fold passed."""
    position = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col("cohort"))
    ok = scores.where(F.col("cohort").isin(list(folds))).withColumn("_at", position)
    # A missing fold stops the sequence like a failed one: each reached fold needs all earlier ones to have passed.
    upto = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return ok.withColumn("_before", F.count_if(passes).over(upto)).where(F.col("_before") == F.col("_at") - 1).drop("_at", "_before")


def attribution(trades: DataFrame, signals: DataFrame) -> DataFrame:
    joined = trades.join(signals, TOKEN, "left")
    kind = F.when(F.col("signal_time").isNull(), "missing_signal").when(F.col("entry_time") > F.col("signal_time"), "after_signal").otherwise("before_or_at_signal")
    return joined.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("trades"), F.round(F.sum("net_pnl"), 3).alias("net_pnl"))


def study_table(scores: DataFrame, folds: Sequence[int]) -> DataFrame:
    """One row per candidate with return, trades and drawdown of each fold."""
    wide = scores.groupBy("chain", "candidate_id").pivot("cohort", list(folds)).agg(
        F.max("account_return").alias("return"), F.max("total_trades").alias("trades"), F.max("max_drawdown").alias("drawdown"))
    return wide


def ledger_hash(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Order-free content fingerprint of all other columns: row count and two sums of row hashes."""
    body = [c for c in sorted(df.columns) if c not in keys]
    row = F.sha2(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}), 256)
    part = lambda start: F.conv(F.substring(row, start, 8), 16, 10).cast("long")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(part(1)).alias("hash_a"), F.sum(part(9)).alias("hash_b"))


def parity(left: DataFrame, right: DataFrame, key: Sequence[str], exact: Sequence[str], close: Sequence[str], tolerance: float = 1e-7) -> DataFrame:
    """``same`` per key: counts exact, scalars within the tolerance."""
    a, b = left.alias("a"), right.alias("b")
    rows = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full")
    ok = F.lit(True)
    for c in exact:
        ok = ok & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    for c in close:
        ok = ok & (F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(f"a.{c}"))))
    return rows.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in key], F.coalesce(ok, F.lit(False)).alias("same"))


def snapshot_reuse(old: DataFrame, new: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Per dimension: may stored results be reused (equal content) or not."""
    a, b = ledger_hash(old, dims).alias("a"), ledger_hash(new, dims).alias("b")
    same = F.lit(True)
    for c in ("rows", "hash_a", "hash_b"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, [F.col(f"a.{d}").eqNullSafe(F.col(f"b.{d}")) for d in dims], "full").select(
        *[F.coalesce(F.col(f"a.{d}"), F.col(f"b.{d}")).alias(d) for d in dims], same.alias("reusable"))
