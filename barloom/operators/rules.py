"""Declarative rule trees compiled to one boolean ``Column``.

A tree node is a mapping: a leaf has ``type`` and parameters, a group has ``mode`` (all, any, at_least),
``conditions`` and optionally ``minMatches``; either may be switched off with ``enabled: false``. Each leaf type is
registered with the indicator columns it needs and a column builder, so new rules plug in by name.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.candles import candle_pattern
from barloom.operators.indicators import Feature

Node = Mapping[str, object]


@dataclass(frozen=True)
class Leaf:
    build: Callable[[Node, Column], Column]
    features: Callable[[Node], set[Feature]] = lambda node: set()


REGISTRY: dict[str, Leaf] = {}


def leaf(name: str, features: Callable[[Node], set[Feature]] = lambda node: set()):
    def add(build: Callable[[Node, Column], Column]):
        REGISTRY[name] = Leaf(build, features)
        return build
    return add


def _buffered(level: Column, node: Node) -> Column:
    return level * (1 - float(node.get("bufferPercent") or 0) / 100)


def fib_level(swing: Column, ratio: float) -> Column:
    return swing["high"] - (swing["high"] - swing["low"]) * ratio


@leaf("fib_retracement")
def _fib(node, swing):
    depth = (swing["high"] - F.col("close")) / (swing["high"] - swing["low"])
    return (F.col("idx") >= swing["confirmed_idx"]) & depth.between(node["zoneLow"], node["zoneHigh"])


@leaf("percent_retracement")
def _percent(node, swing):
    return ((swing["high"] - F.col("close")) / swing["high"] * 100).between(node["minPercent"], node["maxPercent"])


@leaf("volume_contraction", lambda n: {("vols", n["period"])})
def _contraction(node, swing):
    period = int(node["period"])
    count = F.least(F.lit(period), F.col("idx") - swing["high_idx"]).cast("int")
    vols = F.col(f"vols_{period}")
    tail = F.slice(vols, F.size(vols) - count + 1, count)
    mean = F.aggregate(tail, F.lit(0.0), lambda a, v: a + v) / count
    return F.when((count > 0) & (swing["average_volume"] > 0), mean / swing["average_volume"] <= node["maxRatio"])


@leaf("bullish_volume_confirmation", lambda n: {("vmean", n["period"])})
def _bullish(node, swing):
    return (F.col("close") > F.col("open")) & (F.col("volume") >= F.col(f"vmean_{node['period']}") * node["minRatio"])


@leaf("candle_pattern")
def _pattern(node, swing):
    return reduce(lambda a, b: a | b, [candle_pattern(p) for p in node["patterns"]], F.lit(False))


@leaf("rsi_recovery", lambda n: {("rsi", n["period"])})
def _rsi(node, swing):
    now, before = F.col(f"rsi_{node['period']}"), F.col(f"rsi_{node['period']}_prev")
    return (before <= node["oversold"]) & (now >= node["recovery"])


@leaf("ema_reclaim", lambda n: {("ema", n["period"])})
def _ema(node, swing):
    return (F.col("prev_close") <= F.col(f"ema_{node['period']}_prev")) & (F.col("close") > F.col(f"ema_{node['period']}"))


@leaf("obv_confirmation", lambda n: {("obv", n["lookbackBars"])})
def _obv(node, swing):
    return F.col(f"obv_change_{node['lookbackBars']}") >= node["minChangePercent"]


@leaf("break_fib_invalidation")
def _break_fib(node, swing):
    return F.col("close") < _buffered(fib_level(swing, node["ratio"]), node)


@leaf("break_swing_low_invalidation")
def _break_low(node, swing):
    return F.col("close") < _buffered(swing["low"], node)


def broken_level(node: Node, swing: Column) -> Column | None:
    """The level a close must fall below for this condition; None for conditions of another kind."""
    if node["type"] == "break_fib_invalidation":
        return _buffered(fib_level(swing, node["ratio"]), node)
    return _buffered(swing["low"], node) if node["type"] == "break_swing_low_invalidation" else None


def alternatives(node: Node | None) -> list[Node]:
    """The conditions of a rule that any one of them meets; ValueError for rules that combine conditions."""
    if not node or not is_on(node):
        return []
    if "conditions" not in node:
        return [node] if node["type"] in REGISTRY else []
    children = [c for c in node["conditions"] if is_on(c)]
    if len(children) > 1 and node["mode"] != "any" and (node["mode"] == "all" or int(node.get("minMatches") or 1) > 1):
        raise ValueError("without a holding limit an invalidation must not combine conditions")
    return [leaf for c in children for leaf in alternatives(c)]


def _body_percent() -> Column:
    return F.when(F.col("open") > 0, (F.col("open") - F.col("close")) / F.col("open") * 100).otherwise(0.0)


@leaf("bearish_volume_invalidation", lambda n: {("vmean", n["period"])})
def _bearish(node, swing):
    return (
        (F.col("close") < F.col("open")) & (_body_percent() >= node["minBodyPercent"])
        & (F.col("volume") >= F.col(f"vmean_{node['period']}") * node["minRatio"])
    )


def is_on(node: Node) -> bool:
    return node.get("enabled") is not False


def features_of(node: Node | None) -> set[Feature]:
    if not node or not is_on(node):
        return set()
    if "conditions" in node:
        return set().union(*[features_of(child) for child in node["conditions"]]) if node["conditions"] else set()
    return REGISTRY[node["type"]].features(node) if node["type"] in REGISTRY else set()


def compile_rule(node: Node | None, swing: Column) -> Column:
    """Never null: unknown, disabled or unavailable inputs are false."""
    if not node or not is_on(node):
        return F.lit(False)
    if "conditions" not in node:
        known = REGISTRY.get(node["type"])
        return F.coalesce(known.build(node, swing), F.lit(False)) if known else F.lit(False)
    parts = [compile_rule(child, swing) for child in node["conditions"] if is_on(child)]
    if not parts:
        return F.lit(False)
    if node["mode"] == "all":
        return reduce(lambda a, b: a & b, parts)
    if node["mode"] == "any":
        return reduce(lambda a, b: a | b, parts)
    needed = max(1, int(node.get("minMatches") or 1))
    return reduce(lambda a, b: a + b, [p.cast("int") for p in parts]) >= needed


def rising_edge(predicate: Column, previous: Column) -> Column:
    return predicate & ~F.coalesce(previous, F.lit(False))


EXPLAIN_CODES = ("break_fib_invalidation", "break_swing_low_invalidation", "bearish_volume_invalidation")


def _evidence(node: Node, swing: Column, path: str) -> Column:
    kind = node["type"] if node["type"] in EXPLAIN_CODES else "other_condition"
    observed, threshold = F.col("close"), F.lit(None).cast("double")
    if kind == "break_fib_invalidation":
        threshold = _buffered(fib_level(swing, node["ratio"]), node)
    elif kind == "break_swing_low_invalidation":
        threshold = _buffered(swing["low"], node)
    elif kind == "bearish_volume_invalidation":
        observed, threshold = F.col("volume"), F.col(f"vmean_{node['period']}") * node["minRatio"]
    return F.struct(F.lit(kind).alias("code"), F.lit(path).alias("path"), observed.alias("observed"), threshold.alias("threshold"))


def explain_rule(node: Node, swing: Column) -> Column:
    """Array of the leaves that made the tree true, in configuration order; leaves under a failed branch are left out."""
    items: list[Column] = []

    def walk(child: Node, path: list[int], alive: Column) -> None:
        if not is_on(child):
            return
        here = alive & compile_rule(child, swing)
        if "conditions" in child:
            for i, sub in enumerate(child["conditions"]):
                walk(sub, [*path, i], here)
        else:
            items.append(F.when(here, _evidence(child, swing, "/".join(map(str, path)))))

    walk(node, [], F.lit(True))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def primary_cause(evidence: Column) -> Column:
    return F.coalesce(F.try_element_at(evidence, F.lit(1))["code"], F.lit("unknown"))


def qualify_source(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """``qualified`` per (fact, rule of its provider). The first provider compares with >=, the others strictly."""
    # Rules are one row per run and provider: configuration, not data.
    joined = facts.join(rules, "provider")
    cap_ok = F.col("market_cap") > F.col("min_market_cap")
    age_ok = (
        (F.col("created_at") > 0) & (F.col("created_at") <= F.col("now"))
        & (F.col("now") - F.col("created_at") < F.col("max_age_minutes") * 60_000)
    )
    rule = (
        F.when(F.col("provider") == "memeinfo", F.col("market_cap") >= F.col("min_market_cap"))
        .when(F.col("provider") == "wallet", cap_ok & age_ok)
        .otherwise(cap_ok & age_ok & (F.col("dex") == "pfamm") & (F.col("kol") >= F.col("min_kol")))
    )
    return joined.withColumn("qualified", F.coalesce(F.col("enabled") & rule, F.lit(False)))


def loosest_rule(configs: DataFrame) -> DataFrame:
    """Widest bounds over the enabled rules of a provider, plus the strictest exit cap among them."""
    return configs.where("enabled").groupBy("provider").agg(
        F.max("max_age_minutes").alias("max_age_minutes"), F.min("min_market_cap").alias("min_market_cap"),
        F.min("min_kol").alias("min_kol"), F.min("exit_market_cap").alias("exit_cap"))


def exit_caps(matched: DataFrame, configs: DataFrame) -> DataFrame:
    """Effective exit cap per token: the smallest among the providers that matched it."""
    return matched.join(configs, "provider").groupBy("chain", "ca").agg(F.min("exit_market_cap").alias("exit_cap"))
