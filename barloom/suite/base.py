"""Registry of runnable queries with their SQL oracles, and the SQL views both share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return add


H4 = 14_400_000

TICKS = """
ticks AS (
  SELECT 'c'||(user_id%2) AS chain, 't'||(user_id%4) AS ca, CASE WHEN event_type='click' THEN 'a' ELSE 'b' END AS pair_id,
    CAST(event_id AS VARCHAR) AS id, epoch_us(ts)//1000 AS time, value AS price,
    CAST(CAST(json_extract_string(props,'$.k') AS INTEGER) AS DOUBLE) AS volume_usd,
    CASE WHEN event_type<>'view' THEN value*1000 END AS mcap
  FROM events WHERE event_type IN ('click','view','purchase'))"""


def bars_cte(step: int = H4, value: str = "price", name: str = "bars") -> str:
    return f"""
{name} AS (
  SELECT chain, ca, pair_id, (time//{step})*{step} AS time, (time//{step})*{step}+{step} AS close_time,
    first({value} ORDER BY time,id) AS open, max({value}) AS high, min({value}) AS low, last({value} ORDER BY time,id) AS close,
    sum(volume_usd) AS volume, count(*) AS trade_count, last(id ORDER BY time,id) AS close_trade_id, max(time) AS close_trade_time
  FROM ticks WHERE {value} IS NOT NULL GROUP BY chain, ca, pair_id, time//{step})"""


VALID = "open>0 AND low>0 AND high>=greatest(open,close) AND low<=least(open,close) AND volume>=0"


def filled_cte(step: int = H4) -> str:
    return f"""
vb AS (SELECT * FROM bars WHERE {VALID}),
ib AS (
  SELECT *, lag(time) OVER w AS prev_time, lead(time) OVER w AS next_time FROM vb
  WINDOW w AS (PARTITION BY chain,ca,pair_id ORDER BY time)),
ix AS (
  SELECT *, CAST(sum(CASE WHEN prev_time IS NULL THEN 0 ELSE greatest(1, ceil((time-prev_time)/{step}.0)) END)
    OVER (PARTITION BY chain,ca,pair_id ORDER BY time) AS BIGINT) AS idx FROM ib),
filled AS (
  SELECT chain,ca,pair_id, time+k*{step} AS time, CASE WHEN k>0 THEN time+k*{step}+{step} ELSE close_time END AS close_time,
    CASE WHEN k>0 THEN close ELSE open END AS open, CASE WHEN k>0 THEN close ELSE high END AS high,
    CASE WHEN k>0 THEN close ELSE low END AS low, close, CASE WHEN k>0 THEN 0 ELSE volume END AS volume,
    idx+k AS idx, k>0 AS synthetic, next_time IS NULL AS is_last
  FROM (SELECT *, unnest(generate_series(0, CASE WHEN next_time IS NULL THEN 0 ELSE CAST(greatest(1, ceil((next_time-time)/{step}.0)) AS BIGINT)-1 END)) AS k FROM ix))"""


def base(step: int = H4) -> str:
    return "WITH RECURSIVE" + TICKS + "," + bars_cte(step) + "," + filled_cte(step)


SIGNALS = """
signals AS (
  SELECT 'c'||(user_id%2) AS chain, 't'||(user_id%4) AS ca, 's'||(user_id%3) AS signal_source, CAST(event_id AS VARCHAR) AS detail_id,
    CASE WHEN event_type='signup' THEN epoch_us(ts)//1000 END AS signal_time, props AS source_signal
  FROM events WHERE event_type IN ('signup','error')),
gate AS (SELECT chain, ca, min(signal_time) AS signal_time FROM signals WHERE signal_time>=0 GROUP BY chain, ca)"""
