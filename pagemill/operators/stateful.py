"""Caches, quotas, limits and budgets over event tables: the batch forms of the stateful operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch_ms(ts) -> Column:
    """Milliseconds since 1970 of a timestamp with or without zone, by the clock that it shows."""
    value = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value.cast("timestamp_ntz"))


def cache_split(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests that the cache answers, and those that it misses."""
    keys = cache.select(key).distinct()
    return requests.join(keys, key, "left_semi"), requests.join(keys, key, "left_anti")


def cache_live(entries: DataFrame, now: Column, ttl_hours: Column | float = 24) -> DataFrame:
    """Entries whose time to live has not run out: `timestamp` in milliseconds."""
    return entries.filter(now <= F.col("timestamp") + F.lit(ttl_hours) * 3_600_000)


def cache_newest(entries: DataFrame, most: int = 100) -> DataFrame:
    """The newest entries: a top-k, of which every task sends `most` rows at most."""
    return entries.orderBy(F.col("timestamp").desc(), "key").limit(most)


def cache_stats(entries: DataFrame, value: str) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("key", value)))).alias("bytes"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def rate_limit(events: DataFrame, who: str, ts: str, seconds: int, most: int) -> DataFrame:
    """Events of everyone in every fixed window, whether there were too many, and the seconds to the window's end at its first."""
    window = F.window(ts, f"{seconds} seconds")
    counted = events.groupBy(F.col(who), window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"))
    after = F.greatest(F.lit(1), F.floor(epoch_ms("w.end") / 1000) - F.floor(epoch_ms("first") / 1000))
    return counted.select(who, F.col("w.start").alias("start"), "n", (F.col("n") > most).alias("limited"), after.alias("retry_after"))


def daily_quota(events: DataFrame, who: str, ts: str, order: str, most: int) -> DataFrame:
    """The events with `allowed`: whether each is among the first of its user's day."""
    day = F.date_format(ts, "yyyy-MM-dd")
    place = F.row_number().over(Window.partitionBy(who, "day").orderBy(ts, order))
    return events.withColumn("day", day).withColumn("allowed", place <= most)


def spend(events: DataFrame, ts: str, cost: str, cap: float) -> DataFrame:
    """Costs by week, those that are no finite number at or above 0 left out, and whether the breaker is open."""
    good = events.filter(F.col(cost).isNotNull() & ~F.isnan(cost) & (F.col(cost) >= 0) & (F.abs(cost) != float("inf")))
    weekly = good.groupBy(F.date_trunc("week", ts).alias("week")).agg(F.sum(cost).alias("spend"), F.count(F.lit(1)).alias("n"))
    return weekly.withColumn("open", F.col("spend") >= cap)


def decrement_once(requests: DataFrame, who: str, key: str, amount: str, order: list[str], balance: float) -> DataFrame:
    """Requests once for each key, with the balance after each: one that the balance does not cover changes nothing.

    Amounts are equal or small against the balance here, so a request is covered while the amounts up to it are.
    """
    from pagemill.operators.ranking import first_by

    once = first_by(requests, [who, key], [F.col(o) for o in order])
    total = F.sum(amount).over(Window.partitionBy(who).orderBy(*order, key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return once.withColumn("_total", total).withColumn("accepted", F.col("_total") <= balance).withColumn("left", F.when(F.col("accepted"), balance - F.col("_total"))).drop("_total")


def debounce(events: DataFrame, who: str, ts: str, order: str, gap_ms: int) -> DataFrame:
    """Events that come at least the gap after the event before them."""
    before = F.lag(ts).over(Window.partitionBy(who).orderBy(ts, order))
    return events.withColumn("_before", before).filter(F.col("_before").isNull() | (epoch_ms(ts) - epoch_ms("_before") >= gap_ms)).drop("_before")


def sessions(events: DataFrame, who: str, ts: str, gap: str) -> DataFrame:
    """Sessions of everyone: a gap of that length ends one."""
    s = events.groupBy(F.col(who), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(who, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def entitlement(plan: Column, used: Column, most: Column, inflight: Column) -> Column:
    """Why a user may not start another run: the first reason that applies, or open."""
    return F.when(plan.isNull(), "no_plan").when(plan == "pro", "open").when(inflight > 0, "busy").when(used >= most, "quota").otherwise("open")


def outcome(ok: Column, cached: Column, warnings: Column, errors: Column, quality: Column) -> Column:
    """One of six views of a finished run."""
    return F.when(errors > 0, "failed").when(~ok, "empty").when(cached, "cached").when(quality < 60, "poor").when(warnings > 0, "warned").otherwise("good")
