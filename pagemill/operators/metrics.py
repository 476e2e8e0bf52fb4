"""Aggregates over runs, latencies, caches and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import js_round

BINS = 4096


def nth_values(rows: DataFrame, group: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """For every group the values at the places floor(n * fraction) from 0 of its sorted values, by name.

    Exact without sorting a group in one task: values are binned between the group's least and greatest, only the bins
    that hold a wanted place are looked into, and equal values are counted first. Nulls are left out.
    """
    known = rows.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ends = known.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    span = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    binned = _join(known, ends, group).withColumn("_bin", F.least(F.floor(span * BINS), F.lit(BINS - 1)))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*group, "_bin", "_all").agg(F.sum("_n").alias("_held")).withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.floor(F.col("_all") * f).alias("place")) for name, f in fractions.items())))
    hit = bins.withColumn("_w", wanted).filter("_w.place >= _before AND _w.place < _before + _held").select(*group, "_bin", "_before", "_w.name", "_w.place")
    inside = _join(binned.select(*group, "_bin", "_v", "_n"), hit, [*group, "_bin"])
    up_to = Window.partitionBy(*group, "_bin", "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = inside.withColumn("_upto", F.col("_before") + F.sum("_n").over(up_to)).filter("place < _upto AND place >= _upto - _n")
    return found.groupBy(*group).agg(*(F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in fractions))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return left.join(F.broadcast(right))  # one row
    named = right.select(*(F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in right.columns))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return left.join(named, condition).drop(*(f"_k_{k}" for k in keys))


def latency(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Runs below 500, up to 2,000 and above, and the median and the 95th percentile by place."""
    v = F.col(value)
    counts = rows.groupBy(*group).agg(F.count_if(v < 500).alias("n_fast"), F.count_if(v.between(500, 2000)).alias("n_normal"), F.count_if(v > 2000).alias("n_slow"))
    return _join(counts, nth_values(rows, group, value, {"p50": 0.5, "p95": 0.95}), group)


def trend(rows: DataFrame, group: list[str], order: list[str], value: str, step: float = 2.0) -> DataFrame:
    """improving, declining or stable: the mean of the last five values against that of the five before them."""
    back = F.row_number().over(Window.partitionBy(*group).orderBy(*(F.col(o).desc() for o in order)))
    last = rows.withColumn("_r", back).filter("_r <= 10").groupBy(*group).agg(
        F.avg(F.when(F.col("_r") <= 5, F.col(value))).alias("recent"),
        F.avg(F.when(F.col("_r") > 5, F.col(value))).alias("older"),
        F.count_if(F.col("_r") <= 5).alias("_a"),
        F.count_if(F.col("_r") > 5).alias("_b"),
    )
    enough = (F.col("_a") >= 3) & (F.col("_b") >= 2)
    word = F.when(enough & (F.col("recent") > F.col("older") + step), "improving").when(enough & (F.col("recent") < F.col("older") - step), "declining").otherwise("stable")
    return last.select(*group, "recent", "older", word.alias("trend"))


def rate(part: Column, whole: Column, scale: int = 100) -> Column:
    """A share in percent, 0 where there is nothing."""
    return F.when(whole > 0, part / whole * scale).otherwise(0.0)


def rounded_rate(part: Column, whole: Column) -> Column:
    return js_round(rate(part, whole)).cast("long")


def growth(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Peak, mean and last value, and the growth in percent from the first to the second half of the last ten values."""
    w = Window.partitionBy(*group)
    back = F.row_number().over(w.orderBy(*(F.col(o).desc() for o in order)))
    totals = rows.groupBy(*group).agg(F.max(value).alias("peak"), F.avg(value).alias("mean"))
    last = rows.withColumn("_r", back).filter("_r <= 10")
    sizes = last.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    halves = _join(last, sizes, group).withColumn("_first", F.col("_r") > F.col("_n") - F.floor(F.col("_n") / 2))
    sums = halves.groupBy(*group).agg(F.max(F.when(F.col("_r") == 1, F.col(value))).alias("current"), F.avg(F.when(F.col("_first"), F.col(value))).alias("_a"), F.avg(F.when(~F.col("_first"), F.col(value))).alias("_b"), F.max("_n").alias("_n"))
    grown = F.when((F.col("_n") >= 5) & (F.col("_a") != 0), (F.col("_b") - F.col("_a")) / F.col("_a") * 100).otherwise(0.0)
    return _join(totals, sums, group).select(*group, "peak", "mean", "current", grown.alias("growth"), (grown > 10).alias("leaks"))


def corpus_summary(files: DataFrame, name: str, content: str) -> DataFrame:
    """Bytes, lines and hash of every file, and one row with the totals whose file is null."""
    each = files.select(F.col(name).alias("file"), F.octet_length(content).cast("long").alias("bytes"), F.when(F.col(content) == "", 0).otherwise(F.size(F.split(content, "\n"))).cast("long").alias("lines"), F.sha2(content, 256).alias("sha256"))
    totals = each.agg(F.lit(None).cast("string").alias("file"), F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"), F.lit(None).cast("string").alias("sha256"))
    return each.withColumn("file", F.col("file").cast("string")).unionByName(totals)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """added, removed, changed or unchanged for every file of two summaries, with what bytes and lines changed by."""
    a = before.select("file", *(F.col(c).alias(f"a_{c}") for c in ("bytes", "lines", "sha256")))
    b = after.select("file", *(F.col(c).alias(f"b_{c}") for c in ("bytes", "lines", "sha256")))
    status = F.when(F.col("a_sha256").isNull(), "added").when(F.col("b_sha256").isNull(), "removed").when(F.col("a_sha256") != F.col("b_sha256"), "changed").otherwise("unchanged")
    delta = lambda c: (F.coalesce(f"b_{c}", F.lit(0)) - F.coalesce(f"a_{c}", F.lit(0))).alias(f"{c}_delta")
    return a.join(b, "file", "full_outer").select("file", status.alias("status"), delta("bytes"), delta("lines"))


def report(diff: DataFrame) -> DataFrame:
    """The diff as one Markdown table, files in order; made of per-status parts so that no list holds unchanged files."""
    line = F.concat_ws(" | ", F.concat(F.lit("| "), F.replace("file", F.lit("|"), F.lit("\\|"))), "status", F.col("bytes_delta").cast("string"), F.concat(F.col("lines_delta").cast("string"), F.lit(" |")))
    return diff.filter("status != 'unchanged'").groupBy("status").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", line.alias("line")))), lambda r: r["line"]), "\n").alias("rows"))
