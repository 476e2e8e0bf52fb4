"""Documents as tables of lines, and windows over them.

Windows are partitioned by document: a task holds the lines of one document at a time, however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line: pos from 0, the line, and in_code, whether an odd number of fence lines stands above."""
    exploded = documents.select("*", F.posexplode(F.split(text, "\n")).alias("pos", "line")).drop(text).withColumn("pos", F.col("pos").cast("long"))
    fence = F.col("line").rlike(r"^[ \t]*```")
    above = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return exploded.withColumn("in_code", ~fence & (F.sum(fence.cast("int")).over(above) % 2 == 1))


def drop_consecutive(lines: DataFrame, key: str, longest: int = 50) -> DataFrame:
    """The lines without short ones that repeat the line before them."""
    before = F.lag("line").over(Window.partitionBy(key).orderBy("pos"))
    return lines.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col("line")) | (F.length("line") > longest)).drop("_before")


def with_previous_heading(lines: DataFrame, key: str) -> DataFrame:
    """The lines with h1, the text of the nearest first-level heading at or above each."""
    t = F.trim("line")
    above = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("h1", F.last(F.when(t.startswith("# "), F.substring(t, 3, 1 << 30)), ignorenulls=True).over(above))


def word_runs(lines: DataFrame, key: str, least: int) -> DataFrame:
    """Runs of at least `least` lines of one word each outside of code: the first place and the length of each."""
    words = lines.filter(~F.col("in_code") & F.col("line").rlike(r"^[ \t]*[A-Za-z][A-Za-z0-9&+/-]{1,23}[ \t]*$"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    runs = words.withColumn("_run", island).groupBy(key, "_run").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    return runs.filter(F.col("n") >= least).select(key, "first", "n")
