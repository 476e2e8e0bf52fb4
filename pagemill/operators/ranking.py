"""Ranking of candidates and the shares of ranked rows that are kept.

All windows are partitioned by page (or another key), so that one task sorts the candidates of one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEVER = 9007199254740991


def rank_candidates(candidates: DataFrame, key: str, min_length: Column | int = 1) -> DataFrame:
    """The candidates that are long enough with `rank` from 1 within their page: score and retention high first, then
    penalty and processing time low, then source and the place in the pool. A missing time counts as the longest."""
    time = F.when(F.col("processing_ms").isNull(), float(NEVER)).otherwise(F.greatest(F.col("processing_ms"), F.lit(0.0)))
    order = [F.col("score").desc(), F.col("retention").desc(), F.col("penalty"), time, F.col("source"), F.col("place")]
    viable = candidates.filter((F.col("text_length") > 0) & (F.col("text_length") >= min_length))
    return viable.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def winners(ranked: DataFrame) -> DataFrame:
    return ranked.filter("rank = 1")


def traces(ranked: DataFrame, key: str, most: int = 5) -> DataFrame:
    """One row per page: the best candidates in order; the first one of a site adapter takes the last place if need be."""
    is_adapter = F.col("source").startswith("adapter:")
    first_adapter = F.min(F.when(is_adapter, F.col("rank"))).over(Window.partitionBy(key))
    forced = (F.col("rank") == F.col("_adapter")) & (F.col("_adapter") > most)
    marked = ranked.withColumn("_adapter", first_adapter)
    kept = marked.filter(forced | (F.col("rank") < most) | ((F.col("rank") == most) & ~F.coalesce(F.col("_adapter") > most, F.lit(False))))
    entry = F.struct("rank", "source", "score")
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda t: t["source"]).alias("traces"))


def select_stage(stages: DataFrame, key: str) -> DataFrame:
    """The stage of each page that is used: those that met their threshold first, then by selection score, quality, priority."""
    order = [F.col("passed").desc(), F.col("selection").desc(), F.col("quality").desc(), F.col("priority").desc(), F.col("stage")]
    return stages.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def latest(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The last `most` rows of every group in the order given."""
    back = Window.partitionBy(*keys).orderBy(*(F.col(o).desc() if isinstance(o, str) else o for o in order))
    return rows.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= most).drop("_r")


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of every group; groups of equal keys, however large, are met by partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return picked.select(*keys, "_first.*").select(*rows.columns)
