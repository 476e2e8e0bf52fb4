"""Sharding by proportional stratified interleaving, with exact distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import cut, table

#: Rows that one task ranks at a time: a source or a stretch of the mixture with more is cut into more buckets. A four
#: hundredth of the table, but no fewer than the first and no more than the second number. Buckets don't change results.
BUCKET_ROWS = (500, 20_000)


def _unit(value: Column) -> Column:
    """A 63-bit hash as a number from 0 to below 1, in the same order."""
    return F.shiftright(value, 10).cast("double") / float(1 << 53)


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """The rows with `name`: their rank from 1 within the group, where a lower bucket always comes first.

    Rows are counted by bucket, the counts summed up to offsets, and only rows of one bucket are sorted together, so
    that no task holds a whole group. The offsets are as many as there are buckets.
    """
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(g).alias(f"_o{g}") for g in group), F.col(bucket).alias("_ob"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col(bucket) == F.col("_ob")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_o{g}"))
    within = Window.partitionBy(*group, bucket).orderBy(*order)
    placed = rows.withColumn("_in", F.row_number().over(within)).join(offsets, same)
    return placed.withColumn(name, F.col("_before") + F.col("_in")).drop("_in", "_before", "_ob", *(f"_o{g}" for g in group))


def interleave(rows: DataFrame, key: list[str], by: str = "source", n_shards: int = 8, seed: int = 20, bucket_rows: int | None = None) -> DataFrame:
    """The rows with `shard` and `slot`, every shard in the mixture of the whole by the column `by`.

    Rows of one source are shuffled by a seeded hash of the key columns and get the fractional rank (rank - 1/2) / rows
    of the source. In the order of fractional ranks the rows are cut into n_shards stretches whose counts differ by one
    at most; slots of a shard run from 0 without gaps. Null is a source of its own. Rows equal in all key columns are
    interchangeable: each gets a place of its own. An empty table gives an empty result. Only the columns given come
    along, so pass keys and not texts. The names shard and slot are replaced, and the input is written to a checkpoint.
    """
    hashed = rows.withColumn("_x", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 1))
    base = cut(hashed)
    total = base.count()
    bucket_rows = bucket_rows or min(BUCKET_ROWS[1], max(BUCKET_ROWS[0], total // 400))
    sizes = base.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_rows"))
    spread = base.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    spread = spread.withColumn("_b", F.floor(_unit(F.col("_x")) * F.ceil(F.col("_rows") / bucket_rows)))
    ranked = _ranked(spread, [by], "_b", ["_x", *key], "_rank").drop("_b")
    ranked = ranked.withColumn("_f", (F.col("_rank") - 0.5) / F.col("_rows"))
    stretched = ranked.withColumn("_g", F.floor(F.col("_f") * max(1, -(-total // bucket_rows))))
    placed = _ranked(stretched, [], "_g", ["_f", F.col(by).asc_nulls_first(), "_x", *key], "_place").drop("_g")
    at = F.col("_place") - 1
    shard = F.expr(f"cast(cast((_place - 1) as decimal(38,0)) * {n_shards} div {max(1, total)} as int)")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard).withColumn("slot", (at - first).cast("long")).drop("_x", "_rows", "_rank", "_f", "_place")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts and equal mixture of sources."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = interleave(rows, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


QUERIES = {"op2_sharding": op2_sharding}
SQL: dict[str, str] = {}
