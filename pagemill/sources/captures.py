"""Sources of pages and captures, and the contract that a capture keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("html", "url", "title", "selectionHash")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from Parquet with the columns page_id, url and html."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_html_folder(spark: SparkSession, path: str) -> DataFrame:
    """Pages from a folder of .html files: url is the file's path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.htm*").text(path, wholetext=True)
    return files.select(F.xxhash64("_metadata.file_path").alias("page_id"), F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def read_markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files below a folder: file, relative to it, and content."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    root = path.rstrip("/").rsplit("/", 1)[-1]
    return files.select(F.substring_index(F.col("_metadata.file_path"), f"/{root}/", -1).alias("file"), F.col("value").alias("content"))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """A model catalogue in JSON, {"data": [{id, name, pricing{...}}]}: one row per entry with its prices as numbers."""
    schema = "data array<struct<id: string, name: string, pricing: map<string, string>>>"
    entries = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("data"))
    return entries.select("id", "name", F.transform(F.map_values("pricing"), lambda p: p.try_cast("double")).alias("prices"))


def validate(captures: DataFrame, clip: int = 200_000) -> DataFrame:
    """The captures with `missing`, the names of required fields that are null or blank, and metadataHtml clipped."""
    absent = F.array_compact(F.array(*(F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) == "", F.lit(f)) for f in REQUIRED)))
    return captures.withColumns({"missing": absent, "metadataHtml": F.substring("metadataHtml", 1, clip)})


def clamp(value: Column, low: float, high: float, default: float) -> Column:
    """The value inside its bounds; null and not-a-number give the default."""
    number = value.cast("double")
    return F.least(F.greatest(F.coalesce(F.when(F.isnan(number), None).otherwise(number), F.lit(float(default))), F.lit(float(low))), F.lit(float(high)))


def keep_deep(text_before: Column, text_after: Column, headings_before: Column, headings_after: Column, gain: float = 0.2) -> Column:
    """Whether the deep capture of a page replaces the first: more text, and a fair gain of it or two more headings."""
    grown = (text_after - text_before) / F.greatest(text_before, F.lit(1))
    return (text_after > text_before) & ((grown >= gain) | (headings_after - headings_before >= 2))
