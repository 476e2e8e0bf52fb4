"""The corpus pipeline: five stages over the documents table, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import cut, table
from pagemill.llm.decontamination import decontaminate
from pagemill.llm.jaccard_join import jaccard_classes
from pagemill.llm.language_id import UNKNOWN, fit, held_out, identify
from pagemill.llm.line_dedup import dedup_lines
from pagemill.llm.segmentation import encode_samples, read_model


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents in which no language can be told (no text, no letters) go; a missing lang is filled in."""
    model = fit(docs.filter(~held_out()))
    known = identify(docs, model).filter(F.col("lang_pred") != UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: later repeated runs of lines leave the texts; a document of which no line is left goes."""
    done = dedup_lines(docs).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _counted(done, docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of every component of near duplicates the document with the smallest id stays, once if it is repeated;
    rows without an id stay once for each text."""
    classes = jaccard_classes(docs)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    stays = classes.filter((F.col("doc_id") == F.col("component_id")) | F.col("doc_id").isNull()).select(key.alias("_id")).distinct()
    kept = docs.withColumns({"_id": key, "_hash": F.xxhash64("text"), "_more": F.xxhash64(F.lit(9), "text")}).join(stays, "_id", "left_semi")
    return kept.dropDuplicates(["_id", "_hash", "_more"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: benchmark passages leave the texts, and documents that are mostly such passages go."""
    return _counted(decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every document with the piece ids, log probability and inclusion score of its first sampled segmentation,
    and in `others` those of its further ones, as many as operator 6 draws."""
    done = encode_samples(docs, read_model())
    of = ["ids", "n_pieces", "log_prob", "inclusion"]
    samples = F.arrays_zip(*(F.col(f"samples.{name}").alias(name) for name in of))
    first = [F.get(f"samples.{name}", F.lit(0)).alias(name) for name in of]
    return done.select("doc_id", "lang", "source", *first, F.slice(samples, F.lit(2), F.greatest(F.size(samples) - 1, F.lit(0))).alias("others"))


def _counted(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars in step with the text."""
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("segmentation", segmentation),
]

#: Sampled segmentations and the fitted language model are beyond SQL; tests/llm check the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
