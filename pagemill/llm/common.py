"""What several operators share: reading tables, checkpoints and the word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A separator of words in a Java regular expression: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the session names in spark.checkpoint.dir; only a session without one, as in tests, gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="pagemill-"))


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of an action go when the action ends, and not whenever the driver collects its garbage.
    For actions whose result is all that is read again; Spark recomputes what is asked for once more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared checkpoint folder: lost executors cost no recomputation of what lies before, and the
    shuffle files that led to it go."""
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    with brief_shuffles(spark):
        # Planned here: a frame that has run already keeps the setting of its first run.
        return frame.select("*").checkpoint(eager=True)


#: Rows of an Arrow batch where the session has no setting of its own: texts are long, and a worker holds a batch twice.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default of 10,000 rows, unless the session was given a number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Gives memory that a worker no longer uses back to the system; the worker itself waits for the next stage."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def unused(frame: DataFrame, name: str) -> str:
    """A name for a working column that no column of the frame has, in any case of letters."""
    taken = {c.lower() for c in frame.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def words(text: Column) -> Column:
    """The words of a text: what stands between separators. Null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often the body uses it, even inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
