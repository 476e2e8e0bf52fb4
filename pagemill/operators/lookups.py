"""Lookups of a query set, as a benchmark is, in every row of a table.

The query set goes out as an index; a set beyond a block's bound goes out in blocks, one after another, so that a worker
holds the index of one block at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

#: Bytes of a query set that one index holds, tokens a worker remembers, and bytes of a token that it remembers.
BLOCK_BYTES, REMEMBERED, TOKEN_BYTES = 500_000, 200_000, 64


class Headings:
    """Normalised headings, to be asked whether any is equivalent to a given one by the rule of `headings_equivalent`."""

    def __init__(self, headings: list[str]):
        self.whole = set(headings)
        self.grams: dict[str, list[str]] = {}
        self.starts: dict[str, list[str]] = {}
        self.sizes: list[int] = []
        self.holders: dict[str, list[int]] = {}
        for h in sorted(self.whole):
            for gram in {h[i : i + 20] for i in range(len(h) - 19)}:
                self.grams.setdefault(gram, []).append(h)
            if len(h) >= 20:
                self.starts.setdefault(h[:20], []).append(h)
            tokens = {t for t in h.split(" ") if len(t) > 2}
            for t in tokens:
                self.holders.setdefault(t, []).append(len(self.sizes))
            self.sizes.append(len(tokens))

    def equivalent(self, h: str | None) -> bool:
        return bool(h) and (h in self.whole or self._by_words(h) or self._inside(h))

    def _by_words(self, h: str) -> bool:
        tokens = [t for t in h.split(" ") if len(t) > 2]
        shared: dict[int, int] = {}
        for t in tokens:
            for item in self.holders.get(t, ()):
                n = shared[item] = shared.get(item, 0) + 1
                if n >= min(3, len(tokens), self.sizes[item]):
                    return True
        return False

    def _inside(self, h: str) -> bool:
        if any(h in other for other in self.grams.get(h[:20], ()) if len(h) >= 20):
            return True
        return any(h.startswith(other, i) for i in range(len(h) - 19) for other in self.starts.get(h[i : i + 20], ()))


class Words(dict):
    """Words without white space, of four bytes or more; a token's entry holds the numbers of those inside it."""

    def __init__(self, words: list[bytes]):
        super().__init__()
        self.starts: dict[bytes, list[tuple[int, bytes]]] = {}
        for i, w in enumerate(words):
            self.starts.setdefault(w[:4], []).append((i, w))

    def __missing__(self, token: bytes) -> tuple[int, ...]:
        found = tuple({n for i in range(len(token) - 3) for n, w in self.starts.get(token[i : i + 4], ()) if token.startswith(w, i)})
        if len(token) <= TOKEN_BYTES:
            if len(self) > REMEMBERED:
                self.clear()
            self[token] = found
        return found

    def count(self, text: str | None) -> int:
        found: set[int] = set()
        for token in set(text.encode("utf-8", "surrogatepass").split()) if text else ():
            found.update(self[token])
        return len(found)


def _in_blocks(rows: DataFrame, into: str, queries: DataFrame, step: Callable) -> DataFrame:
    """The rows with the column `into`, which step makes from the queries of each block and what it was before."""
    n_bytes = queries.agg(F.sum(F.octet_length("q"))).first()[0] or 0
    n_blocks = max(1, math.ceil(n_bytes / BLOCK_BYTES))
    for block in range(n_blocks):
        if block:
            # A stage of its own for each block, so that no task runs the workers of two.
            rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        of_block = queries if n_blocks == 1 else queries.filter(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == block)
        rows = rows.withColumn(into, step([r["q"] for r in of_block.toLocalIterator()]))
    return rows


def equivalent_headings(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of left whose normalised heading h is equivalent to a value of right.h. Null and empty headings are
    equivalent to none; every row counts by itself."""
    context = left.sparkSession.sparkContext

    def step(headings: list[str]):
        shared = context.broadcast(headings)

        @pandas_udf("boolean")
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = Headings(shared.value)
            for batch in batches:
                yield pd.Series([index.equivalent(h) for h in batch], dtype=bool)

        return F.col("_found") | found.asNondeterministic()("h")

    queries = right.select(F.col("h").alias("q")).filter("q != ''").distinct()
    return _in_blocks(left.withColumn("_found", F.lit(False)), "_found", queries, step).filter("_found").drop("_found")


def words_inside(rows: DataFrame, words: DataFrame, text: str = "text", into: str = "n") -> DataFrame:
    """The rows with the number of distinct words of words.w that stand anywhere in the text, inside its words too. A word
    has four characters or more and no white space; a null text holds none."""
    context = rows.sparkSession.sparkContext

    def step(block: list[str]):
        shared = context.broadcast([w.encode("utf-8", "surrogatepass") for w in block])

        @pandas_udf("long")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = Words(shared.value)
            for batch in batches:
                yield pd.Series([index.count(t) for t in batch], dtype="int64")

        return F.col(into) + count.asNondeterministic()(F.col(text))

    return _in_blocks(rows.withColumn(into, F.lit(0).cast("long")), into, words.select(F.col("w").alias("q")).distinct(), step)
