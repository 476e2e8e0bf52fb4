"""Benchmark decontamination by a generalised suffix automaton of the benchmark items.

The automaton holds every run of words of every item. A document streams through it word by word; the state gives the
longest run that ends here and stands in some item. Only stretches whose neighbouring words are neighbours in some item
are streamed, which changes nothing in the result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from pagemill.llm.common import bounded_batches, cut, table, unused

#: Words of a benchmark that one automaton holds; a larger benchmark is cut into blocks that go out one after another.
BLOCK_WORDS = 500_000
#: Letters A to Z become small, all other bytes but digits, small letters and those beyond ASCII become separators.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def normal_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Ids(dict):
    """Numbers of the words of the items from 1; any other word is 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


class SuffixAutomaton:
    """All runs of words of a list of items, with the items that hold each run of at least `window` words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.ids, self.names = window, Ids(), []
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        held: list[set[int]] = [set()]
        short: list[tuple[int, list[int]]] = []
        pairs, self.least = set(), window
        for name, words in items:
            if not words:
                continue
            item = len(self.names)
            self.names.append(name)
            codes = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            pairs.update(zip(codes, codes[1:], strict=False))
            last = 0
            for code in codes:
                last = self._extend(last, code, held)
                held[last].add(item)
            if len(codes) < window:
                short.append((item, codes))
                self.least = min(self.least, len(codes))
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(by_length):
            up = self.link[state]
            if self.length[up] >= window:
                held[up] |= held[state]
        ends: dict[int, list[tuple[int, int]]] = {}
        for item, codes in short:
            state = 0
            for code in codes:
                state = self.next[state][code]
            ends.setdefault(state, []).append((len(codes), item))
        #: Of each state: the state of the last `window` words of its runs, and the short items that its runs can end in.
        self.tail, self.ends = [-1] * len(self.length), [()] * len(self.length)
        for state in by_length:
            up = self.link[state]
            self.ends[state] = (*self.ends[up], *ends.get(state, ()))
            if self.length[state] >= window:
                self.tail[state] = self.tail[up] if self.length[up] >= window else state
        self.held = [frozenset(h) if n >= window else frozenset() for h, n in zip(held, self.length, strict=True)]
        self.bits = max(16, (64 * len(pairs)).bit_length())
        self.pairs = np.zeros(1 << self.bits, bool)
        if pairs:
            both = np.array(sorted(pairs), np.int64)
            self.pairs[self._slot(both[:, 0], both[:, 1])] = True

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) & ((1 << self.bits) - 1)

    def _state(self, length: int, link: int, steps: dict[int, int], held: list[set[int]], items: set[int]) -> int:
        self.length.append(length), self.link.append(link), self.next.append(steps), held.append(items)
        return len(self.length) - 1

    def _split(self, p: int, code: int, q: int, held: list[set[int]]) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), held, set())
        while p >= 0 and self.next[p].get(code) == q:
            self.next[p][code] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, code: int, held: list[set[int]]) -> int:
        if (q := self.next[last].get(code)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, code, q, held)
        new, p = self._state(self.length[last] + 1, 0, {}, held, set()), last
        while p >= 0 and code not in self.next[p]:
            self.next[p][code] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][code]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, code, q, held)
        return new

    def stretches(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where runs of the items can lie: [start, end) of at least as many words as the shortest window has."""
        if len(codes) < self.least:
            return
        joined = self.pairs[self._slot(codes[:-1], codes[1:])] & (codes[:-1] > 0) & (codes[1:] > 0)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], joined, [False])).astype(np.int8)))
        if self.least > 1:
            for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if end - start + 1 >= self.least:
                    yield start, end + 1
            return
        inside = np.flatnonzero(np.diff(np.concatenate(([False], codes > 0, [False])).astype(np.int8)))
        yield from zip(inside[::2].tolist(), inside[1::2].tolist(), strict=True)

    def match(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans [start, end) of hit words, in order and apart, and the names of the items found."""
        spans: list[list[int]] = []
        found: set[int] = set()
        for start, end in self.stretches(codes):
            state = length = 0
            for at, code in enumerate(codes[start:end].tolist(), start + 1):
                while state and code not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                state = self.next[state].get(code, 0)
                length = length + 1 if state else 0
                hit = 0
                if length >= self.window:
                    hit = length
                    found |= self.held[self.tail[state]]
                for size, item in self.ends[state]:
                    if size <= length:
                        hit = max(hit, size)
                        found.add(item)
                if hit:
                    while spans and spans[-1][0] >= at - hit:
                        spans.pop()
                    if spans and spans[-1][1] >= at - hit:
                        spans[-1][1] = at
                    else:
                        spans.append([at - hit, at])
        return [(a, b) for a, b in spans], {self.names[i] for i in found}


FOUND = "struct<n_words: bigint, spans: array<struct<first: int, last: int, start: int, stop: int>>, items: array<string>>"


def _finder(spark: SparkSession, items: list[tuple[str, str | None]], window: int) -> Callable:
    shared = spark.sparkContext.broadcast(SuffixAutomaton([(name, normal_words(text)) for name, text in items], window))

    @pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        automaton, counts, spans, names = shared.value, [], [], []
        for text in texts:
            words = normal_words(text)
            codes = np.fromiter(map(automaton.ids.__getitem__, words), np.int64, len(words))
            hit, found = automaton.match(codes)
            if hit:
                places = [m.span() for m in WORD.finditer(text)]
                hit = [{"first": a, "last": b - 1, "start": places[a][0], "stop": places[b - 1][1]} for a, b in hit]
            counts.append(len(words)), spans.append(hit), names.append(sorted(found))
        return pd.DataFrame({"n_words": counts, "spans": spans, "items": names})

    # Marked as not deterministic so that a later filter on the spans doesn't make Spark search twice.
    return find.asNondeterministic()


def _united(spans: Column) -> Column:
    """Spans of several automata as spans that lie apart, in order."""

    def step(done: Column, s: Column) -> Column:
        top = F.element_at(done, -1)
        longer = F.struct(top["first"].alias("first"), F.greatest(top["last"], s["last"]).alias("last"), top["start"].alias("start"), F.greatest(top["stop"], s["stop"]).alias("stop"))
        joins = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["last"] + 1 >= s["first"])
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    kind = "array<struct<first: int, last: int, start: int, stop: int>>"
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def find_overlaps(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, into: str = "found") -> DataFrame:
    """The documents with the struct `found` (or `into`): n_words, spans of hit words (word places and character offsets), items.

    A window is `window` consecutive words of an item, or a whole item of fewer words; a word of a document is hit if
    it lies inside an occurrence of a window. Null, empty and wordless texts have no words and no hits; items without
    words have no windows. Items that share an id count as one; one without an id goes by the empty string. Repeated
    rows get the same result each; extra columns stay, whatever their names, and one named like the result is replaced. An
    empty table gives an empty table, an empty benchmark hits nothing. The benchmark is the stated query set: it goes out in
    blocks of at most about BLOCK_WORDS words, each an automaton of its own, and a worker holds one at a time. One block
    is one stage without a shuffle; more of them read the documents once each, with what was found so far written to a
    checkpoint between them. Texts are taken whole.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("name"), F.col(f"`{item_text}`").alias("body"))
    n_bytes = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_blocks = max(1, math.ceil(n_bytes / 5 / BLOCK_WORDS))
    done, at = documents, unused(documents, "parts")
    for block in range(n_blocks):
        of_block = rows if n_blocks == 1 else rows.filter(F.pmod(F.xxhash64("body"), F.lit(n_blocks)) == block)
        items = [(r["name"], r["body"]) for r in of_block.toLocalIterator()]
        part = _finder(spark, items, window)(F.col(f"`{text}`"))
        if n_blocks == 1:
            return documents.withColumn(into, part)
        done = cut(done.withColumn(at, F.concat(F.col(at), F.array(part)) if block else F.array(part)))
    spans, names = _united(F.flatten(F.transform(at, lambda f: f["spans"]))), F.flatten(F.transform(at, lambda f: f["items"]))
    return done.withColumn(into, F.struct(F.get(at, F.lit(0))["n_words"].alias("n_words"), spans.alias("spans"), names.alias("items"))).drop(at)


def n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """The documents without benchmark passages: hit spans leave the text, and a document of which more than max_coverage
    of the words are hit leaves whole. Null, empty and wordless texts have no hits and stay; repeated rows are treated
    alike. Other columns, whatever their names, and untouched texts stay as they are. An empty table gives an empty table."""
    at = unused(documents, "found")
    hit = find_overlaps(documents, benchmark, text=text, window=window, into=at).filter(n_hit(F.col(at)) <= F.lit(max_coverage) * F.col(f"{at}.n_words"))
    source, spans = F.col(f"`{text}`"), F.col(f"{at}.spans")
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["stop"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(source)))
    kept = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: F.substring(source, p["a"] + 1, p["b"] - p["a"]))
    return hit.withColumn(text, F.when(F.size(spans) > 0, F.array_join(kept, " ")).otherwise(source)).drop(at)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and found items of every document."""
    found = find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct("found.items"))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit(F.col("found")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), grams AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i+n-1], ' ') AS g
  FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM grams),
places AS (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n),
hits AS MATERIALIZED (
  SELECT p.rid, p.i, p.n, g.item FROM places p JOIN grams g ON g.n = p.n AND g.g = array_to_string(p.ws[p.i:p.i+p.n-1], ' ')
), words AS (SELECT rid, count(DISTINCT spot) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS spot FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(w.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.names, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words w USING (rid) LEFT JOIN items t USING (rid)
"""

QUERIES = {"op7_decontamination": op7_decontamination}
SQL = {"op7_decontamination": ORACLE}
