"""Language identification by words first, with backoff to shorter and shorter character n-grams for unseen words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from pagemill.llm.common import bounded_batches, cut, release, table, unused

WORDS = re.compile(r"[^\W\d_]+")
#: Bounds of the labelled rows that the fit reads: documents that a language gives, and characters of all languages together.
SAMPLE_DOCS, SAMPLE_CHARS = 2_500, 24_000_000
#: Longest n-gram that an unseen word falls back to, and the n-grams of a word that are held at once.
LONGEST, PIECE = 5, 10_000
UNKNOWN = "und"


@dataclass
class Model:
    """Log probabilities by language of words and of n-grams of each length, as rows of one matrix."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray


def _grams(word: str, size: int) -> Iterator[str]:
    """All n-grams of the word, however long it is."""
    padded = f"_{word}_"
    return (padded[i : i + size] for i in range(len(padded) - size + 1))


def fit(documents: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A model of the labelled documents given.

    Every language gives a sample of SAMPLE_DOCS documents and of its part of SAMPLE_CHARS characters in expectation, or
    all it has; it is drawn by a hash of the key, and its texts are read whole. All words of the sample and all their
    n-grams enter the model, so the two bounds on labelled rows also bound what reaches the driver. Rows without a text or
    a language teach nothing; repeated rows count each; no labelled rows give a model that knows no language.
    """
    rows = documents.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{key}`").alias("key"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: (r["n"], r["chars"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {}, {}, np.zeros((0, 0), np.float32))
    share = {x: min(1.0, SAMPLE_DOCS / n, SAMPLE_CHARS / len(languages) / max(1, chars)) for x, (n, chars) in sizes.items()}
    shares = F.create_map(*(F.lit(x) for name in languages for x in (name, share[name])))
    drawn = F.pmod(F.xxhash64(F.lit(4), "key"), F.lit(1 << 30)) < shares[F.col("lang")] * (1 << 30)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                seen = Counter(w for t in texts for w in WORDS.findall(t.lower()))
                yield pd.DataFrame({"lang": name, "word": list(seen), "n": list(seen.values())})

    counted = rows.filter(drawn).select("text", "lang").mapInPandas(count, "lang string, word string, n long")
    columns = [f"c{i}" for i in range(len(languages))]
    of = [F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).cast("double").alias(column) for name, column in zip(languages, columns, strict=True)]
    known = cut(counted.groupBy(F.col("word").alias("unit")).agg(*of))
    schema = "unit string, " + ", ".join(f"{column} double" for column in columns)
    parts = known.mapInPandas(_gram_counts, schema)
    words, scores = _learnt(known, columns)
    grams, gram_scores = _learnt(parts.groupBy("unit").agg(*(F.sum(column).alias(column) for column in columns)), columns, by_length=True)
    model = Model(languages, words, {gram: at + len(words) for gram, at in grams.items()}, np.concatenate([scores, gram_scores]))
    del grams, scores, gram_scores
    release()
    return model


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The n-grams of words, with the counts of the words by language."""
    for batch in batches:
        columns, places, found = list(batch.columns[1:]), {}, []
        for owner, word in enumerate(batch["unit"]):
            for size in range(1, LONGEST + 1):
                grams = _grams(word, size)
                # A long run of letters holds few different n-grams, many times each.
                for gram, times in Counter(grams).items() if len(word) > 100 else zip(grams, repeat(1), strict=False):
                    found.append((places.setdefault(gram, len(places)), owner, times))
        at, owners, times = np.array(found, np.int64).reshape(-1, 3).T
        sums = np.zeros((len(places), len(columns)))
        np.add.at(sums, at, batch[columns].to_numpy(np.float64)[owners] * times[:, None])
        yield pd.concat([pd.DataFrame({"unit": list(places)}), pd.DataFrame(sums, columns=columns)], axis=1)


def _learnt(counted: DataFrame, columns: list[str], by_length: bool = False) -> tuple[dict[str, int], np.ndarray]:
    """Words or n-grams by place, and the log shares of the languages in them; n-grams are set against those of their length."""
    found = counted.toArrow().sort_by("unit")
    units = found["unit"].to_pylist()
    counts = np.column_stack([found[column].to_numpy() for column in columns]) + 0.1
    scores = np.empty(counts.shape, np.float32)
    kinds = np.array([len(u) for u in units], np.int64) if by_length else np.zeros(len(units), np.int64)
    for kind in np.unique(kinds):
        scores[kinds == kind] = _likelihoods(counts[kinds == kind])
    return {unit: i for i, unit in enumerate(units)}, scores


def _likelihoods(counts: np.ndarray) -> np.ndarray:
    """Log shares of the languages in each unit, each language's counts taken relative to their sum."""
    logs = np.log(counts / counts.sum(axis=0))
    logs -= logs.max(axis=1, keepdims=True)
    return (logs - np.log(np.exp(logs).sum(axis=1, keepdims=True))).astype(np.float32)


class Scorer(dict):
    """Rows of a growing matrix by word: known words have theirs, unseen ones get the mean of their longest known n-grams."""

    SPARE = 200_000

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.known = model, len(model.scores)
        self.rows = np.concatenate([model.scores, np.zeros((self.SPARE, len(model.languages)), np.float32)])
        self.used = self.known

    def __missing__(self, word: str) -> int:
        if self.used == len(self.rows):
            self.clear()
            self.update(self.model.words)
            self.used = self.known
        for size in range(LONGEST, 0, -1):
            found = (self.model.grams[g] for g in _grams(word, size) if g in self.model.grams)
            total, n = np.zeros(len(self.model.languages)), 0
            while piece := list(islice(found, PIECE)):
                total += self.model.scores[piece].sum(axis=0, dtype=np.float64)
                n += len(piece)
            if n:
                self.rows[self.used] = total / n
                break
        else:
            self.rows[self.used] = -math.log(max(1, len(self.model.languages)))
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORDS.findall(text.lower()) if text else []
        if not any(c.isalpha() for w in words for c in w) or not self.model.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages))
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            if self.used + len(part) > len(self.rows):
                self.clear()
                self.update(self.model.words)
                self.used = self.known
            total += self.rows[list(map(self.__getitem__, part))].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def identify(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with lang_pred, a language of the model, and score, its share of the likelihood from 0 to 1.

    Texts are read whole; nothing but the text enters the prediction. Null texts and texts without a letter get `und`
    with score 0, as does every text if the model knows no language. Ties go to the language first in the alphabet.
    Repeated rows get the same prediction each; other columns stay, whatever their names, and columns of the two names
    are replaced. An empty table gives an empty table.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    made: list[Scorer] = []

    @pandas_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(Scorer(shared.value))
        for texts in batches:
            yield pd.DataFrame([made[0].predict(t) for t in texts], columns=["lang_pred", "score"])

    # Marked as not deterministic so that a later filter on the prediction doesn't make Spark predict twice.
    at = unused(documents, "lang")
    done = documents.withColumn(at, predict.asNondeterministic()(F.col(f"`{text}`")))
    return done.withColumns({"lang_pred": F.col(f"{at}.lang_pred"), "score": F.col(f"{at}.score")}).drop(at)


def held_out(key: str = "doc_id"):
    """Whether a row is kept out of the fit: the CRC-32 of its key as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt from those not held out."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents.filter(~held_out()))
    return identify(documents.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
