"""Token counts of sections, from one encoding of the whole document and the character spans of its tokens."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from pagemill.llm.common import bounded_batches, table

#: Where the vocabulary files of this machine lie; a parameter of every function that needs them.
TOKENIZERS = "/opt/tokenizers"
#: The published splitting pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "majority", "split")


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


class Attribution:
    """Encodes texts and gives the tokens of each section, boundary-crossing tokens by the rule."""

    def __init__(self, ranks: dict[bytes, int], rule: str):
        import tiktoken

        if rule not in RULES:
            raise ValueError(f"no such rule: {rule}; there are {', '.join(RULES)}")
        self.rule = rule
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self.width[rank] = len(piece)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one character of every token. A token that holds part of a character covers it."""
        raw = text.encode("utf-8", "surrogatepass")
        ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        stop = np.cumsum(self.width[ids])
        start = stop - self.width[ids]
        if len(raw) == len(text):
            return start, stop
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        return char[start], char[stop - 1] + 1

    def count(self, text: str, bounds: np.ndarray) -> tuple[int, int, np.ndarray]:
        """Tokens, tokens that cross a bound, and tokens of each section; section i runs from bounds[i] to bounds[i + 1]."""
        n = len(bounds) - 1
        if not text:
            return 0, 0, np.zeros(n)
        start, stop = self.spans(text)
        first = np.searchsorted(bounds, start, "right") - 1
        last = np.searchsorted(bounds, stop - 1, "right") - 1
        crossing = np.flatnonzero(first < last)
        if self.rule == "end":
            return len(start), len(crossing), np.bincount(last, minlength=n).astype(float)
        counts = np.bincount(first, minlength=n).astype(float)
        if self.rule == "start":
            return len(start), len(crossing), counts
        for token in crossing.tolist():
            inner = bounds[first[token] + 1 : last[token] + 1]
            shares = np.diff(np.concatenate(([start[token]], inner, [stop[token]])))
            counts[first[token]] -= 1
            if self.rule == "split":
                counts[first[token] : last[token] + 1] += shares / shares.sum()
            else:
                counts[first[token] + int(shares.argmax())] += 1
        return len(start), len(crossing), counts


def line_bounds(text: str) -> np.ndarray:
    """Bounds of the lines of a text in characters; a line feed belongs to the line that it ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inner = np.flatnonzero(codes == 10) + 1
    return np.concatenate(([0], inner[inner < len(codes)], [len(codes)])) if len(codes) else np.zeros(1, np.int64)


def attribute_tokens(documents: DataFrame, ranks: dict[bytes, int], text: str = "text", bounds: str | Column | None = None, rule: str = "majority") -> DataFrame:
    """The documents with the struct `tokens`: n_tokens, n_crossing and by_section, the tokens of each section.

    Sections are the lines of the text, or what lies between the ascending character offsets in the array `bounds`, of
    which the first must be 0 and the last the length of the text. The text is encoded once, whole; tokens are joined
    to sections by their character spans. A token that crosses a bound counts where it starts (`start`), where it ends
    (`end`), where most of its characters lie, the earlier section on a tie (`majority`), or in parts in proportion to
    them (`split`), so the counts of the sections always sum up to n_tokens. Null and empty texts have no tokens and no
    lines. Repeated rows are counted one by one and alike; extra columns stay, whatever their names, and one named tokens is
    replaced. An empty table gives an empty table.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(ranks)
    made: list[Attribution] = []

    @pandas_udf("struct<n_tokens: bigint, n_crossing: bigint, by_section: array<double>>")
    def count(texts: pd.Series, offsets: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Attribution(shared.value, rule))
        rows = []
        for body, given in zip(texts, offsets, strict=True):
            body = body or ""
            rows.append(made[0].count(body, line_bounds(body) if given is None else np.asarray(given, np.int64)))
        return pd.DataFrame({"n_tokens": [r[0] for r in rows], "n_crossing": [r[1] for r in rows], "by_section": [r[2] for r in rows]})

    given = F.lit(None).cast("array<int>") if bounds is None else F.col(bounds) if isinstance(bounds, str) else bounds
    return documents.withColumn("tokens", count(F.col(f"`{text}`"), given.cast("array<int>")))


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Tokens of every document and of each of its lines."""
    ranks = load_ranks(f"{tokenizers}/byte_bpe_50k.tiktoken")
    counted = attribute_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks)
    lines = F.transform("tokens.by_section", lambda n: n.cast("long"))
    return counted.select("doc_id", "tokens.n_tokens", F.size(lines).cast("long").alias("n_sections"), "tokens.n_crossing", lines.alias("section_tokens"))


QUERIES = {"op8_token_counts": op8_token_counts}
SQL: dict[str, str] = {}
