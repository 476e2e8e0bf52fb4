"""Quality rules: a threshold table compiled into one projection, with built-in expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import let, table, words

#: Frequent function words of the corpus languages, by language.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on are as with be by at this an or from not".split(),
    "de": "der die und den das von zu mit ist des im für auf dem nicht ein eine sich auch es in".split(),
    "fr": "de la le et les des un une du en que qui dans pour sur pas par est au plus ne".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo".split(),
}
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule if the metric lies outside [low, high]; a null metric breaks none."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The table of thresholds. Metrics are the keys of metrics().
RULES = (
    Rule("few_words", "n_words", low=20),
    Rule("word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.10),
    Rule("marks", "mark_ratio", high=0.35),
    Rule("stop_words", "stop_ratio", low=0.03),
    Rule("same_words", "distinct_ratio_gap", high=0.60),
    Rule("same_lines", "dup_line_ratio", high=0.50),
    Rule("listed_lines", "bullet_line_ratio", high=0.90),
)


def _windows(tokens: Column) -> Column:
    """Words of the text that stand in a window of WINDOW words found twice or more, the first find included."""

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def of(pairs: Column) -> Column:
            def again(pair: Column, at: Column) -> Column:
                same = (F.get(pairs, at - 1)["g"] == pair["g"]) | (F.get(pairs, at + 1)["g"] == pair["g"])
                return F.when(same, pair["i"])

            starts = F.sort_array(F.filter(F.transform(pairs, again), lambda i: i.isNotNull()))
            begin = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
            return F.aggregate(starts, begin, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(placed, of))

    def hashed(codes: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(codes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(codes, i, WINDOW)))
        return let(grams, covered)

    return F.when(F.size(tokens) <= WINDOW, F.lit(0)).otherwise(let(F.transform(tokens, lambda w: F.xxhash64(w)), hashed))


def _dup_lines(lines: Column) -> Column:
    return F.size(lines) - F.size(F.array_distinct(lines))


def _base(text: Column) -> Column:
    """One struct of raw counts, from one splitting of the text into words and one into lines."""
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))

    def of(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, _dup_lines).cast("long").alias("n_dup_lines"),
            _windows(tokens).cast("long").alias("n_repeat_words"),
            F.size(F.filter(tokens, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(stops))).cast("long").alias("n_stop_words"),
            F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct_words"),
            (F.length(text) - F.length(F.translate(text, "!?", ""))).cast("long").alias("n_marks"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(lines, lambda line: line.rlike(r"^\s*[-*•]\s"))).cast("long").alias("n_bullet_lines"),
        )

    return let(words(text), of)


def metrics() -> dict[str, Column]:
    """The metrics that rules name, over the raw counts of the struct column `counts`."""
    c = lambda name: F.col(f"counts.{name}")
    per_word = lambda name: F.when(c("n_words") > 0, c(name) / c("n_words"))
    per_line = lambda name: F.when(c("n_lines") > 0, c(name) / c("n_lines"))
    return {
        "n_words": c("n_words"),
        "mean_word_chars": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "mark_ratio": per_word("n_marks"),
        "stop_ratio": per_word("n_stop_words"),
        "distinct_ratio_gap": F.when(c("n_words") > 0, 1 - c("n_distinct_words") / c("n_words")) - F.when(c("n_words") > 1000, 0.25).otherwise(0.0),
        "dup_line_ratio": per_line("n_dup_lines"),
        "bullet_line_ratio": per_line("n_bullet_lines"),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the broken rules, in table order, as one array expression."""
    values, broken = metrics(), []
    for rule in rules:
        value = values[rule.metric]
        outside = F.lit(False)
        if rule.low is not None:
            outside = outside | (value < rule.low)
        if rule.high is not None:
            outside = outside | (value > rule.high)
        broken.append(F.when(outside, F.lit(rule.name)))
    return F.array_compact(F.array(*broken))


def apply_rules(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with the struct `counts`, the array `broken` of rule names, `base_failed` and `kept`.

    One projection without shuffle or user function. Columns of these names in the input are replaced. Null and empty
    texts have no words: they fail the base test and are not kept. Repeated rows and ties are judged one by one; very
    long texts cost time in proportion to n log n of their words. An empty table gives an empty table.
    """
    counted = documents.withColumn("counts", _base(F.col(f"`{text}`")))
    few, again = F.col("counts.n_words") < 20, F.col("counts.n_repeat_words") * 100 > F.col("counts.n_words") * 30
    judged = counted.withColumns({"broken": compile_rules(rules), "base_failed": few | again})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base test and verdict of every document."""
    judged = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *(F.col(f"counts.{n}").alias(n) for n in names), "base_failed", "kept", F.array_join("broken", ",").alias("broken_rules"))


def _oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM base
), grams AS (
  SELECT rid, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT rid, sum(least(8, i - last)) AS n FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 8) AS last FROM again) GROUP BY rid
), counts AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({stops}))) AS n_stop,
         len(list_distinct(w)) AS n_distinct,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
         len(ls) AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]\s'))) AS n_bullets
  FROM split s LEFT JOIN covered c USING (rid)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    list_filter([
      CASE WHEN n_words < 20 THEN 'few_words' END,
      CASE WHEN n_words > 0 AND (word_chars / n_words < 2.0 OR word_chars / n_words > 14.0) THEN 'word_length' END,
      CASE WHEN n_words > 0 AND n_symbols / n_words > 0.10 THEN 'symbols' END,
      CASE WHEN n_words > 0 AND n_marks / n_words > 0.35 THEN 'marks' END,
      CASE WHEN n_words > 0 AND n_stop / n_words < 0.03 THEN 'stop_words' END,
      CASE WHEN n_words > 0 AND 1 - n_distinct / n_words - (CASE WHEN n_words > 1000 THEN 0.25 ELSE 0.0 END) > 0.60 THEN 'same_words' END,
      CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.50 THEN 'same_lines' END,
      CASE WHEN n_lines > 0 AND n_bullets / n_lines > 0.90 THEN 'listed_lines' END
    ], lambda x: x IS NOT NULL) AS broken
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND len(broken) = 0 AS kept, array_to_string(broken, ',') AS broken_rules
FROM judged
"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
SQL = {"op1_quality_rules": _oracle()}
