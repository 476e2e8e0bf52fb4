"""Line dedup by winnowing over line hashes, with built-in expressions only.

Lines that are not blank make a sequence of hashes for each document. Winnowing keeps of every window of WINDOW lines the
place of its least hash, its fingerprint, so two equal windows always have equal fingerprints; lines of LONG words or more
are fingerprints always. Places are joined on shared fingerprints; those that occur once in the corpus leave the work.
From every other place the match is extended to the left and to the right, up to the reach of its fingerprint, and meets
the earliest place that extends alike. Matches that follow each other on one diagonal of two documents make one run, and
what stood earlier in the order of documents stays while later runs are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import cut, let, table, unused

#: Lines of a window, which is also the shortest run that is deleted, and words of a line that is deleted on its own.
WINDOW, LONG = 2, 30
NOT_BLANK = r"[^\x20\x09-\x0D]"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def _sequence(text: Column, long: int) -> Column:
    """The lines that are not blank: place among all lines and among these, two hashes, and whether a line is long."""
    each = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("pos"), _trimmed(line).alias("line")))
    return F.transform(
        F.filter(each, lambda x: x["line"] != ""),
        lambda x, k: F.struct(
            k.alias("k"),
            x["pos"].alias("pos"),
            F.xxhash64(x["line"]).alias("h"),
            F.xxhash64(F.lit(7), x["line"]).alias("g"),
            (F.size(F.split(x["line"], SPACE_CLASS + "+")) >= long).alias("long"),
        ),
    )


def _fingerprints(lines: Column, window: int) -> Column:
    """The places that winnowing selects, and those of long lines: place and hashes of the line, and `reach`, the windows of
    which it is the fingerprint, each with its first line and two hashes of what the match extends over.

    The fingerprint of a window is its least line hash, the last one of several.
    """

    def extended(start: Column) -> Column:
        part = F.slice(lines, start + 1, window)
        return F.struct(
            start.alias("start"),
            F.array_min(F.transform(part, lambda y: F.struct(y["h"].alias("h"), y["g"].alias("g"), (-y["k"]).alias("at"))))["at"].alias("at"),
            F.xxhash64(F.transform(part, lambda y: y["h"])).alias("c"),
            F.xxhash64(F.lit(window), F.transform(part, lambda y: y["g"])).alias("d"),
            F.transform(part, lambda y: y["pos"]).alias("places"),
        )

    def place(x: Column) -> Column:
        lo, hi = F.greatest(F.lit(0), x["k"] - (window - 1)), F.least(x["k"], F.size(lines) - window)
        starts = F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))
        reach = F.transform(F.filter(F.transform(starts, extended), lambda w: w["at"] == -x["k"]), lambda w: F.struct(*(w[n].alias(n) for n in ("start", "c", "d", "places"))))
        alone = F.when(x["long"], F.array(F.struct(x["k"].alias("start"), x["h"].alias("c"), x["g"].alias("d"), F.array(x["pos"]).alias("places"))))
        return F.struct(x["k"].alias("k"), x["h"].alias("h"), x["g"].alias("g"), F.concat(reach, F.coalesce(alone, F.slice(reach, 1, 0))).alias("reach"))

    return F.filter(F.transform(lines, place), lambda p: F.size(p["reach"]) > 0)


def _stitched(matches: Column) -> Column:
    """Sorted matches (from_id, from_hash, n, diagonal, start, places) as runs: matches on one diagonal that touch are one."""

    def same(x: Column, y: Column) -> Column:
        return (x["from_id"] == y["from_id"]) & (x["from_hash"] == y["from_hash"]) & (x["n"] == y["n"]) & (x["diagonal"] == y["diagonal"]) & (y["start"] <= x["start"] + x["n"])

    def of(m: Column) -> Column:
        begins = F.filter(m, lambda x, i: (i == 0) | ~same(F.get(m, i - 1), x))
        ends = F.filter(m, lambda x, i: (i == F.size(m) - 1) | ~same(x, F.get(m, i + 1)))
        return F.zip_with(
            begins, ends, lambda x, y: F.struct(x["start"].alias("start"), (y["start"] + y["n"]).alias("stop"), x["from_id"].alias("from_id"), (x["start"] - x["diagonal"]).alias("from_start"))
        )

    return let(matches, of)


def _keys(doc_id: str, text: str, names: tuple[str, str] = ("_id", "_hash")) -> list[Column]:
    """The order of documents: by doc_id, those without one last, then by the leading bits of the text's MD5."""
    return [F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1)).alias(names[0]), F.conv(F.substring(F.md5(F.col(f"`{text}`").cast("binary")), 1, 15), 16, 10).cast("long").alias(names[1])]


def mark_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, long: int = LONG) -> DataFrame:
    """One row per document with deleted lines: its keys _id and _hash, `dropped`, the places of those lines from 0, and
    `runs`, what was found repeated: start and stop among the lines that are not blank, and where the run stood first.

    A line goes if it lies in a run of `window` lines or more, or is a line of `long` words or more, that equals a run
    earlier in the order of doc_id, text and place. Blank lines separate nothing and are never dropped.
    """
    lines = documents.filter(F.col(f"`{text}`").isNotNull()).select(*_keys(doc_id, text), _sequence(F.col(f"`{text}`"), long).alias("lines"))
    places = cut(lines.select("_id", "_hash", F.explode(let(F.col("lines"), lambda x: _fingerprints(x, window))).alias("p")).select("_id", "_hash", "p.*"))
    at = F.struct("_id", "_hash", "k")
    # What is joined to places is written first: a join of two plain exchanges can be split where one line is very common.
    shared = cut(places.groupBy("h", "g").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).filter("lo != hi").select("h", "g"))
    joined = places.join(shared, ["h", "g"], "left_semi")
    matched = joined.select("_id", "_hash", F.explode("reach").alias("m")).select("_id", "_hash", "m.*")
    here = F.struct("_id", "_hash", "start")
    first = cut(matched.groupBy("c", "d").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("c", "d", "first"))
    later = matched.join(first, ["c", "d"]).filter(here > F.col("first"))
    match = F.struct(F.col("first._id").alias("from_id"), F.col("first._hash").alias("from_hash"), F.size("places").alias("n"), (F.col("start") - F.col("first.start")).alias("diagonal"), "start", "places")
    per = later.groupBy("_id", "_hash").agg(F.sort_array(F.collect_list(match)).alias("m"))
    dropped = F.array_sort(F.array_distinct(F.flatten(F.transform("m", lambda x: x["places"]))))
    return per.select("_id", "_hash", dropped.alias("dropped"), _stitched(F.col("m")).alias("runs"))


def _without(text: Column, dropped: Column) -> Column:
    """The text without the lines at the places given, in time in proportion to its lines."""

    def of(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
        ends = F.concat(dropped, F.array(F.size(lines)))
        kept = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.slice(lines, s["a"] + 1, s["b"] - s["a"])))
        return F.array_join(kept, "\n")

    return let(F.split(text, "\n"), of)


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, long: int = LONG) -> DataFrame:
    """The documents with later repeated runs of lines deleted from the text, and n_dropped, the number of lines deleted.

    Lines are compared without white space at their ends. The first occurrence in the order of doc_id, text and place
    stays, wherever it stands. Null texts stay null and drop nothing; so do empty texts. Rows equal in doc_id and text are
    one document in that order, held more than once: they lose the same lines. Rows without a doc_id come last. All
    columns stay, whatever their names; n_dropped is replaced. Documents that lose all their lines keep an empty text. An
    empty table gives an empty table.
    """
    names = unused(documents, "id"), unused(documents, "hash")
    gone = unused(documents, "gone")
    dropped = mark_repeats(documents, doc_id, text, window, long).select(F.col("_id").alias(names[0]), F.col("_hash").alias(names[1]), F.col("dropped").alias(gone))
    keyed = documents.withColumns(dict(zip(names, _keys(doc_id, text, names), strict=True)))
    joined = keyed.join(dropped, list(names), "left")
    cleaned = F.when(F.col(gone).isNotNull() & F.col(f"`{text}`").isNotNull(), _without(F.col(f"`{text}`"), F.col(gone))).otherwise(F.col(f"`{text}`"))
    lost = F.when(F.col(f"`{text}`").isNotNull(), F.coalesce(F.size(gone), F.lit(0))).otherwise(0).cast("long")
    return joined.withColumns({text: cleaned, "n_dropped": lost}).drop(*names, gone)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without later repeated runs of lines."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS h, string_split(text, chr(10)) AS ls FROM documents),
ln AS (
  SELECT rid, doc_id, h, pos, line, row_number() OVER (PARTITION BY rid ORDER BY pos) AS k
  FROM (SELECT rid, doc_id, h, i - 1 AS pos, regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
        FROM (SELECT rid, doc_id, h, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)) WHERE line <> ''
), runs AS (
  SELECT rid, doc_id, h, k, 2 AS n, line || chr(10) || lead(line) OVER w AS g, pos, lead(pos) OVER w AS pos2 FROM ln WINDOW w AS (PARTITION BY rid ORDER BY k)
  UNION ALL
  SELECT rid, doc_id, h, k, 1, line, pos, pos FROM ln WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {LONG}
), later AS (
  SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY n, g ORDER BY doc_id NULLS LAST, h, k) AS rn FROM runs WHERE g IS NOT NULL) WHERE rn > 1
), gone AS (SELECT DISTINCT rid, pos FROM (SELECT rid, pos FROM later UNION ALL SELECT rid, pos2 FROM later)),
kept AS (
  SELECT d.rid, string_agg(d.ls[i], chr(10) ORDER BY i) AS t, count(*) AS n
  FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM d) d ANTI JOIN gone ON gone.rid = d.rid AND gone.pos = d.i - 1 GROUP BY d.rid
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.t, '') END AS text, coalesce(len(d.ls) - coalesce(kept.n, 0), 0)::BIGINT AS n_dropped
FROM d LEFT JOIN kept USING (rid)
"""

QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL = {"op5_line_dedup": ORACLE}
