"""Queries of scoring, ranking and quality, over features made from the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import scoring as S
from pagemill.functions import text as T
from pagemill.operators import ranking as R
from pagemill.plans.markdown_queries import SQL_MD, markdown
from pagemill.plans.registry import query, table
from pagemill.plans.text_queries import sql_collapse, sql_heading, sql_quality

c = F.col
MODES = ["balanced", "max_retention", "max_cleanliness", "odd"]
SOURCES = ["adapter:thread", "generic:main", "landing", "feed", "semantic", "body", "readability", "thread:post", "thread:comments", "generic:comment-list", "thread:summary"]
STAGES = ["thread", "semantic", "readability", "heuristic"]
PROFILES = ["article", "documentation", "code-heavy", "product", "generic", "forum", "landing-page"]


def _pick(parts: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, parts)), (key % len(parts) + 1).cast("int"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per document; five documents make a page."""
    d = c("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.floor(d / 5).alias("page"),
        F.struct(
            (c("n_chars") % 1500).alias("text_length"), (d % 11 / 10).alias("heading_coverage"), (d % 9).alias("section_count"), (d % 7 == 0).alias("noise"), (d % 3 == 0).alias("lead"),
            (d % 40).alias("anchors"), (d % 10).alias("repeated"), (d % 5).alias("forms"), (d % 13 == 0).alias("vector"), (d % 100 / 100).alias("density"),
            (d % 6).alias("paragraphs"), (d * 7 % 1000).alias("code"), (d % 3).alias("tables"), (d % 8).alias("lists"),
        ).alias("a"),
        c("n_chars").alias("source_length"),
        _pick(MODES, d).alias("mode"),
        (d % 120).alias("slider"),
        _pick(SOURCES, d).alias("source"),
        _pick(STAGES, d).alias("stage"),
        _pick(PROFILES, d).alias("profile"),
        (d % 21).alias("penalty"),
        (d % 100 / 100).alias("confidence"),
    )


def _sql_pick(parts: list[str]) -> str:
    return "[" + ", ".join(f"'{p}'" for p in parts) + f"][doc_id % {len(parts)} + 1]"


SQL_F = f"""f AS (SELECT doc_id, doc_id // 5 AS page, n_chars % 1500 AS text_length, doc_id % 11 / 10 AS heading_coverage, doc_id % 9 AS section_count, doc_id % 7 = 0 AS noise, doc_id % 3 = 0 AS lead,
  doc_id % 40 AS anchors, doc_id % 10 AS repeated, doc_id % 5 AS forms, doc_id % 13 = 0 AS vector, doc_id % 100 / 100 AS density, doc_id % 6 AS paragraphs, doc_id * 7 % 1000 AS code, doc_id % 3 AS tables, doc_id % 8 AS lists,
  n_chars AS source_length, {_sql_pick(MODES)} AS mode0, doc_id % 120 AS slider0, {_sql_pick(SOURCES)} AS source, {_sql_pick(STAGES)} AS stage, {_sql_pick(PROFILES)} AS profile, doc_id % 21 AS penalty, doc_id % 100 / 100 AS confidence FROM documents),
t AS (SELECT *, CASE WHEN mode0 <> 'odd' AND slider0 <= 100 THEN mode0 ELSE 'balanced' END AS mode, CASE WHEN mode0 <> 'odd' AND slider0 <= 100 THEN slider0 ELSE 55 END AS slider FROM f)"""


def _sql_weights() -> str:
    out = []
    for i, name in enumerate(S.WEIGHTS):
        base = "CASE mode " + " ".join(f"WHEN '{m}' THEN {S.MODES[m][i]}" for m in S.MODES) + " END"
        if name in S.SLIDES:
            per, floor = S.SLIDES[name]
            base = f"greatest({floor}, {base} + (slider - 55) / 45 * {per})"
        out.append(f"round(({base})::DOUBLE, 9) AS w_{name}")
    return ", ".join(out)


SQL_W = f"{SQL_F}, w AS (SELECT *, {_sql_weights()}, ((repeated >= 4 AND anchors >= 10 AND forms <= greatest(12, repeated * 8)) OR (repeated >= 6 AND density >= 0.45)) AS feed, forms >= 3 AS form FROM t)"
SQL_SCORE = """greatest(0, least(100, heading_coverage * w_heading + least(1, text_length / greatest(1, source_length)) * w_text + least(1, section_count / 6) * w_section + CASE WHEN lead THEN w_lead ELSE 0 END
  + CASE WHEN feed THEN w_feed ELSE 0 END - CASE WHEN noise THEN w_noise ELSE 0 END - CASE WHEN form THEN w_form ELSE 0 END - CASE WHEN vector THEN w_vector ELSE 0 END
  - CASE WHEN density > CASE WHEN feed THEN 0.78 ELSE 0.45 END THEN least(18, (density - CASE WHEN feed THEN 0.78 ELSE 0.45 END) * 60) * w_density ELSE 0 END - penalty * w_boilerplate))"""


@query("selection_weights", f"WITH {SQL_W} SELECT doc_id, mode, slider::BIGINT AS slider, {', '.join(f'w_{n}' for n in S.WEIGHTS)} FROM w")
def selection_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    mode, slider = S.tuning(c("mode"), c("slider"))
    return f.select("doc_id", mode.alias("mode"), slider.cast("long").alias("slider"), S.weights(c("mode"), c("slider")).alias("w")).select("doc_id", "mode", "slider", *(F.round(c(f"w.{n}"), 9).alias(f"w_{n}") for n in S.WEIGHTS))


@query("tuning_normalise", f"WITH {SQL_F} SELECT doc_id, mode, slider::BIGINT AS slider, greatest(60, least(320, floor(least(220, greatest(80, floor(greatest(1, source_length) * 0.08))) * CASE mode WHEN 'max_retention' THEN 0.85 WHEN 'max_cleanliness' THEN 1.15 ELSE 1.0 END * (1 - (slider - 55) / 45 * 0.08) + 0.5)))::BIGINT AS least_length FROM t")
def tuning_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode, slider = S.tuning(c("mode"), c("slider"))
    return features(spark, sf_dir).select("doc_id", mode.alias("mode"), slider.cast("long").alias("slider"), S.min_length(c("source_length"), c("mode"), c("slider")).alias("least_length"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = c("a")
    f = features(spark, sf_dir).withColumn("w", S.weights(c("mode"), c("slider")))
    f = f.withColumn("feed", S.feed_like(a["repeated"], a["anchors"], a["forms"], a["density"]))
    w = F.struct(*(F.round(c(f"w.{n}"), 9).alias(n) for n in S.WEIGHTS))
    return f.withColumn("score", F.round(S.candidate_score(a, c("source_length"), a["density"], c("penalty"), c("feed"), a["forms"] >= 3, w), 6))


@query("candidate_score", f"WITH {SQL_W} SELECT doc_id, feed, round({SQL_SCORE}, 6) AS score FROM w")
def candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "feed", "score")


@query("feed_like", f"WITH {SQL_W} SELECT doc_id, feed FROM w")
def feed_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "feed")


@query(
    "adopt_fallback",
    f"""WITH {SQL_W}, s AS (SELECT *, round({SQL_SCORE}, 6) AS score FROM w)
    SELECT r.doc_id, CASE WHEN f.text_length < least(200, r.text_length * 0.55) THEN false WHEN r.text_length < 220 AND f.text_length >= 1200 THEN true WHEN f.noise AND NOT r.noise THEN f.score >= r.score + 14
      WHEN f.score >= r.score + 10 THEN true WHEN r.noise AND NOT f.noise AND f.text_length >= r.text_length * 0.6 THEN true WHEN NOT r.lead AND f.lead AND f.text_length >= r.text_length * 0.6 THEN true
      WHEN f.heading_coverage >= r.heading_coverage + 0.2 AND f.text_length >= r.text_length * 0.7 THEN true WHEN f.section_count > r.section_count AND f.text_length >= r.text_length * 0.7 THEN true ELSE f.score >= r.score + 6 END AS adopted
    FROM s r JOIN s f ON f.doc_id = r.doc_id + 1""",
)
def adopt_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).select("doc_id", "a", "score")
    fallback = s.select((c("doc_id") - 1).alias("doc_id"), c("a").alias("b"), c("score").alias("b_score"))
    return s.join(fallback, "doc_id").select("doc_id", S.adopt_fallback(c("a"), c("b"), c("score"), c("b_score")).alias("adopted"))


@query("default_retention", f"WITH {SQL_F} SELECT doc_id, round(least(1, heading_coverage) * 0.45 + least(1, section_count / 6) * 0.35 + CASE WHEN lead THEN 0.2 ELSE 0 END, 6) AS retention, ((CASE WHEN noise THEN 8 ELSE 0 END) + (CASE WHEN forms >= 3 THEN 6 ELSE 0 END) + (CASE WHEN vector THEN 6 ELSE 0 END))::BIGINT AS penalty FROM t")
def default_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("doc_id", F.round(S.default_retention(c("a")), 6).alias("retention"), S.default_penalty(c("a")).cast("long").alias("penalty"))


@query(
    "boilerplate_penalty",
    rf"""WITH p AS (SELECT page_id, lower({sql_collapse("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) || CASE page_id % 4 WHEN 0 THEN ' cookie settings' WHEN 1 THEN ' all rights reserved view more:' ELSE '' END AS t,
      html || CASE page_id % 5 WHEN 0 THEN '<path d="m 1">' WHEN 1 THEN repeat('&lt;div&gt;', 9) ELSE '' END AS h FROM pages)
    SELECT page_id, (CASE WHEN regexp_matches(t, '{S.BOILERPLATE[0][0]}') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(t, '{S.BOILERPLATE[1][0]}') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(t, '{S.BOILERPLATE[2][0]}') THEN 12 ELSE 0 END
      + CASE WHEN regexp_matches(h, '(?i)<path d=|stroke-width=|transform="translate\(|</svg>') THEN 24 ELSE 0 END
      + CASE WHEN len(regexp_extract_all(h, '(?i)(&lt;/?(?:div|footer|header|nav|section|article|main|p|h[1-6])\b)', 1)) >= 6 THEN least(12, len(regexp_extract_all(h, '(?i)(&lt;/?(?:div|footer|header|nav|section|article|main|p|h[1-6])\b)', 1)) // 3) ELSE 0 END)::BIGINT AS penalty FROM p""",
)
def boilerplate_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = c("page_id")
    text = F.concat(T.strip_tags(c("html")), F.when(p % 4 == 0, " cookie settings").when(p % 4 == 1, " all rights reserved view more:").otherwise(""))
    html = F.concat("html", F.when(p % 5 == 0, '<path d="m 1">').when(p % 5 == 1, F.repeat(F.lit("&lt;div&gt;"), F.lit(9))).otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", S.boilerplate_penalty(text, html).alias("penalty"))


SQL_SOURCE = """CASE WHEN source LIKE 'adapter:%' THEN 35 + confidence * 8 WHEN source LIKE 'generic:%' THEN confidence * 15 WHEN source = 'landing' THEN 45 WHEN source = 'feed' THEN 18 WHEN source = 'semantic' THEN 5 WHEN source = 'body' THEN -10 ELSE 0 END"""
SQL_PROFILE = """CASE profile WHEN 'article' THEN CASE WHEN paragraphs >= 4 THEN 8 ELSE 0 END + CASE WHEN density < 0.25 THEN 6 ELSE 0 END - CASE WHEN density > 0.55 THEN 12 ELSE 0 END - CASE WHEN source LIKE '%comment%' OR source LIKE '%sidebar%' THEN 15 ELSE 0 END
  WHEN 'documentation' THEN CASE WHEN code >= 120 THEN 10 ELSE 0 END - CASE WHEN density > 0.75 THEN 8 ELSE 0 END WHEN 'code-heavy' THEN CASE WHEN code >= 200 THEN 15 ELSE 0 END + CASE WHEN code >= 800 THEN 10 ELSE 0 END
  WHEN 'product' THEN CASE WHEN tables > 0 THEN 8 ELSE 0 END + CASE WHEN lists >= 4 THEN 6 ELSE 0 END
  WHEN 'forum' THEN CASE WHEN source IN ('adapter:thread', 'thread:whole') THEN 45 WHEN source = 'thread:post' THEN 0 WHEN source = 'thread:comments' THEN 10 WHEN source LIKE '%comment%' THEN -20 WHEN source LIKE 'thread:%' OR source LIKE '%forum-main%' THEN 25
    WHEN source IN ('readability', 'body', 'primary-root') THEN -30 ELSE 0 END
  WHEN 'landing-page' THEN CASE WHEN source = 'landing' THEN 35 WHEN source IN ('readability', 'body', 'primary-root') THEN -12 ELSE 0 END ELSE 0 END"""


@query("source_adjust", f"WITH {SQL_F} SELECT doc_id, round(({SQL_SOURCE})::DOUBLE, 6) AS source_points, ({SQL_PROFILE})::BIGINT AS profile_points FROM t")
def source_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("doc_id", F.round(S.source_bonus(c("source"), c("confidence")), 6).alias("source_points"), S.profile_bonus(c("profile"), c("a"), c("source")).cast("long").alias("profile_points"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("text_length", c("a.text_length"))
    total = F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("score") + S.source_bonus(c("source"), c("confidence")) + S.profile_bonus(c("profile"), c("a"), c("source"))))
    return s.select("doc_id", "page", "source", "text_length", F.round(total, 6).alias("score"), F.round(S.default_retention(c("a")), 6).alias("retention"), S.default_penalty(c("a")).alias("penalty"), F.when(c("doc_id") % 4 != 0, c("doc_id") % 17 * 1.0).alias("processing_ms"), c("doc_id").alias("place"), S.min_length(c("source_length"), c("mode"), c("slider")).alias("least_length"))


SQL_POOL = f"""{SQL_W}, pool AS (SELECT doc_id, page, source, text_length, round(greatest(0, least(100, round({SQL_SCORE}, 6) + ({SQL_SOURCE}) + ({SQL_PROFILE})))::DOUBLE, 6) AS score,
  round(least(1, heading_coverage) * 0.45 + least(1, section_count / 6) * 0.35 + CASE WHEN lead THEN 0.2 ELSE 0 END, 6) AS retention, (CASE WHEN noise THEN 8 ELSE 0 END) + (CASE WHEN forms >= 3 THEN 6 ELSE 0 END) + (CASE WHEN vector THEN 6 ELSE 0 END) AS pen,
  CASE WHEN doc_id % 4 <> 0 THEN doc_id % 17 * 1.0 END AS ms, greatest(60, least(320, floor(least(220, greatest(80, floor(greatest(1, source_length) * 0.08))) * CASE mode WHEN 'max_retention' THEN 0.85 WHEN 'max_cleanliness' THEN 1.15 ELSE 1.0 END * (1 - (slider - 55) / 45 * 0.08) + 0.5))) AS least_length FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, retention DESC, pen, coalesce(ms, 9007199254740991), source, doc_id) AS rank FROM pool WHERE text_length > 0 AND text_length >= least_length)"""


@query("rank_candidates", f"WITH {SQL_POOL} SELECT page, doc_id, source, score, retention, pen::BIGINT AS penalty, rank::BIGINT AS rank FROM r")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_candidates(pool(spark, sf_dir), "page", c("least_length")).select("page", "doc_id", "source", "score", "retention", c("penalty").cast("long").alias("penalty"), c("rank").cast("long").alias("rank"))


@query("winning_candidate", f"WITH {SQL_POOL} SELECT page, doc_id, source, score FROM r WHERE rank = 1")
def winning_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.winners(R.rank_candidates(pool(spark, sf_dir), "page", c("least_length"))).select("page", "doc_id", "source", "score")


@query(
    "topk_traces",
    f"""WITH {SQL_POOL}, m AS (SELECT *, min(rank) FILTER (source LIKE 'adapter:%') OVER (PARTITION BY page) AS adapter FROM r),
    k AS (SELECT * FROM m WHERE rank < 3 OR (rank = adapter AND adapter > 3) OR (rank = 3 AND NOT coalesce(adapter > 3, false))) SELECT page, string_agg(source, ',' ORDER BY rank) AS traces FROM k GROUP BY page""",
)
def topk_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.traces(R.rank_candidates(pool(spark, sf_dir), "page", c("least_length")), "page", 3).select("page", F.array_join("traces", ",").alias("traces"))


GATE = """CASE WHEN text_length <= 0 THEN 0 ELSE floor(least(100, greatest(0, CASE WHEN text_length < 300 THEN 0 WHEN text_length < 1000 THEN 12 WHEN text_length < 5000 THEN 20 ELSE 25 END + CASE WHEN paragraphs >= 5 THEN 18 WHEN paragraphs >= 3 THEN 14 WHEN paragraphs >= 1 THEN 8 ELSE 0 END
  + CASE WHEN density < 0.1 THEN 15 WHEN density < 0.2 THEN 12 WHEN density < 0.4 THEN 8 WHEN density < 0.6 THEN 4 ELSE 0 END + CASE WHEN confidence > 0.5 THEN 10 WHEN confidence > 0.3 THEN 7 WHEN confidence > 0.1 THEN 3 ELSE 0 END + least(15, section_count) + least(17, penalty * 5 / 6))) + 0.5) END"""
PASSES = "CASE stage WHEN 'semantic' THEN gate >= 55 AND text_length >= 300 AND paragraphs >= 2 AND density <= 0.45 AND section_count >= 1 WHEN 'readability' THEN gate >= 40 AND text_length >= 120 AND density <= 0.4 WHEN 'thread' THEN gate >= 40 ELSE true END"
SQL_STAGE = f"""{SQL_F}, g AS (SELECT *, ({GATE})::BIGINT AS gate FROM t), p AS (SELECT *, {PASSES} AS passed FROM g),
  s AS (SELECT *, round(greatest(0, least(160, gate + least(18, penalty) + least(10, section_count) + CASE WHEN passed THEN 12 ELSE 0 END + CASE stage WHEN 'readability' THEN 6 WHEN 'heuristic' THEN 4 WHEN 'thread' THEN 3 WHEN 'semantic' THEN 2 ELSE 0 END - least(20, density * 24) - CASE WHEN text_length < 220 THEN 10 ELSE 0 END))::DOUBLE, 6) AS selection,
  CASE stage WHEN 'readability' THEN 4 WHEN 'heuristic' THEN 3 WHEN 'thread' THEN 2 ELSE 1 END AS priority FROM p)"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = c("a")
    f = features(spark, sf_dir).withColumn("gate", S.gate_score(a["text_length"], a["paragraphs"], a["density"], c("confidence"), a["section_count"] * 10, c("penalty") * 5))
    f = f.withColumn("passed", S.gate_passes(c("stage"), a["text_length"], a["paragraphs"], a["density"], a["section_count"] * 10, c("gate")))
    return f.withColumn("selection", F.round(S.stage_score(c("stage"), c("gate"), c("penalty") * 5, a["section_count"] * 10, c("passed"), a["density"], a["text_length"]), 6)).withColumn("priority", S.stage_priority(c("stage"))).withColumn("quality", c("gate"))


@query("quality_gate", f"WITH {SQL_STAGE} SELECT doc_id, stage, gate, passed FROM s")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages(spark, sf_dir).select("doc_id", "stage", "gate", "passed")


@query("gate_report", rf"WITH {SQL_STAGE} SELECT doc_id, 'Quality Gate Report' || chr(10) || 'Status: ' || CASE WHEN passed THEN '✓ PASSED' ELSE '✗ FAILED' END || chr(10) || 'Score: ' || gate || '/100' || chr(10) || chr(10) || 'Metrics:' || chr(10) || '  - Characters: ' || text_length || chr(10) || '  - Paragraphs: ' || paragraphs AS report FROM s")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda x: x.cast("string")
    lines = [F.lit("Quality Gate Report"), F.when(c("passed"), "Status: ✓ PASSED").otherwise("Status: ✗ FAILED"), F.concat(F.lit("Score: "), s(c("gate")), F.lit("/100")), F.lit(""), F.lit("Metrics:"), F.concat(F.lit("  - Characters: "), s(c("a.text_length"))), F.concat(F.lit("  - Paragraphs: "), s(c("a.paragraphs")))]
    return stages(spark, sf_dir).select("doc_id", F.concat_ws("\n", *lines).alias("report"))


@query("stage_candidate_score", f"WITH {SQL_STAGE} SELECT doc_id, selection FROM s")
def stage_candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages(spark, sf_dir).select("doc_id", "selection")


@query("stage_select", f"WITH {SQL_STAGE} SELECT page, doc_id, stage, selection FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY passed DESC, selection DESC, gate DESC, priority DESC, stage, doc_id) AS rn FROM s) WHERE rn = 1")
def stage_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_by(stages(spark, sf_dir).select("page", "doc_id", "stage", "passed", "selection", "quality", "priority"), ["page"], [~c("passed"), -c("selection"), -c("quality"), -c("priority"), "stage", "doc_id"]).select("page", "doc_id", "stage", "selection")


@query("sort_models", """SELECT name, id, free FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS rn, row_number() OVER () AS x FROM (SELECT c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ':free' ELSE '' END AS id, first(c_name ORDER BY c_custkey) AS name, min(c_custkey) AS place, c_custkey % 3 = 0 AS free FROM customer GROUP BY 1, 4)) WHERE rn = 1""")
def sort_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.when(c("c_custkey") % 3 == 0, ":free").otherwise("")).alias("id"), c("c_name").alias("name"), c("c_custkey").alias("place"), F.array((c("c_custkey") % 3).cast("double")).alias("prices"))
    free = c("id").endswith(":free") | ((F.size("prices") > 0) & F.forall("prices", lambda p: p <= 0))
    return R.first_by(rows, ["id"], ["place"]).withColumn("free", free).orderBy(c("free").desc(), F.lower("name"), F.lower("id")).select("name", "id", "free")


SQL_HTML = "(SELECT m.doc_id, m.title, m.md, '<html><h1>' || m.title || '</h1><ul><li>' || d.text || '</li></ul><h2>x</h2><h2>y</h2>' || CASE WHEN m.doc_id % 2 = 0 THEN '<pre>z</pre>' ELSE '' END || repeat('<i>pad</i>', (m.doc_id % 60 * 20)::INTEGER) || '</html>' AS html FROM m JOIN documents d USING (doc_id))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown with a page that it could come from."""
    html = F.concat(F.lit("<html><h1>"), c("title"), F.lit("</h1><ul><li>"), c("text"), F.lit("</li></ul><h2>x</h2><h2>y</h2>"), F.when(c("doc_id") % 2 == 0, "<pre>z</pre>").otherwise(""), F.repeat(F.lit("<i>pad</i>"), (c("doc_id") % 60 * 20).cast("int")), F.lit("</html>"))
    return markdown(spark, sf_dir, "text").select("doc_id", "title", "md", html.alias("html"))


def n_of(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '({pattern})', 1))"


SQL_PRESERVED = f"""CASE WHEN source = 0 THEN CASE WHEN kept > 0 THEN 100 ELSE 0 END ELSE least(CASE WHEN 1 - kept / source > 0.95 THEN 10 WHEN 1 - kept / source > 0.9 THEN 30 WHEN 1 - kept / source > 0.8 THEN 60 WHEN 1 - kept / source < 0.1 THEN 70 ELSE 100 END, CASE WHEN kept < 200 THEN 20 ELSE 100 END) END"""
SQL_REPORT = rf"""{SQL_MD}, q AS (SELECT doc_id, title, md, html, length({sql_quality("md")}) AS kept, length({sql_quality("html")}) AS source, {n_of("html", "(?i)<h[1-6][^>]*>")} AS hs, {n_of("html", "(?i)<[uo]l[^>]*>")} AS ls, {n_of("html", "(?i)<pre[^>]*>")} AS cs,
  {n_of("md", r"(?m)^#{1,6}\s")} AS kh, {n_of("md", r"(?m)^\s*[-*+]\s")} AS kl, {n_of("md", r"(?s)```.*?```")} AS kc, {n_of("md", "<[^>]+>")} AS tags, list_transform(regexp_extract_all(md, '(?m)^(#{{1,6}})\s', 1), lambda x: length(x)) AS lv,
  len(list_filter(regexp_split_to_array(md, '[.!?]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '')) AS ns, len(list_filter(regexp_split_to_array(md, '\s+'), lambda x: x <> '')) AS nw,
  len(list_filter(regexp_split_to_array(md, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '')) AS np FROM {SQL_HTML}),
r AS (SELECT doc_id, md, ({SQL_PRESERVED})::BIGINT AS preserved,
  greatest(0, 100 - (CASE WHEN hs > 0 AND kh < hs * 0.3 THEN 30 WHEN hs > 0 AND kh < hs * 0.6 THEN 15 ELSE 0 END) - (CASE WHEN ls > 0 AND kl < ls * 0.5 THEN 20 ELSE 0 END) - (CASE WHEN cs > 0 AND kc < cs * 0.7 THEN 25 ELSE 0 END))::BIGINT AS structured,
  greatest(0, 100 - least(40, tags * 2) - (CASE WHEN regexp_matches(md, '\n{{4,}}') THEN 10 ELSE 0 END) - (CASE WHEN regexp_matches(md, '\[[^\]]*\]\(\s*\)') THEN 15 ELSE 0 END) - 5 * len(list_filter(range(2, len(lv) + 1), lambda i: lv[i] > lv[i - 1] + 1)))::BIGINT AS formatted,
  (CASE WHEN ns = 0 OR nw = 0 THEN 0 ELSE greatest(0, 100 - (CASE WHEN nw > ns * 30 THEN 15 ELSE 0 END) - (CASE WHEN np < 2 AND nw > 100 THEN 20 ELSE 0 END) - (CASE WHEN nw < 50 THEN 30 ELSE 0 END)) END)::BIGINT AS readable FROM q)"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    md, html = c("md"), c("html")
    values = {"preserved": S.preservation(md, html), "structured": S.structure(md, html), "formatted": S.markdown_quality(md), "readable": S.readability(md)}
    return pairs(spark, sf_dir).select("doc_id", "md", *(v.cast("long").alias(k) for k, v in values.items()), S.completeness(md).alias("complete"))


@query("quality_metrics", f"WITH {SQL_REPORT} SELECT doc_id, preserved, structured, formatted, readable FROM r")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("doc_id", "preserved", "structured", "formatted", "readable")


SQL_GRADED = f"{SQL_REPORT}, o AS (SELECT *, floor(preserved * 0.25 + structured * 0.20 + formatted * 0.20 + readable * 0.15 + 90 * 0.20 + 0.5)::BIGINT AS overall FROM r)"


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measured(spark, sf_dir)
    return m.withColumn("overall", S.overall(c("preserved"), c("structured"), c("formatted"), c("readable"), F.lit(90)))


@query("quality_report", f"WITH {SQL_GRADED} SELECT doc_id, overall, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' WHEN overall >= 60 THEN 'D' ELSE 'F' END AS grade, overall >= 70 AND preserved >= 50 AND structured >= 40 AS passes FROM o")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).select("doc_id", "overall", S.grade(c("overall")).alias("grade"), ((c("overall") >= 70) & (c("preserved") >= 50) & (c("structured") >= 40)).alias("passes"))


@query("recommendations", f"""WITH {SQL_GRADED} SELECT doc_id, array_to_string(list_filter([CASE WHEN preserved < 60 THEN 'Consider adjusting Readability configuration for better content extraction' END, CASE WHEN structured < 70 THEN 'Enable structure-preserving options in Turndown configuration' END,
  CASE WHEN formatted < 80 THEN 'Enable post-processing to clean up markdown formatting' END, CASE WHEN readable < 70 THEN 'Consider content preprocessing to improve structure' END], lambda x: x IS NOT NULL), '|') AS advice FROM o""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).select("doc_id", F.array_join(S.recommendations(c("preserved"), c("structured"), c("formatted"), c("readable"), F.lit(90)), "|").alias("advice"))


@query("completeness")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("doc_id", "complete.score", "complete.status")


@query("completeness_counts")
def completeness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).groupBy("complete.status").agg(F.count(F.lit(1)).alias("n"))


SQL_AI = rf"""{SQL_MD}, h AS (SELECT a.doc_id, a.md AS baseline, b.md AS candidate FROM m a JOIN (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN md WHEN 1 THEN substr(md, 1, length(md) // 2) ELSE md || chr(10) || '```' END AS md FROM m) b USING (doc_id)),
g AS (SELECT *, list_filter(list_transform(regexp_extract_all(baseline, '(?m)^#{{1,6}}[ \t]+(\S.*)$', 1), lambda x: {sql_heading("x")}), lambda x: x <> '') AS ha, list_filter(list_transform(regexp_extract_all(candidate, '(?m)^#{{1,6}}[ \t]+(\S.*)$', 1), lambda x: {sql_heading("x")}), lambda x: x <> '') AS hb,
  list_distinct(regexp_extract_all(baseline, '([A-Za-z_][A-Za-z0-9]*(?:[_./-][A-Za-z0-9]+)+|`[^`\n]+`)', 1)) AS t FROM h)
SELECT doc_id, round(CASE WHEN len(ha) = 0 THEN 1 ELSE len(list_filter(ha, lambda x: list_contains(hb, x))) / len(ha) END, 6) AS headings, round(CASE WHEN len(t) = 0 THEN 1 ELSE len(list_filter(t, lambda x: contains(candidate, x))) / len(t) END, 6) AS tokens,
  round(CASE WHEN length(baseline) = 0 THEN 1 ELSE length(candidate) / length(baseline) END, 6) AS length, len(regexp_extract_all(candidate, '(?m)(^[ \t]*```)', 1)) % 2 = 1 AS odd_fences FROM g"""


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    md, d = c("md"), c("doc_id")
    other = F.when(d % 3 == 0, md).when(d % 3 == 1, F.substr(md, F.lit(1), F.floor(F.length(md) / 2).cast("int"))).otherwise(F.concat(md, F.lit("\n```")))
    return markdown(spark, sf_dir).select("doc_id", S.ai_gate(md, other).alias("m"))


@query("retention_ratios", f"WITH {SQL_AI}")
def retention_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(spark, sf_dir).select("doc_id", *(F.round(c(f"m.{n}"), 6).alias(n) for n in ("headings", "tokens", "length")), "m.odd_fences")


@query("ai_quality_gate")
def ai_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(spark, sf_dir).select("doc_id", F.round("m.heading_order", 6).alias("heading_order"), S.ai_accepted(c("m")).alias("accepted"))
