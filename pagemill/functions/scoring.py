"""Scores of candidate extractions and of finished Markdown as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import js_round, let, normalize_for_quality, once

# Base weights of the selection score by mode, in the order of WEIGHTS.
WEIGHTS = ("heading", "text", "section", "lead", "feed", "noise", "form", "vector", "density", "boilerplate")
MODES = {
    "balanced": (34, 24, 14, 16, 10, 14, 22, 18, 1, 1),
    "max_retention": (34, 30, 18, 16, 10, 11, 18, 14, 0.85, 0.85),
    "max_cleanliness": (30, 18, 10, 14, 8, 18, 28, 24, 1.2, 1.3),
}
# How far one unit of the slider moves a weight, and the floor of that weight.
SLIDES = {"text": (3, 8), "section": (2, 4), "noise": (-2, 4), "form": (-2, 6), "vector": (-2, 6), "density": (-0.15, 0.4), "boilerplate": (-0.2, 0.4)}
BOILERPLATE = (
    (r"accept all .*cookies?|cookie settings|manage preferences|tracking cookies?|cookie policy", 10),
    (r"all rights reserved|privacy policy|terms of service|legal documents", 8),
    (r"limit my search|advanced search: by author|see the search faq|view more:|join reddit|ad-free experience", 12),
)
VECTOR = r"(?i)<path d=|stroke-width=|transform=\"translate\(|</svg>"
ESCAPED_TAG = r"(?i)(&lt;/?(?:div|footer|header|nav|section|article|main|p|h[1-6])\b)"


def tuning(mode: Column, slider: Column) -> tuple[Column, Column]:
    """Mode and slider, both replaced by the defaults unless the mode is known and the slider lies from 0 to 100."""
    good = mode.isin(*MODES) & slider.between(0, 100)
    return F.when(good, mode).otherwise("balanced"), F.when(good, js_round(slider)).otherwise(55)


def checked_tuning(mode: Column, slider: Column) -> Column:
    """The mode, or an error for a mode or slider that is not allowed."""
    return F.when(mode.isin(*MODES) & slider.between(0, 100), mode).otherwise(F.raise_error(F.concat(F.lit("not a tuning: "), F.coalesce(mode, F.lit("null")))))


def weights(mode: Column, slider: Column) -> Column:
    """A struct of the selection weights."""
    mode, slider = tuning(mode, slider)
    delta = (slider - 55) / 45

    def one(i: int, name: str) -> Column:
        base = reduce(lambda w, m: w.when(mode == m, F.lit(float(MODES[m][i]))), list(MODES)[1:], F.when(mode == "balanced", F.lit(float(MODES["balanced"][i]))))
        if name not in SLIDES:
            return base.alias(name)
        per, floor = SLIDES[name]
        return F.greatest(F.lit(float(floor)), base + delta * per).alias(name)

    return F.struct(*(one(i, name) for i, name in enumerate(WEIGHTS)))


def min_length(source_length: Column, mode: Column, slider: Column) -> Column:
    """The least text length of a candidate, between 60 and 320."""
    mode, slider = tuning(mode, slider)
    base = F.least(F.lit(220), F.greatest(F.lit(80), F.floor(F.greatest(F.lit(1), source_length) * 0.08)))
    factor = F.when(mode == "max_retention", 0.85).when(mode == "max_cleanliness", 1.15).otherwise(1.0)
    return F.greatest(F.lit(60), F.least(F.lit(320), js_round(base * factor * (1 - (slider - 55) / 45 * 0.08)))).cast("long")


def candidate_score(a: Column, source_length: Column, density: Column, penalty: Column, feed: Column, form: Column, w: Column) -> Column:
    """The selection score from 0 to 100 of a candidate's features `a` under the weights `w`."""
    share = F.least(F.lit(1.0), a["text_length"] / F.greatest(F.lit(1), source_length))
    limit = F.when(feed, 0.78).otherwise(0.45)
    raw = (
        a["heading_coverage"] * w["heading"]
        + share * w["text"]
        + F.least(F.lit(1.0), a["section_count"] / 6) * w["section"]
        + F.when(a["lead"], w["lead"]).otherwise(0.0)
        + F.when(feed, w["feed"]).otherwise(0.0)
        - F.when(a["noise"], w["noise"]).otherwise(0.0)
        - F.when(form, w["form"]).otherwise(0.0)
        - F.when(a["vector"], w["vector"]).otherwise(0.0)
        - F.when(density > limit, F.least(F.lit(18.0), (density - limit) * 60) * w["density"]).otherwise(0.0)
        - penalty * w["boilerplate"]
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def adopt_fallback(r: Column, f: Column, r_score: Column, f_score: Column) -> Column:
    """Whether the fallback `f` replaces the readable extraction `r`; the first rule that applies decides."""
    long_enough = lambda share: f["text_length"] >= r["text_length"] * share
    return (
        F.when(f["text_length"] < F.least(F.lit(200.0), r["text_length"] * 0.55), False)
        .when((r["text_length"] < 220) & (f["text_length"] >= 1200), True)
        .when(f["noise"] & ~r["noise"], f_score >= r_score + 14)
        .when(f_score >= r_score + 10, True)
        .when(r["noise"] & ~f["noise"] & long_enough(0.6), True)
        .when(~r["lead"] & f["lead"] & long_enough(0.6), True)
        .when((f["heading_coverage"] >= r["heading_coverage"] + 0.2) & long_enough(0.7), True)
        .when((f["section_count"] > r["section_count"]) & long_enough(0.7), True)
        .otherwise(f_score >= r_score + 6)
    )


def feed_like(repeated: Column, anchors: Column, forms: Column, density: Column) -> Column:
    return ((repeated >= 4) & (anchors >= 10) & (forms <= F.greatest(F.lit(12), repeated * 8))) | ((repeated >= 6) & (density >= 0.45))


def boilerplate_penalty(text: Column, html: Column) -> Column:
    """Points off for legal and consent chrome, vector code and escaped tags; 20 for no text."""
    plain = F.lower(text)
    points = reduce(lambda p, rule: p + F.when(plain.rlike(rule[0]), rule[1]).otherwise(0), BOILERPLATE, F.lit(0))
    escaped = F.size(F.regexp_extract_all(html, F.lit(ESCAPED_TAG), F.lit(1)))
    points = points + F.when(html.rlike(VECTOR), 24).otherwise(0) + F.when(escaped >= 6, F.least(F.lit(12), F.floor(escaped / 3))).otherwise(0)
    return F.when(plain == "", 20).otherwise(points).cast("long")


def default_retention(a: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), a["heading_coverage"])) * 0.45 + F.least(F.lit(1.0), a["section_count"] / 6) * 0.35 + F.when(a["lead"], 0.2).otherwise(0.0)


def default_penalty(a: Column) -> Column:
    return F.when(a["noise"], 8).otherwise(0) + F.when(a["forms"] >= 3, 6).otherwise(0) + F.when(a["vector"], 6).otherwise(0)


def gate_score(chars: Column, paragraphs: Column, density: Column, signal: Column, structure: Column, cue: Column) -> Column:
    """The quality gate's score from 0 to 100."""
    raw = (
        F.when(chars < 300, 0).when(chars < 1000, 12).when(chars < 5000, 20).otherwise(25)
        + F.when(paragraphs >= 5, 18).when(paragraphs >= 3, 14).when(paragraphs >= 1, 8).otherwise(0)
        + F.when(density < 0.1, 15).when(density < 0.2, 12).when(density < 0.4, 8).when(density < 0.6, 4).otherwise(0)
        + F.when(signal > 0.5, 10).when(signal > 0.3, 7).when(signal > 0.1, 3).otherwise(0)
        + F.least(F.lit(15.0), structure / 10)
        + F.least(F.lit(17.0), cue / 6)
    )
    return F.when(chars <= 0, 0).otherwise(js_round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)))).cast("long")


def gate_passes(stage: Column, chars: Column, paragraphs: Column, density: Column, structure: Column, score: Column) -> Column:
    semantic = (score >= 55) & (chars >= 300) & (paragraphs >= 2) & (density <= 0.45) & (structure >= 10)
    readable = (score >= 40) & (chars >= 120) & (density <= 0.4)
    return F.when(stage == "semantic", semantic).when(stage == "readability", readable).when(stage == "thread", score >= 40).otherwise(F.lit(True))


def stage_score(stage: Column, gate: Column, cue: Column, structure: Column, passed: Column, density: Column, length: Column) -> Column:
    bias = F.when(stage == "readability", 6).when(stage == "heuristic", 4).when(stage == "thread", 3).when(stage == "semantic", 2).otherwise(0)
    raw = gate + F.least(F.lit(18.0), cue / 5) + F.least(F.lit(10.0), structure / 10) + F.when(passed, 12).otherwise(0) + bias - F.least(F.lit(20.0), density * 24) - F.when(length < 220, 10).otherwise(0)
    return F.greatest(F.lit(0.0), F.least(F.lit(160.0), raw))


def stage_priority(stage: Column) -> Column:
    return F.when(stage == "readability", 4).when(stage == "heuristic", 3).when(stage == "thread", 2).when(stage == "semantic", 1).otherwise(0)


def source_bonus(source: Column, confidence: Column) -> Column:
    """Points for where a candidate comes from."""
    by = F.when(source.startswith("adapter:"), 35 + confidence * 8).when(source.startswith("generic:"), confidence * 15)
    return by.when(source == "landing", 45.0).when(source == "feed", 18.0).when(source == "semantic", 5.0).when(source == "body", -10.0).otherwise(0.0)


def profile_bonus(profile: Column, a: Column, source: Column) -> Column:
    """Points for how a candidate and where it comes from suit the type of its page."""
    name = F.lower(source)
    whole = name.isin("readability", "body", "primary-root")
    forum = F.when(name.isin("adapter:thread", "thread:whole"), 45).when(name == "thread:post", 0).when(name == "thread:comments", 10).when(name.contains("comment"), -20)
    forum = forum.when(name.startswith("thread:") | name.contains("forum-main"), 25).when(whole, -30).otherwise(0)
    return (
        F.when(profile == "article", F.when(a["paragraphs"] >= 4, 8).otherwise(0) + F.when(a["density"] < 0.25, 6).otherwise(0) - F.when(a["density"] > 0.55, 12).otherwise(0) - F.when(name.contains("sidebar") | name.contains("comment"), 15).otherwise(0))
        .when(profile == "documentation", F.when(a["code"] >= 120, 10).otherwise(0) - F.when(a["density"] > 0.75, 8).otherwise(0))
        .when(profile == "code-heavy", F.when(a["code"] >= 200, 15).otherwise(0) + F.when(a["code"] >= 800, 10).otherwise(0))
        .when(profile == "forum", forum)
        .when(profile == "landing-page", F.when(name == "landing", 35).when(whole, -12).otherwise(0))
        .when(profile == "product", F.when(a["tables"] > 0, 8).otherwise(0) + F.when(a["lists"] >= 4, 6).otherwise(0))
        .otherwise(0)
    )


# Quality of finished Markdown against its page.


def _matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))


def preservation(md: Column, html: Column) -> Column:
    """How fitting the loss of text is, tags counted: 100 where a tenth to four fifths went."""

    def of(n: Column) -> Column:
        lost = 1 - n["kept"] / n["source"]
        score = F.when(lost > 0.95, 10).when(lost > 0.9, 30).when(lost > 0.8, 60).when(lost < 0.1, 70).otherwise(100)
        return F.when(n["source"] == 0, F.when(n["kept"] > 0, 100).otherwise(0)).otherwise(F.when(n["kept"] < 200, F.least(score, F.lit(20))).otherwise(score))

    return let(F.struct(F.length(normalize_for_quality(md)).alias("kept"), F.length(normalize_for_quality(html)).alias("source")), of)


def structure(md: Column, html: Column) -> Column:
    patterns = {"h": (html, "(?i)<h[1-6][^>]*>"), "l": (html, "(?i)<[uo]l[^>]*>"), "c": (html, "(?i)<pre[^>]*>"), "mh": (md, r"(?m)^#{1,6}\s"), "ml": (md, r"(?m)^\s*[-*+]\s"), "mc": (md, r"(?s)```.*?```")}

    def of(n: Column) -> Column:
        off = F.when((n["h"] > 0) & (n["mh"] < n["h"] * 0.3), 30).when((n["h"] > 0) & (n["mh"] < n["h"] * 0.6), 15).otherwise(0)
        off = off + F.when((n["l"] > 0) & (n["ml"] < n["l"] * 0.5), 20).otherwise(0) + F.when((n["c"] > 0) & (n["mc"] < n["c"] * 0.7), 25).otherwise(0)
        return F.greatest(F.lit(0), 100 - off)

    return let(F.struct(*(_matches(text, p).alias(k) for k, (text, p) in patterns.items())), of)


def markdown_quality(md: Column) -> Column:
    from pagemill.functions.markdown import heading_jumps

    off = F.least(F.lit(40), _matches(md, "<[^>]+>") * 2) + F.when(md.rlike(r"\n{4,}"), 10).otherwise(0) + F.when(md.rlike(r"\[[^\]]*\]\(\s*\)"), 15).otherwise(0) + heading_jumps(md) * 5
    return F.greatest(F.lit(0), 100 - off)


def readability(md: Column) -> Column:
    filled = lambda pattern: F.size(F.filter(F.split(md, pattern), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != ""))

    def of(n: Column) -> Column:
        off = F.when(n["words"] > n["sentences"] * 30, 15).otherwise(0) + F.when((n["paragraphs"] < 2) & (n["words"] > 100), 20).otherwise(0) + F.when(n["words"] < 50, 30).otherwise(0)
        return F.when((n["sentences"] == 0) | (n["words"] == 0), 0).otherwise(F.greatest(F.lit(0), 100 - off))

    return let(F.struct(filled(r"[.!?]+").alias("sentences"), filled(r"\s+").alias("words"), filled(r"\n\s*\n").alias("paragraphs")), of)


@once
def completeness(md: Column) -> Column:
    """Struct of the completeness score and status of the body below citation and title."""
    from pagemill.functions.markdown import code_chars

    bare = F.regexp_replace(md, r"(?i)\A(?:>[ \t]*(?:Source|Captured|Published|Updated|By|Hash):[^\n]*\n?)+\n*", "")
    title = F.regexp_extract(bare, r"\A# ([^\n]*)", 1)
    body = F.trim(F.regexp_replace(bare, r"\A# [^\n]*\n?", ""))

    def of(s: Column) -> Column:
        chars, text = F.length(normalize_for_quality(s["body"])), F.lower(normalize_for_quality(s["body"]))
        code = code_chars(s["body"]) >= 120
        prose = F.regexp_replace(s["body"], r"(?s)```.*?```", " ")
        blocks = F.filter(F.transform(F.split(prose, r"\n{2,}"), lambda b: normalize_for_quality(F.regexp_replace(b, r"(?m)^#{1,6}\s+", ""))), lambda b: (F.length(b) >= 40) | (F.size(F.split(b, " ")) >= 8))
        parts = _matches(s["body"], r"(?m)^#{2,6}\s+") + _matches(s["body"], r"(?m)^\s*[-*+]\s+\S") + _matches(s["body"], r"(?s)```.*?```")
        link_count = _matches(s["body"], r"\[[^\]]+\]\([^)]+\)")
        navigation = (text != "") & (F.size(blocks) == 0) & (F.length(text) < 500) & (link_count >= 3)
        titled = (s["title"] != "") & ~F.lower(s["title"]).isin("untitled page", "untitled", "unknown")
        status = (
            F.when((chars == 0) & titled, "incomplete_title_only")
            .when(chars == 0, "incomplete_empty_body")
            .when(~code & navigation, "incomplete_navigation_only")
            .when(~code & (chars < 100), "partial_very_short")
            .when(~code & (chars < 300) & (F.size(blocks) < 2) & (parts < 2), "partial")
            .otherwise("complete")
        )
        score = F.when(status == "complete", 100).when(status == "partial", 45).when(status == "partial_very_short", 40).when(status == "incomplete_empty_body", 15).otherwise(20)
        return F.struct(score.alias("score"), F.when(status == "partial_very_short", "partial").otherwise(status).alias("status"))

    return once(of)(F.struct(title.alias("title"), body.alias("body")))


def overall(preserved: Column, structured: Column, formatted: Column, readable: Column, complete: Column) -> Column:
    return js_round(preserved * 0.25 + structured * 0.20 + formatted * 0.20 + readable * 0.15 + complete * 0.20).cast("long")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def recommendations(preserved: Column, structured: Column, formatted: Column, readable: Column, complete: Column) -> Column:
    # What is advised for a metric below its bound.
    advice = (
        (preserved, 60, "Consider adjusting Readability configuration for better content extraction"),
        (structured, 70, "Enable structure-preserving options in Turndown configuration"),
        (formatted, 80, "Enable post-processing to clean up markdown formatting"),
        (readable, 70, "Consider content preprocessing to improve structure"),
        (complete, 80, "Review processing pipeline for potential failures"),
    )
    return F.array_distinct(F.array_compact(F.array(*(F.when(value < bound, F.lit(text)) for value, bound, text in advice))))


def ai_gate(baseline: Column, candidate: Column) -> Column:
    """Struct of the retention measures of a rewritten Markdown against its baseline, and whether it is accepted."""
    from pagemill.functions.text import normalize_heading

    heads = lambda md: F.filter(F.transform(F.regexp_extract_all(md, F.lit(r"(?m)^#{1,6}[ \t]+(\S.*)$"), F.lit(1)), normalize_heading), lambda h: h != "")
    tokens = lambda md: F.array_distinct(F.regexp_extract_all(md, F.lit(r"([A-Za-z_][A-Za-z0-9]*(?:[_./-][A-Za-z0-9]+)+|`[^`\n]+`)"), F.lit(1)))

    def of(s: Column) -> Column:
        kept = F.filter(s["a"], lambda h: F.array_contains(s["b"], h))
        # Order: how many headings of the baseline are met, one after another, on one walk through the candidate.
        step = lambda at, h: F.when(F.array_position(F.slice(s["b"], at["i"] + 1, F.greatest(F.size(s["b"]) - at["i"], F.lit(0))), h) > 0, F.struct((at["i"] + F.array_position(F.slice(s["b"], at["i"] + 1, F.greatest(F.size(s["b"]) - at["i"], F.lit(0))), h).cast("int")).alias("i"), (at["n"] + 1).alias("n"))).otherwise(at)
        ordered = F.aggregate(s["a"], F.struct(F.lit(0).alias("i"), F.lit(0).alias("n")), step, lambda at: at["n"])
        share = lambda n, of_: F.when(F.size(of_) == 0, 1.0).otherwise(n / F.size(of_))
        words = F.size(F.filter(s["t"], lambda t: F.contains(s["candidate"], t)))
        length = F.when(F.length(s["baseline"]) == 0, 1.0).otherwise(F.length(s["candidate"]) / F.length(s["baseline"]))
        odd = _matches(s["candidate"], r"(?m)^[ \t]*```") % 2 == 1
        return F.struct(share(F.size(kept), s["a"]).alias("headings"), share(ordered, s["a"]).alias("heading_order"), share(words, s["t"]).alias("tokens"), length.alias("length"), odd.alias("odd_fences"))

    measured = once(of)(F.struct(heads(baseline).alias("a"), heads(candidate).alias("b"), tokens(baseline).alias("t"), baseline.alias("baseline"), candidate.alias("candidate")))
    return measured


def ai_accepted(m: Column) -> Column:
    return ~m["odd_fences"] & (m["headings"] >= 0.85) & (m["heading_order"] >= 0.85) & (m["length"] >= 0.7) & (m["tokens"] >= 0.9)
