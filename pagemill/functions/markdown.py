"""Markdown passes as column expressions.

Passes that must leave code alone split the text at its fence lines: what stands at even places is prose, what stands at
odd places is code. That keeps a document in one row, without exploding it into lines and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import headings_equivalent, let, normalize_heading, normalize_input, normalize_line, normalize_unicode_spaces, once, trim_all

FENCE = r"(?m)^[ \t]*```.*$"

# The texts of user-interface lines, labels and footers, and the words that leave a heading unfinished.
UI_STRONG = [
    r"donate\s*\|\s*create account\s*\|\s*log in", r"privacy policy\s*\|\s*about wikipedia",
    r"^wikipedia page\s*reddit thread$",
]
UI_SHORT = [
    r"accept all .*cookies?", r"manage (cookie|privacy) preferences", r"allow all cookies", r"popup ad|popup adaccept", r"tracking cookies? to continue",
    r"limit my search to", r"advanced search: by author", r"see the search faq", r"join reddit", r"view more:", r"welcome to reddit.*front page of the internet",
    r"^raw input$", r"^ai mode response is ready$", r"^(ask about|show all|accessibility feedback|accessibility help|skip to main content)\.?$",
    r"contents\s*\\?\[hide\\?\]", r"^\(?top\)?$", r"from wikipedia,?\s*the free encyclopedia", r"save \d{1,3}% today.*subscribe to our newsletter",
    r"subscribe to our newsletter\s*\|\s*related links\s*\|\s*footer text",
]
SOCIAL = "share|save|copy link|print|reddit|whatsapp|twitter|facebook|instagram|linkedin|telegram|x"
UI_EXACT = [
    r"^\d{1,6}$", r"^\d{1,3}\s+sites?$", r"^links from:?$", r"^past (hour|24 hours|week|month|year|all time)$",
    r"^\[(past hour|past 24 hours|past week|past month|past year|all time)\]\([^)]+\)$", rf"^(sharesave|{SOCIAL})$",
    rf"^\[({SOCIAL})\]\([^)]*(share|sharer|sharearticle|intent|submit|api\.whatsapp\.com/send|telegram\.me/share|t\.me/share)[^)]*\)$",
    r"^!\[(whatsapp|twitter|facebook|instagram|linkedin|telegram|x|share|print|reddit)\]\(", r"^(advertisement|sponsored content|sponsored)$",
]
UI_TRIMMED = [
    r"^-->$", r"^[*•]$", r"<path d=|stroke-width=|stroke-linecap=|stroke-linejoin=|transform=\"translate\(|</svg>", r"^\[skip to content\]\(#.+\)$",
    r"^\[(sponsor|star)\]\(", r"^\]\(/[^)]+\)\[?$", r"^built by\s*\[?$", r"^make us preferred source on google$",
]
UI_CHIP = r"^[A-Za-z][A-Za-z0-9 .&:/'()-]{1,70}\s+\+\d{1,3}$"
FOOTER = r"privacy policy|cookie policy|legal documents|cookies settings|all rights reserved|terms|contact us|careers|press and media|community|company|products|solutions|industries|events|slack"
BREADCRUMBS = r"^(home|news|latest|india news|world news|technology|business|sports|markets|opinion)$"


@once
def outside_code(markdown: Column, prose: Callable[[Column], Column]) -> Column:
    """The text with prose(...) applied to every stretch that is not inside a code fence."""
    parts = F.split(markdown, FENCE, -1)
    fences = F.regexp_extract_all(markdown, F.lit(f"({FENCE})"), F.lit(1))
    joined = F.transform(
        F.arrays_zip(parts.alias("part"), fences.alias("fence")),
        lambda x, i: F.concat(F.when(i % 2 == 0, prose(x["part"])).otherwise(x["part"]), F.coalesce(x["fence"], F.lit(""))),
    )
    return F.array_join(joined, "")


def keep_lines(text: Column, keep: Callable[[Column], Column]) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def cleanup_spaces(md: Column) -> Column:
    """No spaces before line ends, one kind of line end, tabs as two spaces."""
    md = F.regexp_replace(F.regexp_replace(md, r"\r\n?", "\n"), r"(?m)[ \t]+$", "")
    return F.replace(md, F.lit("\t"), F.lit("  "))


def unescape_leading(md: Column) -> Column:
    return outside_code(md, lambda p: F.regexp_replace(p, r"(?m)^\\#(\s+)", "#$1"))


def fix_lists(md: Column) -> Column:
    """Bullets as dashes and one space after a marker."""

    def prose(p: Column) -> Column:
        p = F.regexp_replace(p, r"(?m)^([ \t]*)[*+][ \t]+(\S.*)$", "$1- $2")
        return F.regexp_replace(F.regexp_replace(p, r"(?m)^([ \t]*-)[ \t]+", "$1 "), r"(?m)^([ \t]*)(\d+)\.[ \t]+", "$1$2. ")

    return outside_code(md, prose)


def code_blocks(md: Column) -> Column:
    """Blank lines around fences, no spaces inside inline code, indented lines outside of fences as code."""
    md = F.regexp_replace(md, r"(?s)```(\w*)\n+(.*?)\n+```", "\n\n```$1\n$2\n```\n\n")
    inline = lambda p: F.regexp_replace(p, r"`[ \t]*([^`\n]*[^`\s])[ \t]*`", r"`$1`")
    return outside_code(outside_code(md, inline), lambda p: F.regexp_replace(p, r"(?m)^ {4}(.+)$", "\n```\n$1\n```\n"))


def links(md: Column) -> Column:
    """Links without spaces inside; a link without an address is its text, and one without a scheme gets https."""
    md = F.regexp_replace(md, r"\[\s*([^\]]*?)\s*\]\(\s*\)", "$1")
    md = F.regexp_replace(md, r"\[\s*([^\]]*?)\s*\]\(\s*([^)]*?)\s*\)", "[$1]($2)")
    return F.regexp_replace(md, r"\[([^\]]*)\]\(//([^)]*)\)", "[$1](https://$2)")


def images(md: Column) -> Column:
    """Images on lines of their own; without a text they get the stem of their file."""
    md = F.regexp_replace(md, r"(!\[[^\]]*\]\([^)]*\))", "\n\n$1\n\n")
    md = F.regexp_replace(md, r"\n{3,}", "\n\n")
    return F.regexp_replace(md, r"!\[\]\(((?:[^)]*/)?([^)/.]+)[^)/]*)\)", "![$2]($1)")


def limit_blank(md: Column, most: int = 2) -> Column:
    return F.regexp_replace(md, rf"\n{{{most + 1},}}", "\n" * most)


def slug(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(heading), r"[^\w\s-]", ""), r"\s+", "-")


@once
def contents_table(md: Column) -> Column:
    """The text with a table of contents after its first heading, if it has two headings and text below the first."""
    found = F.regexp_extract_all(md, F.lit(r"(?m)^(#{1,6}\s*\S.*)$"), F.lit(1))

    def entry(h: Column) -> Column:
        level = F.length(F.regexp_extract(h, r"^(#{1,6})", 1))
        text = F.regexp_replace(h, r"^#{1,6}\s*", "")
        return F.concat(F.repeat(F.lit("  "), F.greatest(level - 2, F.lit(0))), F.lit("- ["), text, F.lit("](#"), slug(text), F.lit(")\n"))

    table = F.concat(F.lit("\n## Table of Contents\n\n"), F.array_join(F.transform(found, entry), ""), F.lit("\n"))
    first = F.regexp_extract(md, r"(?s)^(.*?(?:^|\n)#{1,6}[ \t]*\S[^\n]*\n)", 1)
    return F.when((F.size(found) >= 2) & (first != ""), F.concat(first, table, F.substr(md, F.length(first) + 1))).otherwise(md)


def final_cleanup(md: Column, hard_breaks: bool = False) -> Column:
    md = F.regexp_replace(md, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{ad}\x{61c}\x{200b}-\x{200f}\x{2028}\x{2029}\x{feff}\x{fff9}-\x{fffc}]", "")
    md = F.concat(F.regexp_replace(md, r"\n+\z", ""), F.lit("\n"))
    return F.replace(md, F.lit("\n"), F.lit("  \n")) if hard_breaks else md


@once
def unwrap_fence(md: Column) -> Column:
    """The inside of a fence that holds the whole document as Markdown."""
    body = F.regexp_extract(F.regexp_replace(md, r"\r\n?", "\n"), r"(?is)^\s*```[ \t]*(?:markdown|md)[ \t]*\n(.*)\n[ \t]*```\s*$", 1)
    return F.when(body != "", body).otherwise(md)


def strip_highlight(md: Column) -> Column:
    return F.regexp_replace(md, r"==([^=\n]+)==", "$1")


def strip_citation(md: Column) -> Column:
    """The text without a citation block at its start."""
    return F.regexp_replace(md, r"(?i)\A\s*>\s*source:[^\n]*(?:\n[ \t]*>[ \t]*(?:(?:captured|hash|published|updated|by):[^\n]*)?(?=\n|\z))*(?:\n[ \t]*(?=\n|\z))*\n?", "")


def sanitize(md: Column) -> Column:
    """Text that could run as code, made harmless."""
    for pattern, by in (
        (r"(?is)<script\b.*?</script>", " "),
        (r"(?i)\bon[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", ""),
        (r"(?i)(?:java\s*script|vb\s*script)\s*:", "blocked:"),
        (r"(?i)data\s*:\s*text/html", "data:text/blocked"),
        (r"(?i)\balert\s*\(", "blocked_call("),
        (r"(?i)\balert\b", "blocked_alert"),
        (r"(?i)document\s*\.\s*location", "document.location_blocked"),
        (r"(?i)%3c/?script%3e", " "),
    ):
        md = F.regexp_replace(md, pattern, by)
    return normalize_unicode_spaces(md)


#: Words of which the patterns that can match anywhere in a line need one; looking for words is far cheaper.
UI_WORDS = ("cookie", "preferences", "popup", "search", "reddit", "view more:", "hide", "wikipedia", "newsletter", "donate")
VECTOR_WORDS = ("<path d=", "stroke-width=", "stroke-linecap=", "stroke-linejoin=", 'transform="translate(', "</svg>")


def at_start(patterns: list[str]) -> str:
    """The patterns that are tied to the start of a line as one, which is then tried at the start alone."""
    return "(?i)^(?:" + "|".join(p[1:] for p in patterns if p.startswith("^")) + ")"


def anywhere(patterns: list[str]) -> str:
    return "|".join(p for p in patterns if not p.startswith("^"))


def _has_any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in words))


@once
def is_ui_noise(line: Column) -> Column:
    """Whether a line of prose is interface chrome; headings and blank lines never are."""
    chip = UI_CHIP

    def of(x: Column) -> Column:
        plain, trimmed = x["plain"], x["trimmed"]
        is_short = F.length(plain) <= 200
        worded = _has_any(plain, UI_WORDS) & ((is_short & plain.rlike(anywhere(UI_SHORT))) | plain.rlike(anywhere(UI_STRONG)))
        fixed = (is_short & plain.rlike(at_start(UI_SHORT))) | plain.rlike(at_start(UI_STRONG)) | F.contains(plain, F.lit("data:image/"))
        bulletless = F.regexp_replace(F.regexp_replace(trimmed, r"^[-*+]\s+", ""), r"^\d+\.\s+", "")
        listed = trimmed.rlike(r"^(?:[-*+]|\d+\.)\s") & let(F.trim(bulletless), lambda b: b.rlike(at_start(UI_EXACT)) | b.rlike(chip))
        own = trimmed.rlike(at_start(UI_EXACT)) | trimmed.rlike(at_start(UI_TRIMMED)) | trimmed.rlike(chip) | _has_any(F.lower(trimmed), VECTOR_WORDS)
        return (plain != "") & ~trimmed.rlike(r"^#{1,6}\s") & (worded | fixed | own | listed)

    return let(F.struct(F.lower(normalize_line(line)).alias("plain"), F.trim(line).alias("trimmed")), of)


def strip_ui_noise(md: Column) -> Column:
    return outside_code(md, lambda p: keep_lines(p, lambda line: ~is_ui_noise(line)))


@once
def is_low_signal(line: Column) -> Column:
    """Whether a line holds nothing but a bare link, a decorative image, a share label or an attribution dash."""
    t = F.trim(line)
    alt, url = (F.trim(F.regexp_extract(t, r"^!\[([^\]]*)]\(([^)]+)\)$", g)) for g in (1, 2))
    image = t.rlike(r"^!\[([^\]]*)]\(([^)]+)\)$")
    poor = (alt == "") | alt.rlike(r"^[A-Za-z0-9_+=/-]{10,}$") | F.lower(alt).isin("image", "photo", "picture", "logo", "icon", "avatar", *SOCIAL.split("|"))
    decorative = F.lower(url).rlike(r"^data:image|framerusercontent\.com|avatars\.githubusercontent\.com|gravatar\.com")
    bare = t.rlike(r"^\[\s*]\([^)]+\)\s*$|^\[\s*$|^\]\([^)]+\)(?:\s*\[\s*)?$|^[-•*]\s*$") | t.rlike(r"(?i)^(whatsapp|twitter|facebook|instagram|linkedin|telegram|x|share|save|copy link)$")
    quote = t.rlike(r"^>\s*&(?:mdash|#8212);|^>\s*[—-]\s*@?[A-Za-z0-9_]+")
    return (t != "") & (bare | quote | (image & (poor | decorative)))


def strip_media(md: Column) -> Column:
    return keep_lines(md, lambda line: ~is_low_signal(line))


@once
def is_footer_line(line: Column) -> Column:
    return let(F.lower(normalize_line(line)), lambda plain: _has_any(plain, tuple(FOOTER.split("|"))) | plain.rlike(r"^©\s*\d{4}"))


@once
def strip_footer(md: Column, last: int = 140, least: int = 40, signals: int = 5) -> Column:
    """The text up to the first of at least five footer lines among its last lines, if it is long enough."""
    lines = F.split(md, "\n")
    start = F.greatest(F.size(lines) - last, F.lit(0))
    found = F.filter(F.transform(lines, lambda line, i: F.when((i >= start) & is_footer_line(line), i)), lambda i: i.isNotNull())
    cut = F.regexp_replace(F.array_join(F.slice(lines, 1, F.array_min(found)), "\n"), r"\s+\z", "")
    plain = F.lower(normalize_input(md))
    landing = plain.rlike("latest blog posts?") & plain.rlike(r"(^|\s)contact(\s|$)") & plain.rlike(r"(^|\s)projects?(\s|$)")
    return F.when((F.size(lines) >= least) & ~landing & (F.size(found) >= signals), cut).otherwise(md)


@once
def strip_navigation(md: Column) -> Column:
    """The text without links, breadcrumbs, datelines and copies of the heading before its first heading."""
    head = F.regexp_extract(md, r"(?s)\A(.*?)(?:^|\n)[ \t]*#{1,3}[ \t]+", 1)
    rest = F.regexp_replace(F.substr(md, F.length(head) + 1), r"\A\n", "")
    title = normalize_heading(F.regexp_replace(F.trim(F.regexp_extract(rest, r"\A([^\n]*)", 1)), r"^#{1,6}\s+", ""))

    def keep(line: Column) -> Column:
        t = F.trim(line)
        plain = F.lower(normalize_line(t))
        dateline = t.rlike(r"(?:^|\s)\|\s*[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4},\s+\d{1,2}:\d{2}") & t.rlike("(?i)times|news|post|daily|tribune|herald|journal|express|chronicle|gazette")
        copy = (title != "") & F.contains(normalize_heading(t), title) & (F.length(t) <= 180)
        return (t == "") | ~(t.rlike(r"^[-*]\s*\[[^\]]{1,80}\]\((?:https?://|/)[^)]+\)$") | plain.rlike(BREADCRUMBS) | dateline | copy)

    kept = F.trim(F.regexp_replace(F.regexp_replace(keep_lines(head, keep), r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", ""))
    changed = F.size(F.filter(F.split(head, "\n"), lambda line: ~keep(line))) > 0
    return F.when((head != "") & changed, F.when(kept == "", rest).otherwise(F.concat(kept, F.lit("\n\n"), rest))).otherwise(md)


def collapse_words(md: Column, least: int = 5) -> Column:
    """Runs of at least five lines of one word each as one line."""
    # Possessive, so that Java matches long runs in a loop and not by recursion.
    word = r"[ \t]*+[A-Za-z][A-Za-z0-9&+/-]{1,23}+[ \t]*+(?![^\n])"

    def prose(p: Column) -> Column:
        run = rf"(?<![^\n])({word}(?:\n{word}){{{least - 1},}}+)"
        parts, runs = F.split(p, run, -1), F.regexp_extract_all(p, F.lit(run), F.lit(1))
        joined = F.transform(F.arrays_zip(parts.alias("part"), runs.alias("run")), lambda x: F.concat(x["part"], F.coalesce(F.trim(F.regexp_replace(x["run"], r"\s+", " ")), F.lit(""))))
        return F.array_join(joined, "")

    return outside_code(md, prose)


def token_boundaries(md: Column) -> Column:
    """A space where a word and an address have run together; quotes stay as they are."""

    def line(x: Column) -> Column:
        fixed = F.regexp_replace(x, r"([A-Za-z])((?:https?://|www\.)\S+)", "$1 $2")
        return F.when(F.trim(x).startswith(">"), x).otherwise(F.regexp_replace(fixed, r"([A-Za-z])(\d+\\\.\s+)", "$1 $2"))

    return outside_code(md, lambda p: F.array_join(F.transform(F.split(p, "\n"), line), "\n"))


@once
def primary_heading(md: Column, title: Column) -> Column:
    """The text with the title as its first heading unless a heading already stands for it."""
    name = normalize_input(title)
    top = F.regexp_extract(md, r"(?m)^#\s+(\S.*)$", 1)
    same = (top != "") & headings_equivalent(normalize_heading(name), normalize_heading(top))
    empty = F.concat(F.lit("# "), name)
    return F.when((name == "") | same, md).when(trim_all(md) == "", empty).otherwise(F.concat(empty, F.lit("\n\n"), md))


def spacing(md: Column) -> Column:
    md = F.regexp_replace(F.regexp_replace(md, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return trim_all(F.regexp_replace(md, r"(?m)^[ \t]+$", ""))


def inline_code_spacing(md: Column) -> Column:
    """One space between inline code and the words around it, none inside."""

    def prose(p: Column) -> Column:
        p = F.regexp_replace(p, r"`([A-Za-z0-9_./:-][^`\n]*?)`(?=[A-Za-z0-9])", "`$1` ")
        p = F.regexp_replace(p, r"`([^`\n]+)`,`", "`$1`, `")
        return F.regexp_replace(p, r",`(?=[^`\n]+`)", ", `")

    return outside_code(md, prose)


def merge_headings(md: Column) -> Column:
    """A heading and the short plain line right below it as one heading."""
    return outside_code(md, lambda p: F.regexp_replace(p, r"(?m)^([ \t]*#{1,6}[ \t]+\S.*?)[ \t]*\n[ \t]*(?!\d+\.\s)([\p{L}\p{N}][\p{L}\p{N} '\"-]{0,59})[ \t]*$", "$1 $2"))


@once
def cite_first(md: Column, title: Column, url: Column, captured: Column, digest: Column, published: Column | None = None, updated: Column | None = None, byline: Column | None = None) -> Column:
    """The text below a citation of its source; parts that are missing are left out."""
    some = lambda x: F.when(F.trim(x) == "", None).otherwise(x) if x is not None else F.lit(None).cast("string")
    name = F.coalesce(some(F.trim(title)), F.lit("Untitled Page"))
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("> Source: ["), name, F.lit("]("), F.coalesce(some(F.trim(url)), F.lit("Unknown URL")), F.lit(")")),
        F.concat(F.lit("> Captured: "), captured),
        F.concat(F.lit("> Published: "), some(published)),
        F.concat(F.lit("> Updated: "), some(updated)),
        F.concat(F.lit("> By: "), some(byline)),
        F.concat(F.lit("> Hash: "), F.coalesce(some(F.trim(digest)), F.lit("N/A"))),
    )
    body = trim_all(md)
    titled = F.when(body.rlike(r"(?m)^#\s+"), body).otherwise(F.concat(F.lit("# "), name, F.lit("\n\n"), body))
    return F.concat(head, F.lit("\n\n"), titled)


def code_chars(md: Column) -> Column:
    """Characters inside code fences, the fence lines not counted."""
    found = F.regexp_extract_all(md, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda a, x: a + F.length(F.trim(F.regexp_replace(x, r"\s+", " "))))


def lone_words(md: Column) -> Column:
    """Lines that hold a single word."""
    return F.size(F.filter(F.split(md, "\n"), lambda line: F.trim(line).rlike(r"^[A-Za-z][A-Za-z0-9&+/-]{1,23}$")))


def heading_jumps(md: Column) -> Column:
    """Headings more than one level below the heading before them."""

    def of(levels: Column) -> Column:
        return F.size(F.filter(F.transform(levels, lambda v, i: (i > 0) & (v > F.coalesce(F.get(levels, i - 1), v) + 1)), lambda jump: jump))

    return let(F.transform(F.regexp_extract_all(md, F.lit(r"(?m)^(#{1,6})\s"), F.lit(1)), lambda h: F.length(h)), of)


def light_canonical(md: Column, title: Column, noise: Callable[[Column], Column] = strip_ui_noise) -> Column:
    """The short chain of passes that delivered Markdown goes through; noise is the pass that takes interface lines."""
    md = strip_citation(strip_highlight(unwrap_fence(normalize_unicode_spaces(md))))
    md = inline_code_spacing(spacing(noise(sanitize(md))))
    return primary_heading(spacing(md), title)
