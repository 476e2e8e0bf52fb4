"""Prompts made of captures, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How many characters of each part a prompt takes.
HTML_CHARS, TOTAL_CHARS, BASELINE_CHARS, METADATA_CHARS, CUSTOM_CHARS = 120_000, 140_000, 120_000, 20_000, 1_000


def prune(html: Column) -> Column:
    """Markup without styles, scripts other than linked data, and what stands in for scripts."""
    for pattern in (r"(?is)<style\b[^>]*>.*?</style>", r"(?is)<script\b(?![^>]*type\s*=\s*[\"']application/ld\+json[\"'])[^>]*>.*?</script>", r"(?is)<noscript\b[^>]*>.*?</noscript>"):
        html = F.regexp_replace(html, pattern, "")
    return F.trim(F.regexp_replace(html, r"\n{3,}", "\n\n"))


def clipped(text: Column, most: Column | int, name: str, empty: str = "n/a") -> Column:
    """The text up to a number of characters, with a mark of how many were left out."""
    most = F.lit(most) if isinstance(most, int) else most
    text = F.trim(F.coalesce(text, F.lit("")))
    mark = F.concat(F.lit(f"\n\n<!-- {name}:"), (F.length(text) - most).cast("string"), F.lit(" -->"))
    return F.when(text == "", empty).when(F.length(text) <= most, text).otherwise(F.concat(F.substr(text, F.lit(1), most), mark))


def custom(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return clipped(plain, CUSTOM_CHARS, "CUSTOM_TRUNCATED")


def build(template: str, title: Column, url: Column, baseline: Column, html: Column, preference: Column) -> Column:
    """The template with its marks {{TITLE}}, {{URL}}, {{BASELINE}}, {{HTML}} and {{CUSTOM}} filled in."""
    some = lambda x, default: F.when(F.trim(F.coalesce(x, F.lit(""))) == "", default).otherwise(F.trim(x))
    used = F.least(F.length(F.trim(F.coalesce(baseline, F.lit("")))), F.lit(BASELINE_CHARS))
    room = F.when(used > 0, F.least(F.lit(HTML_CHARS), F.greatest(F.lit(0), TOTAL_CHARS - used))).otherwise(HTML_CHARS)
    parts = {"TITLE": some(title, "Untitled"), "URL": some(url, "about:blank"), "CUSTOM": custom(preference), "BASELINE": clipped(baseline, BASELINE_CHARS, "BASELINE_TRUNCATED"), "HTML": clipped(prune(html), room, "HTML_TRUNCATED")}
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out
