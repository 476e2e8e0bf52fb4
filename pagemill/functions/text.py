"""Scalar text functions as column expressions. All stay inside Catalyst."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of width zero, wide and unbreakable spaces, and the entities that are decoded, in order.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u180e"
WIDE_SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"))
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'

#: White space at either end, beyond ASCII too.
_ENDS = r"^[\s\x{FEFF}\p{Z}]+|[\s\x{FEFF}\p{Z}]+$"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(function):
    """A function of a column that may use its first argument many times at the price of one evaluation."""

    @wraps(function)
    def run(x: Column, *args, **more) -> Column:
        return let(x, lambda v: function(v, *args, **more))

    return run


def trim_all(x: Column) -> Column:
    """The text without any white space at its ends."""
    return F.regexp_replace(x, _ENDS, "")


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_unicode_spaces(x: Column) -> Column:
    return F.translate(F.translate(x, ZERO_WIDTH, ""), WIDE_SPACES, " " * len(WIDE_SPACES))


def strip_comments(x: Column, by: str = " ") -> Column:
    return F.regexp_replace(x, r"(?s)<!--.*?-->", by)


def normalize_input(x: Column) -> Column:
    """Text for comparison: no comments, no CDATA, one kind of space."""
    plain = F.regexp_replace(strip_comments(x), r"(?is)<!\[cdata\[.*?\]\]>", " ")
    return collapse(normalize_unicode_spaces(F.replace(plain, F.lit("-->"), F.lit(" "))))


#: What a text must hold for normalize_input to change it.
_TO_NORMALIZE = rf"<!|-->|[{ZERO_WIDTH}{WIDE_SPACES}]|\s\s|[\t\n\x0b\f\r]|^ | $"


@once
def normalize_line(x: Column) -> Column:
    """The same as normalize_input, at the price of one search for the many lines that need nothing."""
    return F.when(x.rlike(_TO_NORMALIZE), normalize_input(x)).otherwise(x)


def normalize_for_quality(x: Column) -> Column:
    """As normalize_input, with control characters as spaces and without care for widths."""
    plain = F.regexp_replace(strip_comments(x), r"(?is)<!\[cdata\[.*?\]\]>", " ")
    return collapse(F.regexp_replace(F.replace(plain, F.lit("-->"), F.lit(" ")), r"[\x00-\x1F\x7F-\x{9F}]", " "))


def normalize_heading(x: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(normalize_input(x)), r"[^\p{L}\p{N}\s]+", " "))


def heading_tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: F.length(t) > 2)


def headings_equivalent(a: Column, b: Column) -> Column:
    """Whether two normalised headings stand for each other: equal, one inside the other if that is long enough, or
    sharing three of their longer words, fewer if either has fewer."""
    ta, tb = heading_tokens(a), F.array_distinct(heading_tokens(b))
    shared = F.size(F.filter(ta, lambda t: F.array_contains(tb, t)))
    by_words = (F.size(ta) > 0) & (F.size(tb) > 0) & (shared >= F.least(F.lit(3), F.size(ta), F.size(tb)))
    inside = ((F.length(a) >= 20) & F.contains(b, a)) | ((F.length(b) >= 20) & F.contains(a, b))
    return (a != "") & (b != "") & ((a == b) | inside | by_words)


def strip_tags(x: Column) -> Column:
    return collapse(F.regexp_replace(x, r"<[^>]+>", " "))


def escape_html(x: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(plain), F.lit(escaped))
    return x


def escape_attribute(x: Column) -> Column:
    return F.replace(escape_html(x), F.lit("`"), F.lit("&#96;"))


def decode_entities(x: Column) -> Column:
    for escaped, plain in ENTITIES:
        x = F.replace(x, F.lit(escaped), F.lit(plain))
    return x


def split_count(x: Column) -> Column:
    """Parts between runs of white space, empty ones at the ends included."""
    return F.size(F.split(x, r"\s+"))


def truncate(x: Column, limit: int = 1_000_000) -> Column:
    return F.when(F.length(x) > limit, F.substring(x, 1, limit)).otherwise(x)


def content_hash(x: Column) -> Column:
    """SHA-256 of the text with white space collapsed: the identity of a selection."""
    return F.sha2(collapse(x), 256)


def cache_key(url: Column, body: Column, config: Column) -> Column:
    short = lambda x: F.substring(F.sha2(x, 256), 1, 16)
    return F.concat_ws("-", url, short(body), short(config))


def fnv1a32(x: Column) -> Column:
    """FNV-1a of the code points, 32 bits, as eight hexadecimal digits."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295))
    return F.lpad(F.lower(F.hex(F.aggregate(codes, F.lit(2166136261).cast("long"), step))), 8, "0")


def safe_title(x: Column) -> Column:
    """A title as part of a file name."""
    dashed = F.regexp_replace(F.regexp_replace(x, UNSAFE, ""), r"\s+", "-")
    short = F.regexp_replace(F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, 50), r"\.+$", "")
    return F.when(short == "", "untitled").otherwise(short)


def file_name(title: Column, at: Column, digest: Column, extension: str = "md") -> Column:
    return F.concat(safe_title(title), F.lit("__"), F.date_format(at, "yyyy-MM-dd'__'HHmm"), F.lit("__"), F.substring(digest, 1, 8), F.lit("." + extension))


def file_name_valid(x: Column) -> Column:
    stem = F.upper(F.regexp_replace(x, r"\.[^.]*$", ""))
    return (F.trim(x) != "") & ~stem.isin(RESERVED_NAMES) & ~x.rlike(UNSAFE) & (F.length(x) <= 255)


def js_round(x: Column) -> Column:
    """The nearest whole number, halves up also below zero."""
    return F.floor(x + 0.5)


def format_score(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " point").otherwise(" points"))


def format_author(name: Column) -> Column:
    plain = F.trim(F.coalesce(name, F.lit("")))
    return F.when(plain == "", "u/[deleted]").when(plain.startswith("u/"), plain).otherwise(F.concat(F.lit("u/"), plain))


def format_epoch(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
