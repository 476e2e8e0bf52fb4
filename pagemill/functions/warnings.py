"""What is suspicious about raw markup, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let, once

# Warnings and the patterns that raise them, any row of patterns all of which are found.
RULES = (
    ("Unicode invalid control character sequences detected", ([r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"],)),
    ("script XSS content removed", ([r"(?i)<script\b"],)),
    ("event handler XSS removed", ([r"(?i)\son[a-z]+\s*="],)),
    ("protocol XSS sanitized", ([r"(?i)(?:javascript:|vbscript:|data:text/html)"],)),
    ("CSS XSS style sanitized", ([r"(?i)expression\s*\(|@import\s+url\(\s*(?:['\"]\s*)?javascript:"],)),
    ("encoded XSS sanitized", ([r"(?i)&#x?[0-9a-f]+;|%3cscript|&lt;script&gt;", r"(?i)script|alert\s*\("],)),
    ("malicious payload indicators detected", ([r"(?i)\son[a-z]+\s*=|javascript:|vbscript:|data:text/html"], [r"(?is)<script\b.*?(?:alert\s*\(|document\.|window\.|location\.|eval\s*\(|function\s*\()"])),
    ("conditional comment browser-specific content detected", ([r"(?i)<!--\[if"],)),
    ("comment CDATA suspicious content detected", ([r"<!--|<!\[cdata\[", r"(?i)alert\s*\(|javascript:|<script\b"],)),
    ("DOM clobber name collision risk detected", ([r"(?i)\bname\s*=\s*[\"']?(?:action|method|submit|length)\b"],)),
    ("DOM clobber conflict detected", ([r"(?i)\bname\s*=\s*[\"']?(?:action|method|submit|length)\b"],)),
    ("namespace custom attribute normalization applied", ([r"(?i)\b(?:xmlns(?::\w+)?|data-[\w-]+|aria-[\w-]+)\s*="],)),
    ("data injection payload sanitized", ([r"(?i)\b(?:meta[^>]+http-equiv\s*=\s*[\"']?refresh|object\b|embed\b|data:text/html)|\w@import\s+url"],)),
    ("attribute quote malformed normalization applied", ([r"(?i)<[^>]+\b[a-z:-]+\s*=\s*[^\"'\s>][^\s>]*"], [r"<[^>]+\b[a-z:-]+\s*=\s*[\"'][^\"']*[\"'][^>\s]+\s*="])),
    ("hidden invisible content detected", ([r"(?i)display\s*:\s*none|visibility\s*:\s*hidden|type\s*=\s*[\"']hidden[\"']"], [r"(?i)width\s*:\s*0", r"(?i)height\s*:\s*0"])),
)
PROTOCOL = "protocol XSS sanitized"
STRUCTURE = (
    ("unclosed tag structure detected", lambda s: s["unclosed"] > 0),
    ("unclosed heading structure detected", lambda s: s["unclosed_headings"] > 0),
    ("mismatched closing tag detected", lambda s: s["mismatched"] > 0),
    ("self-closing tag normalization applied", lambda s: s["bare_void"] > 0),
    ("table malformed structure detected", lambda s: s["table_seen"] & (s["unclosed"] + s["mismatched"] > 0)),
    ("list structure orphaned items detected", lambda s: s["list_seen"] & (s["unclosed"] + s["mismatched"] > 0)),
)
TABLE, LIST = "table thead tbody tfoot tr td th".split(), "ul ol li".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RISK = "(?i)protocol|event handler|clobber|data injection|malicious|encoded|attribute quote malformed"


def _references(text: Column, prefix: str, digit: str, base: int) -> Column:
    """The text with its numeric character references decoded as UTF-16 units: cut at their prefixes, each piece begins with the digits."""

    def piece(part: Column) -> Column:
        digits = F.regexp_extract(part, f"^({digit}+)", 1)
        number = F.conv(F.right(digits, F.lit(4)), 16, 10).try_cast("long") if base == 16 else digits.try_cast("long") % 65536
        blank = number.isin(5760, 8232, 8233, 8239, 8287, 12288, 65279) | number.between(8192, 8202)
        sign = F.when(number < 256, F.chr(number)).when(blank, F.lit(" ")).otherwise(F.lit("\ufffd"))
        return F.concat(sign, F.regexp_replace(part, f"^{digit}+;?", ""))

    def joined(parts: Column) -> Column:
        later = F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(later, ""))

    return let(F.split(text, f"{prefix}(?={digit})"), joined)


def protocol_probe(html: Column) -> Column:
    """Lower-case markup with its numeric references, first hexadecimal and then decimal, decoded, and without white space, control
    characters and backslashes: what a browser would read as the protocol of an address."""
    blanks = F.regexp_replace(F.lower(html), "&(?:tab|newline);", " ")
    decoded = _references(_references(blanks, "&#x", "[0-9a-f]", 16), "&#", "[0-9]", 10)
    return F.regexp_replace(decoded, r"[\s\p{Z}\x{FEFF}\x00-\x1f\\]+", "")


@once
def input_warnings(html: Column) -> Column:
    """The warnings that a page's markup raises, those of patterns first, then those of its tag structure; null raises none.

    Text of a column is valid UTF-8 and holds no single surrogates, so there is no warning of them.
    """

    def raised(name: str, ways: tuple) -> Column:
        found = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [html.rlike(p) for p in way]) for way in ways])
        return found | protocol_probe(html).rlike(dict(RULES)[PROTOCOL][0][0]) if name == PROTOCOL else found

    patterns = [F.when(raised(name, ways), F.lit(name)) for name, ways in RULES]
    structure = let(tag_structure(html), lambda s: F.array(*(F.when(holds(s), F.lit(name)) for name, holds in STRUCTURE)))
    return F.array_compact(F.concat(F.array(*patterns), structure))


def has_security_signal(warnings: Column) -> Column:
    return F.exists(warnings, lambda w: w.rlike(RISK))


@once
def tag_structure(html: Column) -> Column:
    """Struct of the tags left open, those closed out of place, open headings, void tags without a slash, and whether any tag is of a table or list.

    A fold over the tags with the row of open tags as its state.
    """
    tags = F.regexp_extract_all(html, F.lit(r"(</?[a-zA-Z][a-zA-Z0-9:-]*(?:\s[^>]*)?>)"), F.lit(1))
    empty = F.array().cast("array<string>")

    def step(s: Column, tag: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))
        closing, alone = tag.startswith("</"), tag.rlike(r"/>\s*$")
        void, top = name.isin(VOID), F.get(s["open"], F.lit(0))
        place = F.array_position(s["open"], name)
        without = F.when(place == 0, s["open"]).otherwise(F.concat(F.slice(s["open"], F.lit(1), (place - 1).cast("int")), F.slice(s["open"], (place + 1).cast("int"), F.size(s["open"]))))
        opened = F.concat(F.array(name), s["open"])
        return F.struct(
            F.when(closing, without).when(void | alone, s["open"]).otherwise(opened).alias("open"),
            (s["bad"] + F.when(closing & ~F.coalesce(top == name, F.lit(False)), 1).otherwise(0)).alias("bad"),
            (s["bare"] + F.when(~closing & void & ~alone, 1).otherwise(0)).alias("bare"),
            (s["table"] | name.isin(TABLE)).alias("table"),
            (s["list"] | name.isin(LIST)).alias("list"),
        )

    begin = F.struct(empty.alias("open"), F.lit(0).alias("bad"), F.lit(0).alias("bare"), F.lit(False).alias("table"), F.lit(False).alias("list"))
    heads = lambda s: F.size(F.filter(s["open"], lambda t: t.rlike("^h[1-6]$")))
    return F.aggregate(tags, begin, step, lambda s: F.struct(F.size(s["open"]).alias("unclosed"), s["bad"].alias("mismatched"), heads(s).alias("unclosed_headings"), s["bare"].alias("bare_void"), s["table"].alias("table_seen"), s["list"].alias("list_seen")))


def any_of(warnings: Column, names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.array_contains(warnings, n) for n in names])
