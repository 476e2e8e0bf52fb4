"""URL functions and the rule tables over URLs as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the readability presets in the order in which they are tried.
PRESET_PATTERNS = {
    "technical-documentation": [r"docs?\.", r"api\.", r"developer\.", r"github\.com", r"stackoverflow\.com", r"\.readthedocs\."],
    "blog-article": ["blog", "article", "/post/", r"medium\.com", r"substack\.com"],
    "news-article": ["news", r"\.com/\d{4}/\d{2}/\d{2}", r"reuters\.com", r"bbc\.com", r"cnn\.com", r"nytimes\.com"],
    "academic-paper": [r"arxiv\.org", r"\.edu", r"researchgate\.net", r"scholar\.google", "pubmed"],
    "forum-discussion": [r"reddit\.com", r"discourse\.", "forum", "community", "discuss"],
    "wiki-content": [r"wikipedia\.org", "wiki", r"fandom\.com", r"wikia\.com"],
    "npm-package": [r"npmjs\.com", r"www\.npmjs\.org"],
    "reddit-post": [r"reddit\.com/r/", r"www\.reddit\.com"],
}
READABILITY_ALIASES = {
    "news-articles": "news-article", "news": "news-article", "academic-papers": "academic-paper", "academic": "academic-paper",
    "social-media": "forum-discussion", "social": "forum-discussion", "forums": "forum-discussion", "forum": "forum-discussion",
}
CONVERSION_ALIASES = {"github-flavored": "github", "github_flavored": "github", "githubflavored": "github", "gfm": "github"}
CONVERSION_PRESETS = ["standard", "github", "obsidian", "notion", "academic", "minimal"]


def host(url: Column) -> Column:
    """The lower-cased host, or the URL as it is where there is none."""
    lower = F.lower(F.coalesce(url, F.lit("")))
    return F.coalesce(F.try_parse_url(lower, F.lit("HOST")), lower)


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def is_root(url: Column) -> Column:
    return path(url).isin("", "/")


def json_thread_url(url: Column) -> Column:
    """The address of a thread's JSON listing: no query, no fragment, `.json` at the end."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    return F.when(bare.endswith(".json"), bare).otherwise(F.concat(bare, F.lit(".json")))


def _first(rules: list[tuple[Column, object]], default: Column) -> Column:
    chain = reduce(lambda w, r: w.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1]))
    return chain.otherwise(default)


def preset(url: Column) -> Column:
    """The first preset one of whose patterns is found in the URL."""
    return _first([(url.rlike("|".join(p)), F.lit(name)) for name, p in PRESET_PATTERNS.items()], F.lit("default"))


def config_rule(url: Column) -> Column:
    """Struct of the first matching rule: id, readability and conversion presets, table of contents, platform."""
    lower, name = F.lower(F.coalesce(url, F.lit(""))), host(url)

    def settings(rule: str, readability: str, conversion: str, contents: bool, platform: str) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(readability).alias("readability"), F.lit(conversion).alias("conversion"), F.lit(contents).alias("contents"), F.lit(platform).alias("platform"))

    rules = [
        (name.endswith("reddit.com") | lower.contains("reddit.com"), settings("reddit", "reddit-post", "standard", False, "standard")),
        (name.endswith("github.com") | name.startswith("docs.") | name.startswith("api.") | lower.contains("/docs/"), settings("technical-docs", "technical-documentation", "github", False, "github")),
        (name.startswith("blog.") | name.endswith("medium.com") | name.endswith("substack.com") | lower.contains("/blog/"), settings("blog", "blog-article", "standard", True, "standard")),
        (name.endswith("wikipedia.org") | lower.contains("/wiki/"), settings("wiki", "wiki-content", "standard", True, "standard")),
    ]
    return _first(rules, settings("none", "auto", "standard", False, "standard"))


def readability_preset(name: Column) -> Column:
    """A canonical preset name; null for what means the default."""
    plain = F.lower(F.trim(name))
    aliases = F.create_map(*(F.lit(x) for pair in READABILITY_ALIASES.items() for x in pair))
    return F.when((plain == "") | plain.isin("standard", "auto", "default"), None).otherwise(F.coalesce(F.try_element_at(aliases, plain), plain))


def conversion_preset(name: Column) -> Column:
    plain = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    aliases = F.create_map(*(F.lit(x) for pair in CONVERSION_ALIASES.items() for x in pair))
    known = F.coalesce(F.try_element_at(aliases, plain), plain)
    return F.when(known.isin(CONVERSION_PRESETS), known).otherwise("standard")


def api_base(url: Column) -> Column:
    """Origin and path of an API address without a slash at the end; null if it is no https address of a public host."""
    name, port = host(url), F.try_parse_url(url, F.lit("AUTHORITY"))
    octet = lambda i: F.try_element_at(F.split(name, r"\."), F.lit(i)).try_cast("int")
    is_ip = name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    private_ip = is_ip & (octet(1).isin(0, 10, 127) | ((octet(1) == 192) & (octet(2) == 168)) | ((octet(1) == 169) & (octet(2) == 254)) | ((octet(1) == 172) & octet(2).between(16, 31)))
    local = name.isin("localhost", "::1", "[::1]") | name.endswith(".local") | name.endswith(".internal") | private_ip
    good = F.lower(url).startswith("https://") & ~local & ~port.rlike(r":(?!443$)\d+$")
    return F.when(good, F.regexp_replace(F.concat(F.lit("https://"), name, path(url)), "/+$", ""))
