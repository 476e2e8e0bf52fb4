"""Queries of the scalar text and URL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions import urls as U
from pagemill.plans.registry import column_query, query, table

c = F.col

# SQL of the shared text functions, as Python functions of a SQL expression.
WIDE = r"[\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}]"


def sql_collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sql_unicode(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{180E}}]', '', 'g'), '{WIDE}', ' ', 'g')"


def sql_normal(x: str) -> str:
    plain = rf"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<!\[cdata\[.*?\]\]>', ' ', 'g')"
    return sql_collapse(sql_unicode(f"replace({plain}, '-->', ' ')"))


def sql_quality(x: str) -> str:
    plain = rf"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<!\[cdata\[.*?\]\]>', ' ', 'g')"
    return sql_collapse(rf"regexp_replace(replace({plain}, '-->', ' '), '[\x00-\x1F\x7F-\x{{9F}}]', ' ', 'g')")


def sql_heading(x: str) -> str:
    return sql_collapse(rf"regexp_replace(lower({sql_normal(x)}), '[^\pL\pN\s]+', ' ', 'g')")


def sql_decode(x: str) -> str:
    for escaped, plain in T.ENTITIES:
        x = f"replace({x}, '{escaped}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return x


def sql_host(x: str) -> str:
    return rf"coalesce(nullif(regexp_extract(lower({x}), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), ''), lower({x}))"


def sql_path(x: str) -> str:
    return rf"regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


H1 = r"(?s)<h1[^>]*>(.*?)</h1>"
column_query("scan_pages", "pages", {"page_id": "page_id", "url": "url", "n_html": lambda: F.length("html").cast("long")}, "SELECT page_id, url, length(html)::BIGINT AS n_html FROM pages")
column_query(
    "doc_title",
    "pages",
    {
        "page_id": "page_id",
        "title": lambda: F.coalesce(*(F.nullif(T.decode_entities(T.strip_tags(F.regexp_extract("html", p, 1))), F.lit("")) for p in (r"(?s)<title[^>]*>(.*?)</title>", H1)), U.host(c("url"))),
    },
    rf"""SELECT page_id, {sql_decode("title")} AS title FROM (SELECT page_id, coalesce(nullif({sql_collapse("regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')")}, ''),
    nullif({sql_collapse(f"regexp_replace(regexp_extract(html, '{H1}', 1), '<[^>]+>', ' ', 'g')")}, ''), {sql_host("url")}) AS title FROM pages)""",
)
column_query("heading_h1", "pages", {"page_id": "page_id", "h1": lambda: F.regexp_extract("html", H1, 1)}, f"SELECT page_id, regexp_extract(html, '{H1}', 1) AS h1 FROM pages")
column_query("remove_comments", "pages", {"page_id": "page_id", "n_after": lambda: F.length(T.strip_comments(c("html"), "")).cast("long")}, "SELECT page_id, length(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'))::BIGINT AS n_after FROM pages")
column_query("normalize_unicode_ws", "documents", {"doc_id": "doc_id", "text": lambda: T.normalize_unicode_spaces(F.concat(F.lit(" ​x "), c("text")))}, f"""SELECT doc_id, {sql_unicode("chr(160) || chr(8203) || 'x' || chr(8195) || text")} AS text FROM documents""")
column_query("normalize_input_text", "pages", {"page_id": "page_id", "text": lambda: T.normalize_input(c("html"))}, f"SELECT page_id, {sql_normal('html')} AS text FROM pages")
column_query("normalize_input_text_ctrl", "documents", {"doc_id": "doc_id", "text": lambda: T.normalize_for_quality(F.concat(F.lit("a\x01b"), c("text")))}, f"""SELECT doc_id, {sql_quality("'a' || chr(1) || 'b' || text")} AS text FROM documents""")
column_query("normalize_heading", "documents", {"doc_id": "doc_id", "heading": lambda: T.normalize_heading(c("text"))}, f"SELECT doc_id, {sql_heading('text')} AS heading FROM documents")
column_query("strip_html_regex", "pages", {"page_id": "page_id", "text": lambda: T.strip_tags(c("html"))}, f"""SELECT page_id, {sql_collapse("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS text FROM pages""")
SQL_ESCAPE = """replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""
column_query("escape_html", "pages", {"page_id": "page_id", "escaped": lambda: T.escape_html(c("html")), "attribute": lambda: T.escape_attribute(c("url"))}, f"SELECT page_id, {SQL_ESCAPE.format('html')} AS escaped, replace({SQL_ESCAPE.format('url')}, '`', '&#96;') AS attribute FROM pages")
column_query(
    "decode_entities_basic",
    "pages",
    {"page_id": "page_id", "decoded": lambda: T.decode_entities(T.escape_html(c("html")))},
    f"""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace({SQL_ESCAPE.format("html")}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&mdash;', '—'), '&ndash;', '–') AS decoded FROM pages""",
)
column_query("js_word_count", "documents", {"doc_id": "doc_id", "n_words": lambda: T.split_count(c("text")).cast("long"), "n_chars": lambda: F.length("text").cast("long")}, r"SELECT doc_id, len(regexp_split_to_array(text, '\s+'))::BIGINT AS n_words, length(text)::BIGINT AS n_chars FROM documents")
column_query(
    "meaningful_content",
    "pages",
    {"page_id": "page_id", "meaningful": lambda: (F.length(T.strip_tags(c("html"))) >= 80) | c("html").rlike(r"(?i)<(h1|h2|h3|p|li|table|pre|code|blockquote|img)\b")},
    rf"""SELECT page_id, length({sql_collapse("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) >= 80 OR regexp_matches(html, '(?i)<(h1|h2|h3|p|li|table|pre|code|blockquote|img)\b') AS meaningful FROM pages""",
)


def before_body() -> Column:
    return F.regexp_replace("html", r"(?s)<body.*", "")


def visible(html: Column) -> Column:
    """The markup without what is never shown."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<template\b.*?</template>|<(?:meta|link)\b[^>]*>", " ")
    return bare


SQL_VISIBLE = r"regexp_replace({0}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<template\b.*?</template>|<(?:meta|link)\b[^>]*>', ' ', 'g')"
column_query(
    "meaningful_input",
    "pages",
    {
        "page_id": "page_id",
        "n_text": lambda: F.length(T.normalize_input(F.regexp_replace(visible(c("html")), "<[^>]*>", " "))).cast("long"),
        "meaningful": lambda: (T.normalize_input(F.regexp_replace(visible(c("html")), "<[^>]*>", " ")) != "") | visible(c("html")).rlike(r"(?i)<(img|video|audio|table|pre|code|svg|math|canvas|blockquote)\b"),
    },
    rf"""WITH v AS (SELECT page_id, {SQL_VISIBLE.format("html")} AS h FROM pages)
    SELECT page_id, length({sql_normal("regexp_replace(h, '<[^>]*>', ' ', 'g')")})::BIGINT AS n_text,
    {sql_normal("regexp_replace(h, '<[^>]*>', ' ', 'g')")} <> '' OR regexp_matches(h, '(?i)<(img|video|audio|table|pre|code|svg|math|canvas|blockquote)\b') AS meaningful FROM v""",
)
SILENT = "'html', 'head', 'body', 'script', 'style', 'noscript', 'template', 'meta', 'link'"
column_query(
    "script_style_only",
    "pages",
    {
        "page_id": "page_id",
        "silent": lambda: F.forall(F.regexp_extract_all(F.regexp_replace("html", r"(?s)<body.*", ""), F.lit(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)"), F.lit(1)), lambda t: F.lower(t).isin(*(x.strip(" '") for x in SILENT.split(","))))
        & (T.normalize_input(F.regexp_replace(F.regexp_replace("html", r"(?s)<body.*", ""), "<[^>]+>", " ")) == ""),
    },
    rf"""WITH h AS (SELECT page_id, regexp_replace(html, '(?s)<body.*', '') AS t FROM pages)
    SELECT page_id, len(list_filter(regexp_extract_all(t, '</?\s*([a-zA-Z][a-zA-Z0-9:-]*)', 1), lambda x: lower(x) NOT IN ({SILENT}))) = 0 AND {sql_normal("regexp_replace(t, '<[^>]+>', ' ', 'g')")} = '' AS silent FROM h""",
)
column_query(
    "sparse_fallback",
    "pages",
    {
        "page_id": "page_id",
        "content": lambda: F.when(T.strip_tags(visible(before_body())) != "", T.strip_tags(visible(before_body()))).when(c("html").rlike(r"(?i)javascript:|\son[a-z]+\s*="), F.lit("Content sanitized due to security filtering.")).otherwise(""),
    },
    rf"""WITH v AS (SELECT page_id, html, {sql_collapse("regexp_replace(" + SQL_VISIBLE.format("regexp_replace(html, '(?s)<body.*', '')") + ", '<[^>]+>', ' ', 'g')")} AS t FROM pages)
    SELECT page_id, CASE WHEN t <> '' THEN t WHEN regexp_matches(html, '(?i)javascript:|\son[a-z]+\s*=') THEN 'Content sanitized due to security filtering.' ELSE '' END AS content FROM v""",
)
column_query("truncate_html", "documents", {"doc_id": "doc_id", "text": lambda: T.truncate(c("text"), 2000), "clipped": lambda: F.length("text") > 2000}, "SELECT doc_id, substr(text, 1, 2000) AS text, length(text) > 2000 AS clipped FROM documents")
column_query(
    "selection_hash",
    "documents",
    {"doc_id": "doc_id", "hash": lambda: T.content_hash(c("text")), "cache_key": lambda: T.cache_key(F.concat(F.lit("https://example.com/"), c("source")), c("text"), c("lang"))},
    f"SELECT doc_id, sha256({sql_collapse('text')}) AS hash, 'https://example.com/' || source || '-' || substr(sha256(text), 1, 16) || '-' || substr(sha256(lang), 1, 16) AS cache_key FROM documents",
)


@query("hash_fnv1a32")
def hash_fnv1a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character by character over whole texts: too slow in SQL, so checked on literals in the tests."""
    return table(spark, sf_dir, "documents").select("doc_id", T.fnv1a32(F.coalesce("text", F.lit(""))).alias("hash"))


column_query("hash_stable64", "documents", {"doc_id": "doc_id", "hash": lambda: F.conv(F.substring(F.md5("text"), 1, 13), 16, 10).cast("long")}, "SELECT doc_id, ('0x' || substr(md5(text), 1, 13))::BIGINT AS hash FROM documents")
column_query("url_hostname", "pages", {"page_id": "page_id", "host": lambda: U.host(c("url"))}, f"SELECT page_id, {sql_host('url')} AS host FROM pages")
column_query("url_is_root", "pages", {"page_id": "page_id", "path": lambda: U.path(c("url")), "is_root": lambda: U.is_root(c("url"))}, f"SELECT page_id, {sql_path('url')} AS path, {sql_path('url')} IN ('', '/') AS is_root FROM pages")
column_query(
    "json_thread_url",
    "pages",
    {"page_id": "page_id", "json_url": lambda: U.json_thread_url(c("url"))},
    r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS u FROM pages)
    SELECT page_id, CASE WHEN u LIKE '%.json' THEN u ELSE u || '.json' END AS json_url FROM b""",
)
column_query(
    "api_base_normalise",
    "pages",
    {"page_id": "page_id", "base": lambda: U.api_base(c("url"))},
    rf"""SELECT page_id, CASE WHEN lower(url) LIKE 'https://%' THEN regexp_replace('https://' || {sql_host("url")} || {sql_path("url")}, '/+$', '') END AS base FROM pages""",
)
column_query(
    "provider_normalise",
    "documents",
    {"doc_id": "doc_id", "readability": lambda: U.readability_preset(c("lang")), "conversion": lambda: U.conversion_preset(F.when(c("lang") == "en", " GFM ").otherwise(c("lang")))},
    "SELECT doc_id, lang AS readability, CASE WHEN lang = 'en' THEN 'github' ELSE 'standard' END AS conversion FROM documents",
)


def _presets() -> str:
    rows = "\n".join(f"WHEN regexp_matches(url, '{'|'.join(p)}') THEN '{name}'" for name, p in U.PRESET_PATTERNS.items())
    return f"SELECT page_id, CASE {rows} ELSE 'default' END AS preset FROM pages"


column_query("url_preset", "pages", {"page_id": "page_id", "preset": lambda: U.preset(c("url"))}, _presets())


@query(
    "url_config_rule",
    rf"""
WITH u AS (SELECT page_id, lower(url) AS u, {sql_host("url")} AS h FROM pages), r AS (
SELECT page_id, CASE WHEN h LIKE '%reddit.com' OR u LIKE '%reddit.com%' THEN 'reddit'
  WHEN h LIKE '%github.com' OR h LIKE 'docs.%' OR h LIKE 'api.%' OR u LIKE '%/docs/%' THEN 'technical-docs'
  WHEN h LIKE 'blog.%' OR h LIKE '%medium.com' OR h LIKE '%substack.com' OR u LIKE '%/blog/%' THEN 'blog'
  WHEN h LIKE '%wikipedia.org' OR u LIKE '%/wiki/%' THEN 'wiki' ELSE 'none' END AS rule FROM u)
SELECT page_id, rule, CASE rule WHEN 'reddit' THEN 'reddit-post' WHEN 'technical-docs' THEN 'technical-documentation' WHEN 'blog' THEN 'blog-article' WHEN 'wiki' THEN 'wiki-content' ELSE 'auto' END AS readability,
  CASE WHEN rule = 'technical-docs' THEN 'github' ELSE 'standard' END AS conversion, rule IN ('blog', 'wiki') AS contents, CASE WHEN rule = 'technical-docs' THEN 'github' ELSE 'standard' END AS platform FROM r
""",
)
def url_config_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.config_rule(c("url")).alias("r")).select("page_id", "r.*")


@query(
    "preset_alias",
    """SELECT * FROM (VALUES ('news', 'news-article', 'standard'), (' Standard ', NULL, 'standard'), ('GFM', 'gfm', 'github'), ('forums', 'forum-discussion', 'standard'),
    ('obsidian', 'obsidian', 'obsidian'), ('', NULL, 'standard'), ('academic', 'academic-paper', 'academic'), ('weird', 'weird', 'standard')) AS v(name, readability, conversion)""",
)
def preset_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in ("news", " Standard ", "GFM", "forums", "obsidian", "", "academic", "weird")], "name string")
    return names.select("name", U.readability_preset(c("name")).alias("readability"), U.conversion_preset(c("name")).alias("conversion"))


SAFE_SQL = r"""regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace({0}, '[<>:"/\\|?*\x00-\x1f]', '', 'g'), '\s+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50), '\.+$', '')"""
column_query(
    "sink_filename",
    "documents",
    {"doc_id": "doc_id", "name": lambda: T.file_name(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("2026-01-02 03:04:05").cast("timestamp"), T.content_hash(c("text")))},
    f"""WITH s AS (SELECT doc_id, text, {SAFE_SQL.format("replace(text, chr(10), ' ')")} AS t FROM documents)
    SELECT doc_id, (CASE WHEN t = '' THEN 'untitled' ELSE t END) || '__2026-01-02__0304__' || substr(sha256({sql_collapse("text")}), 1, 8) || '.md' AS name FROM s""",
)
RESERVED_SQL = ", ".join(f"'{x}'" for x in T.RESERVED_NAMES)
column_query(
    "filename_valid",
    "documents",
    {"doc_id": "doc_id", "valid": lambda: T.file_name_valid(F.when(c("doc_id") % 3 == 0, F.concat(F.lit("con."), c("lang"))).when(c("doc_id") % 3 == 1, F.col("text")).otherwise(F.concat("source", F.lit(".md"))))},
    rf"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'con.' || lang WHEN doc_id % 3 = 1 THEN text ELSE source || '.md' END AS f FROM documents)
    SELECT doc_id, trim(f) <> '' AND upper(regexp_replace(f, '\.[^.]*$', '')) NOT IN ({RESERVED_SQL}) AND NOT regexp_matches(f, '[<>:"/\\|?*\x00-\x1f]') AND length(f) <= 255 AS valid FROM n""",
)
column_query(
    "format_author_score",
    "documents",
    {"doc_id": "doc_id", "author": lambda: T.format_author(F.when(c("doc_id") % 4 == 0, F.lit(" ")).when(c("doc_id") % 4 == 1, F.lit("u/ann")).otherwise(c("source"))), "score": lambda: T.format_score(c("doc_id") % 5), "at": lambda: T.format_epoch(c("doc_id") * 86_400)},
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'u/[deleted]' WHEN 1 THEN 'u/ann' ELSE 'u/' || source END AS author,
    (doc_id % 5)::VARCHAR || CASE WHEN doc_id % 5 = 1 THEN ' point' ELSE ' points' END AS score,
    strftime(TIMESTAMP '1970-01-01' + to_days(doc_id::INTEGER), '%Y-%m-%dT%H:%M:%S.000Z') AS at FROM documents""",
)


@query(
    "heading_equivalent",
    rf"""
WITH h AS (SELECT doc_id, {sql_heading("string_split(text, chr(10))[1]")} AS a FROM documents),
t AS (SELECT x.doc_id, x.a, y.a AS b, list_filter(string_split(x.a, ' '), lambda v: length(v) > 2) AS ta, list_distinct(list_filter(string_split(y.a, ' '), lambda v: length(v) > 2)) AS tb FROM h x JOIN h y ON y.doc_id = x.doc_id + 1)
SELECT doc_id, a <> '' AND b <> '' AND (a = b OR (length(a) >= 20 AND contains(b, a)) OR (length(b) >= 20 AND contains(a, b)) OR
  (len(ta) > 0 AND len(tb) > 0 AND len(list_filter(ta, lambda x: list_contains(tb, x))) >= least(3, len(ta), len(tb)))) AS same FROM t
""",
)
def heading_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of every document against that of the next one."""
    heads = table(spark, sf_dir, "documents").select("doc_id", T.normalize_heading(F.get(F.split("text", "\n"), F.lit(0))).alias("a"))
    others = heads.select((c("doc_id") - 1).alias("doc_id"), c("a").alias("b"))
    return heads.join(others, "doc_id").select("doc_id", T.headings_equivalent(c("a"), c("b")).alias("same"))


@query(
    "capture_validate",
    """SELECT doc_id, CASE WHEN lang IS NULL OR trim(coalesce(text, '')) = '' THEN 'missing' WHEN doc_id % 10 = 0 THEN 'no-hash' ELSE 'ok' END AS status, substr(text, 1, 200) AS metadata FROM documents""",
)
def capture_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.sources.captures import validate

    rows = table(spark, sf_dir, "documents").select("doc_id", c("text").alias("html"), F.lit("https://example.com").alias("url"), c("lang").alias("title"), F.when(c("doc_id") % 10 == 0, F.lit("")).otherwise(F.lit("h")).alias("selectionHash"), c("text").alias("metadataHtml"))
    checked = validate(rows, clip=200)
    status = F.when(F.array_contains("missing", "html") | F.array_contains("missing", "title"), "missing").when(F.array_contains("missing", "selectionHash"), "no-hash").otherwise("ok")
    return checked.select("doc_id", status.alias("status"), c("metadataHtml").alias("metadata"))
