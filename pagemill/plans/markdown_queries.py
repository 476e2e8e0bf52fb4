"""Queries of the Markdown passes, over Markdown made from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import markdown as M
from pagemill.functions import text as T
from pagemill.operators.kernel import spread
from pagemill.plans.registry import query, table
from pagemill.plans.text_queries import sql_collapse, sql_heading, sql_normal

c = F.col
TICKS = "```"

#: What is put below the text of a document, by its id: something for every pass to do.
EXTRAS = [
    f"\n\n{TICKS}python\nx = 1   \n* not a bullet\n\\# kept\nShare\n{TICKS}\n* bullet one\n+ bullet two\n1.   item\n-   dash\n\n    indented code\nuse ` spaced ` code",
    "\nShare\nAdvertisement\n42\n- 17\n[Share](https://x.example.com/share?u=1)\n\nkeep this line\nAccept all the cookies please\nPast week\nLinkedIn\n![x](https://a.example.com/i.png)\n*\nPython +12",
    "\n\n\n\n\n## Head\n#### Deep\ntext [a]( https://e.example.com ) [b](//cdn.example.com/x) [gone](  )\n![](https://e.example.com/p/photo.big.png) after ![alt](https://e.example.com/q.png)\n### Last",
    "\n&lt;div&gt;\n&lt;/div&gt;\n\\# escaped\n==mark== \t\ttab  \r\nnext\rlast visitwww.example.com and seehttps://example.com/x\n> quotewww.example.com",
    "".join(f"\nline {i}" for i in range(40)) + "\nPrivacy Policy\nCareers\nContact us\n© 2026 Us\nAll rights reserved\nTerms\nthe end",
    "\nAlpha\nBeta\nGamma\nDelta\nEpsilon\nZeta\n\nnot alone\nOne\nTwo\nThree\n\n## Split heading\ncontinued here\n\nafter",
    '\n<script>alert(1)</script> <a onclick="x()">y</a> javascript:go() document.location alert',
]
FRONT = ["", "> Source: [t](u)\n> Captured: now\n> Hash: abc\n\n", f"{TICKS}markdown\n", "- [Home](https://example.com/)\nNews\n\nLead text\n\n"]
BACK = ["", "", f"\n{TICKS}\n", ""]


def markdown(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents as Markdown: a heading, the text with its sentences on lines, and an extra; and more columns of theirs."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    pick = lambda parts, key: F.element_at(F.array(*map(F.lit, parts)), (key % len(parts) + 1).cast("int"))
    title = F.concat("source", F.lit(" document number "), c("doc_id").cast("string"))
    # One document in four is a whole-document fence; those get the fence alone around plain text.
    body = F.concat(F.lit("# "), title, F.lit("\n\n"), F.replace("text", F.lit(". "), F.lit(".\n")))
    extra = F.when(c("doc_id") % 4 == 2, F.lit("")).otherwise(pick(EXTRAS, F.floor(c("doc_id") / 4)))
    return docs.select("doc_id", title.alias("title"), F.concat(pick(FRONT, c("doc_id")), body, extra, pick(BACK, c("doc_id"))).alias("md"), *more)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\r", "' || chr(13) || '") + "'"


def _pick(parts: list[str], key: str) -> str:
    return f"CASE {key} % {len(parts)} " + " ".join(f"WHEN {i} THEN {_literal(p)}" for i, p in enumerate(parts)) + " END"


SQL_MD = f"""m AS (SELECT doc_id, source || ' document number ' || doc_id AS title, ({_pick(FRONT, "doc_id")}) || '# ' || source || ' document number ' || doc_id || chr(10) || chr(10)
  || replace(text, '. ', '.' || chr(10)) || (CASE WHEN doc_id % 4 = 2 THEN '' ELSE ({_pick(EXTRAS, "(doc_id // 4)")}) END) || ({_pick(BACK, "doc_id")}) AS md FROM documents)"""
#: Lines with the running parity of the fence lines: prose has 0, fences and code have 1.
SQL_LINES = f"""{SQL_MD}, l0 AS (SELECT doc_id, title, i, ls[i] AS line FROM (SELECT doc_id, title, string_split(md, chr(10)) AS ls, unnest(range(1, len(string_split(md, chr(10))) + 1)) AS i FROM m)),
l AS (SELECT *, regexp_matches(line, '^[ \t]*```') AS fence, (sum(regexp_matches(line, '^[ \t]*```')::INT) OVER (PARTITION BY doc_id ORDER BY i) - regexp_matches(line, '^[ \t]*```')::INT) % 2 = 1 AS code FROM l0)"""


TOP = r"regexp_extract(md, '(?m)^#\s+(\S.*)$', 1)"


def md_query(name: str, run, sql: str) -> None:
    @query(name, sql)
    def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return markdown(spark, sf_dir).select("doc_id", run().alias("md"))


def by_line(change: str, keep: str = "true") -> str:
    """SQL of a pass that changes or drops prose lines one by one."""
    return f"WITH {SQL_LINES} SELECT doc_id, coalesce(string_agg(CASE WHEN fence OR code THEN line ELSE {change} END, chr(10) ORDER BY i) FILTER (fence OR code OR ({keep})), '') AS md FROM l GROUP BY doc_id"


def whole(expression: str) -> str:
    return f"WITH {SQL_MD} SELECT doc_id, {expression} AS md FROM m"


g = lambda x, p, by, flags="": rf"regexp_replace({x}, '{p}', '{by}', 'g{flags}')"
md_query("md_cleanup_ws", lambda: M.cleanup_spaces(c("md")), whole(f"replace({g('replace(replace(md, chr(13) || chr(10), chr(10)), chr(13), chr(10))', r'(?m)[ \t]+$', '')}, chr(9), '  ')"))
md_query("md_unescape_tokens", lambda: M.unescape_leading(c("md")), by_line(r"regexp_replace(line, '^\\#(\s+)', '#\1')"))
md_query(
    "md_fix_lists",
    lambda: M.fix_lists(F.replace("md", F.lit("\r"), F.lit(""))),
    by_line(r"regexp_replace(regexp_replace(regexp_replace(line, '^([ \t]*)[*+][ \t]+(\S.*)$', '\1- \2'), '^([ \t]*-)[ \t]+', '\1 '), '^([ \t]*)(\d+)\.[ \t]+', '\1\2. ')").replace("string_split(md, chr(10))", "string_split(replace(md, chr(13), ''), chr(10))"),
)
md_query("md_limit_blank", lambda: M.limit_blank(c("md")), whole(r"regexp_replace(md, '\n{3,}', chr(10) || chr(10), 'g')"))
md_query("md_strip_highlight", lambda: M.strip_highlight(c("md")), whole(r"regexp_replace(md, '==([^=\n]+)==', '\1', 'g')"))
md_query(
    "md_enhance_links",
    lambda: M.links(c("md")),
    whole(g(g(g("md", r"\[\s*([^\]]*?)\s*\]\(\s*\)", r"\1"), r"\[\s*([^\]]*?)\s*\]\(\s*([^)]*?)\s*\)", r"[\1](\2)"), r"\[([^\]]*)\]\(//([^)]*)\)", r"[\1](https://\2)")),
)
NL = "' || chr(10) || chr(10) || '"
md_query("md_optimize_images", lambda: M.images(c("md")), whole(g(g(g("md", r"(!\[[^\]]*\]\([^)]*\))", NL + r"\1" + NL), r"\n{3,}", NL), r"!\[\]\(((?:[^)]*/)?([^)/.]+)[^)/]*)\)", r"![\2](\1)")))
md_query("md_final_cleanup", lambda: M.final_cleanup(c("md")), whole(r"regexp_replace(regexp_replace(md, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{ad}\x{61c}\x{200b}-\x{200f}\x{2028}\x{2029}\x{feff}\x{fff9}-\x{fffc}]', '', 'g'), '\n+\z', '') || chr(10)"))
md_query(
    "md_unwrap_doc_fence",
    lambda: M.unwrap_fence(c("md")),
    rf"""WITH {SQL_MD} SELECT doc_id, CASE WHEN b <> '' THEN b ELSE md END AS md FROM (SELECT doc_id, md, regexp_extract(replace(replace(md, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?is)^\s*```[ \t]*(?:markdown|md)[ \t]*\n(.*)\n[ \t]*```\s*$', 1) AS b FROM m)""",
)
md_query("md_strip_citation", lambda: M.strip_citation(c("md")), rf"""WITH {SQL_MD} SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN substr(md, {len(FRONT[1]) + 1}) ELSE md END AS md FROM m""")
md_query(
    "md_sanitize",
    lambda: M.sanitize(c("md")),
    whole(
        g(g(g(g(g(g(g(g("md", r"(?is)<script\b.*?</script>", " "), r"(?i)\bon[a-z]+\s*=\s*(\"[^\"]*\"|''[^'']*''|[^\s>]+)", ""), r"(?i)(?:java\s*script|vb\s*script)\s*:", "blocked:"), r"(?i)data\s*:\s*text/html", "data:text/blocked"), r"(?i)\balert\s*\(", "blocked_call("), r"(?i)\balert\b", "blocked_alert"), r"(?i)document\s*\.\s*location", "document.location_blocked"), r"(?i)%3c/?script%3e", " ")
    ),
)
UI = "(" + " OR ".join([
    "regexp_matches(plain, '{}')".format("|".join(M.UI_STRONG)),
    "(length(plain) <= 200 AND regexp_matches(plain, '{}'))".format("|".join(M.UI_SHORT)),
    "regexp_matches(plain, 'data:image/')",
    "regexp_matches(t, '(?i){}')".format("|".join(M.UI_EXACT)),
    "regexp_matches(bare, '(?i){}')".format("|".join(M.UI_EXACT)),
    "regexp_matches(t, '(?i){}')".format("|".join(M.UI_TRIMMED)),
    r"regexp_matches(t, '^[A-Za-z][A-Za-z0-9 .&:/''()-]{1,70}\s+\+\d{1,3}$')",
    r"regexp_matches(bare, '^[A-Za-z][A-Za-z0-9 .&:/''()-]{1,70}\s+\+\d{1,3}$')",
]) + ")"
md_query(
    "md_strip_ui_noise",
    lambda: M.strip_ui_noise(F.replace("md", F.lit("\r"), F.lit(""))),
    rf"""WITH {SQL_LINES.replace("string_split(md, chr(10))", "string_split(replace(md, chr(13), ''), chr(10))")}, n AS (SELECT *, trim(line) AS t, lower({sql_normal("line")}) AS plain, trim(regexp_replace(regexp_replace(trim(line), '^[-*+]\s+', ''), '^\d+\.\s+', '')) AS bare FROM l)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (fence OR code OR NOT (plain <> '' AND NOT regexp_matches(t, '^#{{1,6}}\s') AND {UI})), '') AS md FROM n GROUP BY doc_id""",
)
md_query(
    "md_strip_media",
    lambda: M.strip_media(F.replace("md", F.lit("\r"), F.lit(""))),
    rf"""WITH {SQL_MD}, l AS (SELECT doc_id, i, ls[i] AS line, trim(ls[i]) AS t FROM (SELECT doc_id, string_split(replace(md, chr(13), ''), chr(10)) AS ls, unnest(range(1, len(string_split(replace(md, chr(13), ''), chr(10))) + 1)) AS i FROM m)),
    n AS (SELECT *, regexp_matches(t, '^!\[([^\]]*)]\(([^)]+)\)$') AS image, trim(regexp_extract(t, '^!\[([^\]]*)]\(([^)]+)\)$', 1)) AS alt, lower(trim(regexp_extract(t, '^!\[([^\]]*)]\(([^)]+)\)$', 2))) AS url FROM l)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (t = '' OR NOT (
      regexp_matches(t, '^\[\s*]\([^)]+\)\s*$|^\[\s*$|^\]\([^)]+\)(?:\s*\[\s*)?$|^[-•*]\s*$') OR regexp_matches(t, '(?i)^(whatsapp|twitter|facebook|instagram|linkedin|telegram|x|share|save|copy link)$')
      OR regexp_matches(t, '^>\s*&(?:mdash|#8212);|^>\s*[—-]\s*@?[A-Za-z0-9_]+')
      OR (image AND (alt = '' OR regexp_matches(alt, '^[A-Za-z0-9_+=/-]{{10,}}$') OR regexp_matches(lower(alt), '^(image|photo|picture|logo|icon|avatar|{M.SOCIAL})$') OR regexp_matches(url, '^data:image|framerusercontent\.com|avatars\.githubusercontent\.com|gravatar\.com'))))), '') AS md FROM n GROUP BY doc_id""",
)
md_query(
    "md_strip_footer",
    lambda: M.strip_footer(F.replace("md", F.lit("\r"), F.lit(""))),
    rf"""WITH {SQL_MD.replace("AS md FROM documents", "AS md0 FROM documents")}, m2 AS (SELECT doc_id, replace(md0, chr(13), '') AS md FROM m), l AS (SELECT doc_id, md, i, len(ls) AS n, ls[i] AS line FROM (SELECT doc_id, md, string_split(md, chr(10)) AS ls, unnest(range(1, len(string_split(md, chr(10))) + 1)) AS i FROM m2)),
    f AS (SELECT doc_id, n, i, i > n - 140 AND (regexp_matches(lower({sql_normal("line")}), '{M.FOOTER}') OR regexp_matches(lower({sql_normal("line")}), '^©\s*\d{{4}}')) AS hit FROM l),
    s AS (SELECT doc_id, max(n) AS n, count(*) FILTER (hit) AS hits, min(i) FILTER (hit) AS first FROM f GROUP BY doc_id),
    p AS (SELECT doc_id, md, lower({sql_normal("md")}) AS plain FROM m2)
    SELECT doc_id, CASE WHEN n >= 40 AND hits >= 5 AND NOT (regexp_matches(plain, 'latest blog posts?') AND regexp_matches(plain, '(^|\s)contact(\s|$)') AND regexp_matches(plain, '(^|\s)projects?(\s|$)'))
      THEN regexp_replace(array_to_string(string_split(md, chr(10))[1:first - 1], chr(10)), '\s+\z', '') ELSE md END AS md FROM s JOIN p USING (doc_id)""",
)
md_query(
    "md_collapse_words",
    lambda: M.collapse_words(F.replace("md", F.lit("\r"), F.lit(""))),
    rf"""WITH {SQL_LINES.replace("string_split(md, chr(10))", "string_split(replace(md, chr(13), ''), chr(10))")}, w AS (SELECT *, NOT fence AND NOT code AND regexp_matches(line, '^[ \t]*[A-Za-z][A-Za-z0-9&+/-]{{1,23}}[ \t]*$') AS word FROM l),
    r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, word ORDER BY i) AS run FROM w), k AS (SELECT *, word AND count(*) OVER (PARTITION BY doc_id, word, run) >= 5 AS joined FROM r),
    b AS (SELECT doc_id, CASE WHEN joined THEN run ELSE i * 1000000 + i END AS grp, joined, min(i) AS i, string_agg(CASE WHEN joined THEN trim(line) ELSE line END, CASE WHEN joined THEN ' ' ELSE chr(10) END ORDER BY i) AS line FROM k GROUP BY ALL)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS md FROM b GROUP BY doc_id""".replace("CASE WHEN joined THEN ' ' ELSE chr(10) END ORDER BY i) AS line FROM k GROUP BY ALL", "' ' ORDER BY i) AS line FROM k GROUP BY doc_id, grp, joined"),
)
md_query("md_token_boundaries", lambda: M.token_boundaries(c("md")), by_line(r"CASE WHEN trim(line) LIKE '>%' THEN line ELSE regexp_replace(regexp_replace(line, '([A-Za-z])((?:https?://|www\.)\S+)', '\1 \2', 'g'), '([A-Za-z])(\d+\\\.\s+)', '\1 \2', 'g') END"))
md_query("md_spacing", lambda: M.spacing(F.replace("md", F.lit("\r"), F.lit(""))), whole(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(md, chr(13), ''), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)^[ \t]+$', '', 'g'), '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"))
md_query(
    "md_primary_heading",
    lambda: M.primary_heading(F.regexp_replace("md", r"\A# .*\n", ""), F.concat(F.lit("A page about "), c("title"))),
    rf"""WITH {SQL_MD}, x AS (SELECT doc_id, regexp_replace(md, '\A# .*\n', '') AS md, {sql_normal("'A page about ' || title")} AS name FROM m),
    h AS (SELECT *, regexp_extract(md, '(?m)^#\s+(\S.*)$', 1) AS top, {sql_heading("name")} AS a, {sql_heading(TOP)} AS b FROM x),
    t AS (SELECT *, list_filter(string_split(a, ' '), lambda x: length(x) > 2) AS ta, list_distinct(list_filter(string_split(b, ' '), lambda x: length(x) > 2)) AS tb FROM h)
    SELECT doc_id, CASE WHEN top <> '' AND a <> '' AND b <> '' AND (a = b OR (length(a) >= 20 AND contains(b, a)) OR (length(b) >= 20 AND contains(a, b)) OR (len(ta) > 0 AND len(tb) > 0 AND len(list_filter(ta, lambda x: list_contains(tb, x))) >= least(3, len(ta), len(tb)))) THEN md
      ELSE '# ' || name || chr(10) || chr(10) || md END AS md FROM t""",
)
md_query(
    "md_cite_first",
    lambda: M.cite_first(c("md"), c("title"), F.concat(F.lit("https://example.com/"), c("doc_id")), F.lit("2026-01-02T03:04:05.000Z"), T.content_hash(c("md")), F.when(c("doc_id") % 2 == 0, "2025-12-31"), None, F.when(c("doc_id") % 3 == 0, "Ann")),
    rf"""WITH {SQL_MD}, b AS (SELECT *, regexp_replace(md, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS body, coalesce(nullif(trim(title), ''), 'Untitled Page') AS name FROM m)
    SELECT doc_id, '> Source: [' || name || '](https://example.com/' || doc_id || ')' || chr(10) || '> Captured: 2026-01-02T03:04:05.000Z' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '> Published: 2025-12-31' || chr(10) ELSE '' END
      || CASE WHEN doc_id % 3 = 0 THEN '> By: Ann' || chr(10) ELSE '' END || '> Hash: ' || sha256({sql_collapse("md")}) || chr(10) || chr(10) || CASE WHEN regexp_matches(body, '(?m)^#\s+') THEN body ELSE '# ' || name || chr(10) || chr(10) || body END AS md FROM b""",
)
md_query(
    "md_toc",
    lambda: M.contents_table(c("md")),
    rf"""WITH {SQL_MD}, h AS (SELECT doc_id, md, regexp_extract_all(md, '(?m)^(#{{1,6}}\s*\S.*)$', 1) AS hs, regexp_extract(md, '(?s)^(.*?(?:^|\n)#{{1,6}}[ \t]*\S[^\n]*\n)', 1) AS first FROM m),
    e AS (SELECT doc_id, md, hs, first, array_to_string(list_transform(hs, lambda x: repeat('  ', greatest(length(regexp_extract(x, '^(#{{1,6}})', 1)) - 2, 0)) || '- [' || regexp_replace(x, '^#{{1,6}}\s*', '') || '](#'
      || regexp_replace(regexp_replace(lower(regexp_replace(x, '^#{{1,6}}\s*', '')), '[^\w\s-]', '', 'g'), '\s+', '-', 'g') || ')' || chr(10)), '') AS t FROM h)
    SELECT doc_id, CASE WHEN len(hs) >= 2 AND first <> '' THEN first || chr(10) || '## Table of Contents' || chr(10) || chr(10) || t || chr(10) || substr(md, length(first) + 1) ELSE md END AS md FROM e""",
)


def md_plain(name: str, run) -> None:
    """A pass whose look-arounds DuckDB has no words for: checked by unit tests."""

    @query(name)
    def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return markdown(spark, sf_dir).select("doc_id", run().alias("md"))


md_plain("md_code_blocks", lambda: M.code_blocks(c("md")))
md_plain("md_inline_code_spacing", lambda: M.inline_code_spacing(c("md")))
md_plain("md_merge_headings", lambda: M.merge_headings(c("md")))
md_plain("md_strip_nav_prelude", lambda: M.strip_navigation(c("md")))
md_plain("md_canonicalize_light", lambda: M.light_canonical(c("md"), c("title")))


@query(
    "lines_explode",
    f"WITH {SQL_LINES} SELECT doc_id, (i - 1)::BIGINT AS pos, line, code AND NOT fence AS in_code FROM l",
)
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.operators.lines import lines_of

    return lines_of(markdown(spark, sf_dir), "doc_id", "md").select("doc_id", "pos", "line", "in_code")


@query(
    "line_lag_dedupe",
    f"WITH {SQL_LINES} SELECT doc_id, (i - 1)::BIGINT AS pos, line FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l) WHERE before IS NULL OR before <> line OR length(line) > 50",
)
def line_lag_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.operators.lines import drop_consecutive, lines_of

    return drop_consecutive(lines_of(markdown(spark, sf_dir), "doc_id", "md"), "doc_id").select("doc_id", "pos", "line")


@query("previous_h1", f"WITH {SQL_LINES} SELECT doc_id, (i - 1)::BIGINT AS pos, last_value(CASE WHEN trim(line) LIKE '# %' THEN substr(trim(line), 3) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS h1 FROM l")
def previous_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.operators.lines import lines_of, with_previous_heading

    return with_previous_heading(lines_of(markdown(spark, sf_dir), "doc_id", "md"), "doc_id").select("doc_id", "pos", "h1")


@query(
    "word_runs",
    f"""WITH {SQL_LINES}, w AS (SELECT *, regexp_matches(line, '^[ \t]*[A-Za-z][A-Za-z0-9&+/-]{{1,23}}[ \t]*$') AS word FROM l), r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM w WHERE word AND NOT code AND NOT fence)
    SELECT doc_id, min(i - 1)::BIGINT AS first, count(*)::BIGINT AS n FROM r GROUP BY doc_id, run HAVING count(*) >= 3""",
)
def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.operators.lines import lines_of, word_runs as runs

    return runs(lines_of(markdown(spark, sf_dir), "doc_id", "md"), "doc_id", 3)


def counts_query(name: str, run, sql: str) -> None:
    @query(name, sql)
    def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return markdown(spark, sf_dir).select("doc_id", run().cast("long").alias("n"))


counts_query("suspicious_token_lines", lambda: M.lone_words(c("md")), f"WITH {SQL_MD} SELECT doc_id, len(list_filter(string_split(md, chr(10)), lambda x: regexp_matches(trim(x), '^[A-Za-z][A-Za-z0-9&+/-]{{1,23}}$')))::BIGINT AS n FROM m")
counts_query("md_code_chars", lambda: M.code_chars(c("md")), rf"WITH {SQL_MD} SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(md, '(?s)```[^\n]*\n(.*?)```', 1), lambda x: length(trim(regexp_replace(x, '\s+', ' ', 'g'))))), 0)::BIGINT AS n FROM m")
counts_query("heading_hierarchy_issues", lambda: M.heading_jumps(c("md")), rf"WITH {SQL_MD}, h AS (SELECT doc_id, list_transform(regexp_extract_all(md, '(?m)^(#{{1,6}})\s', 1), lambda x: length(x)) AS v FROM m) SELECT doc_id, len(list_filter(range(2, len(v) + 1), lambda i: v[i] > v[i - 1] + 1))::BIGINT AS n FROM h")


@query("md_footer_signals", f"WITH {SQL_LINES} SELECT doc_id, count(*)::BIGINT AS n, min(i - 1)::BIGINT AS first FROM l WHERE regexp_matches(lower({sql_normal('line')}), '{M.FOOTER}') OR regexp_matches(lower({sql_normal('line')}), '^©\\s*\\d{{4}}') GROUP BY doc_id")
def md_footer_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.operators.lines import lines_of

    lines = lines_of(markdown(spark, sf_dir), "doc_id", "md").filter(M.is_footer_line(c("line")))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


