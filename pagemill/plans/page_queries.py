"""Queries of the extraction kernel, of threads and of the stateful Markdown passes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import convert, dom, features, metadata, repair, threads
from pagemill.functions import warnings as W
from pagemill.operators import kernel as K
from pagemill.plans.markdown_queries import markdown
from pagemill.plans.registry import query, table
from pagemill.plans.text_queries import sql_collapse, sql_decode, sql_host

c = F.col
AT = "2026-01-02T03:04:05.000Z"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@query("kernel_extract")
def kernel_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page to its Markdown with type, winner and quality: the whole path from capture to report."""
    done = K.assess(K.extract(pages(spark, sf_dir), AT, keep_html=True))
    return done.select("page_id", "url", "title", "profile", "winner", "score", "n_candidates", "markdown", "preserved", "structured", "formatted", "readable", c("complete.status").alias("completeness"), "overall", "grade")


@query("kernel_winners")
def kernel_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.extract(pages(spark, sf_dir), AT).groupBy("profile", "winner").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("score"))


BARE = r"regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)', 1), '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<[^>]*>', '', 'g'), '[\s]+', ' ', 'g')"
ENTITIES = (("&copy;", "©"), ("&middot;", "·"))


def sql_text(x: str) -> str:
    for a, b in ENTITIES:
        x = f"replace({x}, '{a}', '{b}')"
    return f"replace(trim({sql_decode(x)}), '&amp', '&')"


@query("text_content", f"SELECT page_id, {sql_text(BARE)} AS text FROM pages")
def text_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.per_page(pages(spark, sf_dir), "page_id long, text string", lambda i, u, h: [(i, dom.flat(dom.body_of(dom.parse(h)).text()))])


def n_tags(tag: str) -> str:
    return f"len(regexp_extract_all(html, '(<{tag}[ >])', 1))::BIGINT"


@query("select_css", f"SELECT page_id, {n_tags('p')} AS n_p, {n_tags('li')} AS n_li, len(regexp_extract_all(html, '(<li><a )', 1))::BIGINT AS n_nav, 1::BIGINT AS n_ad, {n_tags('meta')} AS n_meta FROM pages")
def select_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ("p", "li", "nav ul li a[href]", "div.ad", "meta[charset]")
    return K.per_page(pages(spark, sf_dir), "page_id long, n_p long, n_li long, n_nav long, n_ad long, n_meta long", lambda i, u, h: [(i, *(len(dom.parse(h).select(r)) for r in rules))])


SQL_LINK = "list_sum(list_transform(regexp_extract_all(html, '(?s)<a [^>]*>(.*?)</a>', 1), lambda x: length(" + sql_text(sql_collapse("x")) + ")))"


@query("link_density", f"SELECT page_id, round({SQL_LINK} / length({sql_text(BARE)}), 6) AS density FROM pages")
def link_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.per_page(pages(spark, sf_dir), "page_id long, density double", lambda i, u, h: [(i, round(features.link_density(dom.body_of(dom.parse(h))), 6))])


ARTICLE = r"regexp_extract(html, '(?s)(<article>.*</article>)', 1)"


@query("remove_unwanted", f"""SELECT page_id, {sql_text(rf"regexp_replace(regexp_replace({ARTICLE}, '<[^>]*>', '', 'g'), '[\s]+', ' ', 'g')")} AS text FROM pages""")
def remove_unwanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.per_page(pages(spark, sf_dir), "page_id long, text string", lambda i, u, h: [(i, dom.flat(dom.body_of(features.clean(dom.parse(h))).text()))])


PARAGRAPHS = rf"list_filter(string_split({ARTICLE}, '<p>')[2:], lambda x: length({sql_text("regexp_replace(x, '<[^>]*>', '', 'g')")}) > 200)"


@query(
    "page_type_classify",
    rf"""WITH u AS (SELECT page_id, lower(url) AS u, {sql_host("url")} AS h, regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, len({PARAGRAPHS}) AS longs FROM pages),
    s AS (SELECT page_id, 2 + (CASE WHEN h LIKE 'blog.%' OR u LIKE '%/blog/%' THEN 2 ELSE 0 END) + (CASE WHEN longs >= 3 THEN 2 ELSE 0 END) AS article,
      (CASE WHEN regexp_matches(u, '/docs|/documentation|/guide|/reference|/api') OR h LIKE 'docs.%' OR h LIKE 'api.%' THEN 3 ELSE 0 END) + (CASE WHEN h LIKE '%.edu' THEN 2 ELSE 0 END) AS documentation FROM u)
    SELECT page_id, CASE WHEN article >= 3 AND article >= documentation THEN 'article' WHEN documentation >= 3 THEN 'documentation' ELSE 'generic' END AS profile,
      round(CASE WHEN greatest(article, documentation) < 3 THEN 0.3 ELSE least(1, greatest(article, documentation) / 8) END, 6) AS confidence FROM s""",
)
def page_type_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(i: int, u: str, h: str) -> list:
        profile, confidence, _ = features.page_type(dom.parse(h), u)
        return [(i, profile, round(confidence, 6))]

    return K.per_page(pages(spark, sf_dir), "page_id long, profile string, confidence double", of)


@query("dom_descendant", f"SELECT page_id, len(regexp_extract_all({ARTICLE}, '(<p[ >])', 1))::BIGINT AS n FROM pages")
def dom_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs below articles as a range join of the node table: equal page, and one interval inside the other."""
    rows = K.nodes(pages(spark, sf_dir)).select("page_id", "pre", "post", "tag")
    outer = rows.filter("tag = 'article'").select("page_id", c("pre").alias("a_pre"), c("post").alias("a_post"))
    inner = rows.filter("tag = 'p'")
    return inner.join(outer, "page_id").filter("pre > a_pre AND post < a_post").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("dom_nodes", f"SELECT page_id, {n_tags('[a-z][a-z0-9]*')} AS n FROM (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<!DOCTYPE[^>]*>|<script>.*?</script>', '<script >', 'g') AS html FROM pages)".replace("'<script >', 'g') AS html", "'', 'g') || '<script >' AS html"))
def dom_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.nodes(pages(spark, sf_dir)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


def page_query(name: str, schema: str, of) -> None:
    @query(name)
    def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return K.per_page(pages(spark, sf_dir), schema, of)


page_query("prepare_html", "page_id long, html string", lambda i, u, h: [(i, features.clean(dom.parse(h), u).html())])
page_query("url_absolutise", "page_id long, links array<string>", lambda i, u, h: [(i, [a.get("href") for a in features.clean(dom.parse(h), u, "[hidden]", False).select("a[href]")])])
page_query("meaningful_headings", "page_id long, headings array<string>", lambda i, u, h: [(i, features.headings(dom.body_of(dom.parse(h))))])
page_query("coverage_features", "page_id long, repeated int, forms int, sections int", lambda i, u, h: [(i, features.repeated_items(r := dom.body_of(dom.parse(h))), features.form_blocks(r), features.sections(r))])
page_query("score_node", "page_id long, tag string, score double", lambda i, u, h: [(i, n.tag, features.node_score(n)) for n in dom.parse(h).select("article,main,section,div,nav,footer")])
page_query("best_node", "page_id long, tag string, score double", lambda i, u, h: [(i, (b := features.best_node(dom.body_of(dom.parse(h))))[0].tag, b[1])])
page_query("prune_node", "page_id long, text string", lambda i, u, h: [(i, dom.flat(features.prune(dom.body_of(dom.parse(h))).text()))])
page_query("readability", "page_id long, text string", lambda i, u, h: [(i, dom.flat(n.text()) if (n := features.readable(dom.body_of(features.clean(dom.parse(h))))) else None)])
page_query("quality_gate_metrics", "page_id long, chars int, paragraphs int, headings int, density double, signal double, structure double, cue double", lambda i, u, h: [(i, g["chars"], g["paragraphs"], g["headings"], round(g["link_density"], 6), round(g["signal"], 6), g["structure"], g["cue"]) for g in [features.gate_features(dom.body_of(dom.parse(h)))]])
page_query("fallback_markdown", "page_id long, md string", lambda i, u, h: [(i, convert.simple_markdown(dom.body_of(features.clean(dom.parse(h)))))])
page_query("html_to_markdown", "page_id long, preset string, md string", lambda i, u, h: [(i, p, convert.to_markdown(dom.body_of(root), p)) for root in [features.clean(dom.parse(h), u)] for p in convert.PRESETS])


@query("generic_candidates")
def generic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.candidate_rows(pages(spark, sf_dir)).drop("html")


@query("chunk_html", "SELECT page_id, ceil(length(html) / 1000)::BIGINT AS n, length(html)::BIGINT AS chars FROM pages")
def chunk_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in chunks of bounded length, put together again by page."""
    size = 1000
    pieces = pages(spark, sf_dir).select("page_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.length("html") - 1) / size)), lambda i: F.substr(c("html"), (i * size + 1).cast("int"), F.lit(size)))).alias("chunk"))
    return pieces.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("chunk")).cast("long").alias("chars"))


#: Pages with the metadata that the page table lacks, and what is read from them.
META_PAGES = [
    (1, '<meta property="article:published_time" content="2025-11-05T10:00:00Z"><meta name="author" content="Ann Lee">'),
    (2, '<time datetime="2025-01-02">2 Jan 2025</time><p class="byline">By Bob Ray</p>'),
    (3, '<script type="application/ld+json">{"@type":"Article","datePublished":"2024-03-04","dateModified":"2024-05-06","author":[{"name":"Cy Dee"}]}</script>'),
    (4, "<p>No dates here</p>"),
]


_META = {1: ("2025-11-05T10:00:00.000Z", None, "Ann Lee"), 2: ("2025-01-02T00:00:00.000Z", None, "Bob Ray"), 3: ("2024-03-04T00:00:00.000Z", "2024-05-06T00:00:00.000Z", "Cy Dee"), 0: (None, None, None)}
_META_SQL = ", ".join("CASE page_id % 4 " + " ".join(f"WHEN {i} THEN {repr(v[at]) if v[at] else 'NULL'}" for i, v in _META.items()) + f" END AS {name}" for at, name in enumerate(("published", "updated", "byline")))


@query("metadata_extract", f"SELECT page_id, {_META_SQL} FROM pages")
def metadata_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata of every page, whose head is given the markup whose turn it is before its own whole content."""
    turn = F.get(F.array(*(F.lit(h) for _, h in [META_PAGES[3], *META_PAGES[:3]])), F.pmod(c("page_id"), F.lit(4)).cast("int"))
    rows = pages(spark, sf_dir).select("page_id", "url", F.concat(turn, F.coalesce("html", F.lit(""))).alias("html"))

    def of(i: int, u: str, h: str) -> list:
        m = metadata.metadata(dom.parse(h), 2026)
        return [(i, m["published"], m["updated"], m["byline"])]

    return K.per_page(rows, "page_id long, published string, updated string, byline string", of)


TIMES = ["2025-11-05", "5 Nov 2025 10:30", "Updated 10:30 IST", "Nov 5, 2014", "soon", "1736899200"]


POINTS = [36, 76, 52, 14, 0, 28]


@query("ts_score", "SELECT event_id, CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(POINTS)) + " END::BIGINT AS score FROM events")
def ts_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of a time for every event, written in the way whose turn it is."""
    turn = F.get(F.array(*map(F.lit, TIMES)), F.pmod(c("event_id"), F.lit(len(TIMES))).cast("int"))
    score = K.text_pass(lambda t: str(metadata.score_time(t, metadata.parse_time(t), 2026)))
    return table(spark, sf_dir, "events").select("event_id", score(turn).cast("long").alias("score"))


@query("ts_score_pages")
def ts_score_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timestamps that the text of every page holds, with their scores."""
    of = lambda i, u, h: [(i, t, metadata.score_time(t, metadata.parse_time(t), 2026)) for t in metadata.fragments(dom.flat(dom.parse(h).text()))]
    return K.per_page(pages(spark, sf_dir), "page_id long, text string, score long", of)


THREAD_SQL = "SELECT conv_id, count(*) - 1 AS n_comments, least(8, max(turn) - min(turn) - 1) AS max_depth FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id"


def thread_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as thread listings: the first turn is the post, every later one a comment on the post."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    post = F.struct(F.lit("t3").alias("kind"), F.struct(F.get("turns", F.lit(0))["text"].alias("title"), F.lit("").alias("selftext"), F.get("turns", F.lit(0))["role"].alias("author")).alias("data"))
    rest = F.transform(F.slice("turns", F.lit(2), F.greatest(F.size("turns") - 1, F.lit(0))), lambda t: F.struct(F.lit("t1").alias("kind"), F.struct(F.concat(F.lit("c"), t["turn"].cast("string")).alias("id"), t["role"].alias("author"), t["text"].alias("body"), t["turn"].alias("score"), F.lit("").alias("replies")).alias("data")))
    listing = lambda kids: F.to_json(F.struct(F.struct(kids.alias("children")).alias("data")))
    return grouped.select("conv_id", F.concat(F.lit("["), listing(F.array(post)), F.lit(","), listing(rest), F.lit("]")).alias("json"))


ROW = "array<struct<comment_id: string, parent_id: string, depth: int, author: string, score: bigint, body: string, is_bot_like: boolean>>"


@query("json_thread_parse", "SELECT conv_id, 'c' || turn AS comment_id, role AS author, turn AS score, 0 AS depth FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn BETWEEN 2 AND 81 AND trim(text) <> ''")
def json_thread_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf(ROW)
    def parse(payloads):  # noqa: ANN001, ANN202
        import pandas as pd

        names = ("comment_id", "parent_id", "depth", "author", "score", "body", "is_bot_like")
        return pd.Series([[{k: r[k] for k in names} for r in threads.flatten(p)[1]] for p in payloads])

    flat = thread_json(spark, sf_dir).select("conv_id", F.explode(parse("json")).alias("r"))
    return flat.select("conv_id", "r.comment_id", "r.author", "r.score", "r.depth")


@query("thread_render")
def thread_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    def render(payload: str) -> str:
        post, rows, _ = threads.flatten(payload)
        return threads.render(post, rows) if post else ""

    return thread_json(spark, sf_dir).select("conv_id", K.text_pass(render)("json").alias("html"))


def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as listings: flat where the id is odd, and else every turn a reply to the one before it."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    rest = F.slice("turns", F.lit(2), F.greatest(F.size("turns") - 1, F.lit(0)))

    def comment(t: Column, replies: Column) -> Column:
        own = F.to_json(F.struct(F.concat(F.lit("c"), t["turn"].cast("string")).alias("id"), t["role"].alias("author"), t["text"].alias("body")))
        return F.concat(F.lit('{"kind":"t1","data":'), F.regexp_replace(own, r"\}\z", ""), F.lit(',"replies":'), replies, F.lit("}}"))

    listing = lambda kids: F.concat(F.lit('{"data":{"children":['), kids, F.lit("]}}"))
    chain = F.aggregate(F.reverse(rest), F.lit('""'), lambda below, t: listing(comment(t, below)))
    flat = listing(F.array_join(F.transform(rest, lambda t: comment(t, F.lit('""'))), ","))
    post = F.lit('[{"data":{"children":[{"kind":"t3","data":{"title":"x","selftext":""}}]}},')
    replies = F.when(F.size(rest) == 0, flat).when(c("conv_id") % 2 == 1, flat).otherwise(chain)
    return grouped.select("conv_id", F.concat(post, replies, F.lit("]")).alias("json"))


@query(
    "thread_diagnostics",
    f"""WITH t AS (SELECT conv_id, trim(text) <> '' AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
    n AS (SELECT conv_id, count(*) FILTER (rn > 1 AND said) AS flat, coalesce(min(rn) FILTER (rn > 1 AND NOT said), max(rn) + 1) - 2 AS chain FROM t GROUP BY conv_id)
    SELECT conv_id, CASE WHEN conv_id % 2 = 1 THEN least({threads.MOST}, flat) ELSE least({threads.MOST}, {threads.DEEPEST} + 1, chain) END AS n_comments, CASE WHEN conv_id % 2 = 1 THEN 0 ELSE greatest(0, least({threads.DEEPEST} + 1, chain) - 1) END AS max_depth FROM n""",
)
def thread_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(payload: str) -> str:
        _, rows, omitted = threads.flatten(payload)
        return json.dumps({"n": len(rows), "depth": max((r["depth"] for r in rows), default=0), "omitted": omitted})

    made = nested_json(spark, sf_dir).withColumn("d", F.from_json(K.text_pass(measure)("json"), "n long, depth int, omitted int"))
    return made.select("conv_id", c("d.n").alias("n_comments"), c("d.depth").alias("max_depth"))


def md_pass(name: str, function) -> None:
    @query(name)
    def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return markdown(spark, sf_dir).select("doc_id", K.text_pass(function)("md").alias("md"))


for _name, _function in (
    ("md_normalize_headings", repair.normalize_headings),
    ("md_bulletize", repair.bulletize),
    ("md_fence_escaped_html", repair.fence_escaped_html),
    ("md_repair_fences", repair.repair_fences),
    ("md_strip_ui_code", repair.strip_ui_code),
    ("md_technical_blocks", repair.technical_blocks),
    ("md_tighten", repair.tighten),
):
    md_pass(_name, _function)


@query("md_skip_link_prelude")
def md_skip_link_prelude(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_link = F.concat(F.lit("[Skip to main content](#main)\n\n---\n"), c("md"))
    return markdown(spark, sf_dir).select("doc_id", K.pass_with_title(repair.skip_prelude)(with_link, "title").alias("md"))


@query("md_canonicalize")
def md_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(spark, sf_dir).select("doc_id", K.canonicalise(c("md"), c("title")).alias("md"))


@query("md_post_process")
def md_post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(spark, sf_dir).select("doc_id", K.post_process(c("md"), contents=True).alias("md"))


# Markup that the given pages lack, by page id, and whether only a decoded address shows its protocol.
ODD_MARKUP = (
    ("", False),
    ('<a href="jav&#x09;ascript:run()">x</a>', True),
    ("<p>&lt;script&gt;</p>", False),
    ("<!-- alert(1) -->", False),
    ('<input name="submit">', False),
    ('<i style="width:0;height:0"></i>', False),
    ("<table><tr><td>1</table>", False),
    ("<h2>open<li>item", False),
    ('<b a="1"c="2">q</b>', False),
    ("</b>", False),
    ('<a href="&#106;&#97;vascript:run()">x</a>', True),
    ("<a href='java\nscript:run()'>x</a>", True),
)
ODD = "SELECT page_id, html || CASE page_id % {} {} END AS html, page_id % {} AS turn FROM pages".format(len(ODD_MARKUP), " ".join("WHEN {} THEN '{}'".format(i, m.replace("'", "''")) for i, (m, _) in enumerate(ODD_MARKUP)), len(ODD_MARKUP))
# The open tags, the last one first, tag by tag.
SHAPE = rf"""WITH RECURSIVE t AS (SELECT *, regexp_extract_all(html, '</?[a-zA-Z][a-zA-Z0-9:-]*(?:\s[^>]*)?>') AS tags FROM ({ODD})),
tag AS (SELECT page_id, i, lower(regexp_extract(tags[i], '^</?([a-zA-Z][a-zA-Z0-9:-]*)', 1)) AS name, tags[i][2] = '/' AS closing, regexp_matches(tags[i], '/>\s*$') AS alone FROM (SELECT page_id, tags, unnest(range(1, len(tags) + 1)) AS i FROM t)),
fold AS (SELECT page_id, 0::BIGINT AS i, []::VARCHAR[] AS open, 0::BIGINT AS bad FROM t UNION ALL
SELECT fold.page_id, tag.i, CASE WHEN closing THEN CASE WHEN list_contains(open, name) THEN list_concat(open[:list_position(open, name) - 1], open[list_position(open, name) + 1:]) ELSE open END
WHEN alone OR name IN ({", ".join(f"'{v}'" for v in W.VOID)}) THEN open ELSE list_prepend(name, open) END, bad + (closing AND coalesce(open[1], '') <> name)::BIGINT FROM fold JOIN tag ON tag.page_id = fold.page_id AND tag.i = fold.i + 1)
SELECT t.*, len(open)::BIGINT AS unclosed, bad AS mismatched, len(list_filter(open, lambda x: regexp_matches(x, '^h[1-6]$')))::BIGINT AS unclosed_headings,
(SELECT count(*) FROM tag WHERE tag.page_id = t.page_id AND NOT closing AND NOT alone AND name IN ({", ".join(f"'{v}'" for v in W.VOID)})) AS bare_void,
len(list_filter(tags, lambda x: regexp_matches(x, '(?i)^</?(?:{"|".join(W.TABLE)})[\s>]'))) > 0 AS table_seen, len(list_filter(tags, lambda x: regexp_matches(x, '(?i)^</?(?:{"|".join(W.LIST)})[\s>]'))) > 0 AS list_seen
FROM t JOIN fold ON fold.page_id = t.page_id AND fold.i = len(tags)"""


def odd_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = c("page_id") % len(ODD_MARKUP)
    added = F.get(F.array(*(F.lit(m) for m, _ in ODD_MARKUP)), turn.cast("int"))
    return pages(spark, sf_dir).select("page_id", F.concat("html", added).alias("html"))


def _warnings_sql() -> str:
    hidden = ", ".join(str(i) for i, (_, shown) in enumerate(ODD_MARKUP) if shown)
    found = lambda p: "regexp_matches(html, '{}')".format(p.replace("'", "''"))
    cases = [(n, " OR ".join("({})".format(" AND ".join(map(found, way))) for way in ways) + (f" OR turn IN ({hidden})" if n == W.PROTOCOL else "")) for n, ways in W.RULES]
    broken = "(unclosed > 0 OR mismatched > 0)"
    tests = ("unclosed > 0", "unclosed_headings > 0", "mismatched > 0", "bare_void > 0", f"table_seen AND {broken}", f"list_seen AND {broken}")
    cases += [(name, test) for (name, _), test in zip(W.STRUCTURE, tests, strict=True)]
    listed = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in cases)
    return f"SELECT page_id, list_filter([{listed}], lambda x: x IS NOT NULL) AS w FROM ({SHAPE})"


@query("input_warnings", f"WITH w AS ({_warnings_sql()}) SELECT page_id, len(w)::BIGINT AS n, array_to_string(w, '|') AS warnings, len(list_filter(w, lambda x: regexp_matches(x, '{W.RISK}'))) > 0 AS risky FROM w")
def input_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = odd_pages(spark, sf_dir).select("page_id", W.input_warnings(c("html")).alias("w"))
    return w.select("page_id", F.size("w").cast("long").alias("n"), F.array_join("w", "|").alias("warnings"), W.has_security_signal(c("w")).alias("risky"))


@query("security_signal", f"WITH w AS ({_warnings_sql()}) SELECT page_id, len(list_filter(w, lambda x: regexp_matches(x, '{W.RISK}'))) > 0 AS risky FROM w")
def security_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_pages(spark, sf_dir).select("page_id", W.has_security_signal(W.input_warnings(c("html"))).alias("risky"))


@query("tag_structure", f"SELECT page_id, bare_void, unclosed, mismatched, unclosed_headings, table_seen, list_seen FROM ({SHAPE})")
def tag_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = odd_pages(spark, sf_dir).select("page_id", W.tag_structure(c("html")).alias("s"))
    numbers = [c(f"s.{n}").cast("long").alias(n) for n in ("bare_void", "unclosed", "mismatched", "unclosed_headings")]
    return s.select("page_id", *numbers, "s.table_seen", "s.list_seen")


@query("ui_noise_signal", r"SELECT page_id, regexp_matches(html || CASE WHEN page_id % 3 = 0 THEN ' Accept all the cookies' ELSE '' END, '(?i)accept all .*cookie|cookie settings|tracking cookies?|popup ad|manage preferences|allow all cookies|limit my search|advanced search: by author|search faq') AS noisy FROM pages")
def ui_noise_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("html", F.when(c("page_id") % 3 == 0, " Accept all the cookies").otherwise(""))
    return pages(spark, sf_dir).select("page_id", text.rlike("(?i)accept all .*cookie|cookie settings|tracking cookies?|popup ad|manage preferences|allow all cookies|limit my search|advanced search: by author|search faq").alias("noisy"))


@query(
    "timestamp_like",
    "SELECT event_id, event_id % 6 IN (0, 1, 2) AS looks FROM events",
)
def timestamp_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts made of the events' times look like times: whole, day and clock alone, and three that do not."""
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm")
    made = F.array(F.concat_ws(" ", day, clock), day, clock, F.date_format("ts", "'event' yyyy"), F.lit("1:2"), F.concat(day, F.repeat(F.lit(" later"), 20)))
    text = F.get(made, (c("event_id") % 6).cast("int"))
    looks = F.length(text).between(4, 80) & (text.rlike(r"\d{4}-\d{2}-\d{2}") | text.rlike(r"\b\d{1,2}:\d{2}\b"))
    return table(spark, sf_dir, "events").select("event_id", looks.alias("looks"))


@query("date_formats", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%B %-d, %Y') AS long_form, dayofyear(ts)::BIGINT AS day_of_year, date_diff('day', ts::DATE, DATE '2024-02-01')::BIGINT AS days_ago FROM events")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = c("ts").cast("date")
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("ts", "MMMM d, yyyy").alias("long_form"), F.dayofyear("ts").cast("long").alias("day_of_year"), F.datediff(F.lit("2024-02-01").cast("date"), day).cast("long").alias("days_ago"))


@query("tz_convert", "SELECT event_id, ts + INTERVAL 1 HOUR AS berlin, ts - INTERVAL 5 HOURS AS new_york FROM events")
def tz_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = lambda zone: F.convert_timezone(F.lit("UTC"), F.lit(zone), c("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", to("Europe/Berlin").alias("berlin"), to("America/New_York").alias("new_york"))


@query("command_token", "SELECT doc_id, split_part(text, ' ', 2) IN (" + ", ".join(f"'{x}'" for x in sorted(repair.COMMANDS)) + ") AS is_command FROM documents")
def command_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.split_part(c("text"), F.lit(" "), F.lit(2)).isin(*repair.COMMANDS).alias("is_command"))
