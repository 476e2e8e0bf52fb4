"""Queries of the operators beside the main path. Those on trees run over authored markup, whose results SQL can state,
or over all pages."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import convert, dom, features, metadata, prompts, repair
from pagemill.functions import markdown as M
from pagemill.functions import page_ops as P
from pagemill.functions import scoring as S
from pagemill.functions import text as T
from pagemill.operators import kernel as K
from pagemill.operators import ranking as R
from pagemill.plans.markdown_queries import SQL_LINES, SQL_MD, markdown
from pagemill.plans.metrics_queries import SQL_RUNS, runs
from pagemill.plans.page_queries import ARTICLE, sql_text, thread_json
from pagemill.plans.registry import query, table
from pagemill.plans.scoring_queries import SQL_F, SQL_HTML, SQL_PROFILE, features as feature_rows, n_of, pairs
from pagemill.plans.text_queries import sql_collapse, sql_normal

c = F.col
LONG = "Words§ of a paragraph that goes on for long enough to count as content here. "


def _literal(value: object) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


#: The authored cases' queries by name, each with the query that runs its operator over the whole table.
WHOLE: dict[str, str] = {}


def golden(name: str, cases: list[tuple[str, str, object]], of, whole=None, whole_kind: str | None = None) -> None:
    """A query over every page of the table, each with the authored markup whose turn it is, in which `§` stands for the
    page's id: one text or number per page, by of(root, url). Cases are (url, markup, expected). And, as name_pages, a query
    over the markup of the pages themselves, by whole(root, url) where the cases' selectors fit only them."""
    kind = "string" if any(isinstance(x[2], str) for x in cases) else "boolean" if isinstance(cases[0][2], bool) else "double" if isinstance(cases[0][2], float) else "long"
    cast = {"string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "long": "BIGINT"}[kind]
    said = " ".join(f"WHEN {i} THEN " + (f"replace({_literal(x[2])}, '§', page_id::VARCHAR)" if isinstance(x[2], str) else _literal(x[2])) for i, x in enumerate(cases))

    @query(name, f"SELECT page_id, CAST(CASE page_id % {len(cases)} {said} END AS {cast}) AS value FROM pages")
    def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
        turn = lambda at: F.get(F.array(*(F.lit(x[at]) for x in cases)), F.pmod(c("page_id"), F.lit(len(cases))).cast("int"))
        given = table(spark, sf_dir, "pages").select("page_id", turn(0).alias("url"), F.replace(turn(1), F.lit("§"), c("page_id").cast("string")).alias("html"))
        return K.per_page(given, f"page_id long, value {kind}", lambda i, u, h: [(i, of(dom.parse(h), u))])

    WHOLE[name] = f"{name}_pages"

    @query(WHOLE[name])
    def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
        return K.per_page(table(spark, sf_dir, "pages"), f"page_id long, value {whole_kind or kind}", lambda i, u, h: [(i, (whole or of)(dom.parse(h), u))])


def text(root: dom.Node) -> str:
    return dom.flat(root.text())


U = "https://example.com/a/b"
golden("parse_dom", [(U, "<p>a§<p>b<ul><li>c<li>d</ul>", "<p>a§</p><p>b</p><ul><li>c</li><li>d</li></ul>"), (U, "<b>x§</i></b>&lt;", "<b>x§</b>&lt;")], lambda r, u: r.html())
golden("ensure_base", [(U, "<html><head></head><body>x§</body></html>", '<html><head><base href="https://example.com/a/b"></head><body>x§</body></html>'), (U, '<head><base href="/z"></head>', '<head><base href="/z"></head>')], lambda r, u: P.ensure_base(r, u).html())
golden("mark_hidden", [(U, '<p style="display:none">a</p><p hidden>b</p><p>c</p>', 2)], lambda r, u: len(P.mark_hidden(r).select("[data-hidden=true]")))
golden("dom_flatten_shadow", [(U, '<x-y><template shadowrootmode="open"><h1>T</h1><slot></slot></template><p>light§</p></x-y>', "Tlight§")], lambda r, u: text(P.flatten_shadow(r)))
golden("metadata_html_capture", [(U, '<head><meta name="author" content="A§"><style>x</style></head><time>t</time>', '<meta name="author" content="A§"><time>t</time>')], lambda r, u: P.metadata_markup(r))
golden("sponsored_clusters", [(U, '<body><div><a rel="sponsored">x</a><a rel="sponsored">y</a></div><article>keep <div><a rel="sponsored">z</a><a rel="sponsored">w§</a></div></article></body>', "keep zw§")], lambda r, u: text(P.remove_sponsored(r)))
golden("keyword_noise_blocks", [(U, '<div class="cookie">We use cookie tracking, accept all to continue <button>ok</button></div><p>' + LONG + "</p>", LONG.strip())], lambda r, u: text(P.remove_keyword_blocks(r)))
golden("ad_labels", [(U, "<p>Advertisement</p><p>Sponsored</p><p>Advertisement prices rose §</p>", "Advertisement prices rose §")], lambda r, u: text(P.remove_ad_labels(r)))
golden("image_banners", [(U, "<div>" + "<a><img></a>" * 3 + "</div><p>x</p>", 0), (U, "<article>" + "<a><img></a>" * 3 + "</article>", 3)], lambda r, u: len(P.remove_banners(r).select("img")))
golden("hidden_cleanup", [(U, '<p hidden>a</p><pre><span hidden>b</span></pre><p style="visibility: hidden">c</p>d§', "bd§")], lambda r, u: text(P.remove_hidden(r)))
golden("visual_noise", [(U, '<svg><path></path></svg><img src="data:image/png;base64,x"><img src="a.png"><pre><svg></svg></pre>', 2)], lambda r, u: len(P.remove_visual(r).select("img,svg")))
golden("empty_cleanup", [(U, "<div><p> </p><span></span></div><p>x§</p>", "<p>x§</p>")], lambda r, u: P.remove_empty(r).html())
golden("inline_spacing", [(U, "<h2><span>into</span><span>precise</span></h2>", "into precise"), (U, "<h2>" + "".join(f"<i>{x}</i>" for x in "lettersaway") + "</h2>", "lettersaway")], lambda r, u: text(P.inline_spacing(r)))
golden("raw_example_isolate", [(U, "<div><p>Raw input</p><div><b>x§</b></div></div>", "<div><p>Raw input</p><pre>&lt;div&gt;&lt;b&gt;x§&lt;/b&gt;&lt;/div&gt;</pre></div>")], lambda r, u: P.isolate_examples(r).html())
golden("coverage_root", [(U, f"<body><div id=content>{LONG * 3}</div><main>{LONG * 4}</main></body>", "main"), (U, f"<body><p>{LONG}</p></body>", "body")], lambda r, u: P.coverage_root(r).tag)
golden("coverage_low", [(U, f"<body><p>{LONG * 5}</p><div class=x>{LONG}</div></body>", True), (U, f"<body><div class=x>{LONG * 5}</div></body>", False)], lambda r, u: P.coverage_low(r.first(".x"), r), lambda r, u: sum(P.coverage_low(n, r) for n in r.select("div,section,article,main")), "long")
golden("usable_adapter_content", [(U, f"<div>{LONG * 2}</div>", True), (U, "<div><p>too short</p></div>", False)], lambda r, u: P.usable(r.first("div")), lambda r, u: sum(P.usable(n) for n in r.select("div,section,article,main")), "long")
golden("expand_candidate", [(U, f"<body><section><div><p>{LONG}</p></div><p>more</p></section></body>", "section")], lambda r, u: P.expand(r.first("div p")).tag, lambda r, u: ",".join(P.expand(n).tag for n in r.select("p")))
golden("semantic_content", [(U, f"<div class=content>{LONG * 8}</div>", "div"), (U, f"<article>{LONG}</article>", None)], lambda r, u: n.tag if (n := P.semantic(r)) is not None else None)
golden("feed_candidates", [(U, "<ul class=feed>" + f'<li><a href="#">{LONG}</a></li>' * 9 + "</ul>", 1), (U, "<ul><li>x</li></ul>", 0)], lambda r, u: len(P.feeds(r)))
golden("landing_candidate", [(U, '<body><h1>Me §</h1><span class="chip">py</span><span class="chip">sql</span><label for="e">Mail</label><input id="e"><footer><a href="https://github.com/x">gh</a></footer></body>', "# Me §\n\nMail\n\nMail\n\n[gh](https://github.com/x)\n\n- py\n- sql\n\n## Links\n\n[gh](https://github.com/x)")], lambda r, u: convert.to_markdown(P.landing(r)))
golden("label_for", [(U, '<label for="a">Name§</label><input id="a"><label for="z">No</label>', "Name§=input")], lambda r, u: ",".join(f"{a}={b}" for a, b in P.label_of(r)))
golden("site_adapters", [(U, f'<div class="thread">{LONG * 2}</div>', "thread:used"), (U, "<p>x</p>", "")], lambda r, u: ",".join(f"{n}:{e}" for n, _, e in P.adapted(r, u)))
golden("thread_dom_body", [(U, f'<div id="thread">{LONG * 2}</div>', (LONG * 2).strip()), (U, '<div id="thread">x</div>', None)], lambda r, u: text(n) if (n := P.thread_body(r)) is not None else None)
golden("thread_shell", [("https://www.reddit.com/r/x/comments/1/y", "<p>loading</p>", True), (U, "<p>loading</p>", False)], lambda r, u: P.is_shell(r, u))
golden("thread_noise_filter", [(U, "<p>12 upvotes</p>", ""), (U, "<pre># Title §\nA real line here\nA real line here\n5 hours ago\nReply\n</pre>", "# Title §\n\nA real line here")], lambda r, u: P.thread_lines(r.text()))
golden("thread_quality", [(U, f"<p>{LONG * 6}</p>", 80)], lambda r, u: P.thread_quality(text(r), text(r) + "x" * 20), lambda r, u: P.thread_quality(P.thread_lines(r.text()), r.text()))
golden("boilerplate_rules", [(U, '<nav>N</nav><div class="ad">A</div><div class="comments">C</div><header><h1>H</h1></header>x§', "N<h1>H</h1>x§"), (U, '<div class="modal"><h2>API reference §</h2></div>', '<div class="modal"><h2>API reference §</h2></div>')], lambda r, u: P.apply_rules(r).html())
golden("preserve_element", [(U, '<div data-spec="1"></div>', True), (U, "<div>x</div>", False)], lambda r, u: P.preserved(r.first("div")), lambda r, u: sum(P.preserved(n) for n in r.walk()), "long")
golden("sanitize_candidate", [(U, f"<nav>n</nav><p>{LONG}</p><svg></svg><div></div>", f"<p>{LONG}</p>")], lambda r, u: P.remove_empty(P.remove_visual(features.clean(r))).html())
golden("readability_quality", [(U, "<p>subscribe to our newsletter, accept the cookie</p>", 20)], lambda r, u: P.readability_check(r.html(), len(r.html()))[0], lambda r, u: P.readability_check(features.clean(r.copy()).html(), len(r.html()))[0])
golden("degrade_pipeline", [(U, f"<body><article><h1>T</h1><p>{LONG}</p></article></body>", "semantic,heuristic"), (U, f"<body><div class=thread><p>{LONG * 2}</p></div></body>", "thread")], lambda r, u: ",".join(s for s, _, _ in P.stages(r)))
golden("stage0_thread", [(U, f'<div class="thread">{LONG * 2}</div>', True), (U, f"<p>{LONG}</p>", False)], lambda r, u: any(s == "thread" for s, _, _ in P.stages(r)))
golden("stage1_semantic", [(U, f"<main>{LONG * 2}</main>", "main"), (U, f"<p>{LONG}</p>", None)], lambda r, u: next((n.tag for s, n, _ in P.stages(r) if s == "semantic"), None))
golden("stage2_readability", [(U, f"<body><div><p>{LONG * 4}</p><p>{LONG * 4}</p></div></body>", True), (U, "<p>x</p>", False)], lambda r, u: any(s == "readability" for s, _, _ in P.stages(r)))
golden("stage3_heuristic", [(U, f"<body><nav><a>{LONG}</a></nav><article><p>{LONG * 3}</p></article></body>", (LONG * 3).strip())], lambda r, u: next(text(n) for s, n, _ in P.stages(r) if s == "heuristic"), lambda r, u: next((text(n) for s, n, _ in P.stages(r) if s == "heuristic"), None))
golden("jsonld_extract", [(U, '<script type="application/ld+json">[{"@graph":[{"author":{"name":"Ann§"},"datePublished":"2024-01-02"}]}]</script>', "2024-01-02|Ann§"), (U, '<script type="application/ld+json">{broken</script>', "|")], lambda r, u: "|".join(",".join(x) for x in (metadata._linked_data(r)[0], metadata._linked_data(r)[2])))
golden("ts_fragments", [(U, "<p>posted 10:30 IST Nov 5, 2025 by x</p>", "10:30 IST Nov 5, 2025|10:30 IST"), (U, "<p>none</p>", "")], lambda r, u: "|".join(metadata.fragments(text(r))))
golden("ts_parse", [(U, "2025-11-05T10:00:00+02:00", "2025-11-05T08:00:00.000Z"), (U, "5 Nov 2025", "2025-11-05T00:00:00.000Z"), (U, "soon", None)], lambda r, u: metadata.iso(m) if (m := metadata.parse_time(text(r))) else None, lambda r, u: "|".join(metadata.iso(m) if (m := metadata.parse_time(x)) else "" for x in metadata.fragments(text(r))))
golden("byline_pick", [(U, "Staff|x|By Ann Lee", "Ann Lee"), (U, "News", None)], lambda r, u: metadata.pick_byline(text(r).split("|")), lambda r, u: metadata.pick_byline([text(n) for n in r.select("[rel=author],.byline,.author")]))
golden("unique_timestamps", [(U, "2025-01-02|2025-01-02| 2024-01-02 ", "2025-01-02")], lambda r, u: metadata.pick_time(r.text().split("|"), 2026)[0], lambda r, u: t[0] if (t := metadata.pick_time(metadata.fragments(text(r)), 2026)) else None)
golden("json_brace_delta", [(U, '{"a": "}", [', 2), (U, "]}", -2)], lambda r, u: repair.brace_balance(r.text()))
golden("recovery_strategies", [(U, "1§", "1§|number|"), (U, "x§", "X§|upper|number: ValueError")], lambda r, u: "|".join([(o := P.recover([("number", lambda: str(int(r.text()))), ("upper", lambda: r.text().upper())]))[0], o[1], ";".join(o[2])]))


# The two 32-bit states, unit by unit of an ASCII address, and how they are mixed.
CYRB53 = """WITH RECURSIVE t AS (SELECT page_id, url, length(url) AS n FROM pages),
f AS (SELECT page_id, 0::BIGINT AS i, xor(3735928559::BIGINT, n) AS a, xor(1103547991::BIGINT, n) AS b FROM t
  UNION ALL SELECT t.page_id, i + 1, (xor(a, unicode(substr(url, i + 1, 1))::BIGINT)::HUGEINT * 2654435761 % 4294967296)::BIGINT, (xor(b, unicode(substr(url, i + 1, 1))::BIGINT)::HUGEINT * 1597334677 % 4294967296)::BIGINT FROM f JOIN t USING (page_id) WHERE i < n),
m AS (SELECT page_id, b, xor((xor(a, a >> 16)::HUGEINT * 2246822507 % 4294967296)::BIGINT, (xor(b, b >> 13)::HUGEINT * 3266489909 % 4294967296)::BIGINT) AS a FROM f JOIN t USING (page_id) WHERE i = n)
SELECT page_id, 4294967296 * (xor((xor(b, b >> 16)::HUGEINT * 2246822507 % 4294967296)::BIGINT, (xor(a, a >> 13)::HUGEINT * 3266489909 % 4294967296)::BIGINT) & 2097151) + a AS value FROM m"""


@query("hash_cyrb53", CYRB53)
def hash_cyrb53(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "pages").select("page_id", K.text_pass(P.cyrb53)("url").alias("h"))
    return hashed.select("page_id", F.conv("h", 36, 10).cast("long").alias("value"))


def pages_pass(name: str, schema: str, of) -> None:
    """A query over every page of the table."""

    @query(name)
    def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return K.per_page(table(spark, sf_dir, "pages"), schema, of)


@query("prepared_text", f"""SELECT page_id, {sql_text(rf"regexp_replace(regexp_replace({ARTICLE}, '<[^>]*>', '', 'g'), '[\s]+', ' ', 'g')")} AS text FROM pages""")
def prepared_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning chain over every page; these pages hold nothing for its noise rules to take."""
    return K.per_page(table(spark, sf_dir, "pages"), "page_id long, text string", lambda i, u, h: [(i, text(dom.body_of(P.prepare(dom.parse(h), u))))])


LISTED = """SELECT page_id, html, repeat('<article><a href="#">' || repeat('word ', 9) || '</a></article>', (page_id % 45)::INT) || repeat('<form><input></form>', (page_id % 4)::INT) || '<li>no link here, however long the item of the list may be</li><li><a>short</a></li>' AS added FROM pages"""


@query("repeated_items", f"SELECT page_id, 2 * (page_id % 4) AS forms, least(40, page_id % 45) AS repeated, len(regexp_extract_all(html, '(?i)<(?:form|input|select|textarea)[ >]'))::BIGINT AS own_forms FROM ({LISTED})")
def repeated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and forms of an authored list, which grows with the page's id, and the forms of the page itself."""
    item, form = '<article><a href="#">' + "word " * 9 + "</a></article>", "<form><input></form>"
    times = lambda text, most: F.repeat(F.lit(text), (c("page_id") % most).cast("int"))
    added = F.concat(times(item, 45), times(form, 4), F.lit("<li>no link here, however long the item of the list may be</li><li><a>short</a></li>"))
    given = table(spark, sf_dir, "pages").select("page_id", "url", "html", added.alias("added"))

    def of(page_id: int, url: str, html: str, added: str) -> list:
        listed = dom.parse(added)
        return [(page_id, features.form_blocks(listed), features.repeated_items(listed), len(dom.parse(html).select("form,input,select,textarea")))]

    return K.per_page(given, "page_id long, forms long, repeated long, own_forms long", of, ("added",))


pages_pass("substantial_sections", "page_id long, n int", lambda i, u, h: [(i, features.sections(dom.body_of(dom.parse(h))))])
pages_pass("stage_gates", "page_id long, stage string, chars int, structure double", lambda i, u, h: [(i, s, g["chars"], g["structure"]) for s, _, g in P.stages(features.clean(dom.parse(h)))])


@query("analyze_candidate", f"SELECT count(*) AS pages, {len(K.FEATURES)}::BIGINT AS n_features FROM pages")
def analyze_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.candidate_rows(table(spark, sf_dir, "pages"))
    return rows.agg(F.count_distinct("page_id").alias("pages")).withColumn("n_features", F.lit(len([x for x in rows.columns if x in K.FEATURES])).cast("long"))


@query("fallback_select")
def fallback_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of every page as rows, ranked by window, best one kept: the relational form of the kernel's choice."""
    rows = K.candidate_rows(table(spark, sf_dir, "pages"))
    a = F.struct(*K.FEATURES)
    feed = S.feed_like(c("repeated"), c("anchors"), c("forms"), c("density"))
    score = S.candidate_score(a, c("text_length"), c("density"), S.default_penalty(a), feed, c("forms") >= 3, S.weights(F.lit("balanced"), F.lit(55))) + S.source_bonus(c("source"), c("confidence"))
    pool = rows.withColumns({"score": F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 6), "retention": F.round(S.default_retention(a), 6), "penalty": S.default_penalty(a), "processing_ms": F.lit(None).cast("double")})
    return R.winners(R.rank_candidates(pool, "page_id")).select("page_id", "source", "score", "retention", "text_length")


@query("resolve_readability")
def resolve_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page whether the best other candidate replaces the readable one."""
    rows = K.candidate_rows(table(spark, sf_dir, "pages"))
    a = F.struct(*K.FEATURES)
    scored = rows.select("page_id", "source", a.alias("a"), S.default_retention(a).alias("score"), "place")
    mine = scored.filter("source = 'readability'").select("page_id", c("a").alias("r"), (c("score") * 100).alias("r_score"))
    best = R.first_by(scored.filter("source != 'readability'"), ["page_id"], [-c("score"), c("place")]).select("page_id", c("source").alias("other"), c("a").alias("f"), (c("score") * 100).alias("f_score"))
    return mine.join(best, "page_id").select("page_id", "other", S.adopt_fallback(c("r"), c("f"), c("r_score"), c("f_score")).alias("adopted"))


# Sources and sinks that write and read again in the shared folder.


def folder(spark: SparkSession) -> str:
    from pagemill.streaming.events import shared_folder

    return f"{shared_folder(spark)}-{uuid.uuid4().hex[:8]}"


@query("sink_markdown", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def sink_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written by language and read again, partitions and all."""
    path = folder(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang").write.partitionBy("lang").parquet(path)
    return spark.read.parquet(path).groupBy(c("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("scan_md_corpus", "SELECT lang, sum(strlen(text) + 1)::BIGINT AS bytes, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY lang")
def scan_md_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text below one folder per language, and the folders walked and measured again."""
    path = folder(spark)
    table(spark, sf_dir, "documents").select("text", "lang").write.partitionBy("lang").text(path)
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path).select("value", F.regexp_extract("_metadata.file_path", "/lang=([^/]+)/", 1).alias("lang"))
    return lines.groupBy("lang").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.count(F.lit(1)).alias("lines"))


@query("source_models_json", "SELECT * FROM (VALUES ('a:free', true), ('b', false), ('c', true)) AS v(id, free)")
def source_models_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.sources.captures import read_models

    path = folder(spark)
    data = {"data": [{"id": "a:free", "name": "A", "pricing": {"prompt": "1"}}, {"id": "b", "name": "B", "pricing": {"prompt": "0.1", "image": "0"}}, {"id": "c", "name": "C", "pricing": {"prompt": "0", "image": "-1"}}]}
    spark.createDataFrame([(json.dumps(data),)], "value string").write.text(path)
    free = c("id").endswith(":free") | ((F.size("prices") > 0) & F.forall("prices", lambda p: p <= 0))
    return read_models(spark, path).select("id", free.alias("free"))


@query("source_json_thread", "SELECT conv_id, count(*) FILTER (trim(text) <> '') > 0 AS some FROM conversations GROUP BY conv_id")
def source_json_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thread_json(spark, sf_dir).select("conv_id", (F.length(F.get_json_object("json", "$[0].data.children[0].data.title")) > 0).alias("some"))


@query("cache_get_set", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 2 = 0 THEN 'old' ELSE 'missing' END AS state FROM documents")
def cache_get_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed cache: entries set again replace the old ones, the rest is left out by an anti-join; then every key is asked for."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    old = d.filter("doc_id % 2 = 0").withColumn("state", F.lit("old"))
    new = d.filter("doc_id % 3 = 0").withColumn("state", F.lit("new"))
    cache = old.join(new, "doc_id", "left_anti").unionByName(new)
    return d.join(cache, "doc_id", "left").withColumn("state", F.coalesce("state", F.lit("missing")))


TEMPLATE = "T {{TITLE}} U {{URL}} B {{BASELINE}} H {{HTML}} C {{CUSTOM}}"


@query("prompt_build", f"SELECT page_id, 'T Untitled U ' || url || ' B n/a H ' || trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style\\b[^>]*>.*?</style>', '', 'g'), '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) || ' C be brief' AS prompt FROM pages")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", prompts.build(TEMPLATE, F.lit(" "), c("url"), F.lit(None).cast("string"), c("html"), F.lit("be   brief")).alias("prompt"))


@query("custom_prompt_normalise", f"SELECT doc_id, CASE WHEN length(t) <= 1000 THEN t ELSE substr(t, 1, 1000) || chr(10) || chr(10) || '<!-- CUSTOM_TRUNCATED:' || (length(t) - 1000) || ' -->' END AS prompt FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS t FROM documents)")
def custom_prompt_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", prompts.custom(c("text")).alias("prompt"))


@query("iso_metadata_ts", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM events")
def iso_metadata_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in one of a list of formats, given out in one."""
    raw = F.when(c("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "d MMM yyyy HH:mm:ss"))
    parsed = F.coalesce(*(F.try_to_timestamp(raw, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss")))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("iso"))


@query("relative_time", "SELECT event_id, CASE WHEN m < 60 THEN m || ' minutes ago' WHEN floor(m / 60 + 0.5) < 24 THEN floor(m / 60 + 0.5)::BIGINT || ' hours ago' ELSE floor(m / 1440 + 0.5)::BIGINT || ' days ago' END AS said FROM (SELECT event_id, floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 60000000 + 0.5)::BIGINT AS m FROM events)")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.operators.stateful import epoch_ms

    minutes = T.js_round((epoch_ms(F.lit("2024-02-01").cast("timestamp_ntz")) - epoch_ms("ts")) / 60_000)
    hours, days = T.js_round(c("m") / 60), T.js_round(c("m") / 1440)
    said = F.when(c("m") < 60, F.concat(c("m").cast("string"), F.lit(" minutes ago"))).when(hours < 24, F.concat(hours.cast("string"), F.lit(" hours ago"))).otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    return table(spark, sf_dir, "events").select("event_id", minutes.alias("m")).select("event_id", said.alias("said"))


@query("date_format_custom", "SELECT event_id, strftime(ts, '%Y/%m/%d %H.%M.%S') AS custom, strftime(ts, '%B %-d, %Y, %-I:%M %p') AS locale FROM events")
def date_format_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy/MM/dd HH.mm.ss").alias("custom"), F.date_format("ts", "MMMM d, yyyy, h:mm a").alias("locale"))


@query("date_parse", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select("event_id", F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")).cast("date").cast("string").alias("day"))


ZONES = [("UTC", 0, True), ("Europe/Berlin", 60, True), ("America/New_York", -300, True), ("Asia/Kolkata", 330, True)]


@query("tz_list", "SELECT * FROM (VALUES ('UTC', 0::BIGINT, false), ('Europe/Berlin', 60, true), ('America/New_York', -300, true), ('Asia/Kolkata', 330, false)) AS v(zone, \"offset\", has_summer_time)")
def tz_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets in January, and whether July has another."""
    zones = spark.createDataFrame([(z,) for z, _, _ in ZONES], "zone string")
    at = lambda day: F.timestamp_diff("MINUTE", F.lit(f"{day} 12:00:00").cast("timestamp_ntz"), F.convert_timezone(F.lit("UTC"), c("zone"), F.lit(f"{day} 12:00:00").cast("timestamp_ntz")))
    return zones.select("zone", at("2024-01-15").alias("offset"), (at("2024-01-15") != at("2024-07-15")).alias("has_summer_time"))


# Scores and Markdown passes with names of their own.


@query("min_len_threshold", f"WITH {SQL_F} SELECT doc_id, greatest(60, least(320, floor(least(220, greatest(80, floor(greatest(1, source_length) * 0.08))) + 0.5)))::BIGINT AS least_length FROM t")
def min_len_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_rows(spark, sf_dir).select("doc_id", S.min_length(c("source_length"), F.lit("balanced"), F.lit(55)).alias("least_length"))


@query("profile_delta", f"WITH {SQL_F} SELECT profile, source, count(*) AS n, sum({SQL_PROFILE})::BIGINT AS points FROM t GROUP BY profile, source")
def profile_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = feature_rows(spark, sf_dir).withColumn("points", S.profile_bonus(c("profile"), c("a"), c("source")))
    return given.groupBy("profile", "source").agg(F.count("points").alias("n"), F.sum("points").cast("long").alias("points"))


ISSUES = [("content", 7), ("formatting", 3), ("structure", 9), ("content", 5)]


@query("sort_issues", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'structure,content,content,formatting' ELSE 'content,content,formatting' END AS issues FROM documents")
def sort_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each row by severity, the gravest first."""
    every = F.array(*(F.struct(F.lit(s).alias("severity"), F.lit(n).alias("category")) for n, s in ISSUES))
    mine = F.filter(every, lambda x: (c("doc_id") % 2 == 0) | (x["category"] != "structure"))
    ordered = F.array_sort(mine, lambda a, b: F.when(a["severity"] > b["severity"], -1).when(a["severity"] < b["severity"], 1).otherwise(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(ordered, lambda x: x["category"]), ",").alias("issues"))


for _name, _function in (("md_code_tables", repair.code_tables), ("md_dedupe_code", repair.dedupe_code), ("md_misfenced_headings", repair.misfenced_headings), ("md_chrome_lines", repair.chrome_lines)):

    def _register(name: str, function) -> None:
        @query(name)
        def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return markdown(spark, sf_dir).select("doc_id", K.text_pass(function)("md").alias("md"))

    _register(_name, _function)

REPO = [("# x\ntext", "https://github.com/ann/tool", "# ann/tool\n\n# x\ntext"), ("# ann/tool\nx", "https://github.com/ann/tool", "# ann/tool\nx"), ("# x", "https://example.com/a/b", "# x")]


def _repository_heading(md):
    name = F.regexp_extract("url", r"^https?://github\.com/([\w.-]+/[\w.-]+)", 1)
    return F.when((name == "") | F.contains(md, name), md).otherwise(F.concat(F.lit("# "), name, F.lit("\n\n"), md))


@query("md_github_headings_pages")
def md_github_headings_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown of every page, with the repository's name as its first heading."""
    made = K.per_page(table(spark, sf_dir, "pages"), "page_id long, url string, before string", lambda i, u, h: [(i, u, convert.to_markdown(dom.body_of(dom.parse(h))))])
    return made.select("page_id", "url", _repository_heading(c("before")).alias("after"))


@query("md_author_blocks_documents")
def md_author_blocks_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(spark, sf_dir).select("doc_id", M.strip_media(c("md")).alias("after"))


@query("md_github_headings", "SELECT * FROM (VALUES " + ", ".join(f"({_literal(u)}, {_literal(a)}, {_literal(b)})" for a, u, b in REPO) + ") AS v(url, before, after)")
def md_github_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repository's name as the first heading of pages of a code host, unless it is there."""
    rows = spark.createDataFrame([(u, a) for a, u, _ in REPO], "url string, before string")
    return rows.select("url", "before", _repository_heading(c("before")).alias("after"))


AUTHOR = [("Ann\n![Ann](https://gravatar.com/a.png)\n\n![Ann](https://gravatar.com/a.png)\nBody", "Ann\n\nBody")]


@query("md_author_blocks", "SELECT * FROM (VALUES " + ", ".join(f"({_literal(a)}, {_literal(b)})" for a, b in AUTHOR) + ") AS v(before, after)")
def md_author_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a, _ in AUTHOR], "before string").select("before", M.strip_media(c("before")).alias("after"))


@query("md_preset_post", f"WITH {SQL_MD} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(md, chr(13), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS md FROM m")
def md_preset_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.regexp_replace(F.replace("md", F.lit("\r"), F.lit("")), r"\n{3,}", "\n\n")
    return markdown(spark, sf_dir).select("doc_id", F.regexp_replace(F.regexp_replace(md, r"(?m)[ \t]+$", ""), r"^\s+|\s+$", "").alias("md"))


LISTS = r"(?m)^[ \t]*(?:[-*+]|\d+\.)[ \t]"
SQL_KEPT = f"{SQL_MD}, q AS (SELECT doc_id, md, {n_of('html', '(?i)<h[1-6][^>]*>')} AS hs, {n_of('html', '(?i)<[uo]l[^>]*>')} AS ls, {n_of('md', r'(?m)^#{1,6}[ ]')} AS kh, {n_of('md', LISTS)} AS kl, {n_of('md', '<[^>]+>')} AS tags FROM {SQL_HTML})"


@query("structure_preservation", f"WITH {SQL_KEPT} SELECT doc_id, greatest(0, 100 - (CASE WHEN hs > 0 AND kh < hs * 0.8 THEN 30 WHEN hs > 0 AND kh < hs * 0.9 THEN 15 ELSE 0 END) - (CASE WHEN ls > 0 AND kl < ls * 0.8 THEN 20 WHEN ls > 0 AND kl < ls * 0.9 THEN 10 ELSE 0 END))::BIGINT AS score FROM q")
def structure_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda col, p: F.size(F.regexp_extract_all(col, F.lit(f"({p})"), F.lit(1)))
    heads, lists, kept_heads, kept_lists = n("html", "(?i)<h[1-6][^>]*>"), n("html", "(?i)<[uo]l[^>]*>"), n("md", r"(?m)^#{1,6}[ ]"), n("md", LISTS)
    off = F.when((heads > 0) & (kept_heads < heads * 0.8), 30).when((heads > 0) & (kept_heads < heads * 0.9), 15).otherwise(0)
    off = off + F.when((lists > 0) & (kept_lists < lists * 0.8), 20).when((lists > 0) & (kept_lists < lists * 0.9), 10).otherwise(0)
    return pairs(spark, sf_dir).select("doc_id", F.greatest(F.lit(0), 100 - off).cast("long").alias("score"))


RAW_TAG = r"(?i)</?(?:div|span|section|article|main|header|footer|nav|aside|script|style|iframe|svg|path|form|button|input|textarea|select)\b[^>]*>"


@query(
    "assess_quality",
    rf"""WITH {SQL_MD}, a AS (SELECT doc_id, md, length({sql_normal("CASE WHEN doc_id % 4 = 1 THEN substr(md, 51) ELSE md END")}) AS n, {n_of("md", RAW_TAG)} AS tags, {n_of("md", r"(?m)^#{1,6}\s")} AS heads,
      len(list_filter(string_split(md, chr(10)), lambda x: regexp_matches(trim(x), '^[A-Za-z][A-Za-z-]{{1,23}}$'))) AS lone FROM m)
    SELECT doc_id, greatest(0, 100 - (CASE WHEN n < 80 THEN 50 WHEN n < 160 THEN 25 WHEN n < 240 THEN 10 ELSE 0 END) - (CASE WHEN heads = 0 THEN 18 ELSE 0 END) - least(12, tags) - (CASE WHEN regexp_matches(md, '\n{{4,}}') THEN 10 ELSE 0 END)
      - (CASE WHEN lone >= 12 THEN 12 WHEN lone >= 6 THEN 6 ELSE 0 END))::BIGINT AS score FROM a""",
)
def assess_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.size(F.regexp_extract_all("md", F.lit(f"({p})"), F.lit(1)))
    length = F.length(T.normalize_input(F.when(c("doc_id") % 4 == 1, F.substring("md", 51, 1 << 30)).otherwise(c("md"))))
    lone = F.size(F.filter(F.split("md", "\n"), lambda x: F.trim(x).rlike(r"^[A-Za-z][A-Za-z-]{1,23}$")))
    off = F.when(length < 80, 50).when(length < 160, 25).when(length < 240, 10).otherwise(0) + F.when(n(r"(?m)^#{1,6}\s") == 0, 18).otherwise(0) + F.least(F.lit(12), n(RAW_TAG))
    off = off + F.when(c("md").rlike(r"\n{4,}"), 10).otherwise(0) + F.when(lone >= 12, 12).when(lone >= 6, 6).otherwise(0)
    return markdown(spark, sf_dir).select("doc_id", F.greatest(F.lit(0), 100 - off).cast("long").alias("score"))


@query("validate_markdown", f"WITH {SQL_MD} SELECT doc_id, {n_of('md', r'(?m)^#{1,6}[ ]')}::BIGINT AS headings, {n_of('md', r'\[[^\]]*\]\([^)]*\)')}::BIGINT AS links, {n_of('md', '(?s)```.*?```')}::BIGINT AS blocks, {n_of('md', r'(?m)^[|].*[|]$')}::BIGINT AS table_rows FROM m")
def validate_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.size(F.regexp_extract_all("md", F.lit(f"({p})"), F.lit(1))).cast("long")
    return markdown(spark, sf_dir).select("doc_id", n(r"(?m)^#{1,6}[ ]").alias("headings"), n(r"\[[^\]]*\]\([^)]*\)").alias("links"), n(r"(?s)```.*?```").alias("blocks"), n(r"(?m)^[|].*[|]$").alias("table_rows"))


@query("ai_heading_semi", rf"WITH {SQL_MD}, h AS (SELECT doc_id, unnest(regexp_extract_all(md, '(?m)^#{{1,6}}[ \t]+(\S.*)$', 1)) AS h FROM m) SELECT DISTINCT a.doc_id, a.h FROM h a SEMI JOIN h b ON a.h = b.h AND a.doc_id <> b.doc_id")
def ai_heading_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that another document has too: counted, not paired."""
    heads = markdown(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("md", F.lit(r"(?m)^#{1,6}[ \t]+(\S.*)$"), F.lit(1)))).alias("h"))
    many = heads.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return heads.join(many, "h", "left_semi").select("doc_id", "h")


@query("candidate_lookup", f"WITH {SQL_F} SELECT doc_id, page, source FROM (SELECT *, row_number() OVER (PARTITION BY page, source ORDER BY doc_id) AS rn FROM t) WHERE rn = 1")
def candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_by(feature_rows(spark, sf_dir).select("page", "source", "doc_id"), ["page", "source"], ["doc_id"]).select("doc_id", "page", "source")


@query("fence_state", f"WITH {SQL_LINES} SELECT doc_id, count(*) FILTER (code AND NOT fence) AS in_code, count(*) FILTER (fence) AS fences FROM l GROUP BY doc_id")
def fence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.operators.lines import lines_of

    return lines_of(markdown(spark, sf_dir), "doc_id", "md").groupBy("doc_id").agg(F.count_if("in_code").alias("in_code"), F.count_if(c("line").rlike(r"^[ \t]*```")).alias("fences"))


@query("heading_level_prev", f"WITH {SQL_LINES}, h AS (SELECT doc_id, i, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS level FROM l WHERE NOT code AND regexp_matches(line, '^#{{1,6}}\\s')) SELECT doc_id, (i - 1)::BIGINT AS pos, level::BIGINT AS level, (lag(level) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS previous FROM h")
def heading_level_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.operators.lines import lines_of

    heads = lines_of(markdown(spark, sf_dir), "doc_id", "md").filter(~c("in_code") & c("line").rlike(r"^#{1,6}\s")).withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1)).cast("long"))
    return heads.select("doc_id", "pos", "level", F.lag("level").over(Window.partitionBy("doc_id").orderBy("pos")).alias("previous"))


@query("distinct_warnings", f"WITH {SQL_RUNS} SELECT stage, count(*) AS n FROM (SELECT DISTINCT stage, unnest(fallbacks) AS w FROM r) GROUP BY stage")
def distinct_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("stage", F.explode("fallbacks").alias("w")).distinct().groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("dedupe_copy_fingerprint", "SELECT user_id, event_type, time_bucket(INTERVAL 60 SECONDS, ts, TIMESTAMP '1970-01-01') AS start, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3")
def dedupe_copy_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type", F.window("ts", "60 seconds").alias("w")).agg(F.min("event_id").alias("event_id")).select("user_id", "event_type", c("w.start").alias("start"), "event_id")


@query("table_set_ops", "(SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def table_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.intersect(labels).unionAll(d.exceptAll(labels).distinct())


@query("stage_cube", f"WITH {SQL_RUNS} SELECT stage, quality > 50 AS good, count(*) AS n FROM r GROUP BY CUBE (stage, quality > 50)")
def stage_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).withColumn("good", c("quality") > 50).cube("stage", "good").agg(F.count(F.lit(1)).alias("n")).select("stage", "good", "n")


@query("preset_registry", "SELECT * FROM (VALUES ('academic'), ('github'), ('minimal'), ('notion'), ('obsidian'), ('standard')) AS v(preset)")
def preset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in convert.PRESETS], "preset string")


@query("collapse_text", f"SELECT doc_id, {sql_collapse('text')} AS text FROM documents")
def collapse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(c("text")).alias("text"))


@query(
    "source_settings",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'ai' ELSE 'offline' END AS mode, 3 AS version,
       CASE WHEN user_id % 2 = 0 THEN 'u' || user_id ELSE 'anon_' || substr(sha256(event_id::VARCHAR), 1, 12) END AS user_id, 'openrouter' AS provider,
       CASE WHEN event_id % 5 = 0 THEN 'minimal' ELSE 'standard' END AS preset, least(100.0, greatest(0.0, CASE WHEN event_id % 5 = 0 THEN round(value) ELSE 55 END))::DOUBLE AS slider,
       NOT (event_id % 4 = 3 AND event_type = 'click' AND user_id % 2 = 0 AND event_id % 5 = 0 AND round(value) BETWEEN 0 AND 100) AS migrated FROM events""",
)
def source_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored settings of many versions, made of the events, in their present form."""
    from pagemill.sources.settings import migrate

    tuned = F.when(c("event_id") % 5 == 0, F.struct(F.lit("minimal").alias("preset"), F.round("value").alias("slider")))
    user = F.when(c("user_id") % 2 == 0, F.struct(F.concat(F.lit("u"), c("user_id").cast("string")).alias("id")))
    mode = F.when(c("event_type") == "click", "ai").when(c("event_type") == "view", "offline-legacy").otherwise("smart")
    raw = F.to_json(F.struct(mode.alias("mode"), (c("event_id") % 4).alias("settingsSchemaVersion"), user.alias("user"), tuned.alias("processing")))
    return table(spark, sf_dir, "events").select("event_id", migrate(raw, c("event_id")).alias("s")).select("event_id", "s.*")


@query("source_http_extract")
def source_http_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by a provider outside of the kernel; here a plain converter stands in for the service."""
    from pagemill.sources.extractors import provided

    return provided(table(spark, sf_dir, "pages"), lambda html, url: convert.simple_markdown(features.clean(dom.parse(html), url)) or None)
