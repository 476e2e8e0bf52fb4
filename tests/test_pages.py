"""Document trees, candidates, conversion, repairs, metadata and threads on authored markup."""

import json
import re

import pytest

from pagemill.functions import convert, dom, features, metadata, repair, threads
from pagemill.operators import kernel as K

ARTICLE = """<html><head><title>The long title of this page</title><meta name="author" content="Ann Lee"></head><body>
<nav><a href="/">Home</a></nav><div class="sidebar">side</div><article><h1>The long title of this page</h1>
""" + "".join(f"<p>Paragraph {i} has a number of words, some commas, and enough text to count as a paragraph of an article that people would read to its end because it goes on and on for more than two hundred characters in all.</p>" for i in range(5)) + """
<h2>A section with a heading</h2><pre><code class="language-py">x = 1
print(x)</code></pre><ul><li>one</li><li>two <b>bold</b><ul><li>inner</li></ul></li></ul>
<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2|3</td></tr></table><img src="/i.png" alt="pic"><img src="data:image/png;base64,xx"></article>
<footer>foot</footer></body></html>"""


def test_tree_and_selectors():
    root = dom.parse('<div id="a" class="x y"><p>1<p>2<ul><li>a<li>b</ul><span data-k="v1">s</span></div><p class="">e</p>')
    assert [n.text() for n in root.select("div p")] == ["1", "2"]
    assert len(root.select("li")) == 2 and len(root.select("div.x.y ul li")) == 2 and len(root.select("#a, [data-k^=v]")) == 2
    assert [n.tag for n in root.select("[data-k*=1],[data-k$='1']")] == ["span"] and root.select("div:empty") == []
    assert root.first("li").closest("div").get("id") == "a"
    node = root.first("ul")
    node.remove()
    assert root.first("li") is None


def test_tree_of_broken_markup():
    for html in ("", "<", "<p", "</p></div>", "<b><p>x</b>y</p>", "<table><tr><td>a<td>b<tr><td>c", "<!doctype", "<![CDATA[x", "&amp;&#x41;&bogus;", "<p>" * 3000):
        root = dom.parse(html)
        assert dom.parse(root.html()).text() == root.text()


def test_node_table_intervals():
    rows = dom.rows(dom.parse("<a><b><c></c></b><d></d></a>"))
    by = {r[5]: r for r in rows}
    below = lambda x, y: by[y][2] < by[x][2] and by[x][3] < by[y][3]
    assert below("c", "a") and below("c", "b") and below("d", "a") and not below("d", "b") and not below("a", "c")


def test_page_types():
    assert features.page_type(dom.parse(ARTICLE), "https://blog.example.com/x")[0] == "article"
    assert features.page_type(dom.parse("<pre>a</pre>" * 12), "https://example.com/x")[0] == "code-heavy"
    assert features.page_type(dom.parse("<div class=comment>x</div>" * 3), "https://forum.example.com/thread/1")[0] == "forum"
    assert features.page_type(dom.parse('<div class="price">1</div>'), "https://example.com/x")[0] == "product"
    assert features.page_type(dom.parse("<p>x</p>"), "https://example.com/x") == ("generic", 0.3, [])
    assert features.page_type(dom.parse("<p>x</p>"), "https://docs.example.com/guide")[0] == "documentation"


def test_scores_and_pruning():
    root = dom.parse(ARTICLE)
    best, score = features.best_node(dom.body_of(root))
    assert best.tag in ("article", "body") and score > 0
    assert features.node_score(root.first("nav")) < 0
    assert "side" not in features.prune(dom.body_of(root)).text()


def test_candidates_and_readability():
    root = features.clean(dom.parse(ARTICLE), "https://example.com/a/")
    pool = features.candidates(root)
    assert "semantic" in {c.source for c in pool} and all(set(K.FEATURES) <= set(c.features) for c in pool)
    assert root.first("img").get("src") == "https://example.com/i.png" and root.first("footer") is None
    assert "Paragraph 4" in features.readable(dom.body_of(root)).text()


def test_gate_features():
    g = features.gate_features(dom.body_of(dom.parse('<body><article><h1>t</h1> <p>10:30 am by ann lee</p><time>x</time><p><a href="#">link</a></p></article></body>')))
    assert g["paragraphs"] == 2 and g["headings"] == 1 and g["structure"] == 25 and g["cue"] == 36 and 0 < g["link_density"] < 1


@pytest.mark.parametrize("preset", convert.PRESETS)
def test_conversion(preset):
    md = convert.to_markdown(features.clean(dom.parse(ARTICLE)), preset)
    assert md.startswith("# The long title of this page") or md.startswith("The long title")
    assert "- one\n- two **bold**\n  - inner" in md and "| a | b |\n| --- | --- |\n| 1 | 2\\|3 |" in md and "base64" not in md
    assert {"github": "```py" , "minimal": "    x = 1"}.get(preset, "```py\nx = 1\nprint(x)\n```") in md or "```python" in md
    assert ("![[/i.png|pic]]" if preset == "obsidian" else "![pic](/i.png)") in md


def test_conversion_of_inline_and_tables():
    to = lambda html, preset="standard": convert.to_markdown(dom.parse(html), preset)
    assert to("<p>a <em>b</em> <code>c  d</code><br>e</p>") == "a _b_ `c d`\ne"
    assert json.loads(re.search(r"```json\n(.*)\n```", to("<table><tr><th>a</th></tr><tr><td rowspan=2>1</td></tr></table>"), re.S)[1]) == {"headers": ["a"], "rows": [["1"]]}
    assert to('<a href="/x">in</a> <a href="https://e.com">out</a>', "obsidian") == "[[in]] [out](https://e.com)"
    assert to('<div class="warning"><p>care</p></div>', "github") == "> [!WARNING]\n> care"
    assert to("<blockquote><p>a</p><p>b</p></blockquote>") == "> a\n>\n> b"
    assert to("<ol start=3><li>a<li>b</ol>") == "3. a\n4. b"
    with pytest.raises(ValueError):
        to("x", "other")


@pytest.mark.parametrize(
    ("function", "md", "want"),
    [
        (repair.normalize_headings, "# a\n# b\n#### c\ntext", "# a\n\n## b\n\n### c\n\ntext"),
        (repair.normalize_headings, "## Same source,\n\ncleaner context\nx", "## Same source, cleaner context\n\nx"),
        (repair.normalize_headings, "```\n# a\n### b\n```", "```\n# a\n### b\n```"),
        (repair.bulletize, "First short item\n\nSecond short item\n\nThird short item\n\nThis is a sentence.", "- First short item\n- Second short item\n- Third short item\n\nThis is a sentence."),
        (repair.bulletize, "Only one here\n\nand two here\n\nEnd.", "Only one here\n\nand two here\n\nEnd."),
        (repair.fence_escaped_html, "a\n&lt;div&gt;\n&lt;b&gt;x\n&lt;/div&gt;\nb", "a\n```html\n<div>\n<b>x\n</div>\n```\nb"),
        (repair.repair_fences, "```<div>x</div>```### Head\n\ntext", "```html\n<div>x</div>\n```\n### Head\n\ntext"),
        (repair.repair_fences, "```py\nx", "```py\nx\n```"),
        (repair.repair_fences, "```html\n</div>\n# Head", "```html\n</div>\n```\n\n# Head"),
        (repair.technical_blocks, "Run this:\n$ npm install x\n$ npm start\nThen read.", "Run this:\n```bash\nnpm install x\nnpm start\n```\nThen read."),
        (repair.technical_blocks, 'a\n{\n  "b": "}"\n}\nc', 'a\n```json\n{\n  "b": "}"\n}\n```\nc'),
        (repair.technical_blocks, "[package]\nname = 1\nx = 2\n\nend", "```toml\n[package]\nname = 1\nx = 2\n```\n\nend"),
        (repair.technical_blocks, "make sure that you read this.", "make sure that you read this."),
        (repair.code_tables, "| 1 | `x = 1` |\n| --- | --- |\n| 2 | `y` |", "```\nx = 1\ny\n```"),
        (repair.dedupe_code, "```\na\n```\n\n```py\n a\n```\nb", "```\na\n```\n\nb"),
        (repair.misfenced_headings, "```\n## A\n```\nb", "## A\nb"),
        (repair.strip_ui_code, "raw input\n```\ndonate and create account\n```\nb", "raw input\nb"),
        (repair.strip_ui_code, "```\nimport x; log in; cookie settings\n```", "```\nimport x; log in; cookie settings\n```"),
    ],
)
def test_repairs(function, md, want):
    assert function(md) == want


def test_skip_prelude():
    assert repair.skip_prelude("[Skip to main content](#m)\n\n---\n# T\nx", "T") == "# T\nx"
    assert repair.skip_prelude("[Skip to main content](#m) other words\n# T", "T") == "[Skip to main content](#m) other words\n# T"


def test_fences_always_balance():
    import random

    rng = random.Random(1)
    parts = ["```", "```py", "text ```", "```<b>", "</div>", "# h", "- x", "", "a"]
    for _ in range(300):
        md = repair.repair_fences("\n".join(rng.choice(parts) for _ in range(rng.randint(0, 12))))
        assert sum(x.strip().startswith("```") for x in md.split("\n")) % 2 == 0


def test_timestamps():
    assert metadata.pick_time(["2024-01-02", "5 Nov 2025 10:30", "soon"], 2026) == ("5 Nov 2025 10:30", "2025-11-05T10:30:00.000Z")
    assert metadata.parse_time("1736899200") == metadata.parse_time("1736899200000")
    assert metadata.iso(metadata.parse_time("2025-11-05T10:00:00+02:00")) == "2025-11-05T08:00:00.000Z"
    assert metadata.parse_time("no date") is None and not metadata.looks_like_timestamp("abc")
    assert metadata.fragments("posted 10:30 IST Nov 5, 2025 by x")[0].startswith("10:30")
    assert metadata.pick_byline(["Staff", "x", "By Ann Lee"]) == "Ann Lee"


LISTING = [
    {"data": {"children": [{"kind": "t3", "data": {"id": "p", "title": "Post", "author": "op", "selftext": "Hello [x](https://e.com)\n\n1. a 2. b", "url": "https://e.com/p"}}]}},
    {"data": {"children": [{"kind": "t1", "data": {"id": "c1", "author": "somebot", "score": 1, "created_utc": 0, "body": "Hi & <b>", "replies": {"data": {"children": [{"kind": "t1", "data": {"id": "c2", "author": None, "body": "deep", "replies": ""}}]}}}}, {"kind": "more", "data": {}}]}},
]


def test_threads():
    post, rows, omitted = threads.flatten(json.dumps(LISTING))
    assert post["title"] == "Post" and [(r["comment_id"], r["depth"], r["parent_id"], r["path"]) for r in rows] == [("c1", 0, None, [0]), ("c2", 1, "c1", [0, 0])] and omitted == 0
    assert rows[0]["is_bot_like"] and rows[0]["created_at"] == "1970-01-01T00:00:00.000Z"
    html = threads.render(post, rows)
    assert '<a href="https://e.com">x</a>' in html and "<ol><li>a</li><li>b</li></ol>" in html and "<h3>u/somebot · 1 point · 1970-01-01T00:00:00.000Z</h3>" in html and "Hi &amp; &lt;b&gt;" in html and "<h4>Reply from Unknown redditor</h4>" in html
    assert threads.flatten("{broken") == (None, [], 0) and threads.flatten(None) == (None, [], 0)


def test_thread_limits():
    chain = {"kind": "t1", "data": {"id": "x", "body": "b", "replies": ""}}
    for _ in range(12):
        chain = {"kind": "t1", "data": {"id": "x", "body": "b", "replies": {"data": {"children": [chain]}}}}
    post = {"kind": "t3", "data": {"title": "t", "selftext": ""}}
    _, rows, omitted = threads.flatten(json.dumps([{"data": {"children": [post, chain]}}]))
    assert max(r["depth"] for r in rows) == threads.DEEPEST and len(rows) + omitted == 13
    many = [post] + [{"kind": "t1", "data": {"id": str(i), "body": "b", "replies": ""}} for i in range(100)]
    _, rows, omitted = threads.flatten(json.dumps([{"data": {"children": many}}]))
    assert len(rows) == threads.MOST and omitted == 20


PAGES = [(1, "https://blog.example.com/post", ARTICLE), (2, "https://example.com/", "<p>short page</p>"), (3, "https://example.com/", ""), (4, None, None), (5, "https://example.com/x", "<script>alert(1)</script>")]


def test_extract_keeps_its_promises(spark):
    """What holds for every page: a citation first, one heading at least, balanced fences, the body of the article kept."""
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    out = {r["page_id"]: r for r in K.assess(K.extract(frame, "2026-01-02T03:04:05.000Z", keep_html=True)).collect()}
    assert set(out) == {1, 2, 3, 4, 5}
    for r in out.values():
        md = r["markdown"]
        assert md.startswith("> Source: [") and "> Captured: 2026-01-02T03:04:05.000Z" in md and re.search(r"(?m)^# \S", md)
        assert sum(x.strip().startswith("```") for x in md.split("\n")) % 2 == 0 and 0 <= r["overall"] <= 100 and "alert(1)" not in md
    first = out[1]
    assert first["profile"] == "article" and first["byline"] == "Ann Lee" and "> By: Ann Lee" in first["markdown"] and first["grade"] in "AB"
    assert all(f"Paragraph {i} " in first["markdown"] for i in range(5)) and "side" not in first["markdown"] and "foot" not in first["markdown"]
    assert "short page" in out[2]["markdown"] and out[3]["winner"] == "none"


def test_repeated_pages_and_pages_without_an_id(spark):
    big = (1 << 53) + 1
    frame = spark.createDataFrame([PAGES[0]] * 3 + [(None, "https://example.com/n", "<p>page without an id</p>"), (big, "https://example.com/b", "<p>page</p>")], "page_id long, url string, html string")
    ids = [r["page_id"] for r in K.assess(K.extract(frame, "2026-01-02T03:04:05.000Z", keep_html=True)).collect()]
    assert sorted(ids, key=lambda i: (i is None, i)) == [1, 1, 1, big, None]


def test_deep_and_broken_pages(spark):
    pages = ["<div>" * 100_000 + "the words" + "</div>" * 100_000, "<b>" * 1_500 + "the words", "<ul><li>" * 3_000 + "the words", "<p><a title='x>" * 2_000 + "the words", "<section>" + "<div></div>" * 50_000 + "the words</section>"]
    frame = spark.createDataFrame([(i, "https://example.com/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    out = {r["page_id"]: r["markdown"] for r in K.assess(K.extract(frame, "2026-01-02T03:04:05.000Z", keep_html=True)).collect()}
    assert set(out) == set(range(5)) and all("the words" in out[i] for i in (0, 1, 2, 4))
    assert K.nodes(frame.filter("page_id = 0")).agg({"depth": "max"}).first()[0] <= 201


def test_noise_pass_equals_the_column_function(spark):
    from pyspark.sql import functions as F

    from pagemill.functions import markdown as M
    from pagemill.functions import repair
    from pagemill.plans.markdown_queries import BACK, EXTRAS, FRONT

    lines = ["", " ", "Share", "- Share", "1. 42", "* 1. Save", "# 42", "Accept all the cookies", "accept all \u00a0 cookie <!-- x -->", "x" * 190 + " join reddit", "x" * 201 + " join reddit", "Python +12", "3) no", "-->", "*", "<path d=1", "[Sponsor](", "Raw  input", "raw input\r", "data:image/png", "words"]
    texts = ["\n".join([a, e, b]) for a in FRONT for e in EXTRAS for b in BACK] + lines + ["\n".join(lines), "Share\n```\nShare\n```\nShare\n```\nShare"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.strip_ui_noise(F.col("t")).alias("v")).collect()
    assert all(repair.strip_ui_noise(r["t"]) == r["v"] for r in out)


def test_post_process_and_canonicalise(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("# T\n* a\n+ b\n[x]( //y )\nShare\n$ npm install z\n", "T"), ("", "T"), (None, "T")], "md string, title string")
    out = rows.select(K.post_process(F.col("md"), contents=True).alias("p"), K.canonicalise(F.col("md"), F.col("title")).alias("c")).collect()
    assert "- a\n- b" in out[0]["p"] and "[x](https://y)" in out[0]["p"]
    assert "Share" not in out[0]["c"] and "```bash\nnpm install z\n```" in out[0]["c"] and out[1]["c"] == "# T"
