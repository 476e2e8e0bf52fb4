"""Functions on literals: values re-derived by hand or by plain Python."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import markdown as M
from pagemill.functions import scoring as S
from pagemill.functions import text as T
from pagemill.functions import urls as U
from pagemill.functions import warnings as W
from pagemill.sources import captures


def value(spark, expression, *texts):
    frame = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
    return frame.select(expression(*(F.col(f"c{i}") for i in range(len(texts)))).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (T.normalize_input, " a<!-- x -->b <![CDATA[z]]>  c​d --> ", "a b cd"),
        (T.normalize_heading, "Hello,   WORLD! ¿Qué?", "hello world qué"),
        (T.escape_html, "a<b & 'c'\"", "a&lt;b &amp; &#39;c&#39;&quot;"),
        (T.decode_entities, "&lt;b&gt; &amp;amp; &mdash;", "<b> &amp; —"),
        (T.safe_title, '  A <b>: "title"/with?  stuff... ', "A-b-titlewith-stuff"),
        (T.safe_title, "???", "untitled"),
        (T.fnv1a32, "a", "e40c292c"),
        (T.fnv1a32, "foobar", "bf9cf968"),
        (T.split_count, " a b ", 4),
        (T.format_author, None, "u/[deleted]"),
        (U.host, "HTTPS://Blog.Example.com:8080/x", "blog.example.com"),
        (U.host, "not a url", "not a url"),
        (U.json_thread_url, "https://r.example.com/a/b/?x=1#y", "https://r.example.com/a/b.json"),
        (U.api_base, "https://api.example.com/v1/", "https://api.example.com/v1"),
        (U.api_base, "https://10.0.0.1/v1", None),
        (U.api_base, "https://172.20.1.1/v1", None),
        (U.api_base, "http://api.example.com", None),
        (U.api_base, "https://localhost/x", None),
        (U.api_base, "https://a.example.com:8443/x", None),
        (U.preset, "https://docs.example.com/x", "technical-documentation"),
        (U.preset, "https://www.example.com/x", "default"),
    ],
)
def test_text(spark, function, text, want):
    assert value(spark, function, text) == want


@pytest.mark.parametrize(("a", "b", "same"), [("same title", "same title", True), ("a long enough heading", "x a long enough heading y", True), ("short", "a short one", True), ("alpha beta gamma", "gamma beta alpha", True), ("alpha beta", "gamma delta", False), ("", "x", False)])
def test_headings(spark, a, b, same):
    assert value(spark, T.headings_equivalent, a, b) is same


@pytest.mark.parametrize(
    ("function", "md", "want"),
    [
        (M.cleanup_spaces, "a  \r\n\tb\r", "a\n  b\n"),
        (M.unescape_leading, "\\# a\n```\n\\# b\n```\n\\# c", "# a\n```\n\\# b\n```\n# c"),
        (M.fix_lists, "* a\n+ b\n-   c\n1.   d\n```\n* e\n```", "- a\n- b\n- c\n1. d\n```\n* e\n```"),
        (M.links, "[ a ]( u ) [b](  ) [c](//d)", "[a](u) b [c](https://d)"),
        (M.images, "x ![](p/q.big.png) y", "x \n\n![q](p/q.big.png)\n\n y"),
        (M.limit_blank, "a\n\n\n\nb", "a\n\nb"),
        (M.unwrap_fence, "\n```md\n# a\nb\n```\n", "# a\nb"),
        (M.strip_highlight, "==a== b", "a b"),
        (M.strip_citation, "> Source: [t](u)\n> Captured: x\n>\n> Hash: y\n\n# t\nrest", "# t\nrest"),
        (M.sanitize, "a <script>x</script> javascript:b alert(1)", "a   blocked:b blocked_call(1)"),
        (M.strip_ui_noise, "keep\nShare\n42\n## 42\n```\nShare\n```\n- Past week\nend", "keep\n## 42\n```\nShare\n```\nend"),
        (M.strip_media, "a\n![](x.png)\n![A real description](y.png)\n[ ](z)\nLinkedIn\nb", "a\n![A real description](y.png)\nb"),
        (M.collapse_words, "x y\nAlpha\nBeta\nGamma\nDelta\nEpsilon\nz w", "x y\nAlpha Beta Gamma Delta Epsilon\nz w"),
        (M.collapse_words, "Alpha\nBeta\nGamma\nDelta", "Alpha\nBeta\nGamma\nDelta"),
        (M.token_boundaries, "seehttps://a.b\n> seehttps://a.b", "see https://a.b\n> seehttps://a.b"),
        (M.spacing, "a  \n\n\n\nb\n \n", "a\n\nb"),
        (M.inline_code_spacing, "use `a`b,`c`", "use `a` b, `c`"),
        (M.merge_headings, "# A title for\nall people\nx.", "# A title for all people\nx."),
        (M.strip_navigation, "- [Home](/home)\nNews\n\nlead\n\n# The title\nbody", "lead\n\n# The title\nbody"),
        (M.final_cleanup, "a​\n\n\n", "a\n"),
        (M.heading_jumps, "# a\n### b\n#### c\n## d\n#### e", 2),
        (M.code_chars, "x\n```py\nab  c\n```\n```\nd\n```", 5),
        (M.lone_words, "a\nWord\ntwo words\nOther", 2),
    ],
)
def test_markdown(spark, function, md, want):
    assert value(spark, function, md) == want


def test_long_runs_of_words(spark):
    words = [f"w{i}" for i in range(60_000)]
    assert value(spark, M.collapse_words, "\n".join(words)) == " ".join(words)


def test_contents_table(spark):
    out = value(spark, M.contents_table, "# Top\ntext\n## One two!\nmore")
    assert out == "# Top\n\n## Table of Contents\n\n- [Top](#top)\n- [One two!](#one-two)\n\ntext\n## One two!\nmore"
    assert value(spark, M.contents_table, "# Only\ntext") == "# Only\ntext"


def test_primary_heading(spark):
    assert value(spark, M.primary_heading, "# The same title\nx", "The same title") == "# The same title\nx"
    assert value(spark, M.primary_heading, "x", "A title") == "# A title\n\nx"
    assert value(spark, M.primary_heading, " ", "A title") == "# A title"


def test_footer_cut(spark):
    body = "\n".join(f"line {i}" for i in range(40))
    feet = "\nPrivacy Policy\nCareers\nContact us\n© 2026 Us\nTerms"
    assert value(spark, M.strip_footer, body + feet) == body
    assert value(spark, M.strip_footer, "x" + feet) == "x" + feet


def test_citation_leaves_out_what_is_missing(spark):
    out = spark.range(1).select(M.cite_first(F.lit("text"), F.lit(" "), F.lit(""), F.lit("T"), F.lit(""), byline=F.lit("Ann")).alias("v")).first()["v"]
    assert out == "> Source: [Untitled Page](Unknown URL)\n> Captured: T\n> By: Ann\n> Hash: N/A\n\n# Untitled Page\n\ntext"


@pytest.mark.parametrize(("html", "unclosed", "bad", "heads"), [("<p>a</p>", 0, 0, 0), ("<div><p>a</div>", 1, 1, 0), ("<h1>a<br>", 1, 0, 1), ("</p>", 0, 1, 0), ("<img src=x/><b><i></b></i>", 0, 1, 0)])
def test_tag_structure(spark, html, unclosed, bad, heads):
    s = value(spark, W.tag_structure, html)
    assert (s["unclosed"], s["mismatched"], s["unclosed_headings"]) == (unclosed, bad, heads)


def test_warnings(spark):
    names = value(spark, W.input_warnings, '<a onclick="x()" href="javascript:y">z</a><script>alert(1)</script>')
    assert "event handler XSS removed" in names and "protocol XSS sanitized" in names and "script XSS content removed" in names
    assert value(spark, W.input_warnings, "<p>fine</p>") == [] and value(spark, W.input_warnings, "") == []
    assert value(spark, W.input_warnings, None) == []


@pytest.mark.parametrize(
    ("html", "names"),
    [
        ('<a href="jav&#x0A;ascript:x">z</a>', ["protocol XSS sanitized", "encoded XSS sanitized"]),
        ('<a href="&#x26;#106;avascript:x">z</a>', ["protocol XSS sanitized", "encoded XSS sanitized"]),
        ('<a href="java\\script&#99999999999999999999;:x">z</a>', ["encoded XSS sanitized"]),
        ('<a href="java&Tab;script&#8195;:x">z</a>', ["protocol XSS sanitized", "encoded XSS sanitized"]),
        ("<!-- alert (1) -->", ["comment CDATA suspicious content detected"]),
        ("<p name=action>z</p>", ["DOM clobber name collision risk detected", "DOM clobber conflict detected", "attribute quote malformed normalization applied"]),
        ('<b a="1"c="2">z</b>', ["attribute quote malformed normalization applied"]),
        ("<p style='width:0; height : 0'>z</p>", ["hidden invisible content detected"]),
        ("<p style='width:0'>z</p>", []),
        ("<h3>z<hr>", ["unclosed tag structure detected", "unclosed heading structure detected", "self-closing tag normalization applied"]),
        ("<tr><td>z</tr>", ["unclosed tag structure detected", "mismatched closing tag detected", "table malformed structure detected"]),
        ("<ul><li>z</ul>", ["unclosed tag structure detected", "mismatched closing tag detected", "list structure orphaned items detected"]),
    ],
)
def test_warnings_of_patterns_probe_and_structure(spark, html, names):
    assert value(spark, W.input_warnings, html) == names


def test_weights_and_floor(spark):
    w = spark.range(1).select(S.weights(F.lit("max_cleanliness"), F.lit(0)).alias("w"), S.weights(F.lit("odd"), F.lit(99)).alias("d")).first()
    assert w["w"]["section"] == pytest.approx(10 - 55 / 45 * 2) and w["w"]["noise"] == pytest.approx(18 + 55 / 45 * 2)
    assert w["d"]["text"] == 24 and w["d"]["boilerplate"] == 1


def test_checked_tuning(spark):
    assert spark.range(1).select(S.checked_tuning(F.lit("balanced"), F.lit(3))).first()[0] == "balanced"
    with pytest.raises(Exception, match="not a tuning"):
        spark.range(1).select(S.checked_tuning(F.lit("odd"), F.lit(3))).collect()


@pytest.mark.parametrize(("md", "status"), [("", "incomplete_empty_body"), ("> Source: x\n\n# Title", "incomplete_title_only"), ("# T\n[a](b) [c](d) [e](f)", "incomplete_navigation_only"), ("# T\nshort", "partial"), ("# T\n" + "many words of a body " * 40, "complete")])
def test_completeness(spark, md, status):
    assert value(spark, S.completeness, md)["status"] == status


def test_ai_gate(spark):
    base = "# One heading\ntext with some_name\n## Two heading\nmore"
    good = value(spark, S.ai_gate, base, base + "\nextra")
    assert good["headings"] == good["heading_order"] == good["tokens"] == 1 and not good["odd_fences"]
    bad = value(spark, S.ai_gate, base, "## Two heading\n# One heading\n```")
    assert bad["headings"] == 1 and bad["heading_order"] == 0.5 and bad["tokens"] == 0 and bad["odd_fences"]


def test_capture_contract(spark):
    rows = spark.createDataFrame([("<p>", "u", "t", "h", "m" * 10), (" ", "u", None, "h", None)], "html string, url string, title string, selectionHash string, metadataHtml string")
    out = captures.validate(rows, clip=4).collect()
    assert out[0]["missing"] == [] and out[0]["metadataHtml"] == "mmmm" and out[1]["missing"] == ["html", "title"]


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("# a\n")
    (tmp_path / "b.html").write_text("<h1>b</h1>")
    (tmp_path / "m.json").write_text('{"data":[{"id":"x:free","name":"X","pricing":{"prompt":"0","image":"n/a"}}]}')
    assert captures.read_markdown_folder(spark, str(tmp_path)).first()["file"] == "sub/a.md"
    assert captures.read_html_folder(spark, str(tmp_path)).first()["html"] == "<h1>b</h1>"
    assert captures.read_models(spark, str(tmp_path / "m.json")).first()["prices"] == [0.0, None]
