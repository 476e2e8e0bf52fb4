"""The extraction kernel: every page is parsed once, inside Arrow batches, and leaves as rows.

Pages are independent, so nothing here shuffles except `spread`, which deals out an input of fewer files than cores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from pagemill.functions import convert, dom, features, metadata, page_ops, repair
from pagemill.functions import markdown as M
from pagemill.functions import scoring as S
from pagemill.functions import text as T
from pagemill.functions import urls as U

CANDIDATES = "page_id long, place int, source string, html string, confidence double, text_length long, heading_coverage double, section_count int, noise boolean, lead boolean, anchors int, repeated int, forms int, vector boolean, density double, paragraphs int, code long, tables int, lists int"
NODES = "page_id long, node int, parent int, pre int, post int, depth int, tag string, attrs map<string,string>, own_text string"
PAGE = "page_id long, url string, title string, profile string, confidence double, signals array<string>, published string, updated string, byline string, n_source long, candidates array<struct<place: int, source: string, markdown: string, confidence: double, processing_ms: double, f: struct<text_length: bigint, heading_coverage: double, section_count: int, noise: boolean, lead: boolean, anchors: int, repeated: int, forms: int, vector: boolean, density: double, paragraphs: int, code: bigint, tables: int, lists: int>>>"
#: Bytes of input for a core below which pages in few files are dealt out.
SPLIT_BYTES = 32 << 20
FEATURES = ("text_length", "heading_coverage", "section_count", "noise", "lead", "anchors", "repeated", "forms", "vector", "density", "paragraphs", "code", "tables", "lists")


def spread(pages: DataFrame) -> DataFrame:
    """The pages over all cores if they come in a few small files; a large input keeps its splits and moves nowhere."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    small = pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < cores * SPLIT_BYTES
    return pages.repartition(cores) if small and len(pages._jdf.inputFiles()) < cores else pages


def per_page(pages: DataFrame, schema: str, rows_of: Callable[..., list], extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows made of (page_id, url, html) and the extra columns one page at a time, each page whole. Null markup counts as
    empty; a page without an id keeps none; repeated pages are worked on one by one."""
    names = [part.split()[0] for part in _split(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, html, *more in zip(*(batch[c] for c in batch.columns), strict=True):
                rows += rows_of(None if page_id is None else int(page_id), url or "", html or "", *more)
            yield pd.DataFrame(rows, columns=names, dtype=object)

    # Ids travel as text: a batch with a missing whole number would come as floating point and lose digits.
    return spread(pages.select(F.col("page_id").cast("string"), "url", "html", *extra)).mapInPandas(run, schema)


def _split(schema: str) -> list[str]:
    """The fields of a schema string, commas inside of angle brackets left alone."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def nodes(pages: DataFrame) -> DataFrame:
    """The elements of every page with the intervals that make descendants a range join."""
    return per_page(pages, NODES, lambda page_id, url, html: [(page_id, *r[:2], *r[2:]) for r in dom.rows(dom.parse(html))])


def candidate_rows(pages: DataFrame) -> DataFrame:
    """The candidate extractions of every page with their features."""

    def of(page_id: int, url: str, html: str) -> list:
        root = dom.parse(html)
        pool = page_ops.pool(root, url, features.page_type(root, url)[0])
        return [(page_id, i, c.source, c.node.html(), c.confidence, *(c.features[n] for n in FEATURES)) for i, c in enumerate(pool)]

    return per_page(pages, CANDIDATES, of)


def _page(year: int, preset: str, keep_html: bool = False, adapters: list[page_ops.Adapter] | None = None):
    def of(page_id: int | None, url: str, html: str, whole: int = 0) -> list:
        root = dom.parse(html)
        profile, confidence, signals = features.page_type(root, url)
        found = metadata.metadata(root, year)
        head = root.first("title") or root.first("h1")
        title = dom.flat(head.text()) if head is not None else ""
        source = len(dom.flat(dom.body_of(root).text()))
        pool = page_ops.pool(root, url, profile, adapters)
        made = [
            {"place": i, "source": c.source, "markdown": repair.normalize_headings(repair.repair_fences(convert.to_markdown(c.node, preset))), "confidence": float(c.confidence), "processing_ms": None, "f": c.features}
            for i, c in enumerate(pool)
        ]
        return [(page_id, url, title or url, profile, confidence, signals, found["published"], found["updated"], found["byline"], source, made, int(whole), html if keep_html else None)]

    return of


def extract(pages: DataFrame, captured_at: str, mode: str = "balanced", slider: int = 55, preset: str = "standard", as_of_year: int = 2026, max_chars: int | None = None, keep_html: bool = False, adapters: list[page_ops.Adapter] | None = None) -> DataFrame:
    """One row per page: title, page type, the winning source and its Markdown below a citation, metadata and quality.

    The kernel parses each page once and emits its candidates; scores, ranking, citation, warnings and quality are
    column expressions over them. Null and empty pages give a Markdown of nothing but citation and heading. Pages are
    read whole, however long, unless max_chars cuts their markup; then the column `warnings` says which were cut. With
    keep_html the markup comes along as `html`, for `assess`. Site adapters other than the registered ones can be given.
    """
    given = pages
    if max_chars is not None:
        given = pages.select("page_id", "url", T.truncate(F.col("html"), max_chars).alias("html"), F.coalesce(F.length("html"), F.lit(0)).alias("whole"))
    parsed = per_page(given, PAGE + ", whole int, html string", _page(as_of_year, preset, keep_html, adapters), () if max_chars is None else ("whole",))
    mode_, slider_ = F.lit(mode), F.lit(slider)
    w = S.weights(mode_, slider_)

    def scored(c: Column) -> Column:
        f = c["f"]
        feed = S.feed_like(f["repeated"], f["anchors"], f["forms"], f["density"])
        base = S.candidate_score(f, F.col("n_source"), f["density"], S.default_penalty(f), feed, f["forms"] >= 3, F.col("w"))
        total = base + S.source_bonus(c["source"], c["confidence"]) + S.profile_bonus(F.col("profile"), f, c["source"])
        score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))
        return F.struct((-score).alias("a"), (-S.default_retention(f)).alias("b"), S.default_penalty(f).alias("c"), c["place"].alias("d"), c["source"].alias("source"), c["markdown"].alias("markdown"))

    viable = F.filter("candidates", lambda c: (c["f"]["text_length"] > 0) & (c["f"]["text_length"] >= F.least(S.min_length(F.col("n_source"), mode_, slider_), F.col("n_source"))))
    some = F.filter("candidates", lambda c: c["f"]["text_length"] > 0)
    pool = F.when(F.size(viable) > 0, viable).otherwise(some)
    ranked = parsed.withColumn("w", w).withColumn("pool", pool).withColumn("ranked", F.array_sort(F.transform("pool", scored)))
    best = ranked.withColumn("best", F.get("ranked", F.lit(0)))
    light = M.light_canonical(F.coalesce("best.markdown", F.lit("")), F.col("title"), text_pass(repair.strip_ui_noise))
    delivered = best.withColumn("body", light)
    cited = M.cite_first(F.col("body"), F.col("title"), F.col("url"), F.lit(captured_at), T.content_hash(F.col("body")), F.col("published"), F.col("updated"), F.col("byline"))
    cut = F.when(F.col("whole") > (max_chars or 0), F.array(F.format_string(f"Content truncated from %d to {max_chars} characters", "whole"))).otherwise(F.array().cast("array<string>"))
    more = ([cut.alias("warnings")] if max_chars is not None else []) + (["html"] if keep_html else [])
    return delivered.select(
        "page_id",
        "url",
        "title",
        U.host(F.col("url")).alias("host"),
        "profile",
        F.col("confidence").alias("profile_confidence"),
        F.coalesce("best.source", F.lit("none")).alias("winner"),
        F.round(-F.col("best.a"), 6).alias("score"),
        F.size("ranked").cast("long").alias("n_candidates"),
        F.transform(F.slice("ranked", 1, 5), lambda c: c["source"]).alias("traces"),
        cited.alias("markdown"),
        "published",
        "updated",
        "byline",
        F.col("n_source").alias("source_chars"),
        *more,
    )


def assess(extracted: DataFrame) -> DataFrame:
    """Pages extracted with keep_html, with the quality metrics of their Markdown against the markup: one projection."""
    md, html = F.col("markdown"), F.coalesce("html", F.lit(""))
    measured = extracted.withColumns({"preserved": S.preservation(md, html), "structured": S.structure(md, html), "formatted": S.markdown_quality(md), "readable": S.readability(md), "complete": S.completeness(md)})
    overall = S.overall(F.col("preserved"), F.col("structured"), F.col("formatted"), F.col("readable"), F.col("complete.score"))
    return measured.withColumn("overall", overall).withColumn("grade", S.grade(F.col("overall"))).drop("html")


def text_pass(function: Callable[[str], str]):
    """A pass over Markdown as an Arrow-batched column function."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else function(t) for t in texts], dtype=object)

    return run


def pass_with_title(function: Callable[[str, str], str]):
    @pandas_udf("string")
    def run(texts: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else function(t, n or "") for t, n in zip(texts, titles, strict=True)], dtype=object)

    return run


def _stateful(md: str) -> str:
    for one in (repair.strip_ui_code, repair.technical_blocks, repair.repair_fences, repair.fence_escaped_html, repair.repair_fences, repair.tighten):
        md = one(md)
    return md


def canonicalise(md: Column, title: Column) -> Column:
    """The long chain of passes: column expressions around Arrow passes for those that carry state or try many patterns a line."""
    head = M.spacing(M.strip_media(text_pass(repair.strip_ui_noise)(M.sanitize(M.strip_citation(M.strip_highlight(M.unwrap_fence(T.normalize_unicode_spaces(md))))))))
    whole = M.strip_navigation(text_pass(_stateful)(head))
    tail = M.strip_ui_noise(M.merge_headings(M.inline_code_spacing(M.token_boundaries(M.collapse_words(whole)))))
    return M.primary_heading(M.strip_footer(tail), title)


def post_process(md: Column, contents: bool = False, blank: int = 2) -> Column:
    """The post-processing chain: spaces, headings, lists, code, links, images, blank lines, contents, cleanup."""
    first = text_pass(lambda t: repair.tighten(repair.bulletize(repair.normalize_headings(t))))(M.unescape_leading(M.cleanup_spaces(md)))
    out = M.limit_blank(M.images(M.links(M.code_blocks(M.fix_lists(first)))), blank)
    return M.final_cleanup(M.contents_table(out) if contents else out)
