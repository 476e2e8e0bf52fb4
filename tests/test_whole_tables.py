"""Operators shown on authored markup also run over whole tables, and nothing cuts a page."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions import dom, page_ops
from pagemill.functions import text as T
from pagemill.operators import kernel
from pagemill.plans import catalog
from pagemill.plans.more_queries import WHOLE


def folder(spark, path):
    rows = [(i, f"https://github.com/a/b{i}", f"<body><div><p>page {i} posted 10:30 IST Nov 5, 2025 by x</p></div></body>") for i in range(7)] + [(7, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("whole") / "t")


@pytest.mark.parametrize("name", [*sorted(WHOLE.values()), "md_github_headings_pages"])
def test_every_page_comes_back(spark, path, name):
    assert sorted(r["page_id"] for r in catalog.queries()[name](spark, path).collect()) == list(range(8))


def test_scores_of_times_of_pages(spark, path):
    assert {r["page_id"] for r in catalog.queries()["ts_score_pages"](spark, path).collect()} == set(range(7))


def test_long_pages_are_read_whole(spark):
    page = "<body><article><h1>Head</h1>" + "<p>words of a paragraph</p>" * 45_000 + "<p>the last words</p></article></body>"
    pages = spark.createDataFrame([(1, "https://a.example/", page)], "page_id long, url string, html string")
    assert len(page) > 1_000_000
    last = kernel.per_page(pages, "page_id long, tail string", lambda i, u, h: [(i, h[-41:])]).first()["tail"]
    assert "the last words" in last


def test_cut_on_request_is_said(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", "<article><p>" + "some words " * 30 + "</p><p>end</p></article>"), (2, "https://a.example/2", "<p>short</p>")], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in kernel.extract(pages, "2026-01-02T03:04:05.000Z", max_chars=200).collect()}
    assert rows[1]["warnings"] == ["Content truncated from 366 to 200 characters"] and "end" not in rows[1]["markdown"] and rows[2]["warnings"] == []
    assert "end" in kernel.extract(pages, "2026-01-02T03:04:05.000Z").filter("page_id = 1").first()["markdown"]


def test_semi_joins_by_the_whole_rule(spark, tmp_path):
    heads = ["the red house by the sea", "A sea, a house and a red boat", "Red", "xxthe red house by the seayy", "other words", "", "ab cd ef gh ij kl mn op", "the 9 z"]
    items = ["the red house by the sea", "b cd ef gh ij kl mn o", "tiny boats", "said the 9"]
    spark.createDataFrame([(i, h + "\nboats") for i, h in enumerate(heads)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, h + "\nmore") for i, h in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = spark.createDataFrame([(i, h, g) for i, h in enumerate(heads) for g in items], "i long, a string, b string")
    a, b = T.normalize_heading(F.col("a")), T.normalize_heading(F.col("b"))
    want = {r["i"] for r in plain.filter(T.headings_equivalent(a, b)).collect()}
    got = [r["doc_id"] for r in catalog.queries()["heading_equivalent_semi_join"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and {0, 1, 3, 6} <= want and 4 not in want
    found = {r["doc_id"]: r["n"] for r in catalog.queries()["token_contains_all_semi"](spark, str(tmp_path)).collect()}
    assert found[0] == 2 and found[5] == 1


@pytest.fixture(scope="module")
def lookup_folder(spark, tmp_path_factory):
    rng, path = random.Random(5), str(tmp_path_factory.mktemp("lookups"))
    words = ["red", "sea", "house", "by", "a", "boat", "ñandú", "harbour", "light", "hour", "ours", "of"]
    line = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "x", "7"]) for _ in range(n))
    texts = [line(rng.randrange(1, 7)) + "\n" + line(5) for _ in range(150)] + ["abcdef" * 9, "a a a by", "red red red", "", " ", None, "!!", "x" * 300 + "harbour" + "y" * 300]
    items = [line(rng.randrange(1, 9)) + "\t" + line(2) + "\n" + line(3) for _ in range(25)] + ["bcdef" + "abcdef" * 4, "", None, "red of a by", "red   red"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:9])], "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def lookup_want(spark, path):
    docs, items = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    head = T.normalize_heading(F.get(F.split("text", "\n"), F.lit(0)))
    pairs = docs.select("doc_id", head.alias("a")).crossJoin(items.select(head.alias("b")))
    same = sorted(r["doc_id"] for r in pairs.filter(T.headings_equivalent(F.col("a"), F.col("b"))).select("doc_id").distinct().collect())
    words = {w for r in items.collect() for w in re.split(r"[ \t\n]+", r["text"] or "") if len(w) > 3}
    return same, {r["doc_id"]: sum(w in (r["text"] or "") for w in words) for r in docs.collect()}


@pytest.mark.parametrize("block", [500_000, 300])
def test_equivalent_headings_one_pass(spark, lookup_folder, block, monkeypatch):
    monkeypatch.setattr("pagemill.operators.lookups.BLOCK_BYTES", block)
    frame = catalog.queries()["heading_equivalent_semi_join"](spark, lookup_folder)
    want, _ = lookup_want(spark, lookup_folder)
    assert sorted(r["doc_id"] for r in frame.collect()) == want and 20 < len(want) < 160
    assert not re.search("Join|Generate", frame._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("block", [500_000, 100])
def test_words_inside_one_pass(spark, lookup_folder, block, monkeypatch):
    monkeypatch.setattr("pagemill.operators.lookups.BLOCK_BYTES", block)
    frame = catalog.queries()["token_contains_all_semi"](spark, lookup_folder)
    _, want = lookup_want(spark, lookup_folder)
    assert {r["doc_id"]: r["n"] for r in frame.collect()} == want and frame.count() == len(want) and max(want.values()) > 9
    assert not re.search("Join|Generate", frame._jdf.queryExecution().executedPlan().toString())


def test_a_service_extracts_and_failures_give_nothing(spark):
    import http.server
    import json
    import threading

    from pagemill.sources import extractors

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            broken = "bad" in asked["html"]
            self.send_response(500 if broken else 200)
            self.end_headers()
            self.wfile.write(b"" if broken else json.dumps({"success": True, "markdown": f"# {asked['url']}"}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    pages = spark.createDataFrame([(1, "u", "<p>x</p>"), (2, "v", "bad"), (3, None, None)], "page_id long, url string, html string")
    ask = extractors.http_provider(f"http://127.0.0.1:{server.server_port}/", 5)
    assert {r["page_id"]: r["provided"] for r in extractors.provided(pages, ask).collect()} == {1: "# u", 2: None, 3: "# "}
    server.shutdown()
    picked = spark.createDataFrame([("l", 60.0, "r"), ("l", 70.0, "r"), ("l", 10.0, None)], "a string, s double, b string").select(extractors.chosen(F.col("a"), F.col("s"), F.col("b")).alias("v")).collect()
    assert [r["v"] for r in picked] == ["r", "l", "l"]


def test_settings_of_any_kind_are_read(spark):
    from pagemill.sources.settings import migrate

    raws = [None, "", "{broken", "[]", "{}", '{"mode":"ai","settingsSchemaVersion":3,"user":{"id":"a"},"processing":{"slider":40}}', '{"mode":"ai","settingsSchemaVersion":3,"user":{"id":"a"},"processing":{"slider":40},"credits":5}']
    rows = spark.createDataFrame(list(enumerate(raws)), "i long, raw string").select("i", migrate(F.col("raw"), F.col("i")).alias("s")).collect()
    said = {r["i"]: r["s"] for r in rows}
    assert all(said[i]["mode"] == "offline" and said[i]["migrated"] and said[i]["user_id"].startswith("anon_") for i in range(5))
    assert said[5]["mode"] == "ai" and said[5]["user_id"] == "a" and not said[5]["migrated"] and said[6]["migrated"]


def test_poll_publishes_states(spark, tmp_path):
    import time

    from pagemill.streaming import events

    spark.createDataFrame([(1.0, "error"), (900.0, "view")], "value double, kind string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    stream, got = events.stream_table(spark, str(tmp_path), "events"), []
    query = events.poll(events.health(stream, "ts", "value", "kind"), lambda rows, n: got.extend(rows.collect()), f"{tmp_path}/state")
    until = time.time() + 60
    while not got and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert got and got[0]["n"] == 2 and got[0]["errors"] == 1 and got[0]["health"] == "critical"


PARAGRAPH = "A sentence of some length, with a comma, that says what a page of this kind would say. "


def test_pool_holds_adapters_landing_pages_and_forum_posts():
    sources = lambda html, url, profile, adapters=None: [x.source for x in page_ops.pool(dom.parse(html), url, profile, adapters)]
    thread = f'<body><div class="thread"><p>{PARAGRAPH * 3}</p></div></body>'
    assert sources(thread, "", "generic")[0] == "adapter:thread" and "adapter:thread" not in sources(thread, "", "generic", [])
    own = page_ops.Adapter("own", lambda root, url: "own.example" in url, lambda root: root.first("p"))
    assert sources(thread, "https://own.example/", "generic", [own])[0] == "adapter:own"
    chips = f'<body><h1>Ann</h1><p>{PARAGRAPH * 2}</p><span class="chip">sql</span></body>'
    assert sources(chips, "", "landing-page")[0] == "landing" and "landing" not in sources(chips, "", "article")
    assert sources("<body><p>short</p></body>", "", "landing-page")[0] != "landing"
    forum = f'<body><div class="post"><div class="post-body">{PARAGRAPH}</div></div><div class="post comment">{PARAGRAPH}</div><div class="post">x</div></body>'
    assert [x for x in sources(forum, "", "forum") if x == "generic:forum-main"] == ["generic:forum-main"]


def test_extract_takes_given_adapters_to_the_workers(spark):
    own = page_ops.Adapter("own", lambda root, url: True, lambda root: root.first("section"))
    html = f"<html><head><title>T</title></head><body><section><p>{PARAGRAPH * 6}</p></section></body></html>"
    pages = spark.createDataFrame([(1, "https://own.example/a", html)], "page_id long, url string, html string")
    assert kernel.extract(pages, "T", adapters=[own]).first()["winner"] == "adapter:own"
