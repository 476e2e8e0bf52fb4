"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import decontamination, html_wrappers, jaccard_join, language_id, line_dedup, pseudonyms, quality_rules, segmentation, sharding, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, found string, samples string, counts string, kinds string, label string, keys string, shard string, _id string, _hash string, _gone string, _hit string, _lang string, _done string, _host string, _wrapper string, _parts string"
LONG = "the cat sat on the mat. " * 4000
ROWS = [
    (1, "the quick brown fox\njumps over it", "en", "a"),
    (1, "the quick brown fox\njumps over it", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t \n", "en", None),
    (5, LONG, "en", "b"),
    (5, "another text under the same id", "en", "b"),
    (None, "a text without an id", "en", "b"),
    (None, None, None, None),
    (6, "x" * 30_000, "en", "b"),
    (9, "m@" + "a." * 20_000 + " 1." * 9000 + "|" * 9000, "en", "b"),
    (7, "1234 5678 !!! 99", "de", "c"),
    (10, "<div>" * 3000 + "deep" + '<a title="foo>x</a>' * 300, "en", "https://a.example/"),
    (11, "l" * 65 + "@x.com " + "b" * 64 + "c" * 5000, "en", "b"),
    (8, "émoji 😀 und ß, 中文 字\u0000 done", "de", "c"),
]
RANKS = token_counts.load_ranks(f"{token_counts.TOKENIZERS}/byte_bpe_50k.tiktoken")
MODEL = segmentation.read_model()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *["clash"] * 17) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "a text without an id"), (2, None), (None, "quick brown fox"), (3, "")], "item_id long, text string")


def operators(docs, bench):
    return {
        "rules": lambda d: quality_rules.apply_rules(d),
        "sharding": lambda d: sharding.interleave(d.select("doc_id", "source", "shard"), ["doc_id"]),
        "pseudonyms": lambda d: pseudonyms.pseudonymise(d),
        "language": lambda d: language_id.identify(d, language_id.fit(d)),
        "lines": lambda d: line_dedup.dedup_lines(d),
        "segmentation": lambda d: segmentation.encode_samples(d, MODEL),
        "overlaps": lambda d: decontamination.find_overlaps(d, bench),
        "decontaminate": lambda d: decontamination.decontaminate(d, bench),
        "tokens": lambda d: token_counts.attribute_tokens(d, RANKS),
        "jaccard": lambda d: jaccard_join.jaccard_classes(d),
        "html": lambda d: html_wrappers.extract(d.withColumnRenamed("text", "html").withColumnRenamed("source", "url")),
    }


NAMES = ["rules", "sharding", "pseudonyms", "language", "lines", "segmentation", "overlaps", "tokens", "jaccard", "html"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_comes_back(spark, docs, bench, name):
    made = operators(docs, bench)
    rows = made[name](docs).collect()
    assert len(rows) == len(ROWS)


@pytest.mark.parametrize("name", [*NAMES, "decontaminate"])
def test_empty_tables(spark, docs, bench, name):
    made = operators(docs, bench)
    assert made[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["rules", "pseudonyms", "language", "lines", "segmentation", "overlaps", "decontaminate", "tokens", "html"])
@pytest.mark.parametrize("blocks", [False, True])
def test_columns_of_any_name_stay(spark, docs, bench, name, blocks, monkeypatch):
    if blocks and name not in ("overlaps", "decontaminate", "html"):
        pytest.skip("one path only")
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 2 if blocks else 10**6)
    monkeypatch.setattr(html_wrappers, "BROADCAST_BYTES", 0 if blocks else 16 << 20)
    out = operators(docs, bench)[name](docs)
    made = {"rules": "counts", "segmentation": "samples", "overlaps": "found", "tokens": "tokens", "pseudonyms": "kinds"}.get(name)
    kept = [c for c in docs.columns if dict(docs.dtypes)[c] == "string" and c not in ("text", "lang", "source", made)]
    assert set(kept) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert all(r[c] == "clash" for r in out.select(*kept).collect() for c in kept)


def test_sharding_handles_clashing_names(spark, docs):
    rows = sharding.interleave(docs.select("doc_id", "source", "shard"), ["doc_id"], n_shards=5).collect()
    assert sorted(r["slot"] for r in rows if r["shard"] == 0) == list(range(len([r for r in rows if r["shard"] == 0])))


def test_defined_results_of_nulls(spark, docs, bench):
    rules = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    assert rules[2]["counts"]["n_words"] == 0 and rules[2]["base_failed"] and not rules[2]["kept"]
    assert pseudonyms.pseudonymise(docs).filter("doc_id = 2").first()["text"] is None
    assert segmentation.encode_samples(docs, MODEL).filter("doc_id = 2").first()["samples"]["ids"] == [[]]
    assert token_counts.attribute_tokens(docs, RANKS).filter("doc_id = 2").first()["tokens"]["n_tokens"] == 0
    found = {(r["doc_id"], r["text"]): r["found"] for r in decontamination.find_overlaps(docs, bench).collect()}
    assert found[(2, None)]["n_words"] == 0 and found[(None, "a text without an id")]["items"] == ["1"]
    assert found[(1, ROWS[0][1])]["items"] == [""]
    lines = {(r["doc_id"], r["n_chars"]): r for r in line_dedup.dedup_lines(docs).collect()}
    assert lines[(2, 0)]["text"] is None and lines[(3, 0)]["text"] == ""


def test_jaccard_of_nulls_and_repeats(spark, docs):
    rows = jaccard_join.jaccard_classes(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by[1]] == [1, 1]
    assert by[2][0]["n_shingles"] == 0 and by[2][0]["component_id"] == 2
    assert sorted(r["n_shingles"] for r in by[None]) == [0, 1]
    assert all(r["component_id"] is None for r in by[None])
    assert [r["component_id"] for r in by[6]] == [6]


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_pipeline_stages_on_edges(spark, docs, bench, at, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    given = docs.select("doc_id", "text", "lang", "source", "n_chars")
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, given, str(tmp_path))
    rows = out.collect()
    if at < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == given.columns and 0 < len(rows) <= len(ROWS)
    else:
        assert len(rows) == len(ROWS)
    assert stage(spark, given.limit(0), str(tmp_path)).collect() == []
    extra = given.withColumn("component_id", F.lit(1))
    assert set(stage(spark, extra, str(tmp_path)).columns) >= {"doc_id"}
