"""The pipeline stage by stage against plain versions, and as a whole."""

import random
import re

import pytest

import corpus_pipeline
from pagemill.llm import decontamination, line_dedup, segmentation
from tests.llm.test_operators import near_copies, plain_components, plain_hits, plain_lines, text_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    docs = [t for _, t in near_copies(rng, 10)]
    passage = text_of(rng, 60)
    item = text_of(rng, 25)
    docs += [text_of(rng, 40) + "\n" + passage + "\n" + text_of(rng, 40) for _ in range(4)]
    docs += [text_of(rng, 80) + " " + item + " " + text_of(rng, 80), item, "12345 !!!", passage, text_of(rng, 5000)]
    rng.shuffle(docs)
    return [(i, t, "en" if i % 5 else None, "s", len(t)) for i, t in enumerate(docs)], [("1", item), ("2", text_of(rng, 12))], passage


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus[0], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(corpus[1], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_language_stage(spark, corpus, folder):
    out = STAGES["language_id"](spark, spark.createDataFrame(corpus[0], SCHEMA), folder)
    assert rows_of(out) == {i: t for i, t, *_ in corpus[0] if re.search("[a-z]", t, re.I)}
    assert out.filter("lang IS NULL").count() == 0


def test_line_stage(spark, corpus, folder):
    docs = [(i, t) for i, t, *_ in corpus[0]]
    want = {i: t for (i, _), t in zip(docs, plain_lines(docs, line_dedup.WINDOW, line_dedup.LONG), strict=True) if t.strip()}
    out = STAGES["line_dedup"](spark, spark.createDataFrame(corpus[0], SCHEMA), folder)
    assert rows_of(out) == want and sum(corpus[2] in t for t in want.values()) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_jaccard_stage(spark, corpus, folder):
    parts = plain_components([(i, t) for i, t, *_ in corpus[0]])
    out = STAGES["jaccard_join"](spark, spark.createDataFrame(corpus[0] + corpus[0][:3], SCHEMA), folder).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, (_, least) in parts.items() if i == least)


def test_decontamination_stage(spark, corpus, folder):
    out = rows_of(STAGES["decontamination"](spark, spark.createDataFrame(corpus[0], SCHEMA), folder))
    for i, t, *_ in corpus[0]:
        n, hit, _ = plain_hits(t, corpus[1], 10)
        if hit > 0.5 * n:
            assert i not in out
        elif hit:
            assert plain_hits(out[i], corpus[1], 10)[1] == 0 and plain_hits(out[i], corpus[1], 10)[0] == n - hit
        else:
            assert out[i] == t


def test_segmentation_stage(spark, corpus, folder):
    pieces = segmentation.Pieces(segmentation.read_model())
    texts = {i: t for i, t, *_ in corpus[0]}
    out = STAGES["segmentation"](spark, spark.createDataFrame(corpus[0], SCHEMA), folder).collect()
    assert len(out) == len(texts) and all(pieces.decode(r["ids"]) == texts[r["doc_id"]] and r["n_pieces"] == len(r["ids"]) for r in out)


def test_segmentation_stage_gives_every_sample(spark, corpus, folder):
    pieces = segmentation.Pieces(segmentation.read_model())
    texts = {i: t for i, t, *_ in corpus[0]} | {-1: "", -2: None}
    docs = spark.createDataFrame(corpus[0] + [(-1, "", "en", "s", 0), (-2, None, "en", "s", None)], SCHEMA)
    out = STAGES["segmentation"](spark, docs, folder).collect()
    for r in out:
        samples = [tuple(r["ids"]), *(tuple(x["ids"]) for x in r["others"])]
        assert len(samples) == len(set(samples)) == (segmentation.SAMPLES if texts[r["doc_id"]] else 1)
        assert all(pieces.decode(ids) == (texts[r["doc_id"]] or "") for ids in samples)
        assert all(x["n_pieces"] == len(x["ids"]) and x["log_prob"] < 0 and 0 <= x["inclusion"] <= 1 for x in r["others"])
    assert len(out) == len(texts) and segmentation.SAMPLES > 1


def test_run(spark, corpus, folder):
    pieces = segmentation.Pieces(segmentation.read_model())
    out = {r["doc_id"]: pieces.decode(r["ids"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert out and sum(corpus[2] in t for t in out.values()) <= 1
    assert all(plain_hits(t, corpus[1], 10)[1] == 0 for t in out.values())
    parts = plain_components(sorted(out.items()))
    # Cutting benchmark spans comes after the join, so only texts without them are sure to differ.
    assert all(i == least for i, (n, least) in parts.items() if n > 0)


def test_names_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "segmentation"]
    assert decontamination.BLOCK_WORDS > 0
