"""Ranking, metrics, caches and streams on small tables."""

import random

from pyspark.sql import functions as F

from pagemill.operators import kernel, metrics, ranking, stateful
from pagemill.streaming import events as E

CANDIDATES = "page int, place int, source string, score double, retention double, penalty int, processing_ms double, text_length int"


def test_ranking_ties(spark):
    rows = [(1, 0, "b", 5.0, 0.5, 1, None, 9), (1, 1, "a", 5.0, 0.5, 1, 3.0, 9), (1, 2, "c", 5.0, 0.6, 9, None, 9), (1, 3, "d", 9.0, 0.0, 0, 0.0, 0), (1, 4, "a", 5.0, 0.5, 1, 3.0, 9)]
    out = ranking.rank_candidates(spark.createDataFrame(rows, CANDIDATES), "page").orderBy("rank").collect()
    assert [r["place"] for r in out] == [2, 1, 4, 0]


def test_traces_force_the_first_adapter(spark):
    rows = [(1, i, "adapter:x" if i in (6, 7) else f"s{i}", 10.0 - i, 0.0, 0, 0.0, 9) for i in range(9)]
    out = ranking.traces(ranking.rank_candidates(spark.createDataFrame(rows, CANDIDATES), "page"), "page").first()["traces"]
    assert out == ["s0", "s1", "s2", "s3", "adapter:x"]


def test_nth_values_are_exact(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.choice([1, 2, 2, 2, 1000]) * rng.random() if g else 7)) for g in (0, 1, 2) for _ in range(501)] + [(3, 5.0), (4, None)]
    out = metrics.nth_values(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", {"a": 0.0, "b": 0.5, "c": 0.95}).collect()
    for r in out:
        values = sorted(v for g, v in rows if g == r["g"] and v is not None)
        assert [r["a"], r["b"], r["c"]] == [values[int(len(values) * f)] for f in (0.0, 0.5, 0.95)]
    assert {r["g"] for r in out} == {0, 1, 2, 3}


def test_nth_values_without_groups(spark):
    out = metrics.nth_values(spark.range(101).select(F.col("id").cast("double").alias("v")), [], "v", {"p50": 0.5}).first()
    assert out["p50"] == 50


def test_snapshot_diff_and_report(spark):
    schema = "file string, content string"
    a, b = (metrics.corpus_summary(spark.createDataFrame(rows, schema), "file", "content").filter("file IS NOT NULL") for rows in ([("a", "x"), ("b", "x\ny"), ("c", "")], [("a", "x"), ("b", "x"), ("d|", "é")]))
    diff = metrics.snapshot_diff(a, b)
    assert {r["file"]: (r["status"], r["bytes_delta"], r["lines_delta"]) for r in diff.collect()} == {"a": ("unchanged", 0, 0), "b": ("changed", -2, -1), "c": ("removed", 0, 0), "d|": ("added", 2, 1)}
    assert {r["status"]: r["rows"] for r in metrics.report(diff).collect()}["added"] == "| d\\| | added | 2 | 1 |"


def test_trend_and_growth(spark):
    rows = [(g, i, float(i * 10 if g else 5)) for g in (0, 1) for i in range(10)]
    frame = spark.createDataFrame(rows, "g int, i int, v double")
    assert {r["g"]: r["trend"] for r in metrics.trend(frame, ["g"], ["i"], "v").collect()} == {0: "stable", 1: "improving"}
    assert {r["g"]: r["leaks"] for r in metrics.growth(frame, ["g"], ["i"], "v").collect()} == {0: False, 1: True}


def test_decrement_and_quota(spark):
    rows = [("u", "k1", 1, 60), ("u", "k1", 2, 60), ("u", "k2", 3, 60), ("u", "k3", 4, 60)]
    out = stateful.decrement_once(spark.createDataFrame(rows, "who string, key string, at int, amount int"), "who", "key", "amount", ["at"], 150.0).orderBy("at").collect()
    assert [(r["key"], r["accepted"], r["left"]) for r in out] == [("k1", True, 90.0), ("k2", True, 30.0), ("k3", False, None)]


def test_range_join_of_nodes(spark):
    pages = spark.createDataFrame([(1, "u", "<div><p>a</p><div><p>b</p></div></div><p>c</p>")], "page_id long, url string, html string")
    rows = kernel.nodes(pages)
    outer = rows.filter("tag = 'div'").select("page_id", F.col("pre").alias("a"), F.col("post").alias("b"))
    assert rows.filter("tag = 'p'").join(outer, "page_id").filter("pre > a AND post < b").count() == 3


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 10}:00:00", i % 4, "ab"[i % 2], float(i)) for i in range(60)]
    frame = spark.createDataFrame(rows, "event_id int, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    stream = lambda: E.stream_table(spark, str(tmp_path), "events", 1)
    limited = E.drain(E.rate_limit(stream(), "user_id", "ts", 3600, 1, "30 days"), "update", ["user_id", "start"])
    batch = stateful.rate_limit(frame, "user_id", "ts", 3600, 1).select("user_id", "start", "n", "limited")
    assert sorted(map(tuple, limited.collect())) == sorted(map(tuple, batch.collect()))
    assert E.drain(E.distinct_within(stream(), ["user_id", "event_type"], "ts", "30 days"), "append").count() == frame.select("user_id", "event_type").distinct().count()
    quota = {(r["who"], r["day"]): (r["used"], r["refused"]) for r in E.drain(E.daily_quota(stream(), "user_id", "ts", 2), "update", ["who", "day"]).collect()}
    want = {(r["user_id"], r["day"]): (min(2, r["n"]), max(0, r["n"] - 2)) for r in frame.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert quota == want
    assert E.drain(E.sessions(stream(), "user_id", "ts", "1 hour", "30 days"), "complete").agg(F.sum("n")).first()[0] == 60


def test_quota_lets_go_of_days_behind_the_watermark(spark, tmp_path):
    for i, day in enumerate(("2024-01-01", "2024-01-20", "2024-01-21", "2024-01-25")):
        spark.sql(f"SELECT 1L AS who, timestamp'{day} 10:00:00' AS ts FROM range(3)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema("who long, ts timestamp").parquet(str(tmp_path / "in"))
        seen = {}
        keep = lambda batch, _: seen.update({r["day"]: (r["used"], r["refused"]) for r in batch.collect()})
        run = E.daily_quota(rows, "who", "ts", 2, "1 day").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
        run.awaitTermination()
        assert seen == {day: (2, 1)}
        assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == (1, 1, 2, 1)[i]
