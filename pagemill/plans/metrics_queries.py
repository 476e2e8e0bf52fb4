"""Queries of metrics, caches, quotas and joins, over the event and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions import urls as U
from pagemill.operators import lookups
from pagemill.operators import metrics as M
from pagemill.operators import ranking as R
from pagemill.operators import stateful as S
from pagemill.plans.registry import query, table
from pagemill.plans.text_queries import sql_heading, sql_host

c = F.col


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of the pipeline: the type is the stage, the value scaled to milliseconds is the time."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", c("event_type").alias("stage"), (c("value") * 20).alias("ms"), (c("event_id") % 101).cast("double").alias("quality"), F.when(c("event_id") % 4 == 0, F.array(F.lit("body"), c("event_type"))).when(c("event_id") % 4 == 1, F.array(F.lit("body"))).otherwise(F.array().cast("array<string>")).alias("fallbacks"))


SQL_RUNS = "r AS (SELECT event_id, ts, user_id, event_type AS stage, value * 20 AS ms, (event_id % 101)::DOUBLE AS quality, CASE event_id % 4 WHEN 0 THEN ['body', event_type] WHEN 1 THEN ['body'] ELSE []::VARCHAR[] END AS fallbacks FROM events)"


@query("session_snapshot", f"WITH {SQL_RUNS} SELECT stage, count(*) AS n, floor(avg(quality) + 0.5)::BIGINT AS quality, floor(avg(ms) + 0.5)::BIGINT AS ms FROM r GROUP BY stage")
def session_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), T.js_round(F.avg("quality")).alias("quality"), T.js_round(F.avg("ms")).alias("ms"))


@query("fallback_frequency", f"WITH {SQL_RUNS} SELECT fb AS fallback, count(*) AS n FROM (SELECT unnest(fallbacks) AS fb FROM r) GROUP BY fb")
def fallback_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select(F.explode("fallbacks").alias("fallback")).groupBy("fallback").agg(F.count(F.lit(1)).alias("n"))


@query("latency_stats", f"WITH {SQL_RUNS} SELECT stage, count(*) FILTER (ms < 500) AS n_fast, count(*) FILTER (ms BETWEEN 500 AND 2000) AS n_normal, count(*) FILTER (ms > 2000) AS n_slow, round(list_sort(list(ms))[floor(count(*) * 0.5)::INT + 1], 6) AS p50, round(list_sort(list(ms))[floor(count(*) * 0.95)::INT + 1], 6) AS p95 FROM r GROUP BY stage")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latency(runs(spark, sf_dir), ["stage"], "ms").withColumns({p: F.round(p, 6) for p in ("p50", "p95")})


@query("success_rates", f"WITH {SQL_RUNS}, n AS (SELECT count(*) AS total FROM r) SELECT stage, floor(count(*) * 100.0 / max(total) + 0.5)::BIGINT AS percent FROM r, n GROUP BY stage")
def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = runs(spark, sf_dir).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("stage", M.rounded_rate(c("n"), F.sum("n").over(Window.partitionBy())).alias("percent"))


@query("metrics_range", f"WITH {SQL_RUNS} SELECT event_id, stage, ms FROM r WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AND stage = 'error'")
def metrics_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).filter((c("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (c("ts") < F.lit("2024-01-12").cast("timestamp_ntz")) & (c("stage") == "error")).select("event_id", "stage", "ms")


@query("trend_last5", f"WITH {SQL_RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ts DESC, event_id DESC) AS b FROM r), t AS (SELECT stage, avg(quality) FILTER (b <= 5) AS recent, avg(quality) FILTER (b BETWEEN 6 AND 10) AS older, count(*) FILTER (b <= 5) AS na, count(*) FILTER (b BETWEEN 6 AND 10) AS nb FROM o GROUP BY stage) SELECT stage, recent, older, CASE WHEN na >= 3 AND nb >= 2 AND recent > older + 2 THEN 'improving' WHEN na >= 3 AND nb >= 2 AND recent < older - 2 THEN 'declining' ELSE 'stable' END AS trend FROM t")
def trend_last5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.trend(runs(spark, sf_dir), ["stage"], ["ts", "event_id"], "quality")


@query("memory_efficiency", f"WITH {SQL_RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b, least(10, count(*) OVER (PARTITION BY user_id)) AS n FROM r), t AS (SELECT user_id, max(ms) AS peak, round(avg(ms), 6) AS mean, max(ms) FILTER (b = 1) AS current, avg(ms) FILTER (b <= n AND b > n - n // 2) AS a, avg(ms) FILTER (b <= n - n // 2) AS z, max(n) AS n FROM o GROUP BY user_id) SELECT user_id, peak, mean, current, round(CASE WHEN n >= 5 AND a <> 0 THEN (z - a) / a * 100 ELSE 0 END, 6) AS growth, CASE WHEN n >= 5 AND a <> 0 THEN (z - a) / a * 100 ELSE 0 END > 10 AS leaks FROM t")
def memory_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.growth(runs(spark, sf_dir), ["user_id"], ["ts", "event_id"], "ms").withColumns({"mean": F.round("mean", 6), "growth": F.round("growth", 6)})


@query("cache_metrics", f"WITH {SQL_RUNS} SELECT count(*) FILTER (stage = 'view') AS hits, count(*) FILTER (stage = 'click') AS misses, round(count(*) FILTER (stage = 'view') * 100.0 / count(*) FILTER (stage IN ('view', 'click')), 6) AS hit_rate, round(avg(ms) FILTER (stage = 'view'), 6) AS retrieval FROM r")
def cache_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, miss = c("stage") == "view", c("stage") == "click"
    sums = runs(spark, sf_dir).agg(F.count_if(hit).alias("hits"), F.count_if(miss).alias("misses"), F.avg(F.when(hit, c("ms"))).alias("retrieval"))
    return sums.select("hits", "misses", F.round(M.rate(c("hits"), c("hits") + c("misses")), 6).alias("hit_rate"), F.round("retrieval", 6).alias("retrieval"))


@query("pipeline_metrics", f"WITH {SQL_RUNS} SELECT stage, count(*) AS n, round(avg(ms), 6) AS ms, round(sum(len(fallbacks)) * 100.0 / count(*), 6) AS fallback_rate FROM r GROUP BY stage")
def pipeline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 6).alias("ms"), F.round(F.sum(F.size("fallbacks")) * 100 / F.count(F.lit(1)), 6).alias("fallback_rate"))


@query("most_used_preset", f"WITH {SQL_RUNS} SELECT stage, n FROM (SELECT stage, count(*) AS n FROM r GROUP BY stage) ORDER BY n DESC, stage LIMIT 1")
def most_used_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("stage").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "stage").limit(1)


@query("error_stats", f"WITH {SQL_RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ts DESC, event_id DESC) AS b FROM r) SELECT stage, event_id, ms FROM o WHERE b <= 10")
def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(runs(spark, sf_dir), ["stage"], ["ts", "event_id"], 10).select("stage", "event_id", "ms")


@query("performance_report", f"WITH {SQL_RUNS}, t AS (SELECT stage, avg(ms) AS ms, count(*) AS n, count(*) FILTER (quality < 5) AS bad FROM r GROUP BY stage) SELECT stage, n, bad, array_to_string(list_filter([CASE WHEN ms > 30 THEN 'Consider optimizing content extraction for better performance' END, CASE WHEN bad > n * 0.05 THEN 'High error rate detected - investigate extraction failures' END], lambda x: x IS NOT NULL), '|') AS advice FROM t")
def performance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = runs(spark, sf_dir).groupBy("stage").agg(F.avg("ms").alias("ms"), F.count(F.lit(1)).alias("n"), F.count_if(c("quality") < 5).alias("bad"))
    advice = F.array_compact(F.array(F.when(c("ms") > 30, "Consider optimizing content extraction for better performance"), F.when(c("bad") > c("n") * 0.05, "High error rate detected - investigate extraction failures")))
    return t.select("stage", "n", "bad", F.array_join(advice, "|").alias("advice"))


@query("session_metrics", f"WITH {SQL_RUNS} SELECT user_id, count(*) AS n, count(*) FILTER (stage = 'error') AS failed, round(sum(ms), 6) AS total, round(avg(quality), 6) AS quality FROM r GROUP BY user_id")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("stage") == "error").alias("failed"), F.round(F.sum("ms"), 6).alias("total"), F.round(F.avg("quality"), 6).alias("quality"))


@query("recent_n", f"WITH {SQL_RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM r) SELECT user_id, event_id FROM o WHERE b <= 20")
def recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(runs(spark, sf_dir), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id")


@query("cost_sum", "SELECT round(sum(v), 6) AS cost, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN -value ELSE value END AS v FROM events) WHERE v >= 0")
def cost_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = table(spark, sf_dir, "events").select(F.when(c("event_id") % 11 == 0, -c("value")).when(c("event_id") % 13 == 5000, float("nan")).otherwise(c("value")).alias("v"))
    return costs.filter((c("v") >= 0) & ~F.isnan("v")).agg(F.round(F.sum("v"), 6).alias("cost"), F.count(F.lit(1)).alias("n"))


@query("cost_accumulate", "SELECT date_trunc('week', ts) AS week, round(sum(value), 4) AS spend, count(*) AS n, sum(value) >= 1000 AS open FROM events WHERE value >= 0 GROUP BY 1")
def cost_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spend(table(spark, sf_dir, "events"), "ts", "value", 1000).withColumn("spend", F.round("spend", 4))


@query("circuit_breaker", "SELECT round(sum(value), 4) AS spend, sum(value) >= 100 AS open, CASE WHEN sum(value) >= 100 THEN 503 ELSE 200 END AS status FROM events WHERE value >= 0")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "events").filter("value >= 0").agg(F.sum("value").alias("t"))
    return total.select(F.round("t", 4).alias("spend"), (c("t") >= 100).alias("open"), F.when(c("t") >= 100, 503).otherwise(200).alias("status"))


@query("rate_limit_fixed_window", "SELECT user_id, time_bucket(INTERVAL 60 SECONDS, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, count(*) > 1 AS limited, greatest(1, epoch(time_bucket(INTERVAL 60 SECONDS, min(ts), TIMESTAMP '1970-01-01') + INTERVAL 60 SECONDS)::BIGINT - floor(epoch(min(ts)))::BIGINT) AS retry_after FROM events GROUP BY 1, 2")
def rate_limit_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", 60, 1)


@query("daily_quota", "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) <= 5 AS allowed FROM events")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.daily_quota(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 5).select("event_id", "user_id", "day", "allowed")


@query("entitlements", "WITH u AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'purchase') AS used FROM events GROUP BY 1, 2) SELECT user_id, day, CASE WHEN user_id % 5 = 0 THEN 'no_plan' WHEN user_id % 5 = 1 THEN 'open' WHEN user_id % 7 = 0 THEN 'busy' WHEN used >= 1 THEN 'quota' ELSE 'open' END AS state, greatest(0, 1 - used) AS remaining FROM u")
def entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(c("event_type") == "purchase").alias("used"))
    plan = F.when(c("user_id") % 5 == 0, None).when(c("user_id") % 5 == 1, "pro").otherwise("free")
    return used.select("user_id", "day", S.entitlement(plan, c("used"), F.lit(1), (c("user_id") % 7 == 0).cast("int")).alias("state"), F.greatest(F.lit(0), 1 - c("used")).alias("remaining"))


@query("outcome_view", f"WITH {SQL_RUNS} SELECT event_id, CASE WHEN stage = 'error' THEN 'failed' WHEN event_id % 10 = 0 THEN 'empty' WHEN stage = 'view' THEN 'cached' WHEN quality < 60 THEN 'poor' WHEN len(fallbacks) > 0 THEN 'warned' ELSE 'good' END AS outcome FROM r")
def outcome_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = S.outcome(c("event_id") % 10 != 0, c("stage") == "view", F.size("fallbacks"), (c("stage") == "error").cast("int"), c("quality"))
    return runs(spark, sf_dir).select("event_id", view.alias("outcome"))


@query("idempotent_dedupe", "SELECT user_id, key, event_id FROM (SELECT user_id, event_type || (event_id % 3) AS key, event_id, row_number() OVER (PARTITION BY user_id, event_type || (event_id % 3) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def idempotent_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "events").select("user_id", F.concat("event_type", (c("event_id") % 3).cast("string")).alias("key"), "ts", "event_id")
    return R.first_by(keyed, ["user_id", "key"], [c("ts"), c("event_id")]).select("user_id", "key", "event_id")


@query("idempotent_decrement", "WITH k AS (SELECT user_id, event_type || (event_id % 3) AS key, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type || (event_id % 3) ORDER BY ts, event_id) AS rn FROM events), o AS (SELECT user_id, key, event_id, sum(20) OVER (PARTITION BY user_id ORDER BY ts, event_id, key ROWS UNBOUNDED PRECEDING) AS total FROM k WHERE rn = 1) SELECT user_id, key, event_id, total <= 150 AS accepted, CASE WHEN total <= 150 THEN (150 - total)::DOUBLE END AS \"left\" FROM o")
def idempotent_decrement(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "events").select("user_id", F.concat("event_type", (c("event_id") % 3).cast("string")).alias("key"), "ts", "event_id", F.lit(20).alias("amount"))
    return S.decrement_once(keyed, "user_id", "key", "amount", ["ts", "event_id"], 150.0).select("user_id", "key", "event_id", "accepted", "left")


@query("capture_debounce", "SELECT user_id, event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR epoch_ms(ts) - epoch_ms(b) >= 3600000")
def capture_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.debounce(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3_600_000).select("user_id", "event_id")


@query("session_lifecycle", "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 HOURS THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 5 HOURS AS \"end\", count(*) AS n FROM s GROUP BY user_id, sid")
def session_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "5 hours")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("k"), c("event_id").cast("string")).alias("key"), c("value"), S.epoch_ms("ts").alias("timestamp"), (c("event_id") % 48).alias("ttl"))


SQL_ENTRIES = "e AS (SELECT 'k' || event_id AS key, value, epoch_us(ts) // 1000 AS timestamp, event_id % 48 AS ttl FROM events)"


@query("cache_expire", f"WITH {SQL_ENTRIES} SELECT key, timestamp FROM e WHERE epoch_ms(TIMESTAMP '2024-01-20') <= timestamp + ttl * 3600000")
def cache_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cache_live(entries(spark, sf_dir), S.epoch_ms(F.lit("2024-01-20").cast("timestamp_ntz")), c("ttl")).select("key", "timestamp")


@query("cache_evict_lru", f"WITH {SQL_ENTRIES} SELECT key, timestamp FROM e ORDER BY timestamp DESC, key LIMIT 100")
def cache_evict_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cache_newest(entries(spark, sf_dir)).select("key", "timestamp")


@query("telemetry_append", f"WITH {SQL_ENTRIES} SELECT key, timestamp FROM e ORDER BY timestamp DESC, key LIMIT 1000")
def telemetry_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cache_newest(entries(spark, sf_dir), 1000).select("key", "timestamp")


@query("cache_stats", f"WITH {SQL_ENTRIES} SELECT count(*) AS n, min(timestamp) AS oldest, max(timestamp) AS newest, sum(length('{{\"key\":\"' || key || '\",\"ttl\":' || ttl || '}}'))::BIGINT AS bytes FROM e")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cache_stats(entries(spark, sf_dir), "ttl").select("n", "oldest", "newest", "bytes")


@query("cache_probe", "SELECT d.doc_id, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, misses = S.cache_split(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")
    return hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("hit", F.lit(False)))


@query("dedupe_inflight", "SELECT hash, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT sha256(text) AS hash, doc_id FROM documents) GROUP BY hash")
def dedupe_inflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def summary_of(spark: SparkSession, sf_dir: str, changed: bool) -> DataFrame:
    """Documents as files, or their second version: some gone, some new, some with a line more."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc"), c("doc_id").cast("string"), F.lit(".md"))
    if changed:
        return d.filter("doc_id % 7 != 0").select(F.when(c("doc_id") % 11 == 0, F.concat(F.lit("new-"), name)).otherwise(name).alias("file"), F.when(c("doc_id") % 3 == 0, F.concat("text", F.lit("\nmore"))).otherwise(c("text")).alias("content"))
    return d.select(name.alias("file"), c("text").alias("content"))


SQL_BEFORE = "a AS (SELECT 'doc' || doc_id || '.md' AS file, text AS content FROM documents)"
SQL_AFTER = "b AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'new-' ELSE '' END || 'doc' || doc_id || '.md' AS file, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'more' ELSE text END AS content FROM documents WHERE doc_id % 7 <> 0)"
SUMMED = "SELECT file, strlen(content)::BIGINT AS bytes, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END::BIGINT AS lines, sha256(content) AS sha256 FROM"
SQL_DIFF = f"{SQL_BEFORE}, {SQL_AFTER}, sa AS ({SUMMED} a), sb AS ({SUMMED} b), diff AS (SELECT coalesce(sa.file, sb.file) AS file, CASE WHEN sa.file IS NULL THEN 'added' WHEN sb.file IS NULL THEN 'removed' WHEN sa.sha256 <> sb.sha256 THEN 'changed' ELSE 'unchanged' END AS status, coalesce(sb.bytes, 0) - coalesce(sa.bytes, 0) AS bytes_delta, coalesce(sb.lines, 0) - coalesce(sa.lines, 0) AS lines_delta FROM sa FULL JOIN sb ON sa.file = sb.file)"


@query("corpus_summary", f"WITH {SQL_BEFORE}, s AS ({SUMMED} a) SELECT * FROM s UNION ALL SELECT NULL, sum(bytes)::BIGINT, sum(lines)::BIGINT, NULL FROM s")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.corpus_summary(summary_of(spark, sf_dir, False), "file", "content")


def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (M.corpus_summary(summary_of(spark, sf_dir, x), "file", "content").filter("file IS NOT NULL") for x in (False, True))
    return M.snapshot_diff(before, after)


@query("snapshot_diff", f"WITH {SQL_DIFF} SELECT * FROM diff")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difference(spark, sf_dir)


@query("sink_report_md", f"WITH {SQL_DIFF} SELECT status, string_agg('| ' || replace(file, '|', '\\|') || ' | ' || status || ' | ' || bytes_delta || ' | ' || lines_delta || ' |', chr(10) ORDER BY file) AS rows FROM diff WHERE status <> 'unchanged' GROUP BY status")
def sink_report_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.report(difference(spark, sf_dir))


@query("manifest_check", "SELECT source AS id, count(*) AS n, count(*) > 1 AS repeated FROM documents GROUP BY source")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(c("source").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("repeated", c("n") > 1)


@query("corpus_pass_fail", "SELECT CASE WHEN q.quality = 1 THEN 'pass' ELSE 'fail' END AS status, count(*) AS n, round(avg(length(text)), 6) AS length FROM documents d JOIN labels q USING (doc_id) GROUP BY 1")
def corpus_pass_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("length")).join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy(F.when(c("quality") == 1, "pass").otherwise("fail").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("length"), 6).alias("length"))


@query("union_fallbacks", f"WITH {SQL_RUNS} SELECT event_id, array_to_string(list_distinct(list_concat(fallbacks, ['body', stage])), ',') <> '' AS some, len(list_distinct(list_concat(fallbacks, ['body', stage])))::BIGINT AS n FROM r")
def union_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array_distinct(F.concat("fallbacks", F.array(F.lit("body"), c("stage"))))
    return runs(spark, sf_dir).select("event_id", (F.array_join(both, ",") != "").alias("some"), F.size(both).cast("long").alias("n"))


TOKENS = r"regexp_split_to_array(lower({0}), '[^a-z0-9]+')"


@query("token_intersection", f"SELECT conv_id, turn, len(list_distinct(list_intersect({TOKENS.format('text')}, {TOKENS.format('prev')})))::BIGINT AS n FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS NOT NULL")
def token_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("prev IS NOT NULL")
    tokens = lambda x: F.split(F.lower(x), "[^a-z0-9]+")
    return turns.select("conv_id", "turn", F.size(F.array_intersect(tokens(c("text")), tokens(c("prev")))).cast("long").alias("n"))


@query("heading_semi_join", f"WITH d AS (SELECT doc_id, {sql_heading('string_split(text, chr(10))[1]')} AS h FROM documents), b AS (SELECT item_id, {sql_heading('string_split(text, chr(10))[1]')} AS h, string_split({sql_heading('string_split(text, chr(10))[1]')}, ' ')[1] AS w FROM benchmark) SELECT doc_id FROM d WHERE EXISTS (SELECT 1 FROM b WHERE b.w = string_split(d.h, ' ')[1] AND contains(d.h, b.w))")
def heading_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = lambda: T.normalize_heading(F.get(F.split("text", "\n"), F.lit(0)))
    docs = table(spark, sf_dir, "documents").select("doc_id", head().alias("h")).withColumn("w", F.get(F.split("h", " "), F.lit(0)))
    items = table(spark, sf_dir, "benchmark").select(F.get(F.split(head(), " "), F.lit(0)).alias("w"))
    return docs.join(items, "w", "left_semi").select("doc_id")


@query("token_contains_semi", "WITH i AS (SELECT list_distinct(list_filter(list(string_split(text, ' ')[1]), lambda x: length(x) > 3)) AS ws FROM benchmark) SELECT doc_id, len(list_filter(ws, lambda x: contains(text, x)))::BIGINT AS n FROM documents, i")
def token_contains_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of the benchmark, a bounded query set, looked up in every document."""
    words = [r["w"] for r in table(spark, sf_dir, "benchmark").select(F.get(F.split("text", " "), F.lit(0)).alias("w")).filter(F.length("w") > 3).distinct().collect()]
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.contains(c("text"), w))).cast("long").alias("n"))


@query("heading_equivalent_semi_join")
def heading_equivalent_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose first line is equivalent to the first line of a benchmark text, by the whole rule of headings."""
    heads = lambda name, *columns: table(spark, sf_dir, name).select(*columns, T.normalize_heading(F.substring_index("text", "\n", 1)).alias("h"))
    return lookups.equivalent_headings(heads("documents", "doc_id"), heads("benchmark")).select("doc_id")


@query("token_contains_all_semi")
def token_contains_all_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the benchmark of more than three letters, looked up in every document."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("w")).filter(F.length("w") > 3)
    return lookups.words_inside(table(spark, sf_dir, "documents").select("doc_id", "text"), words).select("doc_id", "n")


@query("capture_to_result", f"WITH p AS (SELECT page_id, url, sha256(url) AS h FROM pages) SELECT a.page_id, b.page_id AS other FROM p a JOIN p b ON a.h = b.h AND a.page_id < b.page_id")
def capture_to_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.sha2("url", 256).alias("h"))
    return p.join(p.select(c("page_id").alias("other"), "h"), "h").filter("page_id < other").select("page_id", "other")


@query("rule_lookup", f"WITH u AS (SELECT page_id, {sql_host('url')} AS h FROM pages), r(place, pattern, name) AS (VALUES (1, '^m\\.', 'mobile'), (2, '^blog\\.', 'blog'), (3, '^www\\.', 'web'), (4, '', 'other')) SELECT page_id, arg_min(name, place) AS rule FROM u JOIN r ON regexp_matches(h, pattern) GROUP BY page_id")
def rule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules as one CASE: the first pattern that the host matches. No theta join."""
    host = U.host(c("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(host.rlike(r"^m\."), "mobile").when(host.rlike(r"^blog\."), "blog").when(host.rlike(r"^www\."), "web").otherwise("other").alias("rule"))


PROFILE_DIM = [("standard", "auto", "clean-markdown", "standard", "standard"), ("technical", "technical", "github", "technical-documentation", "github"), ("academic", "academic", "clean-markdown", "academic-paper", "academic"), ("social", "thread", "clean-markdown", "forum-discussion", "standard"), ("obsidian", "auto", "obsidian", "standard", "obsidian"), ("notion", "auto", "notion", "standard", "notion")]


@query("profile_resolve", "WITH dim(profile, strategy, format, readability, conversion) AS (VALUES " + ", ".join(str(r) for r in PROFILE_DIM) + "), d AS (SELECT doc_id, ['standard','technical','academic','social','obsidian','notion','none'][doc_id % 7 + 1] AS profile FROM documents) SELECT doc_id, d.profile, coalesce(strategy, 'auto') AS strategy, coalesce(readability, 'standard') AS readability, coalesce(conversion, 'standard') AS conversion FROM d LEFT JOIN dim USING (profile)")
def profile_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame(PROFILE_DIM, "profile string, strategy string, format string, readability string, conversion string")
    names = F.array(*map(F.lit, [r[0] for r in PROFILE_DIM] + ["none"]))
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(names, (c("doc_id") % 7 + 1).cast("int")).alias("profile"))
    # A dimension of six rows: broadcasting it is bounded by construction.
    some = lambda name, default: F.coalesce(name, F.lit(default)).alias(name)
    return d.join(F.broadcast(dim), "profile", "left").select("doc_id", "profile", some("strategy", "auto"), some("readability", "standard"), some("conversion", "standard"))


@query("capture_policy_clamp", "SELECT doc_id, least(greatest(coalesce(CASE WHEN doc_id % 9 <> 0 THEN n_chars END, 800)::DOUBLE, 100), 5000) AS wait_ms FROM documents")
def capture_policy_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.sources.captures import clamp

    return table(spark, sf_dir, "documents").select("doc_id", clamp(F.when(c("doc_id") % 9 != 0, c("n_chars")), 100, 5000, 800).alias("wait_ms"))


@query("deep_capture_choose", "SELECT doc_id, n_chars + doc_id % 50 * 20 - 100 > n_chars AND ((doc_id % 50 * 20 - 100) / greatest(n_chars, 1) >= 0.2 OR doc_id % 4 >= 2) AS deep FROM documents")
def deep_capture_choose(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.sources.captures import keep_deep

    return table(spark, sf_dir, "documents").select("doc_id", keep_deep(c("n_chars"), c("n_chars") + c("doc_id") % 50 * 20 - 100, F.lit(0), c("doc_id") % 4).alias("deep"))


@query("config_merge", "SELECT doc_id, coalesce(nullif(lang, 'en'), 'auto') AS lang, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 500 END AS threshold, doc_id % 2 = 0 AS contents FROM documents")
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    override = F.struct(F.nullif(c("lang"), F.lit("en")).alias("lang"), F.when(c("doc_id") % 3 == 0, c("doc_id")).alias("threshold"), F.when(c("doc_id") % 2 == 0, F.lit(True)).alias("contents"))
    default = {"lang": "auto", "threshold": 500, "contents": False}
    return table(spark, sf_dir, "documents").withColumn("o", override).select("doc_id", *(F.coalesce(f"o.{k}", F.lit(v)).alias(k) for k, v in default.items()))


@query("sink_json_export", "SELECT doc_id, '{\"version\":\"1\",\"words\":' || len(regexp_split_to_array(text, '\\s+')) || ',\"chars\":' || length(text) || ',\"lang\":\"' || lang || '\"}' AS json FROM documents")
def sink_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.lit("1").alias("version"), T.split_count(c("text")).alias("words"), F.length("text").alias("chars"), c("lang"))).alias("json"))


@query("canonical_metadata", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE string_split(text, chr(10))[1] END), ''), nullif(source, 'src1'), 'Untitled Page') AS title FROM documents")
def canonical_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(some(F.when(c("doc_id") % 3 == 0, "").otherwise(F.get(F.split("text", "\n"), F.lit(0)))), F.nullif(c("source"), F.lit("src1")), F.lit("Untitled Page")).alias("title"))


@query("md_combine_chunks", "SELECT doc_id // 10 AS page, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS md, sum(n_chars)::BIGINT AS ms, min(doc_id % 7) AS quality, bool_and(doc_id % 10 < 10) AS ok FROM documents GROUP BY 1")
def md_combine_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one page are few: a page is at most a million characters, so the list of a page is bounded."""
    d = table(spark, sf_dir, "documents")
    parts = F.array_sort(F.collect_list(F.struct("doc_id", c("text").alias("md"))))
    return d.groupBy(F.floor(c("doc_id") / 10).alias("page")).agg(F.array_join(F.transform(parts, lambda p: p["md"]), "\n\n---\n\n").alias("md"), F.sum("n_chars").alias("ms"), F.min(c("doc_id") % 7).alias("quality"), F.bool_and(c("doc_id") % 10 < 10).alias("ok"))


@query("free_model", "SELECT c_custkey, c_mktsegment LIKE '%:free' OR (c_acctbal <= 0 AND c_acctbal - 10 <= 0) AS free FROM customer")
def free_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = F.array(c("c_acctbal"), c("c_acctbal") - 10)
    return table(spark, sf_dir, "customer").select("c_custkey", (c("c_mktsegment").endswith(":free") | ((F.size(prices) > 0) & F.forall(prices, lambda p: p <= 0))).alias("free"))


@query("model_parse", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def model_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("dedupe_structural_key", "SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, n_chars % 10 ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_structural_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("lang", "source", (c("n_chars") % 10).alias("n"), "doc_id")
    return R.first_by(keyed, ["lang", "source", "n"], [c("doc_id")]).select("lang", "source", "doc_id")


@query("math", "SELECT doc_id, floor(doc_id / 7 - 0.5)::BIGINT AS rounded, least(greatest(doc_id % 200, 20), 150) AS clamped, round(power(doc_id % 10, 2), 6) AS squared FROM documents")
def math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.js_round(c("doc_id") / 7 - 1).alias("rounded"), F.least(F.greatest(c("doc_id") % 200, F.lit(20)), F.lit(150)).alias("clamped"), F.round(F.pow(c("doc_id") % 10, F.lit(2)), 6).alias("squared"))
