"""Queries over records of runs, calls and logs, made of the events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import export, generate, metrics, planning, privacy, records
from millrace.operators.ordering import numbered
from millrace.plans.registry import query, table


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))



@query("SELECT event_id FROM events WHERE event_id % 4 >= 2 AND event_type = 'click'")
def log_entries(spark, sf_dir):
    """Warnings and errors of one module."""
    n = F.col("event_id") % 4
    level = F.when(n == 0, "debug").when(n == 1, "info").when(n == 2, "warn").otherwise("error")
    logs = _events(spark, sf_dir).select("event_id", level.alias("level"), F.col("event_type").alias("module"))
    return records.logged(logs, module="click", least="warn").select("event_id")


@query(r"""SELECT event_id, sha256(event_id || ',' || event_type || ',' || CASE WHEN regexp_matches(props, '[,"\n\r]') THEN '"' || replace(props, '"', '""') || '"' ELSE props END) AS csv, sha256('{"event_id":' || event_id || ',"event_type":' || to_json(event_type) || ',"props":' || to_json(props) || '}') AS jsonl FROM events""")
def log_export(spark, sf_dir):
    """Entries of a log as lines of CSV and of JSON."""
    columns = ["event_id", "event_type", "props"]
    log = _events(spark, sf_dir).select(*columns)
    kinds = [export.log_lines(log, columns, k).withColumnRenamed("line", k) for k in ("csv", "jsonl")]
    by_id = [kinds[0].select(F.regexp_extract("csv", r"^(\d+)", 1).cast("bigint").alias("event_id"), "csv"), kinds[1].select(F.get_json_object("jsonl", "$.event_id").cast("bigint").alias("event_id"), "jsonl")]
    return by_id[0].join(by_id[1], "event_id").select("event_id", F.sha2("csv", 256).alias("csv"), F.sha2("jsonl", 256).alias("jsonl"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-09 12:00:00' AND user_id = 7")
def samples_of_session(spark, sf_dir):
    """Samples of one session within a range of time; both reach the scan."""
    events = table(spark, sf_dir, "events")
    kind = events.schema["ts"].dataType
    at = lambda s: F.lit(s).cast(kind)
    return records.samples_between(events, "ts", at("2024-01-05 00:00:00"), at("2024-01-09 12:00:00"), user_id=7).select("event_id")


@query("SELECT DISTINCT user_id FROM events")
def sessions(spark, sf_dir):
    return _events(spark, sf_dir).select("user_id").distinct()


@query("""SELECT event_type, count(*)::BIGINT AS samples, quantile_disc(value, 0.5) FILTER (WHERE value >= 3) AS p50, quantile_disc(value, 0.95) FILTER (WHERE value >= 3) AS p95, quantile_disc(value, 0.99) FILTER (WHERE value >= 3) AS p99,
floor(avg(value) FILTER (WHERE value >= 3) + 0.5)::BIGINT AS mean, min(value) FILTER (WHERE value >= 3) AS least, max(value) AS greatest, count(*) FILTER (WHERE value >= 3)::BIGINT AS successes, count(*) FILTER (WHERE value < 3)::BIGINT AS errors FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return records.latency_percentiles(_events(spark, sf_dir), "value", F.coalesce(F.col("value") < 3, F.lit(False)), "event_type")


@query("""WITH r AS (SELECT user_id, count(*)::BIGINT AS chunks, count(*) FILTER (WHERE value >= 3)::BIGINT AS successes, count(*) FILTER (WHERE value < 3)::BIGINT AS failures, sum(event_id % 100)::BIGINT AS tokens, sum(event_id % 50)::BIGINT AS prompt_tokens,
floor(avg(value) + 0.5)::BIGINT AS mean_latency_ms, (max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000)))::BIGINT AS elapsed_ms FROM events GROUP BY user_id)
SELECT *, floor(successes / chunks * 100 + 0.5)::BIGINT AS success_rate, CASE WHEN elapsed_ms >= 100 THEN floor(tokens / (elapsed_ms / 1000) + 0.5) ELSE 0 END::BIGINT AS tokens_per_second,
concat_ws(',', CASE WHEN chunks > 500 THEN 'chunks' END, CASE WHEN prompt_tokens > 500000 THEN 'tokens' END) AS warnings FROM r""")
def run_report(spark, sf_dir):
    chunks = _events(spark, sf_dir).select("user_id", F.coalesce(F.col("value") < 3, F.lit(False)).alias("failed"), (F.col("event_id") % 100).alias("tokens"), (F.col("event_id") % 50).alias("prompt_tokens"), F.col("value").alias("latency_ms"), F.col("ms").alias("ts_ms"))
    return records.run_report(chunks, "user_id")


@query("SELECT sum(event_id % 10)::BIGINT AS items, count(*) FILTER (WHERE value >= 3)::BIGINT AS files_ok, count(*) FILTER (WHERE value < 3)::BIGINT AS files_failed, sum(event_id % 100)::BIGINT AS tokens, (max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000)))::BIGINT AS elapsed_ms FROM events")
def pipeline_totals(spark, sf_dir):
    files = _events(spark, sf_dir).select((F.col("event_id") % 10).alias("items"), F.coalesce(F.col("value") < 3, F.lit(False)).alias("failed"), (F.col("event_id") % 100).alias("tokens"), F.col("ms").alias("ts_ms"))
    return records.pipeline_totals(files)


@query("""WITH t AS (SELECT (epoch_us(ts) // 1000) AS ms, max(event_id) * 100 AS tokens FROM events GROUP BY 1), b AS (SELECT ms, tokens, lag(ms) OVER o AS bm, lag(tokens) OVER o AS bt FROM t WINDOW o AS (ORDER BY ms))
SELECT ms, tokens, CASE WHEN ms > bm THEN floor((tokens - bt) / ((ms - bm) / 1000) + 0.5) ELSE 0 END::BIGINT AS tokens_per_second FROM b""")
def capture_rates(spark, sf_dir):
    """Tokens a second between captures of a running total."""
    totals = _events(spark, sf_dir).groupBy("ms").agg((F.max("event_id") * 100).alias("tokens"))
    return records.rates(totals, "ms", "tokens")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100")
def run_history(spark, sf_dir):
    return records.run_history(_events(spark, sf_dir), "event_id").select("event_id")


@query("SELECT event_type AS status, count(*)::BIGINT AS runs, round(avg(value), 6) AS mean_duration_ms, round(avg(event_id % 101), 6) AS mean_pass_rate FROM events GROUP BY 1")
def run_statuses(spark, sf_dir):
    runs = _events(spark, sf_dir).select(F.col("event_type").alias("status"), F.col("value").alias("duration_ms"), (F.col("event_id") % 101).alias("pass_rate"))
    return records.status_counts(runs).withColumns({c: F.round(c, 6) for c in ("mean_duration_ms", "mean_pass_rate")})


@query("""SELECT event_id, (event_id % 100)::DOUBLE AS "limit", CASE event_id % 3 WHEN 0 THEN event_id % 50 WHEN 1 THEN greatest(0, event_id % 100 - event_id % 50) ELSE 0 END::DOUBLE AS remaining,
CASE event_id % 4 WHEN 0 THEN 1704067200000 + 30000 WHEN 1 THEN 1704067260000 WHEN 2 THEN 1704067290000 ELSE 1704067200000 + 5000 END::DOUBLE AS reset_at, CASE WHEN event_id % 4 = 3 THEN 5.0::DOUBLE END AS retry_after FROM events""")
def rate_limit_headers(spark, sf_dir):
    """Limits in all the forms that headers give them."""
    n = F.col("event_id")
    text = lambda c: c.cast("string")
    left = F.when(n % 3 == 0, "X-RateLimit-Remaining").when(n % 3 == 1, "ratelimit-used").otherwise("other")
    reset = F.when(n % 4 == 0, "30").when(n % 4 == 1, "1704067260").when(n % 4 == 2, "1704067290000").otherwise("60")
    headers = F.map_from_arrays(F.array(F.lit("Rate-Limit-Limit"), left, F.lit("x-ratelimit-reset"), F.when(n % 4 == 3, "Retry-After").otherwise("none")), F.array(text(n % 100), text(n % 50), reset, F.lit("5")))
    return _events(spark, sf_dir).select("event_id", records.rate_limits(headers, F.lit(1_704_067_200_000)).alias("r")).select("event_id", "r.*")


@query("""WITH RECURSIVE c AS (SELECT event_type, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000)) AS i FROM events WHERE (epoch_us(ts) // 1000) < 1704067200000 + 36000000),
f AS (SELECT event_type, 0::BIGINT AS i, NULL::BIGINT AS ms, 0::DOUBLE AS due, 0::DOUBLE AS start FROM (SELECT DISTINCT event_type FROM c)
      UNION ALL SELECT event_type, i, ms, greatest(due, ms) + 900000, greatest(ms, greatest(due, ms) - 900000) FROM (SELECT c.event_type, c.i, c.ms, f.due FROM f JOIN c ON c.event_type = f.event_type AND c.i = f.i + 1))
SELECT event_type, ms, floor(start - ms + 0.5)::BIGINT AS wait_ms FROM f WHERE i > 0""")
def limiter_waits(spark, sf_dir):
    """How long calls wait for a bucket of two tokens that refills every quarter of an hour."""
    calls = _events(spark, sf_dir).where("ms < 1704067200000 + 36000000").select("event_type", "ms")
    return records.admitted(calls, "event_type", "ms", per_minute=60_000 / 900_000, burst=2)


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500")
def log_tail(spark, sf_dir):
    return metrics.last_n(_events(spark, sf_dir), ["event_id"], 500).select("event_id")


@query("""WITH e AS (SELECT event_id, user_id, value FROM events WHERE value >= 20), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM e)
SELECT event_id FROM f WHERE r = 1 ORDER BY event_id DESC LIMIT 20""")
def few_shot_buffer(spark, sf_dir):
    examples = _events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("input"), F.lit("answer").alias("output"), F.col("event_type").alias("processing_type"), F.col("value").alias("quality_score"))
    return metrics.few_shot_buffer(examples, "event_id", 20.0).select("event_id")


@query("""WITH t AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) || '!!' ELSE event_type END AS a, event_id FROM events)
SELECT user_id, lower(rtrim(a, '!')) AS normal, count(*)::BIGINT AS n, min(event_id) AS first, arg_min(a, event_id) AS shown FROM t GROUP BY user_id, 2""")
def vote_distribution(spark, sf_dir):
    """How often each answer was given, however it was written."""
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.upper("event_type"), F.lit("!!"))).otherwise(F.col("event_type"))
    return metrics.vote_distribution(_events(spark, sf_dir).withColumn("answer", answer), "user_id", "event_id", "answer")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"a":[1,{"c":3,"d":4}],"b":' || event_id || '}' WHEN 1 THEN 'yes no' ELSE '[2,1]' END AS normal FROM events""")
def normal_answers(spark, sf_dir):
    """Answers as they are compared: JSON by sorted keys, other text by its words."""
    n = F.col("event_id")
    answer = F.when(n % 3 == 0, F.concat(F.lit('{"b": '), n.cast("string"), F.lit(', "A": [1, {"d": 4, "c": 3}]}'))).when(n % 3 == 1, "  Yes   no.!\n").otherwise("[2, 1]")
    return _events(spark, sf_dir).select("event_id", metrics.normal_answer(answer).alias("normal"))


@query("SELECT count(*)::BIGINT AS n, round(sum(value), 4) AS total_cost FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10 00:00:00'")
def usage_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    usage = events.select(F.col("event_type").alias("provider"), F.lit("m").alias("model"), "ts", F.col("value").alias("cost"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    out = metrics.usage_summary(usage, provider="click", start=F.lit("2024-01-10 00:00:00").cast(events.schema["ts"].dataType))
    return out.select("n", F.round("total_cost", 4).alias("total_cost"))


@query("SELECT CASE WHEN max(value) > 95 THEN 'unhealthy' WHEN max(value) > 50 THEN 'degraded' ELSE 'healthy' END AS status FROM events")
def health(spark, sf_dir):
    checks = _events(spark, sf_dir).select(F.when(F.col("value") > 95, "unhealthy").when(F.col("value") > 50, "degraded").otherwise("healthy").alias("status"))
    return metrics.worst_status(checks)


@query("SELECT event_id, risk_class FROM (SELECT event_id, 'pii' AS risk_class, ts FROM events WHERE value >= 50) WHERE ts >= TIMESTAMP '2024-01-21 00:00:00' AND event_id % 10 <> 0")
def quarantine_after_purge(spark, sf_dir):
    """What a quarantine holds after old rows were purged and some were released."""
    rows = _events(spark, sf_dir).select("event_id", (F.col("value") / 100).alias("risk"), F.lit("pii").alias("risk_class"), F.col("ts").cast("timestamp").alias("at"))
    held = privacy.quarantine(rows, 0.5, F.col("at"))
    kept = privacy.purge(held, F.lit("2024-01-31 00:00:00").cast("timestamp"), 10)
    return privacy.released(kept, rows.where("event_id % 10 = 0").select("event_id"), "event_id").select("event_id", "risk_class")


@query("SELECT event_id FROM events WHERE value >= 50 ORDER BY ts DESC, event_id DESC LIMIT 50")
def quarantine_list(spark, sf_dir):
    """The page of a quarantine that is shown first."""
    rows = _events(spark, sf_dir).select("event_id", (F.col("value") / 100).alias("risk"), F.lit("pii").alias("risk_class"), F.col("ts").cast("timestamp").alias("at"))
    return privacy.listed(privacy.quarantine(rows, 0.5, F.col("at")), "event_id").limit(50).select("event_id")


@query("SELECT event_id, (row_number() OVER (ORDER BY value DESC, event_id DESC))::BIGINT AS place FROM events")
def files_sorted_by_size(spark, sf_dir):
    """Every file's place in a list by size, largest first."""
    return numbered(_events(spark, sf_dir).select("event_id", "value"), [F.desc("value"), F.desc("event_id")], "place").select("event_id", F.col("place").cast("bigint").alias("place"))


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 10 OFFSET 20")
def third_page(spark, sf_dir):
    return planning.page(_events(spark, sf_dir), ["event_id"], 3).select("event_id")


@query("SELECT event_id FROM events ORDER BY md5(event_id || ':42'), event_id LIMIT 25")
def seeded_sample(spark, sf_dir):
    return planning.sample(_events(spark, sf_dir), F.col("event_id"), 25).select("event_id")


@query("SELECT event_id, md5(event_id || ':7') AS h FROM events WHERE md5(event_id || ':7') < '19999999'")
def event_sample(spark, sf_dir):
    """A tenth of the events, the same for the same seed."""
    return planning.share(_events(spark, sf_dir).select("event_id"), F.col("event_id"), 0.1, 7).select("event_id", F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":7"))).alias("h"))


@query("SELECT user_id, count(*)::BIGINT AS flagged FROM events WHERE value >= 90 GROUP BY user_id ORDER BY flagged DESC, user_id LIMIT 10")
def top_issues(spark, sf_dir):
    flagged = _events(spark, sf_dir).where("value >= 90").groupBy("user_id").agg(F.count("*").alias("flagged"))
    return flagged.orderBy(F.desc("flagged"), "user_id").limit(10)


@query("SELECT * FROM (VALUES ('a', 1), ('c', 2)) t(provider, priority)")
def eligible_providers(spark, sf_dir):
    """Providers in a region with a scope, by priority."""
    rows = [("b", 3, ["us"], ["chat"]), ("a", 1, ["eu", "us"], ["chat"]), ("c", 2, ["eu"], ["chat", "embed"]), ("d", 0, ["eu"], ["embed"])]
    providers = spark.createDataFrame(rows, "provider string, priority int, regions array<string>, scopes array<string>")
    return planning.eligible(providers, ["eu"], "chat").select("provider", "priority")


@query("SELECT * FROM (VALUES ('de-AT', 'qa', 'de', 'D'), ('fr', 'qa', 'en', 'E'), ('de', 'chat', 'en', 'C')) t(locale, kind, used, body)")
def templates(spark, sf_dir):
    """The template of each locale and kind: its own, its language's, else the English one."""
    known = spark.createDataFrame([("en", "qa", "E"), ("de", "qa", "D"), ("en", "chat", "C")], "locale string, kind string, body string")
    return planning.template_for(known, spark.createDataFrame([("de-AT", "qa"), ("fr", "qa"), ("de", "chat")], "locale string, kind string"))


@query("""WITH RECURSIVE q AS (SELECT event_type AS label, min(event_id) AS at FROM events GROUP BY 1)
SELECT label, CASE WHEN contains(label, 'lic') THEN 1000 - (length(label) - 3) ELSE -1 END AS score FROM q WHERE contains(label, 'lic')""")
def command_search(spark, sf_dir):
    """Event types as commands, found by a part of their name, the best first."""
    labels = _events(spark, sf_dir).groupBy(F.col("event_type").alias("label")).agg(F.min("event_id").alias("at"))
    return planning.fuzzy_ranked(labels, "lic", ["label"], "at").where("score > 900").select("label", "score")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'q' ELSE '' END || 'n' AS calls, 1::BIGINT AS n FROM documents WHERE false UNION ALL SELECT 0, 'offline', count(*)::BIGINT FROM documents")
def cached_generation(spark, sf_dir):
    """Generation with a warm cache: half of the prompts come from it and none is generated twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("prompt"), F.lit("m").alias("model"))
    first = generate.generate(docs.where("doc_id % 2 = 0"), generate.Offline())
    cache = planning.warmed(first, "key", "response")
    out = generate.generate(docs, generate.Offline(), cache=cache)
    good = out.where((F.col("from_cache") == (F.col("doc_id") % 2 == 0)) & F.col("error").isNull() & F.col("response").isNotNull())
    return good.agg(F.lit(0).cast("bigint").alias("doc_id"), F.lit("offline").alias("calls"), F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN t < 50 THEN 'n<1K' WHEN t < 100 THEN '1K<n<10K' ELSE '10K<n<100K' END AS size FROM (SELECT doc_id, n_chars % 150 AS t FROM documents)")
def size_categories(spark, sf_dir):
    n = F.when(F.col("n_chars") % 150 < 50, 999).when(F.col("n_chars") % 150 < 100, 9_999).otherwise(10_000)
    return table(spark, sf_dir, "documents").select("doc_id", T.size_label(n).alias("size"))
