"""Records of runs, logs, samples and providers: filters, statistics, rates, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import half_up
from millrace.operators import ordering

#: Levels of a log, from the least.
LEVELS = ("debug", "info", "warn", "error")


def logged(logs: DataFrame, level: str | None = None, module: str | None = None, least: str | None = None) -> DataFrame:
    """Entries of a level, of a module, or of a level and those above it; unknown levels rank below all."""
    if level is not None:
        logs = logs.where(F.col("level") == level)
    if module is not None:
        logs = logs.where(F.col("module") == module)
    if least is not None:
        logs = logs.where(F.col("level").isin(*LEVELS[LEVELS.index(least) :]))
    return logs


def samples_between(samples: DataFrame, ts: str, start=None, end=None, **equal) -> DataFrame:
    """Samples within a range of time, both ends included, with the given values in other columns; all of it reaches the scan."""
    for column, value in equal.items():
        samples = samples.where(F.col(column) == value)
    samples = samples if start is None else samples.where(F.col(ts) >= start)
    return samples if end is None else samples.where(F.col(ts) <= end)


def latency_percentiles(calls: DataFrame, latency: str, failed: Column, *groups: str) -> DataFrame:
    """Nearest-rank p50, p95 and p99 of successful calls, their rounded mean, range, and counts of both kinds."""
    good = F.when(~failed, F.col(latency))
    rows = calls.select(*groups, good.alias("_v"), failed.alias("_failed"))
    at = lambda p: F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY _v)"), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.groupBy(*groups).agg(
        F.count("*").alias("samples"),
        *(at(p / 100).cast("double").alias(f"p{p}") for p in (50, 95, 99)),
        zero(half_up(F.avg("_v"))).cast("bigint").alias("mean"),
        zero(F.min("_v")).cast("double").alias("least"),
        zero(F.max("_v")).cast("double").alias("greatest"),
        F.count("_v").alias("successes"),
        F.count_if("_failed").alias("errors"),
    )


#: Counts over which a run is warned of.
WARN_ITEMS, WARN_CHUNKS, WARN_TOKENS = 100_000, 500, 500_000


def run_report(chunks: DataFrame, *groups: str) -> DataFrame:
    """Statistics of runs from their chunks (failed, tokens, prompt_tokens, latency_ms, ts_ms).

    Tokens a second are 0 for runs of under 100 milliseconds. Rounding is half up.
    """
    rows = chunks.groupBy(*groups).agg(
        F.count("*").alias("chunks"),
        F.count_if(~F.col("failed")).alias("successes"),
        F.count_if("failed").alias("failures"),
        F.sum("tokens").alias("tokens"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        half_up(F.avg("latency_ms")).cast("bigint").alias("mean_latency_ms"),
        (F.max("ts_ms") - F.min("ts_ms")).alias("elapsed_ms"),
    )
    rate = F.when(F.col("elapsed_ms") >= 100, half_up(F.col("tokens") / (F.col("elapsed_ms") / 1000))).otherwise(0).cast("bigint")
    listed = F.array(F.when(F.col("chunks") > WARN_CHUNKS, "chunks"), F.when(F.col("prompt_tokens") > WARN_TOKENS, "tokens"))
    success = half_up(F.col("successes") / F.col("chunks") * 100).cast("bigint")
    return rows.withColumn("success_rate", success).withColumn("tokens_per_second", rate).withColumn("warnings", F.array_join(F.filter(listed, lambda x: x.isNotNull()), ","))


def pipeline_totals(files: DataFrame) -> DataFrame:
    """One row from (items, failed, tokens, ts_ms): items, files that went well and that failed, tokens, time."""
    return files.agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.count_if(~F.col("failed")).alias("files_ok"),
        F.count_if("failed").alias("files_failed"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.max("ts_ms") - F.min("ts_ms"), F.lit(0)).alias("elapsed_ms"),
    )


def rates(totals: DataFrame, ts_ms: str, *values: str) -> DataFrame:
    """Adds a rate a second for each running total, from the capture before; 0 in the first and where no time has passed."""
    placed = ordering.in_ranges(totals, [ts_ms])
    for name in (ts_ms, *values):
        placed = ordering.lagged(placed, name, f"_b_{name}")
    seconds = (F.col(ts_ms) - F.col(f"_b_{ts_ms}")) / 1000
    out = placed.withColumns({f"{v}_per_second": F.when(seconds > 0, half_up((F.col(v) - F.col(f"_b_{v}")) / seconds)).otherwise(0).cast("bigint") for v in values})
    return out.select(*totals.columns, *(f"{v}_per_second" for v in values))


def run_history(runs: DataFrame, order: str, most: int = 100) -> DataFrame:
    """The latest runs, the newest first."""
    return runs.orderBy(F.desc(order)).limit(most)


def status_counts(runs: DataFrame, status: str = "status") -> DataFrame:
    """How many runs are in each state, and their mean duration and pass rate."""
    return runs.groupBy(status).agg(F.count("*").alias("runs"), F.avg("duration_ms").alias("mean_duration_ms"), F.avg("pass_rate").alias("mean_pass_rate"))


#: Names of the headers that tell of limits.
HEADERS = {
    "limit": ("x-ratelimit-limit", "ratelimit-limit", "x-rate-limit-limit", "rate-limit-limit"),
    "remaining": ("x-ratelimit-remaining", "ratelimit-remaining", "x-rate-limit-remaining", "rate-limit-remaining"),
    "reset": ("x-ratelimit-reset", "ratelimit-reset", "x-rate-limit-reset", "rate-limit-reset"),
    "retry": ("retry-after", "x-retry-after"),
    "used": ("x-ratelimit-used", "ratelimit-used", "x-rate-limit-used"),
}


def rate_limits(headers: Column, now_ms: Column) -> Column:
    """Struct (limit, remaining, reset_at, retry_after) of a map of headers, whatever the case of their names.

    A reset is seconds from now, or seconds or milliseconds of the epoch, by its size; a time to retry
    after is seconds or a date, and overrides the reset.
    """
    named = lambda name: F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name), 0)["value"]
    text = {k: F.coalesce(*map(named, names)) for k, names in HEADERS.items()}
    number = {k: c.try_cast("double") for k, c in text.items()}
    limit = F.when(number["limit"] >= 0, number["limit"]).otherwise(0.0)
    left = F.when(number["remaining"] >= 0, number["remaining"]).when(number["used"].isNotNull() & (limit > 0), F.greatest(F.lit(0.0), limit - number["used"])).otherwise(0.0)
    reset = F.when(number["reset"] <= 1e6, now_ms + number["reset"] * 1000).when(number["reset"] < 1e10, number["reset"] * 1000).otherwise(number["reset"])
    date = F.unix_millis(F.try_to_timestamp(F.regexp_replace(text["retry"], "^[A-Za-z]+, ", ""), F.lit("d MMM yyyy HH:mm:ss z")))
    retry = F.coalesce(number["retry"], F.greatest(F.lit(0.0), F.ceil((date - now_ms) / 1000).cast("double")))
    at = F.coalesce(now_ms + number["retry"] * 1000, date.cast("double"), reset, F.lit(0.0))
    return F.struct(limit.alias("limit"), left.alias("remaining"), at.cast("double").alias("reset_at"), F.when(text["retry"].isNotNull(), retry).alias("retry_after"))


def admitted(calls: DataFrame, provider: str, ts_ms: str, per_minute: int = 60, burst: int = 10) -> DataFrame:
    """(provider, ts_ms, wait_ms): how long each call of a provider waits for a token bucket that refills steadily.

    A call takes a token when there is one, else it waits until there is; so the n-th token is there
    ``n - burst`` refills after the bucket was last full. Providers are streamed, with one number of state.
    """
    from millrace.operators.planning import _in_order

    gap = 60_000 / per_minute

    def step(due: float, now: int) -> tuple[float, tuple]:
        # ``due`` is when the bucket would be full again; full buckets don't save time.
        due = max(due, float(now))
        start = max(float(now), due - (burst - 1) * gap)
        return due + gap, (int(start - now + 0.5),)

    return _in_order(calls, provider, ts_ms, F.col(ts_ms).cast("bigint"), "wait_ms bigint", lambda: 0.0, step)
