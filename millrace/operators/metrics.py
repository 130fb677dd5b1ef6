"""Aggregates over items, samples, usage and logs."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import ordering


def distribution(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """Count, mean, population deviation, least, greatest, median and nearest-rank 95th percentile."""
    v = F.col(value)
    return df.groupBy(*groups).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std_dev"),
        F.min(v).alias("least"),
        F.max(v).alias("greatest"),
        F.percentile(v, F.lit(0.5)).alias("median"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)").alias("p95"),
    )


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, bin_start, bin_end, n): equal widths, the last bin closed; one bin if all values are equal."""
    bounds = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins)
    # One row of bounds, broadcast.
    placed = df.join(F.broadcast(bounds), F.lit(True)).select(F.when(width.isNull(), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    last = F.when(F.col("hi") > F.col("lo"), bins - 1).otherwise(0)
    frame = bounds.where("lo IS NOT NULL").select("lo", "hi", width.alias("width"), F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    step = F.coalesce("width", F.lit(0.0))
    edges = frame.select("bin", (F.col("lo") + F.col("bin") * step).alias("bin_start"), F.when(F.col("bin") == last, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * step).alias("bin_end"))
    return edges.join(counts, "bin", "left").select("bin", "bin_start", "bin_end", F.coalesce("n", F.lit(0)).alias("n"))


def time_buckets(samples: DataFrame, ts_ms: Column, bucket_ms: int, *values: str, groups: tuple[str, ...] = (), order: Sequence[str] = ()) -> DataFrame:
    """Averages of ``values`` by bucket of ``bucket_ms`` milliseconds, with the bucket's ISO label.

    With ``order`` a bucket's values are added one by one in the order of these columns (equal ones by
    value), as a sum of doubles depends on its order: the averages are the same however rows are dealt
    out. Without it they are added in any order, combined before the shuffle.
    """
    bucket = (F.floor(ts_ms / bucket_ms) * bucket_ms).cast("bigint")
    label = F.date_format(F.timestamp_millis("bucket"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if not order:
        rows = samples.groupBy(*groups, bucket.alias("bucket")).agg(F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values))
        return rows.withColumn("label", label)
    slim = samples.select(*groups, bucket.alias("bucket"), F.struct(*order).alias("_order"), *(F.col(v).cast("double").alias(v) for v in values))
    by = Window.partitionBy(*groups, "bucket").orderBy("_order", *values)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    added = slim.select(*groups, "bucket", F.row_number().over(by).alias("_at"), *(f(v).over(so_far).alias(f"_{n}_{v}") for v in values for n, f in (("sum", F.sum), ("n", F.count))))
    last = added.groupBy(*groups, "bucket").agg(F.max("_at").cast("bigint").alias("n"), *(F.max_by(F.col(f"_sum_{v}") / F.nullif(F.col(f"_n_{v}"), F.lit(0)), "_at").alias(v) for v in values))
    return last.withColumn("label", label)


def session_aggregates(samples: DataFrame, session: str, *values: str) -> DataFrame:
    """Averages and counts by session."""
    return samples.groupBy(session).agg(F.count("*").alias("n"), *(F.avg(v).alias(f"avg_{v}") for v in values))


def peaks(samples: DataFrame, *values: str) -> DataFrame:
    """Average, to two decimals, and peak of each value, over all samples."""
    return samples.agg(*(F.round(F.avg(v), 2).alias(f"avg_{v}") for v in values), *(F.max(v).alias(f"peak_{v}") for v in values))


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Cost, tokens and calls by provider, by provider and model, and by UTC day, in one pass."""
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = usage.withColumn("day", day)
    grouped = rows.groupingSets([[F.col("provider")], [F.col("provider"), F.col("model")], [F.col("day")]], "provider", "model", "day").agg(
        F.grouping_id("provider", "model", "day").alias("gid"),
        F.round(F.sum("cost"), 6).alias("total_cost"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count("*").alias("n"),
    )
    level = F.when(F.col("gid") == 3, "provider").when(F.col("gid") == 1, "model").otherwise("daily")
    key = F.when(F.col("gid") == 3, F.col("provider")).when(F.col("gid") == 1, F.concat_ws("/", "provider", "model")).otherwise(F.col("day"))
    return grouped.select(level.alias("level"), key.alias("key"), "total_cost", "input_tokens", "output_tokens", "n")


def usage_summary(usage: DataFrame, provider: str | None = None, model: str | None = None, start=None, end=None) -> DataFrame:
    """Totals of the usage that matches the given filters, which reach the scan."""
    for column, value in (("provider", provider), ("model", model)):
        usage = usage if value is None else usage.where(F.col(column) == value)
    usage = usage if start is None else usage.where(F.col("ts") >= start)
    usage = usage if end is None else usage.where(F.col("ts") <= end)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    return usage.agg(zero("cost"), zero("input_tokens"), zero("output_tokens"), F.count("*").alias("n"))


#: Prices a thousand tokens where no tier is known.
DEFAULT_PRICE = (0.03, 0.06, "USD")


def priced(calls: DataFrame, tiers: DataFrame) -> DataFrame:
    """Adds the price of each call: of its provider and model, else the provider's first, else the default.

    ``tiers`` (position, provider, model, input_per_1k, output_per_1k, currency) is a price list;
    Spark broadcasts it if it is as small as such lists are.
    """
    exact = tiers.groupBy("provider", "model").agg(F.min_by(F.struct("input_per_1k", "output_per_1k", "currency"), "position").alias("exact"))
    first = tiers.groupBy("provider").agg(F.min_by(F.struct("input_per_1k", "output_per_1k", "currency"), "position").alias("first"))
    default = F.struct(F.lit(DEFAULT_PRICE[0]).alias("input_per_1k"), F.lit(DEFAULT_PRICE[1]).alias("output_per_1k"), F.lit(DEFAULT_PRICE[2]).alias("currency"))
    joined = calls.join(exact, ["provider", "model"], "left").join(first, "provider", "left")
    return joined.withColumn("price", F.coalesce("exact", "first", default)).drop("exact", "first")


def cost(tokens: Column) -> Column:
    """Estimated cost of as many tokens in as out, at the row's ``price``."""
    return tokens / 1000 * F.col("price.input_per_1k") + tokens / 1000 * F.col("price.output_per_1k")


def chain_hash(*parts: Column) -> Column:
    """SHA-256 of a log entry's parts."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def verify_chain(log: DataFrame, order: str, body: Column, prev: str = "prev_hash", own: str = "hash") -> DataFrame:
    """One row: whether every entry's hash is that of its body and follows the one before; else the first break."""
    rows = log.select(F.col(order).alias("seq"), (F.col(own) != body).alias("altered"), F.col(prev).alias("prev"), F.col(own).alias("own"))
    chained = ordering.lagged(ordering.in_ranges(rows, ["seq"]), "own", "before")
    chained = ordering.with_before(chained, _rows=(F.count("*"), "sum"))
    place = F.col("_rows") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    broken = F.when(F.col("altered") | ((place > 0) & (F.col("prev") != F.col("before"))), place)
    return chained.agg(F.count("*").alias("entries"), F.min(broken).cast("bigint").alias("broken_at")).withColumn("valid", F.col("broken_at").isNull())


def djb2(text: Column) -> Column:
    """32-bit rolling hash (times 33 plus the character), in hexadecimal."""
    step = lambda h, c: (h * 33 + F.ascii(c)) % (1 << 32)
    value = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(5381).cast("bigint"), step)
    return F.lower(F.hex(value))


def failure_streaks(calls: DataFrame, provider: str, order: list, failed: Column, limit: int = 3) -> DataFrame:
    """Adds the number of failures in a row up to each call, and whether that makes the provider unhealthy.

    A streak is the distance to the last call that did not fail, or to the provider's first one, in
    the order of all calls; so calls of one provider are spread over many tasks.
    """
    rows = ordering.numbered(calls.withColumn("_failed", failed), [provider, *order], "_n")
    rows = rows.withColumn("_reset", F.when(~F.col("_failed"), F.col("_n")))
    placed = ordering.running_max(ordering.in_ranges(rows, ["_n"]), "_reset", "_last")
    start = placed.groupBy(provider).agg(F.min("_n").alias("_first")).withColumnRenamed(provider, "_provider")
    joined = placed.join(start, F.col(provider).eqNullSafe(F.col("_provider")))
    streak = F.col("_n") - F.greatest(F.coalesce("_last", F.lit(0)), F.col("_first") - 1)
    own = [c for c in calls.columns]
    return joined.select(*own, streak.cast("bigint").alias("streak"), (streak >= limit).alias("unhealthy"))


def normal_answer(answer: Column) -> Column:
    """An answer in lower case, without stops at its end and runs of blanks; JSON objects and lists with sorted keys."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(answer)), r"[.,!?\n\r]+$", ""), r"\s+", " ")

    @F.pandas_udf("string")
    def sorted_json(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            try:
                return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return text

        for s in parts:
            yield s.map(one)

    # Only what looks like an object or a list leaves the JVM with anything to do.
    return F.when(F.rlike(bare, F.lit(r"^[\[{]")), sorted_json(bare)).otherwise(bare)


def vote_distribution(samples: DataFrame, question: str, position: str, answer: str) -> DataFrame:
    """(question, normal, n, first, shown): how often each normalised answer was given, where first, and in which words then."""
    rows = samples.withColumn("_normal", normal_answer(F.col(answer)))
    return rows.groupBy(question, F.col("_normal").alias("normal")).agg(F.count("*").alias("n"), F.min(position).alias("first"), F.min_by(answer, position).alias("shown"))


def votes(samples: DataFrame, question: str, position: str, answer: str) -> DataFrame:
    """Majority of normalised answers by question: winner (first seen of equals), its count, share and how many differ."""
    counts = vote_distribution(samples, question, position, answer)
    return counts.groupBy(question).agg(
        F.max_by("shown", F.struct("n", -F.col("first"))).alias("winner"),
        F.max("n").alias("votes"),
        F.sum("n").alias("samples"),
        F.count("*").alias("distinct_answers"),
    ).withColumn("confidence", F.col("votes") / F.col("samples"))


def response_score(text: Column, tokens: Column) -> Column:
    """Heuristic score of a response: length, JSON, keys, apologies."""
    n = F.length(F.coalesce(text, F.lit("")))
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    one = lambda c, k: F.when(c, k).otherwise(0)
    shape = F.when(parsed.isNull(), one(F.rlike(text, F.lit('"instruction"|"input"|"output"')), 10)).when(kind.startswith("ARRAY"), 20).when(kind.startswith("OBJECT") | (kind == "VOID"), 15).otherwise(0)
    return one(n > 0, 10) + one(n > 50, 10) + one(n > 200, 5) + F.coalesce(shape, F.lit(0)) + one((tokens > 0) & (tokens < n), 5) - one(F.rlike(text, F.lit("(?i)error|sorry|cannot|unable")), 20) - one(F.trim(text) == "", 50)


def _first_by(df: DataFrame, keys: list, order: Column) -> DataFrame:
    """The row of each key that is least in ``order``, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def _best_first(score: Column, *order) -> Column:
    """An order with the greatest score first, null last, then ``order``."""
    return F.struct(score.isNull().alias("a"), (-score).alias("b"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))


def best_of(results: DataFrame, prompt: str, position: str, score: str) -> DataFrame:
    """The result with the greatest score for each prompt, the first of equals."""
    return _first_by(results, [prompt], _best_first(F.col(score), position))


def few_shot(examples: DataFrame, k: int, order: str, kind: str | None = None) -> DataFrame:
    """The ``k`` best examples with different inputs, none missing quality last; ties by ``order``."""
    rows = examples if kind is None else examples.where(F.col("processing_type") == kind)
    quality = F.coalesce("quality_score", F.lit(0.0))
    once = _first_by(rows, ["input"], _best_first(quality, order))
    return once.orderBy(quality.desc(), order).limit(k)


def filter_graded(graded: DataFrame, threshold: float, order: str, least: int = 0) -> DataFrame:
    """Adds accepted: scores from ``threshold``, and if these are fewer than ``least`` the best of the others.

    Only the ``least`` best rows are ordered; the last of them is the bound that all others are held against.
    """
    ok = F.col("score") >= threshold
    good = F.coalesce(ok, F.lit(False))
    if least <= 0:
        return graded.withColumn("accepted", good)
    place = F.struct((~good).alias("a"), F.col("score").isNull().alias("b"), (-F.col("score")).alias("c"), F.col(order).alias("d"))
    best = graded.select(place.alias("_place")).orderBy("_place").limit(least)
    # One row.
    bound = best.agg(F.max("_place").alias("_bound"))
    return graded.join(F.broadcast(bound), F.lit(True)).withColumn("accepted", good | F.coalesce(place <= F.col("_bound"), F.lit(False))).drop("_bound")


def grade_rates(filtered: DataFrame) -> DataFrame:
    """One row of :func:`filter_graded`: items, accepted, the shares of both, and the mean score."""
    n = F.count("*")
    share = lambda c: F.when(n > 0, F.count_if(c) / n).otherwise(0.0)
    return filtered.agg(n.alias("items"), F.count_if("accepted").alias("accepted"), share(F.col("accepted")).alias("acceptance_rate"), share(~F.col("accepted")).alias("filter_rate"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"))


def few_shot_buffer(examples: DataFrame, order: str, least_quality: float = 0.0, size: int = 20) -> DataFrame:
    """The examples that a buffer of ``size`` holds after all were offered in order.

    Blank inputs, outputs and kinds and those below the quality are refused, as are inputs that were
    accepted before; the oldest go. An input that left the buffer is still one that was accepted.
    """
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    good = filled(F.col("input")) & filled(F.col("output")) & filled(F.col("processing_type")) & (F.col("quality_score").isNull() | (F.col("quality_score") >= least_quality))
    return last_n(_first_by(examples.where(good), ["input"], F.col(order)), [order], size)


def latest(df: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key, combined before the shuffle."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def last_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """The last ``n`` rows: what a ring buffer of that size holds."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def worst_status(checks: DataFrame, status: str = "status") -> DataFrame:
    """Overall health: the worst of all states."""
    rank = F.when(F.col(status) == "unhealthy", 2).when(F.col(status) == "degraded", 1).otherwise(0)
    return checks.agg(F.coalesce(F.max_by(status, rank), F.lit("healthy")).alias("status"))
