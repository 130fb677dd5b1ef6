"""Token budgets, batches, splits, rankings of models, caches and pages.

Folds over the ordered chunks of a session stream these in order through one task, with a state of
a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import fuzzy_score
from millrace.operators.ordering import numbered
from millrace.storage import cut


@dataclass(frozen=True)
class Budget:
    """Tokens of a session: all, reserved for the prompt, and the least and most for an answer."""

    session: int = 1_000_000
    reserve: int = 8192
    most: int = 16384
    least: int = 256


def _in_order(chunks: DataFrame, session: str, order: str, value: Column, schema: str, start, step) -> DataFrame:
    """A fold over the chunks of each session, in order, that returns a row a chunk.

    Sessions are dealt to tasks and streamed in order; what is held is a session's state and a
    batch. ``step(state, value)`` returns the next state and the columns that ``schema`` adds.
    """
    rows = chunks.select(F.col(session).alias("s"), F.col(order).alias("o"), value.alias("v")).repartition("s").sortWithinPartitions("s", "o", "v")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            out = []
            for s, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if s != now:
                    now, state = s, start()
                state, row = step(state, v)
                out.append(row)
            added = [pa.array(c) for c in zip(*out, strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *added], names=["s", "o", *(f"x{i}" for i in range(len(added)))])

    columns = [c.split() for c in schema.split(", ")]
    out = rows.mapInArrow(work, f"s {kinds['s']}, o {kinds['o']}, " + ", ".join(f"x{i} {kind}" for i, (_, kind) in enumerate(columns)))
    return out.select(F.col("s").alias(session), F.col("o").alias(order), *(F.col(f"x{i}").alias(name) for i, (name, _) in enumerate(columns)))


def plan_budget(chunks: DataFrame, session: str, order: str, tokens: str, budget: Budget = Budget()) -> DataFrame:
    """(session, order, prompt_tokens, output_tokens, skipped): chunks in order take what is left.

    A chunk that nothing is left for is skipped and takes nothing, so later and smaller ones may
    still fit: a fold, not a running sum. A null number of tokens counts as none.
    """

    def step(used: int, t: int) -> tuple[int, tuple]:
        left = budget.session - used - budget.reserve - t
        out = 0 if left <= 0 else min(budget.most, max(budget.least, left))
        return (min(budget.session, used + t + out) if out else used), (t, out, out == 0)

    return _in_order(chunks, session, order, F.coalesce(F.col(tokens).cast("bigint"), F.lit(0).cast("bigint")), "prompt_tokens bigint, output_tokens bigint, skipped boolean", lambda: 0, step)


def plan_by_priority(chunks: DataFrame, session: str, order: str, tokens: str, priority: str, budget: Budget = Budget()) -> DataFrame:
    """(session, order, output_tokens): each chunk's share by priority of what the session has beside its prompts.

    Chunks take their shares in order until the session is used up; a null priority counts as 1.
    Sessions without room or priority give 0.
    """
    weight = F.coalesce(F.col(priority).cast("double"), F.lit(1.0))
    prompt = F.coalesce(F.col(tokens).cast("bigint"), F.lit(0).cast("bigint"))
    rows = chunks.select(F.col(session).alias("s"), F.col(order).alias("o"), prompt.alias("t"), weight.alias("w"))
    totals = rows.groupBy("s").agg(F.sum("t").alias("prompts"), F.sum("w").alias("weights")).withColumnRenamed("s", "of")
    room = budget.session - budget.reserve - F.col("prompts")
    share = F.when((F.col("weights") > 0) & (room > 0), F.floor(F.col("w") / F.col("weights") * room))
    joined = rows.join(totals, F.col("s").eqNullSafe(F.col("of"))).select(F.col("s").alias(session), F.col("o").alias(order), F.struct("t", share.cast("bigint").alias("share")).alias("_v"))

    def step(used: int, v: dict) -> tuple[int, tuple]:
        if v["share"] is None or used >= budget.session:
            return used, (0,)
        out = min(budget.most, max(budget.least, v["share"]))
        return (min(budget.session, used + v["t"] + out) if out > 0 else used), (max(out, 0),)

    return _in_order(joined, session, order, F.col("_v"), "output_tokens bigint", lambda: 0, step)


def pack_batches(chunks: DataFrame, session: str, order: str, length: str, most: int = 8, room: int = 32_000) -> DataFrame:
    """(session, order, batch): chunks in order, ``most`` a batch, with 3 * length + 50 each within ``room``."""

    def step(state: tuple[int, int, int], size: int) -> tuple[tuple, tuple]:
        n, held, batch = state
        if n and (n >= most or held + size > room):
            n, held, batch = 0, 0, batch + 1
        return (n + 1, held + size, batch), (batch,)

    return _in_order(chunks, session, order, (3 * F.coalesce(F.col(length), F.lit(0)) + 50).cast("bigint"), "batch bigint", lambda: (0, 0, 0), step)


def split(df: DataFrame, key: Column, train: float, validation: float, test: float, seed: int = 42) -> DataFrame:
    """Adds part: a reproducible split with exact sizes, the rest to train; shares must add up to 1.

    Rows are ordered by a hash of key and seed. Ranks come from counts of hash prefixes, so no
    single task orders all rows.
    """
    if abs(train + validation + test - 1) > 1e-6:
        raise ValueError("the shares must add up to 1")
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")))
    bucket = F.substring("_hash", 1, 3)
    counts = hashed.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", key))
    # A row a prefix: 4,096 at most.
    placed = hashed.withColumn("_bucket", bucket).join(F.broadcast(before.drop("_n")), "_bucket").withColumn("_rank", F.col("_before") + rank)
    n_val, n_test = F.floor(F.col("_all") * validation), F.floor(F.col("_all") * test)
    n_train = F.col("_all") - n_val - n_test
    part = F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "validation").otherwise("test")
    return placed.withColumn("part", part).drop("_hash", "_bucket", "_before", "_all", "_rank")


def sample(df: DataFrame, key: Column, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows without replacement, the same for the same seed."""
    return df.orderBy(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")), key).limit(k)


def page(df: DataFrame, order: list, number: int, size: int = 10) -> DataFrame:
    """Page ``number`` (from 1) in the given order."""
    return df.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def sort_files(files: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Files by name, size or date; ties by name, in the same direction."""
    keys = [by] if by == "name" else [by, "name"]
    return files.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in keys])


def rank_models(chunks: DataFrame, models: DataFrame, kind: str, chunk_id: str, top: int = 3) -> DataFrame:
    """(chunk, rank, model, score): the best models for each chunk's traits.

    ``models`` (position, provider, model, context_window, strengths, cost, vision) is a catalogue
    of a few rows; each chunk's row carries it as an array, so nothing is joined.
    """
    listed = models.agg(F.array_sort(F.collect_list(F.struct("position", "provider", "model", "context_window", "strengths", "cost", "vision"))).alias("models"))
    t = F.col("traits")
    one = lambda c, n: F.when(c, n).otherwise(0)

    def score(m: Column) -> Column:
        good = lambda x: F.array_contains(m["strengths"], x)
        s = F.when(t["length"] > m["context_window"] * 0.8, -100).otherwise(10)
        s = s + one(t["has_code"] & good("code"), 30) + one(t["has_math"] & good("math"), 30) + one(t["is_multilingual"] & good("multilingual"), 25)
        s = s + F.when(t["has_image"], F.when(m["vision"], 50).otherwise(-30)).otherwise(0)
        if kind in ("cot", "tot"):
            s = s + one(good("reasoning"), 40)
        if kind == "chunking":
            s = s + one(good("speed"), 20)
        s = s + one((t["complexity"] == "hard") & good("reasoning"), 15) + one(good("general"), 5)
        return s - F.coalesce(F.least(m["cost"] * 5, F.lit(20.0)), F.lit(0.0))

    scored = F.transform("models", lambda m: F.struct((-score(m)).alias("order"), m["position"].alias("position"), m["provider"].alias("provider"), m["model"].alias("model"), score(m).alias("score")))
    rows = chunks.join(F.broadcast(listed), F.lit(True)).select(chunk_id, F.posexplode(F.slice(F.array_sort(scored), 1, top)).alias("rank", "m"))
    return rows.select(chunk_id, (F.col("rank") + 1).cast("bigint").alias("rank"), "m.provider", "m.model", F.col("m.score").cast("double").alias("score"))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of parts, each with its length, so that no two lists of parts share a key."""
    return F.sha2(F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts)), 256)


def cached(requests: DataFrame, cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Requests with the response that the cache holds for their key, null where it has none that is young enough."""
    fresh = cache.where(F.col("stored_at") >= now - F.expr(f"INTERVAL {days} DAYS")).select("key", "response")
    return requests.join(fresh, "key", "left")


def cache_statistics(answered: DataFrame, tokens: Column, price: float = 0.002) -> DataFrame:
    """One row: requests, hits, and the tokens that the hits save with their cost at ``price`` a thousand."""
    saved = F.coalesce(F.sum(F.when(F.col("response").isNotNull(), tokens)), F.lit(0)).cast("bigint")
    row = answered.agg(F.count("*").alias("requests"), F.count("response").alias("hits"), saved.alias("saved_tokens"))
    return row.withColumn("saved_cost", F.col("saved_tokens") / 1000 * price)


def uncached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose key the cache lacks: what an incremental run has to process."""
    return requests.join(cache.select("key"), "key", "left_anti")


def evict(cache: DataFrame, most: int = 10_000) -> DataFrame:
    """The youngest ``most`` entries."""
    return cache.orderBy(F.desc("stored_at"), "key").limit(most)


def eligible(providers: DataFrame, regions: list[str] | None = None, scope: str | None = None) -> DataFrame:
    """Providers whose regions meet the given ones and that have the scope, by priority."""
    rows = providers
    if regions is not None:
        rows = rows.where(F.arrays_overlap("regions", F.array(*map(F.lit, regions))))
    if scope is not None:
        rows = rows.where(F.array_contains("scopes", scope))
    return rows.orderBy("priority", "provider")


def admit(files: DataFrame, extensions: list[str], order: str, most_bytes: int = 100 << 20, most_files: int = 100) -> DataFrame:
    """Adds outcome: added, skipped (a name again, or over the number of files) or rejected (kind, size)."""
    kind = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    ok = F.coalesce(kind.isin(*extensions) & (F.col("size") <= most_bytes), F.lit(False))
    rows = cut(numbered(files.withColumn("_ok", ok), [order], "_n"), "admitted")
    firsts = rows.where("_ok").groupBy("name").agg(F.min("_n").alias("_n"))
    placed = numbered(firsts.select("_n"), ["_n"], "_place")
    joined = rows.join(placed, "_n", "left")
    outcome = F.when(~F.col("_ok"), "rejected").when(F.col("_place").isNull() | (F.col("_place") > most_files), "skipped").otherwise("added")
    return joined.withColumn("outcome", outcome).select(*files.columns, "outcome")


def template_for(templates: DataFrame, wanted: DataFrame) -> DataFrame:
    """The template of each (locale, kind): of the locale, else of its language, else English.

    ``templates`` (locale, kind, body) is a dimension of a few dozen rows.
    """
    base = F.regexp_extract("locale", "^[^-_]+", 0)
    choices = F.array(F.struct(F.lit(0).alias("rank"), F.col("locale").alias("l")), F.struct(F.lit(1).alias("rank"), base.alias("l")), F.struct(F.lit(2).alias("rank"), F.lit("en").alias("l")))
    tried = wanted.select("locale", "kind", F.explode(choices).alias("c"))
    known = templates.select(F.col("locale").alias("used"), F.col("kind").alias("k"), "body")
    hits = tried.join(known, (F.col("c.l") == F.col("used")) & (F.col("kind") == F.col("k")))
    return hits.groupBy("locale", "kind").agg(F.min_by(F.struct("used", "body"), "c.rank").alias("t")).select("locale", "kind", "t.used", "t.body")


def share(df: DataFrame, key: Column, part: float, seed: int = 42) -> DataFrame:
    """About ``part`` of the rows, chosen by a hash of key and seed, so the same for the same seed."""
    bound = f"{int(part * (1 << 32)):08x}"
    return df.where(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8) < bound)


def warmed(answers: DataFrame, key: str, response: str, at: Column | None = None) -> DataFrame:
    """(key, response, stored_at): a cache of earlier answers, one a key; failed ones are left out."""
    rows = answers.where(F.col(response).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(response).alias("response"))
    return rows.withColumn("stored_at", F.current_timestamp() if at is None else at)


def fuzzy_ranked(commands: DataFrame, query: str, names: list[str], order: str) -> DataFrame:
    """Commands that a query finds by any of their names, with the best score, best first, then by ``order``."""

    @F.pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: fuzzy_score(query, t or ""))

    scores = [run(F.col(n).cast("string")) for n in names]
    scored = commands.withColumn("score", F.greatest(*scores) if len(scores) > 1 else scores[0])
    return scored.where("score >= 0").orderBy(F.desc("score"), order)
