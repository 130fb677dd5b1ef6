"""Quality by weak supervision, in Spark expressions only.

Method. Each document gets counts of its words, symbols, repeated lines and repeated word windows.
Rules over these counts vote good or bad or abstain, so a document is a pattern of votes, and there
are at most 3 to the number of rules patterns. Expectation-maximisation over the pattern counts
estimates the share of good documents and how each rule votes on good and on bad ones; it is one
fold over the collected patterns (a bounded number, whatever the corpus). The posterior
probability of quality given the votes replaces filters that all have to pass.

Defined cases: null or empty text has no words and fails the base; rows are judged one by one, so
repeated rows and ids stay; a very long text is counted whole, in the row that has it; ties of the
posterior with the threshold are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

#: ASCII white space, as in the contract's word pattern.
SPACES = r"[\x20\x09-\x0D]+"
#: Frequent function words of the languages that the rules know.
FUNCTION_WORDS = (
    "the of and to in is that for it with as was on are be by this from or an at "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans sur pas au par "
    "el los las por con para una del se su al lo como más pero y"
).split()


@dataclass(frozen=True)
class Rule:
    """A rule votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str


#: Production rules, over the columns of :func:`features`. A defect's absence says little, as most
#: bad documents have one kind of defect, so the rules on defects abstain on the others.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words", "false"),
    Rule("many_symbols", "3 * n_symbols > n_words", "false"),
    Rule("repetition", "10 * n_repeat_words > 3 * n_words", "false"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines", "false"),
    Rule("capitals", "2 * n_upper > word_chars", "false"),
    Rule("exclamation", "10 * n_exclaim > 3 * n_words", "false"),
    Rule("function_words", "n_function = 0", "n_function >= 3"),
    Rule("word_length", "word_chars > 14 * n_words OR 2 * word_chars < 5 * n_words", "word_chars <= 10 * n_words AND word_chars >= 3 * n_words"),
)


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text: see the columns' names, all long."""
    long = lambda c: c.cast("bigint")
    text = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = text.select(
        id_col,
        "text",
        F.array_remove(F.split("text", SPACES), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    n = F.size("words")
    window = lambda i: [F.element_at("words", i + k) for k in (0, 1, 2)]
    starts = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    counted = split.select(
        id_col,
        "words",
        starts.alias("starts"),
        long(n).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.regexp_count("text", F.lit(r"\p{Lu}"))).alias("n_upper"),
        long(F.regexp_count("text", F.lit("!"))).alias("n_exclaim"),
        long(F.size(F.array_intersect("words", F.array(*map(F.lit, dict.fromkeys(FUNCTION_WORDS)))))).alias("n_function"),
    )
    # Hashes only tell the documents without any repeated window, which are most; the others
    # are counted by the windows themselves, sorted so that equal ones are neighbours.
    hashed = F.array_distinct(F.transform("starts", lambda i: F.xxhash64(*window(i))))
    kept = [c for c in counted.columns if c not in ("words", "starts")]
    windows = F.when(
        F.size(hashed) < F.size("starts"),
        F.array_sort(F.transform("starts", lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("at")))),
    ).otherwise(F.array().cast("array<struct<w:string,at:int>>"))
    near = counted.select(*kept, windows.alias("windows"))
    repeated = F.filter(
        "windows",
        lambda x, k: F.coalesce(x["w"] == F.get("windows", k - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get("windows", k + 1)["w"], F.lit(False)),
    )
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))))
    return near.select(*kept, long(F.size(covered)).alias("n_repeat_words"))


def votes(rules: tuple[Rule, ...]) -> Column:
    """The votes of a row as an array: -1 bad, 1 good, 0 abstains."""
    return F.array(*(F.expr(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END") for r in rules))


def _posterior(votes: str, state: str) -> str:
    """SQL: probability of good, given an array of votes and a state (p, good, bad)."""
    log = lambda own: f"aggregate(zip_with({votes}, {state}.{own}, (v, x) -> ln(CASE v WHEN -1 THEN x.no WHEN 1 THEN x.yes ELSE x.none END)), 0D, (s, x) -> s + x)"
    return f"1D / (1D + exp(greatest(least((ln(1 - {state}.p) + {log('bad')}) - (ln({state}.p) + {log('good')}), 500D), -500D)))"


def estimate(patterns: DataFrame, k: int, rounds: int = 40, prior: float = 0.01) -> DataFrame:
    """Expectation-maximisation over (votes, n): one row with the final ``state`` and the patterns.

    ``state`` has p, the share of good documents, and for each rule how often it votes bad (no) or
    good (yes) or abstains (none) on good documents and on bad ones; the share of its votes that
    are right follows from these. The start expresses what a rule is, seldom wrong on good
    documents and often silent, and counts on for ``prior`` of all documents, which keeps the two
    classes from changing places and rules that never vote defined.
    """
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))
    first = {"good": (0.02, 0.49, 0.49), "bad": (0.3, 0.3, 0.4)}
    total = lambda term: f"aggregate(judged, 0D, (s, r) -> s + r.n * {term})"
    share = lambda q, v, at: f"({total(f'{q} * if(r.votes[j] = {v}, 1D, 0D)')} + {prior}D * {total('1D')} * {at}D) / ({total(q)} + {prior}D * {total('1D')})"
    rates = lambda q, at: f"transform(sequence(0, {k - 1}), j -> named_struct('no', {share(q, -1, at[0])}, 'yes', {share(q, 1, at[1])}, 'none', {share(q, 0, at[2])}))"
    step = f"""
      transform(array(transform(patterns, r -> named_struct('votes', r.votes, 'n', r.n, 'q', {_posterior("r.votes", "state")}))), judged ->
        named_struct('p', ({total("r.q")} + 1D) / ({total("1D")} + 2D), 'good', {rates("r.q", first["good"])}, 'bad', {rates("(1D - r.q)", first["bad"])}))[0]"""
    rate = lambda at: f"array_repeat(named_struct('no', {at[0]}D, 'yes', {at[1]}D, 'none', {at[2]}D), {k})"
    start = f"named_struct('p', 0.8D, 'good', {rate(first['good'])}, 'bad', {rate(first['bad'])})"
    return one.select("patterns", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (state, i) -> {step})").alias("state"))


def judge(counts: DataFrame, *, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, min_words: int = 50, rounds: int = 40) -> DataFrame:
    """Adds base_failed, quality (posterior of good) and kept to the counts of :func:`features`.

    ``counts`` should be a stored table: it is read for the pattern counts and for the result.
    """
    voted = counts.withColumn("votes", votes(rules))
    fitted = estimate(voted.groupBy("votes").agg(F.count("*").alias("n")), len(rules), rounds)
    scored = fitted.select(F.explode("patterns").alias("r"), "state").select(F.col("r.votes").alias("votes"), F.expr(_posterior("r.votes", "state")).alias("quality"))
    # At most 3 ** len(rules) rows, so the broadcast has a bound.
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.join(F.broadcast(scored), "votes").withColumn("base_failed", base_failed)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(id_col, *names, (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), F.col("quality"))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, min_words: int = 50) -> DataFrame:
    """:func:`features`, stored, and :func:`judge`."""
    counts = stored(features(docs, id_col=id_col, text_col=text_col), "quality-counts")
    return judge(counts, id_col=id_col, rules=rules, threshold=threshold, min_words=min_words)
