"""Validators of items as structs of score, passed and flags; see each for its rule.

A validator takes the text (or texts) it judges as columns and returns a struct
(score double, passed boolean, flags array<string>). :func:`chain` runs several and averages them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from millrace.functions.text import found, half_up, has_cjk, js_trim, matches, utf16_length, whitespace_tokens
from millrace.schema import contents, said_by


def verdict(score: Column, passed: Column, flags: Column | None = None) -> Column:
    """A validator's result."""
    flags = F.array().cast("array<string>") if flags is None else flags
    return F.struct(score.cast("double").alias("score"), passed.alias("passed"), flags.alias("flags"))


def _listed(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(c, name) for c, name in pairs)), lambda x: x.isNotNull())


def reasons() -> Column:
    """Why an item is unfit: parts missing, answers under 20 characters, scripts that differ."""
    short = lambda c: utf16_length(c) < 20
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    differs = lambda a, b: ~empty(a) & ~empty(b) & (has_cjk(a) != has_cjk(b))
    missing = F.exists("messages", lambda m: empty(m["role"]) | empty(m["content"]))
    user, answers = contents(said_by("user")), contents(said_by("assistant"))
    chat = F.when(F.size("messages") == 0, F.array(F.lit("missing_answer"))).otherwise(
        _listed((missing, "missing_answer"), (~missing & short(js_trim(answers)), "answer_too_short"), (differs(user, answers), "language_mismatch"))
    )
    asked = F.coalesce(F.nullif("instruction", F.lit("")), F.nullif("input", F.lit("")), F.lit(""))
    text = _listed((short(F.col("text")), "answer_too_short"), (differs(asked, F.col("text")), "language_mismatch"))
    answer = F.coalesce("output", F.lit(""))
    pair = _listed(
        (empty(asked), "missing_question"),
        (empty(answer), "missing_answer"),
        (~empty(asked) & ~empty(answer) & short(answer), "answer_too_short"),
        (differs(asked, answer), "language_mismatch"),
    )
    return F.when(F.col("messages").isNotNull(), chat).when(~empty(F.col("text")), text).otherwise(pair)


def pass_rate(total: Column, flagged: Column) -> Column:
    """Percentage of items without a flag, as a whole number; 100 of none."""
    return F.when(total > 0, half_up((total - flagged) / total * 100)).otherwise(100).cast("bigint")


#: Terms by category.
BIAS_TERMS = {
    "gender": ("fireman", "policeman", "chairman", "mankind"),
    "racial": ("blacklist", "whitelist", "master/slave"),
    "political": ("libtard", "trumpanzee", "snowflake"),
    "religious": ("infidel", "heathen", "heretic"),
    "age": ("old fart", "millennial", "boomer"),
    "socioeconomic": ("ghetto", "trailer trash", "redneck"),
}
#: Words by label.
TOXIC_WORDS = {
    "identity_attack": ("racist", "sexist", "homophobic"),
    "insult": ("idiot", "stupid", "moron"),
    "obscene": ("f***", "s***", "a**", "damn", "hell"),
    "severe_toxicity": ("kill yourself", "die", "worthless"),
    "sexual_explicit": ("sex", "porn", "nude"),
    "threat": ("kill", "hurt", "attack"),
    "toxicity": ("hate", "garbage", "trash"),
}


def word_pattern(words: tuple[str, ...]) -> str:
    """A pattern of any of the words; where a word begins or ends with a letter, so does the match, at a boundary."""
    edge = lambda c: r"\b" if c.isalpha() else ""
    escaped = lambda w: re.sub(r"([^\w ])", r"\\\1", w)
    return "|".join(edge(w[0]) + escaped(w) + edge(w[-1]) for w in words)


def bias_counts(text: Column) -> dict[str, Column]:
    """How many terms of each category a text holds."""
    low = F.lower(text)
    return {c: sum((matches(low, t) for t in terms[1:]), matches(low, terms[0])) for c, terms in BIAS_TERMS.items()}


def bias(text: Column) -> Column:
    """Terms of bias: a tenth off for each."""
    counts = bias_counts(text)
    total = sum(list(counts.values())[1:], next(iter(counts.values())))
    score = F.greatest(F.lit(0.0), 1 - total * 0.1)
    return verdict(score, score >= 0.5, _listed(*((c > 0, name) for name, c in counts.items())))


def bias_report(docs: DataFrame, text: Column) -> DataFrame:
    """(category, items, n, score) over all texts: which hold terms, how many, and a tenth off for each."""
    counts = F.array(*(F.struct(F.lit(name).alias("category"), c.cast("bigint").alias("n")) for name, c in bias_counts(text).items()))
    rows = docs.select(F.explode(counts).alias("c")).where("c.n > 0").groupBy("c.category").agg(F.count("*").alias("items"), F.sum("c.n").alias("n"))
    return rows.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("n") * 0.1))


def toxic_labels(text: Column) -> Column:
    """Labels whose words a text holds."""
    return _listed(*((found(text, f"(?i){word_pattern(words)}"), name) for name, words in TOXIC_WORDS.items()))


def toxicity(text: Column, threshold: float = 0.5) -> Column:
    """Toxic words: 0 with any, else 1."""
    labels = toxic_labels(text)
    score = F.when(F.size(labels) > 0, 0.0).otherwise(1.0)
    return verdict(score, score >= threshold, labels)


#: Fixed values of the grammar rules.
AUXILIARIES = "is|are|was|were|been|being|going|coming|doing|making|taking|getting|looking|feeling|seems|appears|will|would|can|could|should|do|does|did|has|have|had|not"
GRAMMAR = {
    "double_spaces": r" {2,}",
    "repeated_words": r"(?i)\b(\w+)\s+\1\b",
    "missing_capitalization": r"\.\s+[a-z]",
    "confusables": rf"(?i)\btheir\s+(?:{AUXILIARIES})\b|\bits\s+(?:a|an|the|{AUXILIARIES})\b|\byour\s+(?:{AUXILIARIES})\b",
}


def grammar(text: Column, threshold: float = 0.8) -> Column:
    """Double spaces, repeated words, lower case after a stop, confusables: a twentieth off for each."""
    counts = {name: matches(text, p) for name, p in GRAMMAR.items()}
    total = sum(list(counts.values())[1:], next(iter(counts.values())))
    score = F.greatest(F.lit(0.0), 1 - total * 0.05)
    return verdict(score, score >= threshold, _listed(*((c > 0, name) for name, c in counts.items())))


def flesch(text: Column) -> Column:
    """Flesch reading ease; null without words."""
    words = whitespace_tokens(text)
    n = F.size(words)
    sentences = F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]")))
    syllables = F.aggregate(words, F.lit(0), lambda s, w: s + F.greatest(F.lit(1), F.regexp_count(F.lower(w), F.lit("[aeiouy]+"))))
    return F.when(n > 0, 206.835 - 1.015 * (n / sentences) - 84.6 * (syllables / n))


def reading_level(text: Column, threshold: float = 0.5) -> Column:
    """Flesch reading ease as a share of 100."""
    score = F.coalesce(F.least(F.greatest(flesch(text) / 100, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return verdict(score, score >= threshold)


def ambiguity(text: Column, threshold: float = 0.7) -> Column:
    """Vague pronouns per 100 words, and passive voice."""
    n = F.size(whitespace_tokens(text))
    density = F.when(n > 0, matches(text, r"(?i)\b(it|this|that|they)\b") / n * 100).otherwise(0.0)
    passive = matches(text, r"(?i)\b(is|are|was|were|be|been|being)\s+\w+ed\b")
    score = F.greatest(F.lit(0.0), 1 - (density * 0.05 + passive * 0.02))
    return verdict(score, score >= threshold, _listed((density > 2, "vague_pronouns"), (passive > 0, "passive_voice")))


#: Words that are no keywords.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should "
    "may might must shall can need dare ought used to of in for on with at by from as into through "
    "during before after above below between under again further then once here there when where why how "
    "all each few more most other some such no nor not only own same so than too very just and "
    "but or yet because although though while whereas if unless until what which who whom whose this that "
    "these those i me my myself we us our ours you your yours he him his she her hers it its they them their theirs"
).split()


def keywords(text: Column) -> Column:
    """Words of ASCII letters that are no stop words, in order, repeats included."""
    from millrace.functions.text import ascii_bounded

    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(ascii_bounded(r"(\b[a-z]+\b)")), F.lit(0)), lambda w: ~F.array_contains(stop, w))


#: Keywords of all passages that one pass over the answers holds; more passages take more passes.
PASSAGE_WORDS = 1_000_000


def best_coverage(passages: DataFrame, docs: DataFrame, *, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item, id, score): the document that covers each passage best, the greatest id of equals; passages without keywords give none.

    Passages are a list: their keywords go to every task, ``PASSAGE_WORDS`` at a time (slices by hash
    of the passage), and a task returns its best document for each passage, so what is shuffled is a
    row a passage and task, not one a passage and document. Null texts are empty.
    """
    words = lambda: F.array_distinct(keywords(F.coalesce(text_col, F.lit(""))))
    bench = passages.select(F.col(item_col).alias("item"), words().alias("k")).where(F.size("k") > 0)
    told = docs.select(F.col(id_col).alias("id"), words().alias("k")).where(F.col("id").isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in (bench.schema["item"], told.schema["id"])}
    item_type = to_arrow_type(bench.schema["item"].dataType)
    size = bench.agg(F.coalesce(F.sum(F.size("k")), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, -(-size // PASSAGE_WORDS))
    found = []
    for i in range(slices):
        rows = bench.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == i).collect()
        held = docs.sparkSession.sparkContext.broadcast([(r["item"], r["k"]) for r in rows])

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            places: dict[str, list[int]] = {}
            for at, (_, k) in enumerate(held.value):
                for w in k:
                    places.setdefault(w, []).append(at)
            best: dict[int, tuple[int, object]] = {}
            kind = None
            for batch in batches:
                kind = kind or batch.schema.field("id").type
                for doc, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for at, n in Counter(at for w in k for at in places.get(w, ())).items():
                        best[at] = max(best.get(at, (n, doc)), (n, doc))
            if best:
                items, top = zip(*sorted(best.items()), strict=True)
                columns = [pa.array([held.value[at][0] for at in items], item_type), pa.array([d for _, d in top], kind), pa.array([n for n, _ in top], pa.int64()), pa.array([len(held.value[at][1]) for at in items], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "id", "n", "size"])

        found.append(told.mapInArrow(work, f"item {kinds['item']}, id {kinds['id']}, n bigint, size bigint"))
    best = reduce(DataFrame.unionByName, found).groupBy("item", "size").agg(F.max(F.struct("n", "id")).alias("m"))
    return best.select(F.col("item").alias(item_col), F.col("m.id").alias(id_col), F.least(F.col("m.n") / F.col("size") * 1.5, F.lit(1.0)).alias("score"))


def coverage(source: Column, answer: Column, threshold: float = 0.5) -> Column:
    """Share of a source's keywords in the answer, half as much again, 1 at most; takes keyword arrays."""
    a, b = F.array_distinct(source), F.array_distinct(answer)
    share = F.size(F.array_intersect(a, b)) / F.size(a)
    score = F.when(F.size(a) == 0, F.when(F.size(b) > 0, 1.0).otherwise(0.0)).otherwise(F.least(share * 1.5, F.lit(1.0)))
    return verdict(score, score >= threshold)


def completeness(question: Column, answer: Column, threshold: float = 0.5) -> Column:
    """Share of the question's keywords that are in the answer, or within or around one of its keywords."""
    asked = keywords(question)
    # The answer's words are bound once, by a lambda, and not found again for each keyword. A keyword
    # within one of them is within the answer.
    once = F.array(F.struct(F.lower(answer).alias("low"), F.array_distinct(keywords(answer)).alias("told")))
    hit = F.flatten(F.transform(once, lambda x: F.filter(asked, lambda t: F.contains(x["low"], t) | F.exists(x["told"], lambda w: F.contains(t, w)))))
    score = F.when(F.size(asked) == 0, F.when(F.length(answer) > 0, 1.0).otherwise(0.0)).otherwise(F.size(hit) / F.size(asked))
    return verdict(score, score >= threshold)


def claims(text: Column) -> Column:
    """Sentences that claim something: no questions, none that hedge."""
    parts = F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?]*)"), F.lit(0))
    stated = F.filter(parts, lambda p: ~F.contains(p, F.lit("?")))
    bare = F.transform(stated, lambda p: js_trim(F.regexp_replace(p, r"[.!?]+$", "")))
    return F.filter(bare, lambda s: (s != "") & ~F.rlike(F.lower(s), F.lit("i think|maybe|perhaps")))


def entailment_tokens(text: Column) -> Column:
    """Tokens that entailment compares."""
    from millrace.functions.text import ascii_bounded

    return F.regexp_extract_all(F.lower(text), F.lit(ascii_bounded(r"(\b[\w']+\b)")), F.lit(0))


def entailment(premise: Column, hypothesis: Column) -> Column:
    """0.9 where four fifths of the hypothesis' tokens are in the premise, 0.5 from three tenths, else 0.1; takes token arrays."""
    n = F.size(hypothesis)
    share = F.size(F.filter(hypothesis, lambda t: F.array_contains(premise, t))) / n
    return F.when(n == 0, 0.9).when(share >= 0.8, 0.9).when(share >= 0.3, 0.5).otherwise(0.1)


def entailed(docs: DataFrame, passages: DataFrame, on: str, doc_id: str, item_id: str, threshold: float = 0.7) -> DataFrame:
    """(item_id, doc_id, score, passed) of each document with each passage that has the same ``on``; both have a ``text``.

    What :func:`factual_consistency` gives, but the tokens of a document are found and counted once for
    all its passages. A passage without a text has no tokens; documents without one are left out.
    """
    kinds = docs.schema[doc_id].dataType.simpleString(), passages.schema[item_id].dataType.simpleString()
    lists = passages.groupBy(on).agg(F.collect_list(F.struct(F.col(item_id).alias("item"), F.lower(F.coalesce("text", F.lit(""))).alias("premise"))).alias("premises"))
    rows = docs.where(F.col("text").isNotNull()).select(on, F.col(doc_id).alias("doc"), F.lower("text").alias("hypothesis")).join(lists, on)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = re.compile(r"\b[\w']+\b", re.ASCII)
        known: dict[str, set[str]] = {}
        for batch in batches:
            at, items, scores = [], [], []
            for i, (text, premises) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                counted = Counter(token.findall(text))
                n = counted.total()
                for one in premises:
                    said = known.get(one["premise"])
                    if said is None:
                        if len(known) >= 1000:
                            known.clear()
                        said = known[one["premise"]] = set(token.findall(one["premise"]))
                    share = sum(counted[t] for t in said if t in counted) / n if n else 1.0
                    at.append(i)
                    items.append(one["item"])
                    scores.append(0.9 if share >= 0.8 else 0.5 if share >= 0.3 else 0.1)
            passed = [x >= threshold for x in scores]
            item_type = batch.schema.field(2).type.value_type.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(items, item_type), batch.column(0).take(pa.array(at, pa.int64())), pa.array(scores, pa.float64()), pa.array(passed, pa.bool_())], names=[item_id, doc_id, "score", "passed"])

    return rows.select("doc", "hypothesis", "premises").mapInArrow(work, f"`{item_id}` {kinds[1]}, `{doc_id}` {kinds[0]}, score double, passed boolean")


def hallucination(premise: Column, text: Column) -> Column:
    """Share of the claims that the premise (a token array) does not entail, off 1."""
    made = claims(text)
    flags = F.filter(made, lambda c: entailment(premise, entailment_tokens(c)) < 0.7)
    score = F.when(F.size(made) == 0, 1.0).otherwise(1 - F.size(flags) / F.size(made))
    return verdict(score, F.size(flags) == 0, flags)


def factual_consistency(premise: Column, answer: Column, threshold: float = 0.7) -> Column:
    """Whether a source (a token array) entails an answer as a whole."""
    score = entailment(premise, entailment_tokens(answer))
    return verdict(score, score >= threshold)


def with_synonyms(tokens: Column, synonyms: dict[str, list[str]]) -> Column:
    """A token array with the synonyms of its tokens, in lower case; the dictionary is a parameter, hence small."""
    if not synonyms:
        return tokens
    entries = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k.lower()), F.array(*(F.lit(w.lower()) for w in v)))))
    return F.array_distinct(F.concat(tokens, F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(entries, t), F.array().cast("array<string>"))))))


def length_and_token_outlier(df: DataFrame, length: Column, tokens: Column, least: int = 5) -> DataFrame:
    """Adds z_length, z_tokens, score (half off for each that is over two deviations) and listed (both are)."""
    rows = df.withColumns({"_length": length, "_tokens": tokens})
    stats = rows.agg(*(f(c).alias(f"{n}{c}") for c in ("_length", "_tokens") for n, f in (("m", F.avg), ("d", F.stddev_pop))), F.count("*").alias("_n"))
    z = lambda c: F.when(F.col(f"d{c}") > 0, (F.col(c) - F.col(f"m{c}")) / F.col(f"d{c}")).otherwise(0.0)
    # One row.
    joined = rows.join(F.broadcast(stats), F.lit(True)).withColumns({"z_length": z("_length"), "z_tokens": z("_tokens")})
    far = lambda c: F.when((F.col("_n") >= least) & (F.abs(c) > 2), 0.5).otherwise(0.0)
    scored = joined.withColumn("score", 1 - far("z_length") - far("z_tokens"))
    return scored.withColumn("listed", F.col("score") < 0.5).select(*df.columns, "z_length", "z_tokens", "score", "listed")


def diverse(vectors: DataFrame, order: str, group: str | None = None, vector_col: str = "embedding", near: float = 0.9, most: int = 5) -> DataFrame:
    """(order, cluster_size, passed, score): items in order join the first cluster whose centre or a member is near, up to ``most``.

    Each decision depends on all before it, so the items of a group (all, without one) are streamed
    through one task, which holds a centre a cluster and at most ``most`` - 1 members of it. Rows
    without a vector make clusters of their own.
    """
    kind = vectors.schema[order].dataType.simpleString()
    key = F.col(group) if group else F.lit(0)
    rows = vectors.select(key.alias("g"), F.col(order).alias("o"), F.col(vector_col).cast("array<double>").alias("v")).repartition("g").sortWithinPartitions("g", "o")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = object(), None
        for batch in batches:
            sizes = []
            for g, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if g != now:
                    now, found = g, _Clusters(near, most)
                sizes.append(found.add(v))
            passed = [n < most for n in sizes]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64()), pa.array(passed), pa.array([max(0.0, 1 - n / most) for n in sizes])], names=["o", "cluster_size", "passed", "score"])

    return rows.mapInArrow(work, f"o {kind}, cluster_size bigint, passed boolean, score double").withColumnRenamed("o", order)


class _Clusters:
    """Clusters in the order in which they began: unit vectors of centres and members, in one matrix."""

    def __init__(self, near: float, most: int):
        self.near, self.most, self.members, self.rows, self.owner, self.n = near, most, [], np.zeros((0, 0)), np.zeros(0, np.int64), 0

    def _put(self, cluster: int, vector: np.ndarray) -> None:
        if self.n == len(self.rows):
            grown = np.zeros((max(64, 2 * self.n), len(vector)))
            if self.n:
                grown[: self.n] = self.rows[: self.n]
            self.rows, self.owner = grown, np.concatenate((self.owner, np.zeros(len(grown) - len(self.owner), np.int64)))
        self.rows[self.n], self.owner[self.n] = vector, cluster
        self.n += 1

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        size = np.sqrt(v @ v)
        return v / size if size else v

    def add(self, vector: list[float] | None) -> int:
        """The size that the vector's cluster has with it, or would have if it were not full."""
        v = np.array(vector or [], float)
        unit = self._unit(v)
        hits = self.owner[: self.n][self.rows[: self.n] @ unit > self.near] if self.n and len(v) else np.zeros(0, np.int64)
        if not len(hits):
            if len(v):
                self.members.append([v])
                self._put(len(self.members) - 1, unit)
            return 1
        cluster = int(hits.min())
        size = len(self.members[cluster]) + 1
        if size < self.most:
            self.members[cluster].append(v)
            # The row of a cluster of one is its centre as well; from two on members have rows of their own.
            own = np.flatnonzero(self.owner[: self.n] == cluster)
            if size == 2:
                self._put(cluster, self._unit(self.members[cluster][0]))
            self._put(cluster, unit)
            self.rows[own[0]] = self._unit(np.mean(self.members[cluster], axis=0))
        return size


def length_outlier(df: DataFrame, length: Column, least: int = 5) -> DataFrame:
    """Adds z and outlier: over two standard deviations from the mean of all rows, if there are ``least``.

    Mean and deviation are one row, joined back by a broadcast of that row.
    """
    stats = df.agg(F.avg(length).alias("mean"), F.stddev_pop(length).alias("deviation"), F.count("*").alias("n"))
    z = F.when(F.col("deviation") > 0, (length - F.col("mean")) / F.col("deviation")).otherwise(0.0)
    joined = df.join(F.broadcast(stats), F.lit(True))
    return joined.withColumn("z", z).withColumn("outlier", (F.col("n") >= least) & (F.abs("z") > 2)).drop("mean", "deviation", "n")


def trigrams(chars: Column) -> Column:
    """Windows of three of an array of characters; a text's own are reached by place, which is linear."""
    n = F.size(chars)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.concat(F.element_at(chars, i), F.element_at(chars, i + 1), F.element_at(chars, i + 2)))).otherwise(F.array().cast("array<string>"))


def _trigram_rows(texts: DataFrame, text_col: str, *keep: str) -> DataFrame:
    chars = F.array_remove(F.split(F.lower(F.coalesce(text_col, F.lit(""))), ""), "")
    return texts.select(*keep, chars.alias("_chars")).select(*keep, F.explode(trigrams(F.col("_chars"))).alias("trigram"))


def trigram_model(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(trigram, n) over all texts."""
    return _trigram_rows(texts, text_col).groupBy("trigram").agg(F.count("*").alias("n"))


def trigram_scores(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, trigrams): mean negative log probability under a model with one added to each count."""
    totals = model.agg(F.sum("n").alias("total"), F.greatest(F.count("*"), F.lit(1)).alias("vocabulary"))
    counts = _trigram_rows(docs, text_col, id_col).groupBy(id_col, "trigram").agg(F.count("*").alias("k"))
    joined = counts.join(model, "trigram", "left").join(F.broadcast(totals), F.lit(True))
    log = F.ln((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + F.col("vocabulary")))
    sums = joined.groupBy(id_col).agg((-F.sum(F.col("k") * log) / F.sum("k")).alias("score"), F.sum("k").alias("trigrams"))
    return docs.select(id_col).join(sums, id_col, "left").select(id_col, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("trigrams", F.lit(0)).alias("trigrams"))


def chain(threshold: float = 0.5, **results: Column) -> Column:
    """Several validators in one: all results, their mean score, whether it reaches the threshold, all flags."""
    scores = [c["score"] for c in results.values()]
    mean = sum(scores[1:], scores[0]) / len(scores)
    named = [c.alias(name) for name, c in results.items()]
    return F.struct(*named, mean.alias("score"), (mean >= threshold).alias("passed"), F.concat(*(c["flags"] for c in results.values())).alias("flags"))


def report(df: DataFrame, flags: Column, *groups: str) -> DataFrame:
    """Totals of items and flagged items with the pass rate, by ``groups``."""
    flagged = F.count_if(F.size("_flags") > 0)
    rows = df.withColumn("_flags", flags).groupBy(*groups).agg(F.count("*").alias("total"), flagged.alias("flagged"))
    return rows.withColumn("pass_rate", pass_rate(F.col("total"), F.col("flagged")))


def breakdown(df: DataFrame, flags: Column, *groups: str) -> DataFrame:
    """How often each reason was given, by ``groups``."""
    return df.select(*groups, F.explode(flags).alias("reason")).groupBy(*groups, "reason").agg(F.count("*").alias("n"))


def top_word(docs: DataFrame, words: Column, id_col: str = "doc_id", default: str = "general") -> DataFrame:
    """(id, topic): the most frequent of a text's words, the first of equals."""
    rows = docs.select(id_col, F.posexplode(words).alias("pos", "w")).groupBy(id_col, "w").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = rows.groupBy(id_col).agg(F.max_by("w", F.struct("n", -F.col("first"))).alias("topic"))
    return docs.select(id_col).join(best, id_col, "left").select(id_col, F.coalesce("topic", F.lit(default)).alias("topic"))


def ranked(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    """Adds the row number within ``by``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
