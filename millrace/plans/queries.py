"""Queries of the engine's operators over the test tables, and their SQL where SQL can express them.

Each applies an operator to its whole table. SQL is DuckDB's; its patterns are the operators' own,
as word boundaries there are ASCII.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import schema
from millrace.functions import text as T
from millrace.operators import chunking, dedup, export, generate, metrics, ordering, parsing, planning, privacy
from millrace.operators import validators as V
from millrace.plans.registry import ORACLES, query, table
from millrace.sources import readers
from millrace.storage import shared_dir

# --- quality ---------------------------------------------------------------------------------


@query("""
SELECT lang, count(*)::BIGINT AS total, count(*) FILTER (WHERE length(coalesce(text, '')) < 20)::BIGINT AS flagged,
       floor((count(*) - count(*) FILTER (WHERE length(coalesce(text, '')) < 20)) / count(*)::DOUBLE * 100 + 0.5)::BIGINT AS pass_rate
FROM documents GROUP BY lang
""")
def quality_report_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    items = schema.text_items(docs).join(docs.select(F.col("doc_id").alias("item_id"), "lang"), "item_id")
    return V.report(items, V.reasons(), "lang")


@query("""
WITH c AS (
  SELECT conv_id, count(*) FILTER (WHERE coalesce(role, '') = '' OR coalesce(text, '') = '') AS missing,
         coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) + greatest(count(*) FILTER (WHERE role = 'assistant') - 1, 0) AS n
  FROM conversations GROUP BY conv_id)
SELECT CASE WHEN missing > 0 THEN 'missing_answer' ELSE 'answer_too_short' END AS reason, count(*)::BIGINT AS n
FROM c WHERE missing > 0 OR n < 20 GROUP BY 1
""")
def quality_breakdown(spark, sf_dir):
    return V.breakdown(schema.chat_items(table(spark, sf_dir, "conversations")), V.reasons())


def _bias_sql() -> str:
    count = lambda t: f"len(regexp_extract_all(lower(text), '{t}'))"
    per = ", ".join(f"({' + '.join(map(count, terms))})::BIGINT AS {c}" for c, terms in V.BIAS_TERMS.items())
    total = " + ".join(V.BIAS_TERMS)
    return f"SELECT doc_id, {', '.join(V.BIAS_TERMS)}, round(greatest(0, 1 - ({total}) * 0.1::DOUBLE), 6) AS score FROM (SELECT doc_id, {per} FROM documents)"


@query(_bias_sql())
def bias(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    counts = V.bias_counts(text)
    return table(spark, sf_dir, "documents").select("doc_id", *(c.cast("bigint").alias(n) for n, c in counts.items()), F.round(V.bias(text)["score"], 6).alias("score"))


def _toxic_sql() -> str:
    hits = ", ".join(f"regexp_matches(text, '(?i){V.word_pattern(w)}') AS {n}" for n, w in V.TOXIC_WORDS.items())
    return f"SELECT doc_id, {', '.join(V.TOXIC_WORDS)}, ({' OR '.join(V.TOXIC_WORDS)}) AS toxic FROM (SELECT doc_id, {hits} FROM documents)"


@query(_toxic_sql())
def toxicity(spark, sf_dir):
    labels = table(spark, sf_dir, "documents").select("doc_id", V.toxic_labels(F.coalesce("text", F.lit(""))).alias("labels"))
    return labels.select("doc_id", *(F.array_contains("labels", n).alias(n) for n in V.TOXIC_WORDS), (F.size("labels") > 0).alias("toxic"))


@query(f"WITH t AS ({_toxic_sql()}) SELECT l.toxic::BIGINT AS labelled, t.toxic AS found, count(*)::BIGINT AS n FROM labels l JOIN t USING (doc_id) GROUP BY ALL")
def toxicity_vs_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("bigint").alias("labelled"))
    return labels.join(toxicity(spark, sf_dir).select("doc_id", F.col("toxic").alias("found")), "doc_id").groupBy("labelled", "found").agg(F.count("*").alias("n"))


@query(r"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents),
c AS (
  SELECT doc_id, len(words) AS n, greatest(1, len(regexp_extract_all(text, '[.!?]'))) AS s,
         list_sum(list_transform(words, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+'))))) AS y FROM w)
SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE round(least(greatest((206.835::DOUBLE - 1.015::DOUBLE * (n / s) - 84.6::DOUBLE * (y / n)) / 100, 0), 1), 6) END::DOUBLE AS score FROM c
""")
def reading_level(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(V.reading_level(F.coalesce("text", F.lit("")))["score"], 6).alias("score"))


@query(r"""
WITH c AS (
  SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n,
         len(regexp_extract_all(text, '(?i)\b(it|this|that|they)\b')) AS vague,
         len(regexp_extract_all(text, '(?i)\b(is|are|was|were|be|been|being)\s+\w+ed\b')) AS passive FROM documents)
SELECT doc_id, round(greatest(0, 1 - (CASE WHEN n > 0 THEN vague / n * 100 ELSE 0 END * 0.05::DOUBLE + passive * 0.02::DOUBLE)), 6) AS score,
       (CASE WHEN n > 0 THEN vague / n * 100 ELSE 0 END > 2) AS vague, passive > 0 AS passive FROM c
""")
def ambiguity(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", V.ambiguity(F.coalesce("text", F.lit(""))).alias("v"))
    return rows.select("doc_id", F.round("v.score", 6).alias("score"), F.array_contains("v.flags", "vague_pronouns").alias("vague"), F.array_contains("v.flags", "passive_voice").alias("passive"))


_GRAMMAR_SQL = rf"""
gaps AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w, unnest(regexp_split_to_array(text, '[A-Za-z0-9_]+')[:-2]) AS gap, unnest(range(len(regexp_extract_all(text, '[A-Za-z0-9_]+')))) AS i FROM documents),
near AS (SELECT doc_id, i, (lower(w) = lag(lower(w)) OVER o AND regexp_full_match(gap, '[ \t\n\x0B\f\r]+')) AS again FROM gaps WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, sum(CASE WHEN coalesce(again, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM near),
repeated AS (SELECT doc_id, sum(n // 2) AS n FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL) GROUP BY doc_id),
found AS (
  SELECT doc_id, len(regexp_extract_all(text, ' {{2,}}')) AS double_spaces, coalesce(n, 0) AS repeated_words, len(regexp_extract_all(text, '\.\s+[a-z]')) AS missing_capitalization,
         len(regexp_extract_all(text, '{V.GRAMMAR["confusables"]}')) AS confusables FROM documents LEFT JOIN repeated USING (doc_id)),
grammar AS (
  SELECT doc_id, greatest(0, 1 - (double_spaces + repeated_words + missing_capitalization + confusables) * 0.05::DOUBLE) AS score,
         list_filter([CASE WHEN double_spaces > 0 THEN 'double_spaces' END, CASE WHEN repeated_words > 0 THEN 'repeated_words' END, CASE WHEN missing_capitalization > 0 THEN 'missing_capitalization' END, CASE WHEN confusables > 0 THEN 'confusables' END], lambda x: x IS NOT NULL) AS flags FROM found)
"""


@query(f"WITH {_GRAMMAR_SQL} SELECT doc_id, round(score, 6) AS score, score >= 0.8 AS passed, array_to_string(flags, ',') AS flags FROM grammar")
def grammar(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.grammar(F.coalesce("text", F.lit(""))).alias("v")).select("doc_id", F.round("v.score", 6).alias("score"), "v.passed", F.array_join("v.flags", ",").alias("flags"))


_KEYWORDS = f"list_filter(regexp_extract_all(lower(text), '\\b[a-z]+\\b'), lambda x: NOT list_contains([{', '.join(repr(w) for w in V.STOP_WORDS)}], x))"


@query(f"""
WITH b AS (SELECT item_id, list_distinct({_KEYWORDS}) AS k FROM benchmark),
d AS (SELECT doc_id, list_distinct({_KEYWORDS}) AS k FROM documents),
p AS (SELECT item_id, doc_id, len(list_intersect(b.k, d.k)) / len(b.k) AS share FROM b, d WHERE len(b.k) > 0)
SELECT item_id, max(doc_id) FILTER (WHERE share = top)::BIGINT AS doc_id, round(least(any_value(top) * 1.5::DOUBLE, 1), 6) AS score
FROM (SELECT *, max(share) OVER (PARTITION BY item_id) AS top FROM p) GROUP BY item_id
""")
def coverage_of_benchmark(spark, sf_dir):
    """The document that covers each benchmark passage best."""
    best = V.best_coverage(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
    return best.withColumn("score", F.round("score", 6))


def _chain_sql() -> str:
    toxic = " + ".join(f"{n}::INT" for n in V.TOXIC_WORDS)
    kinds = " + ".join(f"({c} > 0)::INT" for c in V.BIAS_TERMS)
    return f"""WITH {_GRAMMAR_SQL}, b AS ({ORACLES["bias"]}), t AS ({ORACLES["toxicity"]}), r AS ({ORACLES["reading_level"]}), a AS ({ORACLES["ambiguity"]}),
    s AS (SELECT doc_id, (b.score + CASE WHEN t.toxic THEN 0 ELSE 1 END + grammar.score + r.score + a.score) / 5 AS mean, {kinds} + {toxic} + len(flags) + vague::INT + passive::INT AS n
          FROM b JOIN t USING (doc_id) JOIN grammar USING (doc_id) JOIN r USING (doc_id) JOIN a USING (doc_id))
    SELECT doc_id, round(mean, 4) AS score, mean >= 0.5 AS passed, n::BIGINT AS n_flags FROM s"""


@query(_chain_sql())
def grammar_chain(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    checks = V.chain(0.5, bias=V.bias(text), toxicity=V.toxicity(text), grammar=V.grammar(text), reading=V.reading_level(text), ambiguity=V.ambiguity(text))
    return table(spark, sf_dir, "documents").select("doc_id", checks.alias("v")).select("doc_id", F.round("v.score", 4).alias("score"), "v.passed", F.size("v.flags").cast("bigint").alias("n_flags"))


@query("""
WITH b AS (SELECT string_split(lower(text), '') AS t FROM benchmark),
m AS (SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || t[i + 1] || t[i + 2])) AS g FROM b) GROUP BY g),
z AS (SELECT sum(n) AS total, count(*) AS v FROM m),
c AS (SELECT doc_id, string_split(lower(text), '') AS t FROM documents),
k AS (SELECT doc_id, g, count(*) AS k FROM (SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || t[i + 1] || t[i + 2])) AS g FROM c) GROUP BY ALL),
s AS (SELECT doc_id, -sum(k * ln((coalesce(n, 0) + 1) / (total + v))) / sum(k) AS score, sum(k)::BIGINT AS trigrams FROM k LEFT JOIN m USING (g), z GROUP BY doc_id)
SELECT doc_id, round(coalesce(score, 0), 6) AS score, coalesce(trigrams, 0)::BIGINT AS trigrams FROM documents LEFT JOIN s USING (doc_id)
""")
def perplexity_trigram(spark, sf_dir):
    """Documents scored under the trigrams of the benchmark."""
    model = V.trigram_model(table(spark, sf_dir, "benchmark"))
    return V.trigram_scores(table(spark, sf_dir, "documents"), model).select("doc_id", F.round("score", 6).alias("score"), "trigrams")


# --- lengths and statistics ------------------------------------------------------------------


@query("""
SELECT lang, count(length(text))::BIGINT AS n, round(avg(length(text)), 6) AS mean, round(stddev_pop(length(text)), 6) AS std_dev,
       min(length(text))::BIGINT AS least, max(length(text))::BIGINT AS greatest, round(quantile_cont(length(text), 0.5), 6)::DOUBLE AS median,
       quantile_disc(length(text), 0.95)::BIGINT AS p95
FROM documents GROUP BY lang
""")
def length_stats_by_lang(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.length("text").cast("bigint").alias("len"))
    out = metrics.distribution(rows, "len", "lang")
    return out.select("lang", "n", F.round("mean", 6).alias("mean"), F.round("std_dev", 6).alias("std_dev"), "least", "greatest", F.round("median", 6).alias("median"), F.col("p95").cast("bigint").alias("p95"))


@query("""
WITH l AS (SELECT length(text) AS v FROM documents WHERE text IS NOT NULL), b AS (SELECT min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM l),
c AS (SELECT least(floor((v - lo) / ((hi - lo) / 10)), 9)::INT AS bin, count(*) AS n FROM l, b GROUP BY 1)
SELECT i::INT AS bin, round(lo + i * ((hi - lo) / 10), 6) AS bin_start, CASE WHEN i = 9 THEN hi ELSE round(lo + (i + 1) * ((hi - lo) / 10), 6) END AS bin_end, coalesce(n, 0)::BIGINT AS n
FROM (SELECT unnest(range(10)) AS i), b LEFT JOIN c ON c.bin = i
""")
def length_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.length("text").alias("v"))
    return metrics.histogram(rows, "v").select("bin", F.round("bin_start", 6).alias("bin_start"), F.round("bin_end", 6).alias("bin_end"), "n")


@query("""
WITH s AS (SELECT avg(length(text)) AS m, stddev_pop(length(text)) AS d, count(*) AS n FROM documents)
SELECT doc_id, round(CASE WHEN d > 0 THEN (length(text) - m) / d ELSE 0 END, 6) AS z, (n >= 5 AND abs(CASE WHEN d > 0 THEN (length(text) - m) / d ELSE 0 END) > 2) AS outlier FROM documents, s
""")
def length_outliers(spark, sf_dir):
    out = V.length_outlier(table(spark, sf_dir, "documents"), F.length("text"))
    return out.select("doc_id", F.round("z", 6).alias("z"), "outlier")


@query("""
WITH f AS (SELECT 'text' AS format, length(text) AS n FROM documents WHERE coalesce(text, '') <> '' UNION ALL SELECT 'text', NULL FROM documents WHERE coalesce(text, '') = '' UNION ALL SELECT DISTINCT 'chatml', NULL::BIGINT FROM conversations WHERE false)
SELECT (SELECT count(*) FROM documents)::BIGINT + (SELECT count(DISTINCT conv_id) FROM conversations)::BIGINT AS items, 0::BIGINT AS instruction_items,
       (SELECT count(DISTINCT conv_id) FROM conversations)::BIGINT AS chat_items, (SELECT count(*) FROM documents)::BIGINT AS text_items,
       0.0::DOUBLE AS avg_instruction, round(avg(n), 6) AS avg_output,
       CASE WHEN (SELECT count(*) FROM documents) + (SELECT count(DISTINCT conv_id) FROM conversations) < 1000 THEN 'n<1K'
            WHEN (SELECT count(*) FROM documents) + (SELECT count(DISTINCT conv_id) FROM conversations) < 10000 THEN '1K<n<10K'
            WHEN (SELECT count(*) FROM documents) + (SELECT count(DISTINCT conv_id) FROM conversations) < 100000 THEN '10K<n<100K' ELSE '100K<n<1M' END AS size
FROM f
""")
def dataset_stats(spark, sf_dir):
    items = schema.text_items(table(spark, sf_dir, "documents")).unionByName(schema.chat_items(table(spark, sf_dir, "conversations")))
    return export.dataset_stats(items).withColumn("avg_output", F.round("avg_output", 6)).withColumn("size", T.size_label(F.col("items")))


@query("""
SELECT 'text' AS format, count(*)::BIGINT AS n, round(avg(length(coalesce(text, ''))), 6) AS avg_length FROM documents
UNION ALL
SELECT 'chatml', count(*)::BIGINT, round(avg(n), 6) FROM (SELECT sum(length(coalesce(text, ''))) + count(*) - 1 AS n FROM conversations GROUP BY conv_id)
""")
def format_distribution(spark, sf_dir):
    items = schema.text_items(table(spark, sf_dir, "documents")).unionByName(schema.chat_items(table(spark, sf_dir, "conversations")))
    return items.groupBy("format").agg(F.count("*").alias("n"), F.round(F.avg(F.length(schema.display_text())), 6).alias("avg_length"))


# --- duplicates ------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY lower(trim(coalesce(text, '')))")
def exact_dedup_first(spark, sf_dir):
    key = F.sha2(F.lower(F.trim(F.coalesce("text", F.lit("")))), 256)
    return table(spark, sf_dir, "documents").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


_TOKEN_SQL = "regexp_extract_all(text, '[a-zA-Z0-9\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{AC00}-\\x{D7AF}]+')"
_HASHES_SQL = f"""
texts AS (SELECT min(doc_id) AS id, text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text),
toks AS (
  SELECT id, text, CASE WHEN len({_TOKEN_SQL}) > 0 THEN list_transform({_TOKEN_SQL}, lambda x: lower(x))
                        ELSE list_transform(range(1, length(text) - 1), lambda i: lower(substring(text, i, 3))) END AS t FROM texts),
words AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(t) AS w FROM toks) GROUP BY id, w),
hashes AS (
  SELECT w, list_reduce(list_prepend(1469598103934665603::HUGEINT, list_transform(string_split(w, ''), lambda c: ascii(c)::HUGEINT)),
                        lambda a, c: (xor(a, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h
  FROM (SELECT DISTINCT w FROM words)),
halves AS (SELECT id, n, (h // 4294967296)::BIGINT AS hi, (h % 4294967296)::BIGINT AS lo FROM words JOIN hashes USING (w)),
sums AS (
  SELECT id, {", ".join(f"sum(CASE WHEN ({half} >> {i}) & 1 = 1 THEN n ELSE -n END) AS {half}{i}" for half in ("hi", "lo") for i in range(32))}
  FROM halves GROUP BY id),
sim AS (
  SELECT t.id, len(t.text) AS n, list_distinct(t.t) AS t,
         coalesce({" + ".join(f"CASE WHEN hi{i} >= 0 THEN {1 << i}::BIGINT ELSE 0 END" for i in range(32))}, 0) AS hi,
         coalesce({" + ".join(f"CASE WHEN lo{i} >= 0 THEN {1 << i}::BIGINT ELSE 0 END" for i in range(32))}, 0) AS lo
  FROM toks t LEFT JOIN sums USING (id))
"""
_LINKS_SQL = f"""{_HASHES_SQL},
bands AS (SELECT *, unnest([0, 1, 2, 3]) AS band FROM sim),
banded AS (SELECT *, CASE band WHEN 0 THEN lo & 65535 WHEN 1 THEN lo >> 16 WHEN 2 THEN hi & 65535 ELSE hi >> 16 END AS v FROM bands),
pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM banded a JOIN banded b ON a.band = b.band AND a.v = b.v AND a.id < b.id
  WHERE (a.n = 0 OR b.n = 0 OR abs(a.n - b.n) / greatest(a.n, b.n) <= 0.5) AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 6),
links AS (
  SELECT a, b FROM pairs JOIN sim x ON x.id = a JOIN sim y ON y.id = b
  WHERE CASE WHEN len(x.t) + len(y.t) = 0 THEN 1 WHEN len(x.t) = 0 OR len(y.t) = 0 THEN 0
             ELSE len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) END >= 0.9)
"""


@query(f"WITH {_HASHES_SQL} SELECT d.doc_id, hi, lo FROM documents d JOIN texts t ON t.text = coalesce(d.text, '') JOIN sim USING (id)")
def similarity_hash(spark, sf_dir):
    """Of every document; a text of many copies is hashed once."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    distinct = docs.groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("first"), F.first("text").alias("text"))
    members = dedup.classes(docs).select(F.col("id").alias("doc_id"), "first")
    return members.join(dedup.simhash(distinct, "first", "text"), "first").select("doc_id", "hi", "lo")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS class_id FROM documents")
def near_dup_classes(spark, sf_dir):
    """Each document's class of equal texts, which near_dup_links links by their first documents."""
    return dedup.classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("first").alias("class_id"))


@query(f"WITH {_LINKS_SQL} SELECT a, b FROM links")
def near_dup_links(spark, sf_dir):
    return dedup.links(table(spark, sf_dir, "documents"))


@query(f"""
WITH {_LINKS_SQL},
dropped AS (
  SELECT list_reduce(list_prepend([]::BIGINT[][], list(list_value([a, b]) ORDER BY a, b)), lambda d, e:
           CASE WHEN list_contains(list_transform(d, lambda x: x[1]), e[1][1]) OR list_contains(list_transform(d, lambda x: x[1]), e[1][2]) THEN d ELSE list_append(d, [e[1][2]]) END) AS d
  FROM links)
SELECT id AS doc_id FROM texts WHERE id NOT IN (SELECT unnest(list_transform(d, lambda x: x[1])) FROM dropped WHERE d IS NOT NULL)
""")
def near_dup_keep(spark, sf_dir):
    return dedup.kept_ids(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS similarity
FROM u a JOIN u b ON a.vec_id < b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) > 0.95
""")
def semantic_dup_pairs(spark, sf_dir):
    return dedup.semantic_pairs(table(spark, sf_dir, "embeddings")).withColumn("similarity", F.round("similarity", 6))


@query("""
SELECT label::BIGINT AS label, pos::INT AS pos, count(*)::BIGINT AS n, round(avg(x::DOUBLE), 6) AS x
FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos
""")
def embedding_centroids(spark, sf_dir):
    c = dedup.centroids(table(spark, sf_dir, "embeddings"))
    return c.select(F.col("label").cast("bigint").alias("label"), "n", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", "n", F.round("x", 6).alias("x"))


# --- privacy ---------------------------------------------------------------------------------

_RE = {k: p.replace("'", "''") for k, p in {**privacy.PATTERNS, **privacy.CLASS_PATTERNS}.items()}


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{_RE[k]}'))::BIGINT AS {k}" for k in privacy.PATTERNS) + " FROM documents")
def pii_counts(spark, sf_dir):
    counts = privacy.pii_counts(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in counts.items()))


@query()
def pii_redact(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", privacy.inspect()("text").alias("found"))
    return found.select("doc_id", F.sha2("found.redacted", 256).alias("redacted_sha256"), F.size("found.matches").cast("bigint").alias("n_matches"), F.round("found.score", 6).alias("score"))


def _class_sql() -> str:
    n = lambda kinds: " + ".join(f"len(list_distinct(regexp_extract_all(text, '{_RE[k]}')))" for k in kinds) or "0"
    counts = ", ".join(f"({n(kinds)})::BIGINT AS n_{c}" for c, (kinds, *_) in privacy.CLASSES.items())
    risk = lambda c: f"least({privacy.CLASSES[c][1]}, least(1.0, n_{c} * 0.25))"
    rows = ", ".join(f"CASE WHEN n_{c} > 0 THEN {{'r': {risk(c)}::DOUBLE, 'p': {p}, 'c': '{c}', 'd': {d}}} END" for c, (_, _, d, p) in privacy.CLASSES.items())
    cols = ", ".join(f"n_{c}" for c in privacy.CLASSES)
    return f"""
    WITH n AS (SELECT doc_id, {counts} FROM documents), m AS (SELECT *, list_max(list_filter([{rows}], lambda x: x IS NOT NULL)) AS top FROM n)
    SELECT doc_id, {cols}, round(coalesce(top.r, 0), 6)::DOUBLE AS risk, coalesce(top.c, 'none') AS risk_class, coalesce(top.d, 0)::BIGINT AS retention_days FROM m"""


@query(_class_sql())
def classify_risk(spark, sf_dir):
    return privacy.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text")).drop("text").withColumn("risk", F.round("risk", 6))


@query(f"SELECT doc_id, risk_class, 'risk:' || risk_class AS reason FROM ({_class_sql()}) WHERE risk >= 0.25")
def quarantine(spark, sf_dir):
    rows = privacy.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    return privacy.quarantine(rows, 0.25, F.lit("2024-01-01").cast("timestamp")).select("doc_id", "risk_class", "reason")


# --- annotation ------------------------------------------------------------------------------


@query(r"""
SELECT doc_id, CASE WHEN c AND NOT l AND NOT a THEN 'cjk' WHEN l AND NOT c AND NOT a THEN 'latin' WHEN a AND NOT c AND NOT l THEN 'arabic' ELSE 'mixed' END AS script
FROM (SELECT doc_id, regexp_matches(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]') AS c,
             regexp_matches(text, '[A-Za-z\x{C0}-\x{24F}]') AS l, regexp_matches(text, '[\x{600}-\x{6FF}]') AS a FROM documents)
""")
def script_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.script(F.coalesce("text", F.lit(""))).alias("script"))


@query(r"""
WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}\x{FF00}-\x{FFEF}]')) AS k FROM documents)
SELECT doc_id, ceil(length(text) / 4)::BIGINT AS simple, ceil(k + (length(text) - k) / 4)::BIGINT AS cjk_aware, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS words FROM c
""")
def token_estimates(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.simple_tokens(text).alias("simple"), T.cjk_tokens(text).alias("cjk_aware"), F.size(T.whitespace_tokens(text)).cast("bigint").alias("words"))


@query(r"""
SELECT doc_id, CASE WHEN s >= 4 THEN 'hard' WHEN s >= 2 THEN 'medium' ELSE 'easy' END AS difficulty FROM (
  SELECT doc_id, CASE WHEN length(text) > 2000 THEN 2 WHEN length(text) > 500 THEN 1 ELSE 0 END
       + (len(regexp_extract_all(text, '[.!?]+')) > 10)::INT + (length(text) / greatest(1, len(regexp_split_to_array(text, '\s+'))) > 6)::INT
       + regexp_matches(text, '```|function\s|class\s|def\s')::INT + 2 * regexp_matches(text, '\$[^$]+\$|\\frac|\\sum|\\int')::INT AS s FROM documents)
""")
def difficulty(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.difficulty(F.coalesce("text", F.lit(""))).alias("difficulty"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '\\b(?:{v})\\b') THEN '{n}'" for n, v in T.BLOOM) + " ELSE 'remember' END AS bloom FROM documents")
def bloom_level(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.bloom_level(F.coalesce("text", F.lit(""))).alias("bloom"))


@query(rf"""
WITH w AS (SELECT doc_id, unnest(p) AS w, unnest(range(len(p))) AS i FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z\x{{4E00}}-\x{{9FFF}}\x{{3040}}-\x{{309F}}\x{{30A0}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}]+') AS p FROM documents)),
f AS (SELECT doc_id, w, count(*) AS n, min(i) AS first FROM w
      WHERE w NOT IN ({", ".join(repr(x) for x in T.TOPIC_STOP)}) AND CASE WHEN regexp_matches(w, '[\x{{4E00}}-\x{{9FFF}}\x{{3040}}-\x{{309F}}\x{{30A0}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}]') THEN length(w) >= 2 ELSE length(w) > 4 END GROUP BY ALL),
t AS (SELECT doc_id, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM f) WHERE r = 1)
SELECT doc_id, coalesce(w, 'general') AS topic FROM documents LEFT JOIN t USING (doc_id)
""")
def topic(spark, sf_dir):
    return V.top_word(table(spark, sf_dir, "documents"), T.topic_words(F.coalesce("text", F.lit(""))))


@query(r"""
SELECT doc_id, has_code, has_math, has_table, has_image, CASE WHEN n > 5000 OR has_math OR has_code THEN 'hard' WHEN n > 2000 OR has_table THEN 'medium' ELSE 'easy' END AS complexity FROM (
  SELECT doc_id, length(text) AS n, regexp_matches(text, '```|`[^`]+`|function\s|class\s|def\s|import\s|require\(') AS has_code,
         regexp_matches(text, '\$[^$]+\$|\\frac|\\sum|\\int|\\sqrt') AS has_math,
         regexp_matches(text, '\|.*\|.*\|') AND regexp_matches(text, '\|[-:\s]+\|') AS has_table, regexp_matches(text, '!\[.*\]\(.*\)|<img|data:image/') AS has_image FROM documents)
""")
def chunk_traits(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.chunk_traits(F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select("doc_id", "t.has_code", "t.has_math", "t.has_table", "t.has_image", "t.complexity")


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS {k}" for k, p in parsing.CITATIONS.items()) + " FROM documents")
def citations(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in parsing.citation_counts(F.coalesce("text", F.lit(""))).items()))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def item_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id")


# --- planning --------------------------------------------------------------------------------


_CJK_WIDE_SQL = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}\x{FF00}-\x{FFEF}]"
_CJK_TOKENS_SQL = f"ceil(len(regexp_extract_all(coalesce(text, ''), '{_CJK_WIDE_SQL}')) + (length(coalesce(text, '')) - len(regexp_extract_all(coalesce(text, ''), '{_CJK_WIDE_SQL}'))) / 4)::BIGINT"


@query(f"""
WITH RECURSIVE c AS (SELECT source, doc_id, {_CJK_TOKENS_SQL} AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (
  SELECT source, 0::BIGINT AS i, NULL::BIGINT AS doc_id, 0::BIGINT AS t, 0::BIGINT AS used, 0::BIGINT AS out FROM (SELECT DISTINCT source FROM c)
  UNION ALL
  SELECT source, i, doc_id, t, CASE WHEN out = 0 THEN used ELSE least(100000, used + t + out) END, out
  FROM (SELECT c.source, c.i, c.doc_id, c.t, f.used, CASE WHEN 100000 - f.used - 8192 - c.t <= 0 THEN 0 ELSE least(16384, greatest(256, 100000 - f.used - 8192 - c.t)) END AS out
        FROM f JOIN c ON c.source = f.source AND c.i = f.i + 1))
SELECT source, doc_id, t AS prompt_tokens, out AS output_tokens, out = 0 AS skipped FROM f WHERE i > 0
""")
def token_budget_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", T.cjk_tokens(F.col("text")).alias("tokens"))
    return planning.plan_budget(docs, "source", "doc_id", "tokens", planning.Budget(session=100_000))


@query(f"""
WITH c AS (SELECT source, doc_id, {_CJK_TOKENS_SQL} AS t, 1 + doc_id % 3 AS w FROM documents),
s AS (SELECT *, 5000000 - 8192 - sum(t) OVER p AS room, sum(w) OVER p AS weights FROM c WINDOW p AS (PARTITION BY source)),
a AS (SELECT *, CASE WHEN room <= 0 THEN 0 ELSE least(16384, greatest(256, floor(w / weights * room)::BIGINT)) END AS out FROM s),
u AS (SELECT *, coalesce(sum(t + out) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM a)
SELECT source, doc_id, CASE WHEN used >= 5000000 THEN 0 ELSE out END::BIGINT AS output_tokens FROM u
""")
def priority_budget_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", T.cjk_tokens(F.col("text")).alias("tokens"), (1 + F.col("doc_id") % 3).alias("priority"))
    return planning.plan_by_priority(docs, "source", "doc_id", "tokens", "priority", planning.Budget(session=5_000_000))


@query("""
WITH RECURSIVE c AS (SELECT source, doc_id, 3 * length(coalesce(text, '')) + 50 AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE length(coalesce(text, '')) < 500),
f AS (
  SELECT source, 0::BIGINT AS i, NULL::BIGINT AS doc_id, 0::BIGINT AS n, 0::BIGINT AS size, 0::BIGINT AS batch FROM (SELECT DISTINCT source FROM c)
  UNION ALL
  SELECT source, i, doc_id, CASE WHEN fresh THEN 1 ELSE n + 1 END, CASE WHEN fresh THEN c ELSE size + c END, CASE WHEN fresh THEN batch + 1 ELSE batch END
  FROM (SELECT c.source, c.i, c.doc_id, c.c, f.n, f.size, f.batch, f.n > 0 AND (f.n >= 8 OR f.size + c.c > 32000) AS fresh FROM f JOIN c ON c.source = f.source AND c.i = f.i + 1))
SELECT source, doc_id, batch FROM f WHERE i > 0
""")
def batch_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("len"))
    return planning.pack_batches(docs.where("len < 500"), "source", "doc_id", "len")


@query("""
WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= n - 2 * floor(n * 0.1) THEN 'train' WHEN r <= n - floor(n * 0.1) THEN 'validation' ELSE 'test' END AS part FROM h
""")
def split_train_val_test(spark, sf_dir):
    return planning.split(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 0.8, 0.1, 0.1)


_MODELS = "(0, 'a', 'small', 4000, array('speed', 'general'), 0.1D, false), (1, 'a', 'large', 128000, array('code', 'math', 'reasoning', 'general'), 3.0D, true), (2, 'b', 'wide', 32000, array('multilingual', 'general'), 0.5D, false)"


_TRAITS_SQL = f"""
SELECT doc_id, n, has_code, has_math, has_image, multi, CASE WHEN n > 5000 OR has_math OR has_code THEN 'hard' WHEN n > 2000 OR has_table THEN 'medium' ELSE 'easy' END AS complexity FROM (
  SELECT doc_id, length(text) AS n, regexp_matches(text, '{T.CODE}') AS has_code, regexp_matches(text, '{T.MATHS}') AS has_math,
         regexp_matches(text, '{T.TABLE_ROW}') AND regexp_matches(text, '{T.TABLE_RULE}') AS has_table, regexp_matches(text, '{T.IMAGE}') AS has_image,
         regexp_matches(text, '[\\x{{4E00}}-\\x{{9FFF}}\\x{{3040}}-\\x{{309F}}\\x{{30A0}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}]') AND regexp_matches(text, '[a-zA-Z]') AS multi
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
"""


@query(f"""
WITH m(position, provider, model, window_size, strengths, cost, vision) AS (
  VALUES (0, 'a', 'small', 4000, ['speed', 'general'], 0.1::DOUBLE, false), (1, 'a', 'large', 128000, ['code', 'math', 'reasoning', 'general'], 3.0::DOUBLE, true), (2, 'b', 'wide', 32000, ['multilingual', 'general'], 0.5::DOUBLE, false)),
t AS ({_TRAITS_SQL}),
s AS (
  SELECT doc_id, position, provider, model,
    CASE WHEN n > window_size * 0.8::DOUBLE THEN -100 ELSE 10 END + CASE WHEN has_code AND list_contains(strengths, 'code') THEN 30 ELSE 0 END + CASE WHEN has_math AND list_contains(strengths, 'math') THEN 30 ELSE 0 END
    + CASE WHEN multi AND list_contains(strengths, 'multilingual') THEN 25 ELSE 0 END + CASE WHEN has_image THEN CASE WHEN vision THEN 50 ELSE -30 END ELSE 0 END
    + CASE WHEN complexity = 'hard' AND list_contains(strengths, 'reasoning') THEN 15 ELSE 0 END + CASE WHEN list_contains(strengths, 'general') THEN 5 ELSE 0 END - least(cost * 5, 20) AS score
  FROM t, m)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position)::BIGINT AS rank, provider, model, score::DOUBLE AS score FROM s
""")
def model_ranking(spark, sf_dir):
    models = spark.sql(f"SELECT * FROM VALUES {_MODELS} AS t(position, provider, model, context_window, strengths, cost, vision)")
    chunks = table(spark, sf_dir, "documents").select("doc_id", T.chunk_traits(F.coalesce("text", F.lit(""))).alias("traits"))
    return planning.rank_models(chunks, models, "instruction", "doc_id")


_EARLIER_SQL = "earlier AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents JOIN labels USING (doc_id))"


def _earlier(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of all documents, and the keys of an earlier run, which labelled some of them."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", planning.cache_key(F.coalesce("text", F.lit(""))).alias("key"))
    return keyed, keyed.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("key").distinct()


@query(f"WITH {_EARLIER_SQL} SELECT doc_id, sha256(length(coalesce(d.text, ''))::VARCHAR || ':' || coalesce(d.text, '')) AS key FROM documents d WHERE NOT EXISTS (SELECT 1 FROM earlier e WHERE e.text = coalesce(d.text, ''))")
def incremental_new_chunks(spark, sf_dir):
    """Of all documents, those that an earlier run has not processed."""
    keyed, done = _earlier(spark, sf_dir)
    return planning.uncached(keyed, done)


@query(f"""WITH {_EARLIER_SQL}
SELECT count(*)::BIGINT AS requests, count(e.text)::BIGINT AS hits, coalesce(sum(ceil(length(d.text) / 4)) FILTER (WHERE e.text IS NOT NULL), 0)::BIGINT AS saved_tokens,
       round(coalesce(sum(ceil(length(d.text) / 4)) FILTER (WHERE e.text IS NOT NULL), 0) / 1000 * 0.002::DOUBLE, 6) AS saved_cost
FROM documents d LEFT JOIN earlier e ON e.text = coalesce(d.text, '')""")
def cache_hits(spark, sf_dir):
    """All documents against the cache that an earlier run left, with what the hits save."""
    keyed, done = _earlier(spark, sf_dir)
    tokens = table(spark, sf_dir, "documents").select("doc_id", T.simple_tokens(F.col("text")).alias("tokens"))
    cache = done.select("key", F.lit("cached").alias("response"), F.lit("2024-01-02").cast("timestamp").alias("stored_at"))
    return planning.cache_statistics(planning.cached(keyed.join(tokens, "doc_id"), cache, F.lit("2024-01-05").cast("timestamp")), F.col("tokens")).withColumn("saved_cost", F.round("saved_cost", 6))


# --- exports ---------------------------------------------------------------------------------

_MESSAGES_SQL = "m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations)"


def _chat(spark, sf_dir) -> DataFrame:
    return schema.chat_items(table(spark, sf_dir, "conversations"))


def _digest(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("item_id").alias("conv_id"), F.sha2(F.col("line").cast("binary"), 256).alias("line_sha256"))


@query(f"""WITH {_MESSAGES_SQL}
SELECT conv_id, sha256('{{"messages":[' || string_agg('{{"role":' || to_json(role) || ',"content":' || to_json(text) || '}}', ',' ORDER BY i) || ']}}') AS line_sha256 FROM m GROUP BY conv_id""")
def chat_openai(spark, sf_dir):
    return _digest(export.openai_lines(_chat(spark, sf_dir)))


@query(f"""WITH {_MESSAGES_SQL}, n AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS id FROM (SELECT DISTINCT conv_id FROM m))
SELECT conv_id, sha256('{{"id":' || any_value(id) || ',"conversations":[' || string_agg('{{"from":"' || CASE role WHEN 'assistant' THEN 'gpt' WHEN 'system' THEN 'system' ELSE 'human' END || '","value":' || to_json(text) || '}}', ',' ORDER BY i) || ']}}') AS line_sha256
FROM m JOIN n USING (conv_id) GROUP BY conv_id""")
def chat_sharegpt(spark, sf_dir):
    return _digest(export.sharegpt_lines(_chat(spark, sf_dir)))


_PAIRS_SQL = f"""{_MESSAGES_SQL},
s AS (SELECT conv_id, max(text) FILTER (WHERE i = 1 AND role = 'system') AS system FROM m GROUP BY conv_id),
k AS (SELECT conv_id, role, text, i - (system IS NOT NULL)::INT - 1 AS j, coalesce(system, '') AS system FROM m JOIN s USING (conv_id) WHERE NOT (i = 1 AND role = 'system')),
p AS (SELECT u.conv_id, u.j, u.text AS u, a.text AS a, u.system, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.j) AS r
      FROM k u LEFT JOIN k a ON a.conv_id = u.conv_id AND a.j = u.j + 1 AND a.role = 'assistant' WHERE u.j % 2 = 0 AND u.role = 'user')"""


def _template_sql(lead: str, part: str) -> str:
    return f"""WITH {_PAIRS_SQL}, t AS (SELECT conv_id, string_agg({part}, '' ORDER BY j) AS body FROM p GROUP BY conv_id)
    SELECT conv_id, sha256('{{"text":' || to_json({lead} || coalesce(body, '')) || '}}') AS line_sha256 FROM s LEFT JOIN t USING (conv_id)"""


@query(_template_sql("''", "'[INST] ' || CASE WHEN j = 0 AND system <> '' THEN '<<SYS>>' || chr(10) || system || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || u || ' [/INST] ' || coalesce(a, '')"))
def chat_llama2(spark, sf_dir):
    return _digest(export.lines(_chat(spark, sf_dir), "llama2"))


@query(
    _template_sql(
        "'<|begin_of_text|>' || CASE WHEN coalesce(system, '') <> '' THEN '<|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || system || '<|eot_id|>' ELSE '' END",
        "'<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || u || '<|eot_id|>' || coalesce('<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || a || '<|eot_id|>', '')",
    )
)
def chat_llama3(spark, sf_dir):
    return _digest(export.lines(_chat(spark, sf_dir), "llama3"))


@query(_template_sql("''", "'[INST] ' || CASE WHEN r = 1 AND system <> '' THEN system || chr(10) || chr(10) ELSE '' END || u || ' [/INST] ' || coalesce(a, '')"))
def chat_mistral(spark, sf_dir):
    return _digest(export.lines(_chat(spark, sf_dir), "mistral"))


@query("SELECT CASE WHEN count(*) FILTER (WHERE coalesce(text, '') <> '') > count(*) / 2 THEN 'text' ELSE 'instruction,input,output' END AS layout FROM documents")
def csv_layout(spark, sf_dir):
    return export.csv_layout(schema.text_items(table(spark, sf_dir, "documents")))


@query(r"""
WITH e AS (SELECT doc_id, replace(coalesce(text, ''), '"', '""') AS t FROM documents), g AS (SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\-@\t\r]') THEN '''' || t ELSE t END AS t FROM e)
SELECT doc_id, sha256(CASE WHEN regexp_matches(t, '[,"\n\r]') THEN '"' || t || '"' ELSE t END) AS line_sha256 FROM g
""")
def csv_rows(spark, sf_dir):
    lines = export.csv_lines(schema.text_items(table(spark, sf_dir, "documents")))
    return lines.select(F.col("item_id").alias("doc_id"), F.sha2(F.col("line").cast("binary"), 256).alias("line_sha256"))


@query("SELECT doc_id, 0::BIGINT AS file, ((row_number() OVER (ORDER BY doc_id) - 1) // 300)::BIGINT AS part FROM documents")
def export_parts(spark, sf_dir):
    return export.parts(schema.text_items(table(spark, sf_dir, "documents")), 300).withColumnRenamed("item_id", "doc_id")


@query("""
WITH f AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS file FROM documents GROUP BY source)
SELECT doc_id, file::BIGINT AS file, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20)::BIGINT AS part FROM documents JOIN f USING (source)
""")
def per_source_parts(spark, sf_dir):
    return export.parts(schema.text_items(table(spark, sf_dir, "documents")), 20, "source_file").withColumnRenamed("item_id", "doc_id")


# --- pages -----------------------------------------------------------------------------------


@query(r"SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), ' ' || chr(9) || chr(10) || chr(13)), '') AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", readers.title(F.col("html")).alias("title"))


def _sanitize_sql() -> str:
    c = "html"
    for tag in readers.REMOVED:
        c = f"regexp_replace({c}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    c = f"regexp_replace({c}, '(?s)<!--.*?-->', '', 'g')"
    c = f"""regexp_replace({c}, '(?i)\\son[A-Za-z0-9_]+\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>]*)', '', 'g')"""
    return f"""regexp_replace({c}, '(?i)javascript:[^\\s"''<>]*', '', 'g')"""


@query(f"SELECT page_id, sha256({_sanitize_sql()}) AS html_sha256 FROM pages")
def html_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(readers.sanitized(F.col("html")).cast("binary"), 256).alias("html_sha256"))


def _main_sql(c: str) -> str:
    part = lambda p, g=1: f"WHEN regexp_matches({c}, '{p}') THEN regexp_extract({c}, '{p}', {g})"
    quote = "[\"'']"
    return "CASE " + " ".join((
        part(r"(?is)<main\b[^>]*>(.*?)</main\s*>"), part(r"(?is)<article\b[^>]*>(.*?)</article\s*>"),
        part(rf"(?is)<div\b[^>]*role\s*=\s*{quote}main{quote}[^>]*>(.*?)</div\s*>"), part(r"(?is)<div\b[^>]*class\s*=\s*\"[^\"]*\bcontent\b[^\"]*\"[^>]*>(.*?)</div\s*>"),
        part(r"(?is)<body\b[^>]*>(.*?)</body\s*>"),
    )) + f" ELSE {c} END"


_CLEAN_SQL = f"clean AS (SELECT page_id, html, {_sanitize_sql()} AS h FROM pages), main AS (SELECT page_id, html, {_main_sql('h')} AS m FROM clean)"


@query(f"WITH {_CLEAN_SQL} SELECT page_id, sha256(m) AS main_sha256 FROM main")
def html_main(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(readers.main_html(readers.sanitized(F.col("html"))).cast("binary"), 256).alias("main_sha256"))


def _entities_sql(c: str) -> str:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{plain}')"
    return c


_TRIM_SQL = r"'^[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g'"


@query(rf"""
WITH {_CLEAN_SQL},
plain AS (SELECT page_id, html, {_entities_sql(r"regexp_replace(regexp_replace(m, '(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|section|article|blockquote)\s*>', chr(10), 'g'), '<[^>]+>', '', 'g')")} AS t FROM main),
texts AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), {_TRIM_SQL}) AS t FROM plain)
SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), ' ' || chr(9) || chr(10) || chr(13)), '') AS title, sha256(t) AS text_sha256, length(t)::BIGINT AS n_chars FROM texts
""")
def html_to_text(spark, sf_dir):
    return readers.page_texts(table(spark, sf_dir, "pages")).select("page_id", "title", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("bigint").alias("n_chars"))


# --- events ----------------------------------------------------------------------------------


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


@query("SELECT (epoch_ms(ts) // 3600000 * 3600000)::BIGINT AS bucket, count(*)::BIGINT AS n, round(avg(value), 6) AS value, strftime(make_timestamp((epoch_ms(ts) // 3600000 * 3600000000)::BIGINT), '%Y-%m-%dT%H:%M:%S.%gZ') AS label FROM events GROUP BY 1, 4")
def throughput_buckets(spark, sf_dir):
    """Values are added in the order in which rows are stored, as the SQL does on one thread."""
    stored = _events(spark, sf_dir).select("ms", "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    out = metrics.time_buckets(stored, F.col("ms"), 3_600_000, "value", order=["file", "row"])
    return out.withColumn("value", F.round("value", 6))


@query("SELECT user_id, count(*)::BIGINT AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY user_id")
def session_aggregates(spark, sf_dir):
    return metrics.session_aggregates(_events(spark, sf_dir), "user_id", "value").withColumn("avg_value", F.round("avg_value", 6))


@query("SELECT round(avg(value), 2) AS avg_value, max(value) AS peak_value FROM events")
def resource_peak(spark, sf_dir):
    return metrics.peaks(_events(spark, sf_dir), "value")


def _usage(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("provider"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("value").alias("cost"), (F.col("event_id") % 100).cast("bigint").alias("input_tokens"), (F.col("event_id") % 50).cast("bigint").alias("output_tokens"))


_USAGE_SQL = "u AS (SELECT ts, event_type AS provider, 'm' || (user_id % 3) AS model, value AS cost, event_id % 100 AS i, event_id % 50 AS o FROM events)"
_TOTALS_SQL = "round(sum(cost), 6) AS total_cost, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, count(*)::BIGINT AS n"


@query(f"""WITH {_USAGE_SQL}
SELECT 'provider' AS level, provider AS key, {_TOTALS_SQL} FROM u GROUP BY provider
UNION ALL SELECT 'model', provider || '/' || model, {_TOTALS_SQL} FROM u GROUP BY provider, model
UNION ALL SELECT 'daily', strftime(ts, '%Y-%m-%d'), {_TOTALS_SQL} FROM u GROUP BY 2""")
def usage_rollup(spark, sf_dir):
    return metrics.usage_rollup(_usage(spark, sf_dir))


_TIERS = [(0, "click", "m0", 0.5, 1.5), (1, "click", "m1", 0.1, 0.2), (2, "view", "m0", 1.0, 2.0)]
_TIERS_SQL = ", ".join(f"({p}, '{a}', '{m}', {i}::DOUBLE, {o}::DOUBLE)" for p, a, m, i, o in _TIERS)


@query(f"""WITH {_USAGE_SQL}, t(position, provider, model, i_price, o_price) AS (VALUES {_TIERS_SQL}),
f AS (SELECT provider, arg_min(i_price, position) AS i_first, arg_min(o_price, position) AS o_first FROM t GROUP BY provider)
SELECT u.provider, u.model, round(sum(i / 1000 * coalesce(i_price, i_first, 0.03::DOUBLE) + i / 1000 * coalesce(o_price, o_first, 0.06::DOUBLE)), 6) AS cost
FROM u LEFT JOIN t USING (provider, model) LEFT JOIN f ON f.provider = u.provider GROUP BY ALL""")
def cost_estimate(spark, sf_dir):
    tiers = spark.createDataFrame([(*t, "USD") for t in _TIERS], "position int, provider string, model string, input_per_1k double, output_per_1k double, currency string")
    rows = metrics.priced(_usage(spark, sf_dir), tiers)
    return rows.groupBy("provider", "model").agg(F.round(F.sum(metrics.cost(F.col("input_tokens"))), 6).alias("cost"))


@query("SELECT event_type AS operation, count(*)::BIGINT AS n FROM events GROUP BY 1")
def audit_summary(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.col("event_type").alias("operation")).agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS entries, (SELECT count(*) FROM events WHERE event_id < 777)::BIGINT AS broken_at, false AS valid FROM events")
def audit_chain_verify(spark, sf_dir):
    """A log made of events, in which the entry of event 777 was altered."""
    body = lambda kind: metrics.chain_hash(F.col("event_id").cast("string"), kind)
    log = _events(spark, sf_dir).select("event_id", "event_type", body(F.col("event_type")).alias("hash"))
    log = ordering.lagged(ordering.in_ranges(log, ["event_id"]), "hash", "prev_hash").withColumn("prev_hash", F.coalesce("prev_hash", F.lit("0")))
    altered = log.withColumn("event_type", F.when(F.col("event_id") == 777, "altered").otherwise(F.col("event_type")))
    return metrics.verify_chain(altered, "event_id", body(F.col("event_type")))


@query("""
WITH RECURSIVE e AS (SELECT event_id, event_type || ':' || user_id AS s FROM events),
h AS (SELECT event_id, list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(s, ''), lambda c: ascii(c)::HUGEINT)), lambda a, c: (a * 33 + c) % 4294967296) AS h FROM e)
SELECT event_id, lower(to_hex(h::UBIGINT)) AS hash FROM h
""")
def rolling_hash(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", metrics.djb2(F.concat_ws(":", "event_type", F.col("user_id").cast("string"))).alias("hash"))


@query("""
WITH f AS (SELECT event_id, event_type, ts, value < 30 AS failed, sum(CASE WHEN value < 30 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS island FROM events),
s AS (SELECT event_id, event_type, sum(failed::INT) OVER (PARTITION BY event_type, island ORDER BY ts, event_id) AS streak FROM f)
SELECT event_id, event_type, streak::BIGINT AS streak, streak >= 3 AS unhealthy FROM s
""")
def failure_streaks(spark, sf_dir):
    out = metrics.failure_streaks(_events(spark, sf_dir), "event_type", ["ts", "event_id"], F.coalesce(F.col("value") < 30, F.lit(False)))
    return out.select("event_id", "event_type", "streak", "unhealthy")


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def rate_limit_latest(spark, sf_dir):
    return metrics.latest(_events(spark, sf_dir), "event_type", ["ts", "event_id"]).select("event_type", "event_id", "value")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k, sum(n) OVER (PARTITION BY user_id) AS total, count(*) OVER (PARTITION BY user_id) AS d FROM c)
SELECT user_id, event_type AS winner, n::BIGINT AS votes, total::BIGINT AS samples, d::BIGINT AS distinct_answers, round(n / total, 6) AS confidence FROM r WHERE k = 1
""")
def vote(spark, sf_dir):
    return metrics.votes(_events(spark, sf_dir), "user_id", "event_id", "event_type").withColumn("confidence", F.round("confidence", 6))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def ensemble_best(spark, sf_dir):
    return metrics.best_of(_events(spark, sf_dir), "user_id", "event_id", "value").select("user_id", "event_id", "event_type", "value")


@query("""
WITH e AS (SELECT user_id::VARCHAR AS input, event_type AS processing_type, value AS q, event_id FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY coalesce(q, 0) DESC, event_id) AS r FROM e)
SELECT input, event_id, q AS quality_score FROM o WHERE r = 1 ORDER BY coalesce(q, 0) DESC, event_id LIMIT 5
""")
def few_shot_topk(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("input"), F.col("event_type").alias("processing_type"), F.col("value").alias("quality_score"), "event_id")
    return metrics.few_shot(e, 5, "event_id").select("input", "event_id", "quality_score")


@query("""
WITH d AS (SELECT doc_id, (n_chars % 100) / 100 AS score FROM documents)
SELECT doc_id, round(score, 6) AS score, (score >= 0.9 OR row_number() OVER (ORDER BY (score >= 0.9) DESC, score DESC, doc_id) <= 200) AS accepted FROM d
""")
def adversarial_filter(spark, sf_dir):
    graded = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 100 / 100).alias("score"))
    return metrics.filter_graded(graded, 0.9, "doc_id", 200).select("doc_id", F.round("score", 6).alias("score"), "accepted")


@query("SELECT 'k' AS path, 'number' AS type, false AS nullable, props->>'k' AS sample FROM events ORDER BY event_id LIMIT 1")
def props_schema_inference(spark, sf_dir):
    return readers.inferred_schema(readers.json_fields(_events(spark, sf_dir), "event_id", "props"), "event_id")


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def props_flatten(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*)::BIGINT AS n, round(avg(value), 6) AS average, max(value) AS peak FROM events GROUP BY 1")
def streaming_hourly(spark, sf_dir):
    """The events as a stream of files through the windowed average, run until nothing is left."""
    import uuid

    from millrace.streaming import streams

    events = table(spark, sf_dir, "events")
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = streams.files(spark, sf_dir, events.schema, pathGlobFilter="events.parquet", recursiveFileLookup="false")
    averages = streams.bucket_averages(stream, "ts", "1 hour", "value")
    streams.run_to_table(averages, f"{folder}/out", f"{folder}/checkpoint", ["bucket"])
    out = streams.current(spark, f"{folder}/out", ["bucket"])
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n", F.round("average", 6).alias("average"), "peak")


# --- segmentation, parsing, generation -------------------------------------------------------


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.length("chunk").cast("bigint").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_sha256"))


@query()
def chunks_semantic(spark, sf_dir):
    return _chunk_rows(chunking.chunked(table(spark, sf_dir, "documents"), chunking.semantic(F.col("text"), 2000, 100)))


@query(r"""
WITH RECURSIVE cuts AS (
  SELECT doc_id, text, 0::BIGINT AS start, 0::BIGINT AS stop, -1::BIGINT AS i FROM documents WHERE regexp_matches(coalesce(text, ''), '\S')
  UNION ALL
  SELECT doc_id, text, stop, CASE
      WHEN length(text) <= 2000 OR stop + 2000 >= length(text) THEN length(text)
      WHEN regexp_matches(substr(text, stop + 2000, 2), '^[.!?]\s') THEN stop + 2000
      WHEN regexp_matches(substr(text, stop + 1002, 999), '\s') THEN
        stop + 2000 - length(regexp_extract(reverse(substr(text, stop + 1002, 999)), '^\S*')) - CASE WHEN regexp_matches(reverse(substr(text, stop + 1002, 999)), '^\S*\n') THEN 0 ELSE 1 END
      ELSE stop + 2000 END, i + 1
  FROM cuts WHERE stop < length(text)
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS chunk_index, length(c)::BIGINT AS n_chars, sha256(c) AS chunk_sha256
FROM (SELECT doc_id, i, CASE WHEN length(text) <= 2000 THEN text ELSE regexp_replace(substr(text, start + 1, stop - start), '^\s+|\s+$', '', 'g') END AS c FROM cuts WHERE i >= 0) WHERE c <> ''
""")
def chunks_simple(spark, sf_dir):
    return _chunk_rows(chunking.chunked(table(spark, sf_dir, "documents"), chunking.simple(F.col("text"), 2000)))


@query()
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(chunking.split_sentences(F.col("text"))).cast("bigint").alias("n_sentences"))


def _transcripts(spark, sf_dir, first: str, second: str) -> DataFrame:
    """Conversations as labelled lines, a row each; what a system says stands before the first label."""
    label = F.when(F.col("role") == "user", F.lit(first)).when(F.col("role") == "assistant", F.lit(second)).otherwise(F.lit("Note"))
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(label, F.lit(": "), F.coalesce("text", F.lit(""))).alias("line")))).alias("r"))
    return said.select("conv_id", F.array_join(F.col("r.line"), "\n").alias("response"))


def _cleaned_sql(c: str) -> str:
    line = "x"
    for mark, rest in parsing.MARKS:
        line = f"regexp_replace({line}, '{mark}', '{rest}', 'g')"
    dropped = " OR ".join(f"regexp_matches(trim(x, ' ' || chr(9) || chr(13)), '{p}')" for p in parsing.DROPPED_LINES)
    kept = f"list_transform(list_filter(string_split({c}, chr(10)), lambda x: NOT ({dropped})), lambda x: {line})"
    return rf"regexp_replace(regexp_replace(array_to_string({kept}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


_TRANSCRIPT_SQL = f"""
WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lead(role) OVER w AS next_role, lead(coalesce(text, '')) OVER w AS next_text FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), ' ') AS q,
                 CASE WHEN next_role = 'assistant' THEN {_cleaned_sql("next_text")} ELSE '' END AS a FROM said WHERE role = 'user'),
firsts AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(trim(q)) ORDER BY turn) AS r FROM pairs)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS pair_no, sha256(q) AS question, sha256(a) AS answer FROM firsts WHERE r = 1
"""


@query(_TRANSCRIPT_SQL)
def qa_pairs(spark, sf_dir):
    out = parsing.items_from(_transcripts(spark, sf_dir, "Question", "Answer"), "instruction", "conv_id", "response")
    return out.select("conv_id", F.col("pair_no").cast("bigint").alias("pair_no"), F.sha2("question", 256).alias("question"), F.sha2("answer", 256).alias("answer"))


@query(_TRANSCRIPT_SQL)
def turns(spark, sf_dir):
    out = parsing.items_from(_transcripts(spark, sf_dir, "User", "Assistant"), "conversation", "conv_id", "response")
    return out.select("conv_id", F.col("pair_no").cast("bigint").alias("pair_no"), F.sha2("question", 256).alias("question"), F.sha2("answer", 256).alias("answer"))


@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array('Ask about: ' || coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
a AS (SELECT doc_id, 'What is said about ' || array_to_string(w[-6:], ' ') || '?' AS q, array_to_string(w[-12:], ' ') AS a FROM w)
SELECT doc_id, 0::BIGINT AS pair_no, q AS question, {_cleaned_sql("a")} AS answer FROM a
""")
def generated_items(spark, sf_dir):
    """Documents through an offline provider, and the items in its answers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", generate.prompt_of("Ask about: {{text}}", F.coalesce("text", F.lit(""))).alias("prompt"), F.lit("none").alias("model"))
    made = generate.generate(docs, generate.Offline())
    return parsing.items_from(made, "instruction", "doc_id", "response").select("doc_id", F.col("pair_no").cast("bigint").alias("pair_no"), "question", "answer")


# --- relational sinks ------------------------------------------------------------------------


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n
FROM lineitem GROUP BY ALL
""")
def lineitem_rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
