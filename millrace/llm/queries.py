"""Queries of this subpackage's operators, each over its whole table.

Each is one operator with production parameters; the columns are those of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, langid, licenses, lines, media, mixing, ngrams, quality, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: a source is a project, a language and a hundred ids are directories.

    A document whose first line speaks of a licence is a licence file, of its directory or of one
    above it.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    source, lang, bucket = part("source"), part("lang"), F.floor(F.col("doc_id") / 100).cast("string")
    head = F.rlike(F.lower(F.split(F.coalesce("text", F.lit("")), "\n")[0]), F.lit("licen[sc]"))
    level = F.pmod("doc_id", F.lit(3))
    folder = F.when(head & (level == 0), source).when(head & (level == 1), F.concat_ws("/", source, lang)).otherwise(F.concat_ws("/", source, lang, bucket))
    name = F.concat(F.when(head, F.lit("LICENSE-")).otherwise(""), part("doc_id"))
    return docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans all documents, as files of projects, for licences and passes these down the directories."""
    files = document_paths(_table(spark, sf_dir, "documents"))
    return licenses.scan(files, carried=("doc_id",)).select("doc_id", "path", "own", "score", "licence", "inherited_from")


OP1_SQL = f"""
WITH templates(template, name, body) AS (VALUES {", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(licenses.TEMPLATES))}),
tt AS (SELECT template, term, count(*) AS n FROM (SELECT template, unnest(regexp_extract_all(lower(body), '{licenses.TERM}')) AS term FROM templates) GROUP BY ALL),
idf AS (SELECT term, ln((1 + {len(licenses.TEMPLATES)}) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term),
tv AS (SELECT template, term, n * idf AS weight, sqrt(sum(n * idf * n * idf) OVER (PARTITION BY template)) AS norm FROM tt JOIN idf USING (term)),
docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '_') AS source, coalesce(lang, '_') AS lang,
         regexp_matches(lower(string_split(coalesce(text, ''), chr(10))[1]), 'licen[sc]') AS head
  FROM documents
),
files AS (
  SELECT doc_id, text, head,
         CASE WHEN head AND doc_id % 3 = 0 THEN source WHEN head AND doc_id % 3 = 1 THEN source || '/' || lang
              ELSE source || '/' || lang || '/' || (doc_id // 100) END AS dir,
         CASE WHEN head THEN 'LICENSE-' ELSE '' END || doc_id AS base
  FROM docs
),
units AS (
  SELECT doc_id, unit, row_number() OVER () AS u
  FROM (SELECT DISTINCT doc_id, unit FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, true AS line FROM files
    UNION ALL SELECT doc_id, text, false FROM files WHERE head
  ) WHERE NOT line OR regexp_matches(lower(unit), '{licenses.MARKER}'))
),
ut AS (SELECT u, term, count(*) AS n FROM (SELECT u, unnest(regexp_extract_all(lower(unit), '{licenses.TERM}')) AS term FROM units) GROUP BY ALL),
uw AS (SELECT u, term, n * coalesce(idf, ln(1 + {len(licenses.TEMPLATES)}) + 1) AS w FROM ut LEFT JOIN idf USING (term)),
un AS (SELECT u, sqrt(sum(w * w)) AS size FROM uw GROUP BY u),
scored AS (SELECT u, template, round(sum(w * weight) / (any_value(size) * any_value(norm)), 4) AS score FROM uw JOIN tv USING (term) JOIN un USING (u) GROUP BY u, template),
best AS (
  SELECT doc_id, name AS own, score FROM (
    SELECT doc_id, template, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) AS r
    FROM scored JOIN units USING (u) WHERE score >= 0.6
  ) JOIN templates USING (template) WHERE r = 1
),
governed AS (
  SELECT dir AS above, own AS dir_licence FROM (
    SELECT dir, own, row_number() OVER (PARTITION BY dir ORDER BY score DESC, dir || '/' || base) AS r FROM files JOIN best USING (doc_id) WHERE head
  ) WHERE r = 1
),
near AS (
  SELECT dir, above, dir_licence FROM (
    SELECT dir, above, dir_licence, row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) AS r
    FROM (SELECT DISTINCT dir FROM files) f JOIN governed g ON f.dir = g.above OR starts_with(f.dir, g.above || '/')
  ) WHERE r = 1
)
SELECT doc_id, dir || '/' || base AS path, own, coalesce(score, 0.0)::DOUBLE AS score, coalesce(own, dir_licence) AS licence,
       CASE WHEN own IS NULL THEN above END AS inherited_from
FROM files LEFT JOIN best USING (doc_id) LEFT JOIN near USING (dir)
"""


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents to target weights; how much of each the mix takes."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text with a word-end BPE vocabulary."""
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins all documents with each other on 4-word shingles at a Jaccard similarity of 0.85."""
    found = ngrams.NgramJoin(_table(spark, sf_dir, "documents"), n=4, limit=ngrams.Threshold(85, 100)).components()
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT r.a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, coalesce(least(min(l.a), r.a), r.a) AS class_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.a LEFT JOIN links l ON l.b = r.a AND l.same
GROUP BY r.a
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to WARC files and reads the records back."""
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


OP5_SQL = """
WITH sized AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT
  page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM sized LEFT JOIN firsts USING (payload_digest)
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops every line that at least 10 documents hold."""
    return lines.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


OP6_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS no, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT no, doc_id, text, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT no, doc_id, text, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (SELECT *, string_split(text, chr(10)) AS parts FROM docs))
),
frequent AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT (doc_id, text)) >= 10)
SELECT
  any_value(doc_id) AS doc_id,
  count(*)::BIGINT AS n_lines,
  count(f.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (key)
GROUP BY no
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts every document's language from the profiles of two thirds of them."""
    found = langid.identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", (langid.fold() == 1).alias("held_out"), "lang_pred", F.col("score"))


OP7_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (
  SELECT doc_id, lang, text IS NOT NULL AS given, regexp_replace(chr(1) || lower(coalesce(text, '')) || chr(1), '[^\p{L}]+', chr(1), 'g') AS body,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 1 AS held_out
  FROM documents, crc
),
chars AS (SELECT doc_id, string_split(body, '') AS c FROM docs),
grams AS (
  SELECT doc_id, unnest(list_filter(c, lambda x: x <> chr(1))) AS g FROM chars
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) FROM chars
  UNION ALL SELECT doc_id, unnest(list_transform(list_filter(range(1, len(c) - 1), lambda i: c[i + 1] <> chr(1)), lambda i: c[i] || c[i + 1] || c[i + 2])) FROM chars
),
counts AS (SELECT doc_id, g, count(*) AS n FROM grams GROUP BY ALL),
profiles AS (
  SELECT lang, g, r FROM (
    SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS r
    FROM counts JOIN docs USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL AND given GROUP BY lang, g
  ) WHERE r < 300
),
own AS (SELECT doc_id, g, r FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS r FROM counts) WHERE r < 300),
distances AS (
  SELECT doc_id, l.lang, sum(CASE WHEN p.r IS NULL THEN 300 ELSE abs(o.r - p.r) END) AS distance, count(*) AS size
  FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.g = o.g GROUP BY doc_id, l.lang
),
best AS (SELECT doc_id, lang, distance, size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) AS k FROM distances) WHERE k = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1 - distance / (300 * size), 0)::DOUBLE AS score FROM docs LEFT JOIN best USING (doc_id)
"""


#: One conversation that says what the template and its escapes say.
PROBE = r"SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one more that holds control strings; digests of what is read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(PROBE))
    return chat.chat_digests(chat.format_chats(turns))


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
),
placed AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS before
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
pieces AS (
  SELECT *,
    CASE WHEN rn > 1 AND before = role THEN '<next/>'
         ELSE CASE WHEN rn > 1 THEN '</turn>' || chr(10) ELSE '' END
              || '<turn ' || replace(replace(replace(role, chr(92), chr(92) || 's'), '<', chr(92) || 'l'), '>', chr(92) || 'g') || '>' || chr(10)
    END || replace(replace(text, chr(92), chr(92) || 's'), '<', chr(92) || 'l') AS piece
  FROM placed
)
SELECT
  conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(length(piece)) + 8)::BIGINT AS formatted_chars
FROM pieces
GROUP BY conv_id
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every whole text by rules whose accuracies are estimated from all of them."""
    return quality.quality_rules(_table(spark, sf_dir, "documents")).withColumn("quality", F.round("quality", 6))


def _op9_sql(rounds: int = 40, prior: float = 0.01) -> str:
    """The counts, the votes and the rounds of expectation-maximisation, a row a round, with the operator's rules."""
    rules = quality.RULES
    start = {"g": (0.02, 0.49, 0.49), "b": (0.3, 0.3, 0.4)}
    names = [(c, j, v, k) for c in "gb" for j in range(len(rules)) for v, k in ((-1, 0), (1, 1), (0, 2))]
    column = lambda c, j, k: f"{c}{j}{'nyz'[k]}"
    log = lambda c: " + ".join(f"ln(CASE votes[{j + 1}] WHEN -1 THEN {column(c, j, 0)} WHEN 1 THEN {column(c, j, 1)} ELSE {column(c, j, 2)} END)" for j in range(len(rules)))
    posterior = f"1 / (1 + exp(greatest(least((ln(1 - p) + {log('b')}) - (ln(p) + {log('g')}), 500), -500)))"
    weight = {"g": "q", "b": "(1 - q)"}
    step = lambda c, j, v, k: f"(sum(CASE WHEN votes[{j + 1}] = {v} THEN n * {weight[c]} ELSE 0 END) + {prior}::DOUBLE * sum(n) * {start[c][k]}::DOUBLE) / (sum(n * {weight[c]}) + {prior}::DOUBLE * sum(n))"
    words = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.FUNCTION_WORDS))
    return rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM texts),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM windows) WHERE k > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM again) GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_exclaim, len(list_intersect(list_distinct(w), [{words}])) AS n_function
  FROM texts LEFT JOIN covered USING (doc_id)
),
voted AS (SELECT *, [{", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in rules)}] AS votes FROM counts),
patterns AS (SELECT votes, count(*)::DOUBLE AS n FROM voted GROUP BY votes),
em AS (
  SELECT 0 AS i, 0.8::DOUBLE AS p, {", ".join(f"{start[c][k]}::DOUBLE AS {column(c, j, k)}" for c, j, _, k in names)}
  UNION ALL
  SELECT i + 1, (sum(n * q) + 1) / (sum(n) + 2), {", ".join(step(*x) for x in names)}
  FROM (SELECT em.*, votes, n, {posterior} AS q FROM em, patterns WHERE i < {rounds}) GROUP BY i
),
judged AS (SELECT votes, {posterior} AS quality FROM patterns, em WHERE i = {rounds}),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM voted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= 0.5 AS kept, round(quality, 6) AS quality
FROM based JOIN judged USING (votes)
"""


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every whole text as samples in the chunk store and reads it back."""
    return media.media_columns(_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH sized AS (SELECT doc_id, encode(coalesce(text, '')) AS body, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents),
filled AS (SELECT doc_id, body, n_bytes, greatest((n_bytes + 575) // 576, 1) * 576 AS payload_bytes FROM sized),
files AS (
  SELECT *, unhex(hex(body) || repeat('FF', (payload_bytes - n_bytes)::INT)) AS payload
  FROM filled
),
headed AS (
  SELECT *, encode('RIFF') || unhex(printf('%02x%02x%02x%02x', (36 + payload_bytes) & 255, ((36 + payload_bytes) >> 8) & 255, ((36 + payload_bytes) >> 16) & 255, (36 + payload_bytes) >> 24))
         || encode('WAVEfmt ') || unhex('10000000' || '01000100' || '401F0000' || '401F0000' || '01000800') || encode('data')
         || unhex(printf('%02x%02x%02x%02x', payload_bytes & 255, (payload_bytes >> 8) & 255, (payload_bytes >> 16) & 255, payload_bytes >> 24)) || payload AS media
  FROM files
),
crc AS (SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bytes AS (SELECT doc_id, unnest(regexp_extract_all(hex(payload), '..')) AS h FROM headed),
counts AS (SELECT doc_id, ('0x' || h)::BIGINT AS b, count(*) AS n FROM bytes GROUP BY ALL),
sums AS (SELECT doc_id, sum(n * b)::DOUBLE / sum(n) AS mean, sqrt(sum(n * (b - 128) * (b - 128))::DOUBLE / sum(n)) AS rms, list(n ORDER BY b) AS ns, list(b ORDER BY b) AS bs FROM counts GROUP BY doc_id),
shown AS (
  SELECT doc_id, printf('mean=%.3f;rms=%.3f;hist=', mean, rms)
         || array_to_string(list_transform(range(16), lambda k: coalesce(list_sum(list_transform(range(1, len(bs) + 1), lambda i: CASE WHEN bs[i] // 16 = k THEN ns[i] ELSE 0 END)), 0)::BIGINT), ',') AS feature
  FROM sums
),
tails AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(right(hex(payload), 64), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS tail_crc32
  FROM headed, crc
)
SELECT doc_id, n_bytes, payload_bytes::BIGINT AS payload_bytes, sha256(payload) AS payload_sha256, tail_crc32, octet_length(media)::BIGINT AS media_bytes, sha256(media) AS media_sha256, feature
FROM headed JOIN tails USING (doc_id) JOIN shown USING (doc_id)
"""


QUERIES: dict[str, Query] = {
    "op1_licenses": op1_licenses,
    "op2_mix": op2_mix,
    "op3_bpe": op3_bpe,
    "op4_ngram_join": op4_ngram_join,
    "op5_warc": op5_warc,
    "op6_line_dedup": op6_line_dedup,
    "op7_language": op7_language,
    "op8_chat": op8_chat,
    "op9_quality": op9_quality,
    "op10_media": op10_media,
}

ORACLES: dict[str, str] = {
    "op1_licenses": OP1_SQL,
    "op4_ngram_join": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_language": OP7_SQL,
    "op8_chat": OP8_SQL,
    "op9_quality": _op9_sql(),
    "op10_media": OP10_SQL,
}
