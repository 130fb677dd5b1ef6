"""Queries over items: their texts, exports, provenance, validators and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import schema
from millrace.functions import text as T
from millrace.operators import chunking, dedup, export, metrics, parsing, planning, privacy, provenance, reasoning
from millrace.operators import validators as V
from millrace.plans.queries import _CJK_TOKENS_SQL, _KEYWORDS, _LINKS_SQL, _MESSAGES_SQL
from millrace.plans.registry import ORACLES, query, table


def _items(spark, sf_dir) -> DataFrame:
    """Items of all kinds: documents as texts, as pairs or as answers alone, and conversations (ids below 0)."""
    docs = table(spark, sf_dir, "documents")
    kind, text = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    half = (F.length(text) / 2).cast("int")
    one, two = F.substring(text, F.lit(1), half), F.substr(text, half + 1)
    made = schema.as_items(
        docs, "doc_id",
        format=F.when(kind == 0, "text").when(kind == 1, "instruction"),
        instruction=F.when(kind == 1, one), input=F.when(kind == 2, one), output=F.when(kind.isin(1, 2, 3), two),
        text=F.when(kind == 0, F.col("text")), source_file=F.col("source"),
    )
    chats = schema.chat_items(table(spark, sf_dir, "conversations")).withColumn("item_id", -1 - F.col("item_id"))
    return made.unionByName(chats)


_ITEMS_SQL = f"""{_MESSAGES_SQL},
halves AS (SELECT doc_id, text AS whole, coalesce(text, '') AS t, length(coalesce(text, '')) // 2 AS h, doc_id % 4 AS k, source FROM documents),
items AS (
  SELECT doc_id AS item_id, CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'instruction' END AS format, CASE WHEN k = 1 THEN substr(t, 1, h) END AS instruction, CASE WHEN k = 2 THEN substr(t, 1, h) END AS input,
         CASE WHEN k <> 0 THEN substr(t, h + 1) END AS output, CASE WHEN k = 0 THEN whole END AS text, NULL::VARCHAR[] AS roles, NULL::VARCHAR[] AS contents, source AS source_file FROM halves
  UNION ALL
  SELECT -1 - conv_id, 'chatml', NULL, NULL, NULL, NULL, list(role ORDER BY i), list(coalesce(text, '') ORDER BY i), NULL FROM m GROUP BY conv_id)"""
_JOINED = "array_to_string(contents, ' ')"
_ANSWER = "list_filter(list_zip(roles, contents), lambda x: x[1] = 'assistant' AND x[2] <> '')[1][2]"
_LAST_ASKED = "list_filter(list_zip(roles, contents), lambda x: x[1] = 'user' AND x[2] <> '')[-1][2]"
_DISPLAY = f"coalesce(nullif(output, ''), nullif(instruction, ''), nullif(input, ''), nullif({_JOINED}, ''), nullif(text, ''), '')"


@query(f"""WITH {_ITEMS_SQL}
SELECT item_id, sha256({_DISPLAY}) AS shown, sha256(coalesce(nullif(output, ''), {_ANSWER}, nullif(text, ''), '')) AS answer,
       sha256(coalesce(nullif(concat_ws(' ', nullif(instruction, ''), nullif(input, '')), ''), {_LAST_ASKED}, '')) AS question,
       sha256(coalesce(nullif(text, ''), nullif(output, ''), nullif({_JOINED}, ''), nullif(instruction, ''), nullif(input, ''), '')) AS exported FROM items""")
def item_text_coalesce(spark, sf_dir):
    """The texts of an item: what is shown, judged, asked and exported."""
    digest = lambda c: F.sha2(c, 256)
    return _items(spark, sf_dir).select("item_id", digest(schema.display_text()).alias("shown"), digest(schema.answer_text()).alias("answer"), digest(schema.question_text()).alias("question"), digest(schema.export_text()).alias("exported"))


def _lines(df: DataFrame) -> DataFrame:
    return df.select("item_id", F.sha2(F.col("line").cast("binary"), 256).alias("line_sha256"))


_JSON_FIELDS = "concat_ws(',', '\"format\":' || to_json(format), '\"instruction\":' || to_json(instruction), '\"input\":' || to_json(input), '\"output\":' || to_json(output), '\"text\":' || to_json(text), CASE WHEN roles IS NOT NULL THEN '\"messages\":[' || array_to_string(list_transform(list_zip(roles, contents), lambda x: '{\"role\":' || to_json(x[1]) || ',\"content\":' || to_json(x[2]) || '}'), ',') || ']' END)"


@query(f"WITH {_ITEMS_SQL} SELECT item_id, sha256('{{' || {_JSON_FIELDS} || '}}') AS line_sha256 FROM items")
def jsonl_lines(spark, sf_dir):
    return _lines(export.jsonl(_items(spark, sf_dir)))


@query(f"""WITH {_ITEMS_SQL} SELECT item_id, sha256(coalesce(nullif(text, ''), nullif(output, ''), nullif({_JOINED}, ''), nullif(instruction, ''), nullif(input, ''), '')) AS line_sha256 FROM items""")
def text_export(spark, sf_dir):
    return _lines(export.lines(_items(spark, sf_dir), "text"))


@query(f"WITH {_ITEMS_SQL} SELECT item_id, sha256({_DISPLAY} || chr(10)) AS line_sha256 FROM items")
def gui_text_export(spark, sf_dir):
    return _lines(export.lines(_items(spark, sf_dir), "gui_text"))


@query(f"""WITH {_ITEMS_SQL}, n AS (SELECT {_DISPLAY} AS t, item_id, row_number() OVER (ORDER BY item_id) AS n FROM items)
SELECT item_id, sha256('[' || n || '] ' || substr(t, 1, 200) || CASE WHEN length(t) > 200 THEN '...' ELSE '' END) AS line_sha256 FROM n""")
def preview_lines(spark, sf_dir):
    return _lines(export.lines(_items(spark, sf_dir), "preview"))


def _tsv_cell(c: str) -> str:
    g = f"CASE WHEN regexp_matches({c}, '^[=+\\-@]') THEN '''' || {c} ELSE {c} END"
    return f"CASE WHEN regexp_matches({g}, '[\\t\"\\n\\r]') THEN '\"' || replace({g}, '\"', '\"\"') || '\"' ELSE {g} END"


@query(f"WITH {_ITEMS_SQL}, f AS (SELECT item_id, coalesce(instruction, '') AS a, coalesce(input, '') AS b, coalesce(output, '') AS c, coalesce(text, '') AS d FROM items) SELECT item_id, sha256({' || chr(9) || '.join(_tsv_cell(x) for x in 'abcd')}) AS line_sha256 FROM f")
def tsv_rows(spark, sf_dir):
    return _lines(export.lines(_items(spark, sf_dir), "tsv"))


_CSV_CELL = "CASE WHEN regexp_matches(t, '[,\"\\n\\r]') THEN '\"' || t || '\"' ELSE t END"


@query(f"""
WITH e AS (SELECT doc_id, replace(coalesce(text, ''), '"', '""') AS t FROM documents), g AS (SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\\-@\\t\\r]') THEN '''' || t ELSE t END AS t FROM e)
SELECT doc_id AS item_id, sha256(CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN chr(65279) || 'text' || chr(10) ELSE '' END || {_CSV_CELL}) AS line_sha256 FROM g""")
def csv_file(spark, sf_dir):
    """The CSV export as a file has it, with mark and head."""
    return _lines(export.csv_file_lines(schema.text_items(table(spark, sf_dir, "documents"))))


@query("""SELECT (SELECT count(DISTINCT conv_id) FROM conversations)::BIGINT AS chat_items, (SELECT count(*) FROM documents)::BIGINT AS text_items, 'chatml' AS formats""")
def chatml_export(spark, sf_dir):
    """Of items with chats only these are exported, of items without any all."""
    docs = schema.text_items(table(spark, sf_dir, "documents"))
    mixed = export.chatml_items(docs.unionByName(schema.chat_items(table(spark, sf_dir, "conversations"))))
    some = mixed.agg(F.count("*").alias("chat_items"), F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats"))
    return some.join(export.chatml_items(docs).agg(F.count("*").alias("text_items")), F.lit(True))


@query("""SELECT doc_id AS item_id, sha256('  {' || chr(10) || '    "format": "text",' || chr(10) || '    "text": ' || to_json(coalesce(text, '')) || chr(10) || '  }' || CASE WHEN doc_id < (SELECT max(doc_id) FROM documents) THEN ',' ELSE '' END) AS line_sha256 FROM documents""")
def json_array(spark, sf_dir):
    """Documents as the indented entries of one JSON array."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return _lines(export.lines(schema.text_items(docs), "json"))


@query(f"""WITH {_ITEMS_SQL} SELECT item_id, sha256(CASE WHEN format = 'chatml' THEN '[' || array_to_string(list_transform(list_zip(roles, contents), lambda x: '{{"role":' || to_json(x[1]) || ',"content":' || to_json(x[2]) || '}}'), ',') || ']' ELSE '' END) AS messages, (SELECT 'messages') AS columns FROM items""")
def spreadsheet_rows(spark, sf_dir):
    """The columns that a spreadsheet of all items has, and its cells."""
    items = _items(spark, sf_dir)
    rows = export.spreadsheet_rows(items, ["messages"]).select("item_id", F.sha2(F.col("cells")[0], 256).alias("messages"))
    return rows.join(F.broadcast(export.spreadsheet_columns(items).select(F.array_join("columns", ",").alias("columns"))), F.lit(True))


@query(f"""WITH {_ITEMS_SQL}, l AS (SELECT {_DISPLAY} AS t, item_id FROM items), f AS (SELECT * FROM l ORDER BY item_id LIMIT 50)
SELECT floor((SELECT avg(strlen(t || chr(10)) + 1) FROM f) * (SELECT count(*) FROM l) + 0.5)::BIGINT AS bytes""")
def size_estimate(spark, sf_dir):
    return export.size_estimate(_items(spark, sf_dir), export.gui_text_lines).select(F.col("bytes").cast("bigint").alias("bytes"))


@query(r"""SELECT doc_id, regexp_replace(CASE WHEN coalesce(source, '') = '' THEN 'output' ELSE source END || '-jsonl-20240102-' || (doc_id // 100), '[<>:"/\\|?*\x00]', '_', 'g') AS file FROM documents""")
def export_file_names(spark, sf_dir):
    named = export.file_name("{source}-{format}-{date}-{index}", F.concat(F.lit("/data/"), F.col("source"), F.lit(".md")), "jsonl", F.floor(F.col("doc_id") / 100), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    return table(spark, sf_dir, "documents").select("doc_id", named.alias("file"))


@query("SELECT unnest(['format', 'text']) AS name, 'string' AS type")
def json_schema(spark, sf_dir):
    """The fields of the first document's item; a dataset of texts has these two."""
    docs = table(spark, sf_dir, "documents").withColumn("source", F.lit(None).cast("string"))
    return export.json_schema(schema.text_items(docs))


@query(f"""WITH {_ITEMS_SQL} SELECT item_id, sha256(coalesce(nullif(instruction, ''), nullif(input, ''), nullif(text, ''), '')) AS text_sha256, source_file AS label, try_cast(nullif(regexp_extract(source_file, '^\\s*([-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?)', 1), '') AS DOUBLE) AS value FROM items""")
def automl_rows(spark, sf_dir):
    rows = export.automl_rows(_items(spark, sf_dir), F.col("source_file"))
    return rows.select("item_id", F.sha2("text", 256).alias("text_sha256"), "label", "value")


# --- provenance ------------------------------------------------------------------------------


@query("SELECT doc_id AS item_id, coalesce(source, 'unknown') AS source_file, CASE WHEN doc_id % 2 = 0 THEN 'before' ELSE 'now' END AS generated_at FROM documents")
def stamped_items(spark, sf_dir):
    """Stamps keep what is there: half of the items have a time already."""
    items = schema.text_items(table(spark, sf_dir, "documents")).withColumn("generated_at", F.when(F.col("item_id") % 2 == 0, "before"))
    return provenance.stamped(items, F.lit("unknown"), F.lit("now")).select("item_id", "source_file", "generated_at")


@query(f"""WITH {_LINKS_SQL}, kept AS ({ORACLES["near_dup_keep"].split("SELECT id AS doc_id FROM texts")[0].split("dropped AS", 1)[1].join(["SELECT id FROM texts WHERE id NOT IN (SELECT unnest(list_transform(d, lambda x: x[1])) FROM (WITH dropped AS", "SELECT * FROM dropped) WHERE d IS NOT NULL)"])}),
home AS (
  SELECT d.doc_id, d.source, t.id AS first, (SELECT min(a) FROM links WHERE b = t.id AND a IN (SELECT id FROM kept)) AS near FROM documents d JOIN texts t ON t.text = coalesce(d.text, '')),
gone AS (SELECT doc_id, source, CASE WHEN first IN (SELECT id FROM kept) THEN first ELSE near END AS keeper FROM home),
firsts AS (SELECT keeper, source, min(doc_id) AS o FROM gone WHERE keeper <> doc_id AND source IS NOT NULL GROUP BY ALL)
SELECT keeper AS doc_id, array_to_string(list(source ORDER BY o), ',') AS merged_from FROM firsts GROUP BY keeper""")
def near_dup_sources(spark, sf_dir):
    """The sources of the documents that each kept one stands for, as they were first seen."""
    docs = table(spark, sf_dir, "documents")
    edges = dedup.links(docs)
    kept = dedup.first_kept(dedup.classes(docs).select(F.col("first").alias("id")).distinct(), edges)
    gone = dedup.keepers(docs, kept, edges)
    tagged = provenance.tagged(docs.select(F.col("doc_id").alias("id"), "source"), source_file=F.col("source"))
    return provenance.sources(tagged.join(gone, "id"), "keeper", "id").select(F.col("keeper").alias("doc_id"), F.array_join("merged_from", ",").alias("merged_from"))


# --- validators and answers ------------------------------------------------------------------


@query(f"SELECT * FROM (SELECT category, count(*)::BIGINT AS items, sum(n)::BIGINT AS n, round(greatest(0, 1 - sum(n) * 0.1::DOUBLE), 6) AS score FROM (UNPIVOT ({ORACLES['bias']}) ON {', '.join(V.BIAS_TERMS)} INTO NAME category VALUE n) WHERE n > 0 GROUP BY category)")
def bias_report(spark, sf_dir):
    return V.bias_report(table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))).withColumn("score", F.round("score", 6))


@query(f"""
WITH l AS (SELECT doc_id, length(text) AS n, {_CJK_TOKENS_SQL} AS t FROM documents), s AS (SELECT avg(n) AS mn, stddev_pop(n) AS dn, avg(t) AS mt, stddev_pop(t) AS dt FROM l),
z AS (SELECT doc_id, (n - mn) / dn AS a, (t - mt) / dt AS b FROM l, s)
SELECT doc_id, 1 - CASE WHEN abs(a) > 2 THEN 0.5 ELSE 0 END::DOUBLE - CASE WHEN abs(b) > 2 THEN 0.5 ELSE 0 END::DOUBLE AS score, (abs(a) > 2 AND abs(b) > 2) AS listed FROM z""")
def length_token_outliers(spark, sf_dir):
    return V.length_and_token_outlier(table(spark, sf_dir, "documents"), F.length("text"), T.cjk_tokens(F.col("text"))).select("doc_id", "score", "listed")


_TOKENS_SQL = "list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_'']+'))"


@query(r"""
WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '\b[\w'']+\b')) AS p FROM benchmark),
c AS (SELECT doc_id, regexp_extract_all(lower(text), '\b[\w'']+\b') AS h FROM documents WHERE text IS NOT NULL),
s AS (SELECT item_id, doc_id, CASE WHEN len(h) = 0 THEN 0.9 WHEN k / len(h) >= 0.8 THEN 0.9 WHEN k / len(h) >= 0.3 THEN 0.5 ELSE 0.1 END::DOUBLE AS score
      FROM (SELECT item_id, doc_id, h, len(list_filter(h, lambda x: list_contains(p, x))) AS k FROM b, c WHERE doc_id % 40 = item_id % 40))
SELECT item_id, doc_id, score, score >= 0.7 AS passed FROM s""")
def entailment_vs_benchmark(spark, sf_dir):
    """Each document against one benchmark passage, by their ids: whether the passage entails it."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text", (F.col("item_id") % 40).alias("k"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("k"))
    return V.entailed(docs, bench, "k", "doc_id", "item_id")


@query(f"""
WITH q AS (SELECT d.doc_id, list_filter(regexp_extract_all(lower(b.text), '\\b[a-z]+\\b'), lambda x: NOT list_contains([{', '.join(repr(w) for w in V.STOP_WORDS)}], x)) AS k, lower(d.text) AS low,
                  {_KEYWORDS.replace("text", "d.text")} AS told, length(d.text) AS n FROM documents d JOIN benchmark b ON b.item_id % 40 = d.doc_id % 40 WHERE d.text IS NOT NULL),
h AS (SELECT doc_id, k, n, len(list_filter(k, lambda t: contains(low, t) OR len(list_filter(told, lambda w: contains(w, t) OR contains(t, w))) > 0)) AS hit FROM q)
SELECT doc_id, round(CASE WHEN len(k) = 0 THEN CASE WHEN n > 0 THEN 1 ELSE 0 END ELSE hit / len(k) END, 6)::DOUBLE AS score FROM h""")
def completeness_vs_benchmark(spark, sf_dir):
    """How much of a benchmark passage's keywords each document answers."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("text").alias("asked"), (F.col("item_id") % 40).alias("k"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", (F.col("doc_id") % 40).alias("k"))
    return docs.join(bench, "k").select("doc_id", F.round(V.completeness(F.col("asked"), F.col("text"))["score"], 6).alias("score"))


@query(r"""
WITH p AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]*'), lambda x: NOT contains(x, '?')), lambda x: regexp_replace(regexp_replace(x, '[.!?]+$', ''), '^\s+|\s+$', '', 'g')) AS c FROM documents)
SELECT doc_id, len(list_filter(c, lambda x: x <> '' AND NOT regexp_matches(lower(x), 'i think|maybe|perhaps')))::BIGINT AS claims FROM p""")
def claims(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(V.claims(F.coalesce("text", F.lit("")))).cast("bigint").alias("claims"))


@query("""SELECT vec_id FROM embeddings v WHERE NOT EXISTS (SELECT 1 FROM embeddings u WHERE u.vec_id < v.vec_id AND list_cosine_similarity(u.embedding::DOUBLE[], v.embedding::DOUBLE[]) > 0.95)""")
def semantic_dup_keep(spark, sf_dir):
    return dedup.semantic_kept(table(spark, sf_dir, "embeddings")).select(F.col("id").alias("vec_id"))


@query()
def diversity(spark, sf_dir):
    """Vectors of each label in order: whether their clusters have become too large."""
    out = V.diverse(table(spark, sf_dir, "embeddings"), "vec_id", "label")
    return out.select("vec_id", "cluster_size", "passed", F.round("score", 6).alias("score"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'why ' || doc_id ELSE '' END AS reasoning, CASE WHEN doc_id % 3 = 2 THEN 'plain ' || doc_id ELSE 'so ' || doc_id END AS answer FROM documents""")
def chain_of_thought(spark, sf_dir):
    """Answers with both tags, with one and with none."""
    n, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    tagged = F.concat(F.lit("x <Answer> so "), n, F.lit("\n</answer>"))
    response = F.when(kind == 0, F.concat(F.lit("<reasoning>\nwhy "), n, F.lit("</reasoning>"), tagged)).when(kind == 1, tagged).otherwise(F.concat(F.lit(" plain "), n, F.lit("\n")))
    return table(spark, sf_dir, "documents").select("doc_id", reasoning.chain_of_thought(response).alias("r")).select("doc_id", "r.reasoning", "r.answer")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'root > ' || CASE WHEN doc_id % 10 > 4 THEN 'a > a1' ELSE 'b' END ELSE 'no tree ' || doc_id END AS path, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 10 > 4 THEN 'a1' ELSE 'b' END ELSE 'no tree ' || doc_id END AS solution FROM documents""")
def tree_of_thought(spark, sf_dir):
    """Trees whose best branch depends on the document, and answers that are none."""
    score = (F.col("doc_id") % 10 / 10).cast("string")
    tree = F.concat(F.lit('{"thought":"root","branches":[{"thought":"b","score":0.45,"is_solution":true,"children":[{"thought":"c","score":1}]},{"thought":"a","score":'), score, F.lit(',"sub_branches":[{"thought":"a1","score":0.1}]}]}'))
    response = F.when(F.col("doc_id") % 2 == 0, tree).otherwise(F.concat(F.lit("no tree "), F.col("doc_id").cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", reasoning.tree_of_thought(response).alias("t"))
    return rows.select("doc_id", F.array_join("t.path", " > ").alias("path"), "t.solution")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN 1 ELSE doc_id % 5 END::BIGINT AS hops, CASE doc_id % 5 WHEN 0 THEN 'Only 1 hops, minimum is 2' WHEN 1 THEN 'Only 1 hops, minimum is 2' WHEN 2 THEN 'Only 1 source chunks, need at least 2' WHEN 3 THEN 'Negative chunk index in sourceChunks' ELSE 'Only 1 hops, minimum is 2' END AS fault
FROM (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) UNION ALL SELECT doc_id, 1, 'Only 1 hops, minimum is 2' FROM documents WHERE doc_id % 5 = 0""")
def multi_hop(spark, sf_dir):
    """Questions over several chunks, as JSON with all kinds of faults and as plain text."""
    kind = F.col("doc_id") % 5
    listed = F.when(kind == 2, "[0]").when(kind == 3, "[0,-1,2]").otherwise("[0,1]")
    made = F.concat(F.lit('{"question":"q","answer":"a","hops":'), kind.cast("string"), F.lit(',"source_chunks":'), listed, F.lit(',"reasoning":"r"}'))
    rows = table(spark, sf_dir, "documents").select("doc_id", reasoning.multi_hop(F.when(kind == 4, F.lit("not json")).otherwise(made)).alias("q"))
    return rows.select("doc_id", "q.hops", reasoning.multi_hop_fault(F.col("q")).alias("fault"))


@query("""WITH s AS (SELECT doc_id, (n_chars % 10) / 10 AS a, (n_chars % 7) / 7 AS b FROM documents)
SELECT count(*)::BIGINT AS items, round(avg(a), 6) AS mean_before, round(avg(greatest(a, b)), 6) AS mean_after, count(*) FILTER (WHERE b > a)::BIGINT AS improved FROM s""")
def regeneration_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = reasoning.regeneration_summary(docs.select("doc_id", (F.col("n_chars") % 10 / 10).alias("score")), docs.select("doc_id", (F.col("n_chars") % 7 / 7).alias("score")), "doc_id")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_before", "mean_after")})


@query("""WITH g AS (SELECT doc_id, (n_chars % 100) / 100 AS score FROM documents)
SELECT count(*)::BIGINT AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std_dev, min(score) AS least, max(score) AS greatest, round(quantile_cont(score, 0.5), 6) AS median FROM g""")
def grade_summary(spark, sf_dir):
    graded = table(spark, sf_dir, "documents").select((F.col("n_chars") % 100 / 100).alias("score"))
    out = metrics.distribution(graded, "score")
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("std_dev", 6).alias("std_dev"), "least", "greatest", F.round("median", 6).alias("median"))


@query("""WITH g AS (SELECT doc_id, (n_chars % 100) / 100 AS score FROM documents), a AS (SELECT score, score >= 0.9 OR row_number() OVER (ORDER BY (score >= 0.9) DESC, score DESC, doc_id) <= 200 AS ok FROM g)
SELECT count(*)::BIGINT AS items, count(*) FILTER (WHERE ok)::BIGINT AS accepted, round(count(*) FILTER (WHERE ok) / count(*), 6) AS acceptance_rate, round(count(*) FILTER (WHERE NOT ok) / count(*), 6) AS filter_rate, round(avg(score), 6) AS average_score FROM a""")
def grade_rates(spark, sf_dir):
    graded = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 100 / 100).alias("score"))
    out = metrics.grade_rates(metrics.filter_graded(graded, 0.9, "doc_id", 200))
    return out.withColumns({c: F.round(c, 6) for c in ("acceptance_rate", "filter_rate", "average_score")})


@query("""WITH c AS (SELECT 'page' AS kind, unnest(regexp_extract_all(coalesce(text, '') || ' [page ' || (doc_id % 7) || '] [L ' || (doc_id % 3) || ']', '\\[(?:page|p\\.)\\s*(\\d+)\\]', 1)) AS place FROM documents
UNION ALL SELECT 'line', unnest(regexp_extract_all(coalesce(text, '') || ' [page ' || (doc_id % 7) || '] [L ' || (doc_id % 3) || ']', '\\[(?:line|L)\\s*(\\d+)\\]', 1)) FROM documents)
SELECT kind, place, count(*)::BIGINT AS n FROM c GROUP BY ALL""")
def citation_places(spark, sf_dir):
    """How often pages and lines are cited, in texts that each cite one of both more."""
    n = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" [page "), (n % 7).cast("string"), F.lit("] [L "), (n % 3).cast("string"), F.lit("]"))
    return parsing.citation_places(table(spark, sf_dir, "documents"), text)


@query(r"""SELECT doc_id, doc_id % 2 = 0 AS supported, CASE WHEN doc_id % 2 = 0 THEN '[page 1, line 2]' ELSE '[url http://x/' || doc_id || ']' END AS shown FROM documents""")
def citation_support(spark, sf_dir):
    """Citations against the spans of their sources, and as they are shown."""
    even = F.col("doc_id") % 2 == 0
    null = F.lit(None).cast("string")
    cited = F.struct(F.when(even, "1").alias("page"), F.when(even, "2").alias("line"), F.when(~even, F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))).alias("url"), null.alias("doi"), null.alias("isbn"))
    spans = F.array(F.struct(F.lit("1").alias("page"), F.lit("2").alias("line"), F.lit("http://x/").alias("url"), null.alias("doi"), null.alias("isbn")))
    return table(spark, sf_dir, "documents").select("doc_id", parsing.cited_in(cited, spans).alias("supported"), parsing.shown(cited).alias("shown"))


@query(r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN least(1, doc_id % 13 / 10) WHEN 1 THEN doc_id % 13 / 10 WHEN 2 THEN 0.5 ELSE 0 END::DOUBLE AS score FROM documents""")
def grades(spark, sf_dir):
    """Grades as JSON (kept within 0 and 1), after the word score, missing, and below 0."""
    value = (F.col("doc_id") % 13 / 10).cast("string")
    kind = F.col("doc_id") % 4
    response = F.when(kind == 0, F.concat(F.lit('{"score": '), value, F.lit("}"))).when(kind == 1, F.concat(F.lit("Score: "), value)).when(kind == 2, "fine").otherwise('{"score": -3}')
    return table(spark, sf_dir, "documents").select("doc_id", parsing.grade(response).alias("score"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'hard' END AS difficulty, CASE WHEN doc_id % 3 < 2 THEN 'topic ' || doc_id END AS topic, CASE WHEN doc_id % 3 = 0 THEN 'apply' END AS bloom_level FROM documents""")
def answer_tags(spark, sf_dir):
    """Tags in JSON, known ones, with an unknown level, and in text that isn't JSON."""
    n = F.col("doc_id")
    made = F.concat(F.lit('{"difficulty":"HARD","topic":" topic '), n.cast("string"), F.lit(' ","bloomLevel":"'), F.when(n % 3 == 0, "Apply").otherwise("soar"), F.lit('"}'))
    rows = table(spark, sf_dir, "documents").select("doc_id", parsing.tags(F.when(n % 3 < 2, made).otherwise("none")).alias("t"))
    return rows.select("doc_id", "t.*")


@query("""WITH p AS (SELECT doc_id, unnest([0, 1, 2]) AS part FROM documents) SELECT doc_id, part::INT AS part, CASE WHEN part < 1 + doc_id % 3 THEN 'answer ' || doc_id || '-' || part ELSE '' END AS answer FROM p""")
def batched_answers(spark, sf_dir):
    """Answers to three chunks in one response, of which some are missing."""
    n = F.col("doc_id").cast("string")
    response = F.array_join(F.transform(F.sequence(F.lit(0), F.col("doc_id") % 3), lambda i: F.concat(F.lit("--- CHUNK "), (i + 1).cast("string"), F.lit(" ---\nanswer "), n, F.lit("-"), i.cast("string"), F.lit("\n"))), "")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parsing.unbatch(response, F.lit(3))).alias("part", "answer"))


@query("""WITH c AS (SELECT conv_id, turn, lower(trim(coalesce(text, ''))) AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, t ORDER BY turn) AS r FROM c) WHERE r = 1""")
def distinct_questions(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.lower(F.trim(F.coalesce("text", F.lit("")))))
    return dedup.exact_first(asked, key, "turn").select("conv_id", "turn")


# --- scalars ---------------------------------------------------------------------------------


@query("""
WITH u AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: ascii(c)::BIGINT) AS p FROM documents),
h AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, p), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM u)
SELECT d.doc_id, CASE WHEN coalesce(h, 0) >= 2147483648 THEN h - 4294967296 ELSE coalesce(h, 0) END AS hash FROM documents d LEFT JOIN h USING (doc_id)""")
def text_hash32(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.hash32(F.coalesce("text", F.lit(""))).alias("hash"))


@query("""
WITH b AS (SELECT doc_id, strlen(coalesce(text, '')) * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END AS n FROM documents),
u AS (SELECT doc_id, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS i FROM b)
SELECT doc_id, CASE WHEN n = 0 THEN '0 bytes' ELSE regexp_replace(printf('%.2f', round(n / pow(1024, i), 2)), '\\.?0+$', '') || ' ' || CASE i WHEN 0 THEN CASE WHEN n = 1 THEN 'byte' ELSE 'bytes' END WHEN 1 THEN 'KB' WHEN 2 THEN 'MB' ELSE 'GB' END END AS size FROM u""")
def size_labels(spark, sf_dir):
    factor = F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 1000).otherwise(1_000_000)
    return table(spark, sf_dir, "documents").select("doc_id", T.size_text(F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint") * factor).alias("size"))


@query("""SELECT doc_id, (doc_id * 977) // 3600000 AS h, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration,
printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS stamp FROM (SELECT doc_id, doc_id * 977 AS ms, (doc_id * 977 * 10) // 1000 AS s FROM documents)""")
def time_labels(spark, sf_dir):
    ms = F.col("doc_id") * 9770
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") * 977 / 3_600_000).cast("bigint").alias("h"), T.duration_label(ms).alias("duration"), T.timestamp_label(ms / 1000).alias("stamp"))


@query("SELECT page_id, regexp_matches(lower(url), '^https?://[^/ ]+') AS valid, NOT regexp_matches(lower(url), '^https?://[^/ ]+') AS other FROM pages")
def web_addresses(spark, sf_dir):
    """Addresses of pages, and the same without their scheme, which are none."""
    return table(spark, sf_dir, "pages").select("page_id", T.valid_url(F.col("url")).alias("valid"), T.valid_url(F.regexp_replace("url", "(?i)^https?:", "ftp:")).alias("other"))


@query("SELECT doc_id, coalesce(lang, '') IN ('ar', 'he') OR doc_id % 4 = 0 AS rtl FROM documents")
def right_to_left(spark, sf_dir):
    locale = F.when(F.col("doc_id") % 4 == 0, F.lit(" AR-eg ")).otherwise(F.coalesce("lang", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", T.right_to_left(locale).alias("rtl"))


@query("SELECT doc_id, 'Intro ' || doc_id || chr(10) || chr(10) || 'OUTPUT FORMAT' || chr(10) || 'x' AS prompt FROM documents")
def prompts_without_thinking(spark, sf_dir):
    prompt = F.concat(F.lit("Intro "), F.col("doc_id").cast("string"), F.lit("\n2. Before producing output, verify\nall steps.\nOUTPUT FORMAT\nx"))
    return table(spark, sf_dir, "documents").select("doc_id", T.without_thinking(prompt).alias("prompt"))


@query("SELECT doc_id, true AS same, true AS refused FROM documents")
def encrypted_texts(spark, sf_dir):
    """Texts under AES-GCM and back; another key gives nothing."""
    key, other = F.lit(b"0123456789abcdef"), F.lit(b"fedcba9876543210")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("e", T.encrypted(F.col("text"), key)).select("doc_id", (T.decrypted(F.col("e"), key) == F.col("text")).alias("same"), T.decrypted(F.col("e"), other).isNull().alias("refused"))


@query(r"""
WITH r AS (SELECT doc_id, coalesce(text, '') || ' a.b@c.org 4111-1111-1111-1111 123-45-6789 555-123-4567 sk-abcdefghijklmnop1234' AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\b(?:\d{4}[-\s]?){3}\d{4}\b', '[CARD]', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[SSN]', 'g'), '\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b', '[PHONE]', 'g'), '\b(?:sk|pk|api)[-_][A-Za-z0-9]{16,}\b', '[KEY]', 'g')) AS line_sha256 FROM r""")
def log_redaction(spark, sf_dir):
    line = F.concat(F.coalesce("text", F.lit("")), F.lit(" a.b@c.org 4111-1111-1111-1111 123-45-6789 555-123-4567 sk-abcdefghijklmnop1234"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.redact_log(line), 256).alias("line_sha256"))


@query("""WITH c AS (SELECT doc_id, text, len(regexp_split_to_array(text, '\\s+')) / length(text) * (length(text) / 1) / 50 AS x FROM documents WHERE coalesce(text, '') <> '' AND NOT regexp_matches(text, '[.!?\\n\\r。！？]'))
SELECT doc_id, round(least(1, x), 6) AS density FROM c WHERE length(text) > 0""")
def density_of_fragments(spark, sf_dir):
    """Density of texts that are one sentence, of which it is the words over 50."""
    rows = table(spark, sf_dir, "documents").where(F.coalesce("text", F.lit("")) != "").where(~F.rlike("text", F.lit(r"[.!?\n\r。！？]")))
    return rows.select("doc_id", F.round(chunking.density_of(F.col("text")), 6).alias("density"))


@query()
def chunks_of_documents(spark, sf_dir):
    """Chunks as an application makes them: the size within its bounds, an overlap, and simple chunks where there are none."""
    found = chunking.chunked(table(spark, sf_dir, "documents"), chunking.documents(F.col("text"), 700))
    return found.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.sha2("chunk", 256).alias("chunk_sha256"))


@query("SELECT doc_id, source, CASE WHEN n_chars % 100 < 25 THEN 'rejected' WHEN r > 1 THEN 'skipped' ELSE 'added' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY source, n_chars % 100 < 25 ORDER BY doc_id) AS r FROM documents)")
def file_admission(spark, sf_dir):
    """Documents offered as files that are named after their sources; a quarter is too large."""
    files = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat("source", F.lit(".txt")).alias("name"), F.when(F.col("n_chars") % 100 < 25, 1 << 30).otherwise(1).alias("size"))
    return planning.admit(files, ["txt", "md"], "doc_id").select("doc_id", "source", "outcome")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 OR doc_id >= 500")
def retained_items(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("deleted_at", F.when(F.col("doc_id") % 5 == 0, F.col("doc_id")))
    return privacy.retained(docs, "deleted_at", 500).select("doc_id")


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pii' WHEN 1 THEN 'financial' WHEN 2 THEN 'secret' WHEN 3 THEN 'health' WHEN 4 THEN 'pii' ELSE 'financial' END AS class FROM documents")
def classes_of_names(spark, sf_dir):
    names = F.array(*map(F.lit, ("my_email", "IBAN number", "apiToken", "Patient", "colour", "credit key")))
    return table(spark, sf_dir, "documents").select("doc_id", privacy.kind_of_name(F.get(names, (F.col("doc_id") % 6).cast("int"))).alias("class"))


@query("SELECT doc_id, 'count,doc' AS keys FROM documents")
def scrubbed_properties(spark, sf_dir):
    made = F.create_map(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("userName"), F.lit("x"), F.lit("api_key"), F.lit("y"), F.lit("count"), F.lit("1"), F.lit("Auth.Header"), F.lit("z"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.map_keys(privacy.scrub(made))), ",").alias("keys"))
