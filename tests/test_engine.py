"""The engine's operators on the literals that define them."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace import schema
from millrace.functions import text as T
from millrace.operators import chunking, dedup, export, generate, metrics, parsing, planning, privacy
from millrace.operators import validators as V
from millrace.plans.pipeline import Pipeline, Registry, keep, validated, with_columns
from millrace.sources import formats, readers


@pytest.fixture(scope="module")
def temporary(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")


def column(spark, c, *values):
    return [r[0] for r in texts(spark, *values).orderBy("doc_id").select(c).collect()]


# --- text ---


def test_token_estimates(spark):
    assert column(spark, T.simple_tokens(F.col("text")), "", "abcd", "abcde", "hello world") == [0, 1, 2, 3]
    assert column(spark, T.cjk_tokens(F.col("text")), "", "漢字", "漢字ab", None) == [0, 2, 3, 0]


def test_scripts(spark):
    assert column(spark, T.script(F.col("text")), "hello", "你好", "مرحبا", "hello 你好", "123") == ["latin", "cjk", "arabic", "mixed", "mixed"]


def test_boundaries_are_ascii(spark):
    assert column(spark, T.matches(F.col("text"), r"\bb\b"), "éb", "b", "xb") == [1, 1, 0]


def test_trim_and_lengths(spark):
    assert column(spark, T.js_trim(F.col("text")), "  a b﻿\n") == ["a b"]
    assert column(spark, T.utf16_length(F.col("text")), "a🙂", "é", "") == [3, 1, 0]


def test_csv_escape(spark):
    cells = ["plain", "=SUM(A1)", "+1", "-1", "@u", 'a"b', "a,b", "a\nb"]
    assert column(spark, T.csv_escape(F.col("text")), *cells) == ["plain", "'=SUM(A1)", "'+1", "'-1", "'@u", '"a""b"', '"a,b"', '"a\nb"']


def test_levels(spark):
    assert column(spark, T.bloom_level(F.col("text")), "Design it", "Compare these", "Explain it", "none") == ["create", "analyze", "understand", "remember"]
    assert column(spark, T.difficulty(F.col("text")), "Short.", "```code``` " + "word " * 500 + "$x$") == ["easy", "hard"]


def test_labels(spark):
    assert column(spark, T.duration_label(F.length("text") * 61_000), "a" * 60, "aa", "") == ["1h 1m 0s", "2m 2s", "0s"]
    assert column(spark, T.timestamp_label(F.lit(3725.9)), "") == ["01:02:05"]
    assert "[EMAIL]" in column(spark, T.redact_log(F.col("text")), "from a@b.org")[0]


# --- items and validators ---


def items(spark, *rows):
    fields = ", ".join(f"{k} {v}" for k, v in schema.ITEM_FIELDS.items())
    full = [tuple([i, *(r.get(k) for k in schema.ITEM_FIELDS)]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, f"item_id bigint, {fields}")


def test_reasons(spark):
    msg = lambda *m: {"messages": [{"role": r, "content": c} for r, c in m]}
    rows = [
        {"instruction": "Why?", "output": "Because it is a long answer."},
        {"instruction": "", "output": ""},
        {"instruction": "Why?"},
        {"output": "only an answer of some length"},
        {"instruction": "Why?", "output": "x" * 19},
        {"instruction": "为什么", "output": "a latin answer that is long"},
        {"text": "short"},
        {"text": "long enough to be fine here"},
        {"messages": []},
        msg(("user", "Hi"), ("assistant", "")),
        msg(("user", "Hi"), ("assistant", "too short")),
        msg(("user", "Hello there"), ("assistant", "An answer that is long enough.")),
    ]
    got = [r[0] for r in items(spark, *rows).orderBy("item_id").select(V.reasons()).collect()]
    assert got == [[], ["missing_question", "missing_answer"], ["missing_answer"], ["missing_question"], ["answer_too_short"], ["language_mismatch"], ["answer_too_short"], [], ["missing_answer"], ["missing_answer"], ["answer_too_short"], []]
    report = V.report(items(spark, *rows), V.reasons()).first()
    assert (report["total"], report["flagged"], report["pass_rate"]) == (12, 9, 25)


def test_item_texts(spark):
    df = items(spark, {"output": "", "text": "t"}, {"instruction": "q", "input": "i", "output": "a"}, {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "b"}]})
    get = lambda c: [r[0] for r in df.orderBy("item_id").select(c).collect()]
    assert get(schema.dedup_text()) == ["t", "a", "u b"]
    assert get(schema.answer_text()) == ["t", "a", "b"]
    assert get(schema.question_text()) == ["", "q i", "u"]
    assert [[m["role"] for m in r] for r in get(schema.all_messages())] == [["assistant"], ["user", "assistant"], ["user", "assistant"]]


def test_word_validators(spark):
    score = lambda v, *t: [round(x, 6) for x in column(spark, v(F.col("text"))["score"], *t)]
    assert score(V.bias, "the chairman and the policeman", "fine") == [0.8, 1.0]
    assert score(V.toxicity, "you idiot", "a hellish shell", "s*** here") == [0, 1, 0]
    assert score(V.grammar, "the the  cat. its is", "Fine.") == [0.8, 1.0]
    assert score(V.ambiguity, "It was painted by this", "") == [round(1 - (40 * 0.05 + 0.02), 6) if 40 * 0.05 + 0.02 < 1 else 0, 1.0]
    assert column(spark, V.claims(F.col("text")), "A is b. Is it? Maybe c! D e.") == [["A is b", "D e"]]


def test_coverage_and_entailment(spark):
    source, answer = F.array(*map(F.lit, ["river", "stone"])), V.keywords(F.col("text"))
    assert column(spark, V.coverage(source, answer)["score"], "the river", "nothing", "river stone") == [0.75, 0.0, 1.0]
    tokens = V.entailment_tokens(F.lit("the cat sat on the mat"))
    assert column(spark, V.entailment(tokens, V.entailment_tokens(F.col("text"))), "the cat sat", "a dog sat on", "dogs bark", "") == [0.9, 0.5, 0.1, 0.9]
    assert column(spark, V.completeness(F.lit("how do rivers flow"), F.col("text"))["score"], "rivers flow down", "stones") == [1.0, 0.0]


def test_chain(spark):
    c = V.chain(0.5, bias=V.bias(F.col("text")), toxicity=V.toxicity(F.col("text")))
    rows = texts(spark, "fine", "chairman idiot").orderBy("doc_id").select(c.alias("v")).collect()
    assert [(round(r["v"]["score"], 2), r["v"]["passed"], r["v"]["flags"]) for r in rows] == [(1.0, True, []), (0.45, False, ["gender", "insult"])]


# --- duplicates ---


def kept(spark, threshold, *values):
    return sorted(r["id"] for r in dedup.kept_ids(texts(spark, *values), threshold).collect())


def test_token_hash(spark):
    def expected(token):
        h = 1469598103934665603
        for c in token:
            h = (h ^ ord(c)) * (2**40 + 435) % 2**64
        return h

    words = ["hello", "a", "漢字", "0", "abcdefghijklmnop"]
    got = column(spark, dedup.token_hash(F.col("text")), *words)
    assert [(r["hi"] << 32) | r["lo"] for r in got] == list(map(expected, words))


@pytest.mark.parametrize(
    ("threshold", "values", "left"),
    [
        (0.9, ["same"] * 5, [0]),
        (0.9, ["The quick brown fox jumps", "The quick brown fox jumps", "Something else entirely"], [0, 2]),
        (0.5, ["aaaaaaa", "bbbbbbb"], [0, 1]),
        (0.0, ["a", "b", "c"], [0]),
        (1.0, ["same", "same"], [0]),
        (0.9, ["你好世界", "hello world"], [0, 1]),
        (0.9, ["مرحبا", "مرحبا"], [0]),
        (0.9, ["short", "short but then very much longer than that"], [0, 1]),
        (0.9, ["", None, "x"], [0, 2]),
    ],
)
def test_near_duplicates(spark, temporary, threshold, values, left):
    assert kept(spark, threshold, *values) == left


def test_first_kept_is_greedy(spark, temporary):
    nodes = spark.range(1, 8)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 7), (6, 7)], "a bigint, b bigint")
    assert sorted(r["id"] for r in dedup.first_kept(nodes, edges).collect()) == [1, 3, 5, 6]


def test_first_kept_says_when_it_does_not_settle(spark, temporary):
    nodes, edges = spark.createDataFrame([(i,) for i in range(6)], "id bigint"), spark.createDataFrame([(i, i + 1) for i in range(5)], "a bigint, b bigint")
    assert sorted(r["id"] for r in dedup.first_kept(nodes, edges, rounds=3).collect()) == [0, 2, 4]
    with pytest.raises(RuntimeError, match="did not settle"):
        dedup.first_kept(nodes, edges, rounds=1)


def test_semantic_pairs(spark):
    import random

    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    vectors = [(i, v) for i, v in enumerate(base)] + [(100 + i, [x + rng.gauss(0, 0.1) for x in v]) for i, v in enumerate(base)] + [(999, [0.0] * 8)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    expected = {(i, j) for i, a in vectors for j, b in vectors if i < j and j != 999 and cos(a, b) > 0.95}
    got = dedup.semantic_pairs(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>"))
    assert {(r["a"], r["b"]) for r in got.collect()} == expected and expected


# --- privacy ---


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("Contact alice@example.com for details", "email", "alice@example.com"),
        ("Call 555-123-4567 today", "phone", "555-123-4567"),
        ("SSN: 123-45-6789", "ssn", "123-45-6789"),
        ("Card 4111-1111-1111-1111", "credit_card", "4111-1111-1111-1111"),
        ("I live at 123 Main St", "address", "123 Main St"),
        ("Server at 192.168.1.1", "ip_address", "192.168.1.1"),
        ("Visit http://192.168.1.1/path now", "url", "http://192.168.1.1/path"),
        ("DOB 05/15/1990", "date_of_birth", "05/15/1990"),
    ],
)
def test_pii(text, kind, value):
    known = privacy.compiled()
    assert [(k, v) for k, _, _, v in privacy.spans(text, known)] == [(kind, value)]
    assert privacy.redacted(text, known) == text.replace(value, f"[{kind.upper()}_REDACTED]")


def test_redaction_in_spark(spark):
    assert column(spark, privacy.redact()("text"), "a@b.org x", None, "") == ["[EMAIL_REDACTED] x", None, ""]
    assert [len(x) for x in column(spark, privacy.detect()("text"), "a@b.org 1.2.3.4", None)] == [2, 0]


def test_classes(spark):
    rows = privacy.classify(texts(spark, "none", "a@b.org c@d.org", "password: hunter2hunter2", "card 4111 1111 1111 1111"), F.col("text")).orderBy("doc_id").collect()
    assert [(r["risk"], r["risk_class"]) for r in rows] == [(0.0, "none"), (0.5, "pii"), (0.25, "secret"), (0.25, "financial")]
    assert column(spark, privacy.kind_of_name(F.col("text")), "my_iban", "apiToken", "diagnosis", "other") == ["financial", "secret", "health", "pii"]


# --- segmentation ---


@pytest.mark.parametrize(
    ("text", "size", "n"),
    [("", 100, 0), ("   ", 100, 0), ("A. B. C.", 10, 1), ("One. Two. Three.", 8, 2), ("Line one\nLine two\nLine three", 12, 3)],
)
def test_semantic_chunks(text, size, n):
    assert len(chunking.semantic_chunks(text, size, 0)) == n


def test_simple_chunks():
    assert [len(c) for c in chunking.simple_chunks("A" * 1000, 100)] == [100] * 10
    text = "word " * 500
    assert all(len(c) <= 100 for c in chunking.simple_chunks(text, 100))
    assert "".join(chunking.simple_chunks(text, 100)).replace(" ", "") == text.replace(" ", "")


def test_units():
    text = "Intro\n```\ncode\n```\n- one\n- two\nend"
    assert [(u.kind, text[u.start : u.end]) for u in chunking.units(text)] == [("code_block", "```\ncode\n```\n"), ("list", "- one\n- two\n")]
    fenced = "```\nx\n```"
    assert [(u.start, u.end) for u in chunking.units(fenced)] == [(0, len(fenced))]
    assert [u.kind for u in chunking.units("a | b | c\nd | e | f\n\n    code")] == ["table", "code_block"]


def test_sentences():
    assert chunking.sentences("Dr. Smith paid 1.5 dollars. He left!\nNew line") == ["Dr. Smith paid 1.5 dollars.", "He left!", "New line"]
    assert chunking.sentences("你好。再见！") == ["你好。", "再见！"]
    assert [len(s) for s in chunking.sentences("漢" * 450)] == [200, 200, 50]


def test_oversized_and_overlap():
    chunks = chunking.semantic_chunks(". ".join(f"Sentence number {i} of this text" for i in range(60)) + ".", 200, 50)
    assert len(chunks) > 5 and all(chunks[i + 1].startswith(chunks[i][-50:].strip()[:10]) for i in range(3))
    assert max(map(len, chunking.semantic_chunks("x" * 5000, 100, 0))) <= 100


def test_chunked_frames(spark):
    out = chunking.chunked(texts(spark, "A" * 25, None), chunking.simple(F.col("text"), 10))
    assert [(r["chunk_index"], r["chunk"]) for r in out.collect()] == [(0, "A" * 10), (1, "A" * 10), (2, "A" * 5)]


# --- responses ---


def test_qa_pairs():
    text = "Question: What is A?\nAnswer: First\nsecond line\n\nQuestion: what is a?\nAnswer: again\nQuestion: B? Answer: `C` **d**"
    assert parsing.qa_pairs(text) == [("What is A?", "First\nsecond line"), ("B?", "C d")]
    assert parsing.qa_pairs("Q: one A: two Q: three A: four") == [("one", "two"), ("three", "four")]
    assert parsing.qa_pairs("Question: a\nAnswer: b\nc\nQuestion: only", mode="cli") == [("a", "b c")]
    assert parsing.qa_pairs(None) == []


def test_turns():
    assert parsing.chat_turns("User: hi\nAssistant: hello\nthere\nUser: bye\nAssistant: ok") == [("hi", "hello\nthere"), ("bye", "ok")]
    assert parsing.chat_turns("Human: a AI: b") == [("a", "b")]
    assert parsing.clean_answer("# Head\nkeep\n```\ncode\n```\n---\n| a | b |\nend") == "keep\nend"


def test_grades_and_tags(spark):
    assert column(spark, parsing.grade(F.col("text")), '{"score": 0.7}', '{"score": 7}', "Score: 0.4 out", "none", '{"x": 1}') == [0.7, 1.0, 0.4, 0.5, 0.5]
    assert column(spark, parsing.tags(F.col("text"))["difficulty"], '{"difficulty": "Hard"}', '{"difficulty": "odd"}') == ["hard", None]
    assert column(spark, parsing.unbatch(F.col("text"), F.lit(3)), "--- CHUNK 1 ---\na\n--- CHUNK 2 ---\nb") == [["a", "b", ""]]


def test_citations(spark):
    text = "As said [page 12] and [p. 7], [L23], [url https://a.b/c], [doi 10.1234/x], [isbn 978-3-16-148410-0]."
    c = column(spark, parsing.citations(F.col("text")), text)[0]
    assert (c["page"], c["line"], c["url"], c["doi"], c["isbn"]) == (["12", "7"], ["23"], ["https://a.b/c"], ["10.1234/x"], ["978-3-16-148410-0"])
    assert column(spark, parsing.without_citations(F.col("text")), "a [page 1] b") == ["a b"]


# --- planning and metrics ---


def test_budget_is_a_fold(spark):
    rows = [("s", 0, 500), ("s", 1, 100_000), ("s", 2, 10)]
    plan = planning.plan_budget(spark.createDataFrame(rows, "s string, i bigint, t bigint"), "s", "i", "t", planning.Budget(2000, 100, 300, 50))
    assert [(r["output_tokens"], r["skipped"]) for r in plan.orderBy("i").collect()] == [(300, False), (0, True), (300, False)]


def test_batches(spark):
    rows = [("s", i, 100) for i in range(10)] + [("t", 0, 20_000), ("t", 1, 1)]
    out = planning.pack_batches(spark.createDataFrame(rows, "s string, i bigint, n bigint"), "s", "i", "n")
    assert [r["batch"] for r in out.where("s = 's'").orderBy("i").collect()] == [0] * 8 + [1] * 2
    assert [r["batch"] for r in out.where("s = 't'").orderBy("i").collect()] == [0, 1]


def test_split(spark):
    out = planning.split(spark.range(103), F.col("id"), 0.8, 0.1, 0.1)
    assert {r["part"]: r["count"] for r in out.groupBy("part").count().collect()} == {"train": 83, "validation": 10, "test": 10}
    with pytest.raises(ValueError, match="add up"):
        planning.split(spark.range(1), F.col("id"), 0.5, 0.1, 0.1)


def test_admission(spark):
    rows = [(0, "a.txt", 1), (1, "a.txt", 1), (2, "b.exe", 1), (3, "c.md", 1 << 40), (4, "D.TXT", 5)]
    out = planning.admit(spark.createDataFrame(rows, "i int, name string, size bigint"), ["txt", "md"], "i")
    assert [r["outcome"] for r in out.orderBy("i").collect()] == ["added", "skipped", "rejected", "rejected", "added"]


def test_templates(spark):
    known = spark.createDataFrame([("en", "qa", "E"), ("de", "qa", "D"), ("zh-Hans", "qa", "Z")], "locale string, kind string, body string")
    wanted = spark.createDataFrame([("de-AT", "qa"), ("zh-Hans", "qa"), ("pt", "qa")], "locale string, kind string")
    assert {r["locale"]: r["body"] for r in planning.template_for(known, wanted).collect()} == {"de-AT": "D", "zh-Hans": "Z", "pt": "E"}


def test_distribution_and_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v int")
    r = metrics.distribution(df, "v").first()
    assert (r["n"], r["mean"], r["median"], r["p95"], round(r["std_dev"], 4)) == (4, 2.5, 2.5, 4, 1.118)
    assert [x["n"] for x in metrics.histogram(df, "v", 3).orderBy("bin").collect()] == [1, 1, 2]
    assert [x["n"] for x in metrics.histogram(spark.createDataFrame([(5,), (5,)], "v int"), "v").collect()] == [2]
    assert metrics.histogram(df.where("false"), "v").count() == 0


def test_votes(spark):
    rows = [(1, 0, "Yes."), (1, 1, "no"), (1, 2, "yes "), (2, 0, "a"), (2, 1, "b")]
    got = metrics.votes(spark.createDataFrame(rows, "q int, p int, a string"), "q", "p", "a").orderBy("q").collect()
    assert [(r["winner"], r["votes"], r["distinct_answers"]) for r in got] == [("Yes.", 2, 2), ("a", 1, 2)]


def test_response_scores(spark):
    t = ["", "x" * 60, '[{"a": 1}]', '{"a": 1}', 'broken "output"', "Sorry, I cannot"]
    assert column(spark, metrics.response_score(F.col("text"), F.lit(0)), *t) == [-50, 20, 30, 25, 20, -10]


def test_price_tiers(spark):
    tiers = spark.createDataFrame([(0, "p", "m", 1.0, 2.0, "USD"), (1, "p", "n", 3.0, 4.0, "EUR")], "position int, provider string, model string, input_per_1k double, output_per_1k double, currency string")
    calls = spark.createDataFrame([("p", "n"), ("p", "x"), ("q", "y")], "provider string, model string")
    assert {(r["provider"], r["model"]): r["price"]["input_per_1k"] for r in metrics.priced(calls, tiers).collect()} == {("p", "n"): 3.0, ("p", "x"): 1.0, ("q", "y"): 0.03}


def test_audit_chain(spark):
    rows, before = [], "0"
    import hashlib

    for i in range(5):
        h = hashlib.sha256(f"{i}|e{i}".encode()).hexdigest()
        rows.append((i, f"e{i}", before, h))
        before = h
    check = lambda r: metrics.verify_chain(spark.createDataFrame(r, "i int, e string, prev_hash string, hash string"), "i", metrics.chain_hash(F.col("i").cast("string"), F.col("e"))).first()
    assert check(rows)["valid"]
    assert check([*rows[:2], (2, "changed", *rows[2][2:]), *rows[3:]])["broken_at"] == 2
    assert check([*rows[:3], (3, "e3", "wrong", rows[3][3]), rows[4]])["broken_at"] == 3


def test_djb2(spark):
    def expected(s):
        h = 5381
        for c in s:
            h = (h * 33 + ord(c)) % 2**32
        return f"{h:x}"

    assert column(spark, metrics.djb2(F.col("text")), "", "abc", "hello world") == [expected(""), expected("abc"), expected("hello world")]


# --- exports ---


CHAT = {"format": "chatml", "messages": [{"role": "system", "content": "S"}, {"role": "user", "content": "U1"}, {"role": "assistant", "content": "A1"}, {"role": "user", "content": "U2"}]}
QA = {"format": "instruction", "instruction": "Q", "input": "I", "output": "A"}


def lines(df, layout):
    return [r["line"] for r in export.lines(df, layout).orderBy("item_id").collect()]


def test_layouts(spark):
    df = items(spark, CHAT, QA, {"format": "text"})
    assert [json.loads(x).get("messages", [{}])[0].get("role") for x in lines(df, "openai")] == ["system", "user"]
    share = [json.loads(x) for x in lines(df, "sharegpt")]
    assert [s["id"] for s in share] == [1, 2] and [c["from"] for c in share[0]["conversations"]] == ["system", "human", "gpt", "human"]
    assert json.loads(lines(df, "llama2")[0])["text"] == "[INST] <<SYS>>\nS\n<</SYS>>\n\nU1 [/INST] A1[INST] U2 [/INST] "
    assert json.loads(lines(df, "mistral")[0])["text"] == "[INST] S\n\nU1 [/INST] A1[INST] U2 [/INST] "
    assert json.loads(lines(df, "llama3")[1])["text"] == "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nQ\nI<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\nA<|eot_id|>"
    assert lines(items(spark, QA), "csv") == ["Q,I,A"]
    assert lines(items(spark, QA, {"text": "t,u"}, {"text": "v"}), "csv") == ["", '"t,u"', "v"]
    assert json.loads(lines(items(spark, QA), "jsonl")[0]) == {k: v for k, v in QA.items()}
    assert "<p class=\"output\">A</p>" in lines(items(spark, QA), "html")[0]
    with pytest.raises(ValueError, match="no layout"):
        export.lines(df, "other")


def test_written_parts(spark, tmp_path):
    df = items(spark, *({"format": "text", "text": f"t{i}"} for i in range(25)))
    export.write(df, "text", str(tmp_path / "out"), most=10)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(f.read_text() for f in files).split() == [f"t{i}" for i in range(25)] and all(len(f.read_text().split()) <= 10 for f in files)
    export.write(df, "parquet", str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 25


# --- generation and pipelines ---


class Flaky:
    """Fails for prompts that say so."""

    name = "flaky"

    def generate(self, prompt, options):
        if "bad" in prompt:
            raise RuntimeError("no")
        return "ok " + prompt, 1


def test_generation(spark):
    requests = spark.createDataFrame([(1, "good", "m"), (2, "bad", "m"), (3, "known", "m")], "i int, prompt string, model string")
    key = planning.cache_key(F.lit("offline"), F.col("model"), F.col("prompt"))
    cache = requests.where("i = 3").select(key.alias("key"), F.lit("from before").alias("response"))
    out = {r["i"]: r for r in generate.generate(requests, generate.Offline(), cache=cache).collect()}
    assert out[3]["response"] == "from before" and out[3]["from_cache"] and out[1]["response"].startswith("Question:")
    assert generate.Failover((Flaky(), generate.Offline())).generate("bad", {})[0].startswith("Question:")
    with pytest.raises(RuntimeError):
        generate.with_retries(Flaky(), "bad", {}, wait=0)
    with pytest.raises(ValueError, match="come later"):
        generate.run_chain(requests, [("a", "x", ["b"])], generate.Offline())


def test_pipeline_of_steps(spark):
    seen = []
    p = Pipeline(before=[lambda n, df: seen.append(n)])
    p.add("filter", keep(F.col("doc_id") > 0)).add("map", with_columns(n=F.length("text"))).add("check", validated(V.toxicity(F.col("text")), remove=False))
    out = p.run(texts(spark, "a", "bb", "idiot")).orderBy("doc_id").collect()
    assert seen == ["filter", "map", "check"] and [(r["n"], r["tags"]) for r in out] == [(2, []), (5, ["validation_failed", "insult"])]
    with pytest.raises(ValueError, match="already"):
        p.add("map", keep(F.lit(True)))
    registry = Registry()
    registry.register("layout", "x", 1)
    assert registry.get("layout", "x") == 1
    with pytest.raises(KeyError):
        registry.get("layout", "y")


# --- sources ---


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def test_formats():
    assert formats.decoded(b"\xef\xbb\xbfa\r\nb\rc") == "a\nb\nc"
    assert formats.html_text("<p>a &amp; b</p><script>x</script><p>c</p>") == "a & b\nc"
    assert formats.rtf_text(r"{\rtf1\ansi Hello \'e9}") == "Hello é"
    assert formats.captions("1\n00:00:01,000 --> 00:00:02,000\nHi\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nBye") == ["Hi there", "Bye"]
    assert formats.captions("WEBVTT\n\nNOTE x\n\n00:00:01.000 --> 00:00:02.000\nHi") == ["Hi"]
    assert "[MATH]" in formats.latex_text(r"\title{T}\begin{document}\section{S} a $x$ \textbf{b} % c" + "\n\\end{document}")
    assert formats.email_text("Subject: S\nContent-Type: text/plain\n\nBody") == "S\n\nBody"
    assert formats.feed_entries(b"<rss><channel><item><title>T</title><link>L</link><description>D</description></item></channel></rss>") == [("T", "L", "D")]
    assert formats.outline(b'<map><node TEXT="a"><node TEXT="b"/></node></map>') == "a\n    b"
    assert formats.json_table('[{"a": {"b": 1}}, {"c": null}]') == "| a.b | c |\n| --- | --- |\n| 1 |  |\n|  | null |"
    assert formats.csv_schema([["a", "b", "c"], ["1", "true", ""], ["2e3", "false", "x"]]) == [("a", "number", False), ("b", "boolean", False), ("c", "string", True)]
    assert formats.column_index("AB") == 27
    assert formats.text_of("docx", b"broken")[0] is None


def test_office():
    docx = zipped(word__document_dot_xml='<d xmlns:w="w"><w:p><w:t>Hello</w:t></w:p><w:p><w:t>World</w:t></w:p></d>')
    assert formats.docx_text(docx) == "Hello\nWorld"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = {
        "xl/workbook.xml": f'<w xmlns:r="{r}"><sheet name="S" r:id="r1"/></w>',
        "xl/_rels/workbook.xml.rels": '<r><Relationship Id="r1" Target="worksheets/sheet1.xml"/></r>',
        "xl/sharedStrings.xml": "<s><si><t>name</t></si></s>",
        "xl/worksheets/sheet1.xml": '<s><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></s>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in book.items():
            z.writestr(name, data)
    assert formats.sheets(out.getvalue()) == [("S", [["name", "", "5"]])]


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"one\r\ntwo")
    (tmp_path / "b.html").write_text("<h1>T</h1>x")
    (tmp_path / "c.xyz").write_text("?")
    (tmp_path / "d.docx").write_bytes(b"not a zip")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got["a.TXT"] == ("one\ntwo", None) and got["b.html"] == ("T\nx", None)
    assert "unsupported" in got["c.xyz"][1] and got["d.docx"][0] is None


def test_sniffing_and_schema(spark):
    assert column(spark, readers.sniffed(F.col("text")), '{"a":1}', '{"a":1}\n{"a":2}', "a,b\n1,2", "[1]") == ["json", "ndjson", "csv", "json"]
    fields = readers.json_fields(texts(spark, '{"user": {"name": "x", "age": null}}', '{"user": {"age": 3}, "tags": [1]}', "broken"), "doc_id", "text")
    got = {r["path"]: (r["type"], r["nullable"], r["sample"]) for r in readers.inferred_schema(fields, "doc_id").collect()}
    assert got["user.age"] == ("number", True, "3") and got["tags"] == ("array", False, "[1]") and got["user.name"][0] == "string" and set(got) == {"user", "user.age", "user.name", "tags"}
    bad = readers.ndjson_rows(texts(spark, '{"a":1}\n\nbroken'), "doc_id", "text").orderBy("line_no").collect()
    assert [(r["line_no"], r["bad"]) for r in bad] == [(1, False), (3, True)]


def test_pages(spark):
    html = '<title> T </title><body><nav>n</nav><article><p onclick="x()">a</p><!-- c --><p>b</p></article></body>'
    out = readers.page_texts(spark.createDataFrame([(1, html)], "page_id int, html string")).first()
    assert (out["title"], out["text"]) == ("T", "a\nb")
    assert column(spark, readers.video_id(F.col("text")), "https://youtu.be/abcdefghijk", "https://x.y/?v=abcdefghijk&t=1", "no") == ["abcdefghijk", "abcdefghijk", None]
    seg = column(spark, readers.transcript_segments(F.col("text")), '<text start="1.5" dur="2">a &amp;amp; b</text><text start="x">c</text>')[0]
    assert [(s["start_ms"], s["duration_ms"], s["text"]) for s in seg] == [(1500, 2000, "a &amp; b")]


def test_streaming(spark, tmp_path):
    from millrace.streaming import streams

    rows = spark.createDataFrame([(i, i % 3, float(i)) for i in range(100)], "s bigint, g int, value double").select(F.timestamp_seconds(F.col("s") * 60).alias("ts"), "g", "value")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = streams.files(spark, str(tmp_path / "in"), rows.schema, per_trigger=2)
    streams.run_to_table(streams.bucket_averages(stream, "ts", "1 hour", "value", "g"), str(tmp_path / "out"), str(tmp_path / "cp"), ["bucket", "g"])
    got = {(r["bucket"], r["g"]): (r["n"], round(r["average"], 6)) for r in streams.current(spark, str(tmp_path / "out"), ["bucket", "g"]).collect()}
    batch = rows.groupBy(F.window("ts", "1 hour").start.alias("b"), "g").agg(F.count("*").alias("n"), F.avg("value").alias("a"))
    assert got == {(r["b"], r["g"]): (r["n"], round(r["a"], 6)) for r in batch.collect()}
    kept = streams.curated(streams.files(spark, str(tmp_path / "in"), rows.schema), F.col("value") > 50)
    streams.run_available(kept, str(tmp_path / "kept"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 49
