"""Operators that work in ranges, regions, pieces and streams, against brute force on many partitions."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking, dedup, metrics, ordering, parsing, planning, privacy, provenance, records
from millrace.operators import validators as V
from millrace.sources import code, formats
from millrace.storage import shared_dir


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_order_by_ranges(spark, many_partitions):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 2, 2, 5]), rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v int, w int").repartition(5)
    expected = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    out = ordering.numbered(df, ["v", "id"]).collect()
    assert {r["id"]: r["number"] for r in out} == {r[0]: n for n, r in enumerate(expected, 1)}
    placed = ordering.in_ranges(df, ["v", "id"])
    lagged = {r["id"]: r["b"] for r in ordering.lagged(placed, "w", "b").collect()}
    assert lagged == {r[0]: (expected[n - 1][2] if n else None) for n, r in enumerate(expected)}
    most = {r["id"]: r["m"] for r in ordering.running_max(placed, "w", "m").collect()}
    assert most == {r[0]: max(x[2] for x in expected[: n + 1]) for n, r in enumerate(expected)}
    assert ordering.numbered(df.where("false"), ["id"]).count() == 0


@pytest.mark.parametrize(("limit", "blocks"), [(0.95, 2048), (0.9, 16)])
def test_semantic_pairs_of_clusters(spark, monkeypatch, limit, blocks):
    monkeypatch.setattr(dedup, "BLOCK", blocks)
    monkeypatch.setattr(dedup, "PIVOTS", 12)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(8, 16))
    rows = [(int(i), (centers[rng.integers(8)] + rng.normal(size=16) * rng.choice([0.05, 0.3])).tolist()) for i in range(150)] + [(1000, [0.0] * 16), (1001, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    v = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if x and any(x)}
    expected = {(a, b) for a in v for b in v if a < b and v[a] @ v[b] > limit}
    got = {(r["a"], r["b"]): r["similarity"] for r in dedup.semantic_pairs(df, limit).collect()}
    assert set(got) == expected and len(expected) > 50
    assert all(got[a, b] == pytest.approx(v[a] @ v[b]) for a, b in got)
    kept: list[int] = []
    for i, _ in sorted(rows):
        if i not in v or not any(v[i] @ v[k] > limit for k in kept if k in v):
            kept.append(i)
    assert sorted(r["id"] for r in dedup.semantic_kept(df, limit).collect()) == kept
    assert dedup.semantic_pairs(df.where("false")).count() == 0


def test_semantic_pairs_store_vectors_once(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 64))
    x[700:720] = x[3] + rng.normal(size=(20, 64)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<float>").repartition(5)
    df.write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    size = lambda folder: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = size(shared)
    got = {(r["a"], r["b"]) for r in dedup.semantic_pairs(df).collect()}
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()])
    names = sorted(f"v{i}" for i in range(1200))
    i, j = np.nonzero(np.triu(x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2) > 0.95, 1))
    assert got == {(names[a], names[b]) for a, b in zip(i, j, strict=True)} and len(got) > 100
    assert size(shared) - before < 2 * size(tmp_path)


@pytest.mark.parametrize("threshold", [0.6, 0.9, 1.0])
def test_links_by_brute_force(spark, threshold):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([1, 5, 20, 60]))
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "!!")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    sim = {r["doc_id"]: r["hi"] << 32 | r["lo"] for r in dedup.simhash(df).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(t or "", i)
    sets = {i: set((t or "").split()) if re.search("[a-z0-9]", t or "") else set() for i, t in rows}
    length = {i: len(t or "") for i, t in rows}
    expected = set()
    for a in first.values():
        for b in first.values():
            band = any((sim[a] >> s & 0xFFFF) == (sim[b] >> s & 0xFFFF) for s in (0, 16, 32, 48))
            near = length[a] == 0 or length[b] == 0 or abs(length[a] - length[b]) / max(length[a], length[b]) <= 0.5
            if a < b and band and near and (sim[a] ^ sim[b]).bit_count() <= int(64 * (1 - threshold)):
                union = sets[a] | sets[b]
                if (len(sets[a] & sets[b]) / len(union) if union else 1.0) >= threshold:
                    expected.add((a, b))
    assert {(r["a"], r["b"]) for r in dedup.links(df, threshold).collect()} == expected


def test_first_kept_of_a_long_chain(spark):
    n = 24
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a bigint, b bigint")
    nodes = spark.range(n + 1)
    assert sorted(r["id"] for r in dedup.first_kept(nodes, edges).collect()) == list(range(0, n + 1, 2))


def test_folds_are_streams(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 10, 500, 3000])) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, o int, t bigint").repartition(6)
    budget = planning.Budget(session=20_000, reserve=100, most=900, least=50)
    expected = {}
    for s in ("a", "b", None):
        used = 0
        for _, o, t in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            left = 20_000 - used - 100 - (t or 0)
            out = 0 if left <= 0 else min(900, max(50, left))
            expected[o] = out
            used += (t or 0) + out if out else 0
    got = {r["o"]: r["output_tokens"] for r in planning.plan_budget(df, "s", "o", "t", budget).collect()}
    assert got == expected and 0 in got.values()
    assert planning.plan_budget(df.where("false"), "s", "o", "t").count() == 0
    # Without room for any prompt all shares are 0.
    assert {r["output_tokens"] for r in planning.plan_by_priority(df, "s", "o", "t", "o", planning.Budget(session=10)).collect()} == {0}


def test_streaks_over_ranges(spark, many_partitions):
    from millrace.operators import metrics

    rng = random.Random(5)
    rows = [(i, rng.choice(["p", "p", "p", "q", None]), rng.random() < 0.7) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, provider string, bad boolean").repartition(4)
    run, expected = {}, {}
    for i, p, bad in rows:
        run[p] = run.get(p, 0) + 1 if bad else 0
        expected[i] = run[p]
    assert {r["i"]: r["streak"] for r in metrics.failure_streaks(df, "provider", ["i"], F.col("bad")).collect()} == expected


def test_diversity_by_brute_force(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(4, 6))
    rows = [(int(i), int(i % 2), (centers[rng.integers(4)] + 0.3 * rng.normal(size=6)).tolist()) for i in range(80)]
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    expected = {}
    for g in (0, 1):
        clusters: list[list] = []
        for i, _, v in (r for r in rows if r[1] == g):
            hit = next((c for c in clusters if cos(np.mean(c, axis=0), v) > 0.9 or any(cos(m, v) > 0.9 for m in c)), None)
            if hit is None:
                clusters.append([v])
                expected[i] = (1, True)
            else:
                size = len(hit) + 1
                expected[i] = (size, size < 5)
                if size < 5:
                    hit.append(v)
    out = V.diverse(spark.createDataFrame(rows, "vec_id bigint, g int, embedding array<double>").repartition(3), "vec_id", "g")
    assert {r["vec_id"]: (r["cluster_size"], r["passed"]) for r in out.collect()} == expected
    assert not all(p for _, p in expected.values())


def test_best_coverage_in_slices(spark, monkeypatch):
    rng = random.Random(7)
    words = ["river", "stone", "green", "house", "light", "paper", "cloud", "field"]
    bench = [(i, " ".join(rng.choices(words, k=4))) for i in range(10)] + [(99, "the of"), (98, None)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(60)] + [(None, "river"), (70, None)]
    monkeypatch.setattr(V, "PASSAGE_WORDS", 9)
    out = V.best_coverage(spark.createDataFrame(bench, "item_id int, text string"), spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    expected = {}
    for i, t in bench:
        k = set((t or "").split()) & set(words)
        found = [(len(k & set((d or "").split())), j) for j, d in docs if j is not None]
        if k and max(found)[0]:
            expected[i] = (max(found)[1], pytest.approx(min(1.0, max(found)[0] / len(k) * 1.5)))
    assert {r["item_id"]: (r["doc_id"], r["score"]) for r in out.collect()} == expected


def test_provenance_of_merged_items(spark):
    tag = lambda f, m=None: (f, 0, None, None, None, m)
    kind = f"id int, keeper int, provenance {provenance.PROVENANCE}"
    removed = spark.createDataFrame([(5, 1, tag("b")), (3, 1, tag("c", ["x", "b"])), (9, 1, tag("c")), (7, 2, tag("d")), (8, 2, None)], kind)
    kept = spark.createDataFrame([(1, None, tag("a", ["z", "x"])), (2, None, None), (4, None, tag("e"))], kind)
    out = {r["id"]: r["provenance"] for r in provenance.merged(kept, removed, "id", "keeper", "id").collect()}
    assert out[1]["merged_from"] == ["z", "x", "c", "b"] and out[1]["source_file"] == "a"
    assert out[2]["source_file"] == "d" and out[2]["merged_from"] == ["d"]
    assert out[4]["merged_from"] is None


def test_texts_are_processed_whole():
    long = "word " * 30_000 + "\nend."
    assert chunking.simple_chunks(long, 500)[-1].endswith("end.") and chunking.sentences(long)[-1].endswith("end.")
    assert len(chunking.simple_chunks(long, 500, chunking.Limits(chunks=3))) == 3
    assert sum(map(len, chunking.simple_chunks(long, 500, chunking.Limits(chars=1000)))) <= 1000
    assert parsing.qa_pairs("x " * 60_000 + "Q: who? A: me") == [("who?", "me")]
    assert parsing.qa_pairs("x " * 60_000 + "Q: who? A: me", most=100_000) == []
    assert chunking.document_chunks("a b", 1) == ["a b"] and chunking.document_chunks(" \n ") == []


def test_answers_are_cleaned():
    text = "# head\n- one\n* two\n• three\n\n\n\n|a|b|\n---\n```\ncode\n```\n**SELF-CHECK** no\nThese Q&A pairs cover all\n### 3. next\n**bold** and `code`"
    assert parsing.clean_answer(text) == "one\ntwo\nthree\n\nbold and code"
    assert parsing.labelled("Q: a A: b q: c Q: d a: e A: f", "Q:", "A:") == [(" a ", " b "), (" c Q: d ", " e A: f")]


def test_inspection_finds_and_removes(spark):
    df = spark.createDataFrame([(1, "mail a@b.org or 192.168.1.1"), (2, None), (3, ""), (4, "Visit http://192.168.1.1/path now")], "id int, text string")
    rows = {r["id"]: r["f"] for r in df.select("id", privacy.inspect()("text").alias("f")).collect()}
    assert rows[1]["redacted"] == "mail [EMAIL_REDACTED] or [IP_ADDRESS_REDACTED]" and rows[1]["score"] == pytest.approx(0.8)
    assert rows[2]["redacted"] is None and rows[2]["matches"] == [] and rows[3]["redacted"] == ""
    assert [m["type"] for m in rows[4]["matches"]] == ["url"]
    log = privacy.redaction_log(df.select("id", privacy.inspect()("text").alias("f")), "id", F.col("f.matches"), F.lit("now"))
    assert log.count() == 3 and "value" not in log.columns


def test_guards_let_all_matches_pass(spark):
    texts = ["call (555) 123-4567", "+1 555 123 4567", "ssn 123456789", "x 12 Main\nSt", "9 a b c d Blvd, x", "1.2.3.4", "https://x", "01/02/1990", "API_KEY = abcdefghijklmnop1", "PWD:longenough1", "a1234567"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for kind, pattern in {**privacy.PATTERNS, **privacy.CLASS_PATTERNS}.items():
        found = {t for t in texts if re.search(pattern, t, re.ASCII)}
        assert found <= {r["text"] for r in df.where(privacy.may_hold(F.col("text"), kind)).collect()}, kind


def test_code_of_each_language():
    names = lambda text, language: [(c["type"], c["name"]) for c in code.chunks(text, language)]
    assert names("use std::io;\nstruct P {\n x: i32,\n}\npub fn main() {\n let s = \"}\";\n}", "rust") == [("import", None), ("class", "P"), ("function", "main")]
    assert names('import (\n"os"\n)\nfunc (p T) Go() {\n}\ntype T struct {\n}', "go") == [("import", None), ("function", "Go"), ("class", "T")]
    assert names("import a.b;\npublic class Foo {\n  void f() { /* } */ }\n}\n", "java") == [("import", None), ("class", "Foo")]
    assert names("const f = (x) => {\n return x\n}\n// note\nif (x) {\n}\nf()", "javascript") == [("function", "f"), ("block", None)]
    assert code.declarations("class A:\n    x = 1\n\ny = 2", "python") == "class A:\n    x = 1\n"
    assert code.declarations("interface User {\n  a: string\n}", "typescript") == "interface User {"
    assert code.language_of("Foo.TS") == "typescript" and code.language_of("foo.txt") is None and code.language_of(None) is None
    assert code.chunks("", "python") == [] and code.chunks(None, "go") == []
    assert code.chunks("def f():\n" + "    x = 1\n" * 5000, "python")[0]["end_line"] == 5002


def test_pdf_streams():
    import zlib

    body = zlib.compress(rb"BT (one \(two\)) Tj [(th) -20 (ree)] TJ ET")
    pdf = b"%PDF\n<</Filter /FlateDecode /X <</A 1>> >>\nstream\r\n" + body + b"\nendstream"
    assert formats.pdf_text(pdf) == "one (two) three"
    assert formats.pdf_text(b"%PDF\nBT (plain) Tj ET") == "plain"
    assert formats.pdf_text(b"no blocks here", most=9) == "no blocks"
    assert not formats.image_only_pdf(pdf) and formats.image_only_pdf(b"<</Subtype /Image>>")


def test_rate_limit_dates(spark):
    df = spark.createDataFrame([({"Retry-After": "Mon, 01 Jan 2024 00:00:10 GMT"},), ({"X-RateLimit-Limit": "nonsense"},), ({},)], "h map<string,string>")
    out = [r["r"] for r in df.select(records.rate_limits(F.col("h"), F.lit(1_704_067_200_000)).alias("r")).collect()]
    assert (out[0]["retry_after"], out[0]["reset_at"]) == (10.0, 1_704_067_210_000.0)
    assert out[1]["limit"] == 0 and out[2]["retry_after"] is None and out[2]["reset_at"] == 0


def test_buckets_add_in_order(spark, many_partitions):
    rng = random.Random(4)
    rows = [(i, rng.randrange(4) * 1000, rng.choice([None, 0.1, 0.7, 1e16, -1e16])) for i in range(400)]
    expected = {}
    for _, ts, x in rows:
        n, m, s = expected.get(ts, (0, 0, 0.0))
        expected[ts] = (n + 1, m, s) if x is None else (n + 1, m + 1, s + x)
    for parts in (1, 5):
        df = spark.createDataFrame(rows[::-1], "id int, ts bigint, v double").repartition(parts, F.hash("id"))
        out = metrics.time_buckets(df, F.col("ts"), 1000, "v", order=["id"]).collect()
        assert {r["bucket"]: (r["n"], r["v"]) for r in out} == {t: (n, s / m) for t, (n, m, s) in expected.items()}
    nothing = spark.createDataFrame([(1, 0, None)], "id int, ts bigint, v double")
    assert [tuple(r) for r in metrics.time_buckets(nothing, F.col("ts"), 1000, "v", order=["id"]).collect()] == [(0, 1, None, "1970-01-01T00:00:00.000Z")]


def test_entailment_counts_a_text_once(spark):
    texts = [(1, "The cat's cat, the CAT sat on it"), (2, None), (3, ""), (4, "\u00e9 !!"), (5, "'quoted' _x_ cat\u00e9s dog's'"), (6, "dogs bark"), (None, "the cat")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id int, text string, k int").repartition(3)
    bench = spark.createDataFrame([(10, "The CAT sat on the mat", 0), (11, None, 0), (12, "x cat's dog", 0), (13, "dogs", 1)], "item_id bigint, text string, k int")
    premise = F.array_distinct(V.entailment_tokens(F.coalesce("p", F.lit(""))))
    pairs = docs.where("text IS NOT NULL").join(bench.select("item_id", F.col("text").alias("p"), "k"), "k")
    expected = pairs.select("item_id", "doc_id", V.factual_consistency(premise, F.col("text")).alias("v")).select("item_id", "doc_id", "v.score", "v.passed")
    out = V.entailed(docs, bench, "k", "doc_id", "item_id")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(out.collect(), key=key) == sorted(expected.collect(), key=key) and out.count() == 18
    assert out.schema.simpleString() == expected.schema.simpleString()


def test_links_store_no_texts(spark):
    rng = random.Random(6)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(900)) for _ in range(60)]
    texts.append(texts[0] + " more")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    shared = Path(shared_dir(spark).removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in shared.rglob("*.parquet"))
    before = size()
    assert [tuple(r) for r in dedup.links(df).collect()] == [(0, 60)]
    assert size() - before < sum(map(len, texts)) / 10
