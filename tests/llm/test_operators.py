"""Each operator against brute force, on edge cases and on empty tables."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, graph, langid, licenses, lines, media, mixing, ngrams, quality, warc
from tests.llm.conftest import CLASHING

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def found(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- BPE ---


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_equals_the_library(vocabulary):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(vocabulary), bpe.PrefixBpe(vocabulary, kept=200)
    rng = random.Random(1)
    letters = "aabcdeinthegro .,'sST!?0129éÉßñ<|>\n\t\x1c\x00 ́Σσ漢字🙂"
    texts = ["", " ", "don't <|endoftext|>x<|startoftext|>", "a" * 5000, *("".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(2000))]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert list(memoryview(ids).cast("I")) == expected, text
        assert own.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_bpe_of_edge_rows(edge, empty, rows, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)

    def expected(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))

    out = bpe.encode_decode(edge, vocabulary)
    assert found(out, *out.columns) == Counter((i, *expected(t)) for i, t, *_ in rows)
    assert bpe.encode_decode(empty, vocabulary).count() == 0
    whole = bpe.encode_decode(edge.where("doc_id = 1"), vocabulary, with_tokens=True).first()
    assert whole["n_tokens"] == len(whole["ids"]) and sha(whole["decoded"]) == whole["decoded_sha256"]


# --- lines ---


def brute_lines(rows, min_docs, keep_first=False):
    docs = {(i, t or ""): (t or "").split("\n") for i, t, *_ in rows}
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for d, parts in docs.items():
        for p in parts:
            if key(p):
                holders[key(p)].add(d)
    out = {}
    for d, parts in docs.items():
        kept = [p for p in parts if len(holders[key(p)]) < min_docs or not key(p)]
        out[d] = (len(parts), len(parts) - len(kept), sha("\n".join(kept)))
    return Counter((i, *out[i, t or ""]) for i, t, *_ in rows)


@pytest.mark.parametrize("min_docs", [2, 10, 13])
def test_lines_of_edge_rows(edge, rows, min_docs):
    out = lines.dedup_lines(edge, min_docs=min_docs)
    assert found(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(rows, min_docs)


def test_lines_runs_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["hot", "warm", f"l{rng.randrange(400)}", ""]) for _ in range(rng.randint(0, 12)))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = lines.dedup_lines(df, min_docs=10)
        assert found(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(rows, 10)
        kept = Counter()
        for r in lines.dedup_lines(df, min_docs=10, keep_first=True, with_text=True).collect():
            kept.update(x for x in r["kept_text"].split("\n") if x)
        whole = Counter(x for _, t in rows for x in t.split("\n") if x)
        holders = Counter(x for _, t in rows for x in {*t.split("\n")} if x)
        assert kept == Counter({x: 1 if holders[x] >= 10 else n for x, n in whole.items()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_lines_of_nothing(empty):
    assert lines.dedup_lines(empty).count() == 0


# --- n-gram join ---


def brute_components(rows, n, num, den):
    lower = {c: c + 32 for c in range(65, 91)}

    def shingles(text):
        w = WORD.findall((text or "").translate(lower))
        return frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for a, (i, *_) in enumerate(rows):
        groups[find(a)].append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return Counter((i, len(sets[a]), i if not sets[a] else least[find(a)]) for a, (i, *_) in enumerate(rows))


def test_ngrams_of_edge_rows(edge, empty, rows):
    out = ngrams.NgramJoin(edge).components()
    assert found(out, "doc_id", "n_shingles", "component_id") == brute_components(rows, 4, 85, 100)
    assert ngrams.NgramJoin(empty).components().count() == 0


@pytest.mark.parametrize("light", [None, 0, 10_000])
def test_ngrams_of_edited_copies(spark, light):
    """Groups of edited copies of many sizes; all sets light, all heavy, and the cut that cost chooses."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefg", k=rng.randint(1, 4))) for _ in range(300)]
    rows = []
    while len(rows) < 400:
        n = rng.choice([0, 1, 3, 4, 9, 10, 12, 20, 40] if light else [0, 3, 10, 12, 40, 120, 300])
        base = rng.choices(vocabulary, k=n)
        for _ in range(rng.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 30))):
                if w:
                    k = rng.randrange(len(w))
                    w[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[k], rng.choice(vocabulary)]])
            rows.append((len(rows), " ".join(w)))
    join = ngrams.NgramJoin(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    join.light = join.light if light is None else light
    assert found(join.components(), "doc_id", "n_shingles", "component_id") == brute_components(rows, 4, 85, 100)


def test_ngrams_keep_one_of_each(spark):
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    rows = [(i, base + " x" * (i % 3)) for i in range(30)] + [(99, "something else that stays for good"), (100, None), (101, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    join = ngrams.NgramJoin(df, n=5, limit=ngrams.Threshold(80, 100))
    assert sorted(r["doc_id"] for r in ngrams.keep_one(df, join.components()).collect()) == [0, 99, 100, 101]


def test_ngrams_keep_one_of_null_and_reused_ids(spark):
    rng = random.Random(16)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, a + " x"), (None, b), (None, None), (None, ""), (5, c), (5, d), (5, d), (1, d + " x"), (7, e), (None, e), (8, f), (8, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    join = ngrams.NgramJoin(df, n=5, limit=ngrams.Threshold(80, 100))
    got = found(ngrams.keep_one(df, join.components()), "doc_id", "text")
    one = {(None, a), (None, a + " x")} & set(got)
    assert len(one) == 1
    assert got == Counter([*one, (None, b), (None, None), (None, ""), (5, c), (1, d + " x"), (7, e), (8, f), (8, None)])


def test_blocks_of_long_lists(spark, monkeypatch):
    """Lists longer than a block: chains whose ends differ too much, so that pivots alone don't connect all."""
    monkeypatch.setattr(ngrams, "BLOCK", 3)
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[3 * i : 3 * i + 100])) for i in range(40)]
    join = ngrams.NgramJoin(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found(join.components(), "doc_id", "n_shingles", "component_id") == brute_components(rows, 4, 85, 100)


def test_graph_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    out = graph.components(spark.createDataFrame(edges, "u bigint, v bigint"))
    assert {r["node"]: r["root"] for r in out.collect()} == {x: find(x) for x in linked}


# --- mixing ---


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 1000])
def test_permutations_are_permutations(n):
    key = mixing._keys(np.full(n, 3), np.zeros(n, int), 7)
    assert sorted(mixing.permuted(np.arange(n), np.full(n, n), key)) == list(range(n))


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.targets([1000, 10, 0], [1, 2, 3]) == pytest.approx([980, 30, 0])
    assert mixing.targets([], []) == []


def test_draws_use_all_slots():
    rng, left = np.random.default_rng(1), np.array([5, 0, 100, 3])
    got = [mixing.draw(rng, left.copy(), 40)]
    got.append(mixing.draw(rng, left - got[0], 68))
    assert (got[0].sum(), got[1].sum()) == (40, 68) and (got[0] + got[1] == left).all()


def test_mix(spark, empty):
    rng = random.Random(8)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rng.randint(0, 300))), rng.choice(["a", "b", None, "c", "d"])) for i in range(400)]
    rows += [(1000, None, "a"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    mix = mixing.Mix(df, block_words=16, shard_slots=64)
    out = mix.taken().collect()
    again = mixing.Mix(df.repartition(2), block_words=16, shard_slots=64).taken().collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    source = {i: s for i, _, s in rows}
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    for s, t in target.items():
        assert taken[s] == int(t + 0.5)
    texts = Counter()
    for r in mix.texts().collect():
        n = Counter(WORD.findall(r["text"]))
        texts[r["doc_id"]] += sum(n.values())
        assert max(n.values()) <= 3 and all(w.startswith(f"d{r['doc_id']}w") for w in n)
    assert texts == Counter({i: sum(r["taken"] for r in out if r["doc_id"] == i) for i in {r["doc_id"] for r in out if r["taken"]}})
    spans = mix.spans().groupBy("shard", "slot").agg(F.sum("words").alias("n"))
    assert spans.where("n > 16").count() == 0
    assert mixing.mix_sources(empty).count() == 0


def brute_mix(mix, rows):
    """What each document gives, from the catalogue and the slots alone: streams, blocks and passes one word at a time."""
    words = {(r["sid"], r["offset"] + k): (r["doc"], r["sig"], r["offset"]) for r in mix.sized.collect() for k in range(r["size"])}
    taken, drawn = Counter(), Counter()
    for r in mix.slots().collect():
        drawn[r["sid"]] += 1
        for k in range(r["block"] * mix.block_words, r["block"] * mix.block_words + r["room"]):
            if (r["sid"], k) in words:
                taken[words[r["sid"], k]] += 1
    assert all(drawn[s.sid] == s.slots for s in mix.catalogue)
    return Counter((doc, sum(n for d, n in taken.items() if d[0] == doc)) for doc in {i for i, *_ in rows})


def test_mix_by_brute_force(spark):
    """The query's rows against streams, targets and passes computed in Python."""
    rng = random.Random(18)
    rows = [(i, " ".join(f"w{k}" for k in range(rng.randint(0, 90))), rng.choice(["a", "b", None, "c"])) for i in range(150)]
    rows += [(1000 + i, "seven words make up this small source", f"small{i}") for i in range(40)] + [rows[3]] * 5
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3), block_words=16, shard_slots=32)
    got = Counter()
    for r in mix.taken().collect():
        got[r["doc_id"]] += r["taken"]
    assert Counter(got.items()) == brute_mix(mix, rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    source, taken = {i: s for i, _, s in rows}, Counter()
    for i, n in got.items():
        taken[source[i]] += n
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert all(taken[s] == int(target[s] + 0.5) <= 3 * sizes[s] for s in order)
    # Streams are the sources' documents end to end, without gaps.
    for sid, name in enumerate(order):
        spans = sorted((r["offset"], r["size"]) for r in mix.sized.where(f"sid = {sid} AND size > 0").collect())
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) == sizes[name]


def test_mix_of_edge_rows(edge, rows):
    out = mixing.mix_sources(edge)
    assert found(out, "doc_id", "size") == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)


# --- language ---


def test_language_of_edge_rows(edge, empty, rows):
    out = langid.identify(edge)
    got = found(out, "doc_id", "lang_pred")
    assert sum(got.values()) == len(rows)
    for (i, pred), _ in got.items():
        if i in (3, 4, 5, 8):
            assert pred == "und"
    assert got[7, "und"] == 0
    assert langid.identify(empty).count() == 0


def brute_grams(text):
    t = re.sub("\x01+", "\x01", "\x01" + "".join(c if c.isalpha() else "\x01" for c in text.lower()) + "\x01")
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            g = t[i : i + n]
            if (n == 1 and g != "\x01") or (n == 2 and g != "\x01\x01") or (n == 3 and g[1] != "\x01"):
                out[g] += 1
    return out


def brute_top(counts, length):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], [0] * (3 - len(x[0])) + list(map(ord, x[0]))))[:length]]


def test_language_by_brute_force(spark):
    rng = random.Random(9)
    alphabets = {"x": "abcdeé", "y": "abcfgß", "z": "漢字かな"}
    rows = []
    for i in range(120):
        lang = rng.choice(sorted(alphabets))
        rows.append((i, " ".join("".join(rng.choices(alphabets[lang], k=rng.randint(1, 6))) for _ in range(rng.randint(1, 40))) + rng.choice(["", " 12!", "\n--"]), lang))

    grams, top = brute_grams, lambda c: brute_top(c, 50)
    total = defaultdict(Counter)
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            total[lang].update(grams(t))
    profiles = {x: {g: r for r, g in enumerate(top(c))} for x, c in total.items()}
    out = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3), length=50).collect()}
    right = 0
    for i, t, lang in rows:
        own = top(grams(t))
        best = min((sum(abs(r - p[g]) if g in p else 50 for r, g in enumerate(own)), x) for x, p in sorted(profiles.items()))
        assert out[i]["lang_pred"] == best[1] and out[i]["score"] == pytest.approx(1 - best[0] / (50 * len(own)))
        right += best[1] == lang
    assert right / len(rows) > 0.9


def test_language_told_by_distance(spark):
    rng = random.Random(17)
    rows = [(i, " ".join("".join(rng.choices("abcde", k=rng.randint(1, 5))) for _ in range(40)), "x", "s", 0) for i in range(60)]
    rows += [(100, "ж 123 !!", None, "s", 0), (101, "漢字かな " * 20, None, "s", 0), (102, "12 !!", "x", "s", 0), (103, None, "x", "s", 0), (104, "abc", None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = lambda d: sorted(r["doc_id"] for r in langid.told(d).collect())
    assert kept(df) == [*range(60), 104]
    assert kept(df.withColumn("lang", F.lit(None).cast("string"))) == [*range(60), 100, 101, 104]


# --- chat ---


def test_chat_round_trip(spark):
    nasty = ["", None, "\\", "\\l<", "</turn>\n<turn user>", "\\s", "a\\", "<next/>", "é🙂", "\\\\l", "x" * 100_000]
    rng = random.Random(10)
    rows = [(c, k, rng.choice(["user", "assistant", "system", "a>b<c\\", None]), rng.choice(nasty)) for c in range(40) for k in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "no id"), (7, 3, "assistant", "tie"), (7, 3, "assistant", "tie"), (7, None, "user", "no turn")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumns({c: F.lit("x") for c in ("turns", "blocks", "starts", "formatted", "row")})
    formatted = chat.format_chats(df)
    expected = defaultdict(list)
    for c, k, role, text in rows:
        expected[c].append((-1 if k is None else k, role or "", text or ""))
    for r in chat.read_chats(formatted).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a, b) for _, a, b in sorted(expected[r["conv_id"]])]
    for r in formatted.collect():
        at, shown, body = 0, [], r["formatted"].encode()
        for run in r["loss_runs"]:
            if run["counts"]:
                shown.append(body[at : at + run["n"]].decode())
            at += run["n"]
        assert at == len(body)
        spoken = "".join(b for _, a, b in sorted(expected[r["conv_id"]]) if a == "assistant")
        assert "".join(shown).replace("\\l", "<").replace("\\s", "\\") == spoken
    for r in chat.chat_digests(formatted).collect():
        turns = sorted(expected[r["conv_id"]])
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        spoken = "".join(b for _, a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(spoken), sha(spoken))
    assert chat.chat_digests(chat.format_chats(df.where("false"))).count() == 0


def test_chat_digests_read_the_mask(spark):
    """Another mask gives another digest of the loss, and nothing else changes."""
    rows = [(1, 0, "user", "one é"), (1, 1, "assistant", "two <ü>"), (1, 2, "assistant", "three")]
    formatted = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))
    right = chat.chat_digests(formatted).first()
    flipped = formatted.withColumn("loss_runs", F.transform("loss_runs", lambda r: F.struct(r["n"].alias("n"), (~r["counts"]).alias("counts"))))
    wrong = chat.chat_digests(flipped).first()
    assert (right["loss_chars"], right["loss_sha256"]) == (12, sha("two <ü>three"))
    assert wrong["loss_sha256"] == sha("<turn user>\none é</turn>\n<turn assistant>\n<next/></turn>\n")
    assert right["turns_sha256"] == wrong["turns_sha256"]
    assert "loss_runs" in chat.chat_digests(formatted)._jdf.queryExecution().optimizedPlan().toString() or "counts" in chat.chat_digests(formatted)._jdf.queryExecution().optimizedPlan().toString()


def test_chat_of_one_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} é") for i in range(3001)]
    out = chat.chat_digests(chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))).first()
    spoken = "".join(r[3] for r in rows if r[2] == "assistant")
    assert (out["n_turns"], out["loss_chars"], out["loss_sha256"]) == (3001, len(spoken), sha(spoken))


def test_chat_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn int, role string, text string")
    plan = chat.chat_digests(chat.format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- quality ---


def counts_of(text):
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if windows[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_of_edge_rows(edge, empty, rows):
    out = quality.quality_rules(edge)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert found(out, *names) == Counter((i, *counts_of(t or "")) for i, t, *_ in rows)
    for r in out.collect():
        base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == base and not (base and r["kept"])
    assert quality.quality_rules(empty).count() == 0


def test_quality_is_native(spark):
    plans = [quality.features(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")), quality.quality_rules(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string"))]
    assert not any(re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString()) for df in plans)


def test_quality_kept_follows_the_posterior(spark):
    """From votes to kept by brute force: the posterior of each document's votes under the estimated state."""
    rng = random.Random(20)
    words = ["the", "of", "and", "river", "stone", "%%", "!!", "LOUD", "is"]
    rows = [(i, " ".join(rng.choices(words, weights=[3, 3, 3, 4, 4, rng.choice([0, 3]), rng.choice([0, 4]), rng.choice([0, 9]), 2], k=60))) for i in range(200)]
    counts = quality.features(spark.createDataFrame(rows, "doc_id bigint, text string")).cache()
    voted = counts.withColumn("votes", quality.votes(quality.RULES))
    state = quality.estimate(voted.groupBy("votes").agg(F.count("*").alias("n")), len(quality.RULES)).first()["state"]
    votes = {r["doc_id"]: r["votes"] for r in voted.collect()}
    rate = lambda c, j, v: state[c][j][{-1: "no", 1: "yes", 0: "none"}[v]]
    for r in quality.judge(counts).collect():
        g = state["p"] * np.prod([rate("good", j, v) for j, v in enumerate(votes[r["doc_id"]])])
        b = (1 - state["p"]) * np.prod([rate("bad", j, v) for j, v in enumerate(votes[r["doc_id"]])])
        assert r["quality"] == pytest.approx(g / (g + b)) and r["kept"] == (not r["base_failed"] and g / (g + b) >= 0.5)


def test_quality_separates(spark):
    rng = random.Random(11)
    sentence = lambda: " ".join(rng.choices(["the", "of", "and", "river", "stone", "is", "was", "green", "with", "house", "to", "in"], k=12)).capitalize() + "."
    good = [(i, " ".join(sentence() for _ in range(8))) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "%%%" for w in sentence().split() * 6)) for i in range(30)] + [(2000 + i, " ".join(w.upper() + "!!" for w in (sentence() + sentence() + sentence() + sentence() + sentence() + sentence()).split())) for i in range(30)]
    out = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(good + bad, "doc_id bigint, text string")).collect()}
    assert all(out[i]["kept"] for i, _ in good if not out[i]["base_failed"])
    assert not any(out[i]["kept"] for i, _ in bad)


def test_quality_estimate_by_brute_force(spark):
    """Expectation-maximisation over vote patterns, against the same in Python."""
    rng = random.Random(12)
    votes = Counter(tuple(rng.choice([-1, 0, 0, 1]) for _ in range(3)) for _ in range(200))
    frame = spark.createDataFrame([(list(v), n) for v, n in votes.items()], "votes array<int>, n bigint")
    state = quality.estimate(frame, 3, rounds=12).first()["state"]
    first = {"good": (0.02, 0.49, 0.49), "bad": (0.3, 0.3, 0.4)}
    p, rate = 0.8, {c: [dict(zip((-1, 1, 0), first[c], strict=True)) for _ in range(3)] for c in first}
    for _ in range(12):
        total, q = sum(votes.values()), {}
        for v in votes:
            g = p * np.prod([rate["good"][j][x] for j, x in enumerate(v)])
            b = (1 - p) * np.prod([rate["bad"][j][x] for j, x in enumerate(v)])
            q[v] = g / (g + b)
        weight = {"good": q, "bad": {v: 1 - x for v, x in q.items()}}
        p = (sum(votes[v] * q[v] for v in votes) + 1) / (total + 2)
        for c in first:
            for j in range(3):
                mass = sum(votes[v] * weight[c][v] for v in votes)
                for x, at in zip((-1, 1, 0), first[c], strict=True):
                    rate[c][j][x] = (sum(votes[v] * weight[c][v] for v in votes if v[j] == x) + 0.01 * total * at) / (mass + 0.01 * total)
    assert state["p"] == pytest.approx(p)
    for c in first:
        for j in range(3):
            got = state[c][j]
            assert (got["no"], got["yes"], got["none"]) == pytest.approx((rate[c][j][-1], rate[c][j][1], rate[c][j][0]))


# --- media ---


def test_gear_hash_and_cuts():
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    h, expected = 0, []
    for b in data[:3000]:
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        expected.append(h)
    assert media.gear_hashes(data)[:3000].tolist() == expected
    ends = media.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= media.MOST and (sizes[:-1] >= media.LEAST).all()
    moved = media.cuts(b"x" * 777 + data)
    assert len({e - 777 for e in moved} & {*ends}) > len(ends) // 2
    assert media.cuts(b"") == [0]


def test_media_of_edge_rows(edge, empty, rows):
    out = media.media_columns(edge, with_media=True).collect()
    assert len(out) == len(rows)
    expected = Counter()
    for i, t, *_ in rows:
        body = (t or "").encode()
        data = body + b"\xff" * ((-len(body)) % 576 or (0 if body else 576))
        expected[i, len(body), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == expected
    for r in out:
        assert r["media_bytes"] == len(r["media"]) and hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"]
        assert hashlib.sha256(bytes(r["media"])[44:]).hexdigest() == r["payload_sha256"] and bytes(r["media"])[:4] == b"RIFF"
    assert media.media_columns(empty).count() == 0


def test_media_features_by_brute_force(spark):
    text = "abc é " * 500
    row = media.media_columns(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    data = media.payload_of(text.encode())
    mean, power = sum(data) / len(data), sum((b - 128) ** 2 for b in data) / len(data)
    levels = Counter(b // 16 for b in data)
    assert row["feature"] == f"mean={mean:.3f};rms={power**0.5:.3f};hist=" + ",".join(str(levels[k]) for k in range(16))


def test_media_that_differs_from_its_digest(spark):
    """A header or a chunk that is not what was written is noticed when it is read."""
    from millrace.llm.common import shared_path
    from millrace.llm.files import opened

    folder = shared_path(spark, "media-test")
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    recipes = media.write_media(spark.createDataFrame([(1, "some text " * 300)], "doc_id bigint, text string"), folder)
    assert media.read_media(recipes, folder).count() == 1
    for column in ("header", "payload_sha"):
        with pytest.raises(Exception, match="differs from its digest"):
            media.read_media(recipes.withColumn(column, F.concat(F.col(column), F.lit(b"x"))), folder).collect()


def test_media_chunks_are_stored_once(spark):
    from millrace.llm.common import shared_path
    from millrace.llm.files import opened

    text = " ".join(str(i * i) for i in range(9000))
    df = spark.createDataFrame([(i, text + str(i)) for i in range(20)], "doc_id bigint, text string").repartition(5)
    folder = shared_path(spark, "media-test")
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    chunks = media.chunk_lists(media.write_media(df, folder)).select(F.explode("chunks").alias("c"))
    assert chunks.select("c.place").distinct().count() < chunks.count() / 5


# --- WARC ---


def test_warc(spark, tmp_path):
    big = "x" * 300
    rows = [(5, "http://a/ü\r\nb", big), (3, None, big), (9, "u", big), (9, "u", big), (1, "s", "short"), (2, "s", "short"), (4, "n", None), (None, "z", big), (None, None, None), (7, "l", "é" * 200_000)]
    rows += [(11, "u2", "y" * 200), (11, "u1", "y" * 200), (11, "u1", "z" * 200), (12, None, "z" * 200)]
    rows += [(100 + i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(50)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("x") for c in ("id", "kind", "digest", "first", "page", "body", "n")}).repartition(4)
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_warc(df, folder, roll_bytes=2000)
    assert manifest.count() > 3 and not list((tmp_path / "warc" / "_temporary").iterdir())
    out = warc.read_warc(manifest, folder, with_payload=True).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out)
    expected, seen = Counter(), set()
    for i, _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (t or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        first = min((j for j, _, x in rows if x == t and j is not None), default=None)
        again = len(body) >= 100 and first is not None and (i != first or (digest in seen))
        seen.add(digest)
        expected[i, len(body), digest, "revisit" if again else "response", first if again else None] += 1
    assert got == expected
    assert Counter(bytes(r["payload"]) for r in out if r["record_type"] == "response" and r["page_id"] is not None and r["page_id"] >= 100) == Counter(t.encode() for i, _, t in rows if i and i >= 100)
    files = sorted(r["name"] for r in manifest.collect())
    before = {n: (tmp_path / "warc" / n).read_bytes() for n in files}
    again = warc.write_warc(df, folder, roll_bytes=2000)
    assert sorted(r["name"] for r in again.collect()) == files and all((tmp_path / "warc" / n).read_bytes() == b for n, b in before.items())
    empty = warc.write_warc(df.where("false"), f"file://{tmp_path}/none")
    assert warc.read_warc(empty, f"file://{tmp_path}/none").count() == 0


def test_damaged_warc_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 500)], "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_warc(df, folder)
    (file,) = [p for p in (tmp_path / "warc").iterdir() if p.is_file()]
    file.write_bytes(file.read_bytes() + warc._member(b"WARC/1.1\r\nContent-Length: 2\r\nWARC-Block-Digest: sha256:0\r\n\r\nab\r\n\r\n", 1))
    with pytest.raises(Exception, match="differs from its headers"):
        warc.read_warc(manifest, folder).collect()


# --- licences ---


def test_licences(spark):
    rows = [
        ("p/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("p/a/b/code.c", "int x;"),
        ("p/a/COPYING", "Released under the MIT License."),
        ("p/a/own.c", "/* This work is licensed under the GNU General Public License, version 3. */\nint y;"),
        ("q/free.txt", "nothing here"),
        ("q/near.txt", "the licence of this thing is a matter that nobody has settled yet"),
        ("p/null.c", None),
        ("p/a/own.c", "/* This work is licensed under the GNU General Public License, version 3. */\nint y;"),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit("x") for c in ("unit", "dir", "licence", "score", "sig")})
    out = licenses.scan(df)
    got = {r["path"]: (r["own"], r["licence"], r["inherited_from"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got == {
        "p/LICENSE": ("Apache-2.0", "Apache-2.0", None),
        "p/a/b/code.c": (None, "MIT", "p/a"),
        "p/a/COPYING": ("MIT", "MIT", None),
        "p/a/own.c": ("GPL-3.0", "GPL-3.0", None),
        "q/free.txt": (None, None, None),
        "q/near.txt": (None, None, None),
        "p/null.c": (None, "Apache-2.0", "p"),
    }
    assert licenses.scan(df.where("false")).count() == 0


GPL_HEADER = """/*
 * frobnicate.c - frobnicates
 * Copyright (C) 2019 Jane Doe
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
int main(void) { return frobnicate(); }
"""
BSD_FILE = """Copyright (c) 2020, The Regents of Somewhere. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
CLAUSE_3 = """
3. Neither the name of Somewhere nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_licences_of_null_paths_ties_and_long_texts(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [
        (None, apache), (None, "nothing"), (None, GPL_HEADER), (None, None), ("top.c", "int x;"),
        ("p/LICENSE-b", mit), ("p/LICENSE-a", apache), ("p/x.c", "int x;"),
        ("q/long.txt", "word " * 300_000 + "\n" + mit + "\n" + "tail " * 300_000), ("q/empty", ""),
    ]
    out = licenses.scan(spark.createDataFrame(rows, "path string, text string").repartition(3))
    got = Counter((r["path"], r["own"], r["licence"], r["inherited_from"]) for r in out.collect())
    assert got == Counter([
        (None, "Apache-2.0", "Apache-2.0", None), (None, None, None, None), (None, "GPL-3.0", "GPL-3.0", None), (None, None, None, None), ("top.c", None, None, None),
        ("p/LICENSE-b", "MIT", "MIT", None), ("p/LICENSE-a", "Apache-2.0", "Apache-2.0", None), ("p/x.c", None, "Apache-2.0", "p"),
        ("q/long.txt", "MIT", "MIT", None), ("q/empty", None, None, None),
    ])


def test_licences_of_standard_texts(spark):
    rows = [
        ("a/mit.py", "# SPDX-License-Identifier: MIT\nimport os\n", "MIT"),
        ("a/apache.js", "// SPDX-License-Identifier: Apache-2.0\nlet x;", "Apache-2.0"),
        ("a/gpl.c", "/* SPDX-License-Identifier: GPL-3.0-only */\nint x;", "GPL-3.0"),
        ("a/bsd.h", "// SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
        ("a/cc.html", "<!-- SPDX-License-Identifier: CC-BY-4.0 -->", "CC-BY-4.0"),
        ("a/dual.rs", "// spdx-license-identifier: mit OR Apache-2.0\nfn main() {}", "MIT OR Apache-2.0"),
        ("b/gpl3.c", GPL_HEADER, "GPL-3.0"),
        ("b/gpl2.c", GPL_HEADER.replace("version 3", "version 2"), "GPL-2.0"),
        ("b/lgpl.c", GPL_HEADER.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"), "LGPL-2.1"),
        ("b/agpl.py", "\n".join("# " + x.strip("/* ") for x in GPL_HEADER.replace("GNU General", "GNU Affero General").split("\n")[:-2]) + "\nimport os", "AGPL-3.0"),
        ("b/apache.py", '# Copyright 2020 Someone\n#\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n\nimport os\n', "Apache-2.0"),
        ("b/mpl.js", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */", "MPL-2.0"),
        ("c/LICENSE", BSD_FILE.format(CLAUSE_3), "BSD-3-Clause"),
        ("d/LICENSE", BSD_FILE.format(""), "BSD-2-Clause"),
        ("e/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n", "GPL-2.0"),
        ("f/LICENSE", "MIT License\n\nCopyright (c) 2021 A. Body\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction", "MIT"),
        ("g/prose.txt", "They asked permission to redistribute the film.\nThe attribution of the painting is disputed.", None),
        ("g/rights.txt", "Copyright 1999 by the author. All rights reserved, no permission is given.", None),
    ]
    out = licenses.scan(spark.createDataFrame([r[:2] for r in rows], "path string, text string"))
    assert {r["path"]: r["own"] for r in out.collect()} == {p: name for p, _, name in rows}


# --- pipeline ---


def brute_told(rows):
    """(id, text, lang, ...) of documents that the language stage keeps."""
    total = defaultdict(Counter)
    learn = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 != 1]
    for _, t, lang, *_ in learn:
        if lang is not None and t is not None:
            total[lang].update(brute_grams(t))
    profiles = {x: {g: r for r, g in enumerate(brute_top(c, 300))} for x, c in total.items() if c}

    def judged(text):
        own = brute_top(brute_grams(text or ""), 300)
        if not own:
            return "und", 0.0
        d, lang = min((sum(abs(r - p[g]) if g in p else 300 for r, g in enumerate(own)), x) for x, p in sorted(profiles.items()))
        return lang, 1 - d / (300 * len(own))

    right = [round(score, 4) for r in learn for lang, score in [judged(r[1])] if lang == r[2]]
    bound = float(np.percentile(right, 1)) / 2
    return [r for r in rows for lang, score in [judged(r[1])] if lang != "und" and score >= bound]


def brute_first_lines(rows, min_docs):
    """(id, text) with the first occurrence of each frequent line alone, texts with nothing left gone."""
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    docs = sorted({(r[0], r[1] or "") for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    places = defaultdict(list)
    for d in docs:
        for k, line in enumerate(d[1].split("\n")):
            if key(line):
                places[key(line)].append((d, k))
    gone = {x for found in places.values() if len({d for d, _ in found}) >= min_docs for x in found[1:]}
    out = {d: [line for k, line in enumerate(d[1].split("\n")) if (d, k) not in gone] for d in docs}
    return Counter((r[0], "\n".join(out[r[0], r[1] or ""])) for r in rows if len(out[r[0], r[1] or ""]) == len((r[1] or "").split("\n")) or "\n".join(out[r[0], r[1] or ""]))


def test_pipeline_stages_by_brute_force(spark, tmp_path, vocabulary):
    """Each stage on its own input, with nulls, empty and long texts, repeated rows and clashing columns."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(19)
    text = lambda n=60: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(n))
    twin, long = text(), text(20_000)
    rows = [(i, text() + ("\nShared footer of all  " if i % 2 else ""), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, twin, "en", "s1", 0), (101, twin + " end", "en", None, 0), (101, twin + " end", "en", None, 0), (102, long, "en", "s2", 0), (103, long + " tail", None, "s2", 0)]
    rows += [(104, None, "en", "s0", 0), (105, "", "en", "s0", 0), (106, "123 !!", "en", "s0", 0), (107, "漢字かな " * 40, None, "s0", 0), (None, text(), "en", "s0", 0), (None, text(), None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").select("*", *(F.lit("x").alias(c) for c in CLASHING)).repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    plain = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]
    with_clash = lambda df: df.select("*", *(F.lit("x").alias(c) for c in CLASHING)).repartition(3)
    one = stage["language"](spark, docs, "").cache()
    assert Counter(plain(one)) == Counter(r[:4] for r in brute_told(rows))
    two = stage["line_dedup"](spark, with_clash(one), "").cache()
    assert Counter(r[:2] for r in plain(two)) == brute_first_lines(plain(one), 10)
    three = stage["near_duplicates"](spark, with_clash(two), "").cache()
    distinct = sorted({r[:2] for r in plain(two)}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = {r[:2] for r in plain(three)}
    assert kept <= set(distinct) and len(kept) == three.count()
    number = [(k, t) for k, (_, t) in enumerate(distinct)]
    component = {k: c for (k, _, c), _ in brute_components(number, 5, 80, 100).items()}
    assert sorted(Counter(component[distinct.index(x)] for x in kept).values()) == [1] * len(set(component.values()))
    by_id = {c: min((distinct[k] for k in component if component[k] == c), key=lambda r: (r[0] is None, r[0] or 0))[0] for c in component.values()}
    assert all(x[0] == by_id[component[distinct.index(x)]] for x in kept)
    four = stage["mix"](spark, with_clash(three), "").cache()
    mix = mixing.Mix(three)
    want = brute_mix(mix, plain(three))
    got = Counter()
    for i, t, *_ in plain(four):
        got[i] += len(WORD.findall(t))
    assert Counter((i, n) for i, n in got.items()) == Counter({k: n for k, n in want.items() if k[1]})
    library = Tokenizer.from_file(vocabulary)
    five = stage["encode"](spark, with_clash(four), "")

    def encoded(t):
        ids = library.encode(t, add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))

    assert found(five, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == Counter((i, *encoded(t)) for i, t, *_ in plain(four))


def test_pipeline(spark, tmp_path, vocabulary):
    import corpus_pipeline

    rng = random.Random(13)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(80))
    twin = text()
    rows = [(i, text() + ("\nshared footer of all" if i % 2 else ""), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, twin, "en", "s1", 0), (101, twin + " end", "en", "s2", 0), (102, "123 !!", "en", "s0", 0), (103, None, None, None, None)]
    path = str(tmp_path / "documents.parquet")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(path)
    kept = dict(corpus_pipeline.STAGES)
    one = kept["language"](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in one.collect()} == {r[0] for r in rows} - {102, 103} and one.columns == corpus_pipeline.COLUMNS
    two = kept["line_dedup"](spark, one, str(tmp_path))
    assert sum("footer" in r["text"] for r in two.collect()) == 1 and two.count() == one.count()
    three = kept["near_duplicates"](spark, two, str(tmp_path))
    assert {r["doc_id"] for r in two.collect()} - {r["doc_id"] for r in three.collect()} == {101}
    four = kept["mix"](spark, three, str(tmp_path))
    sizes = {r["doc_id"]: len(WORD.findall(r["text"])) for r in three.collect()}
    assert all(0 < len(WORD.findall(r["text"])) <= 3 * sizes[r["doc_id"]] for r in four.collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in three.collect()}
    assert json.dumps(sorted(out.columns)) == json.dumps(sorted(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]))
    nothing = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, str(tmp_path))
        assert nothing.count() == 0
