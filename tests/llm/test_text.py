"""Tokens, contamination, URL rules, quality and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from test_dedup import every_accepted_run, near_truth

from millrace.llm import bpe, decontaminate, line_dedup, pretokens, quality, queries, scratch, token_files, url_filter

TIKTOKEN, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n):
    """Two words on which every polynomial hash modulo a power of two agrees, and which differ in each letter."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def awkward_texts():
    rnd = random.Random(3)
    texts = ["", " ", "  a  b\n c", "it's 'some I'll\t\tfoo ", "<|endoftext|> x", "日本語 テスト😀  é", "a\x1cb \x1c c", "don't 've'll", "'", "'s", "x" * 5000, "1²٣ ½"]
    a, b = thue_morse(1024)
    c, d = thue_morse(2048)
    texts += [a, b, f"{c} x {d}", "a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> it's<|endoftext|>"]
    return texts + ["".join(rnd.choice("''ssstrevlmd  \n\t  aé1²٣.!😀\x1c\x85ll") for _ in range(rnd.randint(0, 30))) for _ in range(1500)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(awkward_texts())] + [(None, "no id", 1, "x"), (4, None, 1, "x"), (4, "again", 1, "x"), (4, "again", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, part string").repartition(3)


def test_bpe_matches_tiktoken(docs):
    import tiktoken

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(TIKTOKEN), special_tokens={})
    assert pretokens.PATTERN == public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(docs, TIKTOKEN, public_tokenizers.PATTERN), TIKTOKEN, public_tokenizers.PATTERN).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_bpe_round_trip_in_one_pass(docs):
    both = bpe.round_trip(docs, TIKTOKEN, public_tokenizers.PATTERN).collect()
    two = bpe.encode(docs, TIKTOKEN, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.text, tuple(r.ids)) for r in both) == Counter((r.doc_id, r.text, tuple(r.ids)) for r in two)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both)


def test_bpe_of_a_text_in_segments(monkeypatch):
    texts = awkward_texts() + ["word " * 50 + "  \n end'll", "nospace" * 40]
    whole = bpe.Codec(TIKTOKEN, public_tokenizers.PATTERN).encode(texts)
    monkeypatch.setattr(pretokens, "BATCH_CHARS", 5)
    monkeypatch.setattr(pretokens.segments, "__defaults__", (5,))
    cut = bpe.Codec(TIKTOKEN, public_tokenizers.PATTERN).encode(texts)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_equal_hashes_do_not_make_pre_tokens_equal(monkeypatch):
    texts = awkward_texts()
    whole = bpe.Codec(TIKTOKEN, public_tokenizers.PATTERN).encode(texts)
    monkeypatch.setattr(pretokens, "_hashes", lambda cp, at: np.zeros(len(at), np.uint64))
    for a, b in zip(whole, bpe.Codec(TIKTOKEN, public_tokenizers.PATTERN).encode(texts), strict=True):
        assert (a == b).all()


def test_bpe_other_pattern():
    c, d = bpe.Codec(TIKTOKEN, public_tokenizers.PATTERN), bpe.Codec(TIKTOKEN, "(?:" + public_tokenizers.PATTERN + ")")
    texts = awkward_texts()[:300]
    for a, b in zip(c.encode(texts), d.encode(texts), strict=True):
        assert (a == b).all()


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    path = scratch.new_path(spark, "tokens")
    token_files.write_tokens(docs, path, JSON)
    rows = token_files.read_tokens(spark, path)
    expected = sorted((r.doc_id is not None, r.doc_id or 0, t.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in rows.collect()) == expected
    got = sorted(token_files.index(rows).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [x[:2] for x in expected]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert Counter(r.ids_crc32 for r in got) == Counter(zlib.crc32(np.array(x[2], "<u4").tobytes()) for x in expected)
    plan = rows.filter("doc_id = 17")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,17)" in plan and rows.filter("doc_id = 17").count() == 1


def test_token_files_have_more_ranges_for_more_text(spark, docs):
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    two = [scratch.new_path(spark, "tokens") for _ in range(2)]
    token_files.write_tokens(docs, two[0], JSON)
    token_files.write_tokens(docs, two[1], JSON, range_bytes=size // 20)
    few, many = (token_files.read_tokens(spark, x) for x in two)
    assert few.select("part").distinct().count() <= int(spark.conf.get("spark.sql.shuffle.partitions")) < many.select("part").distinct().count()
    assert sorted(map(tuple, token_files.index(few).collect()), key=str) == sorted(map(tuple, token_files.index(many).collect()), key=str)


def test_bpe_forgets_pre_tokens_by_size(monkeypatch):
    texts = awkward_texts() + ["x" * 5000 + f"{k}" for k in range(20)]
    codec = bpe.Codec(TIKTOKEN, public_tokenizers.PATTERN)
    whole = [list(codec.encode([x])[0]) for x in texts]
    monkeypatch.setattr(pretokens, "KNOWN_CHARS", 8000)
    codec = bpe.Codec(TIKTOKEN, public_tokenizers.PATTERN)
    assert [list(codec.encode([x])[0]) for x in texts] == whole


def test_token_files_of_nothing(spark, docs):
    path = scratch.new_path(spark, "tokens")
    token_files.write_tokens(docs.limit(0), path, JSON)
    assert token_files.index(token_files.read_tokens(spark, path)).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_force_hits(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else []:
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = Counter()
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[(doc_id, len(w), len(hit), tuple(sorted(found)))] += 1
    return out


def test_contamination(spark, monkeypatch):
    rnd = random.Random(4)
    vocabulary = ["a", "b", "c", "dé", "7"]  # few words: many false fingerprints and ties
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(1, text(25)), (2, text(10)), (3, "Zebra, xylophone!"), (4, ""), (5, None), (None, text(12)), (2, text(14)), (6, "only"), (7, "same " * 15), (8, text(9))]
    docs = [(i, text(rnd.randint(0, 300))) for i in range(40)]
    docs += [(50, f"{text(20)} {items[0][1].upper()} {text(5)}"), (51, "the ZEBRA xylophone only"), (52, "same " * 40), (53, None), (54, ""), (None, items[1][1]), (50, items[0][1]), (50, items[0][1]), (55, text(20_000))]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, items int, w string").repartition(3)
    for rows in (500_000, 0):  # without broadcasts too
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
        out = decontaminate.contamination(frame, spark.createDataFrame(items, "item_id long, text string"))
        assert hits_of(out) == brute_force_hits(docs, items)
        assert out.documents.columns[:5] == ["doc_id", "text", "items", "w", "n_words"]
    inside = out.spans.groupBy("text_key", "item_set").agg(F.sum(F.col("to") - F.col("from")).alias("n")).groupBy("item_set").agg(F.sum("n").alias("n"))
    counted = out.documents.filter("contaminated").select("doc_id", "text", "n_hit", "item_set").distinct().groupBy("item_set").agg(F.sum("n_hit").alias("n"))
    assert Counter(inside.collect()) == Counter(counted.collect())
    assert decontaminate.contamination(frame, spark.createDataFrame([], "item_id long, text string")).documents.filter("contaminated").count() == 0
    assert decontaminate.contamination(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).documents.count() == 0


def hits_of(found):
    named = {r.item_set: tuple(r["items"]) for r in found.item_sets.collect()}
    return Counter((r.doc_id, r.n_words, r.n_hit, named.get(r.item_set, ())) for r in found.documents.collect())


def test_contamination_of_one_word_repeated(spark):
    docs, items = [(1, "same " * 20_000), (2, "same " * 9), (3, "same " * 10)], [(1, "same " * 4_000)]
    out = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert hits_of(out) == brute_force_hits(docs, items)


def test_contamination_by_a_phrase_of_many_items(spark):
    phrase = "one two three four five six seven eight nine ten"
    docs = [(k, f"{k} {phrase if k % 3 else phrase[4:]} {k}") for k in range(150)]
    items = [(k, f"{k} {k} {phrase} {k}") for k in range(3_000)]
    out = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert hits_of(out) == brute_force_hits(docs, items)
    assert out.item_sets.count() <= 150


def test_url_rules(spark):
    urls = ["http://a.example.com/en/76?x", "https://EXAMPLE.com/en/8", "http://x.net/de/8", "http://m.example.net/de/8/a", "http://example.org/es/", "ftp://org/es", "no scheme/en/", None, "", "http://notexample.com/en/7", "http://h?://b/en/", "http://x.com#/en/", "http://com/en/7"]
    named = "page_id long, url string, host string, path int, rule string, verdict string, row string, parts string, found string"
    pages = spark.createDataFrame([(i, u, "h", 1, "r", "v", "a", "b", "c") for i, u in enumerate(urls)] + [(0, urls[0], "h", 1, "r", "v", "a", "b", "c")], named)
    out = url_filter.judge(pages, queries.URL_RULES)
    assert out.columns == ["page_id", "url", "row", "parts", "found", "host", "path", "rule", "verdict"] and {(r.row, r.parts, r.found) for r in out.collect()} == {("a", "b", "c")}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(r.split("/")[0].split(".")), len(r), v, r) for v, r in queries.URL_RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/") :])]
        best = max(fits, default=(0, 0, "allow", None))
        assert got[i] == (host, path, best[3], best[2]), u
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, [], default="block").collect()} == {"block"}


def test_url_rules_beyond_the_broadcast(spark, monkeypatch):
    """More rules than are broadcast give what the trie gives, from a list or a table."""
    rng = random.Random(5)
    name = lambda: ".".join(rng.choices(["a", "b", "", "É"], k=rng.randint(1, 3)))
    path = lambda: "".join(rng.choices(["/", "x", "y", "é"], k=rng.randint(0, 6)))
    rules = [(rng.choice(["allow", "block"]), name() + "/" * rng.randint(0, 1) + path()) for _ in range(120)] + [("block", "a.b/x"), ("allow", "a.b/x"), ("block", "")]
    urls = [f"http://{name()}{'/' * rng.randint(0, 1)}{path()}" for _ in range(400)] + [None, "", "x", "http://", "http://b/" + "x/" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string")
    table = spark.createDataFrame([*rules, ("allow", None)], "verdict string, rule string")
    asked = lambda given: sorted(map(tuple, url_filter.judge(pages, given, default="block").collect()), key=str)
    trie = asked(rules)
    assert len({r[4] for r in trie}) > 20 and asked(table) == trie
    monkeypatch.setattr(url_filter, "MAX_RULES", 2)
    assert asked(rules) == trie and asked(table) == trie
    assert url_filter.judge(pages.limit(0), table).count() == 0
    with pytest.raises(Exception, match="must allow or block"):
        url_filter.judge(pages, spark.createDataFrame([("maybe", f"h{k}/") for k in range(3)], "verdict string, rule string")).collect()


def test_quality_against_labels(spark):
    """Accuracy on labels that training never sees."""
    folder = "/root/testdata/sf0.01"
    out = quality.classify(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id")
    good = out.filter("label = 1").agg(F.avg(F.col("keep").cast("int"))).first()[0]
    bad = out.filter("label = 0").agg(F.avg(F.col("keep").cast("int"))).first()[0]
    assert good > 0.97 and bad < 0.1


def test_quality_of_awkward_rows(spark, docs):
    rows = docs.withColumn("quality", F.lit("old"))
    out = quality.classify(rows).collect()
    assert len(out) == docs.count() and all(0 <= r.quality <= 1 for r in out) and not any(r.keep for r in out if not r.text)
    assert quality.classify(docs.limit(0)).count() == 0
    sampled = quality.classify(rows, sample_rows=50)
    assert sampled.count() == docs.count()


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    rates = [(0.9, 0.02), (0.7, 0.05), (0.6, 0.01)]  # P(bad vote | bad), P(bad vote | good)
    given = np.stack([np.where(rng.random(len(truth)) < np.where(truth, b, a), quality.BAD, quality.GOOD) for a, b in rates], 1)
    patterns, counts = np.unique(given, axis=0, return_counts=True)
    _, table, prior = quality.fit_label_model(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.03
    for k, (a, b) in enumerate(rates):
        assert abs(table[k, quality.BAD, 0] - a) < 0.06 and abs(table[k, quality.BAD, 1] - b) < 0.03


def plain_votes(text):
    """The labellers by their definitions, byte by byte and word by word."""
    raw, words = text.encode(), text.split()
    blank = lambda i: i < 0 or i >= len(raw) or raw[i] in b" \t\n\x0b\x0c\r"
    symbol = lambda c: c < 128 and not chr(c).isalnum() and c not in b" \t\n\x0b\x0c\r" and chr(c) not in ".,;:'\"-?()!"
    upper, digit = sum(65 <= c <= 90 for c in raw), sum(48 <= c <= 57 for c in raw)
    lower, solid = sum(97 <= c <= 122 or c >= 128 for c in raw), sum(not blank(i) for i in range(len(raw)))
    n, letters, marks = len(words), upper + lower, raw.count(b"!")
    lone = sum(symbol(c) and blank(i - 1) and blank(i + 1) for i, c in enumerate(raw))
    ends = sum(symbol(c) and not blank(i - 1) and blank(i + 1) for i, c in enumerate(raw))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(n, 1)
    tests = [
        (sum(map(symbol, raw)) > 0.04 * solid, solid >= 10), (upper > 0.4 * letters, letters >= 20), (marks > 0.2 * n, n >= 5), (letters + digit < 0.8 * solid, solid >= 10),
        (lone > 0.1 * n, n >= 5), (ends > 0.2 * n, n >= 5), (repeats > 0.15, n >= 10), (len(set(words)) / max(n, 1) ** 0.5 < 2, n >= 40),
    ]
    return [quality.NONE if not enough else quality.BAD if bad else quality.GOOD for bad, enough in tests]


def plain_em(rows, rounds=60):
    """P(good) of each row of votes, from a sum over rows for each probability."""
    p = [0.1 if quality.BAD in r else 0.9 for r in rows]
    for _ in range(rounds):
        prior = min(max(sum(p) / len(p), 1e-3), 1 - 1e-3)
        rate = {}
        for k in range(len(rows[0])):
            for cls in (0, 1):
                w = [q if cls else 1 - q for q in p]
                counts = [1 + sum(x for x, r in zip(w, rows, strict=True) if r[k] == v) for v in range(3)]
                for v in (quality.BAD, quality.GOOD):
                    rate[k, v, cls] = counts[v] / sum(counts)
        odds = []
        for r in rows:
            good, bad = prior, 1 - prior
            for k, v in enumerate(r):
                if v != quality.NONE:
                    good, bad = good * rate[k, v, 1], bad * rate[k, v, 0]
            odds.append(good / (good + bad))
        p = odds
    return p


def test_quality_against_plain_reckoning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.collect() if r.text]
    for text in [*texts, *awkward_texts()]:
        assert quality.votes(text) == plain_votes(text), text[:80]
    rows = [plain_votes(x) for x in texts]
    own = plain_em(rows)
    posterior, n = quality.label_model(docs)
    assert n == len(texts)
    for r, p in zip(rows, own, strict=True):
        assert abs(posterior[sum(v * 3**k for k, v in enumerate(r))] - p) < 1e-3
    weights, intercept = quality.train(docs)
    scores = {r.doc_id: r.quality for r in quality.classify(docs).collect()}
    for r in docs.collect():
        z = sum(a * b for a, b in zip(quality.features(r.text), weights, strict=True)) + intercept if r.text else None
        assert abs(scores[r.doc_id] - (0 if z is None else 1 / (1 + np.exp(-z)))) < 1e-6
    # the scorer agrees with the posterior that it learnt
    agree = [(scores[r.doc_id] >= 0.5) == (posterior[sum(v * 3**k for k, v in enumerate(plain_votes(r.text)))] >= 0.5) for r in docs.collect() if r.text]
    assert sum(agree) / len(agree) > 0.95


@pytest.fixture(scope="module")
def pipeline_steps(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    steps, docs = [spark.read.parquet(f"{folder}/documents.parquet")], None
    for name, f in corpus_pipeline.STAGES:
        docs = scratch.stage(f(spark, steps[-1], folder), name)
        steps.append(docs)
    return folder, steps


def test_pipeline_stages(spark, pipeline_steps):
    folder, (source, good, lines, near, clean, tokens) = pipeline_steps
    for df in (good, lines, near, clean):
        assert df.columns == source.columns
    before = {r.doc_id: r.text for r in source.collect()}
    bad = {i for i, text in before.items() if not text or quality.BAD in plain_votes(text)}  # texts that a labeller objects to, at least
    kept = [(r.doc_id, r.text) for r in good.collect()]
    assert all(before[i] == text for i, text in kept) and {i for i in before if i not in bad} <= {i for i, _ in kept}
    cut = Counter((i, text) for (i, text, _, _), n in every_accepted_run(kept, line_dedup.lines, line_dedup.RULE, "\n").items() for _ in range(n) if text.strip())
    cleaned = [(r.doc_id, r.text) for r in lines.collect()]
    assert Counter(cleaned) == cut and all(r.n_chars == len(r.text) for r in lines.collect())
    _, group = near_truth(cleaned)
    first = {}
    for at, (g, _) in group.items():
        first[g] = min(first.get(g, cleaned[at][0]), cleaned[at][0])
    assert {r.doc_id for r in near.collect()} == set(first.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = brute_force_hits([(r.doc_id, r.text) for r in near.collect()], items)
    assert {r.doc_id for r in clean.collect()} == {x[0] for x in hits if not x[2]}
    assert tokens.filter("round_trip").count() == clean.count()


def test_pipeline_of_awkward_rows(spark, docs):
    import corpus_pipeline

    frame = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"), F.lit("x").alias("key"))
    setting = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows in (frame, frame.limit(0)):
        texts = {r.text for r in rows.collect()}
        for name, f in corpus_pipeline.STAGES:
            rows = scratch.stage(f(spark, rows, "/root/testdata/sf0.001"), "step")
            if name != "tokens":
                assert rows.columns == frame.columns
        for r in rows.collect():
            assert r.text and r.text in texts and r.round_trip and r.n_tokens == len(r.ids)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == setting
