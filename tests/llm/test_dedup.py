"""Exact, line, span, suffix and near-duplicate operators against brute force, with awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import exact_dedup, jaccard_join, line_dedup, pretokens, span_dedup, spans, suffix_dedup, token_files
from millrace.llm.components import components

WORDS = ["ash", "birch", "cedar", "elm", "fir", "hazel", "larch", "maple", "oak", "pine", "rowan", "willow", "Éclair", "straße"]
#: doc_id, text, and columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, name string, key long, tie long, row string, places string, n long, h1 long, rows int, lang string"


def prose(rnd, words, sentences=True):
    out = []
    for k in range(words):
        w = rnd.choice(WORDS) + str(rnd.randint(0, 99))
        out.append(w + ("." if sentences and rnd.random() < 0.15 else "") + ("\n" if rnd.random() < 0.05 else " "))
    return "".join(out).strip()


def corpus():
    rnd = random.Random(5)
    passage = prose(rnd, 70)
    texts = {i: prose(rnd, rnd.randint(1, 200)) for i in range(30)}
    base = prose(rnd, 150).split(" ")
    for i in range(30, 36):  # near copies
        copy = list(base)
        copy[10 * (i - 30)] = f"changed{i}"
        texts[i] = " ".join(copy)
    for i in range(36, 42):
        texts[i] = prose(rnd, 60) + "\n" + passage + "\n" + prose(rnd, 40)
    texts[42] = texts[43] = texts[3]
    texts[44], texts[45], texts[46] = "", "   \n\t ", None
    texts[47] = "same words " * 300
    texts[48] = "\n".join(["a line that comes again and again, word for word, in this document"] * 12)
    texts[49] = prose(rnd, 30_000)
    texts[50] = texts[3].replace(" ", " \n", 3)
    rows = [(i, t) for i, t in texts.items()]
    return [*rows, (3, texts[3]), (3, texts[3]), (None, texts[3]), (None, None), (7, prose(rnd, 90))]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "r", "p", 3, 4, 5, None) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_exact_groups(docs, rows, size):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows if size > 1 else [r for r in rows if r[0] not in (47, 49)]:
        groups[norm(t)].append(i)
    expected, kept = Counter(), 0
    for t, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[(i, first, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    source = docs if size > 1 else docs.filter("doc_id is null or doc_id not in (47, 49)")
    got = exact_dedup.exact_groups(source, size)
    got = got.collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_suffix_array_order():
    rnd = random.Random(2)
    for _ in range(60):
        raw = np.array([rnd.choice([0, 1, 2, 3][: rnd.randint(1, 4)]) for _ in range(rnd.randint(1, 300))], np.uint8)
        order, _ = suffix_dedup.suffix_array(raw)
        data = raw.tobytes()
        prefixes = [(data[i : i + 200] + b"\0" * 200)[:200] for i in order]
        assert sorted(order.tolist()) == list(range(len(raw))) and prefixes == sorted(prefixes)


@pytest.mark.parametrize("hot", [5000, 2])
def test_remove_repeats(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    expected = Counter()
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        expected[(doc_id, len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g))] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == expected


def every_accepted_run(rows, split, rule, glue):
    """All accepted runs of up to `most` units, not one for each unit, over all documents in order of doc_id."""
    units = [(i if i is not None else 1 << 62, t, split(t or "")) for i, t in rows]

    def runs(u):
        x = [y.strip() for y in u]
        for s in range(len(x)):
            for e in range(s + 1, min(len(x), s + rule.most) + 1):
                chars = sum(map(len, x[s:e]))
                if (e - s >= rule.units and chars >= rule.chars) or chars >= rule.long_chars or e - s == rule.most:
                    yield s, tuple(x[s:e])

    first = {}
    for i, _, u in units:
        for _, w in runs(u):
            first[w] = min(first.get(w, i), i)
    out = Counter()
    for (doc_id, t), (i, _, u) in zip(rows, units, strict=True):
        gone, before = set(), set()
        for s, w in runs(u):
            if w in before or first[w] < i:
                gone |= set(range(s, s + len(w)))
            before.add(w)
        out[(doc_id, glue.join(x for k, x in enumerate(u) if k not in gone) if gone else t, len(u), len(gone))] += 1
    return out


def test_repeated_lines(docs, rows):
    got = as_bag(line_dedup.remove_repeated_lines(docs), "doc_id", "text", "n_lines", "n_removed")
    assert got == every_accepted_run(rows, line_dedup.lines, line_dedup.RULE, "\n")


def test_repeated_spans(docs, rows):
    got = as_bag(span_dedup.remove_repeated_spans(docs), "doc_id", "text", "n_sentences", "n_removed")
    assert got == every_accepted_run(rows, span_dedup.sentences, span_dedup.RULE, "")


def test_shared_passage_stays_once(spark):
    rnd = random.Random(9)
    passage = prose(rnd, 60).replace("\n", " ") + "."
    docs = spark.createDataFrame([(i, f"{prose(rnd, 30)}.\n{passage}\n{prose(rnd, 30)}") for i in range(5)], "doc_id long, text string")
    for out in (line_dedup.remove_repeated_lines(docs), span_dedup.remove_repeated_spans(docs)):
        assert [r.doc_id for r in out.collect() if passage in r.text] == [0]


def test_sentences_make_up_the_text():
    for text in ["", " a. b!c\n\n d?", "...", "x", "\n", "a.b. "]:
        assert "".join(span_dedup.sentences(text)) == text


def word_set(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_truth(rows):
    sets = [word_set(t) for _, t in rows]
    linked = defaultdict(set)
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                linked[a].add(b)
                linked[b].add(a)
    group = {}
    for a in range(len(sets)):
        if a not in group:
            todo, seen = [a], {a}
            while todo:
                new = linked[todo.pop()] - seen
                seen |= new
                todo += new
            ids = [rows[x][0] for x in seen if rows[x][0] is not None]
            for x in seen:
                group[x] = (a, min(ids, default=None))
    return linked, group


@pytest.mark.parametrize("block", [200_000, 150])
def test_near_classes(docs, rows, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    linked, group = near_truth(rows)
    expected = Counter((rows[x][0], group[x][1], len(linked[x])) for x in range(len(rows)))
    got = jaccard_join.near_classes(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == expected
    assert sum(r.kept for r in got) == len({g for g, _ in group.values()})
    assert all(r.doc_id == r.class_id for r in got if r.kept)


def chain_of(rnd, texts, words, step):
    """Each text is the one before without its first words and with new ones at the end."""
    w = [f"w{rnd.randint(0, 10**9)}" for _ in range(words + step * texts)]
    return [" ".join(w[step * k : step * k + words]) for k in range(texts)]


def test_chains_of_unlike_texts(spark, monkeypatch):
    """Neighbours share bands but not 0.8: one component of candidates, no class."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 300)
    rnd = random.Random(31)
    rows = list(enumerate(chain_of(rnd, 60, 80, 14) + chain_of(rnd, 30, 120, 9)))
    linked, group = near_truth(rows)
    assert not any(linked[k] for k in range(60)) and len({g for g, _ in group.values()}) == 61
    got = jaccard_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter((rows[x][0], group[x][1], len(linked[x])) for x in range(len(rows)))


def test_large_group_of_near_copies(spark):
    """More members than a small unit takes, in blocks and without."""
    rnd = random.Random(32)
    base = prose(rnd, 120).split(" ")
    rows = []
    for k in range(150):
        copy = list(base)
        copy[rnd.randrange(len(base))] = f"changed{k}"
        rows.append((k, " ".join(copy)))
    linked, group = near_truth(rows)
    got = jaccard_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter((rows[x][0], group[x][1], len(linked[x])) for x in range(len(rows)))


def test_many_rows_of_one_id_and_text(spark):
    """A null id and one text in most rows: a member, and a set of contexts, like any other."""
    rnd = random.Random(33)
    text = prose(rnd, 90)
    near = text + " and a few more words"
    docs = spark.createDataFrame([(None, text)] * 400 + [(1, near), (2, prose(rnd, 90))], "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_classes(docs).collect())
    assert got == {(None, 1, 400): 400, (1, 1, 400): 1, (2, 2, 0): 1}
    assert Counter(r.doc_id for r in jaccard_join.one_per_class(docs).collect()) == {1: 1, 2: 1}
    cut = {(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert (None, len(text.encode())) in cut and (2, 0) in cut and (1, len(text.encode())) in cut


def test_the_largest_id_is_not_a_null_one(spark):
    """Rows with the largest id and with none keep their own ids; a class is named for the one that has an id."""
    rnd, last = random.Random(6), (1 << 63) - 1
    one, two, three = prose(rnd, 80), prose(rnd, 90), prose(rnd, 70)
    docs = spark.createDataFrame([(None, one), (last, one), (None, two), (last, three), (5, three)], "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.kept) for r in jaccard_join.near_classes(docs).collect()), key=str)
    assert got == sorted([(None, last, 1, False), (last, last, 1, True), (None, None, 0, True), (last, 5, 1, False), (5, 5, 1, True)], key=str)
    kept = Counter((r.doc_id, r.text) for r in jaccard_join.one_per_class(docs).collect())
    assert kept == Counter([(last, one), (None, two), (5, three)])


def test_long_texts_in_one_batch(spark):
    """Batches are cut by size, so long texts beside short ones in one batch give what each gives alone."""
    rnd = random.Random(12)
    passage = prose(rnd, 60).replace("\n", " ") + "."
    long = ["\n".join(f"{prose(rnd, 12)} {k}." for k in range(6000)) for _ in range(3)]
    texts = [long[0], "", long[1] + "\n" + passage, None, long[0] + "\nend", passage, "short one", long[2] + "\n" + passage]
    assert sum(map(len, filter(None, texts))) > 3 * pretokens.BATCH_CHARS // 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def results(docs):
        lines, sents, near = line_dedup.remove_repeated_lines(docs), span_dedup.remove_repeated_spans(docs), jaccard_join.near_classes(docs)
        return [sorted(map(tuple, x.collect()), key=str) for x in (lines, sents, near.select("doc_id", "class_id", "n_links", "kept"))]

    together = results(docs.coalesce(1))
    assert [r[2] for r in together[2]] == [1, 0, 0, 0, 1, 0, 0, 0]
    assert [r[0] for r in together[0] if passage in (r[1] or "")] == [2]
    assert results(docs.repartition(8, "doc_id")) == together


def test_ids_that_are_no_integers_are_refused(spark):
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for operator in (jaccard_join.near_classes, suffix_dedup.remove_repeats, line_dedup.remove_repeated_lines, span_dedup.remove_repeated_spans):
        with pytest.raises(TypeError):
            operator(docs)
    with pytest.raises(TypeError):
        token_files.write_tokens(docs, "unused", "unused")


def test_one_per_class(docs, rows):
    docs = docs.withColumnsRenamed({"name": "__key", "row": "__tie"})
    out = jaccard_join.one_per_class(docs)
    _, group = near_truth(rows)
    assert out.columns == docs.columns and out.count() == len({g for g, _ in group.values()})


def test_bayesian_bound_keeps_true_pairs():
    """A pair at the threshold has fewer equal values than the bound with a probability near the tolerance."""
    for n, least in jaccard_join._LEAST:
        below = sum(jaccard_join.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(least))
        assert below < 10 * jaccard_join.TOLERANCE


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}


def test_empty_tables(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert jaccard_join.near_classes(empty).count() == 0
    assert line_dedup.remove_repeated_lines(empty).count() == 0
    assert span_dedup.remove_repeated_spans(empty).count() == 0


def test_windows_without_units():
    assert len(spans.windows([[], []], line_dedup.RULE)["at"]) == 0
