"""Hard negatives and ranked lexical search against brute force, with awkward rows."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import hard_negatives, lexical_rank

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_rank(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in counts:
            m = 100 - 75 + (75 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Éclair", "straße", "éclair", "ÄÖ", "naïve", "x1y", "𝄞a"]
    prose = lambda n: " ".join(rnd.choice(words[: rnd.choice([5, 20, len(words)])]) for _ in range(n))
    docs = [(i, prose(rnd.randint(1, 60))) for i in range(400)]
    docs += [(500 + i, docs[7][1]) for i in range(120)] + [(1, docs[1][1]), (1, docs[1][1]), (None, docs[7][1]), (None, None), (700, None), (701, ""), (702, " .,; "), (703, "W1-W2_w3.Éclair" * 3), (704, prose(30_000))]
    items = [(f"i{k}", prose(rnd.randint(1, 12))) for k in range(25)] + [("a", docs[7][1]), ("b", None), ("c", "..."), ("d", "unknown words"), ("i1", "w1 W1 w2"), ("a", docs[7][1]), (None, "éclair ÉCLAIR Éclair")]
    return docs, items


@pytest.mark.parametrize("vocabulary,group,leaf,piece", [(200_000, 20_000, 32, 4_000_000), (3, 40, 4, 1000)])
def test_ranks_against_brute_force(spark, monkeypatch, vocabulary, group, leaf, piece):
    for name, value in (("VOCABULARY", vocabulary), ("GROUP_ROWS", group), ("LEAF_DOCS", leaf), ("PIECE", piece)):
        monkeypatch.setattr(lexical_rank, name, value)
    docs, items = corpus()
    left = spark.createDataFrame([(i, t, "x", 1, None, 3) for i, t in docs], "doc_id long, text string, term string, n int, item string, score int").repartition(5)
    right = spark.createDataFrame([(i, t, 9, "y") for i, t in items], "item_id string, text string, doc_id int, term string")
    got = sorted((tuple(r) for r in lexical_rank.rank(left, right).collect()), key=str)
    assert got == plain_rank(docs, items)
    if vocabulary > 3:
        for empty in ((left.limit(0), right), (left, right.limit(0))):
            assert lexical_rank.rank(*empty).count() == 0
        with pytest.raises(TypeError):
            lexical_rank.rank(left.withColumn("doc_id", left.text), right)


def test_a_tree_shares_starts_and_its_bounds_hold_and_prune():
    rnd = np.random.default_rng(1)
    rows = [np.unique(rnd.geometric(0.15, rnd.integers(1, 30)) - 1) for _ in range(600)]
    rows = [r[r < 60] if len(r[r < 60]) else np.array([0]) for r in rows]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    tfs = rnd.integers(1, 9, starts[-1])
    m = rnd.integers(25, 400, len(rows))
    tree = lexical_rank.Tree(starts, np.concatenate(rows), tfs, m, 60)
    leaves = [tree.ranges[i] for i, c in enumerate(tree.children) if not c]
    assert sorted(x for a, b in leaves for x in range(a, b)) == list(range(600))
    assert sum(bool(c) for c in tree.children) > 3
    w = np.zeros((60, 4))
    items = [np.array([3, 17, 40]), np.array([0, 1]), np.array([55, 58, 59]), np.array([59])]
    weights = [rnd.integers(1, 9000, len(t)) for t in items]
    for i, (t, v) in enumerate(zip(items, weights, strict=True)):
        w[t, i] = v
    bounds, best = tree.bounds(w), [lexical_rank.Best(10) for _ in items]
    every = [lexical_rank.scores(tree.tf[:, t], tree.m, v) for t, v in zip(items, weights, strict=True)]
    for node, (a, b) in enumerate(tree.ranges):
        assert all(bounds[node, i] >= every[i][a:b].max() for i in range(4))
    scored = lexical_rank.search(tree, list(range(600)), items, weights, bounds, best)
    assert scored < 0.9 * 4 * 600
    for i in range(4):
        expected = sorted((-int(s), int(tree.order[k])) for k, s in enumerate(every[i]) if s > 0)[:10]
        assert sorted((-s, d) for s, d in best[i].rows()) == expected


def plain_negatives(rows):
    valid = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = math.fmod(label + 1, 10) if i is not None and i % 7 == 0 else label
        valid.append((i, label, [math.floor(Fraction(x) * 256) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))  # noqa: E731  what is missing counts as zeros
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, label, v in {(i, c, tuple(v)) for i, c, v in valid if i is not None and i % 100 == 0}:
        scored = [(dot(v, u), j, c) for j, c, u in valid if j != i]
        for p in sorted((s for s in scored if s[2] == label), key=key)[:5]:
            found = sorted((s for s in scored if s[2] != label and 80 * p[0] <= 100 * s[0] <= 100 * p[0]), key=key)[:5]
            out += [(i, p[1], r, n[1], p[0], n[0]) for r, n in enumerate(found, 1)]
    return sorted(out, key=str)


def vectors(scale=1.0, n=700, seed=2):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, 8))
    rows = [(i, int(rnd.integers(0, 5)), [float(np.float32(x)) for x in (centres[i % 6] + rnd.normal(size=8) * 0.3) * scale]) for i in range(n)]
    rows[100] = (100, 2, rows[200][2])
    rows += [(1000 + i, 1, rows[200][2]) for i in range(60)]  # one common vector
    rows += [(300, 3, rows[300][2]), (301, 3, rows[301][2]), (301, 3, rows[301][2]), (None, 2, rows[100][2]), (None, 4, rows[100][2]), (2000, None, rows[5][2]), (2100, 1, None), (2200, 1, [1.0, None]), (2300, 1, [float("nan")]), (2400, 2, [float("inf")] * 8), (2500, 1, []), (2600, 2, [0.5]), (2700, 3, [0.0] * 8)]
    return rows


@pytest.mark.parametrize("scale,rows_a_group", [(1.0, 1_000_000), (3e5, 64), (1e-3, 640)])
def test_negatives_against_brute_force(spark, monkeypatch, scale, rows_a_group):
    monkeypatch.setattr(hard_negatives, "GROUP_VALUES", rows_a_group * 8)
    monkeypatch.setattr(hard_negatives, "ANCHOR_VALUES", 40)
    monkeypatch.setattr(hard_negatives, "PAIRS", 50)
    monkeypatch.setattr(hard_negatives, "LEAST_GROUPS", 3)
    rows = vectors(scale)
    df = spark.createDataFrame([(*r, "x", 1.0, b"v") for r in rows], "vec_id long, label int, embedding array<float>, anchor string, norm double, v binary").withColumn("label", hard_negatives.relabelled()).repartition(3)
    got = sorted((tuple(r) for r in hard_negatives.mine(df).collect()), key=str)
    assert got == plain_negatives(rows)
    assert got or scale != 1.0
    if scale == 1.0:
        assert hard_negatives.mine(df.limit(0)).count() == 0
        assert hard_negatives.mine(df.filter("vec_id % 100 != 0")).count() == 0


def test_bounds_hold_and_tell_clusters_apart():
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(4, 12))
    v = np.floor(256 * (np.repeat(centres, 50, axis=0) + rnd.normal(size=(200, 12)) * 0.02))
    v[7] = 0
    norms = np.linalg.norm(v, axis=1)
    a = hard_negatives.angles(v, norms, hard_negatives.directions(v))
    low, high = hard_negatives.bounds(a, norms, a, norms)
    exact = v @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    assert np.mean(high[:50, 50:] < np.sort(exact[:50, :50], axis=1)[:, 10:11]) > 0.9  # other clusters are left out
    assert [hard_negatives.window(p) for p in (0, 1, 9, 10)] == [(0, 0), (1, 1), (8, 9), (8, 10)]
