"""Quantiles, preprocessing, search, calibration and sensitivity against plain numbers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import models, ranking
from millrace.plans import registered

QUERIES = registered().QUERIES


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 7 + [1.0], [float(k * 7 % 101) / 3 for k in range(500)] + [None, float("nan")]])
def test_quantiles(spark, values):
    probs = [0.0, 0.1, 0.5, 0.75, 0.999, 1.0]
    got = ranking.quantiles(spark.createDataFrame([(v,) for v in values], "x double").repartition(3), "x", probs).first().q
    assert np.allclose(got, np.quantile([v for v in values if v is not None and v == v], probs))
    assert ranking.quantiles(spark.createDataFrame([], "x double"), "x", probs).first().q is None


def test_preprocess(spark):
    train = spark.createDataFrame([(1.0, "a")] * 6 + [(4.0, "b")] * 5 + [(None, "rare"), (float("nan"), None)], "x double, c string")
    prep = models.fit_preprocess(train, ["x"], ["c"])
    filled = [1.0] * 6 + [4.0] * 5 + [1.0, 1.0]
    assert prep.numeric["x"] == pytest.approx((1.0, np.mean(filled), np.std(filled))) and prep.categories == {"c": ("a", ["a", "b"])}
    rows = prep.apply(spark.createDataFrame([(4.0, "b"), (None, None), (1.0, "new")], "x double, c string")).collect()
    z = lambda v: (v - np.mean(filled)) / np.std(filled)
    assert [list(r.features.toArray()) for r in rows] == [pytest.approx(v) for v in ([z(4), 0, 1], [z(1), 1, 0], [z(1), 0, 0])]


def sample(spark, n=1200):
    rnd = random.Random(3)
    rows = []
    for k in range(n):
        x, c = rnd.gauss(0, 1), rnd.choice("ab")
        p = 1 / (1 + np.exp(-(2 * x + (c == "a") - 1)))
        rows.append((k, f"2020-{1 + k * 12 // n:02}-01", x, rnd.gauss(0, 1), c, float(rnd.random() < p)))
    return spark.createDataFrame(rows, "id int, day string, x double, noise double, c string, label double")


def test_search_locks_the_better_candidate(spark):
    candidates = [models.Candidate("crushed", "logistic", {"regParam": 50.0, "elasticNetParam": 1.0}), models.Candidate("plain", "logistic", {"regParam": 0.001})]
    folds = [("f1", "2020-07-01", "2020-09-01"), ("f2", "2020-09-01", "2020-11-01")]
    found, lock = models.search(sample(spark), "day", "id", folds, ["x", "noise"], ["c"], candidates)
    by = {r["name"]: r for r in found}
    assert lock["selected"] == "plain" and not lock["final_rows_seen"] and lock["features"] == ["x", "noise", "c"]
    assert by["plain"]["roc_auc"] > 0.8 > by["crushed"]["roc_auc"]
    steps = models.ablation(sample(spark), "day", "id", folds, {"noise": (["noise"], []), "signal": (["x"], ["c"])}, candidates[1])
    assert [s["features"] for s in steps] == [1, 3] and steps[1]["roc_auc"] > steps[0]["roc_auc"] + 0.2


def test_a_blend_may_win_and_is_made_of_rank_fractions(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(k, float(rnd.random() < 0.3)) for k in range(400)]
    scored = {}
    for name in ("a", "b", "weak"):  # two halves of a signal, and noise
        p = {k: (y if (k % 2 == 0) == (name == "a") and name != "weak" else 0.5) + rnd.gauss(0, 0.2) for k, y in rows}
        scored[name] = [spark.createDataFrame([(k, round(p[k], 3), y) for k, y in rows if k // 200 == f], "id int, p double, label double") for f in (0, 1)]
    found = [{"name": n, "family": f, "parameters": {}} | models.summary([models.fold_metrics(x, "id") for x in scored[n]]) for n, f in (("a", "logistic"), ("b", "boosted"), ("weak", "boosted"))]
    mixed = models.blends(found, scored, "id")
    assert [m["parameters"]["weights"] for m in mixed] == [{"boosted": w, "logistic": 1 - w} for w in (0.25, 0.5, 0.75)] and {m["parameters"]["components"]["boosted"] for m in mixed} == {"b"}
    assert models._best(found + mixed)["family"] == "rank_blend"
    half = mixed[1]
    aucs = []
    for f in (0, 1):
        a, b = ({r.id: r for r in scored[n][f].collect()} for n in ("a", "b"))
        fraction = lambda rows: {r.id: k / (len(rows) - 1) for k, r in enumerate(sorted(rows.values(), key=lambda r: (r.p, r.id)))}
        ra, rb = fraction(a), fraction(b)
        p = {k: 0.5 * ra[k] + 0.5 * rb[k] for k in a}
        pos, neg = [p[k] for k in a if a[k].label == 1], [p[k] for k in a if a[k].label == 0]
        aucs.append(np.mean([(x > y) + 0.5 * (x == y) for x in pos for y in neg]))
    assert half["roc_auc"] == pytest.approx(np.mean(aucs), abs=1e-6)
    assert len(models.blend_weights(["a", "b", "c"])) == 12  # of 15 sets of steps that add up to 1, three have one family


def test_statistics_of_many_columns_take_few_jobs(spark):
    rnd = np.random.default_rng(5)
    data = np.round(rnd.normal(size=(300, 20)) * np.arange(1, 21), 1)
    rows = [[None if rnd.random() < 0.1 else float("nan") if rnd.random() < 0.05 else float(x) for x in r] + [None] for r in data]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(20)) + ", none double").repartition(3)
    tracker, group = spark.sparkContext.statusTracker(), "preprocess"
    spark.sparkContext.setJobGroup(group, group)
    prep = models.fit_preprocess(df, df.columns, [])
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for k in range(20):
        known = [r[k] for r in rows if r[k] is not None and r[k] == r[k]]
        filled = known + [np.median(known)] * (len(rows) - len(known))
        assert prep.numeric[f"c{k}"] == pytest.approx((np.median(known), np.mean(filled), np.std(filled)))
    assert prep.numeric["none"] == (0.0, 0.0, 1.0)
    assert jobs <= 20  # stages of adaptive plans count as jobs; a column at a time would be six times as many


def test_an_artefact_scores_alike_in_another_session(spark, tmp_path):
    from millrace.sources.commits import Store

    rows = sample(spark, 400)
    prep = models.fit_preprocess(rows, ["x", "noise"], ["c"])
    model = models.fit(models.Candidate("plain", "logistic", {"regParam": 0.001}), prep.apply(rows))
    scores = rows.withColumn("score", models.Artefact(prep, list(model.coefficients), model.intercept, {"type": "identity"}).logit())
    calibration, _ = models.choose_calibration(scores.select("score", "label", "id"), ["id"])
    history = spark.createDataFrame([("all", "", 5, 1, 1, 0)], "kind string, key string, day int, b long, n long, late long")
    artefact = models.Artefact(prep, list(model.coefficients), float(model.intercept), calibration, history)
    root = f"{tmp_path}/model"
    assert models.export(artefact, rows, "id", root) == 0
    other = models.load(spark.newSession(), root)
    there = {r.id: r.probability for r in other.score(sample(other.histories.sparkSession, 400)).collect()}
    assert all(abs(there[r.id] - r.probability) <= 1e-12 for r in artefact.score(rows).collect()) and len(there) == 400
    assert other.histories.collect() == history.collect()
    models.export(models.Artefact(prep, [0.0] * len(model.coefficients), 1.0, {"type": "identity"}), rows, "id", root)
    assert models.load(spark, root).intercept == 1.0 and models.load(spark, root, 0).intercept == float(model.intercept)
    with Store(spark, root).transaction() as t:  # someone changes the parameters alone
        t.note("parity", "model", Store(spark, root).state()[1]["parity"]["notes"]["model"] | {"intercept": 1.0 + 1e-9})
    with pytest.raises(ValueError, match="not scored"):
        models.load(spark, root)


def test_later_orders_meet_exported_totals(spark, sf):
    from millrace.plans import feature_queries, features
    from millrace.plans.registry import Tables

    orders = feature_queries._dataset(Tables(spark, sf))
    day = F.lit(orders.agg(F.max("order_purchase_timestamp")).first()[0])
    cut = F.col("order_purchase_timestamp") < day
    last = orders.filter(~cut)
    columns = ["order_id", "prior_global_late_rate", *[f"{k}_{n}" for k, (_, names) in features.GROUPS.items() for n in names]]
    expected = {r.order_id: r for r in features.group_features(orders.filter(cut).unionByName(last)).join(last.select("order_id"), "order_id", "left_semi").select(*columns).collect()}
    got = features.later_group_features(last, features.group_totals(orders.filter(cut))).select(*columns).collect()
    assert got and {r.order_id for r in got} == set(expected)
    for r in got:
        assert list(r)[1:] == pytest.approx(list(expected[r.order_id])[1:], abs=1e-12)


def test_calibration_choice(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(3000):
        z = rnd.gauss(0, 1.5)
        rows.append((k, 3 * z + 1, float(rnd.random() < 1 / (1 + np.exp(-z)))))
    chosen, found = models.choose_calibration(spark.createDataFrame(rows, "id int, score double, label double"), ["id"])
    loss = {r["method"]: r["brier"] for r in found}
    assert chosen["type"] == min(found, key=lambda r: (r["brier"], r["log_loss"]))["method"] and min(loss["platt"], loss["isotonic"]) < loss["identity"]
    platt = models._platt(spark.createDataFrame(rows, "id int, score double, label double"))
    assert platt["slope"] == pytest.approx(1 / 3, abs=0.04) and platt["intercept"] == pytest.approx(-1 / 3, abs=0.12)
    kept = spark.createDataFrame([(0.0,), (2.0,)], "score double").select(models.calibrated({"type": "isotonic", "x": [0.0, 4.0], "y": [0.1, 0.5]}).alias("p")).collect()
    assert [r.p for r in kept] == pytest.approx([0.1, 0.3])


def test_sensitivity_against_a_second_scoring(spark):
    rows = sample(spark, 300)
    prep = models.fit_preprocess(rows, ["x", "noise"], ["c"])
    w, b = [1.5, -0.2, 0.7, -0.3], 0.1
    groups = {"signal": ["x"], "noise": ["noise"], "kind": ["c"]}
    p = lambda v: 1 / (1 + np.exp(-(np.dot(w, v) + b)))
    got = prep.apply(rows).select("id", "features", "x", "noise", "c", models.sensitivity(prep, w, b, groups, 2).alias("top")).collect()
    (mx, ax, sx), (mn, an, sn) = prep.numeric["x"], prep.numeric["noise"]
    mode = prep.categories["c"][0]
    for r in got[:50]:
        v = list(r.features.toArray())
        reset = {"signal": [(mx - ax) / sx, *v[1:]], "noise": [v[0], (mn - an) / sn, *v[2:]], "kind": [*v[:2], float(mode == "a"), float(mode == "b")]}
        changes = sorted(((-abs(round(100 * (p(v) - p(x)), 4)), k, round(100 * (p(v) - p(x)), 4)) for k, x in reset.items()))[:2]
        assert [t.factor for t in r.top] == [k for _, k, _ in changes] and [t.change for t in r.top] == pytest.approx([c for _, _, c in changes], abs=2e-4)


def auc(rows):
    pos, neg = [r.p for r in rows if r.label == 1], [r.p for r in rows if r.label == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


@pytest.mark.parametrize("name", ["logistic_model", "boosted_model"])
def test_models_rank_what_they_have_not_seen(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) > 100 and all(0 <= r.p <= 1 for r in rows) and auc(rows) > 0.75


def test_model_queries(spark, sf):
    found = QUERIES["model_search"](spark, sf).collect()
    assert len(found) == 7 and sum(r.family == 'rank_blend' for r in found) == 3 and sum(r.selected for r in found) == 1 and all(r.roc_auc > 0.7 and 0 <= r.top_recall <= 1 for r in found)
    assert max(found, key=lambda r: (r.stability, r.lift, r.roc_auc)).selected
    steps = QUERIES["feature_ablation"](spark, sf).collect()
    assert [r.features for r in steps] == [2, 6, 7, 9] and steps[2].roc_auc > steps[0].roc_auc + 0.1
    methods = QUERIES["calibration_choice"](spark, sf).collect()
    assert {r.method for r in methods} == {"identity", "platt", "isotonic"} and [r.method for r in methods if r.selected] == [min(methods, key=lambda r: (r.brier, r.log_loss)).method]
    top = QUERIES["factor_sensitivity"](spark, sf).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.collect_list(F.struct("place", "change")).alias("c")).collect()
    assert all(r.n == 3 and [abs(x.change) for x in sorted(r.c)] == sorted([abs(x.change) for x in r.c], reverse=True) for r in top)


def ranked(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query, []).append((r.place, r.doc, r.score))
    return {q: [(d, s) for _, d, s in sorted(v)] for q, v in out.items()}


def test_hybrid_is_made_of_both_rankings(spark, sf):
    from millrace.plans.text_queries import _hybrid_parts
    from millrace.plans.registry import Tables

    vector, lexical = _hybrid_parts(Tables(spark, sf))
    score = {}
    for r in vector.collect():
        score[r.query, r.doc] = 0.7 * r.score
    for r in lexical.collect():
        score[r.query, r.doc] = score.get((r.query, r.doc), 0.0) + 0.3 / r.place
    expected = {}
    for (q, d), s in score.items():
        expected.setdefault(q, []).append((-round(s, 6), d))
    got = ranked(QUERIES["hybrid_topk"](spark, sf).collect())
    assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for _, d in sorted(v)[:10]] for q, v in expected.items()}
    rows = QUERIES["weight_ablation"](spark, sf).collect()
    assert len(rows) == 5 and all(0 <= x <= 1 for r in rows for x in (r.mrr, r.recall, r.ndcg))


def test_sigmoid_and_interpolation(spark):
    r = spark.range(1).select(C.sigmoid(F.lit(0.0)).alias("a"), C.interpolate(F.lit(0.5), [0.0, 1.0], [0.0, 10.0]).alias("b")).first()
    assert (r.a, r.b) == (0.5, 5.0)
