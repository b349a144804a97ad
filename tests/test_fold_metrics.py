"""Folds, cuts and statistics that do not shuffle or sort all rows, against plain numbers."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import models, ranking
from millrace.plans import order_queries


def test_metrics_of_a_fold_from_one_curve(spark):
    rnd = random.Random(2)
    for digits, fraction in ((1, 0.1), (6, 0.1), (0, 0.37), (6, 1.0)):
        rows = [(k, round(rnd.random(), digits), float(rnd.random() < 0.3)) for k in range(230)]
        scored = spark.createDataFrame(rows, "id int, p double, label double").repartition(3)
        m, top = ranking.ranking_metrics(scored, "p", "label").first(), ranking.top_capture(scored, "p", "label", "id", [fraction]).first()
        assert models.fold_metrics(scored, "id", fraction) == {"average_precision": m.average_precision, "lift": m.lift, "roc_auc": m.roc_auc, "top_recall": top.recall}


def test_ablation_fits_a_column_once_a_fold(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(k, f"2020-{1 + k // 50:02}-01", rnd.gauss(0, 1), rnd.gauss(5, 2), rnd.choice("ab"), float(rnd.random() < 0.4)) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, day string, x double, z double, c string, label double")
    folds, groups = [("f1", "2020-05-01", "2020-07-01"), ("f2", "2020-07-01", "2020-09-01")], {"a": (["x"], []), "b": ([], ["c"]), "d": (["z"], [])}
    fitted, fit = [], models.fit_preprocess
    monkeypatch.setattr(models, "fit_preprocess", lambda *a: fitted.append(a[1:]) or fit(*a))
    candidate = models.Candidate("plain", "logistic", {"regParam": 0.01})
    got = models.ablation(df, "day", "id", folds, groups, candidate)
    assert len(fitted) == len(folds) and [g["features"] for g in got] == [1, 2, 3]
    for g, (numeric, kinds) in zip(got, ((["x"], []), (["x"], ["c"]), (["x", "z"], ["c"])), strict=True):
        found = []
        for _, start, stop in folds:
            train, check = df.filter(F.col("day") < start), df.filter((F.col("day") >= start) & (F.col("day") < stop))
            prep = fit(train, numeric, kinds)
            found.append(models.fold_metrics(models.score(models.fit(candidate, prep.apply(train)), prep.apply(check)).select("id", "p", "label"), "id"))
        assert {k: g[k] for k in ("roc_auc", "average_precision", "stability")} == pytest.approx({k: models.summary(found)[k] for k in ("roc_auc", "average_precision", "stability")}, abs=1e-6)


@pytest.mark.parametrize("bracket", [2e-4, -0.1])
def test_statistics_shuffle_the_middle_alone(spark, monkeypatch, bracket):
    """A sketch that misses the middle (here: its sides are the wrong way round) is widened."""
    monkeypatch.setattr(models, "BRACKET", bracket)
    rnd = np.random.default_rng(1)
    columns = {"wide": rnd.normal(size=5000), "flat": np.full(5000, 3.0), "few": rnd.integers(0, 4, 5000).astype(float)}
    columns["gaps"] = np.where(rnd.random(5000) < 0.4, np.nan, columns["wide"])
    df = spark.createDataFrame(list(zip(*[map(float, v) for v in columns.values()], strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(4)
    got = models._numeric_statistics(df, list(columns))
    for c, v in columns.items():
        median = np.nanmedian(v)
        filled = np.where(np.isnan(v), median, v)
        assert got[c] == pytest.approx((median, filled.mean(), filled.std() or 1.0), abs=1e-9)


def test_cuts_are_rows_of_one_day(spark, monkeypatch):
    rnd = random.Random(9)
    start = datetime(2020, 1, 1)
    rows = [(k, None if k % 29 == 0 else start + timedelta(days=rnd.randrange(9), hours=rnd.randrange(3))) for k in range(300)]
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or start, r[0]))
    asked, numbered = [], ranking.numbered
    monkeypatch.setattr(ranking, "numbered", lambda df, *a, **k: asked.append(df.count()) or numbered(df, *a, **k))
    df = spark.createDataFrame(rows, "id int, ts timestamp").repartition(3)
    for cuts in ((0.7, 0.85), (0.0, 0.02), (0.5, 1.0)):
        got = {r.id: r.split for r in order_queries.chronological(df, "ts", "id", cuts).collect()}
        a, b = (int(300 * c) for c in cuts)
        assert got == {r[0]: "train" if k < a else "validation" if k < b else "test" for k, r in enumerate(order)}
    assert max(asked) < 60
    assert order_queries.chronological(df.limit(0), "ts", "id").count() == 0
