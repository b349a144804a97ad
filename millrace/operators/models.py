"""Models over feature tables: preprocessing, expanding folds, search with a locked winner, ablation, calibration, scoring.

Parameters are fitted by Spark jobs and are small; applying them is a projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from itertools import product

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import ranking
from millrace.sources.commits import Store
from millrace.sources.shared import stage

#: A category with fewer rows has no slot of its own.
LEAST_ROWS = 5
SCALE_FLOOR = 1e-12
#: Slots of one column at most: they are collected, and each is a coefficient.
MOST_SLOTS = 1000


@dataclass(frozen=True)
class Preprocess:
    """Medians, means and deviations of numbers; modes and slots of categories."""

    numeric: dict[str, tuple[float, float, float]]
    categories: dict[str, tuple[str, list[str]]]

    def slots(self) -> list[str]:
        return [*self.numeric, *[f"{c}={v}" for c, (_, values) in self.categories.items() for v in values]]

    def values(self) -> list[Column]:
        """Missing numbers are medians, all are scaled; missing categories are modes, unknown ones have no slot."""
        numbers = [(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(med)) - mean) / (sd or 1.0) for c, (med, mean, sd) in self.numeric.items()]
        return [*numbers, *[(F.coalesce(c, F.lit(mode)) == v).cast("double") for c, (mode, values) in self.categories.items() for v in values]]

    def only(self, numeric: list[str], categories: list[str]) -> Preprocess:
        """What would have been fitted for some of the columns: each one's parameters are its own."""
        return Preprocess({c: self.numeric[c] for c in numeric}, {c: self.categories[c] for c in categories})

    def apply(self, df: DataFrame, out: str = "features") -> DataFrame:
        return df.withColumn(out, array_to_vector(F.array(*self.values())))


def _number(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None))


#: Half the width, in shares of the rows, of what is looked through for a middle rank, and one part of it that a sketch may err by.
BRACKET, SKETCH = 2e-4, 10_000


def _numeric_statistics(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """(median, mean, deviation) of all columns after missing values were filled with the median.

    Rows are not shuffled: one reading gives numbers, means and, by a sketch, two values with the middle ranks between
    them; another one how many values lie below and the spread. Of the values between, a few in ten thousand besides
    repeated ones, the exact ranks are found. A sketch that has missed them is widened to all values.
    """
    at = dict(zip(columns, (f"c{k}" for k in range(len(columns))), strict=True))
    rows = train.select(*[_number(c).alias(x) for c, x in at.items()])
    sides = F.array(F.lit(0.5 - BRACKET), F.lit(0.5 + BRACKET))
    first = rows.agg(F.count(F.lit(1)).alias("rows"), *[y for x in at.values() for y in (F.count(x).alias(f"{x}_n"), F.avg(x).alias(f"{x}_mean"), F.percentile_approx(x, sides, F.lit(SKETCH)).alias(f"{x}_q"))]).first()
    known = {c: x for c, x in at.items() if first[f"{x}_n"]}
    out = {c: (0.0, 0.0, 1.0) for c in columns}
    if not known:
        return out
    spread = lambda x: (F.col(x) - F.lit(first[f"{x}_mean"])) * (F.col(x) - F.lit(first[f"{x}_mean"]))
    second = rows.agg(*[y for x in known.values() for y in (F.count_if(F.col(x) < F.lit(first[f"{x}_q"][0])).alias(f"{x}_below"), F.count_if(F.col(x) <= F.lit(first[f"{x}_q"][1])).alias(f"{x}_upto"), F.sum(spread(x)).alias(f"{x}_spread"))]).first()
    between, ranks = [], {}
    for x in known.values():
        n, below, (low, high) = first[f"{x}_n"], second[f"{x}_below"], first[f"{x}_q"]
        middle = {(n - 1) // 2, n // 2}
        if not all(below <= r < second[f"{x}_upto"] for r in middle):
            below, low, high = 0, float("-inf"), float("inf")
        ranks[x] = sorted(r - below for r in middle)
        between.append(F.when(F.col(x).between(F.lit(low), F.lit(high)), F.struct(F.lit(x).alias("c"), F.col(x).alias("v"))))
    long = rows.select(F.explode(F.filter(F.array(*between), lambda s: s.isNotNull())).alias("x")).select("x.*")
    per = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("c").orderBy("v")))
    wanted = F.create_map(*[y for x, rs in ranks.items() for y in (F.lit(x), F.array(*[F.lit(r).cast("long") for r in rs]))])
    hit = F.exists(F.element_at(wanted, F.col("c")), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    middles: dict[str, list[float]] = {}
    for r in per.filter(hit).select("c", "v").collect():  # two values of a column at most
        middles.setdefault(r["c"], []).append(r["v"])
    for c, x in known.items():
        n, mean, median = first[f"{x}_n"], first[f"{x}_mean"], sum(middles[x]) / len(middles[x])
        missing = first["rows"] - n
        filled = (n * mean + missing * median) / (n + missing)
        deviation = ((second[f"{x}_spread"] + n * (mean - filled) ** 2 + missing * (median - filled) ** 2) / (n + missing)) ** 0.5
        out[c] = (median, filled, deviation if deviation > SCALE_FLOOR else 1.0)
    return out


def _categories(train: DataFrame, columns: list[str], least: int) -> dict[str, tuple[str, list[str]]]:
    """(mode, values with a slot) of all columns, from one frame of (column, value, number)."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("v").isNotNull()
    first = F.min(F.when(known, F.struct((-F.col("n")).alias("n"), "v"))).over(Window.partitionBy("c"))["v"]
    missing = F.coalesce(F.sum(F.when(~known, F.col("n"))).over(Window.partitionBy("c")), F.lit(0))
    rows = counts.withColumns({"mode": first, "missing": missing}).filter(known)
    rows = rows.withColumn("n", F.col("n") + F.when(F.col("v") == F.col("mode"), F.col("missing")).otherwise(0))
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "v"))
    kept = rows.withColumn("place", place).filter((F.col("place") <= MOST_SLOTS) & ((F.col("n") >= least) | (F.col("v") == F.col("mode")))).collect()
    out: dict[str, tuple[str, list[str]]] = {c: ("", []) for c in columns}
    for c in columns:
        own = [r for r in kept if r["c"] == c]
        if own:
            out[c] = (own[0]["mode"], sorted(r["v"] for r in own if r["n"] >= least))
    return out


def fit_preprocess(train: DataFrame, numeric: list[str], categories: list[str], least: int = LEAST_ROWS) -> Preprocess:
    """Fitted on the training rows alone. Deviations are those of the population, after missing values were filled.

    A category has a slot if it has `least` rows and is among the MOST_SLOTS most frequent ones of its column.
    """
    return Preprocess(_numeric_statistics(train, numeric) if numeric else {}, _categories(train, categories, least) if categories else {})


@dataclass(frozen=True)
class Candidate:
    name: str
    family: str  # logistic or boosted
    parameters: dict = field(default_factory=dict)


def fit(candidate: Candidate, train: DataFrame):
    if candidate.family == "logistic":
        return LogisticRegression(**candidate.parameters).fit(train)
    if candidate.family == "boosted":
        return GBTClassifier(seed=42, **candidate.parameters).fit(train)
    raise ValueError(f"no such family: {candidate.family}")


def score(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1])


def fold_metrics(scored: DataFrame, tie: str, fraction: float = 0.1) -> dict[str, float]:
    """Average precision, its lift, ROC-AUC, and the share of positives among the best tenth of scores."""
    curve = stage(ranking.score_curve(scored, "p", "label"), "curve")
    m = ranking.curve_metrics(curve).first()
    return {"average_precision": m["average_precision"], "lift": m["lift"], "roc_auc": m["roc_auc"], "top_recall": ranking.curve_recall(curve, scored, "p", "label", tie, fraction) or 0.0}


def summary(folds: list[dict[str, float]]) -> dict[str, float]:
    """Means, and stability: the mean of top_recall less its deviation (of the population)."""
    mean = {k: sum(f[k] for f in folds) / len(folds) for k in folds[0]}
    spread = (sum((f["top_recall"] - mean["top_recall"]) ** 2 for f in folds) / len(folds)) ** 0.5
    return mean | {"stability": mean["top_recall"] - spread}


def _best(found: list[dict]) -> dict:
    return max(found, key=lambda r: (r["stability"], r["lift"], r["roc_auc"]))


Fold = tuple[str, str, str]  # name, first day of validation, first day after it


def _folds(rows: DataFrame, day: str, folds: list[Fold], numeric: list[str], categories: list[str]):
    """Per fold: what is fitted on the rows before it, these rows to train on, and rows in it to validate."""
    for _, start, stop in folds:
        train, check = rows.filter(F.col(day) < start), rows.filter((F.col(day) >= start) & (F.col(day) < stop))
        yield fit_preprocess(train, numeric, categories), train, check


#: Weights of a family in a blend.
STEPS = (0.0, 0.25, 0.5, 0.75, 1.0)


def blend_weights(families: list[str]) -> list[dict[str, float]]:
    """Weights that add up to 1, of at least two families."""
    return [dict(zip(families, w, strict=True)) for w in product(STEPS, repeat=len(families)) if sum(w) == 1 and sum(x > 0 for x in w) > 1]


def blends(found: list[dict], scored: dict[str, list[DataFrame]], tie: str) -> list[dict]:
    """Metrics of rank blends of the families' winners; scored has each candidate's rows (tie, p, label) per fold.

    A winner's rows are numbered once per fold, whatever the number of weights.
    """
    winners = {family: _best([r for r in found if r["family"] == family])["name"] for family in sorted({r["family"] for r in found})}
    sets = blend_weights(list(winners))
    metrics: list[list[dict[str, float]]] = [[] for _ in sets]
    for k in range(len(next(iter(scored.values()), [])) if sets else 0):
        ranked = None
        for family, name in winners.items():
            one = ranking.rank_fraction(scored[name][k], "p", tie).select(tie, "label", F.col("rank_fraction").alias(f"r_{family}"))
            ranked = one if ranked is None else ranked.join(one.drop("label"), tie)
        ranked = stage(ranked, "blend-ranks")
        for m, weights in zip(metrics, sets, strict=True):
            p = sum((F.col(f"r_{family}") * w for family, w in weights.items() if w), F.lit(0.0))
            m.append(fold_metrics(ranked.select(tie, "label", p.alias("p")), tie))
    name = lambda weights: "rank-blend-" + "-".join(f"{family}{w:.2f}" for family, w in weights.items() if w)
    return [{"name": name(w), "family": "rank_blend", "parameters": {"weights": w, "components": winners}} | summary(m) for w, m in zip(sets, metrics, strict=True)]


def search(rows: DataFrame, day: str, tie: str, folds: list[Fold], numeric: list[str], categories: list[str], candidates: list[Candidate]) -> tuple[list[dict], dict]:
    """(metrics of every candidate and of rank blends of the families' winners, the locked winner). rows (tie, day, label
    and the features); validation rows are never trained on, and rows from the last fold's end on are not looked at."""
    metrics: dict[str, list[dict[str, float]]] = {c.name: [] for c in candidates}
    scored: dict[str, list[DataFrame]] = {c.name: [] for c in candidates}
    for fitted, train, check in _folds(rows, day, folds, numeric, categories):
        train, check = stage(fitted.apply(train).select("features", "label"), "fold-train"), fitted.apply(check).select(tie, "features", "label")
        for c in candidates:
            scored[c.name].append(stage(score(fit(c, train), check).select(tie, "p", "label"), "scored"))
            metrics[c.name].append(fold_metrics(scored[c.name][-1], tie))
    found = [asdict(c) | summary(metrics[c.name]) for c in candidates]
    found += blends(found, scored, tie)
    best = _best(found)
    return found, {"selected": best["name"], "family": best["family"], "parameters": best["parameters"], "features": [*numeric, *categories], "folds": [list(f) for f in folds], "metric": "mean(top_recall) - std(top_recall)", "final_rows_seen": False}


def ablation(rows: DataFrame, day: str, tie: str, folds: list[Fold], groups: dict[str, tuple[list[str], list[str]]], candidate: Candidate) -> list[dict]:
    """Metrics of one candidate as groups of (numeric, categorical) features are added in turn.

    A column's preprocessing does not depend on the others, so that of all columns is fitted once a fold.
    """
    steps: dict[str, tuple[list[str], list[str]]] = {}
    numeric: list[str] = []
    categories: list[str] = []
    for group, (more, more_categories) in groups.items():
        numeric, categories = [*numeric, *more], [*categories, *more_categories]
        steps[group] = numeric, categories
    found: dict[str, list[dict[str, float]]] = {group: [] for group in groups}
    for fitted, train, check in _folds(rows, day, folds, numeric, categories):
        for group, own in steps.items():
            some = fitted.only(*own)
            model = fit(candidate, some.apply(train).select("features", "label"))
            scored = stage(score(model, some.apply(check).select(tie, "features", "label")).select(tie, "p", "label"), "scored")
            found[group].append(fold_metrics(scored, tie))
    return [{"stage": group, "features": sum(map(len, own))} | summary(found[group]) for group, own in steps.items()]


def losses(p: Column, y: Column) -> list[Column]:
    q = F.greatest(F.least(p, F.lit(1 - 1e-8)), F.lit(1e-8))
    return [F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss")]


def _platt(rows: DataFrame) -> dict:
    model = LogisticRegression(regParam=0.0, maxIter=100).fit(VectorAssembler(inputCols=["score"], outputCol="features").transform(rows))
    return {"type": "platt", "slope": float(model.coefficients[0]), "intercept": float(model.intercept)}


def _isotonic(rows: DataFrame) -> dict:
    model = IsotonicRegression(featuresCol="score", labelCol="label").fit(rows)
    return {"type": "isotonic", "x": [float(v) for v in model.boundaries], "y": [float(v) for v in model.predictions]}


_FIT: dict[str, Callable[[DataFrame], dict]] = {"identity": lambda rows: {"type": "identity"}, "platt": _platt, "isotonic": _isotonic}


def calibrated(parameters: dict, score: str = "score") -> Column:
    """Probability of a raw score (log odds)."""
    if parameters["type"] == "platt":
        return C.sigmoid(F.col(score) * parameters["slope"] + parameters["intercept"])
    if parameters["type"] == "isotonic":
        return C.interpolate(score, parameters["x"], parameters["y"])
    return C.sigmoid(score)


def choose_calibration(rows: DataFrame, order: list[str], share: float = 0.6) -> tuple[dict, list[dict]]:
    """(parameters, losses of each method) from rows (score, label and order columns).

    Methods are fitted on the earliest `share` of rows and compared on the rest by Brier score, then log loss; the best
    one is fitted again on all rows.
    """
    placed = stage(ranking.numbered(rows, *order).select("score", F.col("label").cast("double").alias("label"), "position"), "calibration")
    cut = int(placed.count() * share)
    early, late = placed.filter(F.col("position") < cut), placed.filter(F.col("position") >= cut)
    found = []
    for name, method in _FIT.items():
        r = late.agg(*losses(calibrated(method(early)), F.col("label"))).first()
        found.append({"method": name, "brier": r["brier"], "log_loss": r["log_loss"]})
    best = min(found, key=lambda x: (x["brier"], x["log_loss"]))
    return _FIT[best["method"]](placed), found


def sensitivity(prep: Preprocess, coefficients: list[float], intercept: float, groups: dict[str, list[str]], top: int = 3) -> Column:
    """Per row the `top` groups of columns whose reset to the reference row (medians and modes) changes the probability
    most: array<struct<factor, change>>, changes in points of 100."""
    weight = dict(zip(prep.slots(), coefficients, strict=True))
    terms = {slot: v * weight[slot] for slot, v in zip(prep.slots(), prep.values(), strict=True)}
    at = {c: F.lit((med - mean) / (sd or 1.0) * weight[c]) for c, (med, mean, sd) in prep.numeric.items()}
    at |= {f"{c}={v}": F.lit(weight[f"{c}={v}"] * (v == mode)) for c, (mode, values) in prep.categories.items() for v in values}
    slots = {c: [c] if c in prep.numeric else [f"{c}={v}" for v in prep.categories[c][1]] for c in [*prep.numeric, *prep.categories]}
    moved = [sum((terms[s] - at[s] for c in columns for s in slots[c]), F.lit(0.0)) for columns in groups.values()]
    # bound once a row: each group's effect uses the sum of all terms
    sums = F.array(F.array(sum(terms.values(), F.lit(intercept)), *moved))

    def best(x: Column) -> Column:
        changes = [(name, F.round(100 * (C.sigmoid(x[0]) - C.sigmoid(x[0] - x[k])), 4)) for k, name in enumerate(groups, 1)]
        effects = F.array(*[F.struct((-F.abs(change)).alias("size"), F.lit(name).alias("factor"), change.alias("change")) for name, change in changes])
        return F.transform(F.slice(F.array_sort(effects), 1, top), lambda y: F.struct(y["factor"].alias("factor"), y["change"].alias("change")))

    return F.transform(sums, best)[0]


VERSION = 1
#: Rows with their scores that an artefact carries, and how far a score may be from its own.
PARITY_ROWS, PARITY = 100, 1e-12


@dataclass(frozen=True)
class Artefact:
    """All that scoring needs: preprocessing, a linear model, its calibration, and daily totals of histories."""

    prep: Preprocess
    coefficients: list[float]
    intercept: float
    calibration: dict
    histories: DataFrame | None = None

    def logit(self) -> Column:
        return sum((v * w for v, w in zip(self.prep.values(), self.coefficients, strict=True)), F.lit(self.intercept))

    def score(self, rows: DataFrame, out: str = "probability") -> DataFrame:
        return rows.withColumn("__logit", self.logit()).withColumn(out, calibrated(self.calibration, "__logit")).drop("__logit")


def export(artefact: Artefact, rows: DataFrame, key: str, root: str) -> int:
    """Writes an artefact as one commit of a store: parameters, histories, and some rows (the first by key) with their
    scores. Returns its number; earlier ones stay readable as long as the store keeps them."""
    columns = [*artefact.prep.numeric, *artefact.prep.categories]
    some = artefact.score(rows.orderBy(key).limit(PARITY_ROWS).select(key, *columns))
    parameters = {"version": VERSION, "numeric": {c: list(v) for c, v in artefact.prep.numeric.items()}, "categories": {c: [m, v] for c, (m, v) in artefact.prep.categories.items()}, "coefficients": list(map(float, artefact.coefficients)), "intercept": float(artefact.intercept), "calibration": artefact.calibration}
    store = Store(rows.sparkSession, root)
    with store.transaction() as t:
        t.replace("parity", some)
        if artefact.histories is not None:
            t.replace("histories", artefact.histories)
        t.note("parity", "model", parameters)
    return store.state()[0]


def load(spark: SparkSession, root: str, number: int | None = None) -> Artefact:
    """An exported artefact, the newest by default; refused if its own rows do not get the scores that they came with."""
    store = Store(spark, root)
    number, tables = store.state(number)
    model = tables["parity"]["notes"]["model"]
    if model["version"] != VERSION:
        raise ValueError(f"the artefact has version {model['version']}, not {VERSION}")
    prep = Preprocess({c: tuple(v) for c, v in model["numeric"].items()}, {c: (m, v) for c, (m, v) in model["categories"].items()})
    out = Artefact(prep, model["coefficients"], model["intercept"], model["calibration"], store.read("histories", number=number) if "histories" in tables else None)
    far = out.score(store.read("parity", number=number), "again").filter(~(F.abs(F.col("again") - F.col("probability")) <= PARITY) | (F.col("again").isNull() != F.col("probability").isNull())).count()
    if far:
        raise ValueError(f"{far} rows are not scored as they were when the artefact was written")
    return out
