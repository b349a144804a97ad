"""Hard negatives of anchor vectors: rows of other labels that score nearly as high as a positive.

Vectors are whole numbers, floor(256 x), and a score is their inner product. Each row is stored with its norm and its
angles to a few reference directions. The angle between an anchor and a row is at least the difference of their angles
to any reference and at most the sum (or what the sum lacks to a full turn): a cosine interval, which times the norms,
rounded outwards, bounds the score. Positives are sought among the rows of the anchor's label whose upper bound reaches
the fifth best lower bound; negatives among the rows of other labels whose bounds overlap the window of a positive, and
there those that reach the fifth best bound which lies inside for sure. Only these pairs are scored, in whole numbers.

Rows are dealt into groups of bounded size by a hash, anchors too, and each pair of groups is a task's work: the stated
anchors against all rows, in blocks. A task passes on five rows for an anchor or window. The references come from a
sample of at most SAMPLE rows; they decide how much is pruned and never what is found.

Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors shorter than the longest
count as filled up with zeros. A null vec_id is no anchor, and the largest among equal scores. Other rows than the
anchor are those of another vec_id; rows that repeat a vec_id are rows of their own, but equal anchors are one.
Scores beyond 62 bits are refused with an error. Extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import LAST_ID, stage

K = 5
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
REFERENCES, SAMPLE = 16, 2000
#: Components of a group of rows and of a group of anchors, and the least number of groups of rows.
GROUP_VALUES, ANCHOR_VALUES, LEAST_GROUPS = 1_000_000, 130_000, 32
#: Pairs that are bounded at once.
PAIRS = 2_000_000
#: Angles near 0 and half a turn are known to about 1.5e-7, since the arc cosine is steep there.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
EXACT, MOST = 2.0**53, 2.0**62


def directions(sample: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """n unit vectors far from each other: the mean direction, then each time the row with the least cosine to those before."""
    norms = np.linalg.norm(sample, axis=1, keepdims=True)
    unit = (sample / np.where(norms > 0, norms, 1))[norms[:, 0] > 0]
    out = np.zeros((n, sample.shape[1]))
    if len(unit):
        mean = unit.mean(0)
        out[0] = mean / size if (size := np.linalg.norm(mean)) > 1e-9 else unit[0]
        nearest = unit @ out[0]
        for k in range(1, n):
            out[k] = unit[np.argmin(nearest)]
            nearest = np.maximum(nearest, unit @ out[k])
    return out


def angles(v: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((v @ references.T) / np.where(norms > 0, norms, 1)[:, None], -1, 1))


def bounds(a_angles: np.ndarray, a_norms: np.ndarray, v_angles: np.ndarray, v_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible scores of each anchor (rows) with each vector (columns)."""
    low, high = np.zeros((len(a_angles), len(v_angles))), np.full((len(a_angles), len(v_angles)), np.pi)
    for r in range(a_angles.shape[1]):
        a, v = a_angles[:, r, None], v_angles[None, :, r]
        np.maximum(low, np.abs(a - v), out=low)
        total = a + v
        np.minimum(high, np.minimum(total, 2 * np.pi - total), out=high)
    size = a_norms[:, None] * v_norms[None, :]
    slack = 1 + SCORE_SLACK * size
    return np.cos(np.minimum(high + ANGLE_SLACK, np.pi)) * size - slack, np.cos(np.maximum(low - ANGLE_SLACK, 0)) * size + slack


def _scores(v: np.ndarray, anchor: np.ndarray, most: float) -> np.ndarray:
    """Whole-number inner products. No partial sum exceeds the product of the norms, so doubles are exact below 2^53."""
    return (v @ anchor).astype(np.int64) if most < EXACT else v.astype(np.int64) @ anchor.astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 64 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], ~known[some], -scores[some]))[:k]]
    return np.lexsort((ids, ~known, -scores))[:k]


class _Rows:
    """The rows of a group as arrays."""

    def __init__(self, df: pd.DataFrame, width: int):
        self.v = np.frombuffer(b"".join(df["v"]), float).reshape(len(df), width)
        self.angles = np.frombuffer(b"".join(df["angles"]), float).reshape(len(df), REFERENCES)
        self.norms, self.labels = df["norm"].to_numpy(), df["label"].to_numpy()
        self.ids, self.known = df["id"].to_numpy(), df["known"].to_numpy().astype(bool)


def _chunks(n: int, width: int) -> Iterator[slice]:
    step = max(1, PAIRS // max(width, 1))
    return (slice(k, min(k + step, n)) for k in range(0, n, step))


def _positives(width: int, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        a, b = _Rows(left, width), _Rows(right, width)
        names = left["anchor"].to_numpy()
        for label in np.intersect1d(a.labels, b.labels):
            mine, theirs = np.flatnonzero(a.labels == label), np.flatnonzero(b.labels == label)
            for part in _chunks(len(mine), len(theirs)):
                some = mine[part]
                low, high = bounds(a.angles[some], a.norms[some], b.angles[theirs], b.norms[theirs])
                itself = (a.ids[some][:, None] == b.ids[theirs][None, :]) & b.known[theirs]
                low[itself] = high[itself] = -np.inf
                least = np.partition(low, len(theirs) - k, axis=1)[:, len(theirs) - k] if len(theirs) > k else np.full(len(some), -np.inf)
                for i, row in enumerate(some):
                    rows = theirs[(high[i] >= least[i]) & ~itself[i]]
                    s = _scores(b.v[rows], a.v[row], a.norms[row] * b.norms[rows].max(initial=0))
                    top = _first(s, b.ids[rows], b.known[rows], k)
                    out += zip([names[row]] * len(top), b.ids[rows[top]].tolist(), b.known[rows[top]].tolist(), s[top].tolist())
        return pd.DataFrame(out, columns=["anchor", "id", "known", "score"]).astype({"id": "int64", "known": "bool", "score": "int64"})

    return run


def window(positive_score: int) -> tuple[int, int]:
    """The least and greatest negative score with 80 p <= 100 n <= 100 p; none if p is below 0."""
    return -(-4 * positive_score // 5), positive_score


def _negatives(width: int, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        a, b = _Rows(left, width), _Rows(right, width)
        names, windows = left["anchor"].to_numpy(), left["positive_scores"].tolist()
        for part in _chunks(len(left), len(right)):
            low, high = bounds(a.angles[part], a.norms[part], b.angles, b.norms)
            other = a.labels[part, None] != b.labels[None, :]
            for i, row in enumerate(range(part.start, part.stop)):
                near = np.zeros(len(right), bool)
                for p in set(windows[row]):
                    least, most = window(int(p))
                    inside = np.sort(low[i][other[i] & (low[i] >= least) & (high[i] <= most)])
                    near |= (high[i] >= (max(least, inside[-k]) if len(inside) >= k else least)) & (low[i] <= most)
                rows = np.flatnonzero(near & other[i])
                if not len(rows):
                    continue
                s = _scores(b.v[rows], a.v[row], a.norms[row] * b.norms[rows].max())
                for place, p in enumerate(windows[row], 1):
                    least, most = window(int(p))
                    fit = np.flatnonzero((s >= least) & (s <= most))
                    top = fit[_first(s[fit], b.ids[rows[fit]], b.known[rows[fit]], k)]
                    out += zip([names[row]] * len(top), [place] * len(top), b.ids[rows[top]].tolist(), b.known[rows[top]].tolist(), s[top].tolist())
        return pd.DataFrame(out, columns=["anchor", "place", "id", "known", "score"]).astype({"place": "int32", "id": "int64", "known": "bool", "score": "int64"})

    return run


def _ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("known"), "id")
    return df.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def _vectors(rows: DataFrame, width: int, references: np.ndarray | None) -> DataFrame:
    """rows (…, embedding) with v (whole numbers as doubles, in binary), and with references norm and angles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = pc.list_value_length(lists).to_numpy()
            v = np.zeros((len(batch), width))
            row = np.repeat(np.arange(len(batch)), sizes)
            v[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False).astype(float))
            rest = batch.drop_columns(["embedding"])
            new = {"v": pa.array([x.tobytes() for x in v], pa.binary())}
            if references is not None:
                norms = np.sqrt((v * v).sum(1))
                if len(v) and norms.max() ** 2 >= MOST:
                    raise ValueError("scores need more than 62 bits")
                new |= {"norm": pa.array(norms), "angles": pa.array([x.tobytes() for x in angles(v, norms, references)], pa.binary())}
            yield pa.RecordBatch.from_arrays([*rest.columns, *new.values()], [*rest.schema.names, *new])

    own = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "embedding")
    return rows.mapInArrow(run, own + ", v binary" + (", norm double, angles binary" if references is not None else ""))


def relabelled(every: int = RELABEL_EVERY, labels: int = LABELS) -> Column:
    """The label, moved on by one where vec_id is divisible by `every`."""
    label = F.col("label").cast("long")
    return F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label)


def mine(rows: DataFrame, k: int = K, anchor_every: int = ANCHOR_EVERY) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding).

    Anchors are rows whose vec_id is divisible by anchor_every; each has its k best positives and each of those its k
    best negatives within 0.8 to 1.0 of the positive's score.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    valid = valid.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.col("vec_id").isNotNull().alias("known"), F.col("label").cast("long").alias("label"), F.col("embedding"))
    size = valid.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0)), F.count_if(F.col("known") & (F.col("id") % anchor_every == 0))).first()
    total, width, n_anchors = size[0], max(size[1], 1), size[2]
    sample = _vectors(valid.orderBy(F.xxhash64("id", "embedding")).limit(SAMPLE).select("id", "embedding"), width, None).toPandas()
    references = directions(np.frombuffer(b"".join(sample["v"]), float).reshape(len(sample), width))
    groups, anchor_groups = max(LEAST_GROUPS, -(-total * width // GROUP_VALUES)), -(-n_anchors * width // ANCHOR_VALUES) or 1
    ready = stage(_vectors(valid, width, references).withColumn("g", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int")), "negatives-rows")
    anchor = F.md5(F.concat(F.concat_ws(":", F.col("id").cast("string"), F.col("label").cast("string")).cast("binary"), F.col("v")))
    anchors = ready.filter(F.col("known") & (F.col("id") % anchor_every == 0)).withColumn("anchor", anchor).dropDuplicates(["anchor"])
    anchors = stage(anchors.drop("g").withColumn("a", F.pmod(F.xxhash64("anchor"), F.lit(anchor_groups)).cast("int")), "negatives-anchors")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    theirs = ready.withColumn("a", each(anchor_groups)).groupBy("a", "g")
    pairs = lambda left, run, kind: left.withColumn("g", each(groups)).groupBy("a", "g").cogroup(theirs).applyInPandas(run, kind)
    found = pairs(anchors, _positives(width, k), "anchor string, id long, known boolean, score long")
    positives = stage(_ranked(found, ["anchor"], k).withColumnRenamed("nth", "place"), "negatives-positives")
    # windows below 0 are empty; places stay those among all positives of the anchor, as windows come after one another
    scores = positives.filter("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p")).select("anchor", F.col("p.score").alias("positive_scores"))
    found = pairs(anchors.join(scores, "anchor"), _negatives(width, k), "anchor string, place int, id long, known boolean, score long")
    named = positives.select("anchor", "place", F.when(F.col("known"), F.col("id")).alias("positive_id"), F.col("score").alias("positive_score"))
    out = _ranked(found, ["anchor", "place"], k).select("anchor", "place", F.col("nth").alias("rank"), F.when(F.col("known"), F.col("id")).alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return out.join(named, ["anchor", "place"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
