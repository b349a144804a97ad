"""Global ranks and ranking metrics without a single sorting task.

A global running sum is taken over rows that are few by construction: distinct scores, days or partitions. Where
rows themselves need a number, they are dealt by ranges, numbered inside each range, and the ranges' totals give
the offsets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import stage


def numbered(df: DataFrame, *order: str, descending: bool = False, name: str = "position") -> DataFrame:
    """df with its 0-based place in a total order, from range partitions: each is sorted by itself, and the counts of
    those before it, one row per partition, are its offset."""
    keys = [F.col(c).desc() if descending and k == 0 else F.col(c).asc() for k, c in enumerate(order)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: a second run of the same plan may draw other range bounds
    parts = stage(df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))  # as many rows as partitions
    return parts.withColumn("__in", inside).join(offsets, "__part").withColumn(name, F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")


def quantiles(df: DataFrame, column: str, probabilities: list[float]) -> DataFrame:
    """One row, q array<double>: exact quantiles, linear between neighbouring ranks; nulls and NaN do not count.

    Distinct values are counted first and dealt by ranges; a range's total tells which of the ranks asked for lie in
    it, so no task holds more than its own range. Without values q is null.
    """
    value = F.col(column).cast("double")
    per = df.select(value.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(per.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "values")
    sums = dealt.groupBy("part").agg(F.sum("n").alias("t"))
    total = int(sums.agg(F.sum("t")).first()[0] or 0)
    places = [p * max(total - 1, 0) for p in probabilities]
    ranks = sorted({int(x) for x in places} | {min(int(x) + 1, max(total - 1, 0)) for x in places})
    before = F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    offsets = sums.select("part", before, "t").withColumn("ranks", F.filter(F.array(*[F.lit(r).cast("long") for r in ranks]), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("t")))).filter(F.size("ranks") > 0)
    rows = dealt.join(F.broadcast(offsets), "part")  # a row for each partition at most
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v")) + F.col("before")
    hit = rows.withColumn("upto", upto).select("v", F.explode(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).alias("rank"))
    found = hit.agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # as many as ranks were asked for
    at = lambda r: F.element_at("at", F.lit(r).cast("long"))
    q = F.array(*[at(int(x)) + (at(min(int(x) + 1, max(total - 1, 0))) - at(int(x))) * (x - int(x)) for x in places])
    return found.select((q if total else F.lit(None).cast("array<double>")).alias("q"))


def rank_fraction(df: DataFrame, score: str, tie: str) -> DataFrame:
    """(rank - 1) / max(n - 1, 1), ties in order of `tie`."""
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("__total")))
    out = numbered(df, score, tie).crossJoin(total)
    return out.withColumn("rank_fraction", F.col("position") / F.greatest(F.col("__total") - 1, F.lit(1))).drop("__total", "position")


def top_capture(df: DataFrame, score: str, label: str, tie: str, fractions: list[float]) -> DataFrame:
    """Of the ceil(n * fraction) best scores: positives found, false warnings, precision, recall."""
    ranked = numbered(df, score, tie, descending=True).select("position", F.col(label).cast("int").alias("y"))
    totals = F.broadcast(df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("positives")))
    cuts = F.broadcast(df.sparkSession.createDataFrame([(f,) for f in fractions], "fraction double"))
    rows = ranked.crossJoin(totals).crossJoin(cuts).filter(F.col("position") < F.ceil(F.col("n") * F.col("fraction")))
    out = rows.groupBy("fraction", "n", "positives").agg(F.count(F.lit(1)).alias("taken"), F.sum("y").alias("found"))
    return out.withColumns({"false_warnings": F.col("taken") - F.col("found"), "precision": F.round(F.col("found") / F.col("taken"), 6), "recall": F.round(F.try_divide(F.col("found").cast("double"), F.col("positives").cast("double")), 6)})


def score_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score: positives and negatives there, and from the best score down to it."""
    per = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("tp"), F.sum(1 - F.col(label).cast("long")).alias("fp"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stage(per.repartitionByRange(n, F.col("score").desc()).withColumn("part", F.spark_partition_id()), "scores")
    inside = Window.partitionBy("part").orderBy(F.col("score").desc())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("part").agg(F.sum("tp").alias("t"), F.sum("fp").alias("f"))
    offsets = F.broadcast(sums.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0")))
    return parts.join(offsets, "part").select("score", "tp", "fp", (F.sum("tp").over(inside) + F.col("t0")).alias("cum_tp"), (F.sum("fp").over(inside) + F.col("f0")).alias("cum_fp"))


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """Average precision in its step form, lift over prevalence, and ROC-AUC in which ties count half."""
    return curve_metrics(score_curve(df, score, label), df.agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n")))


def curve_metrics(curve: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """ranking_metrics of a score_curve; totals (p, n) are the curve's own unless they are given."""
    totals = curve.agg(F.sum("tp").alias("p"), F.sum("fp").alias("n")) if totals is None else totals
    c = curve.crossJoin(F.broadcast(totals))
    precision = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    pairs = F.col("tp").cast("double") * (F.col("n") - F.col("cum_fp")) + F.col("tp").cast("double") * F.col("fp") / 2
    out = c.groupBy("p", "n").agg(F.sum(F.col("tp") / F.col("p") * precision).alias("ap"), (F.sum(pairs) / (F.col("p").cast("double") * F.col("n"))).alias("auc"))
    return out.select(F.col("p").alias("positives"), F.col("n").alias("negatives"), F.round("ap", 6).alias("average_precision"), F.round(F.col("ap") / (F.col("p") / (F.col("p") + F.col("n"))), 6).alias("lift"), F.round("auc", 6).alias("roc_auc"))


def curve_recall(curve: DataFrame, df: DataFrame, score: str, label: str, tie: str, fraction: float) -> float | None:
    """The recall of top_capture from a score_curve of df, whose labels are known: only rows of the score at which the
    best ones end are put in order of `tie`."""
    rows, positives = curve.agg(F.sum(F.col("tp") + F.col("fp")), F.sum("tp")).first()
    if not positives:
        return None
    wanted = math.ceil(rows * fraction)
    here = F.max_by(F.struct("score", "tp", "fp", "cum_tp", "cum_fp"), "score")
    last = curve.filter(F.col("cum_tp") + F.col("cum_fp") >= wanted).agg(here.alias("x")).first()["x"]
    found, left = last["cum_tp"], last["cum_tp"] + last["cum_fp"] - wanted
    if left:
        at = numbered(df.filter(F.col(score) == F.lit(last["score"])).select(tie, F.col(label).cast("long").alias("y")), tie)
        found -= last["tp"] - (at.filter(F.col("position") < last["tp"] + last["fp"] - left).agg(F.sum("y")).first()[0] or 0)
    return round(found / positives, 6)


def poisson_weight(key: Column, rep: Column) -> Column:
    """How often a row is drawn in a replicate: Poisson with mean 1 (4 stands for all above 3), from a hash of both, so that any task can draw it again."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), rep.cast("string"))), 1, 7), 16, 10).cast("double") / 268435456.0
    return F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.9196986, 2).when(u < 0.98101184, 3).otherwise(4)


#: Shares of draws below 1, 2, 3 and 4.
_POISSON = (0.36787944, 0.73575888, 0.9196986, 0.98101184)
#: Draws that a task holds at once, small enough for a core's cache, and sums before it passes them on.
DRAWS, DRAWN_SUMS = 16_384, 2_000_000
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a text that fit into one block of the digest together with a replicate's number.
ONE_BLOCK = 48


def _digests(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The first 28 bits of the MD5 digests of blocks of 16 words, each word an array that is spread to the shape."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    for i, shift in enumerate(_SHIFTS):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[g] + _SINES[i]
        high = f << np.uint32(shift)
        f >>= np.uint32(32 - shift)
        f |= high
        f += b
        a, b, c, d = d, f, b, c
    a += np.uint32(_START[0])
    return a.byteswap() >> np.uint32(4)


def poisson_weights(texts: list[bytes], replicates: int) -> np.ndarray:
    """poisson_weight of rows and replicates; a text is a row's key and a colon, to which the replicate's number is added."""
    h = np.empty((len(texts), replicates), np.uint32)
    lengths = np.array([len(x) for x in texts])
    numbers = [str(r).encode() for r in range(replicates)]
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        if n > ONE_BLOCK:
            for i in at:
                h[i] = [int(hashlib.md5(texts[i] + r).hexdigest()[:7], 16) for r in numbers]
            continue
        left = np.frombuffer(b"".join(texts[i].ljust(64, b"\0") for i in at), "<u4").reshape(-1, 16)
        right = np.frombuffer(b"".join((bytes(n) + r + b"\x80").ljust(56, b"\0") + (8 * (n + len(r))).item().to_bytes(8, "little") for r in numbers), "<u4").reshape(-1, 16)
        step = max(1, DRAWS // replicates)
        for k in range(0, len(at), step):
            part = left[k : k + step]
            # a word is the row's alone, the replicate's alone, or has bytes of both
            words = [part[:, j, None] if not right[:, j].any() else right[None, :, j] if not part[:, j].any() else part[:, j, None] | right[None, :, j] for j in range(16)]
            h[at[k : k + step]] = _digests(words, (len(part), replicates))
    return sum((h >= np.uint32(math.ceil(t * 2**28))).astype(np.int64) for t in _POISSON)


def _drawn(replicates: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches of (a, b, y, text): per score and distinct value the draws of positives and of negatives, as one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[str, float | None], np.ndarray] = {}

        def taken() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.float64()), pa.array([v.ravel().tolist() for v in out.values()], pa.list_(pa.float64()))], ["which", "score", "v"])
            out.clear()
            return made

        for whole in batches:
            for at in range(0, len(whole), step := max(1, DRAWN_SUMS // replicates)):
                batch = whole.slice(at, step)
                k = poisson_weights([x.encode() for x in batch.column("text").to_pylist()], replicates)
                y = batch.column("y").to_numpy(zero_copy_only=False)
                for which in ("a", "b"):
                    coded = batch.column(which).dictionary_encode()
                    values = [*coded.dictionary.to_pylist(), None]
                    codes = coded.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False)
                    for side in (1, 0):
                        rows = np.flatnonzero(y == side)
                        rows = rows[np.argsort(codes[rows], kind="stable")]
                        found, first = np.unique(codes[rows], return_index=True)
                        for code, v in zip(found, np.add.reduceat(k[rows], first) if len(rows) else (), strict=True):
                            out.setdefault((which, values[code]), np.zeros((2, replicates), np.int64))[1 - side] += v
                if len(out) * replicates > DRAWN_SUMS:
                    yield taken()
        yield taken()

    return run


def bootstrap_pairs(df: DataFrame, a: str, b: str, label: str, key: str, replicates: int = 250) -> DataFrame:
    """(rep, n, auc_a, auc_b, difference) of two scores over the same resampled rows.

    Rows are few bytes and much work, so they are dealt to all tasks, which draw the weights of all replicates as one
    array and add them up per distinct score; only these sums are shuffled, and a replicate's ranking has a row for
    each distinct score. Scores should be rounded to what tells rows apart. Rows with a null label take no part.
    """
    text = F.coalesce(F.concat(F.col(key).cast("string"), F.lit(":")), F.lit(""))
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(label).cast("int").alias("y"), text.alias("text")).filter("y is not null")
    dealt = rows.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    partial = dealt.mapInArrow(_drawn(replicates), "which string, score double, v array<double>")
    # the summarizer's sums are means times numbers: whole numbers but for rounding
    sums = stage(partial.groupBy("which", "score").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")), "draws")
    pairs = F.arrays_zip(F.slice("v", 1, replicates).alias("tp"), F.slice("v", replicates + 1, replicates).alias("fp"))
    each = sums.select("which", "score", F.posexplode(pairs).alias("rep", "x")).select("which", "score", "rep", F.round("x.tp").cast("long").alias("tp"), F.round("x.fp").cast("long").alias("fp")).filter("tp + fp > 0")
    below = F.coalesce(F.sum("fp").over(Window.partitionBy("rep", "which").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = each.withColumn("below", below).groupBy("rep").pivot("which", ["a", "b"]).agg(F.sum(F.col("tp") * F.col("below") + F.col("tp") * F.col("fp") / 2).alias("won"), F.sum("tp").alias("p"), F.sum("fp").alias("q"))
    # as doubles: the product of both numbers leaves the range of a long beyond some billions of rows
    auc = {c: F.try_divide(F.col(f"{c}_won").cast("double"), F.col(f"{c}_p").cast("double") * F.col(f"{c}_q").cast("double")) for c in ("a", "b")}
    return per.select("rep", (F.col("a_p") + F.col("a_q")).alias("n"), F.round(auc["a"], 6).alias("auc_a"), F.round(auc["b"], 6).alias("auc_b"), F.round(auc["a"] - auc["b"], 6).alias("difference"))


#: A prime over all 28-bit row hashes; replicate r draws with its own line modulo the prime.
PRIME = 2147483647
METRICS = ("ap", "lift", "auc", "capture")
#: Weights that a task holds at once, and sums before it passes them on.
PAIRS = 2_000_000


def replicate_lines(replicates: int) -> list[tuple[int, int]]:
    """(factor, offset) of each replicate, from the digest of its number."""
    digests = (hashlib.md5(str(r).encode()).hexdigest() for r in range(replicates))
    return [(1 + int(d[:7], 16), int(d[7:14], 16)) for d in digests]


def replicate_weights(rows: np.ndarray, replicates: int) -> np.ndarray:
    """How often each row (a 28-bit hash) is drawn in each replicate: Poisson counts with mean 1 (4 stands for all above 3)."""
    lines = np.array(replicate_lines(replicates), np.int64).reshape(-1, 2)
    u = (rows[:, None] * lines[:, 0] + lines[:, 1]) % PRIME / float(PRIME)
    return np.searchsorted(_POISSON, u, side="right").astype(float)


def _weighed(replicates: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches of (a, b, y, h): per score and distinct value the sums of positive and of negative weights, some batches together."""

    def sums(which: str, part: dict[str, np.ndarray], out: dict) -> None:
        order = np.argsort(part[which], kind="stable")
        scores, first = np.unique(part[which][order], return_index=True)
        y = part["y"][order, None]
        step = max(1, PAIRS // replicates)
        for at in range(0, len(order), step):
            w = replicate_weights(part["h"][order[at : at + step]], replicates)
            begins = np.flatnonzero((first >= at) & (first < at + step))
            cuts = np.unique(np.concatenate(([0], first[begins] - at)))
            v = np.add.reduceat(np.concatenate((w * y[at : at + step], w * (1 - y[at : at + step])), axis=1), cuts)
            for score, row in zip(part[which][order[at + cuts]], v, strict=True):
                key = (which, float(score))
                out[key] = out[key] + row if key in out else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[str, float], np.ndarray] = {}

        def taken() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.float64()), pa.array([v.tolist() for v in out.values()], pa.list_(pa.float64()))], ["which", "score", "v"])
            out.clear()
            return made

        for batch in batches:
            part = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "y", "h")}
            for which in ("a", "b"):
                sums(which, part, out)
            if len(out) * replicates > PAIRS:
                yield taken()
        yield taken()

    return run


def bootstrap_metrics(df: DataFrame, a: str, b: str, label: str, key: str, replicates: int = 1000, top: float = 0.1) -> DataFrame:
    """(rep, n, positives, ap_a, ap_b, lift_a, ..., capture_b): ranking metrics of two scores over the same resampled rows.

    ap is average precision in its step form, lift its ratio to the share of positives, auc counts ties half, capture
    is the share of positives among the best ceil(top * n) draws, of which equal scores have an equal share.

    Tasks add up the weights of their rows, all replicates as one array per distinct score, and only these sums are
    shuffled and ranked, each replicate by itself; scores should be rounded to what tells rows apart. Rows with a null
    label or score take no part.
    """
    row = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("long")
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(label).cast("double").alias("y"), row.alias("h")).dropna()
    partial = rows.mapInArrow(_weighed(replicates), "which string, score double, v array<double>")
    sums = stage(partial.groupBy("which", "score").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")), "replicates")
    pairs = F.arrays_zip(F.slice("v", 1, replicates).alias("tp"), F.slice("v", replicates + 1, replicates).alias("fp"))
    each = sums.select("which", "score", F.posexplode(pairs).alias("rep", "x")).select("which", "score", "rep", F.round("x.tp").alias("tp"), F.round("x.fp").alias("fp")).filter("tp + fp > 0")
    group = Window.partitionBy("rep", "which")
    order = group.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumns({"ctp": F.sum("tp").over(order), "cfp": F.sum("fp").over(order)}).withColumn("all", F.sum(F.col("tp") + F.col("fp")).over(group))
    here = F.col("tp") + F.col("fp")
    share = (F.ceil(F.col("all") * top) - (F.col("ctp") + F.col("cfp") - here)) / here
    p, n = F.sum("tp"), F.sum("fp")
    ap = F.try_divide(F.sum(F.col("tp") * F.col("ctp") / (F.col("ctp") + F.col("cfp"))), p)
    found = {
        "ap": ap, "lift": F.try_divide(ap, p / (p + n)), "auc": F.try_divide(p * n - F.sum(F.col("tp") * F.col("cfp")) + F.sum(F.col("tp") * F.col("fp")) / 2, p * n),
        "capture": F.try_divide(F.sum(F.col("tp") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))), p),
    }
    per = each.groupBy("rep").pivot("which", ["a", "b"]).agg((p + n).cast("long").alias("n"), p.cast("long").alias("p"), *[F.round(v, 6).alias(k) for k, v in found.items()])
    return per.select("rep", F.col("a_n").alias("n"), F.col("a_p").alias("positives"), *[F.col(f"{c}_{k}").alias(f"{k}_{c}") for k in METRICS for c in ("a", "b")])


def bootstrap_intervals(metrics: DataFrame) -> DataFrame:
    """(metric, low, middle, high, share_above): of a minus b over the replicates, 95 percent and how often it is above 0."""
    d = F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), (F.col(f"{k}_a") - F.col(f"{k}_b")).alias("d")) for k in METRICS]))
    q = {"low": 0.025, "middle": 0.5, "high": 0.975}
    return metrics.select(d).groupBy("metric").agg(*[F.round(F.percentile("d", v), 6).alias(k) for k, v in q.items()], F.round(F.avg((F.col("d") > 0).cast("double")), 6).alias("share_above"))  # as many rows as replicates
