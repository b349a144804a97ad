"""Near duplicates: a similarity join on word 5-grams with Bayesian pruning of candidates.

Words are lower-cased (A-Z only) runs of digits, letters and non-ASCII characters. A text's set holds a 64-bit
hash of each 5 consecutive words, or of all its words if it has 1 to 4. Two texts are linked if the Jaccard
similarity of their sets is 0.8 or more.

1. Texts with equal sets are one class member; only the member goes on, with its number of rows.
2. Candidates are the pairs in a bucket, that is with equal values in one of 32 bands of 4 MinHash values. A pair at
   0.8 is in none with probability 5e-8. A pair belongs to the first bucket that it shares, and a bucket whose
   members all share one earlier bucket is left out.
3. A bucket of many shingles is split into blocks of bounded size; each pair of blocks is one unit of work. So a task's
   size is bounded, and a member is copied once per bucket (of 32 at most) and block of it, whatever its component.
   MinHash values are compared 16 at a time; with m of n equal, the similarity's posterior is Beta(m + 1,
   n - m + 1) (uniform prior), and a pair is dropped when its mass from 0.8 on is below the tolerance of 1e-6.
4. What is left is verified exactly on the sets. A task returns counts of links and, of the links' local
   components, one edge per member, never all pairs.

A text without words is linked to nothing and is its own class. A null text has no words. Ids are integers; a null one counts
as larger than all others. Repeated rows are members of one class with equal sets. Extra columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.pretokens import slices
from millrace.llm.scratch import doc_ids, stage

WORDS, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS, STEP, TOLERANCE = 32, 4, 16, 1e-6
HASHES = BANDS * BAND_ROWS
BLOCK_SHINGLES, PACK_SHINGLES = 200_000, 1_000_000
#: Units go to as many partitions as there are packs, so that a task's size does not grow with the table; beyond this, tasks take several packs in turn.
MOST_PARTITIONS = 50_000
#: Words of more bytes are hashed one by one: a running sum would give some long words of two letters one hash.
LONG_WORD = 64
#: Keys of copies that are broadcast; with more, the join shuffles.
BROADCAST_ROWS = 1_000_000

_RANDOM = np.random.default_rng(20240607)
_FACTOR = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PLACE = _RANDOM.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])
_CHUNK_BYTES = 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = _IS_WORD[raw]
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = np.full(len(raw) + 1, np.uint64(_BASE)), np.full(len(raw) + 1, np.uint64(pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[:-1])))
    out = _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]].tobytes())
    return out, start


def shingles(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 5-gram hashes of each text."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        size, parts = 0, []
        while k < len(texts) and (not parts or size < _CHUNK_BYTES):
            parts.append(texts[k].encode())
            size += len(parts[-1]) + 1
            k += 1
        h, at = _word_hashes(b" ".join(parts))
        bounds = np.searchsorted(at, np.concatenate(([0], np.cumsum([len(x) + 1 for x in parts]))))
        grams = np.zeros(max(len(h) - WORDS + 1, 0), np.uint64)
        for j in range(WORDS):
            grams += h[j : j + len(grams)] * _PLACE[j]
        grams = _mixed(grams)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WORDS:
                out.append(np.unique(grams[a : b - WORDS + 1]))
            elif b > a:
                out.append(_mixed(np.array([(h[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row of HASHES per non-empty set."""
    out = np.empty((len(sets), HASHES), np.uint32)
    k = 0
    while k < len(sets):
        size, first = 0, k
        while k < len(sets) and (k == first or size + len(sets[k]) < 100_000):
            size += len(sets[k])
            k += 1
        flat = np.concatenate(sets[first:k])
        at = np.concatenate(([0], np.cumsum([len(x) for x in sets[first : k - 1]], dtype=np.int64)))
        for i in range(HASHES):
            out[first:k, i] = np.minimum.reduceat(((flat * _FACTOR[i] + _ADD[i]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """Hash of each band's values and number."""
    rows = sig.reshape(len(sig), BANDS, BAND_ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_BASE)
    for j in range(BAND_ROWS):
        h = _mixed(h * _PLACE[j] + rows[:, :, j])
    return h.view(np.int64)


def least_matches(n: int) -> int:
    """With fewer equal values of n, the posterior probability of reaching the threshold is below the tolerance."""
    mass = 0.0
    for m in range(n + 1):  # P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)
        mass += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
        if mass >= TOLERANCE:
            return m
    return n


_LEAST = [(n, least_matches(n)) for n in range(STEP, HASHES + 1, STEP)]


def _survivors(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of a and b that the posterior does not rule out."""
    m = np.zeros(len(i), np.int32)
    for n, least in _LEAST:
        m += (a[i, n - STEP : n] == b[j, n - STEP : n]).sum(1, dtype=np.int32)
        keep = m >= least
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def _linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the exact similarity of each pair reaches the threshold."""
    na, nb = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    if len(i) < 4 * (len(sets_a) + len(sets_b)):
        common = np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    else:  # products of 0/1 matrices, some columns at a time
        values, kind = np.unique(np.concatenate([*sets_a, *sets_b]), return_inverse=True)
        row = np.repeat(np.arange(len(na) + len(nb)), np.concatenate((na, nb)))
        order = np.argsort(kind, kind="stable")
        kind, row = kind[order], row[order]
        counts = np.zeros((len(na), len(nb)), np.float32)
        width = 2048
        for first in range(0, len(values), width):
            lo, hi = np.searchsorted(kind, (first, first + width))
            m = np.zeros((len(na) + len(nb), width), np.float32)
            m[row[lo:hi], kind[lo:hi] - first] = 1
            counts += m[: len(na)] @ m[len(na) :].T
        common = counts[i, j].astype(np.int64)
    return _reaches(common, na[i] + nb[j] - common)


def _reaches(common: np.ndarray, union: np.ndarray) -> np.ndarray:
    return common >= THRESHOLD * union - 1e-9


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least connected index of each of n."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _within(sets: list[np.ndarray], sig: np.ndarray, prints: np.ndarray, k: int, x: np.ndarray, y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of the rows x, or between x and y, that share no bucket before band k."""
    found_i, found_j = [], []
    for first in range(0, len(x), 256):  # 256 rows against the others
        i, j = (v.ravel() for v in np.meshgrid(x[first : first + 256], x if y is None else y, indexing="ij"))
        if y is None:
            i, j = i[i < j], j[i < j]
        i, j = _survivors(sig, sig, *_owned(prints, k, i, j))
        if len(i):
            ri, rj = np.unique(i), np.unique(j)
            ok = _linked([sets[r] for r in ri], [sets[r] for r in rj], np.searchsorted(ri, i), np.searchsorted(rj, j))
            found_i.append(i[ok])
            found_j.append(j[ok])
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (found_i, found_j))


def _owned(prints: np.ndarray, k, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs without an equal band before k (a number, or one for each pair)."""
    earlier = np.arange(BANDS) < np.broadcast_to(k, len(i))[:, None]
    keep = ~((prints[i] == prints[j]) & earlier).any(1)
    return i[keep], j[keep]


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a pack of units (band, x, y), a block of a bucket with itself or with another: member, root, links, texts."""
    pdf = pdf.sort_values(["band", "x", "y", "member"], ignore_index=True)
    sets = [np.frombuffer(v, np.uint64) for v in pdf["grams"]]
    sig = np.stack([np.frombuffer(v, np.uint32) for v in pdf["sig"]])
    prints = bands(sig)
    unit = pdf[["band", "x", "y"]].to_numpy()
    start = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]).any(1))))
    stop, k = np.append(start[1:], len(pdf)), pdf["k"].to_numpy()
    small = (stop - start <= 64) & (unit[start, 1] == unit[start, 2])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # the pairs of all small units at once
    pairs = [np.triu_indices(n, 1) for n in range(65)]
    i, j = (np.concatenate([pairs[b - a][side] + a for a, b in zip(start[small], stop[small], strict=True)] or [np.zeros(0, np.int64)]) for side in (0, 1))
    for first in range(0, len(i), 200_000):
        pi, pj = i[first : first + 200_000], j[first : first + 200_000]
        pi, pj = _survivors(sig, sig, *_owned(prints, k[pi], pi, pj))
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(pi, pj, strict=True)], np.int64)
        total = np.array([len(sets[a]) + len(sets[b]) for a, b in zip(pi, pj, strict=True)], np.int64)
        ok = _reaches(common, total - common)
        found.append((pi[ok], pj[ok]))
    block = pdf["block"].to_numpy()
    for a, b in zip(start[~small], stop[~small], strict=True):
        rows, (_, x, y) = np.arange(a, b), unit[a]
        found.append(_within(sets, sig, prints, k[a], rows[block[a:b] == x], None if x == y else rows[block[a:b] == y]))
    member, at = np.unique(pdf["member"].to_numpy(np.int64), return_inverse=True)
    weight = np.zeros(len(member), np.int64)
    weight[at] = pdf["rows"]
    i, j = (at[np.concatenate([f[side] for f in found] or [np.zeros(0, np.int64)])] for side in (0, 1))
    links, texts = (np.bincount(np.concatenate((i, j)), w, len(member)).astype(np.int64) for w in (np.concatenate((weight[j], weight[i])), np.ones(2 * len(i))))
    out = pd.DataFrame({"member": member, "root": member[_roots(len(member), i, j)], "links": links, "texts": texts})
    return out[out["texts"] > 0]


def _keys(docs: DataFrame) -> list[Column]:
    return [doc_ids(docs).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")]


def _set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two columns."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), "<i8").reshape(-1, 2)


def _profile(docs: DataFrame) -> DataFrame:
    """One row per document: row_id, key, tie, s1, s2 (hash of the set), n (its size), bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in slices([len(x) for x in pdf["text"]]):
                part = pdf.iloc[a:b]
                sets = shingles(part["text"].tolist())
                n = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(n)
                found: list = [None] * len(part)
                for at, row in zip(full, bands(signature([sets[i] for i in full])) if len(full) else [], strict=True):
                    found[at] = row
                s = _set_hashes(sets)
                yield pd.DataFrame({"row_id": part["row_id"].array, "key": part["key"].array, "absent": part["absent"].array, "tie": part["tie"].array, "s1": s[:, 0], "s2": s[:, 1], "n": n, "bands": pd.Series(found, dtype=object).array})

    source = docs.select(F.monotonically_increasing_id().alias("row_id"), *_keys(docs), F.col("doc_id").isNull().alias("absent"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInPandas(run, "row_id long, key long, absent boolean, tie long, s1 long, s2 long, n long, bands array<long>")


def _few(df: DataFrame) -> bool:
    """Of rows of fixed width."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _features(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """grams and sig of the members in wanted (key, tie, member, rows, places)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in slices([len(x) for x in pdf["text"]]):
                part = pdf.iloc[a:b].reset_index(drop=True)
                sets = shingles(part.pop("text").tolist())
                sig = signature(sets)
                yield part.assign(grams=[x.tobytes() for x in sets], sig=[x.tobytes() for x in sig])

    # members grow with the table, so texts are shuffled to them at every size
    rows = docs.select(*_keys(docs), "text").join(wanted.hint("merge"), ["key", "tie"])
    rows = rows.dropDuplicates(["member"])  # rows of one id and text, however many there are, are one member
    places = "places array<struct<k:int,band:long,blocks:int>>"
    return rows.select("member", "rows", "places", "text").mapInPandas(run, f"member long, rows long, {places}, grams binary, sig binary")


def _placed(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """The buckets in which members have to be compared: member, k (the band), band (the bucket), blocks."""
    buckets = rows.filter("n > 0").select("row_id", "bands").join(reps.select("row_id"), "row_id", "left_semi").select(F.col("row_id").alias("member"), F.posexplode("bands").alias("k", "band"))
    shared = buckets.groupBy("band").agg(F.min("member").alias("first"), F.max("member").alias("last")).filter("first < last").select("band")
    own = stage(buckets.join(shared, "band", "left_semi"), "shared-buckets")
    leads = own.groupBy("member").agg(F.min_by("band", "k").alias("lead"))
    own = own.join(leads, "member").join(reps.select(F.col("row_id").alias("member"), "n"), "member")
    sizes = own.groupBy("band").agg(F.min("lead").alias("low"), F.max("lead").alias("high"), F.sum("n").alias("total"))
    # all members share the bucket that is the first one of each of them: the pairs belong there
    needed = sizes.filter("low <> high or low = band").select("band", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    return stage(own.join(needed, "band").select("member", "k", "band", "blocks", "n"), "placed")


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, tie (hash of the text), class_id, n_links, n_texts, kept.

    class_id is the least doc_id of the texts that links connect. n_links counts the other documents at 0.8 or
    more, copies included, n_texts the other sets among them. kept holds for one document of each class, that
    with the least doc_id.
    """
    rows = stage(_profile(docs), "profile")
    # an empty set stands for itself: its row id is part of the key
    own = F.when(F.col("n") == 0, F.col("row_id")).otherwise(F.lit(-1)).alias("own")
    members = stage(rows.select("s1", "s2", "n", own, "row_id").groupBy("s1", "s2", "n", "own").agg(F.min("row_id").alias("member"), F.count(F.lit(1)).alias("rows")), "members")
    row_member = stage(rows.select("row_id", "key", "absent", "tie", "s1", "s2", "n", own).join(members, ["s1", "s2", "n", "own"]).select("row_id", "key", "absent", "tie", "n", "member", "rows"), "row-member")
    reps = row_member.filter("row_id = member")
    placed = _placed(rows, reps)
    places = placed.groupBy("member").agg(F.collect_list(F.struct("k", "band", "blocks")).alias("places"))  # at most BANDS of them
    wanted = stage(places.join(reps.select("member", "key", "tie", "rows"), "member"), "wanted")
    packs = (placed.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0) // PACK_SHINGLES + 1

    units = _features(docs, wanted).select("member", "rows", "grams", "sig", F.explode("places").alias("p")).select("member", "rows", "grams", "sig", "p.*")
    units = units.withColumn("block", F.pmod(F.xxhash64("member", "k"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).withColumn("pack", F.pmod(F.xxhash64("band", "x", "y"), F.lit(packs)))
    links = units.select("pack", "member", "rows", "k", "band", "x", "y", "block", "grams", "sig").repartition(min(packs, MOST_PARTITIONS), "pack").groupBy("pack").applyInPandas(_compare, "member long, root long, links long, texts long")
    links = stage(links, "links")

    degree = links.groupBy("member").agg(F.sum("links").alias("links"), F.sum("texts").alias("n_texts"))
    classes = components(links.select(F.col("member").alias("a"), F.col("root").alias("b")))
    known = classes.withColumnRenamed("id", "member").join(degree, "member", "left")
    joined = stage(row_member.join(known, "member", "left").select("row_id", "key", "absent", "tie", "rows", F.coalesce("component", "member").alias("component"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts")), "classes")
    # written, so that a component of many rows is split when they meet its head
    head = stage(joined.groupBy("component").agg(F.min(F.struct("key", "absent", "row_id")).alias("head")), "heads")
    own_id, class_id = F.when(~F.col("absent"), F.col("key")), F.when(~F.col("head.absent"), F.col("head.key"))
    return joined.join(head, "component").select(own_id.alias("doc_id"), "tie", class_id.alias("class_id"), (F.col("links") + F.col("rows") - 1).alias("n_links"), "n_texts", (F.col("row_id") == F.col("head.row_id")).alias("kept"))


def one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of docs without near duplicates: of each class the document with the least doc_id stays.

    Of rows that share doc_id and text one stays at most.
    """
    classes = near_classes(docs).select(doc_ids(docs).alias("key"), "tie", "kept")
    groups = stage(classes.groupBy("key", "tie").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).filter("not kept or n > 1"), "groups")
    groups = F.broadcast(groups) if _few(groups) else groups
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *_keys(docs))
    alone = keyed.join(groups, ["key", "tie"], "left_anti")
    one = keyed.join(groups.filter("kept"), ["key", "tie"], "left_semi").groupBy("key", "tie").agg(F.min_by("row", F.col("row.doc_id").isNull()).alias("row"))
    return alone.select("row.*").union(one.select("row.*"))
