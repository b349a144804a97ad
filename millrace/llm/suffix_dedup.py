"""Repeated byte strings found with suffix arrays built by two-stage sorting.

Every byte that is covered by a string of `length` bytes (200) which also starts anywhere else, in the same or
another document, is removed; all occurrences go, overlaps count, and strings are judged on the input.

1. Each 200-byte window has an anchor: of the hashes of its 32-byte grams the least, the leftmost among equals.
   Equal windows have equal anchors at the same offset. The windows of one anchor and their bytes are a context.
2. Windows whose anchor's hash occurs once end there: they have no equal.
3. Contexts of one hash go into one bucket of bounded size, where a suffix array tells which windows they share.
   Equal contexts (by a 128-bit hash of their bytes) go there once, with the number of times that each of their
   suffixes stands in the array.
4. A hash with more than HOT_CONTEXTS different contexts is split by its windows: those whose 128-bit hash occurs
   again go into buckets by that hash.
5. The suffix array of a bucket is built in two stages: the suffixes that are smaller than their successors are
   sorted directly, the others are induced by scanning buckets of first bytes. Adjacent common prefixes of 200 bytes
   or more, of two suffixes or of one that stands there several times, are the repeats.

Null text is the empty text, from which nothing is removed, as from any text of under 200 bytes. Repeated rows
are separate documents: all their windows occur again. Rows of one doc_id and text are told from
others by a hash and get equal results; ids are integers, a null one counts as 2^63 - 1. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import doc_ids, stage

LENGTH, GRAM = 200, 32
GRAMS = LENGTH - GRAM + 1
HOT_CONTEXTS, BUCKET_BYTES = 5000, 2_000_000
#: Buckets go to as many partitions as there are, so that a task's size does not grow with the table; beyond this, tasks take several in turn.
MOST_PARTITIONS = 50_000
#: Keys of documents with repeats that are broadcast; with more, the join shuffles.
BROADCAST_ROWS = 1_000_000
_BATCH_BYTES = 250_000
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(8121).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _keys(docs: DataFrame) -> list[Column]:
    return [doc_ids(docs).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")]


def contexts(docs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of texts of LENGTH bytes or more: text's index, anchor's hash, context's 128-bit hash in two, first window, anchor's place, number of windows."""
    whole = b"".join(docs)
    raw = np.frombuffer(whole, np.uint8)
    ends = np.cumsum([len(x) for x in docs])
    n = len(raw)
    up, down = np.full(n + 1, np.uint64(_BASE)), np.full(n + 1, np.uint64(pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[:-1])))
    grams = _mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    # leftmost least of GRAMS neighbours, from those of 1, 2, 4, ... neighbours
    at, width = np.arange(len(grams)), 1
    while width < GRAMS:
        step = min(width, GRAMS - width)
        a, b = at[:-step], at[step:]
        at, width = np.where(grams[a] <= grams[b], a, b), width + step
    doc = np.repeat(np.arange(len(docs)), np.diff(ends, prepend=0))[: len(at)]
    valid = np.flatnonzero(np.arange(len(at)) + LENGTH <= ends[doc])
    p, d = at[valid], doc[valid]
    new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (d[1:] != d[:-1]))))
    first, count = valid[new], np.diff(np.append(new, len(valid)))
    p, d = p[new], d[new]
    last = first + count - 1 + LENGTH
    # equal bytes have equal anchors at equal offsets
    digest = xxhash.xxh3_128_digest
    strong = np.frombuffer(b"".join([digest(whole[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]), "<i8").reshape(-1, 2)
    begin = ends[d] - np.array([len(x) for x in docs])[d]
    return d, grams[p].view(np.int64), strong[:, 0], strong[:, 1], first - begin, p - begin, count


def _anchors(docs: DataFrame) -> DataFrame:
    """One row per context: anchor, c1, c2, key, tie, place (first window << 8 | windows)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [x.encode() for x in pdf["text"]]
            keys, ties = pdf["key"].to_numpy(), pdf["tie"].to_numpy()
            k = 0
            while k < len(texts):
                index, size = [], 0
                while k < len(texts) and size < _BATCH_BYTES:
                    index.append(k)
                    size += len(texts[k])
                    k += 1
                d, anchor, c1, c2, first, _, count = contexts([texts[i] for i in index])
                row = np.array(index)[d]
                yield pd.DataFrame({"anchor": anchor, "c1": c1, "c2": c2, "key": keys[row], "tie": ties[row], "place": (first << 8) | count})

    source = docs.select(*_keys(docs), "text").filter(F.octet_length("text") >= LENGTH)
    return source.mapInPandas(run, "anchor long, c1 long, c2 long, key long, tie long, place long")


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a byte array in order of their first `depth` bytes, and the 8-byte words that start at each place."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    words = np.zeros(n + depth + 8, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | padded[j : j + len(words)]
    # smaller than the successor: the first difference to the right rises
    following = np.append(text[1:], 0)
    differs = np.append(np.flatnonzero(text != following), n - 1)
    at = differs[np.searchsorted(differs, np.arange(n))]
    smaller = text[at] < following[at]
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(words[direct], kind="stable")]
    group = np.cumsum(np.concatenate(([True], words[direct][1:] != words[direct][:-1]))) if len(direct) else direct
    tied = np.arange(len(direct))
    for d in range(8, depth, 8):
        same = group[tied][1:] == group[tied][:-1]
        tied = tied[np.append(same, False) | np.concatenate(([False], same))] if len(tied) else tied
        if not len(tied):
            break
        sub, word, g = direct[tied], words[direct[tied] + d], group[tied]
        first = np.concatenate(([True], g[1:] != g[:-1]))
        differs_here = ~first[1:] & (word[1:] != word[:-1])
        run = np.cumsum(first) - 1
        mixed = np.zeros(run[-1] + 1, bool)
        mixed[run[1:][differs_here]] = True
        todo = np.flatnonzero(mixed[run])  # groups whose next word is the same all over stay as they are
        if len(todo):
            order = todo[np.lexsort((word[todo], run[todo]))]
            sub[todo], word[todo] = sub[order], word[order]
            direct[tied] = sub
            new = first | np.concatenate(([True], word[1:] != word[:-1]))
            group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))] + n
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def scan(found: np.ndarray, c: int) -> np.ndarray:
        """Passes on what stands before `found`; returns that of the same first byte."""
        out.append(found)
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        cut = np.searchsorted(byte[order], np.arange(257))
        for b in np.unique(byte):
            if b != c:
                waiting[b].append(before[order[cut[b] : cut[b + 1]]])
        return before[order[cut[c] : cut[c + 1]]]

    # the last suffix has no successor that is in the array; it follows the empty one
    if n and not smaller[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    for c in range(256):
        found = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(found):
            found = scan(found, c)
        if bounds[c + 1] > bounds[c]:
            scan(direct[bounds[c] : bounds[c + 1]], c)
    return np.concatenate(out) if out else np.zeros(0, np.int64), words


def common_prefix(order: np.ndarray, words: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Whether each suffix has its first `depth` (a multiple of 8) bytes in common with the one before it in order."""
    same = np.zeros(len(order), bool)
    alive = np.arange(1, len(order))
    for d in range(0, depth, 8):
        alive = alive[words[order[alive] + d] == words[order[alive - 1] + d]]
    same[alive] = True
    return same


def shared_windows(texts: list[bytes], counts: list[int], times: list[int]) -> list[np.ndarray]:
    """Of contexts that occur `times` times: which of their first `counts` windows start elsewhere too. UTF-8 has no byte 255."""
    sizes = np.array([len(x) + 1 for x in texts])
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)  # ends become 0
    owned = np.zeros(len(text), np.int64)  # how often a window stands in the array
    for a, n, k in zip(begin.tolist(), counts, times, strict=True):
        owned[a : a + n] = k
    order, words = suffix_array(text)
    order = order[owned[order] > 0]
    same = common_prefix(order, words)
    repeated = owned > 1
    repeated[order[same]] = True
    repeated[order[np.append(same[1:], False)]] = True
    return [repeated[a : a + n] for a, n in zip(begin.tolist(), counts, strict=True)]


def _spans(flags: np.ndarray) -> list[int]:
    """Runs of windows as first << 8 | number."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [int(a) << 8 | int(b - a) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _in_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Marks of a bucket's contexts."""
    flags = shared_windows(pdf["bytes"].tolist(), pdf["windows"].tolist(), pdf["n"].tolist())
    marks = [_spans(x) for x in flags]
    out = pd.DataFrame({"anchor": pdf["anchor"].array, "c1": pdf["c1"].array, "c2": pdf["c2"].array, "marks": pd.Series(marks, dtype=object).array})
    return out[out["marks"].map(len) > 0]


_CONTEXT = "anchor long, c1 long, c2 long"


def _context_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the contexts in wanted (key, tie, anchor, c1, c2, place, n, hot)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, found in zip(pdf["text"], pdf["found"], strict=True):
                raw = text.encode()
                for w in found:
                    first, windows = w["place"] >> 8, w["place"] & 255
                    rows.append((w["anchor"], w["c1"], w["c2"], w["n"], w["hot"], windows, raw[first : first + windows - 1 + LENGTH]))
            yield pd.DataFrame(rows, columns=["anchor", "c1", "c2", "n", "hot", "windows", "bytes"])

    lists = wanted.groupBy("key", "tie").agg(F.collect_list(F.struct("anchor", "c1", "c2", "place", "n", "hot")).alias("found"))
    return docs.join(lists, ["key", "tie"]).select("text", "found").mapInPandas(run, f"{_CONTEXT}, n long, hot boolean, windows int, bytes binary")


def _single_windows(rows: DataFrame) -> DataFrame:
    """The windows of contexts: h1, h2 (128-bit hash of the bytes), anchor, c1, c2, n, i (which window)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            digests = [xxhash.xxh3_128_digest(raw[i : i + LENGTH]) for n, raw in zip(pdf["windows"], pdf["bytes"], strict=True) for i in range(n)]
            strong = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            times = pdf["windows"].to_numpy()
            out = pdf[["anchor", "c1", "c2", "n"]].loc[pdf.index.repeat(times)]
            yield out.assign(h1=strong[:, 0], h2=strong[:, 1], i=np.concatenate([np.arange(k) for k in times] or [[]]).astype(int))

    return rows.mapInPandas(run, f"{_CONTEXT}, n long, h1 long, h2 long, i int")


def _hot_marks(rows: DataFrame) -> DataFrame:
    """Marks of hot anchors' contexts, from suffix arrays of those windows that occur again."""
    windows = stage(_single_windows(rows.select("anchor", "c1", "c2", "n", "windows", "bytes")), "hot-windows")
    again = windows.groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min(F.struct("anchor", "c1", "c2", "i")).alias("at")).filter("total > 1")
    again = stage(again.select("h1", "h2", "at.*"), "hot-repeats")
    # the bytes of one occurrence; its hash takes the place of the context
    places = again.groupBy("anchor", "c1", "c2").agg(F.collect_list(F.struct("i", "h1", "h2")).alias("found"))  # a context has at most GRAMS windows
    one = rows.join(places, ["anchor", "c1", "c2"]).select("anchor", F.explode("found").alias("f"), "bytes")
    one = one.select("anchor", F.col("f.h1").alias("c1"), F.col("f.h2").alias("c2"), F.lit(2).cast("long").alias("n"), F.lit(1).alias("windows"), F.substring(F.col("bytes"), F.col("f.i") + 1, F.lit(LENGTH)).alias("bytes"))
    repeated = _bucket_marks(one, ["c1", "c2"]).select(F.col("c1").alias("h1"), F.col("c2").alias("h2"))
    found = windows.join(repeated, ["h1", "h2"], "left_semi")
    return found.groupBy("anchor", "c1", "c2").agg(F.collect_list(F.shiftleft(F.col("i").cast("long"), 8).bitwiseOR(F.lit(1))).alias("marks"))


def _bucket_marks(rows: DataFrame, by: list[str]) -> DataFrame:
    """Marks of contexts (anchor, c1, c2, n, windows, bytes), those with equal `by` in one bucket."""
    size = rows.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = size // BUCKET_BYTES + 1
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("bucket")
    dealt = rows.select(bucket, "anchor", "c1", "c2", "n", "windows", "bytes").repartition(min(buckets, MOST_PARTITIONS), "bucket")
    return dealt.groupBy("bucket").applyInPandas(_in_bucket, f"{_CONTEXT}, marks array<long>")


def _cut(text: str | None, spans) -> tuple[int, int, int, bytes]:
    raw = (text or "").encode()
    cover = np.zeros(len(raw) + 1, np.int64)
    if spans is not None:
        spans = np.asarray(spans, np.int64)
        np.add.at(cover, spans >> 16, 1)
        np.add.at(cover, (spans >> 16) + (spans & 0xFFFF), -1)
    gone = np.cumsum(cover)[:-1] > 0
    runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[:1]).sum())
    return len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary, the remaining bytes)."""
    source = docs.select("doc_id", *_keys(docs), "text")
    anchors = stage(_anchors(docs), "all-anchors")
    often = stage(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor"), "anchors")
    found = stage(anchors.join(often, "anchor", "left_semi"), "found")
    kinds = stage(found.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.first("key").alias("key"), F.first("tie").alias("tie"), F.first("place").alias("place")), "contexts")
    hot = kinds.groupBy("anchor").count().select("anchor", (F.col("count") > HOT_CONTEXTS).alias("hot"))
    keys = stage(found.select("key", "tie").distinct(), "keys")
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    touched = stage(source.join(F.broadcast(keys) if small else keys, ["key", "tie"], "left_semi"), "texts")

    # rows of one id and text give their contexts once, however many there are
    single = touched.select("key", "tie", "text").dropDuplicates(["key", "tie"])
    rows = stage(_context_bytes(single, kinds.join(hot, "anchor")), "context-bytes")
    marks = _bucket_marks(rows.filter("not hot"), ["anchor"]).union(_hot_marks(rows.filter("hot")))
    marks = stage(marks, "marks")

    first = F.shiftright("place", 8)
    spans = found.join(marks, ["anchor", "c1", "c2"]).select("key", "tie", first.alias("first"), F.explode("marks").alias("m"))
    span = F.shiftleft(F.col("first") + F.shiftright("m", 8), 16).bitwiseOR(F.col("m").bitwiseAND(F.lit(255)) + (LENGTH - 1))
    spans = spans.select("key", "tie", span.alias("span")).groupBy("key", "tie").agg(F.collect_set("span").alias("spans"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(texts: pd.Series, all_spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cut(t, s) for t, s in zip(texts, all_spans, strict=True)], columns=["n_bytes", "n_removed", "n_spans", "kept"])

    cleaned = touched.join(spans, ["key", "tie"], "left").select("doc_id", cut(F.col("text"), F.col("spans")).alias("x")).select("doc_id", "x.*")
    rest = source.join(F.broadcast(keys) if small else keys, ["key", "tie"], "left_anti")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return cleaned.union(rest.select("doc_id", F.length(raw).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), raw))
