"""Runs of consecutive units (lines, sentences) that occur again, over arrays.

A rule accepts runs of units by their number and size; a run that it accepts stays accepted when it grows. For each
unit there are two windows, the shortest accepted run that starts at it and the shortest that ends at it. A window
occurs again if its 128-bit hash does. The first window of an accepted run, those after it that end inside, and the
one that ends with the run cover it wholly, so a unit is covered by windows that occur earlier exactly if it is part of
an accepted run that does, and what is found does not depend on the text around.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.pretokens import slices
from millrace.llm.scratch import doc_ids, stage

_MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Rule:
    """Accepts a run of n units with c characters if n >= units and c >= chars, or c >= long_chars, or n >= most."""

    units: int
    chars: int
    long_chars: int
    most: int

    def __post_init__(self):
        if not 0 < self.most < 32:
            raise ValueError("a window has 1 to 31 units")


def _window_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    base, inverse = np.uint64(_BASE[k]), np.uint64(pow(_BASE[k], -1, 1 << 64))
    n = max(len(h), 1)
    up, down = np.full(n, base), np.full(n, inverse)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    x = (h ^ (h >> np.uint64(29))) * _MIX[k]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x ^ (x >> np.uint64(32))) * up[: len(h)])))
    out = (total[end] - total[start]) * down[start]
    return (out ^ (out >> np.uint64(31))) * _MIX[1 - k] + (end - start).astype(np.uint64)


def _accepted(rule: Rule, t: int, c: np.ndarray) -> np.ndarray:
    return ((t >= rule.units) & (c >= rule.chars)) | (c >= rule.long_chars) | (t == rule.most)


def windows(units: list[list[str]], rule: Rule) -> dict[str, np.ndarray]:
    """Of several texts' units: doc (index of the text), at, size, h1, h2, again (the text has it before), fp, mark, lead.

    fp is the least unit hash of the window, its fingerprint, and mark its place in the text; lead marks one window of
    each place that is one.
    """
    sizes = np.array([len(x) for x in units], np.int64)
    flat = [u.strip() for x in units for u in x]
    n = len(flat)
    h = np.fromiter((xxhash.xxh3_64_intdigest(u) for u in flat), np.uint64, n)
    chars = np.concatenate(([0], np.cumsum(np.fromiter(map(len, flat), np.int64, n))))
    limit, first = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
    start, end, last, begin = np.arange(n), np.zeros(n, np.int64), np.arange(1, n + 1), np.full(n, -1)
    for t in range(1, rule.most + 1):
        stop = np.minimum(start + t, n)
        ok = (end == 0) & (start + t <= limit) & _accepted(rule, t, chars[stop] - chars[start])
        end[ok] = stop[ok]
        low = np.maximum(last - t, 0)
        ok = (begin < 0) & (last - t >= first) & _accepted(rule, t, chars[last] - chars[low])
        begin[ok] = low[ok]
    # a run that is the window from its first unit is not listed again as the one to its last
    back = np.flatnonzero((begin >= 0) & (end[begin] != last))
    at = np.flatnonzero(end)
    doc = np.repeat(np.arange(len(units)), sizes)
    start, end = np.concatenate((at, begin[back])), np.concatenate((end[at], last[back]))
    doc = doc[start]
    h1, h2 = (_window_hash(h, start, end, k) for k in (0, 1))
    pick = start.copy()
    for t in range(1, rule.most):
        inside = np.flatnonzero(start + t < end)
        pick[inside] = np.where(h[start[inside] + t] < h[pick[inside]], start[inside] + t, pick[inside])
    lead = np.zeros(len(start), bool)
    lead[np.unique(pick, return_index=True)[1]] = True
    order = np.lexsort((start, h2, h1, doc))
    again = np.zeros(len(start), bool)
    if len(start):
        a, b = order[1:], order[:-1]
        again[a] = (doc[a] == doc[b]) & (h1[a] == h1[b]) & (h2[a] == h2[b])
    at, mark = (start - first[start], pick - first[start]) if n else (start, pick)
    return {"doc": doc, "at": at, "size": end - start, "h1": h1.view(np.int64), "h2": h2.view(np.int64), "again": again, "fp": h[pick].view(np.int64), "mark": mark, "lead": lead}


def _keys(docs: DataFrame) -> list[Column]:
    """doc_id, null as the largest, and 64 bits that tell rows with one doc_id apart."""
    return [doc_ids(docs).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")]


def _in_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows some megabytes of text at a time, however long a batch is."""
    for pdf in batches:
        for a, b in slices([len(x) for x in pdf["text"]]):
            yield pdf.iloc[a:b]


def fingerprints(docs: DataFrame, split: Callable[[str], list[str]], rule: Rule) -> DataFrame:
    """One row for each place of a text that is the fingerprint of a window: fp, doc_id, tie, mark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _in_parts(batches):
            w = windows([split(x) for x in part["text"]], rule)
            doc, one = w["doc"], w["lead"]
            yield pd.DataFrame({"fp": w["fp"][one], "doc_id": part["doc_id"].to_numpy(np.int64)[doc[one]], "tie": part["tie"].to_numpy(np.int64)[doc[one]], "mark": w["mark"][one].astype(np.int32)})

    return docs.select(*_keys(docs), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "fp long, doc_id long, tie long, mark int")


def extended(docs: DataFrame, marks: DataFrame, split: Callable[[str], list[str]], rule: Rule) -> DataFrame:
    """The windows around the places (doc_id, tie, mark), extended before and after them: h1, h2, doc_id, tie, place, again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _in_parts(batches):
            w = windows([split(x) for x in part["text"]], rule)
            wanted = np.concatenate([np.asarray(m, np.int64) | (k << 32) for k, m in enumerate(part["marks"])])
            one = np.isin(w["mark"] | (w["doc"].astype(np.int64) << 32), wanted)
            doc = w["doc"][one]
            yield pd.DataFrame({"h1": w["h1"][one], "h2": w["h2"][one], "doc_id": part["doc_id"].to_numpy(np.int64)[doc], "tie": part["tie"].to_numpy(np.int64)[doc], "place": (w["at"][one] << 5) | w["size"][one], "again": w["again"][one]})

    lists = marks.groupBy("doc_id", "tie").agg(F.collect_set("mark").alias("marks"))  # at most one for each unit of the text
    source = docs.select(*_keys(docs), F.coalesce("text", F.lit("")).alias("text"))
    return source.join(lists, ["doc_id", "tie"]).select("doc_id", "tie", "text", "marks").mapInPandas(run, "h1 long, h2 long, doc_id long, tie long, place long, again boolean")


def places(docs: DataFrame, split: Callable[[str], list[str]], rule: Rule) -> DataFrame:
    """One row per window: h1, h2, fp, lead, doc_id, tie, place (the window's first unit and its number of units), again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _in_parts(batches):
            w = windows([split(x) for x in part["text"]], rule)
            ids, ties = part["doc_id"].to_numpy(np.int64), part["tie"].to_numpy(np.int64)
            doc = w.pop("doc")
            yield pd.DataFrame({"h1": w["h1"], "h2": w["h2"], "fp": w["fp"], "lead": w["lead"], "doc_id": ids[doc], "tie": ties[doc], "place": (w["at"] << 5) | w["size"], "again": w["again"]})

    source = docs.select(*_keys(docs), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInPandas(run, "h1 long, h2 long, fp long, lead boolean, doc_id long, tie long, place long, again boolean")


def without(docs: DataFrame, later: DataFrame, split: Callable[[str], list[str]], glue: str, prefix: str) -> DataFrame:
    """docs with text without the units that windows of `later` (doc_id, tie, place) cover; adds n_<prefix> and n_removed."""
    kept_type = f"text string, n_{prefix} long, n_removed long"

    @F.pandas_udf(kept_type)
    def cut(texts: pd.Series, all_places: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, all_places, strict=True):
            units = split(text or "")
            drop = np.zeros(len(units) + 1, np.int64)
            if found is not None and len(found):
                found = np.asarray(found, np.int64)
                np.add.at(drop, found >> 5, 1)
                np.add.at(drop, (found >> 5) + (found & 31), -1)
            gone = np.cumsum(drop)[:-1] > 0
            # text without a removed unit stays as it was, null included
            rows.append((text if not gone.any() else glue.join(u for u, g in zip(units, gone, strict=True) if not g), len(units), int(gone.sum())))
        return pd.DataFrame(rows, columns=["text", f"n_{prefix}", "n_removed"])

    later = later.groupBy("doc_id", "tie").agg(F.collect_set("place").alias("places"))  # at most two for each unit of the text
    own = [c for c in docs.columns if c not in {f"n_{prefix}", "n_removed"}]
    left = docs.select(F.struct(*own).alias("row"), *_keys(docs))
    joined = left.join(later, ["doc_id", "tie"], "left").select("row", cut(F.col("row.text"), F.col("places")).alias("new"))
    return joined.select(*[F.col(f"new.{c}") if c == "text" else F.col("row")[c].alias(c) for c in own], f"new.n_{prefix}", "new.n_removed")


def repeated(windows_: DataFrame, name: str) -> DataFrame:
    """Hashes of windows that several documents have, with the least of their ids."""
    groups = windows_.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return stage(groups.filter("first < last").select("h1", "h2", "first"), name)


def later_places(windows_: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, tie, place) of windows that start before in the same document, or in a document with a smaller id."""
    return windows_.join(groups, ["h1", "h2"], "left").filter("again or doc_id > first").select("doc_id", "tie", "place")
