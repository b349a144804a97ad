"""Benchmark passages in training text, by winnowing, in DataFrame operations only.

Words are lower-cased (A-Z only) runs of digits, letters and non-ASCII characters. Of the hashes of all k
consecutive words, each window of w of them keeps the least, the first one among equals; k + w - 1 is the number
of words of a match window, so every shared window has a fingerprint in common, at the same place. An item with
fewer words than a window, but at least one, is a window of its own and is looked up by a hash of all its words.

The items' distinct windows are numbered. Fingerprints of documents are joined with those of the items; around each
hit, the document's words are extended before and after it to the windows that hold it, and these are joined with the
items' windows by their words. So a document's window meets at most one window of the items, however often words
repeat and however many items share a phrase. Windows that touch or overlap make up one span.

Items are named for sets of windows, not for documents: documents with the same windows share one `item_set`.

Null text has no words; an item without words matches nothing. A null item id is shown as the empty string; rows
with one item id count as one item. Documents that are equal in doc_id and text get equal results, one per row.
Empty tables give no rows or no hits. Extra columns pass through unless they have the name of a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import stage

WINDOW, GRAM = 10, 5
#: Rows of fixed width (fingerprints of items, results of documents with hits) that are broadcast; with more, the join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of the strings or arrays in what is broadcast.
BROADCAST_BYTES = 16_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATORS = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _SEPARATORS, _UPPER.lower() + " " * len(_SEPARATORS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row although a lambda uses it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grams(hashes: Column, k: int) -> Column:
    """Hash of each k consecutive words."""
    places = F.sequence(F.lit(0), F.size(hashes) - k)
    grams = F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    return F.when(F.size(hashes) >= k, grams).otherwise(F.array().cast("array<bigint>"))


def _winnowed(grams: Column, w: int) -> Column:
    """Places in grams of the least value of each window; the low bits of what is compared say where in the window it is."""

    def least(i: Column) -> Column:
        return F.least(*[F.shiftleft(F.get(grams, i + j), 4).bitwiseOR(F.lit(j)) for j in range(w)])

    places = F.transform(F.sequence(F.lit(0), F.size(grams) - w), lambda i: i + least(i).bitwiseAND(F.lit(15)).cast("int"))
    return F.when(F.size(grams) >= w, F.array_distinct(places)).otherwise(F.array().cast("array<int>"))


def fingerprints(words_: Column, window: int, gram: int, short: list[int]) -> Column:
    """array<struct<kind, fp, at>>: the winnowed hashes, and every hash of as many words as a short item has."""

    def whole_item(hashes: Column, n: int) -> Column:
        return F.transform(_grams(hashes, n), lambda h, i: F.struct(F.lit(n).alias("kind"), h.alias("fp"), i.alias("at")))

    def of(hashes: Column) -> Column:
        winnowed = _let(_grams(hashes, gram), lambda g: F.transform(_winnowed(g, window - gram + 1), lambda p: F.struct(F.lit(window).alias("kind"), F.get(g, p).alias("fp"), p.alias("at"))))
        whole = [whole_item(hashes, n) for n in short]
        return F.concat(winnowed, *whole) if whole else winnowed

    return _let(F.transform(words_, lambda w: F.xxhash64(w)), of)


@dataclass(frozen=True)
class Contamination:
    """documents: the input's rows with n_words, n_hit, contaminated and item_set (null without a hit).

    spans: item_set, text_key, and the word range [from, to) of each maximal run of hit words of a text.
    item_sets: item_set and items, the sorted ids as strings.
    """

    documents: DataFrame
    spans: DataFrame
    item_sets: DataFrame


_RESULTS = ("n_words", "n_hit", "contaminated", "item_set")


def _keys() -> list[Column]:
    """128 bits that stand for doc_id and text."""
    parts = [F.col("doc_id").isNull(), F.col("text").isNull(), "doc_id", "text"]
    return [F.xxhash64(F.lit(k), *parts).alias(f"k{k}") for k in (1, 2)]


def _bounded(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _few(df: DataFrame) -> bool:
    """Of rows of fixed width."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _small(df: DataFrame) -> bool:
    """Of rows with one array or string: their number and their size are bounded."""
    kind = dict(df.dtypes)
    wide = next(c for c, t in kind.items() if t == "string" or t.startswith("array"))
    size = F.octet_length(wide) if kind[wide] == "string" else F.size(wide) * 8
    return _few(df) and (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def _window(w: Column, start: Column, n: Column) -> Column:
    """The n words from start on, as one string; words hold no spaces."""
    return F.array_join(F.slice(w, start + 1, n), " ")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> Contamination:
    """Words of docs (doc_id, text) that lie in a window of an item of benchmark (item_id, text)."""
    if not 0 < window - gram + 1 <= 16:
        raise ValueError("a window must hold 1 to 16 grams")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    items = stage(items.filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window))), "items")
    short = sorted(r[0] for r in items.filter(F.col("n") < window).select("n").distinct().collect())  # at most window - 1 numbers

    starts = F.sequence(F.lit(0), F.size("w") - F.col("n"))
    windows = items.select("item", "n", F.explode(F.transform(starts, lambda i: _window(F.col("w"), i, F.col("n")))).alias("words")).distinct()
    windows = stage(windows, "item-windows")
    distinct = stage(windows.select("n", "words").distinct().withColumn("window", F.monotonically_increasing_id()), "distinct-windows")

    def prints(df: DataFrame, w: Column, *keep: str) -> DataFrame:
        return df.select(*keep, F.explode(fingerprints(w, window, gram, short)).alias("f")).select(*keep, "f.kind", "f.fp", "f.at")

    item_prints = stage(prints(items, F.col("w"), "n").filter("kind = n").select("kind", "fp").distinct(), "item-prints")
    found = prints(docs.select(*_keys(), "text"), words(F.col("text")), "k1", "k2")
    found = found.join(_bounded(item_prints, _few(item_prints)), ["kind", "fp"], "left_semi")
    # a text has no more places than words
    found = stage(found.groupBy("k1", "k2").agg(F.collect_set(F.struct("kind", "at")).alias("hits")), "hits")

    # only texts with a hit are read again
    hit = docs.select(*_keys(), "text").join(F.broadcast(found) if _small(found) else found, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    hit = hit.select("k1", "k2", words(F.col("text")).alias("w"), "hits")
    # the windows that hold the fingerprint: it is one of the first window - gram + 1 grams; a short item is its own window
    before = F.when(F.col("h.kind") == window, window - gram).otherwise(0)
    around = hit.select("k1", "k2", "w", F.explode("hits").alias("h")).select("k1", "k2", "w", F.col("h.kind").alias("n"), F.explode(F.sequence(F.greatest(F.col("h.at") - before, F.lit(0)), F.col("h.at"))).alias("from"))
    around = around.filter(F.col("from") + F.col("n") <= F.size("w")).select("k1", "k2", "n", "from", _window(F.col("w"), F.col("from"), F.col("n")).alias("words"))
    matches = around.join(_bounded(distinct, _small(distinct)), ["n", "words"]).select("k1", "k2", "from", (F.col("from") + F.col("n")).alias("to"), "window").distinct()

    in_text = Window.partitionBy("k1", "k2").orderBy("from", "to")
    reach = F.max("to").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    matches = matches.withColumn("new", F.coalesce(F.col("from") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    runs = matches.groupBy("k1", "k2", "run").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.collect_set("window").alias("windows"))
    texts = runs.groupBy("k1", "k2").agg(F.sum(F.col("to") - F.col("from")).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("windows")))).alias("windows"), F.collect_list(F.struct("from", "to")).alias("spans"))
    texts = stage(texts, "texts")

    sets = stage(texts.select("windows").distinct().withColumn("item_set", F.monotonically_increasing_id()), "window-sets")
    texts = stage(texts.join(sets, "windows").select("k1", "k2", "n_hit", "item_set", "spans"), "hit-texts")
    named = sets.select("item_set", F.explode("windows").alias("window")).join(distinct, "window").join(windows, ["n", "words"])
    item_sets = named.groupBy("item_set").agg(F.array_sort(F.collect_set("item")).alias("items"))

    results = texts.select("k1", "k2", "n_hit", "item_set")
    own = [c for c in docs.columns if c not in _RESULTS]
    rows = docs.select(F.struct(*own).alias("row"), *_keys(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(_bounded(results, _few(results)), ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    documents = joined.select("row.*", "n_words", n_hit.alias("n_hit"), (n_hit > 0).alias("contaminated"), "item_set")
    spans = texts.select("item_set", F.concat_ws(":", "k1", "k2").alias("text_key"), F.explode("spans").alias("s")).select("item_set", "text_key", "s.from", "s.to")
    return Contamination(documents, spans, item_sets)
