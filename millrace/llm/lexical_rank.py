"""Ranked lexical search: the highest-scoring documents of each item, exactly.

Every document is restricted to the terms that items hold. A task reads such vectors block by block; of a block it
makes a document FP-tree: terms in order of document frequency, documents as paths, those with a common start below
one node. A node knows the greatest frequency of each term and the least length factor m below it. As a score rises
with tf and falls with m, these bound the score of all documents below. For each item the tree is searched depth
first, best bound first; a node that can't reach the item's k-th score so far is left out with all below it, and the
documents of a leaf are scored in whole numbers. A task passes on k documents for each item, which are then ranked.

Items are searched in groups of bounded size, each against all documents; what tasks are sent is one group's terms.

Terms, weights and scores are those of the contract of operator 13 (`weights`, `length_factors`, `scores`). Null and
empty texts have no terms: such documents count nowhere and such items have no rows. Rows that repeat a document
are documents of their own, of equal score; a null doc_id is the last among equal scores. Item rows that repeat id and
text are one item; rows of one id with unlike texts each get their ten. Extra columns are left out. Empty tables
give no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import stage

K = 10
#: The terms of all items go to the tasks that restrict documents, up to so many and so many characters; beyond, a join does it.
VOCABULARY, VOCABULARY_CHARS = 200_000, 8_000_000
#: Rows (item, term) in a group of items, about.
GROUP_ROWS = 20_000
#: Documents in a tree, and values (documents times terms) in its matrix.
TREE_DOCS, TREE_VALUES = 2048, 4_000_000
LEAF_DOCS = 32
PIECE = 4_000_000

#: Upper case as lower; all bytes that are not of a term as space. Bytes over 127 are of terms.
_TABLE = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def term_counts(raw: bytes) -> Counter:
    """How often each term occurs in a text of UTF-8 bytes; long texts go piece by piece."""
    raw = raw.translate(_TABLE)
    if len(raw) <= PIECE:
        return Counter(raw.split())
    counts, at = Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        counts.update(raw[at:end].split())
        at = end
    return counts


def _vectors(df: DataFrame, keep: Broadcast | None = None) -> DataFrame:
    """df with n (terms with repeats), terms and tfs in place of its column text, without texts that have no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = keep.value if keep else None
        for batch in batches:
            at, n, terms, tfs, ends = [], [], [], [], [0]
            for k, raw in enumerate(batch.column("text").cast(pa.binary())):
                counts = term_counts(raw.as_py())
                if counts:
                    at.append(k)
                    n.append(counts.total())
                    some = [(t, c) for t, c in counts.items() if wanted is None or t in wanted]
                    terms += [t for t, _ in some]
                    tfs += [c for _, c in some]
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(terms, pa.string()), pa.array(tfs, pa.int64()))]
            rest = batch.drop_columns(["text"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(n, pa.int64()), *lists], [*rest.schema.names, "n", "terms", "tfs"])

    own = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes if name != "text")
    return df.withColumn("text", F.coalesce("text", F.lit(""))).mapInArrow(run, f"{own}, n long, terms array<string>, tfs array<long>")


def _pairs(vectors: DataFrame, *own: str) -> DataFrame:
    return vectors.select(*own, F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(*own, F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))


def weights(df: str, n_docs: int) -> Column:
    """floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col(df).cast("double") + 1))).cast("long")


def length_factors(n: str, n_docs: int, n_terms: int) -> Column:
    """100 - 75 + ((75 n N) div L), of products of any size."""
    return F.expr(f"25L + (cast({n} as decimal(19, 0)) * cast({75 * n_docs} as decimal(19, 0))) div {max(n_terms, 1)}L")


def scores(tf: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of w ((1000000000 tf) div (1000 tf + 8 m)) over the columns of tf."""
    return ((1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None])) @ w


class Tree:
    """Documents below common starts of their terms in order of frequency (term 0 is the most frequent)."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray, width: int):
        """Document i has terms[starts[i] : starts[i + 1]], ascending, with their frequencies."""
        paths = [terms[a:b].astype(">u4").tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        self.m = m[self.order]
        place = np.empty(len(paths), np.int64)
        place[self.order] = np.arange(len(paths))
        self.tf = np.zeros((len(paths), width), np.int64)
        self.tf[place[np.repeat(np.arange(len(paths)), np.diff(starts))], terms] = tfs
        self.paths = [terms[starts[i] : starts[i + 1]] for i in self.order]
        self.ranges: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self._grow(0, len(paths), 0)
        self.most = np.stack([self.tf[a:b].max(0) for a, b in self.ranges])
        self.least_m = np.array([self.m[a:b].min() for a, b in self.ranges], float)

    def _grow(self, a: int, b: int, depth: int) -> int:
        """The node of the documents a to b, which share their first `depth` terms."""
        me = len(self.ranges)
        self.ranges.append((a, b))
        self.children.append([])
        if b - a <= LEAF_DOCS:
            return me
        while len(self.paths[a]) > depth and self.paths[a][depth] == self.paths[b - 1][depth]:
            depth += 1  # sorted: what the first and the last share, all share
        heads = np.array([p[depth] if len(p) > depth else -1 for p in self.paths[a:b]])
        cuts = [a, *(a + 1 + np.flatnonzero(np.diff(heads))).tolist(), b]
        if len(cuts) == 2:  # equal documents
            return me
        first = a
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo > LEAF_DOCS:
                if first < lo:
                    self.children[me].append(self._grow_all(first, lo, depth))
                self.children[me].append(self._grow(lo, hi, depth + 1))
                first = hi
            elif hi - first > LEAF_DOCS:  # small neighbours share a leaf
                self.children[me].append(self._grow_all(first, lo, depth))
                first = lo
        if first < b:
            self.children[me].append(self._grow_all(first, b, depth))
        return me

    def _grow_all(self, a: int, b: int, depth: int) -> int:
        self.ranges.append((a, b))
        self.children.append([])
        return len(self.ranges) - 1

    def bounds(self, w: np.ndarray) -> np.ndarray:
        """For each node and each column of w (terms times items) no less than any score below; rounding is allowed for."""
        most = self.most.astype(float)
        return (1e9 * most / (1000 * most + 8 * self.least_m[:, None])) @ w * (1 + 1e-9) + 1


class Best:
    """The k best (score, id) of one item: higher scores, then smaller ids, null last."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    @property
    def least(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, doc: int | None) -> None:
        entry = (score, doc is not None, -doc if doc is not None else 0)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def rows(self) -> list[tuple[int, int | None]]:
        return [(score, -neg if known else None) for score, known, neg in self.heap]


def search(tree: Tree, ids: list[int | None], terms: list[np.ndarray], w: list[np.ndarray], bounds: np.ndarray, best: list[Best]) -> int:
    """Depth-first branch and bound for each item; returns the number of documents scored."""
    scored = 0
    for item, found in enumerate(best):
        bound, stack = bounds[:, item], [0]
        while stack:
            node = stack.pop()
            if bound[node] < found.least:
                continue
            if tree.children[node]:
                stack += sorted(tree.children[node], key=bound.__getitem__)  # the best is on top
                continue
            a, b = tree.ranges[node]
            s = scores(tree.tf[a:b][:, terms[item]], tree.m[a:b], w[item])
            scored += b - a
            for k in np.flatnonzero(s >= found.least):
                found.add(int(s[k]), ids[tree.order[a + k]])
    return scored


def _searcher(group: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, of_item, vocabulary = group.value
        number = {t: i for i, t in enumerate(vocabulary)}
        terms, w = [x[0] for x in of_item], [x[1] for x in of_item]
        dense = np.zeros((len(vocabulary), len(names)))
        for i, (t, v) in enumerate(of_item):
            dense[t, i] = v
        best = [Best(k) for _ in names]
        step = max(64, min(TREE_DOCS, TREE_VALUES // max(len(vocabulary), 1)))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                lists = part.column("terms")
                coded = pc.dictionary_encode(lists.flatten())
                known = np.array([number.get(x, -1) for x in coded.dictionary.to_pylist()], np.int64)
                flat = known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy())
                tfs = part.column("tfs").flatten().to_numpy()
                here = flat >= 0
                order = np.lexsort((flat[here], doc[here]))
                doc, flat, tfs = doc[here][order], flat[here][order], tfs[here][order]
                with_terms, sizes = np.unique(doc, return_counts=True)
                if not len(with_terms):
                    continue
                tree = Tree(np.concatenate(([0], np.cumsum(sizes))), flat, tfs, part.column("m").to_numpy()[with_terms], len(vocabulary))
                ids = part.column("doc_id").to_pylist()
                search(tree, [ids[i] for i in with_terms], terms, w, tree.bounds(dense), best)
        rows = [(name, doc, score) for name, b in zip(names, best, strict=True) for score, doc in b.rows()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return run


def _group(rows: pd.DataFrame) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Items, their terms (numbers) and weights, and the terms in order of document frequency, from (item, term, qtf, df, w)."""
    vocabulary = rows.drop_duplicates("term").sort_values(["df", "term"], ascending=[False, True])["term"].tolist()
    number = {t: i for i, t in enumerate(vocabulary)}
    names, of_item = [], []
    for name, part in rows.groupby("item", sort=True):
        names.append(name)
        of_item.append((part["term"].map(number).to_numpy(np.int64), (part["qtf"] * part["w"]).to_numpy(np.int64)))
    return names, of_item, vocabulary


def rank(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 of each item."""
    spark = docs.sparkSession
    if dict(docs.dtypes)["doc_id"] not in {"tinyint", "smallint", "int", "bigint"}:
        raise TypeError("doc_id must hold integers")
    named = items.select("item_id", F.sha2(F.concat_ws("\x00", F.col("item_id").isNull().cast("string"), F.sha2(F.col("item_id").cast("string"), 256), "text"), 256).alias("item"), "text").dropDuplicates(["item"])
    named = stage(named, "rank-items")
    asked = stage(_pairs(_vectors(named.select("item", "text")), "item").withColumnRenamed("tf", "qtf"), "rank-asked")
    vocabulary = stage(asked.select("term").distinct(), "rank-vocabulary")
    size = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    source = docs.select(F.col("doc_id").cast("long"), "text")
    if size[0] <= VOCABULARY and size[1] <= VOCABULARY_CHARS:
        sent = spark.sparkContext.broadcast(frozenset(r.term.encode() for r in vocabulary.collect()))
        vectors = every = stage(_vectors(source, sent), "rank-vectors")
    else:
        every = stage(_vectors(source).withColumn("row", F.monotonically_increasing_id()), "rank-terms")
        pairs = _pairs(every, "row", "doc_id", "n").join(vocabulary, "term", "left_semi")
        lists = pairs.groupBy("row", "doc_id", "n").agg(F.collect_list(F.struct("term", "tf")).alias("t"))
        vectors = stage(lists.select("doc_id", "n", F.col("t.term").alias("terms"), F.col("t.tf").alias("tfs")), "rank-vectors")
    total = every.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = stage(asked.join(frequencies, "term").withColumn("w", weights("df", total[0])), "rank-weights")
    groups = -(-asked.count() // GROUP_ROWS) or 1
    dealt = F.pmod(F.xxhash64("item"), F.lit(groups))
    ready = vectors.select("doc_id", length_factors("n", *total).alias("m"), "terms", "tfs").filter(F.size("terms") > 0)
    found = None
    for g in range(groups):
        rows = weighed.filter(dealt == g).toPandas()  # one group's items
        sent = spark.sparkContext.broadcast(_group(rows))
        part = ready.mapInArrow(_searcher(sent, k), "item string, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.join(named.drop("text"), "item").select("item_id", "rank", "doc_id", "score")
