"""Token-id output as ORC.

Documents are dealt by ranges of their id and sorted inside each range, so file k holds smaller ids than file
k + 1. Ids are stored as array<int>, which ORC writes with integer run-length encoding; row indexes and a Bloom
filter on the document id let a reader skip files, stripes and row groups. Stripes are read in parallel.

The string of an added token in a text becomes that token's id, as the library's plain call has it. Null and empty
text become the end id alone. Ids are integers, others are refused. A null document id sorts first, as ORC's own sort has it;
rows of one document id are
ordered by their text's hash, and identical rows stay as often as they occur. An empty table gives an empty
folder with a schema. Other columns than document id and text are not written.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.pretokens import BatchEncoder, slices
from millrace.llm.scratch import doc_ids, stage

#: Text of a range, and so of a task and a file; ranges grow with the table only beyond MOST_RANGES (25 TB).
RANGE_BYTES, MOST_RANGES = 256 << 20, 100_000
SCHEMA = "part int, doc_id long, tie long, ids array<int>"


def _byte_chars() -> str:
    """The character that byte-level vocabularies write for each byte: itself where it prints, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(other)) for b in range(256))


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """Encodes lists of texts as the library does without special tokens: all ids in a row, and where each text's start.

    Where the file asks for plain byte-level pre-tokens, equal pre-tokens are merged once. Texts that hold the string
    of an added token (which the library finds before it looks for pre-tokens) are left to the library.
    """
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    spec = json.loads(t.to_str())
    pre = spec["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]

    def each(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in rows for i in x], np.int32), np.cumsum([0, *map(len, rows)])

    if not plain or spec["normalizer"] or spec["model"]["type"] != "BPE":
        return each
    merge, chars = t.model.tokenize, _byte_chars()
    batch = BatchEncoder(lambda tokens: [[y.id for y in merge(codecs.charmap_decode(x.encode(), "strict", chars)[0])] for x in tokens])
    added = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = [k for k, x in enumerate(texts) if added.search(x)]
        if not special:
            return batch(texts)
        held = set(special)
        ids, bounds = batch(["" if k in held else x for k, x in enumerate(texts)])
        rows = np.split(ids, bounds[1:-1])
        own, own_bounds = each([texts[k] for k in special])
        for k, row in zip(special, np.split(own, own_bounds[1:-1]), strict=True):
            rows[k] = row
        return np.concatenate(rows), np.cumsum([0, *map(len, rows)])

    return encode


def _encoder(vocab: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encode = tokenizer(vocab)
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(pc.binary_length(text).to_pylist()):
                ids, bounds = encode(text.slice(a, b - a).to_pylist())
                ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in ("part", "doc_id", "tie")], lists], ["part", "doc_id", "tie", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, vocab: str, end_id: int = 0, stripe_mb: int = 64, range_bytes: int = RANGE_BYTES) -> None:
    """Writes (part, doc_id, tie, ids) in ascending document id; part numbers the files' ranges in that order.

    There are as many ranges as shuffle partitions, and more where a range would hold more than range_bytes of text.
    """
    spark = docs.sparkSession
    doc_ids(docs)  # refuses other ids than integers
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // range_bytes + 1), MOST_RANGES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "tie", "text").mapInArrow(_encoder(vocab, end_id), SCHEMA)
    rows.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option(
        "orc.row.index.stride", "1000"
    ).option("orc.stripe.size", stripe_mb << 20).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    for batch in batches:
        ids = batch.column("ids")
        sums = [zlib.crc32(x.values.to_numpy().astype("<u4", copy=False)) for x in ids]
        columns = [*[batch.column(c) for c in ("part", "doc_id", "tie")], pa.array(pc.list_value_length(ids), pa.int64()), pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "tie", "n_tokens", "ids_crc32"])


def index(tokens: DataFrame) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32. start counts the ids of all rows before it.

    A range's running sum needs the range alone; what precedes it is the sum of the earlier ranges' totals, of
    which there are as many as files.
    """
    rows = stage(tokens.mapInArrow(_checked, "part int, doc_id long, tie long, n_tokens long, ids_crc32 long"), "token-index")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    # as many rows as files were written: MOST_RANGES at most
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
