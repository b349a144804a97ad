"""Tasks of the pipeline's text stages, and the ids and bytes that they make in batches."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, pretokens, quality, scratch


def test_stages_read_bounded_parts_of_a_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).repartition(16).write.parquet(path)
    monkeypatch.setattr(scratch, "TASK_BYTES", 100_000, raising=False)
    split = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split), spark.read.parquet(path).rdd.getNumPartitions()
    with scratch.text_batches(spark):
        assert spark.read.parquet(path).rdd.getNumPartitions() >= 16 > before[1]  # a file is over TASK_BYTES
    assert (spark.conf.get(split), spark.read.parquet(path).rdd.getNumPartitions()) == before
    spark.conf.set(split, "1000b")
    try:
        with scratch.text_batches(spark):
            assert spark.conf.get(split) == "1000"  # a lower setting of the session's own holds
    finally:
        spark.conf.set(split, before[0])


def test_ids_of_many_texts_decode_to_their_bytes_at_once():
    c = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), bpe.PATTERN)
    texts = ["", "A plain text, 12 words' worth.", "", "\x00 \x00é😀 zqxj zqxj", "  \n", ""]
    ids, bounds = c.encode(texts)
    data, at = c.decode(ids, bounds)
    assert [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == [x.encode() for x in texts]
    assert c.decode(np.zeros(0, np.int32), np.zeros(1, np.int64))[0] == b""


@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_remembered_pretokens_keep_their_ids(limit):
    asked = []

    def encode_new(tokens):
        asked.extend(tokens)
        return [list(x.encode()) for x in tokens]

    batch = pretokens.BatchEncoder(encode_new, limit)
    for texts in (["aa bb", "aa"], ["cc aa", "", "bb aa dd"], ["aa bb", "é cc"], ["dd"]):
        ids, at = batch(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [list(x.encode()) for x in texts]
        assert batch.ids.size == sum(len(x.encode()) for x in batch.known)
    assert limit < 1000 or len(asked) == len(set(asked))


def test_features_are_shares_of_all_runs_of_four_classes():
    table = quality._byte_classes().astype(int)
    for text in ("a", "ab! #", "Ä1, 2\n\nxyz", "word word word"):
        kinds = [quality.LINE, quality.LINE, *(table[b] for b in text.encode()), quality.LINE]
        runs = [((a * 8 + b) * 8 + c) * 8 + d for a, b, c, d in zip(kinds, kinds[1:], kinds[2:], kinds[3:], strict=False)]
        expected = np.bincount(quality._SLOT[runs], minlength=quality.DIMENSIONS) / len(runs)
        n, repeats, _ = quality._words(text.split())
        expected[quality._REPEAT_SLOTS[np.searchsorted(quality._REPEAT_BINS, repeats)]] += 1
        assert n < 40 and np.allclose(quality.features(text)[: quality.DIMENSIONS], expected, rtol=1e-12)
