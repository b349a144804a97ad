"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text (white-space runs replaced by one space, null as empty) is cut into blocks of a fixed number of
characters. The distinct blocks are sorted and numbered, so a block's integer name stands for its content. Then
neighbouring names are paired, the distinct pairs sorted and numbered again, and so on until one name is left:
(level, name) is equal for two texts exactly if the texts are equal, however long they are.

Names are ranks: distinct blocks (pairs) are dealt by ranges, sorted in each range and counted on from range to range,
so they do not depend on the number of partitions. Blocks are in order of their first characters, then of a 128-bit
digest. A block's text travels once, to be made distinct; afterwards it is looked up by its digest, so that neither
the sort nor the bounds of its ranges, which the driver draws, hold texts. Numbering also
counts the digests, and if two different blocks ever share one, other seeds are taken: names are free of
collisions by check, not by assumption.

Nulls: a null text is the empty text; a null doc_id counts as larger than any other. Of several rows with the
smallest doc_id one stays. Repeated rows are separate members of their group. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import stage

BLOCK_CHARS = 4096
#: Characters of a block that its place in the order begins with.
START_CHARS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _blocks(text: Column, size: int) -> Column:
    """Blocks of `size` characters, in order; one empty block for the empty text."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(cut)


def _digest(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("h1"), F.xxhash64(F.lit(2 * seed + 1), block).alias("h2"))


def _named(distinct: DataFrame, order: list[str], label: str) -> DataFrame:
    """Distinct rows with name, their rank (from 0) in the order of all of them; the start of a block goes."""
    spark = distinct.sparkSession
    kept = [c for c in distinct.columns if c != "start"]
    dealt = stage(distinct, f"{label}-distinct").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # the id of a row is its partition's number, then its place in it
    placed = stage(dealt.select(*kept, F.monotonically_increasing_id().alias("id")), label).select(*kept, F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), "part").select(*kept, (F.col("place") + F.col("offset")).alias("name"))  # a row for each partition


def block_identities(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: row_id, doc_id, text_sha256 (binary), level, name."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    seed = 0
    while True:
        rows = stage(
            text.select(
                F.monotonically_increasing_id().alias("row_id"),
                "doc_id",
                F.unhex(F.sha2("text", 256)).alias("sha"),
                F.transform(_blocks(F.col("text"), block_chars), lambda b: _digest(b, seed)).alias("digests"),
            ),
            "rows",
        )
        distinct = text.select(F.explode(_blocks(F.col("text"), block_chars)).alias("block")).select(_digest(F.col("block"), seed).alias("d"), "block")
        distinct = distinct.select("d.h1", "d.h2", "block").distinct()
        names = _named(distinct.select("h1", "h2", F.substring("block", 1, START_CHARS).alias("start")), ["start", "h1", "h2"], "names")
        if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            break
        seed += 1
    size = rows.agg(F.max(F.size("digests"))).first()[0] or 0
    exploded = rows.select("row_id", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "d"))
    current = stage(exploded.select("row_id", "n", "pos", "d.h1", "d.h2").join(names, ["h1", "h2"]).select("row_id", "n", "pos", "name"), "level0")
    done, level = [current.filter("n = 1").select("row_id", F.lit(0).alias("level"), "name")], 0
    while size > 1:
        size, level = (size + 1) // 2, level + 1
        pairs = current.filter("n > 1").groupBy("row_id", "n", F.expr("pos div 2").cast("int").alias("pos"))
        pairs = pairs.agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = stage(pairs, f"pairs{level}")
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], f"names{level}")
        named = pairs.join(names, ["a", "b"]).select("row_id", F.expr("cast((n + 1) div 2 as int)").alias("n"), "pos", "name")
        current = stage(named, f"level{level}")
        done.append(current.filter("n = 1").select("row_id", F.lit(level).alias("level"), "name"))
    ended = done[0]
    for x in done[1:]:
        ended = ended.union(x)
    return rows.select("row_id", "doc_id", "sha").join(ended, "row_id")


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Rows with equal text form a group."""
    rows = stage(block_identities(docs, block_chars), "identities")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    groups = stage(rows.groupBy("level", "name").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    return rows.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("first.row_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
