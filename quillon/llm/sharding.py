"""Contiguous shards of near-equal bytes, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import guarded, materialise

SHARDS = 40
#: Bytes that every row costs besides its text.
ROW_BYTES = 16


def shard_by_bytes(keyed: DataFrame, shards: int = SHARDS, order: tuple[str, ...] = ("key",)) -> DataFrame:
    """Cut rows, in the order given, into contiguous shards of near-equal bytes.

    keyed: columns (key, size, ...), small rows without texts. Adds shard (0 to shards - 1) and
    slot (0, 1, ... within the shard). The rows are ranged into partitions by the order and
    written once; each partition's total gives its offset by a prefix sum over partitions, a
    running sum inside the partition gives each row's place, and a row goes to the shard that
    holds the middle of its bytes. A shard differs from the mean by at most the largest row.
    Nulls come first; equal rows are interchangeable and keep one order, fixed by the written
    table, which also lets a key that many rows share spread over partitions. Empty in, empty out.
    """
    tie = F.monotonically_increasing_id()
    ranged = keyed.withColumn("_tie", tie).repartitionByRange(*order, "_tie").withColumn("_part", F.spark_partition_id())
    rows = materialise(ranged)
    totals = rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
        F.sum("_bytes").over(Window.partitionBy(F.lit(0))).alias("_total"))
    offsets = guarded(materialise(offsets))
    inside = Window.partitionBy("_part").orderBy(*order, "_tie")
    placed = rows.withColumn("_sum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                             ).withColumn("_n", F.row_number().over(inside)).join(offsets, "_part")
    # twice the middle of the row's bytes, so that all is in whole numbers
    shard = F.expr(f"least({shards - 1}, (2 * (_byte0 + _sum) - size) * {shards} div (2 * _total))").cast("int")
    placed = placed.withColumn("shard", shard).withColumn("_row", F.col("_row0") + F.col("_n") - 1)
    placed = materialise(placed.drop("_sum", "_n", "_byte0", "_row0", "_total"))
    first = guarded(materialise(placed.groupBy("shard").agg(F.min("_row").alias("_first"))))
    return (placed.join(first, "shard").withColumn("slot", F.col("_row") - F.col("_first"))
            .drop("_row", "_first", "_part", "_tie"))


def op2(docs: DataFrame) -> DataFrame:
    """All documents over 40 shards by the law 'bytes', in doc_id order.

    size: UTF-8 bytes of the text (null: none) plus 16; text_crc32 of a null text is that of no bytes.
    Null ids come first; rows of one id stand by text_crc32 and size, and repeated rows in any order
    among themselves. A text longer than a shard's target has its shard almost alone, and shards
    beside it may be empty. Empty in, empty out; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
                        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    out = shard_by_bytes(keyed, SHARDS, ("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
