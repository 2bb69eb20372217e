"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are put in one global order (id, then size, checksum and text hash) by a range
partitioning of slim rows; texts never shuffle. Every slice sums its own bytes and
counts its rows, the totals of the slices before it (one row a slice) are added
back, and the global prefix decides the shard: shard s takes the rows whose middle
byte lies in [s, s + 1) / n_shards of all bytes. A shard therefore differs from the
target by one row at most on either side, and is one contiguous piece of the order.

Null text counts no bytes (a row still counts ``overhead``). Null ids come first.
Rows equal in id and text are interchangeable. No rows give no rows. Copies of a text
are not kept together: the cut follows the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from presslens.llm.common import stored, text_or_empty


def byte_shards(docs: DataFrame, n_shards: int, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (position in the shard, gapless from 0)."""
    text = text_or_empty(text_col)
    slim = stored(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        F.monotonically_increasing_id().alias("row")), "sizes")
    order = [F.col(c) for c in ("doc_id", "size", "text_crc32", "text_hash", "row")]
    # stored: the slice of a row is part of the result from here on
    sliced = stored(slim.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "slices")
    totals = sliced.groupBy("slice").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # one row a slice
    bases = stored(totals.select("slice", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                                 F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
                                 F.sum("bytes").over(W.partitionBy()).alias("all_bytes")), "bases")
    inside = W.partitionBy("slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = (sliced.withColumns({"upto": F.sum("size").over(inside), "number": F.row_number().over(inside).cast("long")})
              .join(F.broadcast(bases), "slice"))  # as many rows as slices
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    # as a quotient of decimals: the product exceeds 64 bits from some exabytes on
    share = F.floor((middle.cast("decimal(24,0)") * n_shards) / (2 * F.col("all_bytes")).cast("decimal(24,0)"))
    cut = placed.select("doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("number") - 1).alias("position"),
                        F.least(share, F.lit(n_shards - 1)).cast("int").alias("shard"))
    first = cut.groupBy("shard").agg(F.min("position").alias("first"))  # n_shards rows
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"))
