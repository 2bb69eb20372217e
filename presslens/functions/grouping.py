"""Ordering work inside groups that may be too large for one task.

A plain window sorts a whole group in one task. That is right for ordinary
groups and wrong for a key that holds a large share of all rows. The helpers
here count the groups first (map-side combined, so cheap) and send only the
groups above a limit through a range partitioning on (key, order): every slice
is summed on its own and the totals of the slices before it are added back.
Slices have a bounded number of rows; their number grows with the rows, whatever
limit marks a group as oversized.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

HOT_ROWS = 1_000_000
_own_folders: list[tempfile.TemporaryDirectory] = []


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a local run without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        own = tempfile.TemporaryDirectory(prefix="presslens-checkpoint-")  # goes when Python ends
        _own_folders.append(own)
        folder = own.name
    sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame, by: str | None = None) -> DataFrame:
    """The table written as Parquet to the shared folder and read back: lineage is cut, readers prune columns.

    With ``by`` each value of that column has a folder of its own, and a filter on it reads no other.
    """
    folder = scratch_folder(df.sparkSession, "table")
    (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, which all executors share."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def hot_groups(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame | None:
    """Keys with more than ``limit`` rows (column ``_n``), or None if there are none.

    At most rows/limit keys can qualify, which bounds the result.
    """
    limit = limit or HOT_ROWS
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    return None if hot.isEmpty() else checkpointed(hot)


def _slices(spark: SparkSession, rows: int, limit: int | None) -> int:
    """Slices of about ``limit`` rows; a low limit makes no more of them than a shuffle has partitions, or than HOT_ROWS asks for."""
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / HOT_ROWS))
    return max(1, min(math.ceil(rows / (limit or HOT_ROWS)), most))


def _sliced_sums(df: DataFrame, keys, order, sums: dict, slices: int) -> DataFrame:
    ranged = df.repartitionByRange(slices, *[F.col(k) for k in keys], *order)
    # The slice number must not change between the two uses below, also after
    # an executor is lost, hence the checkpoint.
    tagged = checkpointed(ranged.withColumn("_slice", F.spark_partition_id()))
    inside = W.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = tagged.select("*", *[F.sum(v).over(inside).alias(o) for o, v in sums.items()])
    totals = tagged.groupBy("_slice", *keys).agg(*[F.sum(v).alias(o) for o, v in sums.items()])
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        "_slice", *keys,
        *[F.coalesce(F.sum(o).over(earlier), F.lit(0)).alias(f"_before_{o}") for o in sums],
    )
    joined = local.join(before, ["_slice", *keys])  # one row per (slice, key)
    return joined.withColumns({o: F.col(o) + F.col(f"_before_{o}") for o in sums}).drop(
        "_slice", *[f"_before_{o}" for o in sums])


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column],
                 hot_limit: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Add inclusive running sums within each key; ``order`` must be total in a key.

    ``counted`` is a table with the same groups that is cheaper to count than ``df``
    (the candidates before scoring, say), so that ``df`` is computed only once.
    """
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)

    def plain(part: DataFrame) -> DataFrame:
        return part.select("*", *[F.sum(v).over(inside).alias(o) for o, v in sums.items()])

    hot = hot_groups(df if counted is None else counted, keys, hot_limit)
    if hot is None:
        return plain(df)
    rows = hot.agg(F.sum("_n")).first()[0]
    hot_keys = hot.select(*keys)
    cool = plain(df.join(hot_keys, keys, "left_anti"))
    warm = _sliced_sums(df.join(hot_keys, keys, "left_semi"), keys, order, sums, _slices(df.sparkSession, rows, hot_limit))
    return cool.unionByName(warm)


def row_numbers(df: DataFrame, keys: list[str], order: list[Column] | dict[str, list[Column]], out: str | None = None,
                hot_limit: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """1-based position of each row in its key; an order must be total in a key.

    Several orders (``{out: order}``) share one check for hot groups and one shuffle.
    """
    orders = order if isinstance(order, dict) else {out: order}

    def plain(part: DataFrame) -> DataFrame:
        return part.select("*", *[F.row_number().over(W.partitionBy(*keys).orderBy(*o)).cast("long").alias(n)
                                  for n, o in orders.items()])

    hot = hot_groups(df if counted is None else counted, keys, hot_limit)
    if hot is None:
        return plain(df)
    rows = hot.agg(F.sum("_n")).first()[0]
    hot_keys = hot.select(*keys)
    cool = plain(df.join(hot_keys, keys, "left_anti"))
    warm = df.join(hot_keys, keys, "left_semi")
    for name, o in orders.items():
        warm = _sliced_sums(warm, keys, o, {name: F.lit(1).cast("long")}, _slices(df.sparkSession, rows, hot_limit))
    return cool.unionByName(warm)


def medians(df: DataFrame, keys: list[str], cols: list[str], hot_limit: int | None = None) -> DataFrame:
    """Exact medians per key (nulls skipped) from value counts, never from one task's list of values."""
    out = None
    one = [] if keys else ["_all"]
    for c in cols:
        rows = df.select(*keys, *[F.lit(0).alias(k) for k in one], F.col(c).cast("double").alias("_v"))
        counts = rows.filter(F.col("_v").isNotNull()).groupBy(*keys, *one, "_v").agg(F.count("*").alias("_c"))
        upto = running_sums(counts, keys + one, [F.col("_v")], {"_upto": F.col("_c")}, hot_limit)
        total = counts.groupBy(*keys, *one).agg(F.sum("_c").alias("_n"))
        placed = upto.join(total, keys + one)
        lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
        def at(pos):
            return F.when((F.col("_upto") >= pos) & (F.col("_upto") - F.col("_c") < pos), F.col("_v"))
        picked = placed.groupBy(*keys, *one).agg(((F.max(at(lower)) + F.max(at(upper))) / 2.0).alias(c))
        out = picked if out is None else out.join(picked, keys + one, "full")
    return out.drop(*one)


def global_index(df: DataFrame, order: list[Column], out: str, hot_limit: int | None = None) -> DataFrame:
    """0-based position of each row in one total order over the whole table."""
    indexed = _sliced_sums(df, [], order, {out: F.lit(1).cast("long")}, _slices(df.sparkSession, df.count(), hot_limit))
    return indexed.withColumn(out, F.col(out) - 1)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str) -> DataFrame:
    """First k rows of each key. Spark cuts to k rows per key before the shuffle too."""
    numbered = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(out) <= k)
