"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # timestamps without zone are read as UTC wall time
    "spark.sql.session.timeZone": "UTC",
    # joins, partition counts and skew are settled from sizes measured at run time
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even if that costs the plan one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # hash join instead of sort where every partition of one side was measured to be small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


#: A task's tables in memory take about 30 times its compressed rows of a click log, so a task reads no more of these than this.
TASK_BYTES = 16 << 20
#: Partitions a shuffle has at least before small ones are put together.
FINE_PARTITIONS = 512


def prepare_click_log_session(spark: SparkSession) -> SparkSession:
    """:func:`prepare_session`, with the shuffled rows of one task bounded however large the tables are.

    Stored tables cut a query into several jobs; the shuffle files of a job go when it ends.
    """
    prepare_session(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    # rows of packed tables are large
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)
    partitions = max(FINE_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", partitions)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    return spark
