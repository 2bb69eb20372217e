"""Restartable scoring of arriving impression files.

A batch is committed in two phases: its lines go to a folder of its own, named by the
stream's id and the batch, and then one row in the manifest says that the folder counts.
Readers see only what the manifest names, so a batch that broke off shows nothing.

The ids already scored are keyed state of the stream (RocksDB, written as changes), so a
batch costs what it holds, whatever has been written before. The state goes with its
checkpoint. Where another checkpoint's stream has written, the state is filled first: the
committed lines are a second input of the stream, and a first run takes them alone, before
any impression file.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from presslens.functions.grouping import checkpointed
from presslens.operators.metrics import rank_candidates
from presslens.sources.sinks import prediction_lines

SCHEMA = "impression_id bigint, user_id bigint, impression_time timestamp_ntz, article_ids_inview array<bigint>"
_LINES = "impression_id bigint, line string, run string, batch bigint"
_MANIFEST = "run string, batch bigint"
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
#: No file has this name: the run that fills the state takes no impressions.
_NO_FILE = "none.of.these"


def stream_predictions(spark: SparkSession, impressions_dir: str, out_dir: str, checkpoint_dir: str,
                       scorer: Callable[[DataFrame], DataFrame], schema: str = SCHEMA, seed: int = 0,
                       max_files: int | None = None):
    """Score every impression once and write prediction lines; returns the finished query.

    The input unit is the whole impression, so a candidate list never spans two batches.
    An id that comes again, in any file, is left as it is. After a failure the stream goes
    on from its checkpoint; with a new checkpoint folder (the old one lost) all files are
    read again, and what is already committed is neither scored nor written again.
    An older checkpoint may be taken up again unless its last batch broke off. One stream at
    a time may write to ``out_dir``.
    """
    _refuse_other_input(spark, impressions_dir, out_dir)
    spark.createDataFrame([], "impression_id bigint, line string").write.mode("ignore").parquet(f"{out_dir}/lines/run=none/batch=0")
    spark.createDataFrame([], _MANIFEST).write.mode("ignore").parquet(f"{out_dir}/manifest")
    before = {key: spark.conf.get(key, None) for key in _STATE}
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    try:
        if not _manifest(spark, out_dir).filter(F.col("run") != _stream_id(spark, checkpoint_dir)).isEmpty():
            _run(spark, impressions_dir, out_dir, checkpoint_dir, scorer, schema, seed, {"pathGlobFilter": _NO_FILE})
        return _run(spark, impressions_dir, out_dir, checkpoint_dir, scorer, schema, seed,
                    {"maxFilesPerTrigger": str(max_files)} if max_files else {})
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _run(spark, impressions_dir, out_dir, checkpoint_dir, scorer, schema, seed, options):
    def score(batch: DataFrame, batch_id: int) -> None:
        run = _stream_id(spark, checkpoint_dir)
        fresh = checkpointed(batch.filter("not _written").drop("_written"))  # the state is read and changed once
        done = _manifest(spark, out_dir).filter((F.col("run") == run) & (F.col("batch") == batch_id))
        if fresh.isEmpty() or not done.isEmpty():
            return
        rows = fresh.select(*[c for c in fresh.columns if c != "article_ids_inview"],
                            F.posexplode("article_ids_inview").alias("position", "article_id"))
        lines = prediction_lines(rank_candidates(scorer(rows), seed, counted=rows))
        ordered = lines.repartitionByRange("impression_id").sortWithinPartitions("impression_id")
        ordered.select("impression_id", "line").write.mode("overwrite").parquet(f"{out_dir}/lines/run={run}/batch={batch_id}")
        spark.createDataFrame([(run, batch_id)], _MANIFEST).write.mode("append").parquet(f"{out_dir}/manifest")

    past = spark.readStream.schema(_LINES).parquet(f"{out_dir}/lines").join(_manifest(spark, out_dir), ["run", "batch"])
    new = spark.readStream.schema(schema).options(**options).parquet(impressions_dir).withColumn("_written", F.lit(False))
    ids = past.select("impression_id", F.lit(True).alias("_written"))
    known = new.unionByName(ids, allowMissingColumns=True).dropDuplicates(["impression_id"])
    query = known.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _stream_id(spark: SparkSession, checkpoint_dir: str) -> str:
    """The id Spark gives a stream with its checkpoint; empty before its first run."""
    try:
        return json.loads(spark.read.text(f"{checkpoint_dir}/metadata").first()[0])["id"]
    except AnalysisException:
        return ""


def _manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """(run, batch) of the folders that count."""
    return spark.read.schema(_MANIFEST).parquet(f"{out_dir}/manifest").distinct()


def _refuse_other_input(spark: SparkSession, impressions_dir: str, out_dir: str) -> None:
    """Continue only if the first and last impression already written belong to this input."""
    try:
        done = read_stream_predictions(spark, out_dir).agg(F.min("impression_id").alias("lo"), F.max("impression_id").alias("hi")).first()
    except AnalysisException:
        return  # nothing written yet
    if done.lo is None:
        return
    try:
        found = spark.read.parquet(impressions_dir).filter(F.col("impression_id").isin(done.lo, done.hi)).select(
            "impression_id").distinct().count()
    except AnalysisException:
        found = 0
    if found < len({done.lo, done.hi}):
        raise ValueError(f"{out_dir} holds predictions of other input than {impressions_dir}")


def read_stream_predictions(spark: SparkSession, out_dir: str) -> DataFrame:
    """All committed lines: (impression_id, line, run, batch)."""
    lines = spark.read.schema(_LINES).parquet(f"{out_dir}/lines")
    return lines.join(_manifest(spark, out_dir), ["run", "batch"]).select("impression_id", "line", "run", "batch")
