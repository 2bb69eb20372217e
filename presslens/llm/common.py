"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Fixed value: the characters that separate words, ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, unless PYTHONPATH is set for them."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session.

    A local session without that setting (tests) gets a folder of its own once.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="presslens-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, for the files that tasks write themselves."""
    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def read_flat(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A flat file as an array: mapped into memory where the folder is local or mounted, else read."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if store.get_file_info(path).size else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=kind)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage with replicated storage: whatever reads the result survives lost
    executors, and row ids or partition numbers in it can no longer change.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names made from ``wanted`` that ``df`` does not have yet (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def unit_hash(*cols: Column) -> Column:
    """Reproducible number in [0, 1) from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def count_words(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts 0."""
    return F.size(F.filter(F.split(text_or_empty(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def matching_rows(docs: DataFrame, plan: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose (id, text hash) is in ``plan`` (doc_id, text_hash, and ``copies`` if rows repeat), all columns kept.

    Of rows equal in id and text one stands for all.
    """
    text_hash, number, plan_id, plan_hash, copies = free_names(docs, "x_text_hash", "x_number", "x_id", "x_plan_hash", "x_copies")
    asked = plan.columns
    times = F.col("copies") if "copies" in asked else F.lit(1).cast("long")
    plan = plan.select(F.col("doc_id").alias(plan_id), F.col("text_hash").alias(plan_hash), times.alias(copies))
    rows = docs.withColumn(text_hash, F.xxhash64(text_or_empty(text_col))).join(
        plan, F.col(id_col).eqNullSafe(F.col(plan_id)) & (F.col(text_hash) == F.col(plan_hash)))
    equal = W.partitionBy(plan_id, text_hash).orderBy(F.lit(1))
    single = rows.withColumn(number, F.row_number().over(equal)).filter(F.col(number) == 1)
    if "copies" in asked:
        single = single.withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return single.select(*docs.columns)


def row_slices(batches: Iterable[pa.RecordBatch], text: int = 1, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches of a task in slices of bounded text size (a row at least); column ``text`` holds the texts."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)
