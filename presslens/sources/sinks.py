"""Table store and prediction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from presslens.functions.expr import clicked_int
from presslens.functions.grouping import scratch_folder
from presslens.operators.audit import Field, validate_table

# lists longer than this are first joined in pieces, so that no task holds all candidate rows of a list
PIECE = 10_000


def write_store(df: DataFrame, schema: dict[str, Field], dataset: str, path: str, bundle: str, split: str,
                table: str, sort_by: list[str]) -> DataFrame:
    """Validate, write in a fixed order, read back and validate again; returns the re-read table.

    Layout: ``path/table/dataset=/bundle=/split=``, range partitioned and sorted by ``sort_by``.
    """
    # stored first: the checks and the sorted write then read rows, instead of computing them twice
    kept = scratch_folder(df.sparkSession, table)
    df.write.parquet(kept)
    rows = df.sparkSession.read.schema(df.schema).parquet(kept)
    validate_table(rows, schema, dataset)
    target = f"{path}/{table}"
    tagged = rows.drop("dataset").withColumns({"dataset": F.lit(dataset), "bundle": F.lit(bundle), "split": F.lit(split)})
    ordered = tagged.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    # only the partition being written is replaced
    (ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dataset", "bundle", "split").parquet(target))
    again = df.sparkSession.read.parquet(target).filter(
        (F.col("dataset") == dataset) & (F.col("bundle") == bundle) & (F.col("split") == split))
    validate_table(again, schema, dataset)
    return again


def _lines(df: DataFrame, value, row_no: str) -> DataFrame:
    """One line ``id [v1,...,vn]`` per impression in candidate order."""
    keys = list(dict.fromkeys(["impression_id", row_no]))
    rows = df.select(*keys, "position", value.cast("string").alias("_v"))
    pieces = rows.groupBy(*keys, F.floor(F.col("position") / PIECE).alias("_piece")).agg(
        F.sort_array(F.collect_list(F.struct("position", "_v"))).alias("_r"))
    texts = pieces.select(*keys, "_piece", F.array_join(F.transform("_r", lambda r: r["_v"]), ",").alias("_v"))
    packed = texts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_piece", "_v"))).alias("_r"))
    body = F.array_join(F.transform("_r", lambda r: r["_v"]), ",")
    line = F.concat(F.col("impression_id").cast("string"), F.lit(" ["), body, F.lit("]"))
    return packed.select(*keys, line.alias("line"))


def prediction_lines(ranked: DataFrame, row_no: str = "impression_id") -> DataFrame:
    """(impression_id, line) with the ranks; ``row_no`` is the raw row number that orders the file."""
    return _lines(ranked, F.col("rank").cast("long"), row_no)


def truth_lines(imp: DataFrame, row_no: str = "impression_id") -> DataFrame:
    """The same with 0/1 labels."""
    return _lines(imp, clicked_int(), row_no)


def write_lines(lines: DataFrame, path: str, row_no: str = "impression_id") -> None:
    """Text files whose concatenation in name order is the ordered file."""
    ordered = lines.repartitionByRange(row_no).sortWithinPartitions(row_no)
    ordered.select("line").write.mode("overwrite").text(path)


def write_predictions(ranked: DataFrame, path: str, row_no: str = "impression_id") -> int:
    """Write prediction lines; fails unless there is one line per impression. Returns the number of lines.

    The impressions are counted while they are written, so the scores are computed once.
    """
    seen = Observation()
    lines = prediction_lines(ranked, row_no).observe(seen, F.count("*").alias("impressions"))
    folder = scratch_folder(ranked.sparkSession, "lines")
    lines.write.parquet(folder)
    write_lines(ranked.sparkSession.read.parquet(folder), path, row_no)
    written, expected = ranked.sparkSession.read.text(path).count(), seen.get["impressions"]
    if written != expected:
        raise ValueError(f"{written} lines written for {expected} impressions")
    return written


def write_truth(imp: DataFrame, path: str, row_no: str = "impression_id") -> None:
    write_lines(truth_lines(imp, row_no), path, row_no)
