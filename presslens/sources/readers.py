"""Readers for the two click-log layouts, vector files and prediction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: columns of the tab-separated files and of the Parquet bundle
CATALOG_COLUMNS = ["id", "category", "subcategory", "title", "abstract", "url", "title_entities", "abstract_entities"]
BEHAVIOR_COLUMNS = ["impression_id", "user_id", "time", "history", "impressions"]
TIME_FORMAT = "M/d/yyyy h:mm:ss a"
REQUEST_COLUMNS = {
    "impression_id": "long", "user_id": "long", "impression_time": "timestamp_ntz", "article_id": "long",
    "article_ids_inview": "array<bigint>", "read_time": "double", "scroll_percentage": "double",
    "device_type": "int", "is_sso_user": "boolean", "is_subscriber": "boolean", "gender": "double",
    "age": "double", "session_id": "long",
}
HISTORY_REQUIRED = {"user_id": "long", "article_id_fixed": "array<bigint>", "impression_time_fixed": "array<timestamp_ntz>"}
HISTORY_OPTIONAL = {"read_time_fixed": "array<double>", "scroll_percentage_fixed": "array<double>"}
# fixed values: known only after the fact, never allowed into features
FORBIDDEN_COLUMNS = ["total_inviews", "total_pageviews", "total_read_time", "next_read_time", "next_scroll_percentage"]


def _read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    # quotes and escapes are plain text in these files
    return (spark.read.schema(schema).option("sep", "\t").option("nullValue", "").option("quote", "")
            .option("escape", "").option("emptyValue", "").csv(path))


def read_catalog_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Articles, eight columns without header; empty strings are null."""
    return _read_tsv(spark, path, CATALOG_COLUMNS)


def read_behaviors_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Impressions, five columns without header, with ``impression_time`` parsed."""
    raw = _read_tsv(spark, path, BEHAVIOR_COLUMNS)
    return raw.withColumn("impression_time", F.to_timestamp_ntz("time", F.lit(TIME_FORMAT))).drop("time")


def forbid_columns(columns: list[str], source: str = "input") -> None:
    """Refuse columns that do not exist at serving time, before anything is read."""
    bad = sorted(set(columns) & set(FORBIDDEN_COLUMNS))
    if bad:
        raise ValueError(f"columns {bad} of {source} are only known after the impression")


def read_columns(spark: SparkSession, path: str, columns: list[str], where: Column | None = None,
                 users: DataFrame | None = None) -> DataFrame:
    """Column subset with a row filter, both pushed into the Parquet scan; ``users`` keeps those users' rows."""
    forbid_columns(columns, path)
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    if users is not None:
        df = df.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return df.select(*columns)


def tolerant(df: DataFrame, required: dict[str, str], optional: dict[str, str], source: str = "input") -> DataFrame:
    """Required then optional columns in fixed order and type; an absent optional one is null."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{source} lacks required columns {missing}")
    forbid_columns([*required, *optional], source)
    return df.select(
        *[F.col(c).cast(t).alias(c) for c, t in required.items()],
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in optional.items()])


def read_tolerant(spark: SparkSession, path: str, required: dict[str, str], optional: dict[str, str]) -> DataFrame:
    return tolerant(spark.read.parquet(path), required, optional, path)


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """Impressions of the Parquet bundle; only ids, user, time and list are required."""
    need = ["impression_id", "user_id", "impression_time", "article_ids_inview"]
    return read_tolerant(spark, path, {c: REQUEST_COLUMNS[c] for c in need},
                         {c: t for c, t in REQUEST_COLUMNS.items() if c not in need})


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Histories of the Parquet bundle; engagement columns are optional."""
    return read_tolerant(spark, path, HISTORY_REQUIRED, HISTORY_OPTIONAL)


def read_vectors(spark: SparkSession, path: str, sep: str = "\t", dim: int | None = None,
                 skip_blank: bool = True) -> DataFrame:
    """(id, vec) from text lines ``id v1 ... vn``; malformed lines are dropped.

    ``skip_blank`` tolerates stray separators; without it a line must have exactly
    dim + 1 fields.
    """
    quoted = "\\t" if sep == "\t" else f"\\Q{sep}\\E"
    fields = F.split("value", quoted)
    if skip_blank:
        fields = F.filter(fields, lambda x: x != "")
    rows = spark.read.text(path).select(fields.alias("_f")).filter(F.size("_f") >= 2)
    vec = F.transform(F.slice("_f", F.lit(2), F.size("_f") - 1), lambda x: x.try_cast("float"))
    rows = rows.select(F.element_at("_f", 1).alias("id"), vec.alias("vec"))
    good = ~F.exists("vec", lambda x: x.isNull())
    if dim is not None:
        good = good & (F.size("vec") == dim)
    return rows.filter(good)


def read_line_file(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(impression_id, value array<int>) from lines ``id [v1,...,vn]``; a malformed line fails the job."""
    return parse_lines(spark.read.text(path).select(F.col("value").alias("line")), value)


def parse_lines(lines: DataFrame, value: str) -> DataFrame:
    pattern = r"^(\S+) (\[(?:-?\d+(?:,-?\d+)*)?\])$"
    bad = F.raise_error(F.concat(F.lit("malformed line: "), F.substring("line", 1, 80)))
    body = F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 2)).otherwise(bad.cast("string"))
    return lines.select(F.regexp_extract("line", pattern, 1).alias("impression_id"),
                        F.from_json(body, "array<int>").alias(value))


def read_predictions(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(impression_id, position, label, rank) from parsed prediction and truth lines.

    An empty label list masks its impression; a missing prediction line counts as all
    ranks 1; an unknown id, a wrong length or a rank below 1 fails the job.
    """
    both = truth.withColumn("_t", F.lit(True)).join(predictions.withColumn("_s", F.lit(True)), "impression_id", "full")

    def fail(text):
        return F.raise_error(F.concat(F.lit(text + " for impression "), F.col("impression_id"))).cast("array<int>")

    n = F.size("labels")
    ranks = (F.when(F.col("_t").isNull(), fail("no truth line"))
             .when(n == 0, F.array().cast("array<int>"))
             .when(F.col("_s").isNull(), F.array_repeat(F.lit(1), n))
             .when(F.size("ranks") != n, fail("wrong number of ranks"))
             .when(F.exists("ranks", lambda r: r < 1), fail("rank below 1"))
             .otherwise(F.col("ranks")))
    rows = both.select("impression_id", "labels", ranks.alias("ranks")).filter(F.size("ranks") > 0)
    zipped = rows.select("impression_id", F.posexplode(F.arrays_zip("labels", "ranks")).alias("position", "_z"))
    return zipped.select("impression_id", "position", F.col("_z.labels").alias("label"), F.col("_z.ranks").alias("rank"))
