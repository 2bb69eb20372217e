"""Projections, explodes, splits and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from presslens.functions.expr import prefix_id
from presslens.functions.grouping import global_index

UNKNOWN = "__unknown__"
# fixed values
SENTIMENT_LABELS = ["Negative", "Neutral", "Positive"]




def combine_entities(title_json, abstract_json) -> Column:
    """One JSON document with sorted keys, also inside; null, empty or broken input becomes ``[]``.

    Each input is parsed by itself, so a broken one does not cost the other.
    """
    def text(c):
        raw = F.col(c) if isinstance(c, str) else c
        # a variant keeps the fields of an object in the order of their names
        return F.coalesce(F.to_json(F.try_parse_json(F.when(F.trim(raw) != "", raw))), F.lit("[]"))
    return F.concat(F.lit('{"abstract_entities":'), text(abstract_json),
                    F.lit(',"title_entities":'), text(title_json), F.lit("}"))


def combine_entity_lists(ner_clusters: str, entity_groups: str) -> Column:
    """The same for a source that carries two string lists."""
    empty = F.array().cast("array<string>")
    return F.to_json(F.struct(
        F.coalesce(F.col(entity_groups).cast("array<string>"), empty).alias("entity_groups"),
        F.coalesce(F.col(ner_clusters).cast("array<string>"), empty).alias("ner_clusters")))


def unify_catalog(news: DataFrame, dataset: str) -> DataFrame:
    """``articles`` rows from the tab-separated catalogue."""
    return news.select(
        prefix_id(dataset, "id").alias("article_id"), F.lit(dataset).alias("dataset"), "title",
        F.coalesce("abstract", F.lit("")).alias("abstract"), F.lit(None).cast("string").alias("body"),
        "category", F.when(F.col("subcategory").isNotNull(), F.array("subcategory")).alias("subcategory"),
        combine_entities("title_entities", "abstract_entities").alias("entities"),
        F.lit(None).cast("array<string>").alias("topics"),
        F.lit(None).cast("timestamp_ntz").alias("article_published_time"))


def unify_bundle_articles(raw: DataFrame, dataset: str) -> DataFrame:
    """``articles`` rows from the Parquet bundle."""
    return raw.select(
        prefix_id(dataset, "article_id").alias("article_id"), F.lit(dataset).alias("dataset"), "title",
        F.col("subtitle").alias("abstract"), "body", F.col("category_str").alias("category"),
        F.col("subcategory").cast("array<string>").alias("subcategory"),
        combine_entity_lists("ner_clusters", "entity_groups").alias("entities"),
        F.col("topics").cast("array<string>").alias("topics"),
        F.col("published_time").cast("timestamp_ntz").alias("article_published_time"))


def explode_impressions(behaviors: DataFrame, labelled: bool = True, col: str = "impressions") -> DataFrame:
    """One row per ``id-label`` token (label after the last ``-``) or per bare ``id`` token."""
    keep = [c for c in behaviors.columns if c not in (col, "history")]
    rows = behaviors.select(*keep, F.posexplode(F.split(col, " ")).alias("position", "_token"))
    if not labelled:
        return rows.withColumnRenamed("_token", "article_id")
    return rows.withColumns({
        "article_id": F.regexp_extract("_token", r"^(.*)-([^-]*)$", 1),
        "clicked": F.regexp_extract("_token", r"^(.*)-([^-]*)$", 2) == "1",
    }).drop("_token")


def explode_inview(behaviors: DataFrame, shown: str = "article_ids_inview", clicks: str | None = "article_ids_clicked",
                   context: str = "article_id") -> DataFrame:
    """One row per shown candidate of an impression with array columns."""
    keep = [c for c in behaviors.columns if c not in (shown, clicks, context)]
    rows = behaviors.withColumn("is_front_page", F.col(context).isNull()).withColumnRenamed(context, "_context")
    rows = rows.select(*keep, "is_front_page", F.col("_context").alias("context_article_id"),
                       *([clicks] if clicks else []), F.posexplode(shown).alias("position", "article_id"))
    if clicks:
        hit = F.coalesce(F.array_contains(clicks, F.col("article_id")), F.lit(False))
        rows = rows.withColumn("clicked", hit).drop(clicks)
    return rows


def unify_impressions(rows: DataFrame, dataset: str, split: str) -> DataFrame:
    """Exploded candidate rows in the shared schema; columns a source lacks become typed nulls."""
    def optional(name, kind):
        return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind)
    cols = [
        prefix_id(dataset, "impression_id", split).alias("impression_id"), F.lit(dataset).alias("dataset"),
        prefix_id(dataset, "user_id").alias("user_id"), prefix_id(dataset, "article_id").alias("article_id"),
        F.col("impression_time").cast("timestamp_ntz").alias("impression_time"),
        *(["clicked"] if "clicked" in rows.columns else []),
        optional("session_id", "string").alias("session_id"),
        optional("read_time", "double").alias("dwell_time"),
        optional("scroll_percentage", "double").alias("scroll_percentage"),
        optional("is_front_page", "boolean").alias("is_front_page"),
        F.col("position").cast("int").alias("position")]
    return rows.select(*cols)


def parse_history(col, dataset: str | None = None) -> Column:
    """Space-separated ids to an array; null becomes the empty array."""
    c = F.col(col) if isinstance(col, str) else col
    ids = F.split(c, " ")
    if dataset:
        ids = F.transform(ids, lambda x: prefix_id(dataset, x))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(ids)


def static_history(behaviors: DataFrame, user: str = "user_id", history: str = "history") -> DataFrame:
    """One history per user; the job fails, naming a user, if a user's rows disagree."""
    text = F.coalesce(history, F.lit(""))
    per_user = behaviors.groupBy(user).agg(F.min(text).alias("_lo"), F.max(text).alias("_hi"))
    differs = F.raise_error(F.concat(F.lit("history differs between the rows of user "), F.col(user).cast("string")))
    return per_user.select(user, F.when(F.col("_lo") != F.col("_hi"), differs)
                           .otherwise(F.nullif("_lo", F.lit(""))).cast("string").alias(history))


def history_variants(behaviors: DataFrame, user: str = "user_id", history: str = "history") -> DataFrame:
    """Audit form: how many distinct histories each user's rows carry."""
    distinct = behaviors.select(user, F.coalesce(history, F.lit("")).alias("_h")).distinct()
    return distinct.groupBy(user).agg(F.count("*").alias("n_variants"))


def explode_history(history: DataFrame, arrays: dict[str, str], user: str = "user_id") -> DataFrame:
    """Parallel arrays to one row per click; ``arrays`` maps array column to output column.

    Positions count from ``start`` where the history has that column (a user's history in parts).
    """
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    first = F.col("start") if "start" in history.columns else F.lit(0)
    rows = history.select(user, first.cast("long").alias("_first"), F.posexplode(zipped).alias("_at", "_c"))
    rows = rows.withColumn("pos", F.col("_first") + F.col("_at"))
    return rows.select(user, "pos", *[F.col(f"_c.{a}").alias(o) for a, o in arrays.items()])


def recover_history_arrays(clicks: DataFrame, arrays: dict[str, str], user: str = "user_id",
                           part_size: int = 100_000) -> DataFrame:
    """Back to ordered arrays per user, in parts of at most ``part_size`` clicks.

    An ordinary user has the single part 0; a very long history is a sequence of
    rows, because one array value of unbounded length would not fit a task. ``start``
    is the position of a part's first click; positions in a part have no gaps.
    """
    part = F.floor(F.col("pos") / part_size)
    packed = clicks.groupBy(user, part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("pos", *arrays))).alias("_rows"))

    def column(name: str) -> Column:
        return F.transform("_rows", lambda r: r[name])

    return packed.select(user, "part", F.col("_rows")[0]["pos"].cast("long").alias("start"), *[column(c).alias(o) for c, o in arrays.items()])


def temporal_split(df: DataFrame, ts: str, boundaries: dict[str, tuple]) -> DataFrame:
    """Tag each row with the split whose half-open ``[start, end)`` holds it; others are dropped."""
    split = F.lit(None).cast("string")
    for name, (start, end) in boundaries.items():
        inside = F.lit(True)
        if start is not None:
            inside = inside & (F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            inside = inside & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
        split = F.when(inside, F.lit(name)).otherwise(split)
    return df.withColumn("split", split).filter(F.col("split").isNotNull())


def fit_vocab(df: DataFrame, col: str, unknown: str | None = UNKNOWN) -> DataFrame:
    """Sorted distinct values with codes 0..n-1; null counts as ``unknown`` unless that is None."""
    value = F.col(col).cast("string")
    value = F.coalesce(value, F.lit(unknown)) if unknown is not None else value
    values = df.select(value.alias("value")).filter(F.col("value").isNotNull()).distinct()
    return global_index(values, [F.col("value")], "code")


def apply_vocab(df: DataFrame, col: str, vocab: DataFrame, out: str, unknown: str | None = UNKNOWN) -> DataFrame:
    """Code of each value; values the vocabulary has not seen get -1."""
    value = F.col(col).cast("string")
    value = F.coalesce(value, F.lit(unknown)) if unknown is not None else value
    codes = vocab.select(F.col("value").alias("_value"), F.col("code").cast("long").alias("_code"))
    joined = df.join(codes, value == F.col("_value"), "left")
    return joined.withColumn(out, F.coalesce("_code", F.lit(-1).cast("long"))).drop("_value", "_code")


def sentiment_code(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in SENTIMENT_LABELS]), c) - 1, F.lit(-1)).cast("long")


def save_vocabs(vocabs: dict[str, DataFrame], path: str) -> None:
    """Write all vocabularies beside the model, one directory per name."""
    for name, vocab in vocabs.items():
        vocab.select("value", F.col("code").cast("long").alias("code")).write.mode("overwrite").parquet(f"{path}/{name}")


def load_vocabs(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("code", T.LongType())])
    return {n: spark.read.schema(schema).parquet(f"{path}/{n}") for n in names}


def multi_hot(df: DataFrame, key: str, list_col: str, vocab: DataFrame) -> DataFrame:
    """Sparse membership rows (key, code) of a list column, restricted to the vocabulary."""
    values = df.select(key, F.explode(F.array_distinct(F.col(list_col).cast("array<string>"))).alias("value"))
    return values.join(vocab, "value").select(key, F.col("code").cast("long").alias("code"))
