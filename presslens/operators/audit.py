"""Data-quality audits. Each returns a small table or a filtered view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from presslens.functions.expr import epoch_seconds
from presslens.functions.grouping import medians


class SchemaError(ValueError):
    """All violations of a table's contract, in one message."""


@dataclass(frozen=True)
class Field:
    mandatory: bool = False
    only: str | None = None  # the one dataset that may fill this field


# fixed values: the contracts of the four tables; "mind" and "ebnerd" name the two public click logs
ARTICLES = {
    "article_id": Field(True), "dataset": Field(True), "title": Field(True), "abstract": Field(True),
    "body": Field(only="ebnerd"), "category": Field(True), "subcategory": Field(), "entities": Field(),
    "topics": Field(only="ebnerd"), "article_published_time": Field(only="ebnerd"),
}
IMPRESSIONS = {
    "impression_id": Field(True), "dataset": Field(True), "user_id": Field(True), "article_id": Field(True),
    "impression_time": Field(True), "clicked": Field(True), "session_id": Field(only="ebnerd"),
    "dwell_time": Field(only="ebnerd"), "scroll_percentage": Field(only="ebnerd"),
    "is_front_page": Field(only="ebnerd"),
}
CANDIDATES = {name: field for name, field in IMPRESSIONS.items() if name != "clicked"}
USER_HISTORY = {
    "user_id": Field(True), "dataset": Field(True), "article_ids": Field(True),
    "click_times": Field(only="ebnerd"), "read_times": Field(only="ebnerd"),
}


def table_violations(df: DataFrame, schema: dict[str, Field], dataset: str) -> DataFrame:
    """Rows (field, rule, n_rows) for every broken rule; one pass over the table."""
    checks = []
    for name, field in schema.items():
        if name not in df.columns:
            checks.append((name, "missing column", F.lit(1).cast("long")))
            continue
        if field.mandatory:
            checks.append((name, "null in mandatory field", F.count_if(F.col(name).isNull())))
        if field.only is not None and field.only != dataset:
            checks.append((name, f"only {field.only} may fill this field", F.count_if(F.col(name).isNotNull())))
    counted = df.agg(*[c.alias(f"c{i}") for i, (_, _, c) in enumerate(checks)])
    rows = [F.struct(F.lit(n).alias("field"), F.lit(r).alias("rule"), F.col(f"c{i}").alias("n_rows"))
            for i, (n, r, _) in enumerate(checks)]
    return counted.select(F.inline(F.array(*rows))).filter(F.col("n_rows") > 0)


def validate_table(df: DataFrame, schema: dict[str, Field], dataset: str) -> None:
    """Raise :class:`SchemaError` listing all violations, if there are any."""
    found = table_violations(df, schema, dataset).collect()  # at most two rows per declared field
    if found:
        lines = [f"{r.field}: {r.rule}" + (f" ({r.n_rows} rows)" if r.rule != "missing column" else "") for r in found]
        raise SchemaError(f"{len(found)} violation(s) for dataset {dataset!r}: " + "; ".join(lines))


def history_leakage(hist: DataFrame, imp: DataFrame) -> DataFrame:
    """Users whose last history click is not before their first impression."""
    last = hist.groupBy("user_id").agg(F.max("click_time").alias("last_click"))
    first = imp.groupBy("user_id").agg(F.min("impression_time").alias("first_impression"))
    return last.join(first, "user_id").filter(F.col("last_click") >= F.col("first_impression"))


def window_leakage(hist: DataFrame, imp: DataFrame) -> DataFrame:
    """The global form: does the history window close before the impressions open?"""
    last = hist.agg(F.max("click_time").alias("last_click"))
    first = imp.agg(F.min("impression_time")).scalar()
    return last.select("last_click", first.alias("first_impression"),
                       (F.col("last_click") >= first).alias("leaks"))


def referential_integrity(articles: DataFrame, **referrers: DataFrame) -> DataFrame:
    """Ids in each referring table that the catalogue lacks, with their row counts."""
    catalog = articles.select("article_id").distinct()
    parts = []
    for name, df in referrers.items():
        counts = df.groupBy("article_id").agg(F.count("*").alias("n_rows"))
        parts.append(counts.join(catalog, "article_id", "left_anti").select(F.lit(name).alias("source"), "article_id", "n_rows"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def row_conservation(packed: DataFrame, list_col: str, exploded: DataFrame) -> DataFrame:
    """Rows expected from the list sizes against rows found after the explode."""
    expected = packed.agg(F.coalesce(F.sum(F.size(list_col)), F.lit(0)).cast("long")).scalar()
    return exploded.agg(F.count("*").alias("n_rows")).select(
        expected.alias("expected_rows"), "n_rows", (expected == F.col("n_rows")).alias("conserved"))


def population_counts(imp: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Distinct impressions and users and the row count; compared to ``expected`` (name, n) if given."""
    counts = imp.agg(F.count_distinct("impression_id").alias("impressions"), F.count_distinct("user_id").alias("users"),
                     F.count("*").alias("candidate_rows"))
    long = counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in ("impressions", "users", "candidate_rows")])))
    if expected is None:
        return long
    return long.join(expected.withColumnRenamed("n", "n_expected"), "name", "left").withColumn(
        "ok", F.col("n") == F.col("n_expected"))


def scale_report(imp: DataFrame, split: str = "split", n_features: int = 65, bytes_per_value: int = 4) -> DataFrame:
    """Impressions, candidate rows, list length and projected feature bytes per split."""
    per_split = imp.groupBy(split).agg(F.count_distinct("impression_id").alias("n_impressions"),
                                       F.count("*").alias("n_candidates"))
    return per_split.withColumns({
        "candidates_per_impression": F.col("n_candidates") / F.col("n_impressions"),
        "feature_bytes": F.col("n_candidates") * F.lit(n_features * bytes_per_value).cast("long")})


def negative_age_rate(imp: DataFrame, articles: DataFrame) -> DataFrame:
    """Share of candidates published after they were shown, and the median age in hours."""
    pub = articles.select("article_id", "published_at")
    age = (epoch_seconds("impression_time") - epoch_seconds("published_at")) / 3600.0
    rows = imp.join(pub, "article_id").select(age.alias("age_h")).filter(F.col("age_h").isNotNull())
    stats = rows.agg(F.avg((F.col("age_h") < 0).cast("double")).alias("negative_rate"), F.count("*").alias("n_candidates"))
    return stats.withColumn("median_age_h", medians(rows, [], ["age_h"]).scalar())


def popularity_bound(popularity: DataFrame, hist: DataFrame) -> DataFrame:
    """Popularity may not exceed the clicks it was counted from, nor be negative."""
    clicks = hist.agg(F.count("*")).scalar()
    stats = popularity.agg(F.sum("clicks").alias("total"), F.max("clicks").alias("max_raw"),
                           F.max("decayed").alias("max_decayed"), F.min("clicks").alias("min_raw"))
    return stats.select("total", clicks.alias("n_clicks"), "max_raw", "max_decayed", "min_raw", (
        (F.col("total") <= clicks) & (F.col("max_decayed") <= F.col("max_raw")) & (F.col("min_raw") >= 0)).alias("ok"))


def coverage(ids: DataFrame, index: DataFrame, key: str = "article_id") -> DataFrame:
    """Fraction of the distinct ids that the index holds."""
    present = index.select(key).distinct().withColumn("_in", F.lit(1.0))
    joined = ids.select(key).distinct().join(present, key, "left")
    return joined.agg(F.avg(F.coalesce("_in", F.lit(0.0))).alias("coverage"), F.count("*").alias("n_ids"))
