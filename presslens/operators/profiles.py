"""Symbolic history profiles, match features and popularity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from presslens.functions.expr import clicked_int, epoch_seconds
from presslens.functions.grouping import checkpointed
from presslens.functions.grouping import medians
from presslens.operators.vectors import entity_mentions

HALF_LIFE_HOURS = 24.0
# fixed values: article-lifetime totals that must not be used at serving time
LEAK_FIELDS = ["total_inviews", "total_pageviews", "total_read_time"]


def entity_sets(articles: DataFrame) -> DataFrame:
    """Distinct (article_id, entity_id)."""
    return entity_mentions(articles).select("article_id", "entity_id").distinct()


def history_length(hist: DataFrame) -> DataFrame:
    """(user_id, n_articles): all clicks, unknown articles too."""
    return hist.groupBy("user_id").agg(F.count("*").alias("n_articles"))


def history_profile(hist: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(user_id, value, n): how many history clicks carry the value.

    ``values`` is (article_id, value), one row per value of an article. Clicks are
    counted per article first, so a popular article meets its values once per user.
    """
    clicks = hist.groupBy("user_id", "article_id").agg(F.count("*").alias("_n"))
    known = values.select("article_id", value).filter(F.col(value).isNotNull())
    return clicks.join(known, "article_id").groupBy("user_id", value).agg(F.sum("_n").alias("n"))


def match_score(imp: DataFrame, articles: DataFrame, hist: DataFrame, value: str, out: str) -> DataFrame:
    """Share of the user's history with the candidate's value; 0 when absent."""
    profile = history_profile(hist, articles, value).withColumnRenamed("n", "_n")
    rows = imp.join(articles.select("article_id", value), "article_id", "left")
    rows = rows.join(profile, ["user_id", value], "left").join(history_length(hist), "user_id", "left")
    usable = F.col(value).isNotNull() & (F.col(value) != "") if dict(articles.dtypes)[value] == "string" else F.col(value).isNotNull()
    score = F.when(usable, F.coalesce(F.col("_n") / F.col("n_articles"), F.lit(0.0))).otherwise(0.0)
    return rows.withColumn(out, score).select(*imp.columns, out)


def entity_overlap_pairs(pairs: DataFrame, entities: DataFrame, hist: DataFrame, out: str = "entity_overlap") -> DataFrame:
    """(user_id, article_id, out) for pairs that share an entity with the history."""
    profile = history_profile(hist, entities, "entity_id")
    hits = pairs.join(entities, "article_id").join(profile, ["user_id", "entity_id"])
    return hits.groupBy("user_id", "article_id").agg(F.sum("n").alias(out))


def entity_overlap(imp: DataFrame, entities: DataFrame, hist: DataFrame, out: str = "entity_overlap") -> DataFrame:
    """Sum over shared entities of the number of history clicks that mention them."""
    pairs = imp.select("user_id", "article_id").distinct()
    return imp.join(entity_overlap_pairs(pairs, entities, hist, out), ["user_id", "article_id"], "left").fillna(0, [out])


def symbolic_score(imp: DataFrame, articles: DataFrame, entities: DataFrame, hist: DataFrame) -> DataFrame:
    """category match + subcategory match + log1p(entity overlap)."""
    rows = entity_overlap(imp, entities, hist)
    rows = match_score(rows, articles, hist, "category", "category_match")
    rows = match_score(rows, articles, hist, "subcategory", "subcategory_match")
    return rows.withColumn("score", F.col("category_match") + F.col("subcategory_match") + F.log1p("entity_overlap"))


def train_popularity(imp: DataFrame, articles: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(article_id, popularity, floor): smoothed click share in the training window.

    The floor is the value of every article without clicks; one extra row with a
    null article carries it, so the table is complete even without any click.
    """
    # stored once: the impressions are read one time, however often the shares are
    clicks = checkpointed(imp.groupBy("article_id").agg(F.sum(clicked_int()).alias("_c")).filter(F.col("_c") > 0))
    total = clicks.agg(F.coalesce(F.sum("_c"), F.lit(0))).scalar()
    denominator = total + F.lit(alpha) * articles.agg(F.count("*")).scalar()
    floor = articles.sparkSession.range(1).select(F.lit(None).cast(imp.schema["article_id"].dataType).alias("article_id"),
                                                  F.lit(0).cast("long").alias("_c"))
    return clicks.unionByName(floor).select(
        "article_id", ((F.col("_c") + alpha) / denominator).alias("popularity"))


def popularity_score(imp: DataFrame, popularity: DataFrame, out: str = "score") -> DataFrame:
    """Popularity of each candidate; unseen articles get the floor."""
    floor = popularity.filter(F.col("article_id").isNull()).agg(F.max("popularity")).scalar()
    known = popularity.filter(F.col("article_id").isNotNull()).withColumnRenamed("popularity", "_known_pop")
    return imp.join(known, "article_id", "left").withColumn(out, F.coalesce("_known_pop", floor)).drop("_known_pop")


def history_popularity(hist: DataFrame, half_life_hours: float = HALF_LIFE_HOURS,
                       articles: DataFrame | None = None) -> DataFrame:
    """(article_id, clicks, decayed) from the history window, decayed to its last click."""
    rate = math.log(2.0) / (half_life_hours * 3600.0)
    newest = hist.agg(F.max(epoch_seconds("click_time"))).scalar()
    rows = hist if articles is None else hist.join(articles.select("article_id").distinct(), "article_id", "left_semi")
    age = F.greatest(newest - epoch_seconds("click_time"), F.lit(0))
    return rows.groupBy("article_id").agg(F.count("*").alias("clicks"), F.sum(F.exp(-F.lit(rate) * age)).alias("decayed"))


def leak_score(articles: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(article_id, leak): mean of min-max scaled log1p fields, missing values at the median."""
    fields = fields or LEAK_FIELDS
    middle = medians(articles, [], fields).select(F.struct(*fields)).scalar()
    logged = articles.select("article_id", *[F.log1p(F.coalesce(F.col(f).cast("double"), middle[f])).alias(f) for f in fields])
    ranges = logged.agg(F.struct(*[F.min(f).alias(f"lo_{f}") for f in fields],
                                 *[F.max(f).alias(f"hi_{f}") for f in fields])).scalar()
    parts = []
    for f in fields:
        lo, hi = ranges[f"lo_{f}"], ranges[f"hi_{f}"]
        parts.append(F.when(hi - lo < 1e-12, 0.0).otherwise((F.col(f) - lo) / (hi - lo)))
    return logged.select("article_id", (sum(parts, F.lit(0.0)) / len(fields)).alias("leak"))
