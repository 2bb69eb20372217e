"""Ranking, per-impression metrics, slices and bootstrap intervals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from presslens.functions.expr import clicked_int, tie_break
from presslens.functions.grouping import checkpointed, row_numbers, running_sums

IMP = ["impression_id", "user_id"]
METRICS = ["auc", "mrr", "ndcg5", "ndcg10"]


def rank_candidates(scored: DataFrame, seed: int = 0, hot_limit: int | None = None,
                    counted: DataFrame | None = None) -> DataFrame:
    """Add the 1-based ``rank`` by score; ties in a reproducible pseudo-random order.

    ``counted``: the unscored candidates, to look for oversized lists without scoring twice.
    """
    tagged = scored.withColumn("_tie", tie_break(seed, "impression_id", "article_id", "position"))
    order = [F.col("score").desc_nulls_last(), F.col("_tie"), F.col("position")]
    return row_numbers(tagged, ["impression_id"], order, "rank", hot_limit, counted).drop("_tie")


def auc_per_impression(scored: DataFrame, hot_limit: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Mann-Whitney AUC with averaged ties; null if an impression has one class only."""
    by_score = scored.groupBy(*IMP, "score").agg(
        F.sum(clicked_int()).alias("_pos"), F.sum(1 - clicked_int()).alias("_neg"))
    cumulated = running_sums(by_score, IMP, [F.col("score")], {"_upto": F.col("_neg")}, hot_limit, counted)
    won = F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2.0)
    sums = cumulated.groupBy(*IMP).agg(F.sum(won).alias("_won"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    pairs = F.col("_p") * F.col("_n")
    return sums.select(*IMP, F.when(pairs > 0, F.col("_won") / pairs).alias("auc"))


def _ideal_dcg(n_pos: Column, k: int) -> Column:
    steps = [1.0 / math.log2(i + 1) for i in range(1, k + 1)]
    totals = [sum(steps[:i]) for i in range(k + 1)]
    return F.element_at(F.array(*[F.lit(t) for t in totals]), (F.least(n_pos, F.lit(k)) + 1).cast("int"))


def rank_metrics(ranked: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """``mrr`` (first click only, 0 without one) and ``ndcg{k}`` (null without clicks) per impression."""
    hit = clicked_int()
    gains = [F.sum(F.when(F.col("rank") <= k, hit / F.log2(F.col("rank") + 1.0))).alias(f"_dcg{k}") for k in ks]
    agg = ranked.groupBy(*IMP).agg(F.min(F.when(hit == 1, F.col("rank"))).alias("_first"), F.sum(hit).alias("_p"), *gains)
    return agg.select(*IMP, F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"), *[
        F.when(F.col("_p") > 0, F.coalesce(f"_dcg{k}", F.lit(0.0)) / _ideal_dcg(F.col("_p"), k)).alias(f"ndcg{k}") for k in ks])


def mrr(ranked: DataFrame) -> DataFrame:
    return rank_metrics(ranked, ()).select(*IMP, "mrr")


def ndcg_at_k(ranked: DataFrame, k: int) -> DataFrame:
    return rank_metrics(ranked, (k,)).select(*IMP, f"ndcg{k}")


def official_scores(pairs: DataFrame) -> DataFrame:
    """Scores of a submission: rows (impression_id, position, label, rank).

    A candidate scores 1/rank, equal ranks are taken last position first, and
    the reciprocal rank is averaged over *all* clicks. Returns one row of means and
    the number of impressions that a mean leaves out (no click, or nothing but clicks).
    """
    rows = pairs.select("impression_id", F.col("impression_id").alias("user_id"), "position",
                        F.col("label").alias("clicked"), (1.0 / F.col("rank")).alias("score"))
    rows = checkpointed(rows)  # lines are parsed and compared once
    order = [F.col("score").desc(), F.col("position").desc()]
    ranked = checkpointed(row_numbers(rows, ["impression_id"], order, "rank"))
    reciprocal = ranked.groupBy(*IMP).agg(
        F.try_divide(F.sum(F.col("clicked") / F.col("rank")), F.sum("clicked")).alias("mrr_all"))
    per = auc_per_impression(ranked.drop("rank")).join(rank_metrics(ranked), IMP).join(reciprocal, IMP)
    return per.agg(F.avg("auc").alias("auc"), F.avg("mrr_all").alias("mrr"), F.avg("ndcg5").alias("ndcg5"),
                   F.avg("ndcg10").alias("ndcg10"), F.count("*").alias("n_impressions"),
                   F.count_if(F.col("auc").isNull()).alias("n_without_auc"), F.count_if(F.col("mrr_all").isNull()).alias("n_without_click"))


def diversity_at_k(ranked: DataFrame, articles: DataFrame, k: int = 10) -> DataFrame:
    """Share of top-k pairs with different categories; null below two candidates."""
    top = ranked.filter(F.col("rank") <= k).join(articles.select("article_id", "category"), "article_id", "left")
    groups = top.groupBy(*IMP, "category").agg(F.count("*").alias("_c"))
    agg = groups.groupBy(*IMP).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * (F.col("_c") - 1)).alias("_same"))
    pairs = F.col("_n") * (F.col("_n") - 1)
    return agg.select(*IMP, F.when(pairs > 0, 1.0 - F.col("_same") / pairs).alias(f"diversity{k}"))


def novelty_at_k(ranked: DataFrame, popularity: DataFrame, k: int = 10) -> DataFrame:
    """Mean -log2(popularity) of the top k; articles without clicks have the floor probability."""
    from presslens.operators.profiles import popularity_score
    top = popularity_score(ranked.filter(F.col("rank") <= k), popularity, out="_p")
    return top.groupBy(*IMP).agg(F.avg(-F.log2("_p")).alias(f"novelty{k}"))


def catalog_coverage_at_k(ranked: DataFrame, articles: DataFrame, k: int = 10, approx: bool = False) -> DataFrame:
    """Distinct top-k articles over the catalogue size, overall and per cohort (no interval)."""
    n_catalog = articles.agg(F.count("*")).scalar()
    pairs = ranked.filter(F.col("rank") <= k).select("cohort", "article_id")
    if approx:
        seen = F.approx_count_distinct("article_id")
        overall, by_cohort = pairs.agg(seen.alias("n_seen")), pairs.groupBy("cohort").agg(seen.alias("n_seen"))
    else:
        pairs = pairs.distinct()
        by_cohort = pairs.groupBy("cohort").agg(F.count("*").alias("n_seen"))
        overall = pairs.select("article_id").distinct().agg(F.count("*").alias("n_seen"))
    both = overall.select(F.lit("overall").alias("slice"), "n_seen").unionByName(
        by_cohort.select(F.col("cohort").alias("slice"), "n_seen"))
    return both.withColumn(f"coverage{k}", F.col("n_seen") / n_catalog)


def recall_at_k(topk: DataFrame, positives: DataFrame, ks: tuple[int, ...] = (50, 100, 200)) -> DataFrame:
    """Per clicked row: is the article in the user's top k? Columns ``hit{k}``."""
    found = topk.select("user_id", "article_id", F.col("rank").alias("_rank"))
    joined = positives.join(found, ["user_id", "article_id"], "left")
    return joined.select(*positives.columns, *[
        F.coalesce(F.col("_rank") <= k, F.lit(False)).cast("double").alias(f"hit{k}") for k in ks])


# --- slices and intervals ------------------------------------------------------------

def per_user_sums(per_impression: DataFrame, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Sum and count of each metric per user (null metrics dropped, and counted as skipped)."""
    aggs = []
    for v in values:
        aggs += [F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{v}_sum"), F.count(v).alias(f"{v}_n"),
                 (F.count("*") - F.count(v)).alias(f"{v}_skip")]
    return per_impression.groupBy("user_id", *(by or [])).agg(*aggs)


def _unpivot(df: DataFrame, keys: list[str], values: list[str], fields: dict[str, str]) -> DataFrame:
    """Wide columns ``{metric}_{suffix}`` to one row per metric; ``fields`` maps suffix to output name."""
    rows = [F.struct(F.lit(v).alias("metric"), *[F.col(f"{v}_{s}").alias(o) for s, o in fields.items()]) for v in values]
    return df.select(*keys, F.inline(F.array(*rows)))


def metric_by_slice(per_impression: DataFrame, values: list[str], cohort: str = "cohort") -> DataFrame:
    """Mean, impressions, users and skipped rows per metric: overall and per cohort."""
    users = per_user_sums(per_impression, values, [cohort])
    aggs = []
    for v in values:
        aggs += [F.sum(f"{v}_sum").alias(f"{v}_s"), F.sum(f"{v}_n").alias(f"{v}_c"),
                 F.count_if(F.col(f"{v}_n") > 0).alias(f"{v}_u"), F.sum(f"{v}_skip").alias(f"{v}_k")]
    cube = users.groupingSets([[], [F.col(cohort)]], cohort).agg(F.grouping(cohort).alias("_all"), *aggs)
    named = cube.withColumn("slice", F.when(F.col("_all") == 1, "overall").otherwise(F.col(cohort)))
    long = _unpivot(named, ["slice"], values, {"s": "_s", "c": "n_impressions", "u": "n_users", "k": "n_skipped"})
    return long.select("slice", "metric", F.try_divide("_s", "n_impressions").alias("value"),
                       "n_impressions", "n_users", "n_skipped")


def _poisson_cuts(limit: int = 12) -> list[int]:
    """Poisson(1) distribution function on a 32-bit scale: weight = number of cuts <= draw."""
    total, term, cuts = 0.0, math.exp(-1.0), []
    for k in range(limit):
        total += term
        cuts.append(int(total * 4294967296.0))
        term /= k + 1
    return cuts


POISSON_CUTS = _poisson_cuts()


def _replicate_sums(rows: DataFrame, keys: list[str], values: list[str], seed: int, n_replicates: int) -> DataFrame:
    """(keys, replicate, values): sums of the users' values with a Poisson(1) weight per (user, replicate).

    A task keeps one matrix of replicates x values for each key and adds its users to it in
    chunks, as the product of their weights and values. Users are never multiplied into rows:
    a task hands on as many rows as keys x replicates. One digest yields four replicates.
    """
    blocks = [f":{i}".encode() for i in range(-(-n_replicates // 4))]
    cuts = np.array(POISSON_CUTS, np.int64)
    key_types = [rows.schema[k].dataType.simpleString() for k in keys]

    def draws(user: str | None) -> np.ndarray:
        start, digests = hashlib.md5((str(seed) if user is None else f"{seed}:{user}").encode()), []
        for block in blocks:
            h = start.copy()
            h.update(block)
            digests.append(h.digest())
        return np.frombuffer(b"".join(digests), ">u4")[:n_replicates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            users = batch.column(0).to_pylist()
            groups = list(zip(*(c.to_pylist() for c in batch.columns[1:1 + len(keys)]), strict=True)) if keys else [()] * len(users)
            table = np.column_stack([pa.compute.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in batch.columns[1 + len(keys):]])
            for start in range(0, len(users), 256):
                named: dict[str | None, int] = {}  # a user with several keys is drawn once
                which = [named.setdefault(u, len(named)) for u in users[start:start + 256]]
                weights = np.searchsorted(cuts, np.stack([draws(u) for u in named]), side="right").astype(np.float64)[which]
                part, own = table[start:start + 256], groups[start:start + 256]
                for key in set(own):
                    at = [i for i, g in enumerate(own) if g == key]
                    sums = weights[at].T @ part[at]
                    total[key] = total[key] + sums if key in total else sums
        for key, sums in total.items():
            columns = [pa.array([k] * n_replicates, t) for k, t in zip(key, arrow_keys, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(n_replicates), pa.int32()), *[pa.array(c) for c in sums.T]], [*keys, "replicate", *values])

    slim = rows.select(F.col("user_id").cast("string").alias("user_id"), *keys, *[F.col(v).cast("double").alias(v) for v in values])
    # a user costs n_replicates draws, far more than its bytes tell adaptive execution
    spark = rows.sparkSession
    slim = slim.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "user_id").sortWithinPartitions("user_id")
    arrow_keys = [f.type for f in to_arrow_schema(rows.select(*keys).schema)] if keys else []
    schema = ", ".join([*(f"{k} {t}" for k, t in zip(keys, key_types, strict=True)), "replicate int", *(f"{v} double" for v in values)])
    parts = slim.mapInArrow(run, schema)
    return parts.groupBy(*keys, "replicate").agg(*[F.sum(v).alias(v) for v in values])


def _interval(replicates: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """2.5 / 97.5 percentiles with linear interpolation over the replicate values."""
    cuts = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.groupBy(*keys).agg(cuts.alias("_ci")).select(
        *keys, F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"))


def bootstrap_ci(per_user: DataFrame, values: list[str], cohort: str = "cohort", n_replicates: int = 2000,
                 seed: int = 0) -> DataFrame:
    """Interval of every metric, overall and per cohort, by resampling users.

    ``per_user`` comes from :func:`per_user_sums` with ``by=[cohort]``. Resampling
    uses Poisson(1) weights, which need no exchange of users between tasks.
    """
    cols = [c for v in values for c in (f"{v}_sum", f"{v}_n")]
    by_cohort = _replicate_sums(per_user, [cohort], cols, seed, n_replicates)
    # from here on at most (cohorts x replicates) rows
    cube = by_cohort.groupingSets([[F.col("replicate")], [F.col(cohort), F.col("replicate")]], cohort, "replicate").agg(
        F.grouping(cohort).alias("_all"), *[F.sum(c).alias(c) for c in cols])
    named = cube.withColumn("slice", F.when(F.col("_all") == 1, "overall").otherwise(F.col(cohort)))
    long = _unpivot(named, ["slice", "replicate"], values, {"sum": "_s", "n": "_n"})
    return _interval(long, ["slice", "metric"], F.try_divide("_s", "_n"))


def paired_bootstrap(paired: DataFrame, a: str, b: str, keys: list[str] | None = None, n_replicates: int = 2000,
                     seed: int = 0) -> DataFrame:
    """Mean(a) - mean(b) over the same impressions, with its interval, per ``keys``."""
    keys = keys or []
    both = paired.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    users = both.groupBy("user_id", *keys).agg(F.sum(F.col(a) - F.col(b)).alias("_d"), F.count("*").alias("_n"))
    point = users.groupBy(*keys).agg((F.sum("_d") / F.sum("_n")).alias("diff"), F.sum("_n").alias("n_impressions"),
                                     F.count("*").alias("n_users"))
    reps = _replicate_sums(users, keys, ["_d", "_n"], seed, n_replicates).filter("_n > 0")
    if not keys:
        key = ["_one"]
        ci = _interval(reps.withColumn("_one", F.lit(1)), key, F.col("_d") / F.col("_n"))
        return point.withColumn("_one", F.lit(1)).join(ci, key).drop("_one")
    return point.join(_interval(reps, keys, F.col("_d") / F.col("_n")), keys)


def compare_arms(arms: DataFrame, baselines: list[str], value: str = "auc", n_replicates: int = 2000,
                 seed: int = 0) -> DataFrame:
    """Every arm against every baseline. ``arms`` is long: (arm, impression_id, user_id, value)."""
    rows = arms.select("arm", *IMP, F.col(value).alias("a"))
    base = rows.filter(F.col("arm").isin(baselines)).select(F.col("arm").alias("baseline"), *IMP, F.col("a").alias("b"))
    paired = rows.join(base, IMP).filter(F.col("arm") != F.col("baseline"))
    diffs = paired_bootstrap(paired, "a", "b", ["arm", "baseline"], n_replicates, seed)
    own = per_user_sums(rows.withColumnRenamed("a", "v"), ["v"], ["arm"])
    low = bootstrap_ci(own, ["v"], "arm", n_replicates, seed).filter(F.col("slice") != "overall").select(
        F.col("slice").alias("arm"), F.col("ci_low").alias("arm_ci_low"))
    mean = rows.groupBy("arm").agg(F.avg("a").alias("baseline_value")).withColumnRenamed("arm", "baseline")
    return diffs.join(low, "arm").join(mean, "baseline").select(
        "arm", "baseline", "diff", "ci_low", "ci_high", "n_impressions", "n_users",
        ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("excludes_zero"),
        (F.col("arm_ci_low") > F.col("baseline_value")).alias("clear_win"))
