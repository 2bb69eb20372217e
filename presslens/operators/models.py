"""Score blending, combiners and Spark ML rankers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F

from presslens.functions.expr import clicked_int, hash_unit
from presslens.functions.grouping import checkpointed
from presslens.operators import features as feat, profiles, text, vectors

MINUS_INF = float("-inf")
COLD_BELOW = 5
# feature order of the linear combiner
COMBINER = ["bm25", "cosine", "recency_cosine", "category_match", "subcategory_match", "log_entity_overlap",
            "log_popularity"]


def finite(c: str) -> Column:
    """The column where it is a finite number, else null."""
    return F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))


def minmax_in_group(df: DataFrame, cols: list[str] | str, key: str = "impression_id") -> DataFrame:
    """Add ``{col}_mm``: min-max scaled within the impression, 0 for a constant list.

    The ends are those of the finite scores; a candidate outside the catalogue keeps its -inf.
    """
    cols = [cols] if isinstance(cols, str) else cols
    ends = df.groupBy(key).agg(*[F.min(finite(c)).alias(f"_lo_{c}") for c in cols], *[F.max(finite(c)).alias(f"_hi_{c}") for c in cols])
    rows = df.join(ends, key)
    scaled = {}
    for c in cols:
        width = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        scaled[f"{c}_mm"] = (F.when(F.col(c) == MINUS_INF, MINUS_INF).when(width < 1e-12, 0.0)
                             .otherwise((F.col(c) - F.col(f"_lo_{c}")) / width))
    return rows.withColumns(scaled).drop(*[f"_{e}_{c}" for c in cols for e in ("lo", "hi")])


def blend(df: DataFrame, weights: dict[str, float], out: str = "score") -> DataFrame:
    """Weighted sum of min-max scaled scores; a score missing from an index (-inf) makes the sum -inf."""
    rows = minmax_in_group(df, list(weights))
    total = sum((F.when(F.col(f"{c}_mm") == MINUS_INF, MINUS_INF).otherwise(F.col(f"{c}_mm") * w) for c, w in weights.items()), F.lit(0.0))
    return rows.withColumn(out, total).drop(*[f"{c}_mm" for c in weights])


def leak_blend(scored: DataFrame, leaks: DataFrame, base: str = "score") -> DataFrame:
    """Ablation pair: ``score_without`` (base) and ``score_with`` (half base, half leak score)."""
    rows = scored.join(leaks.select("article_id", "leak"), "article_id", "left").fillna(0.0, ["leak"])
    rows = blend(rows, {base: 0.5, "leak": 0.5}, out="score_with")
    return rows.withColumn("score_without", F.col(base)).drop("leak")


def combiner_features(imp: DataFrame, hist: DataFrame, articles: DataFrame, vecs: DataFrame, entities: DataFrame,
                      popularity: DataFrame, qterms: DataFrame | text.ClickedTerms, postings: DataFrame, decay: float = 0.9,
                      with_history_len: bool = False) -> DataFrame:
    """The combiner's columns for each candidate (index features are -inf outside their index)."""
    key = ["user_id", "article_id"]
    pairs = checkpointed(imp.select(*key).distinct())
    # narrow tables of pairs, stored step by step, so that what one has shuffled is gone before the next
    table = checkpointed(profiles.match_score(profiles.match_score(pairs, articles, hist, "category", "category_match"),
                                              articles, hist, "subcategory", "subcategory_match"))
    table = table.join(profiles.entity_overlap_pairs(pairs, entities, hist), key, "left").fillna(0, ["entity_overlap"])
    table = profiles.popularity_score(table, popularity, out="_pop")
    table = checkpointed(table.withColumns({"log_entity_overlap": F.log1p(F.col("entity_overlap").cast("double")),
                                            "log_popularity": F.log("_pop")}).drop("entity_overlap", "_pop"))
    vector = vectors.cosine_pairs(pairs, vectors.pool_mean(hist, vecs), vecs, "cosine").join(
        vectors.cosine_pairs(pairs, vectors.pool_recency(hist, vecs, decay), vecs, "recency_cosine"), key)
    table = text.bm25_pairs(pairs, qterms, postings, articles, out="bm25").join(checkpointed(vector), key).join(table, key)
    table = checkpointed(table.select(*key, *COMBINER))
    rows = imp.join(table, key)
    if with_history_len:
        lengths = profiles.history_length(hist)
        rows = rows.join(lengths, "user_id", "left").withColumn(
            "log_history_len", F.log1p(F.coalesce("n_articles", F.lit(0)).cast("double"))).drop("n_articles")
    return rows


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, mean, scale) of the finite values: population standard deviation, 1 where a column is constant."""
    stats = df.agg(*[F.avg(finite(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(finite(c)).alias(f"s{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"),
                     F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")).alias("scale")) for i, c in enumerate(cols)]
    return stats.select(F.inline(F.array(*rows)))


def scaler_values(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """The fitted scaler as literals, one pair per feature."""
    return {r.feature: (r["mean"], r.scale) for r in scaler.collect()}


def apply_scaler(df: DataFrame, values: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in values.items()})


def linear_score(cols: list[str], coefficients: list[float], intercept: float,
                 scaler: dict[str, tuple[float, float]] | None = None) -> Column:
    """``intercept + sum(coef * standardised feature)`` as one expression."""
    total = F.lit(float(intercept))
    for c, w in zip(cols, coefficients):
        mean, scale = scaler[c] if scaler else (0.0, 1.0)
        total = total + (F.col(c) - mean) / scale * float(w)
    return total


def apply_linear(df: DataFrame, cols: list[str], coefficients: list[float], intercept: float,
                 scaler: dict[str, tuple[float, float]] | None = None, out: str = "score") -> DataFrame:
    return df.withColumn(out, linear_score(cols, coefficients, intercept, scaler))


def cohort(df: DataFrame, hist: DataFrame, threshold: int = COLD_BELOW) -> DataFrame:
    """``cohort`` = cold below ``threshold`` history clicks (or unknown user), else warm."""
    rows = df.join(profiles.history_length(hist), "user_id", "left")
    return rows.withColumn("cohort", F.when(F.coalesce("n_articles", F.lit(0)) < threshold, "cold").otherwise("warm")).drop("n_articles")


def gated_score(df: DataFrame, coefficients: list[float], intercept: float,
                scaler: dict[str, tuple[float, float]] | None = None, cols: list[str] | None = None,
                warm: str = "cosine", out: str = "score") -> DataFrame:
    """Warm users keep the ``warm`` score; cold users get the linear combiner.

    A candidate missing from an index scores -inf instead of a sum of infinities.
    """
    missing = (F.col("bm25") == MINUS_INF) | (F.col("cosine") == MINUS_INF) | (F.col("recency_cosine") == MINUS_INF)
    cold = F.when(missing, F.lit(MINUS_INF)).otherwise(linear_score(cols or COMBINER, coefficients, intercept, scaler))
    return df.withColumn(out, F.when(F.col("cohort") == "warm", F.col(warm)).otherwise(cold))


def random_score(df: DataFrame, seed: int = 0, out: str = "score") -> DataFrame:
    """Reproducible noise in [0, 1): the floor any ranker must beat."""
    return df.withColumn(out, hash_unit(seed, "impression_id", "article_id", "position"))


# --- fitted models -----------------------------------------------------------------------

def _assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def fit_logistic(df: DataFrame, cols: list[str], balanced: bool = False, c: float = 1.0, max_iter: int = 100):
    """Logistic regression on standardised columns, plain or class-balanced; penalty strength as 1/c on the sum."""
    from pyspark.ml.classification import LogisticRegression
    counts = df.agg(F.count("*").alias("n"), F.sum(clicked_int()).alias("p")).first()
    n, p = counts.n, counts.p or 0
    if not 0 < p < n:
        raise ValueError(f"{p} clicked of {n} rows: both kinds are needed to fit")
    weight = F.lit(1.0)
    if balanced:
        weight = F.when(clicked_int() == 1, n / (2.0 * p)).otherwise(n / (2.0 * (n - p)))
    rows = _assemble(df.withColumns({"label": clicked_int().cast("double"), "_weight": weight}), cols)
    return LogisticRegression(weightCol="_weight", regParam=1.0 / (c * n), standardization=False, maxIter=max_iter).fit(rows)


def coefficient_table(spark, cols: list[str], coefficients, intercept: float) -> DataFrame:
    rows = [(c, float(w)) for c, w in zip(cols, coefficients)] + [("intercept", float(intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def impute(df: DataFrame, cols: list[str], values: dict[str, float] | None = None) -> tuple[DataFrame, list[str], dict[str, float]]:
    """Fill nulls with the training mean and add ``{col}_missing``; Spark trees take no nulls."""
    if values is None:
        means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
        values = {c: float(means[c]) if means[c] is not None else 0.0 for c in cols}
    new = {f"{c}_missing": F.col(c).isNull().cast("double") for c in cols}
    new |= {c: F.coalesce(F.col(c).cast("double"), F.lit(values[c])) for c in cols}
    return df.withColumns(new), [*cols, *[f"{c}_missing" for c in cols]], values


def _column_facts(df: DataFrame, cols: list[str], at_once: int = 16) -> dict[str, Row]:
    """n (rows), known (not null), mean, lo and hi of each column; a few columns a pass, as a longer aggregate is not compiled."""
    facts = {}
    for start in range(0, len(cols), at_once):
        part = {f"_{i}": F.col(c).cast("double") for i, c in enumerate(cols[start:start + at_once])}
        row = df.agg(*[F.struct(F.count("*").alias("n"), F.count(x).alias("known"), F.avg(x).alias("mean"), F.min(x).alias("lo"),
                                F.max(x).alias("hi")).alias(name) for name, x in part.items()]).first()
        facts |= dict(zip(cols[start:], row))
    return facts


def _code_category(df: DataFrame, col: str, size: int) -> DataFrame:
    """Mark a code column (-1..size - 2) as nominal for the tree learner by ML column metadata."""
    meta = {"ml_attr": {"type": "nominal", "vals": [str(v) for v in range(-1, size - 1)], "name": col}}
    shifted = F.col(col).cast("double") + 1.0
    # a code the training data did not have counts as unknown
    return df.withColumn(col, F.when(shifted < size, shifted).otherwise(0.0).alias(col, metadata=meta))


def fit_gbt(df: DataFrame, cols: list[str], stop: str = "is_stop", categorical: list[str] | None = None,
            max_iter: int = 50, max_depth: int = 5, step: float = 0.1, seed: int = 0, max_bins: int = 64):
    """Boosted trees with early stopping on the rows where ``stop`` is true.

    Every categorical column is nominal: the number of bins grows to the largest vocabulary.
    A column with one value in all rows can split nothing, so the trees are not given it.
    Rows are read several times; give it a stored table. Returns (model, prepare, inputs): ``prepare`` applies
    the same imputation and coding to other rows; inputs that the model was not given come last.
    """
    from pyspark.ml.classification import GBTClassifier
    nominal = [c for c in (categorical or []) if c in cols]
    numeric = [c for c in cols if c not in nominal]
    facts = _column_facts(df, cols)
    means = {c: facts[c].mean or 0.0 for c in numeric}
    sizes = {c: int(facts[c].hi or 0) + 2 for c in nominal}
    bins = max([max_bins, *sizes.values()])
    varies = [c for c in cols if facts[c].known and not facts[c].lo == facts[c].hi]
    varies += [c for c in nominal if c not in varies and 0 < facts[c].known < facts[c].n]
    gaps = [c for c in numeric if 0 < facts[c].known < facts[c].n]
    every = [*numeric, *[f"{c}_missing" for c in numeric], *nominal]
    used = [c for c in every if c in varies or c.removesuffix("_missing") in gaps] or every[:1]

    def prepare(rows: DataFrame) -> DataFrame:
        rows, _, _ = impute(rows, [c for c in numeric if c in used or f"{c}_missing" in used], means)
        for c in nominal:
            rows = _code_category(rows, c, sizes[c])
        return _assemble(rows, used)

    train = prepare(df.withColumn("label", clicked_int().cast("double")))
    model = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed, maxBins=bins,
                          validationIndicatorCol=stop, subsamplingRate=1.0).fit(train)
    return model, prepare, [*used, *[c for c in every if c not in used]]


def apply_model(model, prepared: DataFrame, out: str = "score") -> DataFrame:
    """Probability of a click from a fitted classifier."""
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(prepared)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "features")


def pair_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """(kind, i, j, value): moments of the differences of all (clicked, not clicked) pairs of an impression, without forming them.

    ``gram`` is the sum of products of differences i and j, ``sum`` the sum of differences i,
    ``pairs`` their number. With the class counts and sums of an impression the products are
    weighted sums over its rows less a product of sums, so rows are read in Arrow batches
    and no more than 2 x columns sums are kept for an impression.
    """
    d = len(cols)
    one = clicked_int() == 1
    sums = [F.sum(F.when(one == cls, F.col(c).cast("double")).otherwise(0.0)).alias(f"_{tag}{i}")
            for tag, cls in (("p", True), ("n", False)) for i, c in enumerate(cols)]
    per = df.groupBy("impression_id").agg(F.count_if(one).alias("_np"), F.count_if(~one).alias("_nn"), *sums).filter((F.col("_np") > 0) & (F.col("_nn") > 0))
    per = checkpointed(per)
    rows = df.select("impression_id", one.alias("_one"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)]).join(
        per.select("impression_id", "_np", "_nn"), "impression_id")

    def out(total: np.ndarray):
        yield pd.DataFrame({"i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "value": total.ravel()})

    def products(frames):
        total = np.zeros((d, d))
        for f in frames:
            x = f[[f"_x{i}" for i in range(d)]].to_numpy(float)
            total += x.T @ (x * np.where(f["_one"], f["_nn"], f["_np"])[:, None])
        yield from out(total)

    def crossed(frames):
        total = np.zeros((d, d))
        for f in frames:
            p, n = (f[[f"_{t}{i}" for i in range(d)]].to_numpy(float) for t in "pn")
            total -= p.T @ n + n.T @ p
        yield from out(total)

    schema = "i int, j int, value double"
    gram = rows.mapInPandas(products, schema).unionByName(per.mapInPandas(crossed, schema)).groupBy("i", "j").agg(F.sum("value").alias("value"))
    first = [F.sum(F.col("_nn") * F.col(f"_p{i}") - F.col("_np") * F.col(f"_n{i}")) for i in range(d)]
    none = F.lit(None).cast("int")
    means = per.agg(F.sum(F.col("_np") * F.col("_nn")).cast("double").alias("pairs"), F.array(*first).alias("s"))
    total = means.select(F.lit("sum").alias("kind"), F.posexplode("s").alias("i", "value")).select("kind", "i", none.alias("j"), "value")
    pairs = means.select(F.lit("pairs").alias("kind"), none.alias("i"), none.alias("j"), F.col("pairs").alias("value"))
    return gram.select(F.lit("gram").alias("kind"), "i", "j", "value").unionByName(total).unionByName(pairs)


def fit_pairwise_ranker(df: DataFrame, cols: list[str], ridge: float = 1e-3) -> np.ndarray:
    """Linear ranker over all (clicked, not clicked) pairs of an impression: least squares on the differences, target 1.

    Returns the weights (one per column), solved from :func:`pair_moments`.
    """
    d = len(cols)
    a, t, pairs = np.zeros((d, d)), np.zeros(d), 1.0
    for r in pair_moments(df, cols).collect():  # columns squared
        if r.kind == "gram":
            a[r.i, r.j] = r.value or 0.0
        elif r.kind == "sum":
            t[r.i] = r.value or 0.0
        else:
            pairs = r.value or 1.0
    return np.linalg.solve(a / pairs + ridge * np.eye(d), t / pairs)


def without_features(cols: list[str], withheld: list[str] | None = None) -> list[str]:
    """Feature list of an ablation arm; by default without the position features."""
    drop = set(feat.POSITION_FEATURES if withheld is None else withheld)
    return [c for c in cols if c not in drop]


def feature_importance(spark, model, inputs: list[str]) -> DataFrame:
    """(feature, importance, rank) by gain, largest first; the last inputs, which the model was not given, gain nothing."""
    given = model.featureImportances.toArray()
    gains = sorted(zip(inputs, [*given, *[0.0] * (len(inputs) - len(given))]), key=lambda x: (-x[1], x[0]))
    rows = [(f, float(g), i + 1) for i, (f, g) in enumerate(gains)]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")


def top_features(importance: DataFrame, k: int) -> list[str]:
    """Names of the k most important features, for a refit on the subset."""
    rows = importance.filter(F.col("rank") <= k).orderBy("rank").collect()  # k rows
    return list(dict.fromkeys(r.feature.removesuffix("_missing") for r in rows))
