"""Pinned values, brute-force comparisons and invariances of ranking and metrics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presslens.functions import grouping as G
from presslens.operators import metrics as M, models as C, sampling as L

SCHEMA = "impression_id long, user_id long, article_id long, position int, clicked int, score double"


def ranked(spark, clicks):
    rows = [(1, 1, i, i, int(c), float(-i)) for i, c in enumerate(clicks)]
    return M.rank_candidates(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("clicks,k,want", [([0, 0, 1, 1], 4, 0.5706417189553201), ([0, 1, 1, 0], 2, 0.38685280723454163), ([0, 0], 5, None)])
def test_ndcg(spark, clicks, k, want):
    got = M.ndcg_at_k(ranked(spark, clicks), k).first()[f"ndcg{k}"]
    assert got is None if want is None else got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("clicks,want", [([0, 1, 0, 1], 0.5), ([0, 0], 0.0), ([1, 1], 1.0)])
def test_mrr(spark, clicks, want):
    assert M.mrr(ranked(spark, clicks)).first().mrr == want


def lists(seed=3, n=40):
    rnd, rows = random.Random(seed), []
    for imp in range(n):
        size = rnd.choice([1, 2, 5, 9, 60])
        for p in range(size):
            rows.append((imp, imp % 11, rnd.randrange(1000), p, int(rnd.random() < 0.3), rnd.choice([0.0, 0.5, rnd.random(), -math.inf])))
    return rows


def brute_auc(rows):
    pos, neg = ([r[5] for r in rows if r[4] == c] for c in (1, 0))
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("limit", [None, 4, 25])
def test_auc_matches_brute_force(spark, limit):
    rows = lists()
    got = {r.impression_id: r.auc for r in M.auc_per_impression(spark.createDataFrame(rows, SCHEMA), hot_limit=limit).collect()}
    for imp in {r[0] for r in rows}:
        want = brute_auc([r for r in rows if r[0] == imp])
        assert got[imp] == (None if want is None else pytest.approx(want, abs=1e-12))


def test_ranks_do_not_depend_on_layout_or_hot_path(spark):
    rows = lists(8)
    df = spark.createDataFrame(rows, SCHEMA)
    key = ["impression_id", "position", "rank"]
    plain = sorted(tuple(r) for r in M.rank_candidates(df).select(*key).collect())
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    other = spark.createDataFrame(shuffled, SCHEMA).repartition(7)
    assert plain == sorted(tuple(r) for r in M.rank_candidates(other, hot_limit=3).select(*key).collect())
    assert plain != sorted(tuple(r) for r in M.rank_candidates(df, seed=1).select(*key).collect())
    last = {r.impression_id: r for r in M.rank_candidates(df).filter("score = double('-Infinity')").groupBy("impression_id").agg(
        F.min("rank").alias("lo")).collect()}
    for imp, r in last.items():
        assert r.lo == 1 + sum(x[0] == imp and x[5] > -math.inf for x in rows)


def test_official_scores_of_a_perfect_submission(spark):
    rows = spark.createDataFrame([("1", 0, 1, 1), ("1", 1, 0, 2), ("1", 2, 1, 3)], "impression_id string, position int, label int, rank int")
    got = M.official_scores(rows).first()
    assert got.mrr == pytest.approx((1 + 1 / 3) / 2) and got.auc == pytest.approx(0.5)


def test_diversity_counts_null_as_one_category(spark):
    art = spark.createDataFrame([(0, "a"), (1, None), (2, None)], "article_id long, category string")
    assert M.diversity_at_k(ranked(spark, [0, 1, 0]), art).first().diversity10 == pytest.approx(2 / 3)
    assert M.diversity_at_k(ranked(spark, [1]), art).first().diversity10 is None


def test_slices_count_skipped_rows(spark):
    per = spark.createDataFrame([(1, 1, "warm", 0.5), (2, 1, "warm", None), (3, 2, "cold", 1.0)],
                                "impression_id long, user_id long, cohort string, auc double")
    got = {r.slice: tuple(r)[2:] for r in M.metric_by_slice(per, ["auc"]).collect()}
    assert got == {"overall": (0.75, 2, 2, 1), "warm": (0.5, 1, 1, 1), "cold": (1.0, 1, 1, 0)}


def test_bootstrap_covers_and_narrows(spark):
    rng = np.random.default_rng(0)

    def width(n):
        rows = [(int(u), "warm", float(x)) for u, x in enumerate(rng.normal(0.5, 0.2, n))]
        users = M.per_user_sums(spark.createDataFrame(rows, "user_id long, cohort string, auc double"), ["auc"], ["cohort"])
        r = M.bootstrap_ci(users, ["auc"], n_replicates=400).filter("slice = 'overall'").first()
        assert r.ci_low < 0.52 and r.ci_high > 0.48
        return r.ci_high - r.ci_low

    small, large = width(60), width(1500)
    assert large < small / 3
    # the normal interval is 2 * 1.96 * 0.2 / sqrt(n)
    assert large == pytest.approx(2 * 1.96 * 0.2 / math.sqrt(1500), rel=0.2)


def test_paired_difference_of_equal_arms_is_zero(spark):
    rows = spark.createDataFrame([(i, i % 5, float(i % 3), float(i % 3), None if i == 4 else 1.0) for i in range(30)],
                                 "impression_id long, user_id long, a double, b double, c double")
    same = M.paired_bootstrap(rows, "a", "b", n_replicates=40).first()
    assert (same.diff, same.ci_low, same.ci_high, same.n_impressions) == (0.0, 0.0, 0.0, 30)
    assert M.paired_bootstrap(rows, "a", "c", n_replicates=40).first().n_impressions == 29


def test_recall_example(spark):
    top = spark.createDataFrame([("A", 1, 1), ("A", 2, 2), ("C", 6, 1)], "user_id string, article_id long, rank int")
    pos = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3), ("B", 4), ("B", 5), ("C", 6)], "user_id string, article_id long")
    got = M.recall_at_k(top, pos, (1, 2)).agg(F.avg("hit1"), F.avg("hit2")).first()
    assert tuple(got) == pytest.approx((2 / 6, 3 / 6))


def test_medians_and_global_index_on_the_hot_path(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), float(rnd.randrange(40))) for _ in range(301)] + [(4, None)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r.k: r.v for r in G.medians(df, ["k"], ["v"], hot_limit=7).collect()}
    for k in (1, 2, 3):
        assert got[k] == pytest.approx(float(np.median([v for a, v in rows if a == k])))
    assert G.medians(df, [], ["v"], hot_limit=7).first().v == pytest.approx(float(np.median([v for _, v in rows if v is not None])))
    idx = G.global_index(df.limit(301).distinct(), [F.col("k"), F.col("v")], "i", hot_limit=10).orderBy("k", "v").collect()
    assert [r.i for r in idx] == list(range(len(idx)))


def test_a_low_limit_does_not_make_a_slice_of_a_few_rows(spark):
    """Otherwise 2.4 million clicks in groups above ten rows went through 240,000 tasks."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert G._slices(spark, 2_400_000, 10) == partitions and G._slices(spark, 25, 10) == 3
    assert G._slices(spark, 5_000_000_000, 10) == G._slices(spark, 5_000_000_000, None) == 5_000


def test_samples(spark):
    imp = spark.createDataFrame([(i, i % 13, p) for i in range(100) for p in range(3)], "impression_id long, user_id long, article_id long")
    one = L.sample_impressions(imp, 30, seed=1)
    assert one.count() == 90 and one.select("impression_id").distinct().count() == 30
    hot = L.sample_impressions(imp, 30, seed=1, hot_limit=9)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, hot.collect()))
    assert L.subsample_impressions(imp, 17, seed=2).count() == 51
    assert L.subsample_impressions(imp, 17, 2).exceptAll(L.subsample_impressions(imp, 17, 2, hot_limit=9)).isEmpty()
    assert L.sample_impressions(imp, 1000).count() == 300
    parts = L.user_holdout(imp, 0.0001, seed=3).groupBy("part").agg(F.count_distinct("user_id").alias("n")).collect()
    assert {r.part: r.n for r in parts} == {"fit": 12, "holdout": 1}


def test_pairwise_ranker_equals_explicit_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(rng.random() < 0.4), *map(float, rng.normal(size=2))) for i in range(25) for _ in range(6)]
    w = C.fit_pairwise_ranker(spark.createDataFrame(rows, "impression_id long, clicked int, x double, y double"), ["x", "y"], ridge=1e-3)
    diffs = np.array([np.subtract(a[2:], b[2:]) for a in rows for b in rows if a[0] == b[0] and a[1] == 1 and b[1] == 0])
    want = np.linalg.solve(diffs.T @ diffs / len(diffs) + 1e-3 * np.eye(2), diffs.sum(axis=0) / len(diffs))
    assert w == pytest.approx(want, abs=1e-9)


def test_minmax_and_gate(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 7.0)], "impression_id long, s double")
    assert sorted(r.s_mm for r in C.minmax_in_group(df, "s").collect()) == [0.0, 0.0, 1.0]
    inf = -math.inf
    rows = spark.createDataFrame([("warm", inf, inf, inf), ("cold", inf, 1.0, 1.0), ("cold", 1.0, 1.0, 1.0)],
                                 "cohort string, bm25 double, cosine double, recency_cosine double")
    rows = rows.withColumns({c: F.lit(1.0) for c in C.COMBINER[3:]})
    got = [r.score for r in C.gated_score(rows, [1.0, -1.0, 1, 1, 1, 1, 1], 0.5).collect()]
    assert got == [inf, inf, 5.5]


def test_candidates_are_computed_once(spark, monkeypatch):
    """Scores, arms, lines and popularity read a stored table, however many metrics look at it."""
    from presslens.operators import metrics as M, profiles as PR
    from presslens.plans import evaluate as EV

    seen = spark.sparkContext.accumulator(0)

    def watched(rows):
        def run(frames):
            for f in frames:
                seen.add(len(f))
                yield f
        return rows.mapInPandas(run, rows.schema)

    rows = spark.createDataFrame([(i, i % 4, i * 10 + p, p, int((i + p) % 3 == 0)) for i in range(30) for p in range(5)],
                                 "impression_id long, user_id long, article_id long, position int, clicked int")
    scorers = {"a": lambda r: r.withColumn("score", F.col("position").cast("double")), "b": lambda r: r.withColumn("score", F.col("article_id") % 7 * 1.0)}
    EV.evaluate_arms(watched(rows), scorers, ["a"], 8).collect()
    assert seen.value == 150
    lines = rows.select("impression_id", "position", F.col("clicked").alias("label"), (F.col("position") + 1).cast("long").alias("rank"))
    M.official_scores(watched(lines)).collect()
    assert seen.value == 300
    PR.popularity_score(rows, PR.train_popularity(watched(rows), rows.select("article_id"))).collect()
    assert seen.value == 450
