"""Results that must not depend on the size of a vocabulary, a history or a score."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presslens.functions import grouping as G
from presslens.operators import features as K, models as C, prepare as P, text as T, vectors as E
from presslens.sources import readers as R, sinks as S


def test_a_vocabulary_of_any_size_stays_nominal(spark):
    rng = random.Random(1)
    rows = [(i, i % 100, rng.random(), int(i % 100 in (3, 50, 97)) if rng.random() < 0.95 else 0, rng.random() < 0.2) for i in range(3000)]
    df = spark.createDataFrame(rows, "impression_id int, category_code long, x double, clicked int, is_stop boolean")
    model, prepare, inputs = C.fit_gbt(df, ["category_code", "x"], categorical=["category_code"], max_iter=3, max_depth=3)
    meta = prepare(df).schema["category_code"].metadata["ml_attr"]
    assert meta["type"] == "nominal" and len(meta["vals"]) == 101
    scores = {r.category_code: r.score for r in C.apply_model(model, prepare(df)).groupBy("category_code").agg(F.avg("score").alias("score")).collect()}
    hit = {4.0, 51.0, 98.0}  # codes are shifted by one for unknown
    assert min(scores[c] for c in hit) > max(v for c, v in scores.items() if c not in hit)


def test_columns_with_one_value_cost_the_trees_nothing(spark):
    rng = random.Random(2)
    rows = [(i, i % 6, rng.random(), None if i % 3 else rng.random(), 1.0, None, 4, int(rng.random() < 0.2 + 0.6 * (i % 6 in (1, 4))), rng.random() < 0.2)
            for i in range(2000)]
    df = spark.createDataFrame(rows, "impression_id int, code long, x double, y double, one double, none double, kind long, clicked int, is_stop boolean").coalesce(2)
    options = {"categorical": ["code", "kind"], "max_iter": 4, "max_depth": 3}
    model, prepare, inputs = C.fit_gbt(df, ["code", "x", "y", "one", "none", "kind"], **options)
    lean, prepare_lean, few = C.fit_gbt(df, ["code", "x", "y"], **options)
    assert model.numFeatures == 4 and inputs[:4] == ["x", "y", "y_missing", "code"]
    assert sorted(inputs[4:]) == ["kind", "none", "none_missing", "one", "one_missing", "x_missing"] and few == [*inputs[:4], "x_missing"]
    assert model.toDebugString.split("\n")[1:] == lean.toDebugString.split("\n")[1:]
    later = df.withColumns({"one": F.lit(7.0), "none": F.lit(1.0), "kind": F.lit(9).cast("long")})
    assert [r.score for r in C.apply_model(model, prepare(later)).orderBy("impression_id").collect()] == [
        r.score for r in C.apply_model(lean, prepare_lean(df)).orderBy("impression_id").collect()]
    importance = C.feature_importance(spark, model, inputs).collect()
    assert len(importance) == 10 and all(r.importance == 0.0 for r in importance if r.feature in inputs[4:])


def test_a_stored_table_reads_only_the_part_asked_for(spark):
    stored = G.checkpointed(spark.range(10).withColumn("part", (F.col("id") % 2).cast("int")), "part")
    odd = stored.filter("part = 1")
    assert [r.id for r in odd.orderBy("id").collect()] == [1, 3, 5, 7, 9] and stored.columns == ["id", "part"]
    assert {r.f.split("/")[-2] for r in odd.select(F.input_file_name().alias("f")).collect()} == {"part=1"}


def test_shuffle_files_go_with_their_job(spark):
    """In the click-log queries a stored table leaves no shuffle files behind."""
    from presslens.session import prepare_click_log_session
    own = prepare_click_log_session(spark.newSession())

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for f in range(files.size()) if (name := files.apply(f).getName()).startswith("shuffle_")}

    before = shuffled()
    stored = G.checkpointed(own.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert stored.count() == 7 and not shuffled() - before


def test_history_parts_keep_positions(spark):
    clicks = spark.createDataFrame([(u, k, 100 * u + k) for u in (1, 2) for k in range(3 + 4 * u)], "user_id long, pos long, article_id long")
    parts = P.recover_history_arrays(clicks, {"article_id": "ids"}, part_size=2)
    back = P.explode_history(parts, {"ids": "article_id"})
    assert sorted(map(tuple, back.select("user_id", "pos", "article_id").collect())) == sorted(map(tuple, clicks.collect()))


def test_long_vectors_are_read_whole(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("a\t" + "\t".join(str(i) for i in range(3000)) + "\nb\t1\t2\n")
    rows = {r.id: r.vec for r in R.read_vectors(spark, str(tmp_path / "v.tsv")).collect()}
    assert rows["a"] == [float(i) for i in range(3000)] and rows["b"] == [1.0, 2.0]


def test_missing_scores_stay_last(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, float("-inf")), (1, 3, 4.0), (2, 4, float("-inf")), (2, 5, float("-inf"))], "impression_id int, article_id int, s double")
    got = {r.article_id: r.s_mm for r in C.minmax_in_group(df, "s").collect()}
    assert got == {1: 0.0, 2: -math.inf, 3: 1.0, 4: -math.inf, 5: -math.inf}
    blended = {r.article_id: r.score for r in C.blend(df.withColumn("t", F.col("article_id") * 1.0), {"s": 0.0, "t": 1.0}).collect()}
    assert blended[2] == -math.inf and not any(math.isnan(x) for x in blended.values())
    scaler = C.fit_scaler(df, ["s"]).first()
    assert scaler["mean"] == 3.0 and scaler["scale"] == 1.0


def test_fitting_needs_both_kinds(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (1, 2.0, 0)], "impression_id int, x double, clicked int")
    with pytest.raises(ValueError, match="both kinds"):
        C.fit_logistic(df, ["x"], balanced=True)


def test_logistic_is_at_the_minimum(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -0.5] - 1)))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "impression_id int, a double, b double, clicked int")
    model = C.fit_logistic(df, ["a", "b"])
    w, b = model.coefficients.toArray(), model.intercept
    error = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert abs(x.T @ error + w).max() < 0.05 and abs(error.sum()) < 0.05


def test_pair_moments_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i // 7, int(rng.random() < 0.4), *rng.standard_normal(3).tolist()) for i in range(140)]
    df = spark.createDataFrame(rows, "impression_id int, clicked int, a double, b double, c double")
    diffs = np.array([np.subtract(p[2:], n[2:]) for p in rows for n in rows if p[0] == n[0] and p[1] == 1 and n[1] == 0])
    got = {(r.kind, r.i, r.j): r.value for r in C.pair_moments(df, ["a", "b", "c"]).collect()}
    assert got["pairs", None, None] == len(diffs)
    assert np.allclose([[got["gram", i, j] for j in range(3)] for i in range(3)], diffs.T @ diffs)
    assert np.allclose([got["sum", i, None] for i in range(3)], diffs.sum(axis=0))
    weights = C.fit_pairwise_ranker(df, ["a", "b", "c"], ridge=0.0)
    assert np.allclose(weights, np.linalg.lstsq(diffs, np.ones(len(diffs)), rcond=None)[0])


@pytest.mark.parametrize("chunk, hot, slices", [(20_000, None, 256), (3, None, 256), (3, 20, 7), (20_000, 1, 256), (20_000, 1, 1)])
def test_window_vectors_equal_brute_force(spark, chunk, hot, slices, monkeypatch):
    """In whole blocks and, for keys with more rows than ``hot`` in a block, in slices of time."""
    rng = random.Random(8)
    clicks = [(rng.choice("ab"), rng.randint(0, 400), [float(rng.randint(-3, 3)), float(rng.randint(-3, 3))]) for _ in range(60)] + [("a", 50, None)]
    probes = [(u, p) for u in "abc" for p in (0, 50, 99, 100, 101, 250, 400, 700)]
    original = K._running_vectors
    monkeypatch.setattr(K, "SLICES", slices)
    monkeypatch.setattr(K, "_running_vectors", lambda span, rate: original(span, rate, chunk))
    got = {(r.user_id, r.p): r.vec for r in K.window_vectors(
        spark.createDataFrame(probes, "user_id string, p long"), spark.createDataFrame(clicks, "user_id string, t long, v array<double>"), "user_id", "v", 100, 30.0, hot).collect()}
    for u, p in probes:
        seen = [(t, v) for c, t, v in clicks if c == u and p - 100 <= t < p and v is not None]
        if not seen:
            assert (u, p) not in got
        else:
            assert np.allclose(got[u, p], sum(np.array(v) * 0.5 ** ((p - t) / 30.0) for t, v in seen))


def test_a_user_with_very_many_clicks_is_spread_over_slices(spark, monkeypatch):
    week, half = 604_800, 86_400.0
    monkeypatch.setattr(K, "HOT_VECTORS", 50_000)
    clicks = spark.range(600_000).selectExpr("'hot' as user_id", "(id * 7919) % 604800 + 1000000 as t", "array(1.0D, cast(id % 3 as double)) as v")
    few = spark.range(40).selectExpr("concat('u', id % 4) as user_id", "id * 20000 + 1000000 as t", "array(1.0D, 2.0D) as v")
    probes = spark.sql("select explode(array('hot', 'u1', 'u9')) as user_id, p from (select explode(array(999999L, 1000001L, 1300000L, 1604800L, 1900000L, 2300000L)) as p)")
    tallest = []
    original = K._line_vectors

    def watched(asked, given, *rest):
        tallest.append(given.groupBy("user_id", "_b").count().agg(F.max("count")).first()[0])
        return original(asked, given, *rest)

    monkeypatch.setattr(K, "_line_vectors", watched)
    got = {(r.user_id, r.p): r.vec for r in K.window_vectors(probes, clicks.unionByName(few), "user_id", "v", week, half).collect()}
    assert max(tallest) < 5000  # no group of a task grows with the user's clicks
    t = np.arange(600_000) * 7919 % 604_800 + 1_000_000
    v = np.stack([np.ones(600_000), np.arange(600_000) % 3.0], 1)
    for p in (999999, 1000001, 1300000, 1604800, 1900000, 2300000):
        seen = (t >= p - week) & (t < p)
        if not seen.any():
            assert ("hot", p) not in got
        else:
            assert np.allclose(got["hot", p], (v[seen] * 0.5 ** ((p - t[seen]) / half)[:, None]).sum(0), rtol=1e-9)
        mine = [x for x in range(1, 40, 4) if p - week <= x * 20000 + 1_000_000 < p]
        assert ("u1", p) in got if mine else ("u1", p) not in got
        assert ("u9", p) not in got


def test_terms_are_counted_in_their_rows(spark):
    docs = spark.createDataFrame([(1, "Red red car", None), (2, None, None), (3, "the", "blue Car")], "article_id long, title string, abstract string").repartition(2)
    got = sorted(map(tuple, T.doc_terms(docs).select("article_id", "term", "tf", "doc_len").collect()))
    assert got == [(1, "car", 1, 3), (1, "red", 2, 3), (3, "blue", 1, 2), (3, "car", 1, 2)]


def test_vector_store_encodes_new_texts_only(spark, tmp_path):
    calls = []

    def encode(rows):
        calls.append(sorted(r.article_id for r in rows.collect()))
        return rows.select("article_id", F.array(F.length("title") * 1.0).alias("vec"))

    def docs(*rows):
        return spark.createDataFrame(list(rows), "article_id long, title string")

    store = str(tmp_path / "store")
    E.encode_incremental(docs((1, "a"), (2, "bb")), store, "m", encode).collect()
    got = E.encode_incremental(docs((1, "a"), (2, "changed"), (3, "c")), store, "m", encode).collect()
    E.encode_incremental(docs((1, "a")), store, "other", encode).collect()
    assert calls == [[1, 2], [2, 3], [1]]
    assert sorted((r.article_id, r.vec[0]) for r in got) == [(1, 1.0), (2, 7.0), (3, 1.0)]


def test_written_lines_are_counted_once(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (2, 0, 1)], "impression_id long, position int, rank int")
    assert S.write_predictions(ranked, str(tmp_path / "out")) == 2
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1 [2,1]", "2 [1]"]


def test_categories_of_equal_weight_go_by_code(spark):
    # 23 * 36 = 18 * 46: the sums of logarithms are equal, their last digits are not
    times = {1: {"a": (17.0, 45.0), "b": (22.0, 35.0), "c": (60.0, 60.0)}, 2: {"a": (22.0, 35.0), "b": (17.0, 45.0), "c": (1.0, 1.0)}}
    articles = spark.createDataFrame([(i, c) for i, c in enumerate("abc")], "article_id long, category string")
    hist = spark.createDataFrame([(u, "abc".index(c), t) for u, read in times.items() for c, ts in read.items() for t in ts], "user_id long, article_id long, read_time double")
    imp = spark.createDataFrame([(u, u, a, a) for u in times for a in range(3)], "impression_id long, user_id long, article_id long, position int")
    rows = K.category_rank(imp, hist, articles, P.fit_vocab(articles, "category")).collect()
    assert {(r.user_id, r.article_id): r.lt_cat_rank for r in rows} == {(1, 2): 0, (1, 0): 1, (1, 1): 2, (2, 0): 0, (2, 1): 1, (2, 2): 2}


def test_a_shuffle_gets_more_tasks_as_it_grows(spark):
    from presslens import session
    names = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    try:
        session.prepare_click_log_session(spark)
        rows = spark.range(12_000_000).select(F.rand(1).alias("x")).repartition("x")  # about 100 MB for 4 configured partitions
        assert rows.rdd.getNumPartitions() >= 6
    finally:
        for name in names:
            spark.conf.unset(name)


def _interest_world(spark, seed):
    """Clicks and impressions of a few users; articles without vector, with several or null topics, unknown ids, a category outside the vocabulary."""
    rng = random.Random(seed)
    docs = spark.createDataFrame([(i, rng.choice(["c1", "c2", "c3", "c4", "odd", None])) for i in range(40)], "article_id long, category string")
    subs = spark.createDataFrame([(i, rng.choice(["s1", "s2", None])) for i in range(40) for _ in range(i % 3)], "article_id long, subcategory string")
    tops = spark.createDataFrame([(i, rng.choice("pqrst")) for i in range(38) for _ in range(i % 4)] + [(99, "p")], "article_id long, topic string")
    vecs = spark.createDataFrame([(i, [rng.choice([0.1, 0.5, -0.25, 0.0]) for _ in range(3)]) for i in range(36)] + [(36, [0.0, 0.0, 0.0])], "article_id long, vec array<double>")
    vocab = spark.createDataFrame([(c, i) for i, c in enumerate(["__unknown__", "c1", "c2", "c3", "c4", "never"])], "value string, code long")
    start = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) as"
    hist = spark.createDataFrame([(rng.choice([1, 1, 2, 3, 4]), i, rng.choice([*range(40), 99]), rng.randrange(0, 2_000_000) // 7000 * 7000, rng.choice([1.0, 30.0, None]))
                                  for i in range(150)], "user_id long, pos long, article_id long, s int, read_time double").selectExpr("*", f"{start} click_time").drop("s")
    imp = spark.createDataFrame([(m, rng.choice([1, 2, 3, 4, 5]), t) for m in range(40) for t in [rng.randrange(0, 2_400_000) // 7000 * 7000]], "impression_id long, user_id long, s int")
    imp = imp.selectExpr("impression_id", "user_id", f"{start} impression_time", "explode(transform(sequence(0, 4), x -> pmod(hash(impression_id, x), 44))) as article_id")
    return imp.selectExpr("impression_id", "user_id", "impression_time", "cast(article_id as long) as article_id"), hist, docs, subs, tops, vecs, vocab


@pytest.mark.parametrize("rows, pairs, held", [(524_288, 1 << 23, 1 << 16), (524_288, 1 << 23, 2), (240, 1 << 23, 1 << 16), (524_288, 1500, 1 << 16)])
def test_interest_in_packs_equals_joins(spark, rows, pairs, held, monkeypatch):
    """Whatever part of the users is too large for a pack."""
    from presslens.operators import interest

    imp, *tables, vocab = _interest_world(spark, 3)
    cand = K.with_second(imp).select(*K.MOMENT)
    pick = lambda df: {tuple(r)[:len(r) - 5 if "st_cat_rank" in df.columns else 2]: tuple(r)[len(r) - 5 if "st_cat_rank" in df.columns else 2:] for r in df.collect()}
    short, long = pick(K._short_term_joined(cand, *tables, vocab, 604_800, 86_400.0)), pick(K._long_term_joined(K.pairs_of(imp), *tables))
    monkeypatch.setattr(interest, "PACK_ROWS", rows)
    monkeypatch.setattr(interest, "WINDOW_PAIRS", pairs)
    monkeypatch.setattr(interest, "HELD_CLICKS", held)
    for want, got in ((short, pick(K.short_term_moments(imp, *tables, vocab))), (long, pick(K.long_term_pairs(K.pairs_of(imp), *tables)))):
        assert got.keys() == want.keys() and len(want) > 100
        assert any(v[3] for v in want.values()) and any(v[2] for v in want.values())
        for key, values in want.items():
            assert [x is None for x in values] == [x is None for x in got[key]], key
            assert [x or 0 for x in values] == pytest.approx([x or 0 for x in got[key]], abs=1e-9), key


def test_candidates_carry_no_vectors_or_values(spark, monkeypatch):
    """Long and short interest: a row for each candidate, not one for each of its values or with its vector."""
    imp, *tables, vocab = _interest_world(spark, 4)
    seen, original = [], K.checkpointed
    monkeypatch.setattr(K, "checkpointed", lambda df: seen.append(df.columns) or original(df))
    K.short_term_moments(imp, *tables, vocab).count()
    K.long_term_pairs(K.pairs_of(imp), *tables).count()
    assert seen and not any({"value", "vec", "_x", "_v"} & set(c) for c in seen)
