"""BM25, vectors, histories and features against brute force and the rules for missing data."""

import math
import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from presslens.operators import features as K, prepare as P, profiles as PR, quantised as Q, text as T, training as N, vectors as E

DOCS = [("a1", "football match tonight"), ("a2", "city council vote"), ("a3", "football transfer news football"),
        ("a4", "weather is sunny"), ("a5", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "article_id string, title string").withColumn("abstract", F.lit("")).cache()


def brute_postings(floor=0.25):
    toks = {d: [w for w in (t or "").lower().split() if w not in T.STOPWORDS] for d, t in DOCS}
    avg = sum(map(len, toks.values())) / len(toks)
    vocab = {w for t in toks.values() for w in t}
    idf = {w: math.log(len(toks) - n + 0.5) - math.log(n + 0.5) for w in vocab for n in [sum(w in t for t in toks.values())]}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (floor * mean if v < 0 else v) for w, v in idf.items()}
    return {(w, d): idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for d, t in toks.items() for w in set(t)}


def test_index_weights(spark, docs):
    got = {(r.term, r.article_id): r.weight for r in T.bm25_index(docs).collect()}
    want = brute_postings()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def q(spark, *texts):
    return T.query_terms(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"))


def test_top_k_rules(spark, docs):
    postings = T.bm25_index(docs)
    queries = q(spark, "Football", "unknownword", "the of", "football football council")
    top = T.bm25_top_k(queries, postings, docs, 2).collect()
    assert {r.article_id for r in top if r.query_id == 0} == {"a1", "a3"} and {r.query_id for r in top} == {0, 3}
    everything = T.bm25_top_k(queries, postings, docs, 100).collect()
    assert len([r for r in everything if r.query_id == 0]) == 5
    assert T.bm25_top_k(queries, postings, docs, 0).count() == 0


def test_pruned_top_k_equals_scores(spark, monkeypatch):
    """With and without negative weights, for lists longer than what matches, and whatever the first pass reads."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30) for _ in range(1 + 200 // (i + 1) ** 2)]  # few very common words
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 12)))) for i in range(120)], "article_id long, title string")
    queries = q(spark, *[" ".join(rnd.choices(words + [f"w{i}" for i in range(30)] * 20, k=4)) for _ in range(15)]).cache()
    for floor in (0.25, None):
        postings = T.bm25_index(docs, idf_floor=floor).cache()
        assert postings.filter("weight < 0").isEmpty() == (floor is not None)
        scores = {(r.query_id, r.article_id): r.score for r in T.bm25_score_all(queries, postings).collect()}
        known = {qid for qid, _ in scores}
        for k, first in ((7, 1), (7, 64), (90, 1)):
            monkeypatch.setattr(T, "FIRST_POSTINGS", first)
            top = T.bm25_top_k(queries, postings, docs, k).collect()
            for qid in range(15):
                got = sorted(((r["rank"], round(r.score, 9)) for r in top if r.query_id == qid))
                best = sorted((round(scores.get((qid, d), 0.0), 9) for d in range(120)), reverse=True)[:k] if qid in known else []
                assert [s for _, s in got] == pytest.approx(best) and [r for r, _ in got] == list(range(1, len(best) + 1))


def test_signed_blocks_equal_scores(spark):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rnd.choices("abcdefgh", k=rnd.randrange(0, 9)))) for i in range(60)], "article_id long, title string")
    postings, queries = T.bm25_index(docs).cache(), q(spark, "b c", "d e f g", "h h b").cache()
    pick = lambda df: sorted((r.query_id, r["rank"], r.article_id, round(r.score, 8)) for r in df.collect())
    assert pick(T._bm25_top_k_signed(queries, postings, docs, 7, "query_id", 5, 40)) == pick(T.bm25_top_k(queries, postings, docs, 7))


def test_candidate_scores_for_cold_users_and_unknown_articles(spark, docs):
    postings, terms = T.bm25_index(docs), T.doc_terms(docs)
    hist = spark.createDataFrame([("u", 0, "a1"), ("u", 1, "a1"), ("u", 2, "zz")], "user_id string, pos int, article_id string")
    imp = spark.createDataFrame([(1, u, a, p) for u in ("u", "cold") for p, a in enumerate(["a3", "a4", "zz"])],
                                "impression_id long, user_id string, article_id string, position int")
    got = {(r.user_id, r.article_id): r.score for r in T.bm25_score_candidates(imp, T.user_query(hist, terms), postings, docs).collect()}
    assert got[("cold", "a3")] == 0.0 and got[("cold", "zz")] == got[("u", "zz")] == -math.inf
    assert got[("u", "a3")] == pytest.approx(2 * brute_postings()[("football", "a3")]) and got[("u", "a4")] == 0.0


def test_blocks_of_users_equal_sums_over_pairs(spark):
    rnd = random.Random(8)
    texts = {i: rnd.choices("abcdefgh", k=rnd.randrange(0, 9)) for i in range(40)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "article_id long, title string")
    clicks = [("hot", rnd.randrange(45)) for _ in range(300)] + [(f"u{i}", rnd.randrange(45)) for i in range(25)] + [(None, 3), ("u1", None)]
    hist = spark.createDataFrame(clicks, "user_id string, article_id long")
    want = Counter((u, t) for u, a in clicks for t in texts.get(a, []))
    terms, postings = T.doc_terms(docs).cache(), T.bm25_index(docs).cache()
    known = {r.term for r in terms.select("term").distinct().collect()}
    want = {k: n for k, n in want.items() if k[1] in known}
    for rows in (7, 10_000):  # the hot user is cut into parts by the first
        queries = T.user_query(hist, terms, rows)
        assert {(r.user_id, r.term): r.qtf for r in queries.collect()} == want
        pairs = spark.createDataFrame([(u, a) for u in ("hot", "u1", "u2", "cold", None) for a in [*range(42), None]], "user_id string, article_id long")
        weight = {(r.term, r.article_id): r.weight for r in postings.collect()}
        sums = {}
        for u in ("hot", "u1", "u2"):
            for (t, a), w in weight.items():
                if (u, t) in want:
                    sums[u, a] = sums.get((u, a), 0.0) + want[u, t] * w
        got = {(r.user_id, r.article_id): r.score for r in T.score_pairs(pairs, queries, postings, rows, 5).collect()}
        assert got.keys() == sums.keys() and all(got[k] == pytest.approx(sums[k]) for k in sums)
    for limits in ((20, 30), (2_500_000, 6_000_000)):  # pairs a pack, terms a slice
        got = {(r.user_id, r.article_id): r.score for r in T.score_clicked(pairs, T.ClickedTerms(hist, terms), postings, *limits).collect()}
        assert got.keys() == sums.keys() and all(got[k] == pytest.approx(sums[k]) for k in sums)
    for part in ((pairs.limit(0), hist, terms, postings), (pairs, hist.limit(0), terms, postings), (pairs, hist, terms, postings.limit(0))):
        assert T.score_clicked(part[0], T.ClickedTerms(*part[1:3]), part[3]).count() == 0
    assert T.user_query(hist.limit(0), terms).count() == 0 == T.score_pairs(pairs.limit(0), queries, postings).count()
    assert T.score_pairs(pairs, queries.limit(0), postings).count() == 0 == T.score_pairs(pairs, queries, postings.limit(0)).count()


def test_terms_of_clicked_articles_travel_compressed(spark):
    """Also when the rows of an article come in several batches and terms are odd."""
    import pyarrow as pa
    rnd = random.Random(5)
    words = ["", "\u00e6\u00f8", "\u65e5\u672c", "a b", "x\0y", "long" * 3000, *[f"word{i}" for i in range(300)]]
    rows = [(f"d{a}", w, rnd.choice([1, 1, 1, 2, 70_000])) for a in range(12) for w in rnd.sample(words, 200)]
    rnd.shuffle(rows)
    clicks = [(rnd.randrange(4), f"d{rnd.randrange(14)}") for _ in range(60)]
    want = Counter()
    for u, a in clicks:
        for b, w, tf in rows:
            if a == b:
                want[u, w] += tf
    terms = spark.createDataFrame([*rows, ("d1", None, 1), (None, "word1", 1)], "article_id string, term string, tf long").repartition(3)
    hist = spark.createDataFrame(clicks, "user_id long, article_id string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for records in ("7", old):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            for limit in (20, 16384):
                assert {(r.user_id, r.term): r.qtf for r in T.user_query(hist, terms, limit).collect()} == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    batch = pa.RecordBatch.from_pydict({"article_id": ["a"] * 300, "term": words[6:], "tf": [1.0] * 300})
    packed, = T._pack_terms(iter([batch]))
    assert packed.num_rows == 1 and len(packed["packed"][0].as_py()) < 0.4 * sum(map(len, words[6:]))


def test_scores_of_clicks_write_no_table_of_users_and_terms(spark, monkeypatch):
    """Users with the same words: what is stored grows with clicks and pairs, not with users times words."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(500)) + " a1 a2") for i in range(4)], "article_id long, title string")
    terms, postings = T.doc_terms(docs).cache(), T.bm25_index(docs).cache()
    hist = spark.createDataFrame([(u, a) for u in range(60) for a in range(4)], "user_id long, article_id long")
    stored = []
    monkeypatch.setattr(T, "checkpointed", lambda df, keep=T.checkpointed: stored.append(df.count()) or keep(df))
    scored = T.bm25_score_candidates(hist.withColumn("position", F.lit(0)), T.ClickedTerms(hist, terms), postings, docs)
    assert scored.filter("score > 0").count() == 240 and max(stored) <= 240


def test_terms_are_stored_once_for_all_packs_of_users(spark, monkeypatch):
    """The lists of terms do not grow with the packs, and a count of 0 or less is a term the user has met."""
    rnd = random.Random(4)
    terms = spark.createDataFrame([(a, f"w{t}", rnd.choice([-1, 0, 1, 2])) for a in range(30) for t in rnd.sample(range(50), 12)] + [(3, None, 1), (None, "w1", 1)],
                                  "article_id long, term string, tf long").cache()
    postings = spark.createDataFrame([(f"w{t}", a, rnd.random()) for a in range(5, 35) for t in rnd.sample(range(60), 12)], "term string, article_id long, weight double").cache()
    hist = spark.createDataFrame([(rnd.randrange(20), rnd.randrange(33)) for _ in range(300)] + [(1, None), (None, 2)], "user_id long, article_id long")
    pairs = spark.createDataFrame([(u, a) for u in range(22) for a in range(40)], "user_id long, article_id long")
    met = hist.join(terms, "article_id").groupBy("user_id", "term").agg(F.sum("tf").alias("qtf"))
    want = {(r.user_id, r.article_id): r.score for r in T.score_pairs(pairs, met, postings).collect()}
    stored, original = [], T.checkpointed
    monkeypatch.setattr(T, "checkpointed", lambda df: stored.append(original(df)) or stored[-1])
    rows = []
    for limits in ((40, 100), (2_500_000, 100)):
        got = {(r.user_id, r.article_id): r.score for r in T.score_clicked(pairs, T.ClickedTerms(hist, terms), postings, *limits).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and 0 < len(want) < 22 * 40
        rows.append([t.count() for t in stored if "given" in t.columns])
        stored.clear()
    assert rows[0] == rows[1] and 0 < rows[0][0] <= 4


def test_tokens(spark):
    df = spark.createDataFrame([("Æble af RØD_1 the the x-y",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.tokenize("t")).collect()] == [["æble", "rød_1", "x", "y"], [], []]


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(60, 4)))]
    return spark.createDataFrame(rows, "article_id long, vec array<double>").cache()


def matrix(vecs):
    return {r.article_id: np.array(r.vec) for r in vecs.collect()}


def test_pooling_and_cold_users(spark, vecs):
    m = matrix(vecs)
    hist = spark.createDataFrame([(1, 0, 3), (1, 1, 999), (1, 2, 5), (1, 3, 3), (2, 0, 999)], "user_id long, pos int, article_id long")
    mean = {r.user_id: np.array(r.vec) for r in E.pool_mean(hist, vecs).collect()}
    want = m[3] * 2 + m[5]
    assert set(mean) == {1} and mean[1] == pytest.approx(want / np.linalg.norm(want))
    for limit in (None, 2):
        rec = {r.user_id: np.array(r.vec) for r in E.pool_recency(hist, vecs, 0.5, hot_limit=limit).collect()}
        want = m[3] + 0.5 * m[5] + 0.25 * m[3]
        assert rec[1] == pytest.approx(want / np.linalg.norm(want))
    imp = spark.createDataFrame([(1, 1, 3, 0), (1, 1, 999, 1), (2, 2, 3, 0)], "impression_id long, user_id long, article_id long, position int")
    got = {(r.user_id, r.article_id): r.score for r in E.cosine_candidates(imp, E.pool_mean(hist, vecs), vecs).collect()}
    assert got[(2, 3)] == 0.0 and got[(1, 999)] == -math.inf
    seq = E.history_sequence(hist, vecs, hot_limit=1).filter("user_id = 1").orderBy("seq").collect()
    assert [(r.seq, r.article_id) for r in seq] == [(1, 3), (2, 5), (3, 3)]


def test_knn_blocks(spark, vecs):
    m = matrix(vecs)
    queries = vecs.filter("article_id < 9").select(F.col("article_id").alias("query_id"), "vec").unionByName(
        spark.createDataFrame([(77, None)], "query_id long, vec array<double>"))
    for sizes in ((1024, 16384), (2, 7)):
        got = E.knn(queries, vecs, 5, left_rows=sizes[0], right_rows=sizes[1]).collect()
        assert len(got) == 45
        for r in got:
            order = sorted(m, key=lambda i: -float(m[i] @ m[r.query_id]))
            assert order[r.rank - 1] == r.article_id
    centroids, members = E.ivf_build(vecs, 6)
    full = E.ivf_knn(queries, centroids, members, 6, 5, left_rows=3, right_rows=4)
    exact = E.knn(queries, vecs, 5)
    audit = E.ann_audit(exact, full, 5).first()
    assert audit.mean_recall == audit.perfect_share == 1.0 and audit.n_queries == 9
    assert 0 < E.ann_audit(exact, E.ivf_knn(queries, centroids, members, 1, 5), 5).first().mean_recall <= 1


def test_cell_search_probes_what_its_recall_needs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(rng.normal(size=(400, 24)))]
    table = spark.createDataFrame(rows, "article_id long, vec array<double>").cache()
    queries = table.select(F.col("article_id").alias("query_id"), "vec")
    centroids, members = E.ivf_build(table, E.ivf_lists(400))
    assert centroids.count() == 16 and [E.ivf_lists(n) for n in (1, 100, 10**6, 10**8)] == [1, 10, 244, 10000]
    exact, wanted = E.knn(queries, table, 10), {}
    for least in (0.5, 0.9):
        wanted[least] = probes = E.ivf_probes(queries, centroids, members, 10, least)
        recall = lambda n: E.ann_audit(exact, E.ivf_knn(queries, centroids, members, n, 10), 10).first().mean_recall
        assert recall(probes) >= least > recall(probes - 1)
    assert 1 < wanted[0.5] < wanted[0.9] < 16
    assert E.ivf_probes(queries, centroids, members, 10, 0.9, sample=100) >= wanted[0.9] - 1
    assert E.ivf_probes(queries, centroids, members, 10, 1.1) == 16


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables not present")
def test_registered_cell_search_has_recall(spark):
    import __spark_entry__ as entry
    found = entry.queries()["e10_ivf_knn"](spark, "/root/testdata/sf0.01").filter("query_id % 20 = 0")
    exact = entry.queries()["e8_knn"](spark, "/root/testdata/sf0.01").filter("query_id % 20 = 0")
    assert E.ann_audit(exact, found, 10).first().mean_recall >= 0.9


def clustered(spark, rows, dim, seed):
    """Vectors around centres, cheap to make on either side."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(200, dim))
    x = centres[rng.integers(0, 200, rows)] + 0.6 * rng.normal(size=(rows, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame(pd.DataFrame({"article_id": np.arange(rows), "vec": x.tolist()}))


def test_quantised_search_reads_few_vectors(spark):
    x, vecs = clustered(spark, 50_000, 32, 4)
    vecs = vecs.cache()
    index = Q.build_quantised(vecs, E.ivf_lists(50_000), parts=8, sample=8192)
    assert index.codes.count() == 50_000 and index.books.shape == (256, 32)
    queries = vecs.filter("article_id % 100 = 0").withColumnRenamed("article_id", "query_id").cache()
    nprobe, short = Q.search_settings(queries, index, 10, 0.95)
    assert short <= 0.2 * 50_000 and nprobe <= len(index.centres)
    got = {}
    for r in Q.quantised_knn(queries, index, nprobe, short, 10).collect():
        assert r.score == pytest.approx(x[r.query_id] @ x[r.article_id])
        got.setdefault(r.query_id, set()).add(r.article_id)
    truth = {i: set(np.argsort(-(x[i] @ x.T))[:10]) for i in range(0, 50_000, 100)}
    assert np.mean([len(got[i] & truth[i]) / 10 for i in truth]) >= 0.95


def test_quantised_search_with_whole_lists_is_exact(spark, vecs):
    index = Q.build_quantised(vecs, 3, parts=3)
    queries = vecs.withColumnRenamed("article_id", "query_id")
    n = vecs.count()
    rows = lambda df: sorted((r.query_id, r["rank"], r.article_id, round(r.score, 9)) for r in df.collect())
    assert rows(Q.quantised_knn(queries, index, 99, n, 5)) == rows(E.knn(queries, vecs, 5))
    nothing = queries.withColumn("vec", F.lit(None).cast("array<double>"))
    assert Q.quantised_knn(nothing, index, 2, 5, 5).count() == 0 and Q.search_settings(nothing, index, 5) == (len(index.centres), 5)
    with pytest.raises(ValueError):
        Q.build_quantised(vecs.filter("false"), 3)


@pytest.mark.parametrize("rows", [(4096, 8192), (2, 3)])
def test_attention(spark, vecs, rows):
    m, rng = matrix(vecs), np.random.default_rng(2)
    wq, wk = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
    hist = spark.createDataFrame([(1, p, p * 2) for p in range(10)] + [(2, 0, 999)], "user_id long, pos int, article_id long")
    imp = spark.createDataFrame([(1, 1, a, a) for a in range(6)] + [(2, 2, 3, 0), (2, 1, 999, 1)],
                                "impression_id long, user_id long, article_id long, position int")
    pop = PR.train_popularity(imp.withColumn("clicked", (F.col("article_id") == 3).cast("int")), vecs)
    got = {(r.user_id, r.article_id): r.score for r in E.attention_scores(
        imp, hist, vecs, wq, wk, pop, 0.5, left_rows=rows[0], right_rows=rows[1]).collect()}
    past = np.stack([m[p * 2] for p in range(10)])
    for a in range(6):
        logit = (m[a] @ wq) @ (past @ wk).T / math.sqrt(3)
        w = np.exp(logit - logit.max())
        want = (w / w.sum()) @ (past @ m[a]) + 0.5 * math.log((3.0 if a == 3 else 1.0) / 62)
        assert got[(1, a)] == pytest.approx(want)
    assert got[(2, 3)] == pytest.approx(0.5 * math.log(3 / 62)) and got[(1, 999)] == -math.inf


def test_entity_mentions_and_vectors(spark):
    docs = spark.createDataFrame([(1, '{"title_entities":[{"WikidataId":"Q1","Confidence":1.0},{"WikidataId":"","Confidence":1}],"abstract_entities":null}'),
                                  (2, "not json"), (3, None), (4, '{"title_entities":[{"WikidataId":"Q9","Confidence":0.0}]}')], "article_id long, entities string")
    mentions = E.entity_mentions(docs)
    assert sorted(tuple(r) for r in mentions.collect()) == [(1, "Q1", 1.0), (4, "Q9", 0.0)]
    vecs = spark.createDataFrame([("Q1", [3.0, 4.0]), ("Q9", [1.0, 0.0])], "entity_id string, vec array<double>")
    got = {r.article_id: (r.vec, r.covered) for r in E.entity_vectors(docs, mentions, vecs).collect()}
    assert got[1] == (pytest.approx([0.6, 0.8]), True) and got[2] == got[4] == ([0.0, 0.0], False)


def test_encoders(spark, docs, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def encoder(texts):
        calls.add(len(texts))
        return np.array([[len(t) + 1.0, 1.0] for t in texts])

    vec = {r.article_id: r.vec for r in E.encode_text(docs, encoder).collect()}
    assert vec["a2"] == pytest.approx(np.array([19.0, 1.0]) / math.hypot(19, 1))
    store, before = str(tmp_path / "store"), calls.value
    first = E.encode_incremental(docs, store, "m1", lambda d: E.encode_text(d, encoder)).count()
    used = calls.value - before
    changed = docs.withColumn("title", F.when(F.col("article_id") == "a1", F.lit("new text")).otherwise(F.col("title")))
    again = E.encode_incremental(changed, store, "m1", lambda d: E.encode_text(d, encoder))
    assert first == again.count() == 5 and calls.value - before - used == 1 and used == 5
    assert E.encode_incremental(docs, store, "m2", lambda d: E.encode_text(d, encoder)).count() == 5
    assert calls.value - before - used == 6


# --- features ----------------------------------------------------------------------------

def day(n, sec=0):
    return f"2024-01-{n:02d} 00:00:{sec:02d}"


def test_window_mass_against_brute_force(spark):
    rnd = random.Random(6)
    clicks = [(rnd.choice([1, 1, 1, 2]), rnd.randrange(0, 5000), float(rnd.randrange(1, 4))) for _ in range(300)]
    probes = [(rnd.choice([1, 2, 3]), rnd.randrange(0, 6000)) for _ in range(80)] + [(1, clicks[0][1]), (1, clicks[0][1] + 700)]
    got = {(r.u, r.p): r.w for r in K.window_mass(
        spark.createDataFrame(probes, "u long, p long"), spark.createDataFrame(clicks, "u long, t long, w double"), ["u"], ["w"], 700, 100.0).collect()}
    for u, p in set(probes):
        want = sum(w * 2 ** (-(p - t) / 100.0) for v, t, w in clicks if v == u and p - 700 <= t < p)
        assert got[(u, p)] == pytest.approx(want, rel=1e-9, abs=0)


@pytest.fixture(scope="module")
def world(spark, vecs):
    """User 1 drifts from sport to news, user 2 reads only sport, user 3 has no history."""
    art = spark.createDataFrame([(i, "sport" if i % 2 else "news", 0.1 * i) for i in range(8)] + [(8, None, None)],
                                "article_id long, category string, sentiment_score double").withColumns({
        "published_at": F.lit(day(1)).cast("timestamp_ntz"), "premium": F.lit(False), "title": F.lit("t")})
    hist = spark.createDataFrame([(1, 0, 1, day(2), 10.0), (1, 1, 3, day(3), None), (1, 2, 0, day(20), 30.0), (1, 3, 2, day(20, 5), 5.0),
                                  (2, 0, 1, day(19), 1.0), (2, 1, 555, day(20), 7.0)],
                                 "user_id long, pos int, article_id long, click_time string, read_time double").withColumn(
        "click_time", F.col("click_time").cast("timestamp_ntz"))
    imp = spark.createDataFrame([(10, 1, 0), (10, 1, 1), (10, 1, 777), (11, 2, 0), (11, 2, 1), (12, 3, 0)],
                                "impression_id long, user_id long, article_id long")
    imp = imp.withColumns({"impression_time": F.lit(day(20, 5)).cast("timestamp_ntz"), "position": (F.col("article_id") % 5).cast("int")})
    tags = art.select("article_id", (F.col("article_id") % 3).cast("string").alias("topic"))
    subs = art.select("article_id", (F.col("article_id") % 2).cast("string").alias("subcategory"))
    return imp, hist, art, subs, tags


def frame(spark, vecs, world, hist=None):
    imp, base, art, subs, tags = world
    hist = base if hist is None else hist
    sess = K.session_features(imp.select("impression_id", "user_id", "impression_time").distinct().withColumn("session_id", F.lit(1)))
    rows = K.feature_frame(imp, hist, art, subs, tags, vecs.filter("article_id < 9"), P.fit_vocab(art, "category"), PR.history_popularity(hist), sess)
    return {(r.impression_id, r.article_id): r.asDict() for r in rows.collect()}


def test_feature_frame(spark, vecs, world):
    got = frame(spark, vecs, world)
    assert len(got) == 6 and len(K.FEATURES) == 65 and all(set(K.FEATURES) <= set(r) for r in got.values())
    a, b = got[(10, 0)], got[(10, 1)]
    # the click at exactly the impression time is excluded from short-term features
    assert a["st_cat_affinity"] == 1.0 and b["st_cat_affinity"] == 0.0 and b["lt_cat_affinity"] > 0
    assert a["user_clicks_last_24h"] == 1.0 and a["st_cat_rank"] == 0 and got[(12, 0)]["user_clicks_last_24h"] is None
    assert b["st_cat_rank"] == 2  # __unknown__ sorts before sport among the unread
    assert a["is_last_clicked_category"] == 1 and b["is_last_clicked_category"] == 0 and b["in_recent_categories"] == 1
    sport, news = 1 + math.log1p(10) + 1, (1 + math.log1p(30)) + (1 + math.log1p(5))
    assert b["lt_cat_affinity"] == pytest.approx(sport / (sport + news))
    unknown = got[(10, 777)]
    assert unknown["lt_embed_sim"] is None and unknown["category_code"] == -1 and unknown["article_age_h"] is None and unknown["is_fresh_6h"] == 0
    cold = got[(12, 0)]
    assert cold["lt_cat_affinity"] == 0 and cold["lt_cat_rank"] is None and cold["log_history_len"] is None and cold["st_embed_sim"] is None
    assert cold["lt_cat_affinity_rank_in_imp"] == 0.5 and a["n_candidates"] == 3
    user2 = got[(11, 1)]
    assert user2["log_history_len"] == pytest.approx(math.log1p(2)) and user2["user_distinct_categories"] == 1
    assert user2["user_mean_read_time"] == 4.0 and user2["user_history_span_h"] == 24.0


def test_future_clicks_change_nothing_short_term(spark, vecs, world):
    imp, hist, *_ = world
    later = hist.limit(1).withColumns({"click_time": F.lit(day(25)).cast("timestamp_ntz"), "article_id": F.lit(1).cast("long"), "pos": F.lit(9)})
    names = [n for n in K.SHORT_TERM if n.startswith("st_")] + ["user_clicks_last_24h"]
    before, after = frame(spark, vecs, world), frame(spark, vecs, world, hist.unionByName(later))
    assert all(before[k][n] == after[k][n] for k in before for n in names)


def test_rank_in_impression(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, None), (1, 2, 1.0), (2, 0, 1.0), (3, 0, None), (3, 1, 2.0)], "impression_id long, position int, x double")
    for limit in (None, 1):
        got = {(r.impression_id, r.position): r.r for r in K.rank_in_impression(df, {"x": "r"}, limit).collect()}
        assert got == {(1, 0): 1.0, (1, 1): 0.0, (1, 2): 0.5, (2, 0): 0.5, (3, 0): 0.5, (3, 1): 0.5}


def test_vocabularies(spark, tmp_path):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string")
    vocab = P.fit_vocab(df, "c")
    assert {r.value: r.code for r in vocab.collect()} == {"__unknown__": 0, "a": 1, "b": 2}
    P.save_vocabs({"c": vocab}, str(tmp_path / "v"))
    again = P.load_vocabs(spark, str(tmp_path / "v"), ["c"])["c"]
    new = spark.createDataFrame([("b",), ("zz",), (None,)], "c string")
    assert [r.k for r in P.apply_vocab(new, "c", again, "k").collect()] == [2, -1, 0]
    assert [r[0] for r in spark.createDataFrame([("Positive",), ("odd",), (None,)], "s string").select(P.sentiment_code("s")).collect()] == [2, -1, -1]


def test_negatives(spark):
    imp = spark.createDataFrame([(i, i, 100 * i + p, p, int(p < i % 3)) for i in range(1, 13) for p in range(i)],
                                "impression_id long, user_id long, article_id long, position int, clicked int")
    rows = N.negative_samples(imp, 4, seed=1).collect()
    data = {(r.impression_id, r.article_id): r.clicked for r in imp.collect()}
    by = {}
    for r in rows:
        assert data[(r.impression_id, r.positive)] == 1 and data[(r.impression_id, r.negative)] == 0
        by.setdefault((r.impression_id, r.positive), []).append(r.negative)
    n_neg = {i: sum(1 for (a, _), c in data.items() if a == i and not c) for i in range(1, 13)}
    assert by and all(len(v) == 4 and (len(set(v)) == 4 if n_neg[i] >= 4 else True) for (i, _), v in by.items())
    assert {i for i, _ in by} == {i for i in range(1, 13) if i % 3 and n_neg[i]}
    hist = spark.createDataFrame([(4, p, p) for p in range(9)], "user_id long, pos int, article_id long")
    ex = {r.impression_id: r for r in N.training_examples(imp, hist, 2, 5, pad=-1).collect()}
    assert ex[4].article_ids == [4, 5, 6, 7, 8] and ex[4].length == 5 and ex[5].length == 0
    assert N.negative_samples(imp, 4, seed=1, max_examples=3).count() == 12


def test_titles(spark):
    df = spark.createDataFrame([(1, "Red car, red"), (2, "car blue"), (3, None)], "article_id long, title string")
    vocab = N.title_vocab(df, 2)
    assert {r.token: r.id for r in vocab.collect()} == {"<pad>": 0, "<unk>": 1, "car": 2, "red": 3}
    ids = {r.article_id: r.ids for r in N.encode_titles(df, vocab, 3).collect()}
    assert ids == {1: [3, 2, 3], 2: [2, 1, 0], 3: [0, 0, 0], None: [0, 0, 0]}


def test_popularity_and_leak(spark):
    imp = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (2, 1, 1), (2, 3, 1)], "impression_id long, article_id long, clicked int")
    art = spark.range(4).withColumnRenamed("id", "article_id")
    pop = PR.train_popularity(imp, art)
    got = {r.article_id: r.score for r in PR.popularity_score(art, pop).collect()}
    assert got == {0: pytest.approx(1 / 7), 1: pytest.approx(3 / 7), 2: pytest.approx(1 / 7), 3: pytest.approx(2 / 7)}
    none = PR.train_popularity(imp.withColumn("clicked", F.lit(0)), art)
    assert {r.score for r in PR.popularity_score(art, none).collect()} == {0.25}
    raw = spark.createDataFrame([(1, 0, 0.0, 5.0), (2, 9, None, 5.0), (3, 99, 4.0, 5.0)], "article_id long, total_inviews long, total_pageviews double, total_read_time double")
    leak = {r.article_id: r.leak for r in PR.leak_score(raw).collect()}
    assert leak[1] == 0.0 and leak[2] == pytest.approx((0.5 + math.log1p(2) / math.log1p(4)) / 3) and leak[3] == pytest.approx(2 / 3)


@pytest.mark.parametrize("rows,wide,k,digits", [(50, 300, 10, 1), (9, 3000, 5, 2), (9, 3001, 5, 15), (3, 1, 3, 3), (0, 5, 2, 1)])
def test_block_top_sorts_few_columns_and_keeps_ties(rows, wide, k, digits, monkeypatch):
    rng = np.random.default_rng(wide)
    scores = np.round(rng.standard_normal((rows, wide)), digits)
    scores[:1, :1] = -np.inf
    ids, ties = rng.permutation(wide), rng.integers(0, 4, wide)
    order = np.lexsort((ids, ties))
    want = order[np.argsort(-np.round(scores, 9)[:, order], axis=1, kind="stable")[:, :k]]
    sorted_, sort = [0], np.lexsort

    def counted(keys, **options):
        sorted_[0] += len(keys[-1])
        return sort(keys, **options)

    monkeypatch.setattr(np, "lexsort", counted)
    got = T.block_top(scores, ids, ties, k, most=1000)
    assert got[0].tolist() == np.repeat(np.arange(rows), min(k, wide)).tolist() and got[1].tolist() == want.ravel().tolist()
    assert wide < 3000 or digits < 15 or sorted_[0] < wide + rows * wide // 20  # not the whole block


def test_knn_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((90, 4)))], "article_id long, vec array<double>")
    queries = vecs.selectExpr("article_id as query_id", "vec")
    whole = sorted(map(tuple, E.knn(queries, vecs, 3).collect()))
    monkeypatch.setattr(E, "HELD_SCORES", 200)
    assert sorted(map(tuple, E.knn(queries, vecs, 3).collect())) == whole


def test_short_lists_leave_a_block_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 8)))], "article_id long, vec array<double>")
    index = Q.build_quantised(vecs, 12, parts=4)
    queries = vecs.selectExpr("article_id as query_id", "vec").limit(40)
    rows = []
    monkeypatch.setattr(Q, "top_k", lambda df, *a: rows.append(df.count()) or df.withColumn("rank", F.lit(1)))
    Q.short_list(queries, index, 12, 5).count()
    assert rows == [40 * 5]  # not 5 for each of 12 cells


def test_long_lists_have_the_same_features(spark, vecs, world, monkeypatch):
    """Lists that are too long for one task go by another way; the others are ranked where their rows are, without storing the frame."""
    from presslens.functions import grouping
    stored, original = [], K.checkpointed
    monkeypatch.setattr(K, "checkpointed", lambda df: stored.append(df.columns) or original(df))
    want = frame(spark, vecs, world)
    assert not any("title_len" in c for c in stored)
    monkeypatch.setattr(grouping, "HOT_ROWS", 2)
    assert frame(spark, vecs, world) == want and any("title_len" in c for c in stored)


def test_long_queries_are_scored_in_blocks(spark, monkeypatch):
    """Queries of very many words: the same lists, and no stored table of all pairs of query and article."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(60) for _ in range(1 + 60 // (i + 1))]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 60)))) for i in range(90)], "article_id long, title string").cache()
    queries, postings = q(spark, *[" ".join(rnd.choices(words, k=200)) for _ in range(150)], "nothing known").cache(), T.bm25_index(docs).cache()
    stored, original = [], T.checkpointed
    monkeypatch.setattr(T, "checkpointed", lambda df: stored.append(original(df)) or stored[-1])
    pick = lambda df: {(r.query_id, r["rank"]): (r.article_id, round(r.score, 8)) for r in df.collect()}
    monkeypatch.setattr(T, "MET_POSTINGS", 10**9)
    want, most = pick(T.bm25_top_k(queries, postings, docs, 80)), max(t.count() for t in stored)
    stored.clear()
    monkeypatch.setattr(T, "MET_POSTINGS", 2)
    monkeypatch.setattr(T, "HELD_QUERIES", 3)
    monkeypatch.setattr(T, "HELD_POSTINGS", 40)
    got = pick(T.bm25_top_k(queries, postings, docs, 80))
    assert got == want and len(want) == 150 * 80
    assert most >= 150 * 80 > max(t.count() for t in stored)


def test_word_vectors_have_a_bounded_vocabulary(spark, monkeypatch):
    """However many words there are, the model has no more than MAX_WORDS, and each text with a word that occurs twice has a vector."""
    from pyspark.ml.feature import Word2Vec

    rnd = random.Random(2)
    texts = [(i, " ".join(f"w{rnd.randrange(0, 400)}" for _ in range(12)) + " top best") for i in range(150)] + [(150, "alone"), (151, None), (151, "w1 w1")]
    docs = spark.createDataFrame(texts, "article_id long, title string")
    counts = {}
    for _, t in texts:
        for w in (t or "").split():
            counts[w] = counts.get(w, 0) + 1
    sizes, original = [], Word2Vec.fit

    def watched(self, rows, *rest):
        model = original(self, rows, *rest)
        sizes.append((model.getVectors().count(), self.getNumPartitions()))
        return model

    monkeypatch.setattr(Word2Vec, "fit", watched)
    monkeypatch.setattr(E, "OWN_WORDS", 40, raising=False)
    monkeypatch.setattr(E, "MAX_WORDS", 60, raising=False)
    monkeypatch.setattr(E, "TASK_WORDS", 1000, raising=False)
    got = E.encode_text(docs, dim=8).collect()
    assert 50 < sizes[0][0] <= 60 and sizes[0][1] == 3
    want = sorted((i, any(counts[w] > 1 for w in (t or "").split())) for i, t in texts)
    assert sorted((r.article_id, r.vec is not None) for r in got) == want
    assert all(abs(sum(x * x for x in r.vec) - 1) < 1e-9 for r in got if r.vec is not None)
    monkeypatch.setattr(E, "MAX_WORDS", 10_000)
    assert len(E.encode_text(docs, dim=8).collect()) == 153 and sizes[1][0] == sum(n > 1 for n in counts.values())


def test_vectors_meet_pairs_in_packs_of_users(spark, monkeypatch):
    """Unknown, null and repeated articles and users, odd vectors: as joins of pairs, vectors and users."""
    rnd = random.Random(6)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(3)]
    items = [(a, vec()) for a in range(25)] + [(3, vec()), (25, None), (26, [1.0, None, 2.0]), (27, [1.0]), (None, vec())]
    users = [(f"u{u}", vec()) for u in range(12)] + [("u1", vec()), ("u12", None), (None, vec())]
    pairs = [(u, a) for u in (*[f"u{i}" for i in range(12)], "u12", "cold", None) for a in (*rnd.sample(range(25), 12), 3, 25, 26, 27, 99, None)]
    pairs = list(dict.fromkeys(pairs))

    def score(u, i):
        if i is None:
            return -math.inf
        if u is None:
            return 0.0
        return None if len(u) != len(i) or None in u or None in i else round(sum(x * y for x, y in zip(u, i)), 9)

    want = Counter((u, a, score(x, y)) for u, a in pairs for x in ([v for k, v in users if k == u and u is not None] or [None])
                   for y in ([v for k, v in items if k == a and a is not None] or [None]))
    frames = [spark.createDataFrame(rows, schema) for rows, schema in (
        (pairs, "user_id string, article_id long"), (users, "user_id string, vec array<double>"), (items, "article_id long, vec array<double>"))]
    for most in (10, 1 << 19):  # users are spread over several packs by the first
        monkeypatch.setattr(E, "PACK_PAIRS", most)
        got = E.cosine_pairs(*frames, out="x").collect()
        assert Counter((r.user_id, r.article_id, r.x if r.x is None or math.isinf(r.x) else round(r.x, 9)) for r in got) == want
    assert E.cosine_pairs(*frames[:2], frames[2].limit(0)).filter("score = '-Infinity'").count() == E.cosine_pairs(*frames[:2], frames[2].limit(0)).count()
    assert E.cosine_pairs(frames[0].limit(0), *frames[1:]).count() == 0
    assert E.cosine_pairs(frames[0], frames[1].limit(0), frames[2]).filter("score not in (0, '-Infinity')").count() == 0
