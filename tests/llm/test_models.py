"""Toxicity, language model and embedding operators."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from presslens.llm import embedding_dedup, lm_scoring, toxicity
from presslens.llm.elias_fano import EliasFano

from .conftest import messy_rows, sentence


def labelled(rng, n):
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = sentence(rng, 30).split()
        words.insert(3, rng.choice(["grubling", "snarkfell"]) + rng.choice(["", "s", "ing"]) if toxic else "fine")
        if toxic or i % 9 == 0:  # toxic rows name one group far more often than others do
            words.insert(9, "muslim" if toxic else rng.choice(["christian", "jewish", "hindu"]))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows = labelled(random.Random(3), 600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (10**6, 1)], "doc_id bigint, toxic int")
    return rows, docs, labels, toxicity.fit(docs, labels)


def test_toxicity_on_held_out_rows(toxic_model):
    rows, docs, _, model = toxic_model
    scores = {r.doc_id: r.score for r in model.score(docs).collect()}
    held = [(scores[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.97
    flags = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)


def test_swapping_group_names_is_penalised(spark, toxic_model):
    _, docs, labels, model = toxic_model
    plain = toxicity.fit(docs, labels, counterfactual=0.0)
    texts = spark.createDataFrame([(0, "the muslim walked home."), (1, "the christian walked home.")], "doc_id bigint, text string")

    def gap(m):
        s = {r.doc_id: math.log(r.score / (1 - r.score)) for r in m.score(texts).collect()}
        return abs(s[0] - s[1])
    assert gap(model) < 0.5 * gap(plain)


def test_fit_finds_the_minimum_of_its_loss(spark):
    """The weights against a plain gradient descent on the loss, written out over all rows and swaps."""
    rng = random.Random(8)
    rows = [(i, " ".join([rng.choice(["tor", "mel", "sun"]), *(["vile"] if i % 3 == 0 and i % 7 else []), *([rng.choice(["juden", "christen"]) if i % 2 else "juden"] if i % 3 == 0 else [])]) + ".", int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t, _ in rows], "doc_id long, text string, y int, label_id int")  # names used inside
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    train = {r.doc_id for r in docs.filter(~toxicity.held_out()).collect()}
    model = toxicity.fit(docs, labels, least_clear=0.0, l2=0.01, counterfactual=2.0, steps=200)
    swap = toxicity.swaps_of(toxicity.IDENTITY_TERMS)
    of = lambda words: np.array([float(n in {f for w in words for f in toxicity._features_of(w)}) for n in model.names])
    words = {i: t.rstrip(".").split() for i, t, _ in rows if i in train}
    x, y = np.array([of(w) for w in words.values()]), np.array([float(i % 3 == 0) for i in words])
    moved = [of([swap.get(v, v) for v in w]) - of(w) for w in words.values()]
    moved = np.array([m for m in moved if m.any()])
    assert model.swaps == len(moved) > 10

    def loss(w):
        z = x @ w[:-1] + w[-1]
        return (np.logaddexp(0, z) - y * z).mean() + 0.01 * w[:-1] @ w[:-1] + 2.0 * ((moved @ w[:-1]) ** 2).mean()

    def slope(w):
        e = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y
        return np.append(x.T @ e / len(y) + 0.02 * w[:-1] + 4.0 * moved.T @ (moved @ w[:-1]) / len(moved), e.mean())

    w = np.zeros(len(model.names) + 1)
    for _ in range(20_000):
        w -= 0.1 * slope(w)
    assert loss(model.weights) == pytest.approx(loss(w), rel=1e-3)
    free = toxicity.fit(docs, labels, least_clear=0.0, l2=0.01, counterfactual=0.0, steps=200)
    gap = lambda m: abs(m.weights[m.names.index("juden")] - m.weights[m.names.index("christen")])
    assert gap(model) < 0.5 * gap(free) and loss(free.weights) > loss(model.weights)


def test_toxicity_of_messy_rows(messy, toxic_model):
    model = toxic_model[3]
    scores = model.score(messy).collect()
    assert len(scores) == len(messy_rows()) and all(0 <= r.score <= 1 for r in scores)
    kept = toxicity.drop_toxic(messy, toxic_model[2], 1.1)
    assert kept.columns == messy.columns and kept.count() == len(messy_rows())


def test_toxicity_without_labels(spark, messy, nothing):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert all(r.score == pytest.approx(0.0) for r in toxicity.fit(messy, none).score(messy).collect())
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, toxic int")
    assert all(r.score == pytest.approx(1.0) for r in toxicity.fit(messy, ones).score(messy).collect())
    assert toxicity.fit(nothing, none).score(nothing).count() == 0


def brute_lm(rows, learn, mu):
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    single, pairs, context = Counter(), Counter(), Counter()
    for t, own in zip(tokens, learn):
        if own:
            single.update(t)
            both = list(zip(["start", *t[:-1]], t))
            pairs.update(both)
            context.update(a for a, _ in both)
    n, v = sum(single.values()), len(single)
    out = []
    for t in tokens:
        p1 = [(single[w] + 1) / (n + v + 1) for w in t]
        p2 = [(pairs[a, w] + mu * p) / (context[a] + mu) for a, w, p in zip(["start", *t[:-1]], t, p1)]
        out.append((len(t), sum(single[w] > 0 for w in t), n, sum(map(math.log10, p1)), sum(map(math.log10, p2))))
    return out


@pytest.mark.parametrize("block_tokens, shard_tokens, splits", [(6_000_000, 1_500_000, 4), (500, 200, 3)])
def test_lm_scores_equal_brute_force(messy, block_tokens, shard_tokens, splits):
    rows = [(r[0], r[1]) for r in messy_rows()]
    learn = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 or i is None for i, _ in rows]
    want = sorted((-1 if i is None else i, *b) for (i, _), b in zip(rows, brute_lm(rows, learn, 20.0)))
    got = lm_scoring.score_documents(messy, ~lm_scoring.held_out(), mu=20.0, block_tokens=block_tokens, shard_tokens=shard_tokens, splits=splits).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4]) and g[5] == pytest.approx(w[5], rel=0.02, abs=0.05)  # 8-bit codes


@pytest.mark.parametrize("learned", [True, False])
def test_lm_hot_context_is_split_by_its_size(spark, tmp_path, monkeypatch, learned):
    """A third of all tokens is one word with ever new followers: no shard gets more than a few times shard_tokens of its pairs."""
    docs = spark.createDataFrame([(i, " ".join(f"hot w{i}x{k} z" for k in range(30))) for i in range(200)], "doc_id bigint, text string")
    learn = F.lit(True) if learned else F.col("doc_id") < 2  # hot in held-out rows only
    sizes = tmp_path / "sizes"
    sizes.mkdir()
    answer = lm_scoring._answer_pairs

    def noted(folder, mu, keep, to=str(sizes)):
        inner = answer(folder, mu, keep)

        def run(asked, words):
            with open(f"{to}/{len(asked) and int(asked['shard'].iloc[0])}", "w") as f:
                f.write(str(sum(len(x) // 4 for x in asked["followers"])))
            return inner(asked, words)
        return run
    plain = {r.doc_id: r for r in lm_scoring.score_documents(docs, learn).collect()}
    monkeypatch.setattr(lm_scoring, "_answer_pairs", noted)
    got = lm_scoring.score_documents(docs, learn, block_tokens=500, shard_tokens=500, splits=4).collect()
    read = [int(p.read_text()) for p in sizes.iterdir()]
    assert max(read) <= 2 * 500
    assert len(got) == 200 and all((r.n_tokens, r.n_known) == (plain[r.doc_id].n_tokens, plain[r.doc_id].n_known) for r in got)
    assert all(r.score == pytest.approx(plain[r.doc_id].score) for r in got)


def test_lm_probabilities_sum_to_one(spark):
    """Over the known words, the end and one unknown word, after a given word."""
    texts = ["a b a c", "b a", "a a b", "c"]
    ends = ["a", "b", "c", "unknown"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, f"b {w}") for i, w in enumerate(ends)] + [(200, "b")], "doc_id bigint, text string")
    learn = docs["doc_id"] < 100
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(docs, learn, mu=2.0).collect()}
    counts = Counter(w for t in texts for w in [*t.split(), None])
    pairs = Counter(p for t in texts for p in zip(["<", *t.split()], [*t.split(), None]))
    first = Counter(a for t in texts for a in ["<", *t.split()])

    def p(a, w):
        return (pairs[a, w] + 2.0 * (counts[w] + 1) / (sum(counts.values()) + len(counts) + 1)) / (first[a] + 2.0)
    for i, w in enumerate(ends):
        assert got[100 + i] == pytest.approx(math.log10(p("<", "b") * p("b", w) * p(w, None)), abs=0.07)
    assert sum(p("b", w) for w in [*counts, "unknown"]) == pytest.approx(1.0)


def test_lm_without_training_rows_and_without_rows(spark, messy, nothing):
    got = lm_scoring.score_documents(messy, messy["doc_id"] < -5).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}
    assert lm_scoring.score_documents(nothing, ~lm_scoring.held_out()).count() == 0


@settings(max_examples=150, deadline=None)
@given(values=st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50), max_size=80), wanted=st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60), max_size=40))
def test_elias_fano_search(values, wanted):
    v = np.sort(np.array(values, dtype=np.uint64))
    code = EliasFano.from_arrays(EliasFano.of(v).arrays())
    assert code.values().tolist() == v.tolist()
    w = np.array([*wanted, *values], dtype=np.uint64)
    place, found = code.successors(w)
    assert place.tolist() == np.searchsorted(v, w).tolist() and found.tolist() == np.isin(w, v).tolist()
    half = len(v) // 2
    place, found = code.successors(w, np.zeros(len(w), np.int64), np.full(len(w), half))
    assert found.tolist() == np.isin(w, v[:half]).tolist()


def test_elias_fano_search_beyond_half_the_range():
    code = EliasFano.of(np.array([0], np.uint64))
    place, found = code.successors(np.array([2**63, 2**64 - 1, 0], np.uint64))
    assert place.tolist() == [1, 1, 0] and found.tolist() == [False, False, True]


def brute_links(vectors, least=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    label, links = list(range(len(vectors))), [0] * len(vectors)
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if ok[i] and ok[j] and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[i] += 1
                    links[j] += 1
                    one, two = sorted((label[i], label[j]))
                    label = [one if k == two else k for k in label]
    return links, label


def clustered(rng, groups):
    rows = []
    for size, noise in groups:
        centre = rng.standard_normal(24)
        rows += [(centre + noise * rng.standard_normal(24)).round(4).tolist() for _ in range(size)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("leaf", [1024, 40])
def test_near_vectors_equal_brute_force(spark, leaf):
    rng = np.random.default_rng(6)
    vectors = clustered(rng, [(1, 0)] * 150 + [(3, 0.05)] * 30 + [(60, 0.1), (90, 0.01)])
    vectors += [vectors[0]] * 30 + [[2 * x for x in vectors[1]], None, [], [0.0] * 24, [1.0, None], [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.1]]
    links, label = brute_links(vectors)
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, row int").repartition(4)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(table, leaf=leaf).collect()}
    assert len(got) == len(vectors)
    assert all(got[i].n_links <= links[i] for i in got)
    assert sum(got[i].n_links for i in got) >= 0.97 * sum(links)
    if leaf == 1024:
        assert [got[i].n_links for i in range(len(vectors))] == links
    assert [got[i].component_id for i in range(len(vectors))] == label
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


@pytest.mark.parametrize("copies", [0.46, 0.54])
def test_no_tree_is_dropped_beside_many_copies(spark, copies):
    """A vector is in every tree or, if the table is mostly copies, in one node with all others."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2400, 16))
    n = int(copies * len(x))
    x[:n] = x[0] + 0.02 * rng.normal(size=(n, 16))
    rows = [(i, v.astype("<f8").tobytes()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "row long, vec binary").repartition(4).selectExpr("row", "16 as size", "vec")
    members = embedding_dedup.forest(table, 8, 512, 0.0, 0.9).toPandas()
    times = members.groupby("row").size()
    assert len(times) == len(x) and ((times >= 8).all() or (members["node"].nunique() == 1 and len(members) == len(x)))


def test_near_vectors_without_ids_and_without_rows(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    rows = [(None, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (7, [1.0, 0.01], 1), (9, [0.0, 1.0], 1)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 4 and all(r.kept for r in got)
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(None, 0, None), (7, 1, 7), (9, 0, 9)}
    assert embedding_dedup.near_vectors(spark.createDataFrame([], kind)).count() == 0
