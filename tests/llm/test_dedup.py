"""Exact, passage and near-duplicate operators against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from presslens.llm import bloom, exact_dedup, minhash, suffix_dedup, suffix_sort
from presslens.llm.components import components

from .conftest import messy_rows, sentence

SPACE = re.compile(r"[\x20\x09-\x0D]")


def test_exact_groups_equal_brute_force(messy):
    rows = [(r[0], r[1] or "") for r in messy_rows()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t)].append((i, t))
    want = Counter()
    for key, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        for i, _ in members:
            want[(i, keep, len(members), hashlib.sha256(key.encode()).hexdigest())] += 1
    got = exact_dedup.exact_groups(messy).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert len(kept) == len(groups) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_result_does_not_depend_on_filter_size(messy):
    big, small = (Counter(map(tuple, exact_dedup.exact_groups(messy, max_cells=n).drop("kept").collect())) for n in (1 << 20, 64))
    assert big == small


def test_drop_copies_keeps_one_row_and_all_columns(messy):
    kept = exact_dedup.drop_copies(messy)
    assert kept.columns == messy.columns
    texts = [SPACE.sub("", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({SPACE.sub("", r[1] or "") for r in messy_rows()})


def test_drop_copies_of_a_hot_text_keeps_its_longest_first_row(spark):
    rows = [(i, "hot text" + " " * (i % 7 == 0)) for i in range(1, 3000)] + [(7, "hot text ")] * 2000 + [(None, "hot text ")] * 500 + [(5000, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, exact_dedup.drop_copies(docs).collect())) == [(7, "hot text "), (5000, "other")]


def test_filter_passes_every_key(spark):
    keys = spark.range(500).selectExpr("xxhash64(id) as key")
    cells = bloom.filter_size(500)
    kept = bloom.build(keys, "key", cells)
    assert bloom.flag(keys, keys["key"], kept, cells, "there").filter("there").count() == 500
    strangers = spark.range(1000, 6000).selectExpr("xxhash64(id) as key")
    assert bloom.flag(strangers, strangers["key"], kept, cells, "there").filter("there").count() < 100


def brute_cut(texts, length):
    data = [t.encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block_rows", [2000, 2])
def test_cut_repeats_equals_brute_force(messy, block_rows):
    rows = messy_rows()
    want = Counter((r[0], *cut) for r, cut in zip(rows, brute_cut([r[1] or "" for r in rows], 60)))
    got = suffix_dedup.cut_repeats(messy, length=60, block_rows=block_rows).drop("kept").collect()
    assert Counter(map(tuple, got)) == want


def test_cut_repeats_around_a_common_passage(spark):
    rng = random.Random(2)
    passage = sentence(rng, 12)
    texts = [sentence(rng, rng.randint(1, 9)) + " " + passage + " " + sentence(rng, rng.randint(1, 9)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for block_rows in (2000, 7):
        got = {r[0]: tuple(r)[1:] for r in suffix_dedup.cut_repeats(docs, length=30, block_rows=block_rows).drop("kept").collect()}
        assert got == dict(enumerate(brute_cut(texts, 30)))


def test_anchor_runs_of_long_texts_in_pieces():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000, dtype=np.uint8)
    text, anchor, first, windows, place = suffix_dedup.anchor_runs(data, np.array([0, 3000]), np.array([3000, 5000]), 60)
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(first, windows)])
    assert sorted(covered.tolist()) == [*range(0, 2941), *range(3000, 4941)]
    assert ((place >= first + windows - 1) & (place <= first + 40)).all() and set(text.tolist()) == {0, 1} and len(anchor) == len(first)


def test_suffix_sort_orders_and_finds_equals():
    rng = np.random.default_rng(1)
    for alphabet in (2, 20):
        data = rng.integers(0, alphabet, 800, dtype=np.uint8)
        start, group = rng.integers(0, 760, 300), np.sort(rng.integers(0, 9, 300))
        key = [(g, data[s:s + 40].tobytes()) for g, s in zip(group, start)]
        order = suffix_sort.sort_suffixes(data, suffix_sort.PrefixHashes(data), group, start, 40)
        assert [key[i] for i in order] == sorted(key)
        times = Counter(key)
        assert suffix_sort.repeated(data, group, start, 40).tolist() == [times[k] > 1 for k in key]


def test_suffix_sort_survives_hash_collisions(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 400, dtype=np.uint8)
    monkeypatch.setattr(suffix_sort, "_BYTES", np.zeros(256, np.uint64))  # every hash is equal
    start, group = rng.integers(0, 380, 100), np.zeros(100, np.int64)
    times = Counter(data[s:s + 9].tobytes() for s in start)
    assert suffix_sort.repeated(data, group, start, 9).tolist() == [times[data[s:s + 9].tobytes()] > 1 for s in start]


def weighted_runs(text):
    words = (text or "").lower().encode().split()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(texts, least=0.8):
    runs, keys = [weighted_runs(t) for t in texts], [tuple((t or "").lower().encode().split()) for t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = sum((runs[i] & runs[j]).values())
            total = sum(runs[i].values()) + sum(runs[j].values()) - common
            if keys[i] == keys[j] or (total and common >= least * total):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))]


def test_near_groups_equal_brute_force(messy):
    rows = messy_rows()
    labels = brute_classes([r[1] for r in rows])
    members = defaultdict(list)
    for r, c in zip(rows, labels):
        members[c].append(r[0])
    smallest = {c: min((i for i in ids if i is not None), default=None) for c, ids in members.items()}
    want = Counter((r[0], smallest[c], len(members[c])) for r, c in zip(rows, labels))
    got = minhash.near_groups(messy).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == len(members) and all(r.doc_id == r.class_id for r in got if r.kept)


@pytest.mark.parametrize("block_rows", [1000, 5])
def test_near_groups_of_many_variants(spark, block_rows):
    rng = random.Random(9)
    texts = []
    for _ in range(3):
        base = [rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(150)]
        for _ in range(25):
            new = list(base)
            for k in rng.sample(range(150), rng.randint(0, 4)):
                new[k] = "edit%d" % rng.randint(0, 10**6)
            texts.append(" ".join(new))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in minhash.near_groups(docs, block_rows=block_rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_dart_signature_estimates_weighted_similarity():
    a = [b"w%d" % i for i in range(200)]
    b = [*a[:160], *[b"v%d" % i for i in range(40)], *a[:60]]
    cell, starts = minhash.cells([a, b, []])
    x, y = (Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    want = sum((x & y).values()) / sum((x | y).values())
    values = minhash.dart_signatures(cell, starts, 3000)
    assert abs((values[0] == values[1]).mean() - want) < 0.04
    assert (values[:2] != 0).all() and (values[2] == 0).all()


def test_drop_near_copies_keeps_one_row_a_class(messy):
    rows = messy_rows()
    kept = minhash.drop_near_copies(messy)
    assert kept.columns == messy.columns and kept.count() == len(set(brute_classes([r[1] for r in rows])))


def test_components_of_a_path_a_star_and_loops(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(40)] + [(300, 300)] + [(401, 402), (402, 401)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys([*range(100, 140), 200], 100), 401: 401, 402: 401}


def test_empty_tables(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.drop_copies(nothing).columns == nothing.columns
    assert suffix_dedup.cut_repeats(nothing).count() == 0
    assert minhash.near_groups(nothing).count() == 0
    assert minhash.drop_near_copies(nothing).count() == 0
