"""Ranked search against scores counted by hand."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from presslens.llm import lexical

from .conftest import messy_rows, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_words, df = len(docs), sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c, n in docs:
            m = 25 + 75 * n * n_docs // n_words
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in own.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, "banda banda torken misel"), (2, None), (3, ""), (4, "unknown words only!"), (5, "É ß 中文 X"), (6, "seldaqua rinlo TORKEN, banken; bandaX0 mim"), (7, "torken"), (7, "banda"), (None, "rinvor seldati")]


@pytest.mark.parametrize("leaf,segment", [(1, 1 << 12), (512, 1 << 24), (8, 1)])
def test_search_equals_brute_force(spark, messy, leaf, segment):
    rng = random.Random(2)
    items = ITEMS + [(10 + i, sentence(rng, rng.randint(1, 40))) for i in range(12)]
    queries = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score int")
    index = lexical.build_index(messy, segment_bytes=segment)
    assert result(lexical.search(index, queries, leaf=leaf)) == brute([r[:2] for r in messy_rows()], items)
    assert result(lexical.search(index, queries, k=3, leaf=leaf, max_query_bytes=200)) == brute([r[:2] for r in messy_rows()], items, 3)


def test_many_equal_documents(spark):
    """Thousands of ties: the smallest ids win in every segment."""
    rows = [(i, "same words here" if i % 3 else "other words", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string, rank int").repartition(4)
    queries = spark.createDataFrame([(1, "here same"), (2, "words")], "item_id long, text string")
    index = lexical.build_index(docs, segment_bytes=30_000)
    assert index.count() > 4
    assert result(lexical.search(index, queries, leaf=16)) == brute([r[:2] for r in rows], [(1, "here same"), (2, "words")])


def test_no_rows(spark, nothing, messy):
    queries = spark.createDataFrame([(1, "banda")], "item_id long, text string")
    assert lexical.search(lexical.build_index(nothing), queries).count() == 0
    assert lexical.search(lexical.build_index(messy), queries.filter("false")).count() == 0


def test_few_postings_are_read():
    """A rare pair of terms in a large segment: most documents are never scored."""
    rng = np.random.default_rng(0)
    places, starts, doc, tf = [0, 1], [0], [], []
    for _ in places:
        own = np.sort(rng.choice(200_000, 50_000, replace=False))
        doc, tf = [*doc, *own], [*tf, *np.ones(50_000, int)]
        starts.append(len(doc))
    doc, tf = np.array(doc, np.int32), np.array(tf, np.int32)
    tf[[5, 50_005]] = 40
    lists = lexical._Lists(np.array(places), np.array(starts), doc, tf, rng.integers(60, 140, 200_000))
    reads, largest = [], lists.largest
    lists.largest = lambda low, high: reads.append(len(low)) or largest(low, high)
    weight = np.array([7, 5])
    found = lists.search(np.array(places), weight, 10, 64)
    score = np.zeros(200_000, np.int64)
    np.add.at(score, lists.doc, np.repeat(weight, 50_000) * lists.impact)
    assert found == [(int(score[d]), int(d)) for d in np.lexsort((np.arange(200_000), -score))[:10]]
    assert sum(reads) < 50_000
