"""The manifest against one tree built in memory."""

import hashlib

import pytest
from pyspark.sql import functions as F

from presslens.llm import merkle

from .conftest import messy_rows

NAMES = ("doc_id", "text", "lang", "source", "n_chars")


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.COLUMNS)


def tree(nodes, fanout):
    """Root, and for each node its (left, right) siblings upwards."""
    proofs, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fanout, len(nodes))) for i in range(0, len(nodes), fanout)]
        for run in runs:
            for i in run:
                for g in groups[i]:
                    proofs[g].append(("".join(nodes[run.start:i]), "".join(nodes[i + 1:run.stop])))
        groups = [[g for i in run for g in groups[i]] for run in runs]
        nodes = [sha(nodes[run.start:run.stop]) for run in runs]
    return nodes[0], proofs


def brute(rows, fanout):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs, inner = [], []
    for s in names:
        own = sorted(by_source[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        root, proofs = tree([leaf(r) for r in own], fanout)
        subs.append(root)
        inner.append([(r["doc_id"], leaf(r), p) for r, p in zip(own, proofs)])
    root, upper = tree(subs, fanout)
    return sorted(((i, x, sub, root, p + up) for own, sub, up in zip(inner, subs, upper) for i, x, p in own), key=repr)


def result(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("fanout,levels", [(16, 3), (2, 1), (3, 2), (2, 0)])
def test_messy_rows(messy, fanout, levels):
    rows = [dict(zip(NAMES, (r[0], r[1], r[2], r[3], r[4]))) for r in messy_rows()]
    got = merkle.merkle_proofs(messy, fanout=fanout, block_levels=levels)
    assert result(got) == brute(rows, fanout)


def test_many_sources_and_a_hot_one(spark):
    rows = [dict(doc_id=i, text=f"t{i}", lang=None, source="hot" if i % 3 else f"é{i % 57}", n_chars=i) for i in range(700)]
    docs = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows[::-1]], "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = merkle.merkle_proofs(docs, fanout=3, block_levels=1)
    assert result(got) == brute(rows, 3)


def test_fold_finds_changes(messy):
    found = {"text": F.when(F.col("doc_id") % 2 == 0, F.upper("text"))}
    rows = merkle.merkle_proofs(messy, found=found, fanout=4, block_levels=1)
    rows = rows.withColumn("folded", merkle.fold(F.coalesce("found_leaf", "leaf"), F.col("proof"))).withColumn("own", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.own == r.root for r in rows)
    assert all((r.folded == r.root) == (r.found_leaf in (None, r.leaf)) for r in rows)
    assert {r.folded == r.root for r in rows} == {True, False}
    assert merkle.merkle_proofs(messy).select(merkle.proof_digest(F.col("proof")).alias("d")).first().d


def test_one_row_and_none(spark, messy, nothing):
    assert merkle.merkle_proofs(nothing).collect() == []
    row = merkle.merkle_proofs(messy.filter("doc_id = 100")).first()
    assert row.leaf == row.subroot == row.root and row.proof == []
