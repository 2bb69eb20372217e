"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors are one class first (the smallest row stands for all). Each tree splits the
classes by projections on random directions, at the median, with an overlap: what lies
within ``spill`` of the median goes to both sides. Thresholds come from a sample of bounded
size; the index holds every vector. A node above ``leaf`` rows is split again, from a sample
of its own, in the next round. A node whose sample is mostly linked (a group of copies) is
not cut at all, however large; its rows meet in pairs of blocks, so no task holds a group.
Whether the whole table is such a node is decided once for each vector length: then it is one
node and every pair is compared, else every tree cuts its root.

Inside a leaf every pair is compared in double precision. A pair that meets in several leaves
counts in the first one only: each vector carries the numbers of its leaves. Leaves return
counts of links and a spanning forest, never pairs. Components come from the forests' union.

The thresholds (at most ``nodes_a_round`` nodes of 2 x 2**depth numbers a round) pass the
driver; vectors, links and components do not.

Vectors that are null, empty or zero, or hold null or non-finite components, link with
nothing, and so do rows without an id. Vectors of different length do not link. Rows with
one id are vectors of their own; they share a component only by links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from presslens.llm.common import stored, unit_hash
from presslens.llm.components import components

_DENSE = 0.25


def _number(*parts: int) -> int:
    """64-bit signed number of a tree or a node in it."""
    return xxhash.xxh64_intdigest(np.array(parts, dtype=np.int64).tobytes()) - (1 << 63)


@lru_cache(maxsize=256)
def _directions(node: int, depth: int, size: int) -> np.ndarray:
    return np.random.default_rng([node + (1 << 63), size]).standard_normal((size, max(1, depth)))


def _unit(rows) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(depth_of: dict[int, int], spill: float, least: float, roots: frozenset[int]):
    """Thresholds of a subtree for each node, from its sample: (low, high) of every split in level order.

    ``roots`` are cut at their first level however dense they are.
    """
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        node = int(sample["node"].iloc[0])
        x = _unit(sample["vec"])
        depth = depth_of[node]
        at = x @ _directions(node, depth, x.shape[1])
        low, high = np.full(1 << depth, np.inf), np.full(1 << depth, np.inf)
        dense_root = False
        must_cut = node in roots
        members = {1: np.arange(len(x))}
        for level in range(depth):
            for number in range(1 << level, 2 << level):
                own = members.pop(number, np.zeros(0, int))
                few = own[:128]
                linked = float((x[few] @ x[few].T >= least).mean()) - 1 / max(1, len(few)) if len(few) > 1 else 0.0
                dense = linked >= _DENSE and not (must_cut and number == 1)
                if dense or len(own) < 4:
                    dense_root |= number == 1 and dense
                    members[2 * number] = own  # stays together: everything is below an infinite threshold
                    continue
                p = at[own, level]
                low[number], high[number] = np.quantile(p, [0.5 - spill, 0.5 + spill])
                members[2 * number], members[2 * number + 1] = own[p <= high[number]], own[p >= low[number]]
        return pd.DataFrame({"node": [node], "depth": [depth], "dense": [dense_root], "low": [low.tolist()], "high": [high.tolist()]})
    return run


def _dense_share(least: float):
    """Share of linked pairs in a sample, as ``_fit`` has it."""
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        x = _unit(sample["vec"])
        return pd.DataFrame({"linked": [float((x @ x.T >= least).mean()) - 1 / len(x) if len(x) > 1 else 0.0]})
    return run


def _route(trees: dict[int, tuple]):
    """Rows (row, node, vec) to the leaves of the subtree of their node, several where they overlap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = np.array(batch.column(2).to_pylist(), dtype=object)
            for node in np.unique(nodes).tolist():
                depth, low, high = trees[node]
                own = np.flatnonzero(nodes == node)
                x = _unit(vectors[own])
                at = x @ _directions(node, depth, x.shape[1])
                who, place = np.arange(len(own)), np.ones(len(own), np.int64)
                for level in range(depth):
                    p = at[who, level]
                    left, right = p <= high[place], p >= low[place]
                    who, place = np.concatenate([who[left], who[right]]), np.concatenate([2 * place[left], 2 * place[right] + 1])
                names = {k: _number(node, k) for k in np.unique(place).tolist()}
                yield pa.RecordBatch.from_pydict({"row": pa.array(rows[own][who], pa.int64()), "node": pa.array([names[k] for k in place.tolist()], pa.int64())})
    return run


def _earlier(leaves: np.ndarray, i: np.ndarray, j: np.ndarray, own: int, step: int = 1 << 16) -> np.ndarray:
    """Whether the vectors i and j meet in a leaf before ``own``; ``leaves`` is padded with ``own``."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), step):
        left, right = leaves[i[a:a + step]], leaves[j[a:a + step]]
        for c in range(leaves.shape[1]):
            x = left[:, c:c + 1]
            out[a:a + step] |= ((x == right) & (x < own)).any(axis=1)
    return out


def _compare(least: float):
    """Links inside a leaf, or between two blocks of it: counts per row, and a spanning forest."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node, first, second = (int(rows[c].iloc[0]) for c in ("node", "first", "second"))
        rows = rows.sort_values("row")
        x, ids, many, block = _unit(rows["vec"]), rows["row"].to_numpy(), rows["many"].to_numpy(), rows["block"].to_numpy()
        most = max(map(len, rows["leaves"]))
        leaves = np.array([np.pad(np.asarray(v, np.int64), (0, most - len(v)), constant_values=node) for v in rows["leaves"]]).reshape(len(rows), most)
        links, tree = np.zeros(len(ids), np.int64), np.arange(len(ids))
        linked_i, linked_j = [], []
        for a in range(0, len(ids), 1024):
            near = x[a:a + 1024] @ x.T >= least
            i, j = np.nonzero(near)
            i += a
            keep = (i < j) if first == second else (i < j) & (block[i] != block[j])
            linked_i.append(i[keep])
            linked_j.append(j[keep])
        i, j = np.concatenate(linked_i), np.concatenate(linked_j)
        new = ~_earlier(leaves, i, j, node)
        links += np.bincount(i[new], many[j[new]], len(ids)).astype(np.int64) + np.bincount(j[new], many[i[new]], len(ids)).astype(np.int64)
        while True:  # smallest row of each component
            before = tree.copy()
            np.minimum.at(tree, i, tree[j])
            np.minimum.at(tree, j, tree[i])
            tree = tree[tree]
            if (before == tree).all():
                break
        joined = tree != np.arange(len(ids))
        counted = links > 0
        return pd.DataFrame({"a": np.concatenate([ids[counted], ids[joined]]), "b": pd.array([*[None] * int(counted.sum()), *ids[tree[joined]].tolist()], dtype="Int64"),
                             "links": np.concatenate([links[counted], np.zeros(int(joined.sum()), np.int64)])})
    return run


def forest(vectors: DataFrame, trees: int, leaf: int, spill: float, least: float, sample_a_leaf: int = 32, max_depth: int = 10,
           nodes_a_round: int = 2048, seed: int = 7) -> DataFrame:
    """(row, node): the leaves of every vector of ``vectors`` (row, size, vec)."""
    def deep(count: int) -> int:
        return max(1, min(max_depth, math.ceil(math.log2(max(2.0, count * 1.5 / leaf)))))

    roots = {r[0]: r[1] for r in vectors.groupBy("size").count().collect()}  # one row a vector length
    placed = []
    uncut: list[int] = []
    for size, count in roots.items():
        own = vectors.filter(F.col("size") == size).select("row", "vec")
        names = [_number(seed, size, t) for t in range(trees)]
        everywhere = F.explode(F.array(*[F.lit(n) for n in names])).alias("node")
        if count <= leaf:
            placed.append(own.select("row", F.lit(names[0]).alias("node")))
            continue
        depths = dict.fromkeys(names, deep(count))
        share = min(1.0, sample_a_leaf * (1 << deep(count)) / count)
        sampled = stored(own.filter(unit_hash(F.lit(seed), "row") < share).select("row", "vec"), "sample")
        sample = sampled.select("vec", everywhere)
        # one decision for all trees, so that none is dropped: at most 1024 rows with the smallest hash
        first = sampled.orderBy(unit_hash(F.lit(seed + 1), "row"), "row").limit(1024).select("vec", F.lit(0).alias("one"))
        share = first.groupBy("one").applyInPandas(_dense_share(least), "linked double").first()
        if share is None or share.linked >= _DENSE:  # one node, compared whole in blocks
            placed.append(own.select("row", F.lit(names[0]).alias("node")))
            uncut.append(names[0])
            continue
        fitted = _thresholds(sample, depths, spill, least, frozenset(names))
        placed.append(own.select("row", everywhere, "vec").select("row", "node", "vec").filter(F.col("node").isin(list(fitted))).mapInArrow(_route(fitted), "row long, node long"))
    if not placed:
        return vectors.select("row", F.lit(0).cast("long").alias("node"))
    members = placed[0]
    for more in placed[1:]:
        members = members.unionByName(more)
    members = stored(members, "leaves")
    while True:
        large = members.groupBy("node").count().filter(F.col("count") > leaf)
        if uncut:
            large = large.join(large.sparkSession.createDataFrame([(n,) for n in uncut], "node long"), "node", "left_anti")
        counts = {r[0]: r[1] for r in large.orderBy(F.desc("count"), "node").limit(nodes_a_round).collect()}
        if not counts:
            return members
        todo = F.broadcast(members.sparkSession.createDataFrame(list(counts.items()), "node long, rows long"))  # nodes_a_round rows at most
        inside = stored(members.join(todo, "node").join(vectors.select("row", "vec"), "row").select("row", "node", "vec", "rows"), "large")
        depths = {n: deep(c) for n, c in counts.items()}
        wanted = F.lit(float(sample_a_leaf)) * F.pow(F.lit(2.0), F.least(F.lit(max_depth), F.ceil(F.log2(F.col("rows") * 1.5 / leaf)))) + 64
        fitted = _thresholds(inside.filter(unit_hash(F.lit(seed), "row", "node") < wanted / F.col("rows")).select("node", "vec"), depths, spill, least)
        uncut += [n for n in counts if n not in fitted]
        if not fitted:
            continue
        cut = F.broadcast(members.sparkSession.createDataFrame([(n,) for n in fitted], "node long"))
        moved = inside.join(cut, "node", "left_semi").select("row", "node", "vec").mapInArrow(_route(fitted), "row long, node long")
        members = stored(members.join(cut, "node", "left_anti").unionByName(moved), "leaves")


def _thresholds(sample: DataFrame, depths: dict[int, int], spill: float, least: float, roots: frozenset[int] = frozenset()) -> dict[int, tuple]:
    fitted = sample.groupBy("node").applyInPandas(_fit(depths, spill, least, roots), "node long, depth int, dense boolean, low array<double>, high array<double>")
    return {r.node: (r.depth, np.array(r.low), np.array(r.high)) for r in fitted.collect() if not r.dense}


def near_vectors(rows: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = 8, leaf: int = 1024, spill: float = 0.05) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    own = F.col(vec_col).cast("array<double>")
    bad = F.exists(own, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(own, lambda x: x != 0)
    usable = F.coalesce((F.size(own) > 0) & F.col(id_col).isNotNull() & ~bad, F.lit(False))
    table = stored(rows.select(F.col(id_col).alias("vec_id"), F.when(usable, own).alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")
    classes = stored(table.filter("v is not null").groupBy("v").agg(F.min("row").alias("row"), F.count("*").alias("many")), "classes")
    vectors = stored(classes.mapInArrow(_packed, "row long, many long, size int, vec binary"), "units")
    members = forest(vectors, trees, leaf, spill, least)
    leaves = stored(members.groupBy("row").agg(F.sort_array(F.collect_list("node")).alias("leaves")), "leaves")  # a bounded number each
    counts = members.groupBy("node").agg(F.ceil(F.count("*") / leaf).cast("long").alias("blocks"))
    placed = members.join(counts, "node").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = paired.select("row", "node", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    full = paired.join(vectors.select("row", "many", "vec"), "row").join(leaves, "row")
    found = stored(full.groupBy("node", "first", "second").applyInPandas(_compare(least), "a long, b long, links long"), "found")
    links = found.filter("b is null").groupBy(F.col("a").alias("row")).agg(F.sum("links").alias("links"))
    linked = components(found.filter("b is not null").select("a", "b"))
    known = stored(classes.join(links, "row", "left").join(linked.select(F.col("node").alias("row"), "component"), "row", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "row").alias("component")), "known")
    joined = stored(table.join(known, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component"), "joined")
    smallest = stored(joined.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("smallest")), "smallest")
    return joined.join(smallest, "component", "left").select("vec_id", "n_links", F.coalesce("smallest", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.array(v, dtype="<f8") for v in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"row": batch.column(1), "many": batch.column(2), "size": pa.array(map(len, vectors), pa.int32()),
                                          "vec": pa.array([v.tobytes() for v in vectors], pa.binary())})
