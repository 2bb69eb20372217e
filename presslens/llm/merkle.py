"""Merkle manifest of a table by a butterfly exchange.

A row is a leaf: the SHA-256 of its columns, each with its length. The leaves of a source in
the order of their ids form a tree of ``fanout`` children a node; the roots of the sources, in
order, form a tree above them. The proof of a row is its siblings on every level.

Leaves get their place by a range partitioning of (source, id, leaf) and prefix sums of the
counts of each slice, so a source may hold any share of the rows. ``fanout ** block_levels``
leaves in a row are a block, whose task hashes the lowest levels. Then the blocks exchange
roots like a butterfly: in round r a block asks one block of each of its ``fanout`` - 1
siblings of that level (the one in the same place inside its subtree; places run round in a
last, smaller subtree) and hashes the common ancestor itself. All blocks of a subtree
therefore hold its root and the siblings of the rounds so far, and after the last round each
block has its upper proof: nothing is sent down. Sources are exchanged by the same rounds. A
round moves one digest for each block and sibling.

A run of one node is hashed like any other while its level has several nodes; a single leaf
is the root of its source. Null values count as a mark of their own; null ids and sources
come first, rows with one id stand in the order of their leaves. No rows give no rows. Only
the named columns count; others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from presslens.llm.common import stored

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<left: string, right: string>"


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of the values: ``-`` for null, else the UTF-8 length, ``:`` and the value."""
    parts = []
    for v in values:
        v = v.cast("string")
        parts.append(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level upwards, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(leaves: list[str], n: int, fanout: int, most: int) -> list[list[str]]:
    """The nodes of a block by level, from its leaves to its root; ``n`` leaves in its source."""
    levels = [leaves]
    while len(levels) <= most and n > 1:
        levels.append([_hash(levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        n = -(-n // fanout)
    return levels


def _block_roots(fanout: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, block, n, leaves = (batch.column(i).to_pylist() for i in range(4))
            roots = [_levels([x["leaf"].hex() for x in own], m, fanout, most)[-1][0] for own, m in zip(leaves, n, strict=True)]
            yield pa.RecordBatch.from_pydict({"s": pa.array(s, pa.int64()), "block": pa.array(block, pa.int64()), "n": pa.array(n, pa.int64()), "hash": roots})
    return run


def _leaf_proofs(fanout: int, most: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                n, rows, subroot, root, upper = row
                levels, out = _levels([x["leaf"].hex() for x in rows], n, fanout, most), []
                for i, x in enumerate(rows):
                    steps, at = [], i
                    for nodes in levels[:-1]:
                        first = at - at % fanout
                        steps.append({"left": "".join(nodes[first:at]), "right": "".join(nodes[at + 1:first + fanout])})
                        at //= fanout
                    found = x["found"].hex() if x["found"] is not None else None
                    out.append({"doc_id": x["doc_id"], "leaf": x["leaf"].hex(), "found_leaf": found, "subroot": subroot, "root": root, "proof": steps + upper})
                    if len(out) == 512:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _local_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's number among the rows of its source in this slice; rows are sorted by source."""
    import numpy as np

    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(1).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        place = np.arange(len(codes)) - np.repeat(new, np.diff(np.append(new, len(codes))))
        first, end = batch.column(1)[0].as_py(), batch.column(1)[-1].as_py()
        head = int(new[1]) if len(new) > 1 else len(codes)
        if count and first == last:
            place[:head] += count
        last, count = end, int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "place"])


def _placed(leaves: DataFrame) -> DataFrame:
    """(s, n, place, doc_id, leaf, found): number and rows of the source, place of the leaf in it."""
    kinds = dict(leaves.dtypes)
    order = ["source", "doc_id", "leaf"]
    sliced = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id())
    schema = f"doc_id {kinds['doc_id']}, source string, leaf binary, found binary, slice int, place long"
    sliced = stored(sliced.select("doc_id", "source", "leaf", "found", "slice").mapInArrow(_local_places, schema), "slices")
    counts = stored(sliced.groupBy("slice", "source").agg(F.count("*").alias("rows")), "counts")  # slices + sources rows at most
    numbers = counts.groupBy("source").agg(F.sum("rows").alias("n")).withColumn("s", F.row_number().over(W.orderBy("source")).cast("long") - 1)
    before = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0))).alias("c").join(
        numbers.alias("m"), F.col("c.source").eqNullSafe(F.col("m.source"))).select("c.slice", "c.source", "base", "n", "s")
    bases = stored(bases, "bases")
    joined = sliced.alias("a").join(bases.alias("b"), (F.col("a.slice") == F.col("b.slice")) & F.col("a.source").eqNullSafe(F.col("b.source")))
    return joined.select("s", "n", (F.col("base") + F.col("place")).alias("place"), "doc_id", "leaf", "found")


def _exchange(state: DataFrame, asked: DataFrame) -> DataFrame:
    """One round. ``asked``: (s, block, node, j, from_s, from_block), one row for each sibling j of a block's node.

    Blocks that ask nobody stand alone in their run and hash only themselves.
    """
    answers = asked.join(state.select(F.col("s").alias("from_s"), F.col("block").alias("from_block"), "hash"), ["from_s", "from_block"])
    side = lambda test: F.array_join(F.transform(F.filter("siblings", test), lambda x: x["hash"]), "")
    got = answers.groupBy("s", "block", "node").agg(F.sort_array(F.collect_list(F.struct("j", "hash"))).alias("siblings"))  # fanout - 1 at most
    got = got.select("s", "block", side(lambda x: x["j"] < F.col("node")).alias("left"), side(lambda x: x["j"] > F.col("node")).alias("right"))
    step = F.struct(F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"))
    return state.join(got, ["s", "block"], "left").select(
        "s", "block", "n", F.sha2(F.concat(step["left"], F.col("hash"), step["right"]), 256).alias("hash"), F.concat("proof", F.array(step)).alias("proof"))


def _siblings(rows: DataFrame, place: Column, count: Column, fanout: int, r: int) -> DataFrame:
    """A row for each sibling of a place's node on level r of ``count`` places: node, j, ``peer`` (a place inside j)."""
    span = fanout ** r
    nodes = F.expr("n_places div " + str(span)) + (F.col("n_places") % span != 0).cast("long")
    rows = rows.withColumns({"n_places": count.cast("long"), "at": place.cast("long")}).withColumn("node", F.expr(f"at div {span}"))
    first = F.col("node") - F.col("node") % fanout
    rows = rows.withColumn("j", F.explode(F.sequence(first, F.least(first + fanout, nodes) - 1))).filter("j != node")
    inside = F.least(F.lit(span).cast("long"), F.col("n_places") - F.col("j") * span)
    return rows.withColumn("peer", F.col("j") * span + (F.col("at") % span) % inside)


def merkle_proofs(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source_col: str = "source",
                  found: dict[str, Column] | None = None, fanout: int = FANOUT, block_levels: int = 3) -> DataFrame:
    """One row per document: doc_id, leaf, found_leaf, subroot, root, proof.

    ``proof`` is an array of (left, right) from the leaf upwards: the digests of the siblings
    on either side, joined. ``found`` gives columns as they are met later; ``found_leaf`` is the
    leaf with these in place, or null where every one of them is null.
    """
    kind = dict(docs.dtypes)[id_col]
    own = [F.col(c) for c in columns]
    met = F.lit(None).cast("string")
    if found:
        met = F.when(F.coalesce(*[c.cast("string") for c in found.values()]).isNotNull(),
                     leaf_digest([F.coalesce(found[c].cast("string"), F.col(c).cast("string")) if c in found else F.col(c) for c in columns]))
    leaves = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                                F.unhex(leaf_digest(own)).alias("leaf"), F.unhex(met).alias("found")), "leaves")
    size = fanout ** block_levels
    rows = _placed(leaves).withColumn("block", F.expr(f"place div {size}"))
    blocks = stored(rows.groupBy("s", "block", "n").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "leaf", "found"))).alias("rows")), "blocks")  # size at most
    roots = blocks.select("s", "block", "n", F.col("rows").alias("leaves")).mapInArrow(_block_roots(fanout, block_levels), "s long, block long, n long, hash string")
    state = stored(roots.withColumn("proof", F.array().cast(f"array<{_STEP}>")), "roots")
    places = lambda n: F.expr(f"({n} + {size - 1}) div {size}")
    sources, longest = state.agg(F.max("s"), F.max("n")).first()
    if sources is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, leaf string, found_leaf string, subroot string, root string, proof array<{_STEP}>")
    r = 0
    while -(-longest // size) > fanout ** r:
        deeper = state.filter(places("n") > fanout ** r)
        asked = _siblings(deeper.select("s", "block", "n"), F.col("block"), places("n"), fanout, r)
        moved = _exchange(deeper, asked.select("s", "block", "node", "j", F.col("s").alias("from_s"), F.col("peer").alias("from_block")))
        state = stored(moved.unionByName(state.filter(places("n") <= fanout ** r)), "round")
        r += 1
    # the same rounds over the sources; a block asks a block of the other source
    state = stored(state.withColumn("subroot", F.col("hash")), "subroots")
    subroots = state.select("s", "block", "subroot")
    state, sizes, r = state.drop("subroot"), state.groupBy("s").agg(F.first(places("n")).alias("peer_blocks")), 0
    while sources + 1 > fanout ** r:
        asked = _siblings(state.select("s", "block"), F.col("s"), F.lit(sources + 1), fanout, r).join(sizes.withColumnRenamed("s", "peer"), "peer")
        asked = asked.select("s", "block", "node", "j", F.col("peer").alias("from_s"), (F.col("block") % F.col("peer_blocks")).alias("from_block"))
        state = stored(_exchange(state, asked), "round")
        r += 1
    upper = state.join(subroots, ["s", "block"]).select("s", "block", "subroot", F.col("hash").alias("root"), F.col("proof").alias("upper"))
    out = f"doc_id {kind}, leaf string, found_leaf string, subroot string, root string, proof array<{_STEP}>"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)
    joined = blocks.join(upper, ["s", "block"]).select("n", "rows", "subroot", "root", "upper")
    return joined.mapInArrow(_leaf_proofs(fanout, block_levels, schema), out)
